import random
import re
from collections import Counter

import numpy as np
import xxhash

from stockloom.llm import near_copies
from stockloom.llm.components import stars


def brute_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, links):
    to = {n: n for n in nodes}

    def root(n):
        while to[n] != n:
            n = to[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        to[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def brute(rows, distance=3):
    prints = [brute_print(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= distance]
    group = brute_components(range(len(rows)), links)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[group[i]] = min(doc_id, least.get(group[i], doc_id))
    return [(rows[i][0], f"{prints[i]:016x}", least.get(group[i])) for i in range(len(rows))]


def texts(n, seed=5):
    """Texts in families: each next one changes a few words of an earlier one."""
    rng, out = random.Random(seed), []
    for k in range(n):
        if out and rng.random() < 0.6:
            w = rng.choice(out).split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                w[rng.randrange(len(w))] = f"n{rng.random()}"
            out.append(" ".join(w))
        else:
            out.append(" ".join(f"v{rng.randrange(400)}" for _ in range(rng.choice([1, 2, 3, 60, 200]))))
    return out


ROWS = [(k * 7 % 211, t) for k, t in enumerate(texts(200))] + [(500, None), (501, ""), (502, " \n\t"), (None, "alone by itself here"), (None, None), (7, "Éa ÀB cd"), (7, "Éa ÀB cd"), (600, "word " * 30000)]


def collect(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_groups_against_all_pairs(frame):
    got = near_copies.report(frame(ROWS, "doc_id long, text string"))
    assert collect(got) == sorted(brute(ROWS), key=repr)


def test_shingles_of_no_words_and_few(frame):
    assert near_copies.fingerprint(None, 3) == near_copies.fingerprint(b" \n", 3) == 0
    assert near_copies.fingerprint(b"one TWO", 3) & (2**64 - 1) == xxhash.xxh64_intdigest(b"one two", 42)


def test_close_pairs_against_all_pairs(spark):
    """Clustered, biased and correlated bits, so that allotments are unequal."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 60, dtype=np.int64)
    flips = np.array([[1 << int(b) for b in rng.integers(0, 63, 3)] for _ in range(600)], dtype=np.int64)
    values = np.unique(np.concatenate([np.repeat(base, 10) ^ np.bitwise_or.reduce(flips, axis=1), base, base & 0xFFFF, np.arange(40)]))
    for distance in (0, 1, 3, 4):
        frame = spark.createDataFrame([(int(v),) for v in values], "fp long")
        got = {tuple(r) for r in near_copies.close_pairs(frame, distance).collect()}
        want = {(int(a), int(b)) for a in values for b in values if a < b and (int(a) ^ int(b)).bit_count() <= distance}
        assert got == want


def test_each_allotment_deals_out_all_errors():
    rng = np.random.default_rng(1)
    values = rng.integers(-(2**63), 2**63 - 1, 500, dtype=np.int64)
    values[:200] &= ~0xFFFF
    for widths in ([16] * 4, [22, 21, 21], [32, 32]):
        order = list(range(64))
        groups = [[order.pop(0) for _ in range(w)] for w in widths]
        near = []
        for g in groups:
            for c in near_copies._chunks(g):
                near.append(near_copies.by_distance(np.bincount(near_copies._value(values, c), minlength=1 << len(c)), 3))
        dealt = np.stack(near_copies.allotments(values, groups, near, len(values), 3))
        assert (dealt.sum(axis=0) == 4).all() and (dealt >= 0).all()
        if len(widths) == 4:
            assert (dealt[0, :200] == 0).all()  # a value that very many share is skipped


def test_by_distance_counts_neighbours():
    counts = np.array([3, 0, 1, 5, 0, 0, 2, 0.0])
    near = near_copies.by_distance(counts, 2)
    for v in range(8):
        by = Counter()
        for u in range(8):
            by[(u ^ v).bit_count()] += counts[u]
        assert [near[d, v] for d in range(3)] == [by[d] for d in range(3)]


def test_partitions_widen_with_the_table():
    assert [len(near_copies.widths_for(n, 3)) for n in (10**3, 10**6, 10**11)] == [4, 3, 2]


def test_stars_join_long_chains(spark):
    rng = random.Random(2)
    chain = list(range(300))
    rng.shuffle(chain)
    links = list(zip(chain, chain[1:])) + [(1000, k) for k in range(1001, 1100)] + [(5000, 5000), (6000, 6001), (6001, 6000)]
    got = {r["u"]: r["v"] for r in stars(spark.createDataFrame(links, "a long, b long")).collect()}
    want = brute_components({n for link in links for n in link}, links)
    assert got == {n: r for n, r in want.items() if n != r}
    assert stars(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each(frame):
    schema = "doc_id long, text string, root string, fp long, name int"
    docs = frame([(*r, "x", 1, 2) for r in ROWS], schema)
    kept = near_copies.one_of_each(docs)
    assert kept.schema == docs.schema
    want = {}
    for (doc_id, print_, component), (_, text) in zip(brute(ROWS), ROWS):
        want.setdefault(component, []).append(doc_id)
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(min((d for d in ids if d is not None), default=None) for ids in want.values())


def test_empty_table(frame):
    empty = frame([], "doc_id long, text string")
    assert near_copies.report(empty).count() == 0
    assert near_copies.one_of_each(empty).count() == 0
