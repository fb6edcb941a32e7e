import random
import re

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from oracle import compare
from stockloom.llm import oracles, overlap_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    size = min(4, len(w))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    group = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and group[i] != group[j]:
                o = len(sets[i] & sets[j])
                if 100 * o >= 85 * (len(sets[i]) + len(sets[j]) - o):
                    group = [group[j] if g == group[i] else g for g in group]
    least = {}
    for (doc_id, _), s, g in zip(docs, sets, group):
        if doc_id is not None and s:
            least[g] = min(least.get(g, doc_id), doc_id)
    return sorted(((d, len(s), least.get(g) if s else d) for (d, _), s, g in zip(docs, sets, group)), key=repr)


def collect(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", "n_shingles", "component_id").collect()), key=repr)


def families(seed, sizes, length, edits):
    """Groups of texts that differ from their first in a few words, or in a chain each from the one before."""
    rng, out = random.Random(seed), []
    for size in sizes:
        text = [f"w{rng.randrange(3000)}" for _ in range(length)]
        for k in range(size):
            out.append(" ".join(text) if k else " ".join(text).upper())
            if edits:
                text = text[:] if rng.random() < 0.5 else text
                for _ in range(rng.randint(0, edits)):
                    text[rng.randrange(len(text))] = f"w{rng.randrange(3000)}"
    return out


PASSAGE = " ".join(f"shared{k}" for k in range(60))
EDGE = [
    (1, None),
    (2, ""),
    (3, " \n\t"),
    (None, "one two three four five six seven eight"),
    (8, "one two three four five six seven EIGHT"),
    (4, "one two"),
    (5, "One\x0btwo"),
    (5, "One\x0btwo"),
    (6, "one two three"),
    (None, None),
    (None, "only without id"),
    (7, "x " * 50_000),
    (9, "x x x x x"),
    (10, " ".join(f"long{k}" for k in range(40_000))),
    (11, " ".join(f"long{k}" for k in range(39_000))),
    (12, "one\xa0two three"),
]


@pytest.fixture()
def small(monkeypatch):
    for name, value in {"SHARD": 5, "VISITORS": 3, "PACK": 20, "OFTEN": 2, "LONG_LISTS": 64}.items():
        monkeypatch.setattr(overlap_join, name, value)


def numbered(texts):
    return [(k * 7919 % 100_003, t) for k, t in enumerate(texts)]


def test_against_all_pairs(frame, small):
    texts = families(1, [40, 9, 9, 2, 1, 1], 60, 2) + families(2, [30], 120, 9) + [f"{PASSAGE} {t}" for t in families(3, [6, 1, 1, 1, 1, 1, 1], 9, 1)]
    texts += [f"{t} {PASSAGE}" for t in families(4, [4, 4, 1, 1], 30, 1)] + families(5, [3], 5, 1)
    docs = numbered(texts) + EDGE
    mine = collect(overlap_join.report(frame([(*d, 1, "s", 2) for d in docs], "doc_id long, text string, set int, shard string, n int")))
    assert mine == brute(docs)
    assert len({c for _, _, c in mine}) < len(docs) - 60


def test_usual_sizes_and_sql(frame, tmp_path):
    docs = numbered(families(6, [50, 3, 1], 80, 3)) + [(200_000 + k, t) for k, t in enumerate(["", None, "a b", "a b"])]
    rows = frame(docs, "doc_id long, text string")
    mine = overlap_join.report(rows).toArrow()
    rows.write.parquet(str(tmp_path / "documents"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    assert compare(mine, con.sql(oracles.overlap_join()).to_arrow_table()) is None


def test_empty_table_and_no_links(frame):
    none = frame([], "doc_id long, text string")
    assert collect(overlap_join.report(none)) == []
    docs = [(1, "a b c d e"), (2, "f g h i j"), (3, None)]
    assert collect(overlap_join.report(frame(docs, "doc_id long, text string"))) == brute(docs)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sets(st.integers(0, 25), min_size=1), min_size=1, max_size=12), st.sampled_from([0.0085, 1.0, 50.0]), st.sampled_from([50, 85, 100]))
def test_partners_are_all_sets_that_link(sets, mu, least):
    old, overlap_join.MU = overlap_join.MU, mu
    try:
        arrays = [np.array(sorted(s), np.uint64) for s in sets]
        lists = overlap_join.Lists(arrays)
        for k, s in enumerate(sets):
            links = [j for j, o in enumerate(sets) if 100 * len(s & o) >= least * len(s | o)]
            assert list(lists.partners(arrays[k], least)) == links
            assert list(lists.partners(arrays[k], least, below=k)) == [j for j in links if j < k]
    finally:
        overlap_join.MU = old


@given(st.sets(st.integers(0, 90), min_size=1), st.sets(st.integers(0, 90), min_size=1), st.integers(0, 91))
def test_sets_that_link_share_a_first_shingle(a, b, cut):
    long = np.arange(cut, 91, dtype=np.uint64), np.arange(91 - cut)[::-1].copy()
    if 100 * len(a & b) >= 85 * len(a | b):
        first = [set(overlap_join.first_shingles(np.array(sorted(s), np.uint64), long, 85).tolist()) for s in (a, b)]
        assert len(first[0] & first[1]) > min(overlap_join.EXTRA * overlap_join.threshold(len(s), 85) // 100 for s in (a, b))
