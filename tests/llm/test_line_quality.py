import itertools
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stockloom.llm import line_quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_base(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    covered = {j for i, a in enumerate(windows) if windows.count(a) > 1 for j in range(i, i + 5)}
    lines = text.split("\n")
    dup = sum(1 for k, line in enumerate(lines) if WORD.search(line) and line in lines[:k])
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": dup, "n_repeat_words": len(covered)}


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("ab \n\té|#\x0b\x85\u3000")), max_size=120))
def test_base_counts(text):
    assert line_quality.measures(text.encode())[0] == brute_base(text)


def test_repeated_windows_stay_exact_for_large_vocabularies():
    rng = random.Random(3)
    words = [b"%d" % k for k in range(9000)] * 2 + [b"x%d" % rng.randrange(20000) for _ in range(5000)] + [b"9", b"10", b"11", b"12", b"13"]
    assert line_quality.repeated_words(words) == 18000 + 5
    assert line_quality.repeated_words([b"a"] * 5) == 0 and line_quality.repeated_words([b"a"] * 6) == 6


def path_score(labels, scores, trans):
    return sum(s * y for s, y in zip(scores, labels)) + sum(trans[a][b] for a, b in zip(labels, labels[1:]))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.floats(-3, 3), min_size=1, max_size=8), st.lists(st.floats(-3, 3), min_size=4, max_size=4))
def test_viterbi_against_all_labellings(scores, trans):
    trans = [trans[:2], trans[2:]]
    best = max(path_score(y, scores, trans) for y in itertools.product((0, 1), repeat=len(scores)))
    assert path_score(line_quality.viterbi(scores, trans), scores, trans) == pytest.approx(best)


def test_marginals_against_all_labellings():
    rng = np.random.default_rng(0)
    scores, trans = rng.normal(size=(3, 5)), rng.normal(size=(2, 2))
    mask = np.arange(5)[None] < np.array([[5], [3], [1]])
    logz, one, pairs = line_quality._marginals(scores, trans, mask)
    want = np.zeros((2, 2))
    for k, n in enumerate(mask.sum(axis=1)):
        weight = {y: np.exp(path_score(y, scores[k], trans)) for y in itertools.product((0, 1), repeat=int(n))}
        z = sum(weight.values())
        assert logz[k] == pytest.approx(np.log(z))
        for t in range(n):
            assert one[k, t] == pytest.approx(sum(w for y, w in weight.items() if y[t]) / z)
        for y, w in weight.items():
            for a, b in zip(y, y[1:]):
                want[a, b] += w / z
    assert np.allclose(pairs, want)


GOOD = "The small house stood by the river and nobody knew how old it was. Many years went by."
BAD = ["BUY NOW!! CHEAP!! OFFER!! CLICK!! HERE!! TODAY!! FREE!! SHIP!! BEST!! WIN!! PRIZE!! GO!!", "home | about | contact | login | cart | help | terms | privacy | sitemap | jobs | press"]


def corpus(n, seed):
    rng = random.Random(seed)
    rows, labels = [], []
    words = GOOD.split()
    for k in range(n):
        bad = rng.random() < 0.4
        lines = [" ".join(rng.sample(BAD[k % 2].split(" | " if k % 2 else " "), 8) + [f"{k}x", "| z" if k % 2 else "Y!!"]) if bad else " ".join(rng.sample(words, 12)) + f" {k}." for _ in range(rng.randrange(1, 6))]
        rows.append((k, "\n".join(lines)))
        labels.append((k, int(not bad)))
    return rows, labels


SCHEMA = "doc_id long, text string, kept int, rows string, label double"
WIDE = lambda rows: [(*r, 3, "r", 0.5) for r in rows]


def test_held_out_documents(frame):
    rows, labels = corpus(400, 1)
    truth = dict(labels)
    found = line_quality.report(frame(WIDE(rows), SCHEMA), frame(labels[:200], "doc_id long, quality int")).collect()
    held = [r for r in found if r["doc_id"] >= 200 and not r["base_failed"]]
    assert len(held) > 150
    assert sum(r["kept"] == bool(truth[r["doc_id"]]) for r in held) >= 0.97 * len(held)


EDGES = [(1, None), (2, ""), (3, "one two"), (4, GOOD), (4, GOOD), (None, GOOD), (5, "again and again so " * 9000), (6, "\n".join([GOOD] * 3)), (7, " \n\n ")]


def test_edge_rows_and_passing_through(frame):
    rows, labels = corpus(100, 2)
    docs, known = frame(WIDE(EDGES + rows), SCHEMA), frame(labels + [(None, 1), (3, None), (4, 7)], "doc_id long, quality int")
    found = line_quality.report(docs, known).collect()
    assert len(found) == len(EDGES) + 100
    base = {(r["doc_id"], *(r[c] for c in line_quality.BASE)) for r in found}
    assert {(d, *brute_base(t).values()) for d, t in EDGES if d != 5} <= base
    for r in found:
        failed = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
        assert r["base_failed"] == failed and (not failed or not r["kept"])
    kept = line_quality.retained(docs, line_quality.fitted(docs, known))
    assert kept.schema == docs.schema
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted((r["doc_id"] for r in found if r["kept"]), key=repr)


def test_without_labels_the_base_rules_decide(frame):
    none = frame([], "doc_id long, quality int")
    found = line_quality.report(frame(WIDE(EDGES), SCHEMA), none).collect()
    assert all(r["kept"] != r["base_failed"] for r in found)
    assert line_quality.report(frame([], SCHEMA), none).count() == 0


def test_repeated_ids_bound_the_sample(frame, monkeypatch):
    """One text per id is fitted on, however often the id stands in either table, and none of an id with both labels."""
    seen = []
    monkeypatch.setattr(line_quality, "fit", lambda sample: seen.append(sample))
    docs = frame([(1, GOOD)] * 50 + [(1, "a least text here")] + [(2, "home | about")] * 50 + [(3, GOOD)], "doc_id long, text string")
    line_quality.fitted(docs, frame([(1, 1)] * 600 + [(2, 0), (3, 0), (3, 1), (4, 1)], "doc_id long, quality int"))
    assert [(len(rows), label) for rows, label in seen[0]] == [(1, 0), (1, 1)]
    assert np.expm1(5 * seen[0][0][0][0][1]) == pytest.approx(len(min(GOOD, "a least text here").split()))
