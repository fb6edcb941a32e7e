import hashlib
import math
import re
import zlib

import duckdb
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from oracle import compare
from stockloom.llm import oracles, resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, longest=1, buckets=10000):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, longest=1, buckets=10000, least=20, percent=10):
    feats = [features(t, longest, buckets) for _, t in docs]
    s, t = [0] * buckets, [0] * buckets
    for _, fs in feats:
        for f in fs:
            s[f] += 1
    for text in target:
        for f in features(text, longest, buckets)[1]:
            t[f] += 1
    all_s, all_t = sum(s) + buckets, sum(t) + buckets
    gain = [math.floor(1000 * math.log((b + 1) * all_s / ((a + 1) * all_t))) for a, b in zip(s, t)]
    rows = []
    for (i, _), (n, fs) in zip(docs, feats):
        weight = sum(gain[f] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    fit = fit[: percent * len(fit) // 100]
    ranked = [(r[0], r[2], r[3], r[4], k) for k, r in enumerate(fit, 1)]
    chosen = {id(r) for r in fit}
    return sorted(ranked + [(r[0], r[2], r[3], r[4], None) for r in rows if id(r) not in chosen], key=repr)


def collect(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


LONG = " ".join(f"Word{k % 40}" for k in range(90))
DOCS = [(k, f"{LONG} own{k} über-{k % 3}") for k in range(30)] + [
    (40, None),
    (41, ""),
    (42, "...!"),
    (43, "a" * 200_000 + " b" * 40),
    (44, "x y " * 100_000),
    (45, LONG),
    (45, LONG),
    (45, LONG),
    (45, "other words " + LONG),
    (None, LONG),
    (None, LONG + " more"),
    (46, " ".join("w" * 19)),
    (47, " ".join("w" * 20)),
    (48, "Ä\x7fÖ[été]"),
]
TARGET = [(1, "word1 word2 own3"), (2, None), (3, ""), (4, "été WORD1"), (4, "été WORD1")]


@pytest.mark.parametrize("longest, percent", [(1, 10), (2, 40), (3, 100), (1, 0)])
def test_against_plain_loops(frame, longest, percent):
    docs = frame([(*d, 1, 2) for d in DOCS], "doc_id long, text string, rank int, score int")
    target = frame([(*t, 3) for t in TARGET], "item_id long, text string, n int")
    mine = collect(resampling.resampled(docs, target, longest=longest, percent=percent))
    assert mine == brute(DOCS, [t for _, t in TARGET], longest, percent=percent)


def test_empty_tables(frame):
    docs, target = frame(DOCS, "doc_id long, text string"), frame(TARGET, "item_id long, text string")
    assert collect(resampling.resampled(docs.limit(0), target)) == []
    assert collect(resampling.resampled(docs, target.limit(0))) == brute(DOCS, [])


def test_sql_on_the_same_rows(frame, tmp_path):
    docs, target = frame(DOCS, "doc_id long, text string"), frame(TARGET, "item_id long, text string")
    con = duckdb.connect()
    for name, rows in (("documents", docs), ("benchmark", target)):
        rows.write.parquet(str(tmp_path / name))
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path / name}/*.parquet'")
    assert compare(resampling.resampled(docs, target).toArrow(), con.sql(oracles.resampling()).to_arrow_table()) is None


def test_a_third_of_the_rows_alike(frame, monkeypatch):
    monkeypatch.setattr(resampling, "RUN", 7)
    docs = [(1, LONG)] * 100 + [(k, f"{LONG} {k}") for k in range(2, 202)]
    mine = collect(resampling.resampled(frame(docs, "doc_id long, text string"), frame(TARGET, "item_id long, text string"), percent=50))
    assert mine == brute(docs, [t for _, t in TARGET], percent=50)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.none() | st.text("aB é1.-ß\n", max_size=30), max_size=8), st.integers(1, 4), st.sampled_from([1, 40, 1 << 22]))
def test_grams_of_slices(texts, longest, size):
    old, resampling.SLICE_BYTES = resampling.SLICE_BYTES, size
    try:
        found, at = [[] for _ in texts], 0
        for part in resampling.slices(pa.array(texts, pa.string())):
            for owner, bucket in resampling.grams(part, longest, 997):
                for o, b in zip(owner, bucket):
                    found[at + o].append(int(b))
            at += len(part)
    finally:
        resampling.SLICE_BYTES = old
    assert [sorted(f) for f in found] == [sorted(features(t, longest, 997)[1]) for t in texts]
