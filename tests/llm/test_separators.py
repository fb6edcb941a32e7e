import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stockloom.llm import separators
from stockloom.session import fresh_folder

ROWS = [(1, "One small text."), (2, None), (3, ""), (4, "<|endoftext|> is text here"), (5, "wörd " * 4000), (5, "wörd " * 4000), (None, "x")]


def test_counts_against_direct_encoding(frame):
    encode = separators.encoder().encode_ordinary
    docs = frame([(*r, "p", 7) for r in ROWS], "doc_id long, text string, path string, ordinal int")
    got = sorted((tuple(r) for r in separators.report(docs).collect()), key=repr)
    assert got == sorted(((d, len(encode(t or ""))) for d, t in ROWS), key=repr)
    assert separators.report(docs.limit(0)).count() == 0


def brute(ids, end):
    out, start = [], 0
    for at, token in enumerate(ids):
        if token == end:
            out.append((len(out), start, at - start, True))
            start = at + 1
    if start < len(ids):
        out.append((len(out), start, len(ids) - start, False))
    return out


FILES = {
    "a.bin": [9, 9, 1, 2, 9, 3, 4, 5, 6, 7, 8, 1, 2, 9, 9, 4],
    "b.bin": [],
    "c.bin": [1] * 50 + [9],
    "d.bin": [5] * 33,
    "e.bin": [9],
    "f.bin": [1, 9] * 40 + [2, 2, 2],
}


@pytest.mark.parametrize("width", [2, 4])
@pytest.mark.parametrize("block_bytes", [1, 6, 16, 4096])
def test_boundaries_across_blocks(spark, width, block_bytes):
    folder = fresh_folder(spark, "flat")
    os.makedirs(folder)
    for name, ids in FILES.items():
        with open(f"{folder}/{name}", "wb") as f:
            f.write(np.array(ids, f"<u{width}").tobytes() + b"\0" * (name == "f.bin"))
    got = separators.document_spans(spark, folder, end=9, width=width, block_bytes=block_bytes).collect()
    for name, ids in FILES.items():
        mine = sorted((r["ordinal"], r["start"], r["n_tokens"], r["closed"]) for r in got if r["path"].endswith(name))
        assert mine == brute(ids, 9)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=200))
def test_any_file(spark, ids):
    folder = fresh_folder(spark, "flat")
    os.makedirs(folder)
    np.array(ids, "<u2").tofile(f"{folder}/x.bin")
    got = separators.document_spans(spark, folder, end=0, block_bytes=10)
    assert sorted((r["ordinal"], r["start"], r["n_tokens"], r["closed"]) for r in got.collect()) == brute(ids, 0)


def test_a_task_that_runs_again_leaves_whole_files(frame, spark):
    folder = fresh_folder(spark, "flat")
    docs = frame([(k, f"text number {k}") for k in range(50)], "doc_id long, text string")
    separators.write_tokens(docs, folder).count()
    first = {f: open(f"{folder}/flat/{f}", "rb").read() for f in os.listdir(f"{folder}/flat")}
    separators.write_tokens(docs, folder).count()
    assert {f: open(f"{folder}/flat/{f}", "rb").read() for f in os.listdir(f"{folder}/flat")} == first
    assert not os.listdir(f"{folder}/unfinished")
