import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stockloom.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, tests):
    out = []
    for doc_id, text in docs:
        w, hit, items = words(text), set(), set()
        for item, t in tests:
            p = words(t)
            size = min(13, len(p))
            for j in range(len(p) - size + 1 if size else 0):
                for i in range(len(w) - size + 1):
                    if w[i : i + size] == p[j : j + size]:
                        hit.update(range(i, i + size))
                        items |= {str(item)} if item is not None else set()
        digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(items), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return out


LONG = " ".join(f"w{i}" for i in range(40))
DOCS = [
    (1, f"Start here, {LONG.upper()}! And an end."),
    (2, None),
    (3, ""),
    (4, "nothing to see"),
    (5, " ".join(f"w{i}" for i in range(7, 21)) + " x" * 300),
    (6, "Été à la ßtraße, oui"),
    (6, "Été à la ßtraße, oui"),
    (None, "Short item"),
    (8, " ".join(f"w{i}" for i in range(12))),
    (9, "q " * 5000 + LONG),
    (10, "a a a a a a a a a a a a a a a a"),
]
TESTS = [(7, LONG), (70, LONG[3:]), (3, "short ITEM"), (4, None), (5, ""), (9, "été à"), (None, "nothing to see"), (11, "a " * 14), (12, "!?")]


def collect(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("block_chars", [decontaminate.BLOCK_CHARS, 100])
def test_against_every_position(frame, block_chars):
    docs, tests = frame(DOCS, "doc_id long, text string"), frame(TESTS, "item_id long, text string")
    assert collect(decontaminate.report(docs, tests, block_chars=block_chars)) == sorted(brute(DOCS, TESTS), key=repr)


def test_empty_tables(frame):
    docs, tests = frame(DOCS, "doc_id long, text string"), frame([], "item_id long, text string")
    assert not any(r["contaminated"] for r in decontaminate.report(docs, tests).collect())
    assert decontaminate.report(frame([], "doc_id long, text string"), tests).count() == 0


def test_rows_stay_whole_beside_clashing_names(frame):
    schema = "doc_id long, text string, hits string, row int, items double, n_words long"
    docs = frame([(*r, "h", 1, 0.5, 9) for r in DOCS], schema)
    kept = decontaminate.without_contaminated(docs, frame(TESTS, "item_id long, text string"))
    assert kept.schema == docs.schema
    clean = [r[0] for r, b in zip(DOCS, brute(DOCS, TESTS)) if not b[5]]
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted(clean, key=repr)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=40), st.lists(st.lists(st.sampled_from("abc"), min_size=1, max_size=6), max_size=6))
def test_search_finds_each_place_once(text, patterns):
    text, patterns = [t.encode() for t in text], {tuple(w.encode() for w in p) for p in patterns}
    found = sorted(decontaminate.occurrences(text, decontaminate.search_tables(patterns)))
    assert found == sorted((i, p) for p in patterns for i in range(len(text) - len(p) + 1) if tuple(text[i : i + len(p)]) == p)
