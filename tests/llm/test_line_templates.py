import hashlib

import pytest

from oracle import compare
from stockloom.llm import line_templates, oracles


def log(k, host, place):
    return f"{k} Started session for user {host} on node {place}"


def own(k):
    return f"{'abcdefghijklmnop'[k] * 3} has words that no other text has"


ROWS = (
    [(k, "\n".join([log(k, f"u{k}", "north"), f"{own(k)}", "short line"])) for k in range(12)]
    + [(20 + k, f"Accepted login for {n} from outer gate today") for k, n in enumerate(["ann", "bob", "cyd", "dan", "eve", "fay"])]
    + [(40, f"An exact line that stands in many documents"), (41, "An exact line that stands in many documents\nAn exact line that stands in many documents")]
    + [(42 + k, "  An exact  line that stands\tin many documents ") for k in range(4)]
    + [(60, None), (61, ""), (62, "\n\n"), (None, "An exact line that stands in many documents"), (63, "few tokens here"), (64, "1 2 3 4 5 6 7 " * 3000)]
    + [(70, "A line in two rows of one id only"), (70, "A line in two rows of one id only")]
)
SCHEMA = "doc_id long, text string, line_no int, sig string, n_chars long"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    return duckdb.connect()


def test_against_sql(frame, duck):
    docs = frame([(*r, 3, "s", 1) for r in ROWS if r[0] is not None], SCHEMA)
    duck.register("given", docs.toArrow())
    assert compare(line_templates.report(docs).toArrow(), duck.sql(oracles.line_templates("given")).to_arrow_table()) is None


def test_variable_fields_and_exact_lines_go(frame):
    docs = frame([(*r, 3, "s", 1) for r in ROWS], SCHEMA)
    got = {}
    for r in line_templates.cleaned(docs, length="n_chars").collect():
        got.setdefault(r["doc_id"], []).append(r)
    text = lambda k: [r["text"] for r in got[k]]
    assert text(0) == [ROWS[0][1]]  # the first of its template keeps the line
    for k in range(1, 12):
        assert text(k) == [own(k)]
        assert got[k][0]["n_chars"] == len(text(k)[0])
    assert text(20) == ["Accepted login for ann from outer gate today"] and text(25) == [""]
    assert text(None) == ["An exact line that stands in many documents"]  # a null id comes first
    assert text(40) == [""] and text(41) == [""] and text(43) == [""]
    assert text(60) == [None] and text(61) == [""] and text(62) == ["\n\n"] and text(63) == ["few tokens here"]
    assert text(70) == ["A line in two rows of one id only"] * 2
    assert line_templates.cleaned(docs).schema == docs.schema


def test_first_keeps_one_line_of_a_template(frame):
    line = "The very same words of a line"
    rows = [(k, "\n".join([line, f"own {chr(97 + k)}", line])) for k in range(5)]
    got = {r["doc_id"]: r["text"] for r in line_templates.cleaned(frame(rows, "doc_id long, text string")).collect()}
    assert got == {0: f"{line}\nown a"} | {k: f"own {chr(97 + k)}" for k in range(1, 5)}


def test_digest_and_empty_table(frame):
    empty = frame([], "doc_id long, text string")
    assert line_templates.report(empty).count() == 0
    one = line_templates.report(frame([(1, "a\nb")], "doc_id long, text string")).collect()
    assert [tuple(r) for r in one] == [(1, 2, 0, hashlib.sha256(b"a\nb").hexdigest())]


def test_short_lines_that_recur_go(frame):
    """Menus and the like have few tokens. Numbers and addresses that stand alone are not one template."""
    short = ["All rights reserved.", "Menu", "Last changed 2024 by editors"]
    rows = [(k, "\n".join([*short, str(1000 + k), f"u{k}@example.org", f"Page {k}", f"Say no to {own(k)[:3]}"])) for k in range(5)]
    rows = [(k, t.replace("2024", str(2020 + k))) for k, t in rows] + [(9, "Rare words"), (10, "Rare words")]
    got = {r["doc_id"]: r["text"] for r in line_templates.cleaned(frame(rows, "doc_id long, text string")).collect()}
    assert got[0] == rows[0][1]
    for k in range(1, 5):
        assert got[k] == f"{1000 + k}\nu{k}@example.org\nPage {k}\nSay no to {own(k)[:3]}"
    assert got[9] == got[10] == "Rare words"


@pytest.mark.parametrize("names, sections", [(3, 3), (50, 10)])
def test_fields_whose_values_repeat(frame, names, sections):
    """Each value stands in several lines, more of them the larger the corpus; each line is in one document."""
    letters = "abcdefghij"
    name = lambda k: letters[k // 10] + letters[k % 10] + "ann"
    line = lambda a, b: f"This article was written by {name(a)} for the {letters[b]}part section"
    rows = [(a * sections + b, f"{line(a, b)}\nown {a} of {letters[b]}") for a in range(names) for b in range(sections)]
    rare = [f"This article was taken from {name(k)[::-1]} in our old archive" for k in range(6)]
    rows += [(1000 + k, t) for k, t in enumerate(rare)]
    got = {r["doc_id"]: r["text"] for r in line_templates.cleaned(frame(rows, "doc_id long, text string")).collect()}
    kept = [k for k in range(names * sections) if got[k].startswith("This")]
    assert len(kept) <= sections  # one of each template; a section may stay fixed
    assert [got[1000 + k] for k in range(6)] == [rare[0]] + [""] * 5
