import math
import re
from itertools import permutations

import pytest

from oracle import compare
from stockloom.llm import filter_audit, oracles

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, hash string, part int, bits string"
LABELS = "doc_id long, quality int, toxic int, good string"


def brute(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows = [(i, t or "", s or "") for i, t, s in docs]
    fails = []
    for i, t, s in rows:
        w = WORD.findall(t)
        f = ""
        f += "A" * (len(w) < 50)
        f += "B" * (100 * len(set(w)) < 65 * len(w))
        f += "C" * (100 * len(re.findall("[A-Z]", t)) > 5 * len(t))
        f += "D" * bool(re.search("[#$%&*|]", t))
        f += "E" * any(j is not None and i is not None and j < i and u == t for j, u, _ in rows)
        fails.append((i, s, f))
    out = {}
    for part in {s for _, s, _ in fails}:
        own = [(i, f) for i, s, f in fails if s == part]
        first = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [(i, f) for i, f in left if letter in f]
                left = [(i, f) for i, f in left if letter not in f]
                first[letter] += len(gone)
                failing = [f for _, f in own if letter in f]
                out[part, order, step] = [
                    len(left),
                    len(gone),
                    len(failing) - len(gone),
                    failing.count(letter),
                    sum(i in good for i, _ in gone),
                    sum(i in toxic for i, _ in gone),
                ]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(first[order[step - 1]])
    return sorted((*k, *v) for k, v in out.items())


def collect(frame):
    names = "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    return sorted(tuple(r) for r in frame.select(names).collect())


FINE = " ".join(f"word{k}" for k in range(60))
DOCS = [
    (1, FINE, "a"),
    (2, FINE, "a"),
    (2, FINE, "b"),
    (3, FINE + " #", "a"),
    (3, FINE + " #", "a"),
    (4, "SHOUT " * 60, None),
    (5, "short", ""),
    (6, "short", "a"),
    (6, "Short", "a"),
    (7, None, "b"),
    (8, "", "b"),
    (None, "short", "b"),
    (None, FINE, None),
    (9, "same word " * 40000 + "|", "b"),
    (10, FINE.replace(" ", "\xa0"), "b"),
    (11, FINE.replace(" ", "\x0b"), "c"),
]
MARKS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, 0, 1), (6, 1, 0), (6, 1, 0), (None, 1, 1), (99, 1, 1), (8, None, None), (9, None, 1)]


def frames(frame, docs, labels):
    return frame([(*d, "x", 1, "y") for d in docs], SCHEMA), frame([(*m, "z") for m in labels], LABELS)


def test_against_every_order(frame):
    assert collect(filter_audit.audit(*frames(frame, DOCS, MARKS))) == brute(DOCS, MARKS)


def test_empty_tables(frame):
    assert collect(filter_audit.audit(*frames(frame, [], MARKS))) == []
    assert collect(filter_audit.audit(*frames(frame, DOCS, []))) == brute(DOCS, [])


def test_sql_on_the_same_rows(frame, tmp_path):
    import duckdb

    docs, labels = frames(frame, DOCS, MARKS)
    con = duckdb.connect()
    for name, rows in (("documents", docs), ("labels", labels)):
        rows.write.parquet(str(tmp_path / name))
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path / name}/*.parquet'")
    assert compare(filter_audit.audit(docs, labels).toArrow(), con.sql(oracles.filter_audit()).to_arrow_table()) is None


def test_one_text_of_many_documents(frame):
    docs = [(i, "the very same text", f"s{i % 2}") for i in range(3000)]
    rows = collect(filter_audit.audit(*frames(frame, docs, [(5, 1, 0)])))
    at = {r[:3]: r[3:] for r in rows}
    assert at["s0", "EABCD", 1] == (1, 1499, 0, 0, 0, 0, 1499 * 60)
    assert at["s1", "EABCD", 1] == (0, 1500, 0, 0, 1, 0, 1500 * 60)


@pytest.mark.parametrize("k", range(1, 6))
def test_orders_in_which_one_of_k_filters_is_first(k):
    chosen = "ABCDE"[:k]
    assert sum(min(chosen, key=p.index) == "A" for p in permutations("ABCDE")) * k == math.factorial(5)
