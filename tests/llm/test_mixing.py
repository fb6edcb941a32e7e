import random
from collections import defaultdict
from fractions import Fraction

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from oracle import compare
from stockloom.llm import mixing, oracles


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=9))
def test_less_than_one_block_from_the_share(weights):
    shares = {f"s{k}": w for k, w in enumerate(weights)}
    total, had = sum(weights), defaultdict(int)
    rows = mixing.plan(shares)
    assert [r[2] for r in rows] == list(range(total))
    for source, turn, slot, release, due in rows:
        assert turn == had[source] and release <= slot < due
        had[source] += 1
        for s, w in shares.items():
            assert abs(had[s] - Fraction(w * (slot + 1), total)) < 1
    assert had == shares


def test_shares_are_checked():
    assert mixing.plan({}) == []
    with pytest.raises(ValueError):
        mixing.plan({"a": 0})
    with pytest.raises(ValueError):
        mixing.plan({"a": mixing.MOST_SLOTS, "b": 1})


def rows():
    rng = random.Random(5)
    out = [(k, "x" * rng.randrange(200), rng.choice(["a", "a", "a", "b", "c"])) for k in range(600)]
    return out + [(700, None, "a"), (701, "", "b"), (702, "y" * 5000, "c"), (703, "z", None), (704, "zz" * 70, None), (705, "q", "d"), (706, "twice", "b"), (706, "twice", "b")]


SCHEMA = "doc_id long, text string, source string, slot string, block double, key int"


def test_against_sql(frame):
    docs = frame([(*r, "s", 0.5, 1) for r in rows()], SCHEMA)
    con = duckdb.connect()
    con.register("given", docs.toArrow())
    mine = mixing.report(docs, mixing.tempered_shares(docs), block_chars=300)
    assert compare(mine.toArrow(), con.sql(oracles.mixing("given", block_chars=300)).to_arrow_table()) is None


def test_blocks_are_whole_and_the_mix_keeps_its_shares(frame):
    docs = frame([(*r, "s", 0.5, 1) for r in rows()], SCHEMA)
    shares = {"a": 3, "b": 2, "c": 1}
    got = mixing.report(docs, shares, block_chars=300).collect()
    assert len(got) == len(rows())
    sizes = {r[0]: len(r[1] or "") for r in rows()}
    blocks = defaultdict(list)
    for r in got:
        assert (r["slot"] is None) == (r["source"] not in shares)
        blocks[r["source"], r["block"]].append((r["place"], sizes[r["doc_id"]]))
    for texts in blocks.values():
        texts.sort()
        assert all(a + n <= b for (a, n), (b, _) in zip(texts, texts[1:]))
    slots = {(r["slot"]): (r["source"], r["block"]) for r in got if r["slot"] is not None}
    assert len(slots) == len({(r["source"], r["block"]) for r in got if r["slot"] is not None})
    assert all(r["release"] <= r["slot"] < r["due"] for r in got if r["slot"] is not None)


def test_rows_stay_whole(frame):
    docs = frame([(*r, "s", 0.5, 1) for r in rows()], SCHEMA)
    mixed = mixing.interleaved(docs, {"a": 1})
    assert mixed.select("row.*").schema == docs.schema
    assert sorted(map(repr, mixed.select("row.*").collect())) == sorted(map(repr, docs.collect()))
    empty = docs.limit(0)
    assert mixing.report(empty, mixing.tempered_shares(empty)).count() == 0
