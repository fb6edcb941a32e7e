import difflib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from checks import people
from stockloom.operators import dimension, joins
from stockloom.session import fresh_folder

WORDS = ["total_sales", "revenue", "product", "region", "customer_id", "order_date", "quantity", "price"]
PLACE = "id int, name string, latitude double, longitude double"


def test_fuzzy_sample(frame):
    tokens = frame([(t,) for t in "total_sales by product avg_sales by brand".split()], "token string")
    got = {r.token: r.match for r in joins.fuzzy_match(tokens, frame([(w,) for w in WORDS], "word string")).collect()}
    assert got == {"total_sales": "total_sales", "by": None, "product": "product", "avg_sales": "total_sales", "brand": None}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("cutoff", [0.2, 0.5, 0.75, 1.0])
def test_fuzzy_against_all_words(frame, cutoff):
    rng = random.Random(2)
    make = lambda n: "".join(rng.choice("abé") for _ in range(n))
    tokens = {make(rng.randrange(9)) for _ in range(60)}
    words = {make(rng.randrange(9)) for _ in range(200)}
    got = joins.fuzzy_match(frame([(t,) for t in [*tokens, None]], "token string"), frame([(w,) for w in [*words, None]], "word string"), cutoff)
    for token, match in got.collect():
        best = max((1 - distance(token, w) / max(len(token), len(w), 1), w) for w in words)
        assert match == (best[1] if best[0] >= cutoff else None)


@settings(max_examples=300, deadline=None)
@given(st.text("abc_", max_size=14), st.text("abc_", max_size=14))
def test_letters_in_matching_blocks(a, b):
    want = sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
    assert joins.matched_letters(a, b) == want


def test_fuzzy_sample_by_matching_blocks(frame):
    tokens = frame([(t,) for t in "total_sales by product avg_sales by brand".split()], "token string")
    got = {r.token: r.match for r in joins.fuzzy_match(tokens, frame([(w,) for w in WORDS], "word string"), 0.6, measure="blocks").collect()}
    assert got == {"total_sales": "total_sales", "by": None, "product": "product", "avg_sales": "total_sales", "brand": None}


@pytest.mark.parametrize("cutoff", [0.6, 0.8])
def test_matching_blocks_against_all_words(frame, cutoff):
    rng = random.Random(3)
    make = lambda n: "".join(rng.choice("abcdeé") for _ in range(n))
    words = {make(rng.randrange(14)) for _ in range(150)}
    tokens = {make(rng.randrange(14)) for _ in range(40)} | {w[: rng.randrange(15)] + make(2) + w[rng.randrange(8) :] for w in sorted(words)[:60]}
    got = joins.similar_words(frame([(t,) for t in tokens], "token string"), frame([(w,) for w in words], "word string"), cutoff, "blocks")
    ratio = lambda t, w: difflib.SequenceMatcher(None, w, t, autojunk=False).ratio()
    want = {(t, w): ratio(t, w) for t in tokens for w in words if ratio(t, w) >= cutoff}
    assert {(r.token, r.word): r.score for r in got.collect()} == want
    assert len(want) > 40


def test_words_meet_on_segments(frame):
    """A thousand words of one length, of which only like ones are measured."""
    rng = random.Random(5)
    words = [("".join(rng.choice("abcdefghijklmnop") for _ in range(12)),) for _ in range(1000)]
    tokens, words = frame(words, "token string"), frame(words, "word string")
    on = ["_long", "_short", "_part", "_letters"]
    a, b = (joins._segments(f.toDF(n), n, f.toDF("o"), "edits", 0.75, x) for f, n, x in ((tokens, "t", True), (words, "w", False)))
    assert a.join(b, on).select("t", "w").distinct().count() < 30_000
    assert joins.fuzzy_match(tokens, words, 0.75).where("match = token").count() == 1000
    plan = joins.fuzzy_match(tokens, words, 0.75)._jdf.queryExecution().toString()
    assert "_letters" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_fuzzy_cutoff_is_checked(frame):
    with pytest.raises(ValueError):
        joins.fuzzy_match(frame([("a",)], "token string"), frame([("a",)], "word string"), 0)


def near_by_comparing(points, known, eps):
    out = {}
    for pid, _, lat, lon in points:
        hits = [k for k in known if abs(k[2] - lat) < eps and abs(k[3] - lon) < eps]
        out[pid] = min(hits)[0] if hits else None
    return out


@pytest.mark.parametrize("keep", [1, 3, 16])
def test_near_points_in_crowded_cells(frame, keep):
    rng = random.Random(keep)
    spread = lambda n, base: [(base + i, f"p{i}", rng.uniform(-0.0004, 0.0004), rng.uniform(10, 10.0004)) for i in range(n)]
    known = spread(300, 1000)
    # Least ids lie at the far side of a cell, so the short list of that cell alone would miss the match.
    known += [(i, "low", 0.00009 + i * 1e-9, 10.00009) for i in range(30)]
    points = spread(300, 5000) + [(1, "edge", 0.0, 10.0), (2, "edge", 0.0001, 10.0001), (3, "far", 50.0, 50.0)]
    got = joins.near_locations(frame(points, PLACE), frame(known, PLACE), 1e-4, keep=keep).collect()
    assert {r.id: r.match_id for r in got} == near_by_comparing(points, known, 1e-4)
    assert len(got) == len(points)


def test_near_points_without_coordinates(frame):
    points, known = frame([(1, "a", None, 2.0), (2, "b", 1.0, 2.0)], PLACE), frame([(9, "k", 1.0, 2.0), (8, "n", 1.0, None)], PLACE)
    assert {r.id: r.match_id for r in joins.near_locations(points, known).collect()} == {1: None, 2: 9}


def test_a_crowd_out_of_reach_is_not_compared(frame, monkeypatch):
    """Known locations and points crowd two adjoining cells, farther than eps from each other."""
    rng = random.Random(3)
    eps = 1e-4
    known = [(i, "k", rng.uniform(0, 1e-5), rng.uniform(0, 1e-5)) for i in range(3000)]
    points = [(i, "p", rng.uniform(1.3e-4, 1.5e-4), rng.uniform(0, 1e-5)) for i in range(3000)]
    got = joins.near_locations(frame(points, PLACE), frame(known, PLACE), eps)
    assert got.filter("match_id IS NOT NULL").count() == 0
    touching = [(i, "p", rng.uniform(0.9e-4, 1.1e-4), rng.uniform(0, 1e-5)) for i in range(300)]
    got = joins.near_locations(frame(touching, PLACE), frame(known, PLACE), eps).collect()
    assert {r.id: r.match_id for r in got} == near_by_comparing(touching, known, eps)


def test_add_new_locations(frame):
    known = frame([(1, "home", 1.0, 1.0)], PLACE)
    points = frame([(7, "near home", 1.00005, 1.0), (9, "new b", 5.00002, 5.0), (8, "new a", 5.00001, 5.0), (6, "nowhere", None, 5.0)], PLACE)
    assert sorted(r.id for r in joins.add_new_locations(known, points).collect()) == [1, 8]


def test_add_new_locations_one_after_the_other(frame):
    """Points on both sides of cell borders, and chains in which each is near the next."""
    rng = random.Random(6)
    known = [(i, "k", rng.uniform(0, 0.002), rng.uniform(0, 0.002)) for i in range(20)]
    points = [(100 + i, "p", rng.uniform(0, 0.002), rng.uniform(0, 0.002)) for i in range(150)]
    points += [(1000 + i, "chain", 7.0, 7.0 + i * 0.00009) for i in range(12)] + [(2001, "left", 0.0001 - 1e-8, 9.0), (2002, "right", 0.0001 + 1e-8, 9.0)]
    want = list(known)
    for p in sorted(points):
        if all(abs(p[2] - k[2]) >= 1e-4 or abs(p[3] - k[3]) >= 1e-4 for k in want):
            want.append(p)
    got = joins.add_new_locations(frame(known, PLACE), frame(points, PLACE), 1e-4)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def one_after_the_other(known, points, eps):
    """Plain rule, with the added ones in cells of eps."""
    cells, want = {}, []

    def put(p):
        want.append(p)
        cells.setdefault((int(p[2] // eps), int(p[3] // eps)), []).append(p)

    for p in known:
        put(p)
    for p in sorted(points):
        cy, cx = int(p[2] // eps), int(p[3] // eps)
        close = [k for dy in (-2, -1, 0, 1, 2) for dx in (-2, -1, 0, 1, 2) for k in cells.get((cy + dy, cx + dx), ())]
        if all(abs(p[2] - k[2]) >= eps or abs(p[3] - k[3]) >= eps for k in close):
            put(p)
    return sorted(want)


def test_add_new_locations_along_a_chain(frame, monkeypatch):
    """Two thousand points, each near the next and in order of id: a few rounds, not one per second point."""
    points = [(k, "chain", 3.0, 3.0 + k * 0.00009) for k in range(2000)]
    looks, plain = [], joins.near_locations
    monkeypatch.setattr(joins, "near_locations", lambda *args: (looks.append(1), plain(*args))[1])
    got = joins.add_new_locations(frame([], PLACE), frame(points, PLACE), 1e-4)
    assert sorted(tuple(r) for r in got.collect()) == one_after_the_other([], points, 1e-4)
    # One look at the known ones, and one for each half tile of 256 cells along 1,800 cells.
    assert len(looks) <= 1 + 8


@pytest.mark.parametrize("tile", [4, 512])
def test_add_new_locations_in_crowds_and_small_tiles(frame, monkeypatch, tile):
    """Crowds of more points in a cell than a tile looks at, chains across and along tile borders, equal ids and repeated rows."""
    monkeypatch.setattr(joins, "TILE", tile)
    rng = random.Random(tile)
    points = [(rng.randrange(10**6), rng.choice("ab"), rng.uniform(0, 3e-4), rng.uniform(0, 3e-4)) for _ in range(600)]
    points += [(2 * 10**6 + k, "zig", 0.0004 + (k % 2 * 2 - 1) * 1e-6, 0.002 + k * 0.00003) for k in range(40)]
    points += [(5, "same", 0.001, 0.001), (5, "same", 0.001, 0.001), (5, "more", 0.00105, 0.001), (5, "far", 0.003, 0.001)]
    known = [(9, "home", 0.0001, 0.0001)]
    got = joins.add_new_locations(frame(known, PLACE), frame(points, PLACE), 1e-4)
    assert sorted(tuple(r) for r in got.collect()) == one_after_the_other(known, points, 1e-4)


def test_items_to_label(frame):
    sold = frame([(1, "a"), (1, "a"), (2, "b"), (3, "c")], "item int, name string")
    dim = frame([(1, None), (2, "x")], "item int, segment string")
    assert sorted(r.item for r in joins.items_to_label(sold, dim, "item", "segment", ["name"]).collect()) == [1, 3]
    assert [r.item for r in joins.items_to_label(sold, dim, "item", "segment", ["name"], 1).collect()] == [1]
    assert joins.items_to_label(sold, dim, "item", "segment", ["name"], -1).count() == 2


def test_upsert_by_key(frame):
    users = frame([("a", "A", 1), ("b", "B", 2)], "email string, name string, phone int")
    updates = frame([("a", "old", "x", 1), ("a", None, "x", 2), ("c", "C", "x", 1), (None, "N", "x", 1)], "email string, name string, extra string, seq int")
    got = sorted(tuple(r) for r in dimension.upsert_by_key(users, updates, "email", "seq").collect())
    assert got == [("a", None, 1), ("b", "B", 2), ("c", "C", None)]


def test_upsert_dimension_replaces_by_key(frame):
    dim = frame([(1, "x", "old"), (2, "y", "keep")], "item int, name string, segment string")
    updates = frame([(1, "b", None), (1, "a", None), (3, "z", "s"), (3, "z", "t")], "item int, name string, segment string")
    got = sorted(tuple(r) for r in dimension.upsert_dimension(dim, updates, "item", ["name"], "segment").collect())
    assert got == [(1, "a", None), (2, "y", "keep"), (3, "z", "t")]


def test_logins(frame):
    logins = frame([("a", "x", 1), ("n", "y", 2), ("n", None, 3)], "email string, provider string, seq int")
    rows = {r.seq: r for r in dimension.append_logins(frame([("a",)], "email string"), logins, "email", "seq").collect()}
    assert {s: r.is_new for s, r in rows.items()} == {1: False, 2: True, 3: False}
    assert rows[3].provider == "google" and rows[2].provider == "y"
    assert rows[3].raw_payload == '{"email":"n"}'


def test_delete_counts_rows(frame):
    left, affected = dimension.delete_by_key(frame([(1,), (2,)], "k int"), frame([(2,), (2,), (9,)], "k int"), "k")
    assert [r.k for r in left.collect()] == [1] and affected.first().affected == 1


def test_holiday_weeks(frame):
    weekly = frame([("2024-07-01",), ("2024-07-08",), ("2024-12-30",)], "w string").selectExpr("to_date(w) AS week_start")
    days = frame([("2024-07-04", "fourth"), ("2024-07-07", "sunday"), ("2025-01-01", "new year")], "d string, name string")
    flagged = joins.flag_holiday_weeks(weekly, days.selectExpr("to_date(d) AS date", "name")).orderBy("week_start").collect()
    assert [(r.holidays, r.is_holiday_week) for r in flagged] == [(["fourth", "sunday"], True), (None, False), (["new year"], True)]


def files_of(spark, path):
    import glob

    return {b: sorted(glob.glob(f"{path}/rows/_bucket={b}/*.parquet")) for b in range(16)}


def test_upsert_and_delete_touch_their_buckets_only(spark, frame):
    path = fresh_folder(spark, "users")
    rows = [(k, f"u{k}", k % 3) for k in range(200)] + [(None, "nobody", 0)]
    dimension.create_bucketed(frame(rows, "id long, name string, n int"), path, "id", 16)
    before = files_of(spark, path)
    updates = frame([(7, "seven", 1), (7, "seven!", 2), (1000, "new", 1), (None, "lost", 1)], "id int, name string, seq int")
    rewritten = dimension.upsert_bucketed(spark, path, updates, "id", "seq")
    after = files_of(spark, path)
    assert rewritten == sum(before[b] != after[b] for b in range(16)) <= 2
    got = {(r.id, r.name, r.n) for r in dimension.read_bucketed(spark, path).collect()}
    assert got == {r for r in rows if r[0] != 7} | {(7, "seven!", 1), (1000, "new", None)}
    assert dimension.delete_bucketed(spark, path, frame([(5,), (5,), (None,), (4242,)], "id long"), "id") == 1
    last = files_of(spark, path)
    assert sum(after[b] != last[b] for b in range(16)) in (1, 2)
    assert {(r.id, r.name, r.n) for r in dimension.read_bucketed(spark, path).collect()} == got - {(5, "u5", 2)}
    assert dimension.upsert_bucketed(spark, path, frame([], "id long, name string"), "id") == 0


def test_a_bucket_may_be_emptied(spark, frame):
    path = fresh_folder(spark, "users")
    dimension.create_bucketed(frame([(1, "a"), (2, "b"), (3, "c")], "id long, name string"), path, "id", 1)
    assert dimension.delete_bucketed(spark, path, frame([(1,), (2,), (3,)], "id long"), "id") == 3
    dimension.create_bucketed(frame([(k, "x") for k in range(40)], "id long, name string"), f"{path}2", "id", 16)
    gone = [tuple(r) for r in spark.read.parquet(f"{path}2/rows").where("_bucket = 3").select("id").collect()]
    assert gone and dimension.delete_bucketed(spark, f"{path}2", frame(gone, "id long"), "id") == len(gone)
    assert files_of(spark, f"{path}2")[3] == []
    assert dimension.read_bucketed(spark, f"{path}2").count() == 40 - len(gone)


def test_items_sold_are_not_merged_into_few_tasks(spark, frame, unmerged):
    folder = fresh_folder(spark, "sold")
    frame([(k, f"name {k}", "SMALL") for k in range(40)], "p_partkey long, p_name string, p_type string").write.parquet(f"{folder}/part.parquet")
    lines = [(k, (k or 0) % 3 + j, "RN"[j % 2]) for k in [*range(39), None] for j in range(4)]
    frame([*lines, *lines], "l_partkey long, l_suppkey long, l_returnflag string").write.parquet(f"{folder}/lineitem.parquet")
    assert people.items_sold(spark, folder).count() == 39 * 4
    out = people.collapsed_items(spark, folder)
    assert out.rdd.getNumPartitions() >= unmerged
    assert {tuple(r) for r in out.collect()} == {(k, f"name {k}", "SMALL", f"NAME {k}" if k % 4 else None) for k in range(39)}
