import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockloom.operators import split, stats


@pytest.mark.parametrize("q", [0.0, 0.1, 0.5, 0.9, 0.9999, 1.0])
def test_quantile_of_awkward_values(frame, q):
    rng = random.Random(3)
    data = {
        "one": [4.0],
        "two": [1.0, 2.0],
        "ties": [5.0] * 400 + [7.0] * 3,
        "outliers": [rng.random() for _ in range(500)] + [1e300, -1e300],
        "normal": [rng.gauss(0, 1) for _ in range(1001)],
    }
    df = frame([(k, v) for k, s in data.items() for v in [*s, None, float("nan")]], "k string, v double")
    # A coarse sketch makes the bracket miss now and then; the result must not depend on it.
    for accuracy in (2, 20, 10_000):
        got = {r.k: r.quantile for r in stats.exact_quantile(df, "v", q, ["k"], accuracy).collect()}
        assert got.keys() == data.keys()
        for k, s in data.items():
            assert got[k] == pytest.approx(float(np.quantile(s, q)), rel=1e-9, abs=1e-12), (k, accuracy)
    alone = stats.exact_quantile(df.filter("k = 'normal'"), "v", q, accuracy=50).collect()
    assert [r.quantile for r in alone] == [pytest.approx(float(np.quantile(data["normal"], q)))]


def test_quantile_of_nothing(frame):
    empty = frame([], "k string, v double")
    assert stats.exact_quantile(empty, "v", 0.9, ["k"]).count() == 0
    assert [r.quantile for r in stats.exact_quantile(empty, "v", 0.9).collect()] in ([], [None])


def acf_by_definition(x, max_lag):
    x = np.array(x) - np.mean(x)
    return [float(x[: len(x) - k] @ x[k:] / (x @ x)) for k in range(min(max_lag + 1, len(x)))]


def test_acf_and_period(frame):
    rng = random.Random(1)
    data = {
        "wave": [math.sin(2 * math.pi * i / 13) + rng.random() / 9 for i in range(120)],
        "short": [1.0, 3.0, 2.0],
        "flat": [2.0, 2.0, 2.0],
        "single": [2.0],
    }
    rows = [(k, i, v) for k, s in data.items() for i, v in enumerate(s)] + [("wave", -1, None), ("wave", 500, float("nan"))]
    df = frame(rows, "k string, i int, v double")
    got = {}
    for r in stats.acf(df, ["k"], "i", "v", 52).collect():
        got.setdefault(r.k, {})[r.lag] = r.acf
    for k in ("wave", "short"):
        expected = acf_by_definition(data[k], 52)
        assert [got[k][lag] for lag in range(len(got[k]))] == pytest.approx(expected)
    assert set(got["flat"].values()) == {None} and got["single"] == {0: None}
    periods = {r.k: r.period_weeks for r in stats.detect_periodicity(df, ["k"], "i", "v").collect()}
    assert periods["wave"] in (6, 7, 13) and periods["flat"] is None and periods["single"] is None
    strengths = acf_by_definition(data["wave"], 52)
    assert periods["wave"] == 1 + int(np.argmax(np.abs(strengths[1:])))


def test_acf_of_long_series_in_blocks(frame):
    """Blocks of any size give what one piece gives: a hot key, short and flat ones, a NULL key, missing values, lags over several blocks."""
    rng = random.Random(8)
    rows = [("hot", i * 3, math.sin(i / 9) + rng.gauss(0, 1)) for i in range(3000)]
    rows += [(None, i, rng.random()) for i in range(40)] + [("short", i, v) for i, v in enumerate([1.0, 3.0, 2.0])] + [("flat", i, 2.0) for i in range(5)]
    rows += [("single", 7, 4.0), ("hot", -1, None), ("hot", 99_999, float("nan")), ("none", 1, None)]
    rng.shuffle(rows)
    df = frame(rows, "k string, i int, v double")
    for function, lags in ((stats.acf, 70), (stats.pacf, 12)):
        want = {(r[0], r[1]): r[2] for r in function(df, ["k"], "i", "v", lags).collect()}
        for block in (1, 64, 5000):
            got = {(r[0], r[1]): r[2] for r in function(df, ["k"], "i", "v", lags, block).collect()}
            assert got.keys() == want.keys()
            assert all(v is None if want[k] is None else v == pytest.approx(want[k], abs=1e-9) for k, v in got.items())
    keyless = df.where("k = 'hot'")
    cut, whole = (stats.detect_periodicity(keyless, [], "i", "v", 70, block).first() for block in (256, None))
    assert cut[:2] == whole[:2] and cut[2] == pytest.approx(whole[2], abs=1e-9)
    assert stats.acf(df.where("false"), ["k"], "i", "v", 5, 8).count() == 0


def test_pacf_against_normal_equations(frame):
    rng = random.Random(2)
    x = [rng.gauss(0, 1) for _ in range(60)]
    df = frame(list(enumerate(x)), "i int, v double")
    got = {r.lag: r.pacf for r in stats.pacf(df, [], "i", "v", 8).collect()}
    r = acf_by_definition(x, 8)
    for k in range(1, 9):
        matrix = np.array([[r[abs(i - j)] for j in range(k)] for i in range(k)])
        assert got[k] == pytest.approx(float(np.linalg.solve(matrix, r[1 : k + 1])[-1]))
    assert {r.pacf for r in stats.pacf(frame([(0, 1.0), (1, 1.0)], "i int, v double"), [], "i", "v").collect()} <= {None}


def test_mape_with_missing_and_zero(frame):
    df = frame([("a", 2.0, 1.0), ("a", 4.0, 5.0), ("b", 1.0, None), ("b", 1.0, 1.0), ("c", 0.0, 0.0), ("d", 1.0, float("nan"))], "k string, a double, p double")
    got = {r.k: r.mape for r in stats.mape(df, "a", "p", ["k"]).collect()}
    assert got == {"a": 0.375, "b": None, "c": 0.0, "d": None}


def test_intervals_cover(frame):
    rng = random.Random(4)
    rows = [(i, 10 + rng.gauss(0, 1), 10.0) for i in range(2000)]
    df = frame(rows, "i int, actual double, predicted double")
    out = stats.conformal_intervals(df.filter("i < 1000"), df.filter("i >= 1000"))
    inside = out.filter("actual between lower and upper").count()
    assert 870 <= inside <= 930
    q = float(np.quantile([abs(a - p) for i, a, p in rows if i < 1000], 0.9))
    assert out.first().upper == pytest.approx(10 + q)


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_random_split_sizes_and_repeatability(spark, n):
    df = spark.range(n).repartition(3)
    first = {r.id: r.split for r in split.split_frames(df, ["id"]).collect()}
    again = {r.id: r.split for r in split.split_frames(df.repartition(7), ["id"]).collect()}
    assert first == again and len(first) == n
    test = math.ceil(n * 0.2)
    assert sum(s == "test" for s in first.values()) == test
    assert sum(s == "cal" for s in first.values()) == math.ceil((n - test) * 0.2)
    if n == 1000:
        assert first != {r.id: r.split for r in split.split_frames(df, ["id"], seed=7).collect()}


def test_split_of_rows_with_one_key(spark):
    same = spark.range(50).select(F.lit(1).alias("k"))
    counts = {r.split: r["count"] for r in split.split_frames(same, ["k"]).groupBy("split").count().collect()}
    assert counts == {"test": 10, "cal": 8, "train": 32}


def test_running_total_and_global_split(spark):
    df = spark.range(100).select((F.col("id") % 7).alias("k"), F.col("id").alias("t")).repartition(5)
    rows = split.running_total(df.groupBy("k").count(), ["k"], "count", "upto").orderBy("k").collect()
    assert [r.upto for r in rows] == list(np.cumsum([r["count"] for r in rows]))
    ordered = sorted(((r.k, r.t), r.split) for r in split.time_split(df, "t", 0.2, ["k"], "global").collect())
    assert [s for _, s in ordered] == ["train"] * 80 + ["test"] * 20
    per_key = split.time_split(df, "t", 0.2, ["k"]).filter("split = 'test'").groupBy("k").count().collect()
    assert {r["count"] for r in per_key} == {3}


@pytest.mark.parametrize("mode", ["by_key", "global"])
def test_time_split_rows_are_not_merged_into_few_tasks(frame, unmerged, mode):
    rows = [(k, t, i) for k, times in (("a", [1, 2, 3, 3, 3, 3, 4]), (None, [5, None, 6, 6, 6]), ("b", [7, 7, 7])) for i, t in enumerate(times)]
    out = split.time_split(frame(rows, "k string, t int, i int"), "t", 0.4, ["k"], mode)
    # Rows settled by their group, and those of groups that hold a border.
    assert out.rdd.getNumPartitions() >= 2 * unmerged
    first = lambda v: (v is not None, v)
    ordered = sorted(rows, key=lambda r: (*first(r[0]), *first(r[1]), r[2]))
    groups = [ordered] if mode == "global" else [[r for r in ordered if r[0] == k] for k in (None, "a", "b")]
    expected = {r: "test" if i >= len(g) - math.ceil(0.4 * len(g)) else "train" for g in groups for i, r in enumerate(g)}
    assert {(r.k, r.t, r.i): r.split for r in out.collect()} == expected


def test_rows_of_a_large_key_stay_apart(frame, spark, monkeypatch):
    """Without joins of small tables by size, brackets and quantiles of large keys still reach the rows where they are."""
    monkeypatch.setattr(stats, "ACCURACY", 50)
    rows = [(k, float(i * 37 % 400), float(i)) for k, n in (("a", 400), (None, 300), ("few", 7)) for i in range(n)]
    df = frame(rows, "k string, actual double, predicted double")
    test = frame([*rows, ("unseen", 1.0, 2.0)], "k string, actual double, predicted double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        q = stats.exact_quantile(df, "actual", 0.9, ["k"], 50)
        assert q._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") >= 1
        out = stats.conformal_intervals(df, test, keys=["k"])
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "_dealt" in plan and plan.count("BroadcastHashJoin") >= 2
        got = out.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    errors = {k: np.quantile([abs(a - p) for key, a, p in rows if key == k], 0.9) for k in ("a", None, "few")}
    assert {r.k: r.quantile for r in q.collect()} == {k: pytest.approx(np.quantile([a for key, a, _ in rows if key == k], 0.9)) for k in errors}
    assert len(got) == len(rows) + 1
    for r in got:
        assert (r.lower, r.upper) == ((None, None) if r.k == "unseen" else pytest.approx((r.predicted - errors[r.k], r.predicted + errors[r.k])))
