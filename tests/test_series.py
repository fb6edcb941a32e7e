import math
import random

import pytest

from stockloom.operators import series


def points_by_walking(values, keep, turn):
    """The marking rule as a walk over one series."""
    found, kind, before, previous = [], None, None, None
    for i in range(1, len(values)):
        before = kind
        if values[i] > values[i - 1]:
            kind = "min"
        elif values[i] < values[i - 1]:
            kind = "max"
        if i > 1 and kind and (not turn or (before and kind != before)):
            found.append((i - 1, values[i - 1], kind))
    low = sorted((p for p in found if p[2] == "min"), key=lambda p: p[1])[:keep]
    high = sorted((p for p in found if p[2] == "max"), key=lambda p: -p[1])[:keep]
    return sorted(low + high)


@pytest.mark.parametrize("mode", ["run", "turn"])
def test_points_against_a_walk(frame, mode):
    rng = random.Random(5)
    all_series = {k: [float(rng.randint(0, 4)) for _ in range(rng.randint(1, 30))] for k in range(40)}
    all_series[100], all_series[101], all_series[102] = [3.0] * 5, [1.0], [2.0, 2.0, 1.0, 1.0, 3.0]
    rows = [(k, f"2021-01-{i + 1:02d}", v) for k, s in all_series.items() for i, v in enumerate(s)]
    df = frame(rows, "k int, d string, v double").selectExpr("k", "to_date(d) AS d", "v")
    got = {}
    for r in series.annotated_points(df, ["k"], "d", "v", keep=3, mode=mode).collect():
        got.setdefault(r.k, []).append((r.timestamp.day - 1, r.value, r.type))
        assert r.label == f"Jan {r.timestamp.day:02d} ({r.type})"
        extreme = min(all_series[r.k]) if r.type == "min" else max(all_series[r.k])
        assert r.is_global == (r.value == extreme)
    for k, s in all_series.items():
        assert sorted(got.get(k, [])) == points_by_walking(s, 3, mode == "turn"), s


def test_critical_points(frame):
    def marks(values):
        df = frame([(i, v) for i, v in enumerate(values)], "i int, v double")
        return sorted(r.i for r in series.critical_points(df, [], "i", "v").collect())

    assert marks([1.0, 2.0, 3.0, 2.0, 2.0, 5.0]) == [1, 3, 4, 5]
    assert marks([1.0, 1.0, 1.0]) == []
    assert marks([1.0, None, 2.0, float("nan"), 1.0]) == [2, 4]
    assert marks([7.0]) == []


def test_ranks_keep_missing_apart(frame):
    df = frame(
        [("a", 0.9, 0.2), ("b", -0.95, 0.1), ("c", 0.9, None), ("d", None, 0.1), ("e", math.nan, math.nan)],
        "metric string, periodicity_strength double, mape double",
    )
    got = {r.metric: (r.periodicity_rank, r.predictability_rank, r.overall_rank) for r in series.rank_metrics(df).collect()}
    assert got == {"a": (1, 2, 3), "b": (2, 1, 3), "c": (1, None, None), "d": (None, 1, None), "e": (None, None, None)}


def test_tail_and_lags(frame):
    df = frame([("a", i, i * i) for i in range(6)] + [("b", 1, 5)], "k string, i int, v int")
    assert sorted((r.k, r.i) for r in series.tail(df, ["k"], "i", 2).collect()) == [("a", 4), ("a", 5), ("b", 1)]
    lagged = {(r.k, r.i): (r.v_lag_1, r.v_lag_4) for r in series.lag_features(df, ["k"], "i", "v", [1, 4]).collect()}
    assert lagged["a", 5] == (16, 1) and lagged["a", 0] == (None, None) and lagged["b", 1] == (None, None)
