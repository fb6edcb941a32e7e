import os
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockloom.operators import stats
from stockloom.plans import forecast, labelling, regression
from stockloom.session import fresh_folder

MONDAY = date(2020, 1, 6)


def weekly(frame, data):
    rows = [(k, MONDAY + timedelta(weeks=i), None if v is None else float(v)) for k, s in data.items() for i, v in enumerate(s)]
    return frame(rows, "k string, week_start date, sales double")


def ahead(df, **options):
    got = {}
    for r in forecast.seasonal_forecast(df, ["k"], **options).orderBy("k", "lag", "date").collect():
        got.setdefault((r.k, r.lag), []).append(r)
    return got


def test_trend_and_season_go_on(frame):
    season = [10, 12, 9, 30]
    data = {"line": [5 + 2 * i for i in range(80)], "season": [season[i % 4] + 100 for i in range(80)], "both": [season[i % 4] + 3 * i for i in range(80)]}
    got = ahead(weekly(frame, data), lags=[1, 4], horizon=8)
    for (k, lag), rows in got.items():
        assert [r.date for r in rows] == [MONDAY + timedelta(weeks=80 + i) for i in range(8)]
        assert {r.status for r in rows} == {"ok"} and {r.interpolated for r in rows} == {0}
        expected = {"line": [5 + 2 * i for i in range(80, 88)], "season": [season[i % 4] + 100 for i in range(80, 88)], "both": [season[i % 4] + 3 * i for i in range(80, 88)]}[k]
        if lag == 4 or k == "line":
            assert [r.forecast for r in rows] == pytest.approx(expected, abs=1e-4), (k, lag)


def test_known_coefficients_are_found():
    rng = np.random.default_rng(0)
    noise = rng.normal(size=3000)
    w = np.zeros(3000)
    for t in range(1, 3000):
        w[t] = 0.6 * w[t - 1] + noise[t] + 0.3 * noise[t - 1]
    fit = forecast._SeasonalFit(np.cumsum(w), (1, 1, 1), (0, 0, 0), 1, "n").fit(200)
    assert fit.x == pytest.approx([0.6, 0.3], abs=0.06)
    drift = forecast._SeasonalFit(np.cumsum(w + 2), (1, 1, 1), (0, 0, 0), 1, "c").fit(200)
    assert drift.beta[0] / (1 - drift.x[0]) == pytest.approx(2, abs=0.3)


def test_short_and_gappy_series(frame):
    data = {"short": [1, 2, 3], "gap": [None if i in (7, 8) else 5 + i for i in range(60)], "empty": [None] * 30}
    got = ahead(weekly(frame, data), lags=[1, 52], horizon=3)
    assert {r.status for r in got["short", 1]} == {"too_short"} and {r.forecast for r in got["short", 1]} == {None}
    assert {r.status for r in got["gap", 52]} == {"too_short"}
    assert {(r.status, r.interpolated) for r in got["gap", 1]} == {("ok", 2)}
    assert [r.forecast for r in got["gap", 1]] == pytest.approx([65, 66, 67], abs=1e-4)
    assert {r.status for r in got["empty", 1]} == {"too_short"}


@pytest.mark.parametrize("bad", [{"lags": [0]}, {"lags": []}, {"trend": "q"}, {"order": (1, 1)}, {"order": (-1, 1, 1)}])
def test_arguments_are_checked(frame, bad):
    with pytest.raises(ValueError):
        forecast.seasonal_forecast(weekly(frame, {"a": [1, 2]}), ["k"], **bad)


@pytest.mark.parametrize("trend", ["n", "c", "t", "ct"])
def test_trends_and_orders_run(frame, trend):
    rng = np.random.default_rng(1)
    data = {"a": 50 + np.arange(90) * 0.5 + rng.normal(size=90)}
    for order, seasonal in [((1, 1, 1), (1, 1, 1)), ((2, 1, 0), (0, 1, 1)), ((0, 1, 2), (0, 0, 0)), ((0, 1, 0), (0, 0, 0))]:
        rows = ahead(weekly(frame, data), lags=[4], horizon=4, trend=trend, order=order, seasonal=seasonal)["a", 4]
        assert all(80 < r.forecast < 110 for r in rows)


def test_holdout(frame):
    season = np.array([0.0, 4.0, -3.0, 1.0, 7.0])
    data = {"line": [10 + 3 * i for i in range(50)], "season": [100 + season[i % 5] + 0.5 * i for i in range(60)], "tiny": [1, 2]}
    df = weekly(frame, data)
    periods = frame([("line", None), ("season", 5), ("tiny", 9)], "k string, period_weeks int")
    got = {r.k: r.mape for r in forecast.assess_predictability(df, ["k"], "week_start", "sales", periods).collect()}
    assert got["line"] == pytest.approx(0, abs=1e-9) and got["season"] < 0.02 and got["tiny"] is None
    alone = forecast.assess_predictability(df.filter("k = 'line'"), [], "week_start", "sales").collect()
    assert [r.mape for r in alone] == [pytest.approx(0, abs=1e-9)]
    long = forecast.holdout_predictions(df.filter("k = 'season'"), ["k"], "week_start", "sales", periods.withColumn("period_weeks", F.lit(30)))
    assert long.filter("predicted is not null").count() == 0 and long.count() == 12


def smoothed(y, period, weights, horizon):
    """Additive Holt-Winters of one series by plain loops: squared error and forecast."""
    alpha, beta, gamma = weights
    m = period or 1
    first, second = (float(np.mean(y[a : a + m])) for a in (0, m))
    trend = (second - first) / m
    level = first - trend * (m + 1) / 2 if period else y[0] - trend
    season = [y[i] - first - trend * (i - (m - 1) / 2) if period else 0.0 for i in range(m)]
    loss = 0.0
    for t, seen in enumerate(y):
        s, base = season[t % m], level + trend
        loss += (seen - base - s) ** 2
        new = alpha * (seen - s) + (1 - alpha) * base
        trend = beta * (new - level) + (1 - beta) * trend
        season[t % m] = gamma * (seen - base) + (1 - gamma) * s if period else 0.0
        level = new
    return loss, [level + h * trend + season[(len(y) + h - 1) % m] for h in range(1, horizon + 1)]


def test_holdout_of_many_series_at_once(frame, monkeypatch):
    monkeypatch.setattr(forecast, "SMOOTHED_AT_ONCE", 3)
    rng = np.random.default_rng(3)
    periods = {None: 4, "none": None, "one": 1, "long": 30, **{f"p{i}": (0, 4, 6)[i % 3] for i in range(12)}}
    data = {k: rng.integers(1, 90, 20 + 3 * i).astype(float).tolist() for i, k in enumerate(periods)}
    df = weekly(frame, data).join(frame([*periods.items()], "j string, period_weeks int"), F.col("k").eqNullSafe(F.col("j"))).drop("j")
    held = forecast.holdout_predictions(df, ["k"], "week_start", "sales")
    assert "FlatMapGroups" not in held._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in held.orderBy("week_start").collect():
        got.setdefault(r.k, []).append((r.actual, r.predicted))
    assert got.keys() == data.keys()
    for k, y in data.items():
        cut = int(len(y) * 0.8)
        period = periods[k] if periods[k] and 1 < periods[k] < cut else 0
        assert [a for a, _ in got[k]] == y[cut:]
        if cut < 2 * period:
            assert all(p is None for _, p in got[k])
            continue
        centre, best = [0.5] * 3, None
        for width in (1 / 2, 1 / 6, 1 / 18, 1 / 54):
            axes = [np.clip(np.linspace(c - width, c + width, 5), 0, 1) for c in centre]
            sets = [(a, b, c) for a in axes[0] for b in axes[1] for c in (axes[2] if period else [0.0])]
            found = min(((*smoothed(y[:cut], period, w, len(y) - cut), w) for w in sets), key=lambda f: f[0])
            if best is None or found[0] <= best[0]:
                best, centre = found, found[2]
        assert [p for _, p in got[k]] == pytest.approx(best[1], rel=1e-9, abs=1e-9)


def test_metric_analysis_skips_short_series(frame):
    rows = [(MONDAY + timedelta(weeks=i), float(10 + (i % 4) * 5), float(i) if i < 6 else None, 7.0) for i in range(40)]
    df = frame(rows, "d date, a double, b double, flat double")
    out = {r.metric: r for r in forecast.analyze_metrics(df, ["a", "b", "flat"], "d", max_lag=12).collect()}
    assert out.keys() == {"a", "flat"}
    assert (out["a"].period_weeks, out["a"].periodicity_rank) == (4, 1)
    assert (out["flat"].period_weeks, out["flat"].periodicity_rank, out["flat"].overall_rank) == (None, None, None)
    assert out["flat"].mape == pytest.approx(0, abs=1e-9) and out["flat"].predictability_rank is not None


def test_boosted_trees_beat_the_mean(spark):
    df = spark.range(1200).select("id", (F.col("id") % 13).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"))
    df = df.withColumn("y", F.col("a") * 3 + F.when(F.col("b") > 2, 10).otherwise(0))
    df = df.withColumn("a", F.when(F.col("id") % 50 != 0, F.col("a")))
    model, tested, residuals = regression.regress_with_intervals(df, ["a", "b"], "y", ["id"], trees=10)
    error = stats.rmse(tested, "actual", "predicted").first().rmse
    spread = tested.agg(F.stddev_pop("actual")).first()[0]
    assert error < spread / 3
    n = 1200 - 24
    assert tested.count() == -(-n // 5) and residuals.filter("residual < 0").count() == 0
    names = [r.feature for r in regression.feature_importances(spark, model, ["a", "b"]).collect()]
    assert names == ["a", "b"]
    folder = fresh_folder(spark, "results")
    regression.write_results(folder, tested, residuals, regression.feature_importances(spark, model, ["a", "b"]))
    back = {name: spark.read.option("header", True).csv(f"{folder}/{name}") for name in os.listdir(folder)}
    assert set(back["predictions_with_intervals"].columns) == {"id", "actual", "predicted", "lower", "upper"}
    assert set(back["raw_predictions"].columns) == {"id", "predicted"} and back["raw_predictions"].count() == tested.count()
    assert set(back["calibration_residuals"].columns) == {"id", "residual"} and back["feature_importances"].count() == 2


def test_labelling(frame):
    calls = []

    def model(prompt):
        items = [line.split(": ")[1].split(",")[0] for line in prompt.splitlines() if line.startswith("- ")]
        if "3" in items:
            return "no idea"
        return "{" + ", ".join(f'"{i}": "s{i}"' for i in items) + "}"

    df = frame([(i, f"n{i}") for i in range(10)], "item int, name string").coalesce(1).orderBy("item")
    got = {r.item: r.segment for r in labelling.label_items(df, model, ["name"], "item", batch_size=4).collect()}
    assert got == {i: (None if i < 4 else f"s{i}") for i in range(10)}
    echoed = labelling.label_items(df, labelling.classifier("MOCK"), ["name"], "item")
    assert echoed.filter("segment is not null").count() == 0 and echoed.count() == 10
    with pytest.raises(ValueError):
        labelling.classifier("unknown")


def test_fits_of_many_series_are_those_of_each():
    rng = np.random.default_rng(3)
    ys = [np.round(100 + 30 * rng.normal(size=n)) for n in (70, 58, 70, 64, 9, 70)] + [np.arange(66.0)]
    for order, seasonal, lag in [((1, 1, 1), (1, 1, 1), 4), ((1, 1, 1), (0, 0, 0), 1), ((2, 1, 0), (0, 1, 2), 4), ((0, 1, 0), (0, 0, 0), 2)]:
        for few in (0, 160):
            forecast.FEW, kept = few, forecast.FEW
            try:
                got = forecast._fit_all(ys, lag, order, seasonal, "n", 5, 200)
            finally:
                forecast.FEW = kept
            for y, (status, ahead, rss, start) in zip(ys, got):
                one = forecast._SeasonalFit(y, order, seasonal, lag, "n")
                if not one.usable():
                    assert (status, ahead, rss) == ("too_short", None, None)
                    continue
                one.fit(200)
                assert status == ("ok" if one.converged else "not_converged")
                assert ahead == pytest.approx(one.forecast(5), rel=1e-6, abs=1e-6)
                assert (rss, start) == pytest.approx((float(one.e @ one.e), one.start_loss), rel=1e-8, abs=1e-9)


def test_many_series_take_few_fits(frame, monkeypatch):
    """The number of fits that Python makes one by one does not grow with the series."""
    calls = []
    monkeypatch.setattr(forecast._SeasonalFit, "fit", lambda self, steps: calls.append(1))
    rng = np.random.default_rng(4)
    assert {s for s, *_ in forecast._fit_all([rng.normal(size=60) for _ in range(30)], 4, (1, 1, 1), (1, 1, 1), "n", 3, 20)} <= {"ok", "not_converged"}
    assert not calls


def test_an_answer_is_parsed_once_for_its_batch(frame):
    df = frame([(i, f"n{i}") for i in range(10)], "item int, name string").coalesce(1)
    out = labelling.label_items(df, lambda prompt: '{"1": "a"}', ["name"], "item", batch_size=4)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" in plan and "from_json" not in plan.split("Generate explode")[0]
    assert {r.item: r.segment for r in out.collect()} == {i: "a" if i == 1 else None for i in range(10)}
