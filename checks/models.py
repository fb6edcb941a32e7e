"""Errors, quantiles, autocorrelation, splits, forecasts and regression."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks.base import PART_WEEKS, TYPE_WEEKS, part_weeks, query, sales, table, type_weeks
from checks.sales import points_sql
from stockloom.operators import aggregate, series, split, stats
from stockloom.plans import forecast, regression
from stockloom.plans.mart import weekly_sales
from stockloom.session import fresh_folder
from stockloom.sources import tables

LAST = "PARTITION BY l_partkey ORDER BY week_start"


def naive_predictions(spark, d):
    """Each week of a part predicted by the week before."""
    lagged = series.lag_features(part_weeks(spark, d), ["l_partkey"], "week_start", "qty", [1])
    known = lagged.filter(F.col("qty_lag_1").isNotNull())
    return known.select(
        "l_partkey", "week_start", F.col("qty").cast("double").alias("actual"), F.col("qty_lag_1").cast("double").alias("predicted")
    )


NAIVE = f"""SELECT l_partkey, week_start, qty::double AS actual, before::double AS predicted
FROM (SELECT *, lag(qty) OVER ({LAST}) AS before FROM ({PART_WEEKS})) WHERE before IS NOT NULL"""


@query(f"SELECT l_partkey, round(sqrt(avg((actual - predicted) ** 2)), 6) AS rmse FROM ({NAIVE}) GROUP BY 1")
def error_rmse(spark, d):
    out = stats.rmse(naive_predictions(spark, d), "actual", "predicted", ["l_partkey"])
    return out.withColumn("rmse", F.round("rmse", 6))


@query(
    f"""SELECT l_partkey, round(avg(abs(actual - predicted) / greatest(abs(actual), 2.220446049250313e-16)), 6) AS mape
FROM ({NAIVE}) GROUP BY 1"""
)
def error_mape(spark, d):
    out = stats.mape(naive_predictions(spark, d), "actual", "predicted", ["l_partkey"])
    return out.withColumn("mape", F.round("mape", 6))


def priced(spark, d):
    """Line prices predicted from the quantity alone."""
    return table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_linestatus",
        "l_returnflag",
        F.col("l_extendedprice").alias("actual"),
        (F.col("l_quantity") * 1500).alias("predicted"),
    )


PRICED = "SELECT *, l_extendedprice AS actual, l_quantity * 1500 AS predicted FROM lineitem"


@query(f"SELECT l_linestatus, round(quantile_cont(abs(actual - predicted), 0.9), 4) AS q FROM ({PRICED}) GROUP BY 1")
def error_quantile_by_key(spark, d):
    out = stats.abs_error_quantile(priced(spark, d), "actual", "predicted", 0.1, ["l_linestatus"])
    return out.withColumn("q", F.round("q", 4))


@query(f"SELECT round(quantile_cont(abs(actual - predicted), 0.9), 4) AS q FROM ({PRICED})")
def error_quantile(spark, d):
    out = stats.abs_error_quantile(priced(spark, d), "actual", "predicted", 0.1)
    return out.withColumn("q", F.round("q", 4))


# Every eleventh part has no key; NULL counts as a key of its own.
KEYED = f"SELECT * REPLACE (CASE WHEN l_partkey % 11 <> 0 THEN l_linestatus END AS l_linestatus) FROM ({PRICED})"


def keyed(spark, d):
    return priced(spark, d).withColumn("l_linestatus", F.when(F.col("l_partkey") % 11 != 0, F.col("l_linestatus")))


@query(f"SELECT l_linestatus, round(quantile_cont(abs(actual - predicted), 0.9), 4) AS q FROM ({KEYED}) GROUP BY 1")
def error_quantile_null_key(spark, d):
    out = stats.abs_error_quantile(keyed(spark, d), "actual", "predicted", 0.1, ["l_linestatus"])
    return out.withColumn("q", F.round("q", 4))


@query(
    f"""WITH p AS ({KEYED}), q AS (SELECT l_linestatus, quantile_cont(abs(actual - predicted), 0.9) AS q FROM p WHERE l_returnflag = 'R' GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_partkey, l_linestatus, round(predicted - q, 4) AS lower, round(predicted + q, 4) AS upper
FROM p JOIN q ON p.l_linestatus IS NOT DISTINCT FROM q.l_linestatus WHERE l_returnflag <> 'R'""".replace("l_partkey, l_linestatus", "l_partkey, p.l_linestatus")
)
def prediction_intervals_null_key(spark, d):
    rows = keyed(spark, d)
    cal, test = rows.filter(F.col("l_returnflag") == "R"), rows.filter(F.col("l_returnflag") != "R")
    out = stats.conformal_intervals(cal, test, keys=["l_linestatus"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_linestatus", F.round("lower", 4).alias("lower"), F.round("upper", 4).alias("upper"))


def intervals_sql(key):
    on = f"JOIN q USING ({key})" if key else "CROSS JOIN q"
    by = f"{key}, " if key else ""
    group = "GROUP BY 1" if key else ""
    return f"""WITH p AS ({PRICED}),
q AS (SELECT {by}quantile_cont(abs(actual - predicted), 0.9) AS q FROM p WHERE l_returnflag = 'R' {group})
SELECT l_orderkey, l_linenumber, l_partkey, actual, predicted, round(predicted - q, 4) AS lower, round(predicted + q, 4) AS upper
FROM p {on} WHERE l_returnflag <> 'R'"""


def _intervals(spark, d, keys):
    rows = priced(spark, d)
    cal, test = rows.filter(F.col("l_returnflag") == "R"), rows.filter(F.col("l_returnflag") != "R")
    out = stats.conformal_intervals(cal, test, keys=keys)
    kept = ["l_orderkey", "l_linenumber", "l_partkey", "actual", "predicted"]
    return out.select(*kept, F.round("lower", 4).alias("lower"), F.round("upper", 4).alias("upper"))


@query(intervals_sql(""))
def prediction_intervals(spark, d):
    return _intervals(spark, d, [])


@query(intervals_sql("l_linestatus"))
def prediction_intervals_by_key(spark, d):
    return _intervals(spark, d, ["l_linestatus"])


def acf_sql(weeks, key):
    return f"""WITH x AS (SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY week_start) AS i,
    qty - avg(qty) OVER (PARTITION BY {key}) AS x FROM ({weeks})),
s AS (SELECT {key}, count(*) AS n, sum(x * x) AS ss FROM x GROUP BY 1)
SELECT {key}, lag::int AS lag, CASE WHEN any_value(ss) > 0 THEN sum(a.x * b.x) / any_value(ss) END AS r
FROM s JOIN range(0, 53) l(lag) ON lag < n JOIN x a USING ({key}) JOIN x b ON b.{key} = a.{key} AND b.i = a.i + lag GROUP BY 1, 2"""


@query(f"SELECT p_type, lag, round(r, 6) + 0 AS acf FROM ({acf_sql(TYPE_WEEKS, 'p_type')})")
def autocorrelation(spark, d):
    return stats.acf(type_weeks(spark, d), ["p_type"], "week_start", "qty").withColumn("acf", F.round("acf", 6))


@query(
    """WITH m AS (SELECT event_type, date_trunc('minute', ts) AS minute, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL),
x AS (SELECT event_type, n - avg(n) OVER (PARTITION BY event_type) AS v, row_number() OVER (PARTITION BY event_type ORDER BY minute) AS p FROM m),
k AS (SELECT a.event_type, (b.p - a.p)::int AS lag, sum(a.v * b.v) AS s FROM x a JOIN x b ON a.event_type = b.event_type AND b.p BETWEEN a.p AND a.p + 200 GROUP BY ALL)
SELECT k.event_type, k.lag, CASE WHEN z.s > 1e-9 THEN round(k.s / z.s, 6) + 0 END AS acf FROM k JOIN k z ON k.event_type = z.event_type AND z.lag = 0"""
)
def autocorrelation_by_minute(spark, d):
    """Long series: the minutes with events of a type, over 200 lags, in blocks."""
    minutes = table(spark, d, "events").where("ts IS NOT NULL").groupBy("event_type", F.date_trunc("minute", "ts").alias("minute")).agg(F.count("*").alias("n"))
    return stats.acf(minutes, ["event_type"], "minute", "n", 200, block=4096).withColumn("acf", F.round("acf", 6))


@query(
    f"""WITH RECURSIVE r AS (SELECT p_type, list(r ORDER BY lag) AS r, count(*) AS n FROM ({acf_sql(TYPE_WEEKS, 'p_type')}) GROUP BY 1),
p AS (SELECT p_type, 1 AS k, [r[2]] AS phi, r[2] AS value, 1 - r[2] * r[2] AS err FROM r
  UNION ALL SELECT p_type, k + 1, list_append([phi[j] - a * phi[k + 1 - j] for j in range(1, k + 1)], a), a, err * (1 - a * a)
  FROM (SELECT p.*, (r.r[k + 2] - list_sum([phi[j] * r.r[k + 2 - j] for j in range(1, k + 1)])) / err AS a
    FROM p JOIN r USING (p_type) WHERE k + 1 < n))
SELECT p_type, 0::int AS lag, 1.0::double AS pacf FROM r UNION ALL SELECT p_type, k::int, round(value, 6) + 0 FROM p"""
)
def partial_autocorrelation(spark, d):
    return stats.pacf(type_weeks(spark, d), ["p_type"], "week_start", "qty").withColumn("pacf", F.round("pacf", 6))


@query(
    f"""SELECT l_partkey, lag AS period_weeks, round(r, 6) + 0 AS periodicity_strength FROM ({acf_sql(PART_WEEKS, 'l_partkey')}) WHERE lag > 0
QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY round(abs(r), 9) DESC, lag) = 1"""
)
def dominant_period(spark, d):
    found = stats.detect_periodicity(part_weeks(spark, d), ["l_partkey"], "week_start", "qty").drop("n")
    return found.withColumn("periodicity_strength", F.round("periodicity_strength", 6))


@query(
    f"""WITH m AS (SELECT p_type, year(week_start)::int AS metric, round(stddev_pop(qty), 3) AS strength, round(avg(qty), 0) AS error FROM ({TYPE_WEEKS}) GROUP BY 1, 2),
v AS (SELECT p_type, metric, CASE WHEN metric % 4 > 0 THEN strength END AS periodicity_strength, error AS mape FROM m),
k AS (SELECT *, CASE WHEN periodicity_strength IS NOT NULL THEN dense_rank() OVER (PARTITION BY p_type ORDER BY periodicity_strength DESC NULLS LAST) END AS a,
  dense_rank() OVER (PARTITION BY p_type ORDER BY mape) AS b FROM v)
SELECT p_type, metric, periodicity_strength, mape, a::int AS periodicity_rank, b::int AS predictability_rank, (a + b)::int AS overall_rank FROM k"""
)
def metric_ranks(spark, d):
    yearly = type_weeks(spark, d).groupBy("p_type", F.year("week_start").alias("metric"))
    found = yearly.agg(F.round(F.stddev_pop("qty"), 3).alias("strength"), F.round(F.avg("qty"), 0).alias("mape"))
    strength = F.when(F.col("metric") % 4 > 0, F.col("strength")).otherwise(float("nan"))
    return series.rank_metrics(found.withColumn("periodicity_strength", strength).drop("strength"), ["p_type"])


@query(
    """WITH s AS (SELECT count(*) AS n, ceil(count(*) * 0.2)::bigint AS t FROM lineitem),
c AS (SELECT n, t, ceil((n - t) * 0.2)::bigint AS k FROM s)
SELECT 'test' AS split, t AS n FROM c UNION ALL SELECT 'cal', k FROM c UNION ALL SELECT 'train', n - t - k FROM c"""
)
def random_split_sizes(spark, d):
    parts = split.split_frames(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    return parts.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""SELECT l_partkey, week_start, qty, CASE WHEN row_number() OVER ({LAST}) <= n - ceil(n * 0.2) THEN 'train' ELSE 'test' END AS split
FROM ({PART_WEEKS}) JOIN (SELECT l_partkey, count(*) AS n FROM ({PART_WEEKS}) GROUP BY 1) USING (l_partkey)"""
)
def time_split_by_key(spark, d):
    return split.time_split(part_weeks(spark, d), "week_start", 0.2, ["l_partkey"])


@query(
    f"""SELECT l_partkey, week_start, qty, CASE WHEN row_number() OVER (ORDER BY l_partkey, week_start) <= n - ceil(n * 0.2) THEN 'train' ELSE 'test' END AS split
FROM ({PART_WEEKS}), (SELECT count(*) AS n FROM ({PART_WEEKS}))"""
)
def time_split_global(spark, d):
    return split.time_split(part_weeks(spark, d), "week_start", 0.2, ["l_partkey"], mode="global")


SOME_WEEKS = f"""SELECT CASE WHEN l_partkey % 11 <> 0 THEN l_partkey END AS l_partkey, week_start, sum(qty)::bigint AS qty FROM ({PART_WEEKS}) GROUP BY 1, 2"""


def some_weeks(spark, d):
    """Weekly quantity per part, those of every eleventh part under the NULL key."""
    key = F.when(F.col("l_partkey") % 11 != 0, F.col("l_partkey")).alias("l_partkey")
    return part_weeks(spark, d).groupBy(key, "week_start").agg(F.sum("qty").alias("qty"))


@query(
    f"""WITH w AS ({SOME_WEEKS}), p AS (SELECT *, row_number() OVER ({LAST}) AS i, count(*) OVER (PARTITION BY l_partkey) AS n FROM w)
SELECT l_partkey, week_start, qty, CASE WHEN i <= n - ceil(n * 0.2) THEN 'train' ELSE 'test' END AS split FROM p"""
)
def time_split_by_null_key(spark, d):
    return split.time_split(some_weeks(spark, d), "week_start", 0.2, ["l_partkey"])


@query(
    f"""SELECT l_partkey, week_start, qty, CASE WHEN row_number() OVER (ORDER BY l_partkey NULLS FIRST, week_start) <= n - ceil(n * 0.2) THEN 'train' ELSE 'test' END AS split
FROM ({SOME_WEEKS}), (SELECT count(*) AS n FROM ({SOME_WEEKS}))"""
)
def time_split_global_null_key(spark, d):
    return split.time_split(some_weeks(spark, d), "week_start", 0.2, ["l_partkey"], mode="global")


def regular_types(spark, d):
    return series.regular_weekly(type_weeks(spark, d), "week_start", "qty", ["p_type"])


# Every week of a type, missing ones on the line between their neighbours.
FILLED = f"""SELECT p_type, week_start, i, qty IS NULL AS gap,
  coalesce(qty::double, before + (after - before) * (i - before_i) / (after_i - before_i)) AS y
FROM (SELECT *, last_value(qty IGNORE NULLS) OVER p AS before, last_value(CASE WHEN qty IS NOT NULL THEN i END IGNORE NULLS) OVER p AS before_i,
    first_value(qty IGNORE NULLS) OVER n AS after, first_value(CASE WHEN qty IS NOT NULL THEN i END IGNORE NULLS) OVER n AS after_i
  FROM (SELECT p_type, week_start, qty, row_number() OVER (PARTITION BY p_type ORDER BY week_start) AS i
    FROM (SELECT p_type, unnest(generate_series(min(week_start), max(week_start), INTERVAL 7 DAY))::date AS week_start
      FROM ({TYPE_WEEKS}) GROUP BY 1) LEFT JOIN ({TYPE_WEEKS}) USING (p_type, week_start))
  WINDOW p AS (PARTITION BY p_type ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    n AS (PARTITION BY p_type ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""

# Without coefficients the model only differences: a week moves like the same week one season before, or not at all for lag 1.
WALK = f"""WITH RECURSIVE y AS (SELECT p_type, lag, max(week_start) AS last, count_if(gap)::int AS gaps, list(y ORDER BY i) AS ys
  FROM ({FILLED}), unnest([1, 2, 3, 4, 13, 26, 52]) t(lag) GROUP BY 1, 2),
f AS (SELECT p_type, lag, last, gaps, 0 AS h, ys FROM y
  UNION ALL SELECT p_type, lag, last, gaps, h + 1,
    list_append(ys, ys[-1] + CASE WHEN lag > 1 THEN ys[-lag] - ys[-(lag + 1)] ELSE 0 END) FROM f WHERE h < 12)
SELECT p_type, lag::int AS lag, (last + (7 * h)::int)::date AS date, round(ys[-1], 4) + 0 AS forecast, gaps AS interpolated, 'ok' AS status
FROM f WHERE h > 0"""


@query(WALK)
def seasonal_walk_forecasts(spark, d):
    ahead = forecast.seasonal_forecast(regular_types(spark, d), ["p_type"], order=(0, 1, 0), seasonal=(0, 1, 0))
    return ahead.withColumn("forecast", F.round("forecast", 4))


@query(
    f"""WITH y AS (SELECT p_type, max(week_start) AS last, arg_max(y, i) AS top, arg_min(y, i) AS low, count(*) AS n,
  count_if(gap)::int AS gaps FROM ({FILLED}) GROUP BY 1)
SELECT p_type, 1::int AS lag, (last + (7 * h)::int)::date AS date, round(top + h * (top - low) / (n - 1), 4) + 0 AS forecast,
  gaps AS interpolated, 'ok' AS status FROM y, range(1, 13) t(h)"""
)
def drift_forecasts(spark, d):
    ahead = forecast.seasonal_forecast(regular_types(spark, d), ["p_type"], lags=[1], order=(0, 1, 0), trend="c")
    return ahead.withColumn("forecast", F.round("forecast", 4))


@query(points_sql(f"SELECT p_type, date AS week_start, forecast AS qty FROM ({WALK}) WHERE lag = 52", "p_type", False, 2))
def walk_forecast_points(spark, d):
    ahead = forecast.seasonal_forecast(regular_types(spark, d), ["p_type"], lags=[52], order=(0, 1, 0), seasonal=(0, 1, 0))
    ahead = ahead.withColumn("forecast", F.round("forecast", 4))
    return series.annotated_points(ahead, ["p_type"], "date", "forecast", keep=2)


@query(
    f"""SELECT p_type, year(min(week_start))::int AS start_year, year(max(week_start))::int AS end_year, 'trend1' AS name,
  round((arg_max(y, i) - arg_min(y, i)) / (count(*) - 1), 6) + 0 AS coefficient FROM ({FILLED}) GROUP BY 1"""
)
def stored_drift_models(spark, d):
    path = fresh_folder(spark, "drift")
    fitted = forecast.fit_models(regular_types(spark, d), ["p_type"], order=(0, 1, 0), seasonal=(0, 0, 0), trend="c")
    tables.save_models(fitted, path)
    stored = tables.load_models(spark, path).select("p_type", "start_year", "end_year", F.explode("params").alias("name", "coefficient"))
    return stored.withColumn("coefficient", F.round("coefficient", 6))


# The start of each fit in SQL: the differenced series, less a line where the model has a trend. No SQL gives the coefficients, so of the
# fits it states the start, and that no fit is worse.
def started(series, key, lags, trend=False):
    left = "regr_syy(w, i) - coalesce(regr_slope(w, i) * regr_sxy(w, i), 0)" if trend else "sum(w * w)"
    return f"""WITH y AS ({series}),
d AS (SELECT {key}, lag, i, y - lag(y) OVER s AS a, lag(y, lag) OVER s - lag(y, lag + 1) OVER s AS b,
    lag(y, lag + 1) OVER s IS NOT NULL AS whole FROM y, unnest({lags!r}) t(lag) WINDOW s AS (PARTITION BY {key}, lag ORDER BY i)),
w AS (SELECT {key}, lag, i, CASE WHEN lag = 1 THEN a WHEN whole THEN a - b END AS w FROM d),
e AS (SELECT {key}, lag, w, row_number() OVER (PARTITION BY {key}, lag ORDER BY i) AS i FROM w WHERE w IS NOT NULL),
c AS (SELECT {key}, lag, w, i, count(*) OVER (PARTITION BY {key}, lag) AS n, CASE WHEN lag = 1 THEN 1 ELSE 1 + lag END AS skip,
    CASE WHEN lag = 1 THEN 2 ELSE 4 END + {2 if trend else 0} AS free FROM e),
f AS (SELECT {key}, lag, {left} AS start_rss FROM c WHERE i > skip AND n - skip > free + 1 GROUP BY ALL),
t AS (SELECT {key}, max(week_start) AS last, count_if(gap)::int AS gaps FROM y GROUP BY 1)
SELECT {key}, lag::int AS lag, (last + (7 * h)::int)::date AS date, gaps AS interpolated, start_rss IS NOT NULL AS fitted,
  round(start_rss / 1000) + 0 AS start_rss, CASE WHEN start_rss IS NOT NULL THEN true END AS no_worse
FROM (SELECT t.*, lag, h FROM t, unnest({lags!r}) u(lag), range(1, 13) s(h)) LEFT JOIN f USING ({key}, lag)"""


def checked_fits(ahead, key):
    """What SQL can state of fitted forecasts."""
    fitted = F.col("status").isin("ok", "not_converged") & ~F.isnan("forecast")
    start = F.round(F.col("start_rss") / 1000)
    no_worse = F.col("rss") <= F.col("start_rss") * (1 + 1e-9)
    return ahead.select(key, "lag", "date", "interpolated", F.coalesce(fitted, F.lit(False)).alias("fitted"), start.alias("start_rss"), no_worse.alias("no_worse"))


LAGS = [1, 2, 3, 4, 13, 26, 52]


@query(started(FILLED, "p_type", LAGS))
def seasonal_forecasts(spark, d):
    return checked_fits(forecast.seasonal_forecast(regular_types(spark, d), ["p_type"], with_fit=True), "p_type")


@query(started(FILLED, "p_type", [52], trend=True))
def seasonal_forecasts_with_drift(spark, d):
    return checked_fits(forecast.seasonal_forecast(regular_types(spark, d), ["p_type"], lags=[52], trend="ct", with_fit=True), "p_type")


def vendor_weeks(spark, d):
    """Regular weekly series per vendor; the number of series grows with the tables."""
    return series.regular_weekly(sales(spark, d), "sales_date", "bottles", ["l_suppkey"])


VENDOR_WEEKS = """SELECT l_suppkey, date_trunc('week', l_shipdate)::date AS week_start, sum(l_quantity)::bigint AS qty FROM lineitem GROUP BY 1, 2"""
VENDOR_FILLED = FILLED.replace(TYPE_WEEKS, VENDOR_WEEKS).replace("p_type", "l_suppkey")


@query(started(VENDOR_FILLED, "l_suppkey", LAGS))
def vendor_forecasts(spark, d):
    return checked_fits(forecast.seasonal_forecast(vendor_weeks(spark, d), ["l_suppkey"], with_fit=True), "l_suppkey")


@query(f"SELECT p_type, lag::int AS lag, true AS on_forecast, true AS flags_extremes FROM (SELECT DISTINCT p_type FROM ({TYPE_WEEKS})), unnest([1, 13, 52]) t(lag)")
def forecast_points(spark, d):
    """Each point is a value of the forecast of its day, and those that equal the forecast's extreme of their kind are marked global."""
    ahead = forecast.seasonal_forecast(regular_types(spark, d), ["p_type"], lags=[1, 13, 52]).checkpoint()
    points = series.annotated_points(ahead, ["p_type", "lag"], "date", "forecast", keep=2)
    ends = ahead.groupBy("p_type", "lag").agg(F.min("forecast").alias("low"), F.max("forecast").alias("high"))
    days = ahead.select("p_type", "lag", F.col("date").alias("day"), F.col("forecast").alias("there"))
    point = points.select("p_type", "lag", F.to_date("timestamp").alias("day"), "value", "type", "is_global")
    matched = point.join(days, ["p_type", "lag", "day"], "left").join(ends, ["p_type", "lag"])
    same = F.coalesce(F.col("value") == F.col("there"), F.lit(False))
    extreme = F.col("value") == F.when(F.col("type") == "min", F.col("low")).otherwise(F.col("high"))
    return matched.groupBy("p_type", "lag").agg(F.bool_and(same).alias("on_forecast"), F.bool_and(F.col("is_global") == extreme).alias("flags_extremes"))


@query(
    f"""SELECT p_type, year(min(week_start))::int AS start_year, year(max(week_start))::int AS end_year,
  'ar1,ma1,seasonal_ar1,seasonal_ma1' AS names, true AS within_bounds FROM ({FILLED}) GROUP BY 1 HAVING count(*) - 106 > 5"""
)
def stored_forecast_models(spark, d):
    path = fresh_folder(spark, "fitted")
    weeks = series.regular_weekly(type_weeks(spark, d), "week_start", "qty", ["p_type"], fill=0)
    tables.save_models(forecast.fit_models(weeks, ["p_type"], lag=52), path)
    stored = tables.load_models(spark, path).filter("params IS NOT NULL AND length(model_blob) > 0")
    within = F.forall(F.map_values("params"), lambda c: F.abs(c) <= 1)
    return stored.select("p_type", "start_year", "end_year", F.array_join(F.array_sort(F.map_keys("params")), ",").alias("names"), within.alias("within_bounds"))


@query(
    f"""WITH v AS (SELECT l_suppkey, week_start, qty FROM ({VENDOR_WEEKS})),
p AS (SELECT l_suppkey, lag, round(r, 6) + 0 AS r FROM ({acf_sql(VENDOR_WEEKS, 'l_suppkey')}) WHERE lag > 0
  QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY round(abs(r), 9) DESC, lag) = 1),
n AS (SELECT l_suppkey, count(*) AS n, floor(count(*) * 0.8)::bigint AS cut FROM v GROUP BY 1),
u AS (SELECT n.*, CASE WHEN lag > 1 AND lag < cut THEN lag ELSE 0 END AS period FROM n LEFT JOIN p USING (l_suppkey))
SELECT l_suppkey, n - cut AS test_rows, cut >= greatest(2, 2 * period) AS predicted FROM u"""
)
def holdout_error(spark, d):
    """Test rows per vendor, and whether all of them have a forecast."""
    points = stats.with_periodicity(vendor_weeks(spark, d), ["l_suppkey"], "week_start", "sales").checkpoint()
    held = forecast.holdout_predictions(points, ["l_suppkey"], "week_start", "sales")
    by = held.withColumn("predicted", F.nanvl("predicted", F.lit(None))).groupBy("l_suppkey")
    return by.agg(
        F.count(F.lit(1)).alias("test_rows"),
        (F.count("predicted") == F.count(F.lit(1))).alias("predicted"),
    )


@query(
    f"""WITH RECURSIVE y AS (SELECT l_suppkey, list(qty::double ORDER BY week_start) AS ys, count(*) AS n, floor(count(*) * 0.8)::bigint AS cut
  FROM ({VENDOR_WEEKS}) GROUP BY 1),
s AS (SELECT l_suppkey, 0::bigint AS t, ys[1] - (ys[2] - ys[1]) AS level, ys[2] - ys[1] AS trend FROM y WHERE cut >= 2
  UNION ALL SELECT l_suppkey, t + 1, 0.5 * ys[t + 1] + 0.5 * (level + trend),
    0.1 * (0.5 * ys[t + 1] + 0.5 * (level + trend) - level) + 0.9 * trend FROM s JOIN y USING (l_suppkey) WHERE t < cut)
SELECT l_suppkey, h::int AS step, ys[cut + h] AS actual, round(level + h * trend, 4) + 0 AS predicted
FROM s JOIN y USING (l_suppkey), unnest(range(1, n - cut + 1)) u(h) WHERE t = cut"""
)
def holdout_with_fixed_weights(spark, d):
    weeks = aggregate.weekly_series(sales(spark, d), "sales_date", "bottles", ["l_suppkey"], "qty")
    held = forecast.holdout_predictions(weeks, ["l_suppkey"], "week_start", "qty", weights=(0.5, 0.1, 0.0)).filter(~F.isnan("predicted"))
    step = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("week_start")).alias("step")
    return held.select("l_suppkey", step, "actual", F.round("predicted", 4).alias("predicted"))


@query(
    f"""SELECT p_type, 7::bigint AS metrics, true AS periods_valid, true AS ranks_from_one, true AS errors_valid
FROM ({TYPE_WEEKS}) GROUP BY 1"""
)
def metric_analysis(spark, d):
    """All metrics of every type, with periods of 1 to 52 weeks, ranks from 1 on and errors that are not negative."""
    mart = weekly_sales(type_weeks(spark, d), "week_start", "qty", ["p_type"])
    found = forecast.analyze_metrics(series.dated_mart(mart), keys=["p_type"])
    return found.groupBy("p_type").agg(
        F.count_distinct("metric").alias("metrics"),
        F.bool_and(F.col("period_weeks").between(1, 52) & (F.abs("periodicity_strength") <= 1)).alias("periods_valid"),
        ((F.min("periodicity_rank") == 1) & (F.min("predictability_rank") == 1) & (F.max("overall_rank") <= 14)).alias("ranks_from_one"),
        F.bool_and(F.coalesce(F.col("mape") >= 0, F.lit(True))).alias("errors_valid"),
    )


def vendor_features(spark, d):
    weeks = aggregate.weekly_series(sales(spark, d), "sales_date", "bottles", ["l_suppkey"], "qty")
    return regression.weekly_features(weeks, ["l_suppkey"], "week_start", "qty")


FEATURE_ROWS = f"""SELECT l_suppkey, week_start FROM ({VENDOR_WEEKS}) QUALIFY lag(qty, 8) OVER (PARTITION BY l_suppkey ORDER BY week_start) IS NOT NULL"""


@query(
    f"""SELECT ceil(count(*) * 0.2)::bigint AS test_rows, 1::bigint AS widths, true AS centred, true AS covers, true AS bounded_error FROM ({FEATURE_ROWS})"""
)
def boosted_tree_intervals(spark, d):
    """Size of the test part, one width of all intervals around the prediction, coverage of about nine in ten, and a squared error of less
    than one and a half times the variance (the quantities are random, so that there is little to learn)."""
    wide, features = vendor_features(spark, d)
    _, tested, _ = regression.regress_with_intervals(wide, features, "qty", ["l_suppkey", "week_start"])
    actual, predicted = F.col("actual"), F.col("predicted")
    inside = actual.between(F.col("lower"), F.col("upper")).cast("double")
    return tested.agg(
        F.count(F.lit(1)).alias("test_rows"),
        F.count_distinct(F.round(F.col("upper") - F.col("lower"), 3)).alias("widths"),
        F.bool_and(F.abs(F.col("upper") + F.col("lower") - 2 * predicted) < 1e-6 * (1 + F.abs(predicted))).alias("centred"),
        F.avg(inside).between(0.8, 1.0).alias("covers"),
        (F.avg((actual - predicted) ** 2) < 1.5 * F.var_pop(actual)).alias("bounded_error"),
    )


@query(
    """SELECT feature, true AS share, true AS sums_to_one
FROM unnest(['weekofyear', 'month', 'dayofweek', 'year', 'qty_lag_1', 'qty_lag_2', 'qty_lag_4', 'qty_lag_8']) t(feature)"""
)
def boosted_tree_importances(spark, d):
    wide, features = vendor_features(spark, d)
    found = regression.feature_importances(spark, regression.fit_gbt(wide, features, "qty", max_depth=5), features)
    whole = F.abs(F.sum("importance").over(Window.partitionBy()) - 1) < 1e-9
    return found.select("feature", F.col("importance").between(0, 1).alias("share"), whole.alias("sums_to_one"))
