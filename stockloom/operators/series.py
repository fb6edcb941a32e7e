"""Regular weekly series and their window features.

Series operators expect one row per (keys, period), as the aggregates deliver it: a window partition then holds at most
one row per calendar period, however many raw rows a key has.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from stockloom.functions.dates import week_start
from stockloom.functions.records import null_nan, usable
from stockloom.operators.aggregate import weekly_series


def drop_latest_week(weekly, keys=(), quantity="current_sales_quantity", year="sales_year", week="sales_week"):
    """Usable weeks before the latest usable one, which may be incomplete."""
    order = F.col(year) * 100 + F.col(week)
    latest = F.max("_yw").over(Window.partitionBy(*keys))
    marked = usable(weekly, quantity).withColumn("_yw", order).withColumn("_latest", latest)
    return marked.filter(F.col("_yw") < F.col("_latest")).drop("_yw", "_latest")


def regular_weekly(df, date_col, value_col, keys=(), fill=None, out="sales"):
    """One row per Monday and key between the first and last week; weeks of equal date are summed, gaps are `fill`.

    Each week is expanded up to the next one that exists, so no calendar table and no join are needed.
    """
    weekly = weekly_series(df.filter(F.col(date_col).isNotNull()), date_col, value_col, keys, out)
    following = F.lead("week_start").over(Window.partitionBy(*keys).orderBy("week_start"))
    until = F.coalesce(F.date_sub(following, 7), F.col("week_start"))
    spread = weekly.withColumn("_weeks", F.sequence("week_start", until, F.expr("interval 7 days"))).select(
        *keys, out, F.posexplode("_weeks").alias("_gap", "week_start")
    )
    value = F.when(F.col("_gap") == 0, F.col(out))
    if fill is not None:
        value = F.coalesce(value, F.lit(fill))
    return spread.select(*keys, "week_start", value.alias(out))


def dated_mart(mart, year="sales_year", week="sales_week", out="date"):
    """Mart rows with the Monday of their ISO week; rows without year or week are dropped."""
    dated = mart.dropna(subset=[year, week])
    return dated.withColumn(out, week_start(F.col(year), F.col(week)))


def future_weeks(series, keys=(), date="week_start", horizon=12):
    """The `horizon` Mondays after the last one of each key."""
    last = series.groupBy(*keys).agg(F.max(date).alias("_last"))
    steps = F.sequence(F.date_add("_last", 7), F.date_add("_last", 7 * horizon), F.expr("interval 7 days"))
    return last.select(*keys, F.explode(steps).alias(date))


def lag_features(df, keys, order, value, lags=(1, 2, 4, 8)):
    window = Window.partitionBy(*keys).orderBy(order)
    return df.withColumns({f"{value}_lag_{k}": F.lag(value, k).over(window) for k in lags})


def diff(df, keys, order, value, out="diff"):
    window = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn(out, F.col(value) - F.lag(value).over(window))


def tail(df, keys, order, n=52):
    """Last n rows of each key."""
    window = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("_rn", F.row_number().over(window)).filter(F.col("_rn") <= n).drop("_rn")


def _present(df, value):
    return df.withColumn(value, null_nan(F.col(value))).filter(F.col(value).isNotNull())


def critical_points(df, keys, order, value):
    """Rows where the sign of the step differs from the sign of the step before; the missing first step counts as 0."""
    window = Window.partitionBy(*keys).orderBy(order)
    step = F.coalesce(F.signum(F.col(value) - F.lag(value).over(window)), F.lit(0.0))
    signed = _present(df, value).withColumn("_sign", step)
    turned = signed.withColumn("_before", F.lag("_sign").over(window))
    return turned.filter(F.col("_sign") != F.col("_before")).drop("_sign", "_before")


def annotated_points(df, keys, order, value, keep=2, mode="run"):
    """The `keep` lowest minima and highest maxima of each key, with a label and a flag for the series extreme.

    `run` marks every inner point by the direction of the step that leaves it (down: max, up: min, flat: as before);
    `turn` marks only points where the direction really changes. The first and the last point are never marked.
    """
    if mode not in ("run", "turn"):
        raise ValueError("mode must be run or turn")
    keys = list(keys)
    window = Window.partitionBy(*keys).orderBy(order)
    whole = Window.partitionBy(*keys)
    step = F.signum(F.col(value) - F.lag(value).over(window))
    heading = F.last(F.when(F.col("_step") != 0, F.col("_step")), ignorenulls=True)
    points = (
        _present(df, value)
        .withColumns({"_step": step, "_rn": F.row_number().over(window)})
        .withColumn("_heading", heading.over(window.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumns(
            {
                "_leaving": F.lead("_heading").over(window),
                "_low": F.min(value).over(whole),
                "_high": F.max(value).over(whole),
            }
        )
        .filter((F.col("_rn") > 1) & F.col("_leaving").isNotNull())
    )
    if mode == "turn":
        points = points.filter(F.col("_leaving") != F.col("_heading"))
    kind = F.when(F.col("_leaving") < 0, "max").otherwise("min")
    points = points.withColumn("type", kind)
    is_min = F.col("type") == "min"
    strength = F.when(is_min, F.col(value)).otherwise(-F.col(value))
    ranked = Window.partitionBy(*keys, "type").orderBy(strength, order)
    extreme = F.when(is_min, F.col("_low")).otherwise(F.col("_high"))
    return (
        points.withColumn("_rank", F.row_number().over(ranked))
        .filter(F.col("_rank") <= keep)
        .select(
            *keys,
            F.col(order).alias("timestamp"),
            F.col(value).alias("value"),
            F.concat(F.date_format(order, "MMM dd"), F.lit(" ("), F.col("type"), F.lit(")")).alias("label"),
            "type",
            (F.col(value) == extreme).alias("is_global"),
        )
    )


def rank_metrics(df, keys=(), strength="periodicity_strength", error="mape"):
    """Dense ranks by strength (high first) and error (low first) among the metrics of a key, and their sum."""

    def dense(order, column):
        return F.when(F.col(column).isNotNull(), F.dense_rank().over(Window.partitionBy(*keys).orderBy(order)))

    clean = df.withColumns({strength: null_nan(F.col(strength)), error: null_nan(F.col(error))})
    return clean.withColumns(
        {
            "periodicity_rank": dense(F.col(strength).desc_nulls_last(), strength),
            "predictability_rank": dense(F.col(error).asc_nulls_last(), error),
        }
    ).withColumn("overall_rank", F.col("periodicity_rank") + F.col("predictability_rank"))
