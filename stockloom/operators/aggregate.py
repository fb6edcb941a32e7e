"""Totals by day, week, item, class and free dimensions."""

from pyspark.sql import functions as F

from stockloom.functions.dates import iso_week, iso_year, monday


def daily_sales(df, date_col, value_col, keys=(), out="daily_sales"):
    return df.groupBy(*keys, F.to_date(date_col).alias("sales_date")).agg(F.sum(value_col).alias(out))


def weekly_series(df, date_col, value_col, keys=(), out="sales"):
    """Total per Monday; rows without a date are one group."""
    return df.groupBy(*keys, monday(F.col(date_col)).alias("week_start")).agg(F.sum(value_col).alias(out))


def iso_weekly_sales(df, date_col, value_col, keys=(), out="sales_quantity"):
    """Total per ISO (year, week). One aggregate on the Monday; year and week are derived from it."""
    weekly = weekly_series(df, date_col, value_col, keys, out)
    start = F.col("week_start")
    return weekly.select(*keys, iso_year(start).alias("sales_year"), iso_week(start).alias("sales_week"), out)


def metrics_by(df, metrics, dimensions, agg="sum"):
    """Each metric aggregated by the dimensions; `agg` is one of sum, avg, min, max, count."""
    allowed = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}
    if agg not in allowed:
        raise ValueError(f"agg must be one of {sorted(allowed)}")
    return df.groupBy(*dimensions).agg(*[allowed[agg](m).alias(m) for m in metrics])


def collapse_items(df, key, mins, label):
    """One row per item: least value of each column in `mins`, greatest label that is present."""
    return df.groupBy(key).agg(*[F.min(c).alias(c) for c in mins], F.max(label).alias(label))


def detection_summary(df, arrival, cls="class", timestamp="timestamp", source="source"):
    """Per class: number of detections, and time and source of the one that arrived last."""
    latest = F.max_by(F.struct(timestamp, source), arrival)
    return (
        df.groupBy(cls)
        .agg(F.count(F.lit(1)).alias("count"), latest.alias("latest"))
        .select(cls, F.col(f"latest.{timestamp}").alias("last_seen"), "count", F.col(f"latest.{source}").alias(source))
    )
