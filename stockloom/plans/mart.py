"""The weekly sales mart: each ISO week next to seven earlier calendar weeks."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from stockloom.functions.dates import iso_week, iso_year, week_index
from stockloom.operators.aggregate import weekly_series

# Lag in weeks and the column prefix it fills. 52 stands for the same week number one year before.
LAG_PREFIXES = {
    1: "last_week",
    2: "last_2_week",
    3: "last_3_week",
    4: "last_4_week",
    13: "last_13_week",
    26: "last_26_week",
    52: "last_year",
}


def weekly_sales(df, date_col, qty_col, keys=()):
    """Weekly totals with year, week, quantity and difference for each lag; 31 columns after the keys.

    A lag looks up the calendar week, not the previous row: a week without sales gives NULL. Instead of one self
    join per lag the totals are read through RANGE windows, which share the partitioning of the keys. The windows see
    weekly totals only, so a partition holds at most one row per calendar week whatever the size of the input.
    """
    keys = list(keys)
    week = weekly_series(df, date_col, qty_col, keys, "current_sales_quantity")
    start = F.col("week_start")
    week = week.withColumns(
        {"sales_year": iso_year(start), "sales_week": iso_week(start), "_idx": week_index(start)}
    ).withColumn("_yw", F.col("sales_year") * 100 + F.col("sales_week"))

    by_index = Window.partitionBy(*keys).orderBy("_idx")
    by_year_week = Window.partitionBy(*keys).orderBy("_yw")
    quantity = F.col("current_sales_quantity")
    found = {}
    for lag in LAG_PREFIXES:
        window = by_year_week.rangeBetween(-100, -100) if lag == 52 else by_index.rangeBetween(-lag, -lag)
        # NULL order keys are peers of each other, so the undated group would find itself.
        found[f"_q{lag}"] = F.when(start.isNotNull(), F.first(quantity).over(window))
    week = week.withColumns(found)

    columns = [*keys, "sales_year", "sales_week", "current_sales_quantity"]
    for lag, prefix in LAG_PREFIXES.items():
        earlier = F.col(f"_q{lag}")
        target = F.date_sub(start, 7 * lag)
        year, number = (iso_year(target), iso_week(target)) if lag != 52 else (F.col("sales_year") - 1, F.col("sales_week"))
        columns += [
            year.alias(f"{prefix}_year"),
            number.alias(f"{prefix}_week"),
            earlier.alias(f"{prefix}_quantity"),
            (quantity - earlier).alias(f"{prefix}_diff"),
        ]
    return week.select(*columns)
