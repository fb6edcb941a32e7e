from datetime import date, timedelta

from pyspark.sql import functions as F

from stockloom.functions import dates
from stockloom.operators import aggregate, series
from stockloom.plans.mart import weekly_sales


def day(text):
    return date.fromisoformat(text)


def test_iso_functions_over_every_day_of_many_years(spark):
    span = spark.sql("SELECT explode(sequence(date'1999-12-01', date'2021-02-01')) AS d")
    d = F.col("d")
    rows = span.select(
        "d", dates.iso_year(d).alias("y"), dates.iso_week(d).alias("w"), dates.week_index(d).alias("i"),
        dates.week_start(dates.iso_year(d), dates.iso_week(d)).alias("m"), dates.iso_weeks_in_year(F.year(d)).alias("n"),
    ).collect()
    for r in rows:
        year, week, weekday = r.d.isocalendar()
        assert (r.y, r.w) == (year, week)
        assert r.m == r.d - timedelta(days=weekday - 1)
        assert r.i == (r.m - day("1970-01-05")).days // 7
        assert r.n == date(r.d.year, 12, 28).isocalendar()[1]


def test_mart_gap_new_year_and_week_53(frame):
    sold = frame(
        [
            (day("2020-12-28"), 5),  # 2020 week 53
            (day("2021-01-04"), 7),  # 2021 week 1
            (day("2021-01-25"), 9),  # 2021 week 4; weeks 2 and 3 are missing
            (day("2020-01-02"), 4),  # 2020 week 1
            (None, 3),
        ],
        "d date, q int",
    )
    rows = {(r.sales_year, r.sales_week): r for r in weekly_sales(sold, "d", "q").collect()}
    first = rows[2021, 1]
    assert (first.last_week_year, first.last_week_week, first.last_week_quantity, first.last_week_diff) == (2020, 53, 5, 2)
    assert (first.last_year_year, first.last_year_week, first.last_year_quantity) == (2020, 1, 4)
    fourth = rows[2021, 4]
    assert fourth.last_week_quantity is None and fourth.last_2_week_quantity is None
    assert (fourth.last_3_week_week, fourth.last_3_week_quantity, fourth.last_4_week_quantity) == (1, 7, 5)
    leap = rows[2020, 53]
    assert (leap.last_year_year, leap.last_year_week, leap.last_year_quantity) == (2019, 53, None)
    undated = rows[None, None]
    assert undated.current_sales_quantity == 3 and undated.last_week_quantity is None and undated.last_week_year is None


def test_mart_keeps_keys_apart_and_takes_no_rows(frame):
    sold = frame([("a", day("2021-01-04"), 1), ("b", day("2021-01-11"), 2)], "k string, d date, q int")
    rows = weekly_sales(sold, "d", "q", ["k"]).collect()
    assert {r.k: r.last_week_quantity for r in rows} == {"a": None, "b": None}
    assert weekly_sales(sold.filter("q > 5"), "d", "q").count() == 0


def test_mart_windows_see_only_weekly_rows(spark, frame):
    sold = frame([(day("2021-01-04"), 1)], "d date, q int")
    plan = weekly_sales(sold, "d", "q")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("Aggregate")


def test_latest_week_is_by_year_then_week(frame):
    weekly = frame([(2024, 52, 9), (2025, 5, 4), (2025, 6, 0), (2024, 9, None), (None, None, 8)], "sales_year int, sales_week int, q int")
    left = series.drop_latest_week(weekly, quantity="q").collect()
    assert [(r.sales_year, r.sales_week) for r in left] == [(2024, 52)]


def test_regular_weeks(frame):
    sold = frame(
        [("a", day("2021-01-04"), 1), ("a", day("2021-01-10"), 2), ("a", day("2021-01-25"), 5), ("b", day("2021-01-05"), 3), ("b", None, 7)],
        "k string, d date, q int",
    )
    rows = sorted(tuple(r) for r in series.regular_weekly(sold, "d", "q", ["k"]).collect())
    monday = day("2021-01-04")
    assert rows == [
        ("a", monday, 3), ("a", monday + timedelta(7), None), ("a", monday + timedelta(14), None), ("a", monday + timedelta(21), 5),
        ("b", monday, 3),
    ]
    filled = series.regular_weekly(sold, "d", "q", ["k"], fill=0)
    assert filled.filter("sales = 0").count() == 2
    ahead = series.future_weeks(series.regular_weekly(sold, "d", "q", ["k"]), ["k"], horizon=2).collect()
    assert sorted(tuple(r) for r in ahead)[0] == ("a", day("2021-02-01"))


def test_filter_years_is_pushed_to_the_scan(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    df = dates.filter_years(orders, "o_orderdate", 1996, None)
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == orders.filter(F.year("o_orderdate") >= 1996).count()


def test_metrics_by_rejects_unknown_aggregate(frame):
    try:
        aggregate.metrics_by(frame([(1,)], "a int"), ["a"], [], "median")
    except ValueError:
        return
    raise AssertionError
