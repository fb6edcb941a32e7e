"""Totals, calendar functions, the mart and weekly series."""

from pyspark.sql import functions as F

from checks.base import PART_WEEKS, TYPE_WEEKS, part_weeks, query, sales, table, type_weeks
from stockloom.functions import dates
from stockloom.operators import aggregate, series
from stockloom.operators.joins import flag_holiday_weeks
from stockloom.plans.mart import LAG_PREFIXES, weekly_sales


def mart_sql(weekly, keys=()):
    """The mart by one self join per lag on the earlier (year, week)."""
    lead = "".join(f"w.{k}, " for k in keys)
    same = "".join(f" AND {{p}}.{k} = w.{k}" for k in keys)
    columns, joins = [], []
    for lag, prefix in LAG_PREFIXES.items():
        p = f"p{lag}"
        if lag == 52:
            year, week = "w.y - 1", "w.wk"
        else:
            year = f"CASE WHEN w.wk > {lag} THEN w.y ELSE w.y - 1 END"
            before = "extract(week FROM make_date(w.y - 1, 12, 28))"
            week = f"CASE WHEN w.wk > {lag} THEN w.wk - {lag} ELSE {before} - ({lag} - w.wk) END"
        joins.append(f"LEFT JOIN weekly {p} ON {p}.y = {year} AND {p}.wk = {week}" + same.format(p=p))
        columns.append(
            f"({year})::int AS {prefix}_year, ({week})::int AS {prefix}_week, {p}.q AS {prefix}_quantity, "
            f"w.q - {p}.q AS {prefix}_diff"
        )
    return f"""WITH weekly AS ({weekly})
SELECT {lead}w.y::int AS sales_year, w.wk::int AS sales_week, w.q AS current_sales_quantity,
  {", ".join(columns)}
FROM weekly w {" ".join(joins)}"""


WEEKLY = """SELECT {keys}extract(isoyear FROM l_shipdate) AS y, extract(week FROM l_shipdate) AS wk,
  sum(l_quantity)::bigint AS q FROM lineitem GROUP BY ALL"""


@query(mart_sql(WEEKLY.format(keys="")))
def weekly_sales_mart(spark, d):
    return weekly_sales(sales(spark, d), "sales_date", "bottles")


@query(mart_sql(WEEKLY.format(keys="l_suppkey, "), ["l_suppkey"]))
def weekly_sales_mart_by_vendor(spark, d):
    return weekly_sales(sales(spark, d), "sales_date", "bottles", ["l_suppkey"])


@query(
    """SELECT l_shipdate::date AS sales_date, sum(l_quantity)::bigint AS daily_bottles FROM lineitem GROUP BY 1"""
)
def daily_sales(spark, d):
    return aggregate.daily_sales(sales(spark, d), "sales_date", "bottles", out="daily_bottles")


@query(
    """SELECT l_returnflag, extract(isoyear FROM l_shipdate)::int AS sales_year, extract(week FROM l_shipdate)::int AS sales_week,
  sum(l_quantity)::bigint AS sales_quantity FROM lineitem GROUP BY ALL"""
)
def iso_weekly_sales(spark, d):
    return aggregate.iso_weekly_sales(sales(spark, d), "sales_date", "bottles", ["l_returnflag"])


@query(
    """SELECT o_orderpriority, date_trunc('week', o_orderdate)::date AS week_start,
  sum(o_totalprice::decimal(18,2))::double AS sales FROM orders GROUP BY 1, 2"""
)
def week_start_totals(spark, d):
    orders = table(spark, d, "orders").withColumn("price", F.col("o_totalprice").cast("decimal(18,2)"))
    weekly = aggregate.weekly_series(orders, "o_orderdate", "price", ["o_orderpriority"])
    return weekly.withColumn("sales", F.col("sales").cast("double"))


@query(
    """SELECT l_returnflag, l_linestatus, sum(l_quantity::bigint)::bigint AS l_quantity,
  sum(l_extendedprice::decimal(18,2))::double AS l_extendedprice FROM lineitem GROUP BY 1, 2"""
)
def metrics_by_dimensions(spark, d):
    line = table(spark, d, "lineitem").withColumns(
        {"l_quantity": F.col("l_quantity").cast("long"), "l_extendedprice": F.col("l_extendedprice").cast("decimal(18,2)")}
    )
    out = aggregate.metrics_by(line, ["l_quantity", "l_extendedprice"], ["l_returnflag", "l_linestatus"])
    return out.withColumn("l_extendedprice", F.col("l_extendedprice").cast("double"))


@query(
    """SELECT y AS sales_year, extract(week FROM make_date(y, 12, 28))::int AS weeks, n
FROM (SELECT extract(year FROM o_orderdate)::int AS y, count(*) AS n FROM orders GROUP BY 1)"""
)
def weeks_in_year(spark, d):
    years = table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("sales_year")).agg(F.count(F.lit(1)).alias("n"))
    return years.withColumn("weeks", dates.iso_weeks_in_year(F.col("sales_year")))


@query(
    """SELECT extract(isoyear FROM l_shipdate)::int AS sales_year, extract(week FROM l_shipdate)::int AS sales_week,
  date_trunc('week', l_shipdate)::date AS week_start,
  strftime(l_shipdate, '%G%V') AS year_week, count(*) AS n FROM lineitem GROUP BY ALL"""
)
def week_dates(spark, d):
    weeks = aggregate.iso_weekly_sales(sales(spark, d).withColumn("one", F.lit(1)), "sales_date", "one", out="n")
    year, week = F.col("sales_year"), F.col("sales_week")
    return weeks.withColumns({"week_start": dates.week_start(year, week), "year_week": dates.year_week_label(year, week)})


@query(
    """SELECT extract(week FROM l_shipdate)::int AS weekofyear, extract(month FROM l_shipdate)::int AS month,
  (extract(isodow FROM l_shipdate) - 1)::int AS dayofweek, extract(year FROM l_shipdate)::int AS year,
  strftime(l_shipdate, '%Y%m%d')::int AS date_int, count(*) AS n FROM lineitem GROUP BY ALL"""
)
def calendar_features(spark, d):
    wide = dates.time_features(sales(spark, d), "sales_date").withColumn("date_int", dates.date_int(F.col("sales_date")))
    return wide.groupBy("weekofyear", "month", "dayofweek", "year", "date_int").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT o_orderkey, o_custkey, o_orderdate::date AS order_date FROM orders
WHERE extract(year FROM o_orderdate) BETWEEN 1996 AND 1998"""
)
def orders_of_years(spark, d):
    orders = table(spark, d, "orders")
    # The filter goes to the stored column, so that the scan is pruned.
    kept = dates.filter_years(orders, "o_orderdate", 1996, 1998)
    return kept.select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("order_date"))


@query(
    """WITH w AS (SELECT l_suppkey, extract(isoyear FROM l_shipdate)::int AS sales_year, extract(week FROM l_shipdate)::int AS sales_week,
  sum(l_quantity)::bigint AS sales_quantity FROM lineitem GROUP BY ALL),
m AS (SELECT l_suppkey, max(sales_year * 100 + sales_week) AS latest FROM w WHERE sales_quantity > 0 GROUP BY 1)
SELECT w.* FROM w JOIN m USING (l_suppkey) WHERE sales_quantity > 0 AND sales_year * 100 + sales_week < latest"""
)
def weeks_before_latest(spark, d):
    weekly = aggregate.iso_weekly_sales(sales(spark, d), "sales_date", "bottles", ["l_suppkey"])
    return series.drop_latest_week(weekly, ["l_suppkey"], "sales_quantity")


REGULAR = f"""SELECT l_partkey, g.week_start::date AS week_start, qty AS sales
FROM (SELECT l_partkey, unnest(generate_series(min(week_start), max(week_start), INTERVAL 7 DAY))::date AS week_start
  FROM ({PART_WEEKS}) GROUP BY 1) g LEFT JOIN ({PART_WEEKS}) USING (l_partkey, week_start)"""


@query(REGULAR)
def regular_weeks(spark, d):
    return series.regular_weekly(sales(spark, d), "sales_date", "bottles", ["l_partkey"])


@query(f"SELECT l_partkey, week_start, coalesce(sales, 0)::bigint AS sales FROM ({REGULAR})")
def regular_weeks_zero_filled(spark, d):
    return series.regular_weekly(sales(spark, d), "sales_date", "bottles", ["l_partkey"], fill=0)


@query(
    """WITH w AS (SELECT l_suppkey, date_trunc('week', l_shipdate)::date AS week_start, sum(l_quantity)::bigint AS q
  FROM lineitem GROUP BY 1, 2),
u AS (SELECT * FROM w WHERE q > 0 AND week_start < (SELECT max(week_start) FROM w m WHERE m.l_suppkey = w.l_suppkey AND m.q > 0)),
g AS (SELECT l_suppkey, unnest(generate_series(min(week_start), max(week_start), INTERVAL 7 DAY))::date AS week_start FROM u GROUP BY 1)
SELECT l_suppkey, week_start, q AS sales FROM g LEFT JOIN u USING (l_suppkey, week_start)"""
)
def forecast_input(spark, d):
    mart = weekly_sales(sales(spark, d), "sales_date", "bottles", ["l_suppkey"])
    usable = series.drop_latest_week(mart, ["l_suppkey"])
    return series.regular_weekly(series.dated_mart(usable), "date", "current_sales_quantity", ["l_suppkey"])


@query(
    f"""SELECT l_partkey, unnest(generate_series(max(week_start) + 7, max(week_start) + 84, INTERVAL 7 DAY))::date AS week_start
FROM ({PART_WEEKS}) GROUP BY 1"""
)
def weeks_ahead(spark, d):
    return series.future_weeks(part_weeks(spark, d), ["l_partkey"])


@query(
    f"""SELECT *, lag(qty, 1) OVER w AS qty_lag_1, lag(qty, 2) OVER w AS qty_lag_2, lag(qty, 4) OVER w AS qty_lag_4,
  lag(qty, 8) OVER w AS qty_lag_8 FROM ({PART_WEEKS}) WINDOW w AS (PARTITION BY l_partkey ORDER BY week_start)"""
)
def row_lags(spark, d):
    return series.lag_features(part_weeks(spark, d), ["l_partkey"], "week_start", "qty")


@query(f"SELECT *, qty - lag(qty) OVER (PARTITION BY l_partkey ORDER BY week_start) AS step FROM ({PART_WEEKS})")
def first_differences(spark, d):
    return series.diff(part_weeks(spark, d), ["l_partkey"], "week_start", "qty", "step")


@query(
    f"""WITH s AS (SELECT *, coalesce(sign(qty - lag(qty) OVER w), 0) AS sg FROM ({PART_WEEKS})
  WINDOW w AS (PARTITION BY l_partkey ORDER BY week_start)),
t AS (SELECT *, lag(sg) OVER (PARTITION BY l_partkey ORDER BY week_start) AS before FROM s)
SELECT l_partkey, week_start, qty::double AS qty FROM t WHERE sg <> before"""
)
def slope_changes(spark, d):
    return series.critical_points(part_weeks(spark, d), ["l_partkey"], "week_start", "qty")


def points_sql(weeks, key, turn, keep):
    """Walk the series step by step: each step that is not flat sets the kind, and names the point it leaves."""
    changed = "AND kind <> before" if turn else ""
    return f"""WITH s AS (SELECT {key}, week_start, qty::double AS qty,
    row_number() OVER w AS rn, sign(qty - lag(qty) OVER w) AS sg FROM ({weeks})
  WINDOW w AS (PARTITION BY {key} ORDER BY week_start)),
k AS (SELECT *, last_value(CASE sg WHEN 1 THEN 'min' WHEN -1 THEN 'max' END IGNORE NULLS)
    OVER (PARTITION BY {key} ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS here FROM s),
p AS (SELECT a.{key}, a.week_start, a.qty, b.here AS kind, a.here AS before FROM k a JOIN k b ON b.{key} = a.{key} AND b.rn = a.rn + 1
  WHERE a.rn > 1 AND b.here IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY {key}, kind
    ORDER BY CASE kind WHEN 'min' THEN qty ELSE -qty END, week_start) AS place FROM p WHERE true {changed}),
e AS (SELECT {key}, min(qty) AS low, max(qty) AS high FROM s GROUP BY 1)
SELECT r.{key}, week_start AS timestamp, qty AS value, strftime(week_start, '%b %d') || ' (' || kind || ')' AS label, kind AS type,
  qty = CASE kind WHEN 'min' THEN low ELSE high END AS is_global
FROM r JOIN e USING ({key}) WHERE place <= {keep}"""


@query(points_sql(PART_WEEKS, "l_partkey", False, 2))
def marked_points(spark, d):
    return series.annotated_points(part_weeks(spark, d), ["l_partkey"], "week_start", "qty")


@query(points_sql(TYPE_WEEKS, "p_type", True, 4))
def marked_turns(spark, d):
    return series.annotated_points(type_weeks(spark, d), ["p_type"], "week_start", "qty", keep=4, mode="turn")


@query(
    f"""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY week_start DESC) AS rn FROM ({TYPE_WEEKS}))
WHERE rn <= 52"""
)
def last_52_weeks(spark, d):
    return series.tail(type_weeks(spark, d), ["p_type"], "week_start", 52)


@query(
    f"""WITH h AS (SELECT name, dt::date AS dt FROM
  (SELECT unnest(range(1995, 2003)) AS y), (VALUES ('Founders', 7, 4), ('Year end', 12, 31), ('New Year', 1, 1)) v(name, m, dd),
  LATERAL (SELECT make_date(y, m, dd) AS dt))
SELECT t.p_type, t.week_start, t.qty, string_agg(DISTINCT name, ',' ORDER BY name) AS holidays, count(name) > 0 AS is_holiday_week
FROM ({TYPE_WEEKS}) t LEFT JOIN h ON dt BETWEEN week_start AND week_start + 6 GROUP BY 1, 2, 3"""
)
def holiday_weeks(spark, d):
    weeks = type_weeks(spark, d)
    years = sales(spark, d).agg(F.min(F.year("sales_date")).alias("a"), F.max(F.year("sales_date")).alias("b"))
    days = F.array(
        *[
            F.struct(F.lit(name).alias("name"), F.make_date("y", F.lit(m), F.lit(day)).alias("date"))
            for name, m, day in [("Founders", 7, 4), ("Year end", 12, 31), ("New Year", 1, 1)]
        ]
    )
    holidays = years.select(F.explode(F.sequence("a", F.expr("b + 1"))).alias("y")).select(F.inline(days))
    out = flag_holiday_weeks(weeks, holidays)
    return out.withColumn("holidays", F.array_join("holidays", ","))
