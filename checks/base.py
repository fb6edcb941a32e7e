"""Registration and shared inputs of the queries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from stockloom.operators.aggregate import weekly_series

QUERIES = {}
ORACLES = {}


def query(sql=None):
    """Register a function (spark, sf_dir) -> DataFrame under its name, with the SQL for the same rows if there is one."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sales(spark, sf_dir):
    """Sales facts: the line items with a whole number of bottles per row."""
    line = table(spark, sf_dir, "lineitem")
    return line.select(
        F.to_date("l_shipdate").alias("sales_date"),
        F.col("l_quantity").cast("int").alias("bottles"),
        "l_partkey",
        "l_suppkey",
        "l_extendedprice",
        "l_returnflag",
        "l_linestatus",
    )


def part_weeks(spark, sf_dir):
    """Weekly quantity per part."""
    return weekly_series(sales(spark, sf_dir), "sales_date", "bottles", ["l_partkey"], "qty")


PART_WEEKS = """SELECT l_partkey, date_trunc('week', l_shipdate)::date AS week_start, sum(l_quantity)::bigint AS qty
  FROM lineitem GROUP BY 1, 2"""


def type_weeks(spark, sf_dir):
    """Weekly quantity per part type. Weeks are summed per part before the join, so a part with very many sales is one
    row per week by then."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    joined = part_weeks(spark, sf_dir).join(part, F.col("l_partkey") == F.col("p_partkey"))
    return weekly_series(joined, "week_start", "qty", ["p_type"], "qty")


TYPE_WEEKS = """SELECT p_type, date_trunc('week', l_shipdate)::date AS week_start, sum(l_quantity)::bigint AS qty
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2"""


def stock_history(spark, sf_dir):
    """Weekly stock per part: 10,000 less all that was sold so far."""
    window = Window.partitionBy("l_partkey").orderBy("week_start").rowsBetween(Window.unboundedPreceding, 0)
    weeks = part_weeks(spark, sf_dir)
    return weeks.select(
        F.col("l_partkey").alias("item_id"),
        F.col("week_start").alias("date"),
        (F.lit(10000) - F.coalesce(F.sum("qty").over(window), F.lit(0))).alias("quantity_on_hand"),
    )


STOCK = f"""SELECT l_partkey AS item_id, week_start AS date,
    (10000 - sum(qty) OVER (PARTITION BY l_partkey ORDER BY week_start))::bigint AS quantity_on_hand
  FROM ({PART_WEEKS})"""


def reorder_params(history):
    """Lead time, threshold and quantity per item, by arithmetic on the key."""
    return history.groupBy("item_id").agg(F.max_by("quantity_on_hand", "date").alias("_last")).select(
        "item_id",
        (F.col("item_id") % 5 + 2).cast("int").alias("lead_time_days"),
        (F.col("_last") - F.col("item_id") * 7 % 150).cast("int").alias("reorder_threshold"),
        (F.col("item_id") % 30 + 10).cast("int").alias("reorder_quantity"),
    )


def detections(spark, sf_dir):
    """Shelf detections from the events; some lack a source or a time, arrival is the event id."""
    events = table(spark, sf_dir, "events")
    return as_detections(events)


def as_detections(events):
    return events.select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        F.col("event_type").alias("class"),
        (F.col("value") / 500).alias("confidence"),
        F.when(F.col("user_id") % 11 != 0, F.concat(F.lit("cam"), F.col("user_id").cast("string"))).alias("source"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("table"),
        F.col("event_id").alias("arrival"),
    )


DETECTIONS = """SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp, event_type AS class, value / 500 AS confidence,
    CASE WHEN user_id % 11 <> 0 THEN 'cam' || user_id END AS source,
    CASE WHEN event_type <> 'error' THEN event_type END AS "table", event_id AS arrival
  FROM events"""
