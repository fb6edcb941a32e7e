"""Inventory: usage, projection, reorders, state."""

from pyspark.sql import functions as F

from checks.base import STOCK, query, reorder_params, stock_history, table
from stockloom.operators import inventory


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


USAGE = f"""SELECT item_id, avg(-step) / 7 AS daily_usage, max(date) AS last_date, arg_max(quantity_on_hand, date) AS last_level
FROM (SELECT *, quantity_on_hand - lag(quantity_on_hand) OVER (PARTITION BY item_id ORDER BY date) AS step FROM ({STOCK})) GROUP BY 1"""


@query(f"SELECT item_id, round(daily_usage, 6) AS daily_usage, last_date, last_level FROM ({USAGE})")
def daily_usage(spark, d):
    return rounded(inventory.daily_usage(stock_history(spark, d), ["item_id"]), "daily_usage")


# Levels of every eleventh item stand under the NULL item, with every fifth week missing.
GAPPED = f"""SELECT CASE WHEN item_id % 11 <> 0 THEN item_id END AS item_id, date,
  CASE WHEN week(date) % 5 <> 0 THEN avg(quantity_on_hand) END AS quantity_on_hand FROM ({STOCK}) GROUP BY 1, 2"""


@query(
    f"""SELECT item_id, round(avg(-step) / 7, 6) AS daily_usage, max(date) AS last_date, round(arg_max_null(quantity_on_hand, date), 6) AS last_level
FROM (SELECT *, quantity_on_hand - lag(quantity_on_hand) OVER (PARTITION BY item_id ORDER BY date) AS step FROM ({GAPPED})) GROUP BY 1"""
)
def daily_usage_null_item(spark, d):
    key = F.when(F.col("item_id") % 11 != 0, F.col("item_id")).alias("item_id")
    level = F.when(F.weekofyear("date") % 5 != 0, F.avg("quantity_on_hand")).alias("quantity_on_hand")
    history = stock_history(spark, d).groupBy(key, "date").agg(level)
    return rounded(inventory.daily_usage(history, ["item_id"]), "daily_usage", "last_level")


# Day by day, as the rule is stated: yesterday's level less the usage, never below zero.
LEVELS = f"""WITH RECURSIVE u AS ({USAGE}),
l AS (SELECT item_id, daily_usage, last_date AS date, last_level::double AS inventory_level, 0 AS day FROM u
  UNION ALL SELECT item_id, daily_usage, date + 1, greatest(inventory_level - daily_usage, 0), day + 1 FROM l WHERE day < 30)
SELECT item_id, date, CASE WHEN daily_usage IS NOT NULL THEN inventory_level END AS inventory_level FROM l WHERE day > 0"""


@query(f"SELECT item_id, date, round(inventory_level, 6) AS inventory_level FROM ({LEVELS})")
def stock_projection(spark, d):
    return rounded(inventory.project_inventory(stock_history(spark, d), ["item_id"]), "inventory_level")


PARAMS = f"""SELECT item_id, (item_id % 5 + 2)::int AS lead, last - item_id * 7 % 150 AS threshold, (item_id % 30 + 10)::int AS qty
FROM (SELECT item_id, arg_max(quantity_on_hand, date) AS last FROM ({STOCK}) GROUP BY 1)"""

REORDERS = f"""levels AS (SELECT item_id, date, round(inventory_level, 6) AS inventory_level FROM ({LEVELS})),
params AS ({PARAMS}),
first AS (SELECT item_id, min(date) AS day, (min(date) + any_value(lead))::date AS arrival, any_value(qty) AS qty
  FROM levels JOIN params USING (item_id) WHERE inventory_level <= threshold GROUP BY 1),
once AS (SELECT l.item_id, l.date, l.inventory_level + CASE WHEN l.date >= f.arrival THEN f.qty ELSE 0 END AS inventory_level
  FROM levels l LEFT JOIN first f USING (item_id)),
second AS (SELECT o.item_id, min(o.date) AS day, (min(o.date) + any_value(lead))::date AS arrival, any_value(p.qty) AS qty
  FROM once o JOIN first f USING (item_id) JOIN params p USING (item_id)
  WHERE o.date > f.arrival AND o.inventory_level <= threshold GROUP BY 1)"""


def _levels_and_params(spark, d):
    history = stock_history(spark, d)
    levels = rounded(inventory.project_inventory(history, ["item_id"]), "inventory_level")
    return levels, reorder_params(history)


@query(
    f"""WITH {REORDERS} SELECT o.item_id, o.date,
  round(o.inventory_level + CASE WHEN o.date >= s.arrival THEN s.qty ELSE 0 END, 6) AS inventory_level
FROM once o LEFT JOIN second s USING (item_id)"""
)
def stock_with_reorders(spark, d):
    levels, params = _levels_and_params(spark, d)
    return rounded(inventory.apply_reorders(levels, params, ["item_id"]), "inventory_level")


EVENTS = f"""WITH {REORDERS} SELECT item_id, 'first' AS which, day AS order_day, arrival AS arrival_day, qty AS quantity FROM first
UNION ALL SELECT item_id, 'second', day, arrival, qty FROM second"""


@query(EVENTS)
def reorder_events(spark, d):
    levels, params = _levels_and_params(spark, d)
    return inventory.reorder_events(levels, params, ["item_id"])


@query(
    f"""SELECT e.*, round(l.inventory_level, 6) AS level_at_arrival FROM ({EVENTS}) e
LEFT JOIN ({LEVELS}) l ON l.item_id = e.item_id AND l.date = e.arrival_day"""
)
def level_at_arrival(spark, d):
    levels, params = _levels_and_params(spark, d)
    events = inventory.reorder_events(levels, params, ["item_id"])
    return inventory.level_at_arrival(levels, events, ["item_id"])


@query(
    f"""WITH s AS (SELECT item_id, arg_max(quantity_on_hand, date) AS quantity_on_hand FROM ({STOCK}) GROUP BY 1),
asked AS (SELECT p_partkey AS item_id FROM part UNION SELECT s_suppkey - 1000000 FROM supplier)
SELECT item_id, quantity_on_hand, CASE WHEN quantity_on_hand IS NOT NULL THEN 100 + item_id % 50 END AS reorder_threshold,
  CASE WHEN quantity_on_hand IS NOT NULL THEN item_id % 5 END AS lead_time_days, quantity_on_hand IS NOT NULL AS found
FROM asked LEFT JOIN s USING (item_id)"""
)
def inventory_state(spark, d):
    item = F.col("item_id")
    history = stock_history(spark, d).withColumns({"reorder_threshold": item % 50 + 100, "lead_time_days": item % 5})
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("item_id"))
    unknown = table(spark, d, "supplier").select((F.col("s_suppkey") - 1000000).alias("item_id"))
    return inventory.inventory_state(history, parts.union(unknown), "item_id")
