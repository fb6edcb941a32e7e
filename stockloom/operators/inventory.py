"""Stock levels: usage, projection, reorders, current state."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from stockloom.operators.keys import join_by_keys


def daily_usage(history, keys, date="date", quantity="quantity_on_hand"):
    """Mean fall of the level from one snapshot to the next, divided by 7, with the last date and level of each key.

    Without gaps the falls add up to first less last level, so one aggregate is enough and the history is neither shuffled
    nor sorted. Only keys with NULL levels, where the falls beside a gap do not count, are walked snapshot by snapshot; if no
    level is NULL, the scalar subquery stops every row before that step, and if the schema rules NULL out it is not planned.
    """
    keys = list(keys)
    if not keys:
        return daily_usage(history.withColumn("_all", F.lit(True)), ["_all"], date, quantity).drop("_all")
    level = F.col(quantity)
    steps = F.count(level) - 1
    summed = history.groupBy(*keys).agg(
        F.when(steps > 0, (F.min_by(level, date) - F.max_by(level, date)) / steps / 7).alias("_plain"),
        F.max(date).alias("last_date"),
        F.max_by(level, date).alias("last_level"),
        (F.count(level) < F.count(F.lit(1))).alias("_gaps"),
    )
    if not history.schema[quantity].nullable:
        return summed.select(*keys, F.col("_plain").alias("daily_usage"), "last_date", "last_level")
    gapped = summed.filter("_gaps").select(*keys)
    fall = F.lag(level).over(Window.partitionBy(*keys).orderBy(date)) - level
    any_gap = history.agg(F.coalesce(F.bool_or(level.isNull()), F.lit(False)).alias("gap"))
    walked = history.filter(any_gap.scalar()).transform(join_by_keys, gapped, keys, "left_semi").withColumn("_fall", fall)
    walked = walked.groupBy(*keys).agg((F.avg("_fall") / 7).alias("_walked"))
    usage = F.when(F.col("_gaps"), F.col("_walked")).otherwise(F.col("_plain"))
    return join_by_keys(summed, walked, keys, "left").select(*keys, usage.alias("daily_usage"), "last_date", "last_level")


def project_inventory(history, keys, horizon=30, date="date", quantity="quantity_on_hand"):
    """Daily level for `horizon` days after the last snapshot: yesterday's level less the usage, never below zero.

    The day-by-day rule has a closed form. Falling stock stops at zero; rising stock (negative usage) is cut at zero only
    on the first day. Fewer than two snapshots give no usage and NULL levels, and so
    does a last snapshot without a level.
    """
    state = daily_usage(history, keys, date, quantity)
    day, usage, last = F.col("_day"), F.col("daily_usage"), F.col("last_level")
    zero = F.lit(0.0)
    falling = F.greatest(last - usage * day, zero)
    rising = F.greatest(last - usage, zero) - usage * (day - 1)
    level = F.when(last.isNull() | usage.isNull(), None).when(usage >= 0, falling).otherwise(rising)
    days = state.withColumn("_day", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    return days.select(*keys, F.expr("date_add(last_date, _day)").alias("date"), level.alias("inventory_level"))


def _with_passes(levels, params, keys, n):
    """Levels joined to their parameters, with order and arrival day of each reorder pass. Without keys there is one item."""
    joint = [*keys, "_all"]
    one = F.lit(True).alias("_all")
    given = params.select(*keys, "lead_time_days", "reorder_threshold", "reorder_quantity", one)
    frame = levels.select("*", one).join(given, joint, "left")
    whole = Window.partitionBy(*keys)
    frame = frame.withColumn("_level", F.col("inventory_level"))
    for i in range(1, n + 1):
        due = F.col("_level") <= F.col("reorder_threshold")
        if i > 1:
            due = due & (F.col("date") > F.col(f"_arrival{i - 1}"))
        frame = frame.withColumn(f"_order{i}", F.min(F.when(due, F.col("date"))).over(whole))
        frame = frame.withColumn(f"_arrival{i}", F.expr(f"date_add(_order{i}, lead_time_days)"))
        refill = F.when(F.col("date") >= F.col(f"_arrival{i}"), F.col("reorder_quantity")).otherwise(0)
        frame = frame.withColumn("_level", F.col("_level") + refill)
    return frame


def apply_reorders(levels, params, keys, n=2):
    """Levels after up to n reorders. An order is placed on the first day at or below the threshold, for the second and
    later ones strictly after the previous arrival; its quantity counts from the arrival day on."""
    frame = _with_passes(levels, params, keys, n)
    return frame.select(*keys, "date", F.col("_level").alias("inventory_level"))


def reorder_events(levels, params, keys, n=2):
    """One row per reorder placed: which, order_day, arrival_day (may lie beyond the horizon), quantity."""
    names = ["first", "second", "third"]
    passes = [
        F.struct(
            F.lit(names[i - 1] if i <= len(names) else f"{i}th").alias("which"),
            F.first(f"_order{i}").alias("order_day"),
            F.first(f"_arrival{i}").alias("arrival_day"),
            F.first("reorder_quantity").alias("quantity"),
        )
        for i in range(1, n + 1)
    ]
    frame = _with_passes(levels, params, keys, n).groupBy(*keys).agg(F.array(*passes).alias("_events"))
    return frame.select(*keys, F.inline("_events")).filter(F.col("order_day").isNotNull())


def level_at_arrival(levels, events, keys):
    """Each event with the level on its arrival day; NULL when that day is outside the levels."""
    at = levels.select(*keys, F.col("date").alias("arrival_day"), F.col("inventory_level").alias("level_at_arrival"))
    return events.join(at, [*keys, "arrival_day"], "left")


def inventory_state(history, items, key, date="date", columns=("quantity_on_hand", "reorder_threshold", "lead_time_days")):
    """Latest state of each requested item, with `found` false for items without history."""
    latest = history.groupBy(key).agg(F.max_by(F.struct(*columns), date).alias("_state"), F.lit(True).alias("_seen"))
    joined = items.select(key).distinct().join(latest, key, "left")
    picked = [F.col(f"_state.{c}").alias(c) for c in columns]
    return joined.select(key, *picked, F.coalesce("_seen", F.lit(False)).alias("found"))
