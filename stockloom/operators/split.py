"""Exact-size random splits and time-ordered splits."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from stockloom.operators.keys import spread
from stockloom.session import shared_folder


def split_frames(df, key_cols, test=0.2, cal=0.2, seed=42):
    """Add `split`: test (ceil(n * test) rows), cal (ceil(rest * cal)) or train, at random but the same on every run.

    `key_cols` identify a row. Rows are ordered by a hash of key and seed. Counts per its top 16 bits tell which of 65,536 buckets
    hold the first row of cal and of train, and only those are ranked row by row. All other rows are labelled in one reading, by
    comparison with these two; rows that share the key of one of the two are labelled by rank.
    """
    placed = F.struct(F.xxhash64(*key_cols, F.lit(seed)).alias("h"), *[F.col(k).alias(f"k{i}") for i, k in enumerate(key_cols)])
    rows = df.select(F.struct(*df.columns).alias("_row"), placed.alias("_at"))
    bucket = F.shiftright("_at.h", 48).cast("int")
    upto = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    n_test = F.ceil(F.col("_n") * F.lit(test))
    n_cal = F.ceil((F.col("_n") - n_test) * F.lit(cal))
    # At most 65,536 rows; those that hold a border are one or two.
    counts = rows.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_c"))
    counts = counts.withColumns({"_end": F.sum("_c").over(upto), "_n": F.sum("_c").over(Window.partitionBy())})
    counts = counts.select("_bucket", "_end", (F.col("_end") - F.col("_c")).alias("_start"), n_test.alias("_t"), (n_test + n_cal).alias("_k"))
    holds = [(F.col("_start") <= F.col(c)) & (F.col(c) < F.col("_end")) for c in ("_t", "_k")]
    ranked = rows.withColumn("_bucket", bucket).join(F.broadcast(counts.filter(holds[0] | holds[1])), "_bucket")
    ranked = ranked.withColumn("_pos", F.col("_start") + F.row_number().over(Window.partitionBy("_bucket").orderBy("_at")) - 1)
    first = {c: ranked.filter(F.col("_pos") == F.col(c)).agg(F.max("_at").alias("_first")) for c in ("_t", "_k")}

    def compared(c):
        return F.coalesce(F.col("_at") < first[c].scalar(), F.lit(True)), F.coalesce(F.col("_at") == first[c].scalar(), F.lit(False))

    (is_test, at_cal), (before_train, at_train) = compared("_t"), compared("_k")
    tied = at_cal | at_train
    settled = rows.filter(~tied).withColumn("split", F.when(is_test, "test").when(before_train, "cal").otherwise("train"))
    by_rank = F.when(F.col("_pos") < F.col("_t"), "test").when(F.col("_pos") < F.col("_k"), "cal").otherwise("train")
    ends = ranked.filter(tied).withColumn("split", by_rank)
    return settled.select("_row.*", "split").unionByName(ends.select("_row.*", "split"))


def running_total(df, order, value, out):
    """Global running sum by the order columns without a one-task window.

    Rows are range-sorted and numbered by partition; the checkpoint fixes that layout, so that the partition totals and the
    rows agree even if executors are lost.
    """
    shared_folder(df.sparkSession)
    spot = F.monotonically_increasing_id()
    placed = df.orderBy(*order).withColumn("_id", spot).withColumn("_pid", F.shiftright("_id", 33)).checkpoint()
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("_pid").agg(F.sum(value).alias("_s"))
    offsets = totals.select("_pid", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_offset"))
    inner = Window.partitionBy("_pid").orderBy("_id").rowsBetween(Window.unboundedPreceding, 0)
    # One row per partition.
    joined = placed.join(F.broadcast(offsets), "_pid")
    return joined.withColumn(out, F.col("_offset") + F.sum(value).over(inner)).drop("_id", "_pid", "_offset")


def time_split(df, order, frac=0.2, keys=(), mode="by_key"):
    """Add `split`: the last ceil(n * frac) rows are test.

    `by_key` takes the last rows of every key by time. `global` orders all rows by (keys, time), so the test part is made
    of the last keys. NULL is a key like any other. Rows are counted per key and time first, and of those groups only the ones that
    hold a border are ranked row by row, so a key with very many rows is not sorted in one task. Rows and counts are dealt to a fixed
    number of tasks; merged by the few bytes that they are shuffled in, they would be gigabytes in a task's tables and sorts.
    """
    keys = list(keys)
    if mode not in ("by_key", "global"):
        raise ValueError("mode must be by_key or global")
    spot = [*keys, order]
    # As one struct, which is never NULL and equal where its fields are, the rows stand for the count, the join and the ranks alike.
    rows = spread(df.withColumn("_spot", F.struct(*spot)), ["_spot"])
    counts = rows.groupBy("_spot").agg(F.count(F.lit(1)).alias("_c")).select("_spot.*", "_c")
    if mode == "by_key":
        upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        counts = spread(counts, keys) if keys else counts
        ends = counts.withColumns({"_end": F.sum("_c").over(upto), "_n": F.sum("_c").over(Window.partitionBy(*keys))})
    else:
        n = df.agg(F.count(F.lit(1)).alias("_n"))
        ends = running_total(counts, spot, "_c", "_end").withColumn("_n", n.scalar())
    ends = ends.withColumn("_cut", F.col("_n") - F.ceil(F.col("_n") * F.lit(frac))).withColumn("_start", F.col("_end") - F.col("_c"))
    whole = F.when(F.col("_end") <= F.col("_cut"), "train").when(F.col("_start") >= F.col("_cut"), "test")
    ends = spread(ends.select(F.struct(*spot).alias("_spot"), "_start", "_cut", whole.alias("split")), ["_spot"])
    marked = rows.join(ends, "_spot")
    settled = marked.filter(F.col("split").isNotNull())
    rest = [c for c in df.columns if c not in spot]
    position = F.col("_start") + F.row_number().over(Window.partitionBy("_spot").orderBy(*(rest or spot)))
    border = marked.filter(F.col("split").isNull()).withColumn("_pos", position)
    border = border.withColumn("split", F.when(F.col("_pos") <= F.col("_cut"), "train").otherwise("test"))
    columns = [*df.columns, "split"]
    return settled.select(*columns).unionByName(border.select(*columns))
