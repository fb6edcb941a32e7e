"""Dimension and user table changes: as frames with the new content, or in place on tables stored by a bucket of the key."""

from pyspark.sql import functions as F

from stockloom.operators.aggregate import collapse_items
from stockloom.session import fresh_folder


def _merged(target, new, key, given):
    """Rows of `new` (one per key) replace the `given` columns of the target row of the same key, or are added to it.

    Rows of `new` without a key are left out; rows of the target without one stay as they are. One full join, so that both
    sides are read once.
    """
    new = new.filter(F.col(key).isNotNull())
    packed = new.select(F.col(key).alias("_key"), F.struct(*given).alias("_new"), F.lit(True).alias("_matched"))
    joined = target.join(packed, F.col(key) == F.col("_key"), "full_outer")
    columns = {c: F.when(F.col("_matched"), F.col(f"_new.{c}")).otherwise(F.col(c)) for c in given}
    columns[key] = F.coalesce(F.col(key), F.col("_key"))
    return joined.select(*[columns.get(c, F.col(c)).alias(c) for c in target.columns])


def upsert_dimension(dim, updates, key, mins, label):
    """Updates collapsed to one row per item replace the dimension rows of the same key."""
    fresh = collapse_items(updates, key, mins, label)
    return _merged(dim, fresh, key, [c for c in dim.columns if c != key])


def latest_by_key(df, key, order):
    """Last row per key by the order column, found by aggregation so that a key with many rows needs no sort."""
    rest = [c for c in df.columns if c != key]
    last = df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_last"))
    return last.select(key, "_last.*")


def upsert_by_key(target, updates, key, order):
    """Insert absent keys, set the given columns of present ones; columns the target lacks are ignored.

    Of several updates for a key the last by `order` counts.
    """
    given = [c for c in updates.columns if c in target.columns and c != key]
    return _merged(target, latest_by_key(updates, key, order), key, given)


def delete_by_key(target, keys_df, key):
    """Rows that remain, and a one-row frame with the number deleted."""
    doomed = keys_df.select(key).distinct()
    affected = target.join(doomed, key, "left_semi").agg(F.count(F.lit(1)).alias("affected"))
    return target.join(doomed, key, "left_anti"), affected


#: Column that a bucketed table is stored by.
BUCKET = "_bucket"


def _bucketed(df, key, buckets):
    return df.withColumn(BUCKET, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def _stored(spark, path):
    """The rows of a bucketed table with its bucket column, and its number of buckets."""
    table = spark.read.parquet(f"{path}/rows")
    return table, spark.read.parquet(f"{path}/layout").first()["buckets"]


def create_bucketed(df, path, key, buckets=64):
    """Store a table by a hash bucket of its key; its updates then rewrite only the buckets they touch."""
    df.sparkSession.createDataFrame([(key, buckets)], "key string, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{path}/layout")
    _bucketed(df, key, buckets).repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{path}/rows")


def read_bucketed(spark, path):
    return _stored(spark, path)[0].drop(BUCKET)


def _swap(spark, path, rows, columns, touched):
    """Put `rows` in place of the touched buckets. They are staged as a whole and swapped in by one dynamic partition overwrite, so
    a failure before that leaves the table as it was. A bucket left without rows is removed, as no partition would replace it."""
    staged = fresh_folder(spark, "buckets")
    rows.select(*columns, BUCKET).repartition(BUCKET).write.partitionBy(BUCKET).parquet(staged)
    new = spark.read.schema(rows.select(*columns, BUCKET).schema).parquet(staged)
    new.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(f"{path}/rows")
    left = {r[0] for r in new.select(BUCKET).distinct().collect()}
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for bucket in set(touched) - left:
        folder = hadoop(f"{path}/rows/{BUCKET}={bucket}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _touched(spark, path, key, given):
    """The table's rows in the buckets that the keys of `given` fall into, `given` with its keys in the type they are stored in (or else
    one key could have two buckets), the numbers of these buckets (at most all of them), and how many there are."""
    table, buckets = _stored(spark, path)
    given = given.withColumn(key, F.col(key).cast(table.schema[key].dataType))
    touched = [r[0] for r in _bucketed(given.select(key).where(F.col(key).isNotNull()), key, buckets).select(BUCKET).distinct().collect()]
    return table.where(F.col(BUCKET).isin(touched)), given, touched, buckets


def upsert_bucketed(spark, path, updates, key, order=None):
    """upsert_by_key on a bucketed table in place (without `order` the updates have one row per key); returns how many buckets were rewritten.
    Buckets without an update keep their files."""
    if order is not None:
        updates = latest_by_key(updates, key, order)
    rows, updates, touched, buckets = _touched(spark, path, key, updates)
    if touched:
        columns = [c for c in rows.columns if c != BUCKET]
        merged = _merged(rows.select(columns), updates, key, [c for c in updates.columns if c in columns and c != key])
        _swap(spark, path, _bucketed(merged, key, buckets), columns, touched)
    return len(touched)


def delete_bucketed(spark, path, keys_df, key):
    """delete_by_key on a bucketed table in place; returns the number of rows deleted."""
    rows, keys_df, touched, buckets = _touched(spark, path, key, keys_df)
    if not touched:
        return 0
    columns = [c for c in rows.columns if c != BUCKET]
    remaining, affected = delete_by_key(rows.select(columns), keys_df, key)
    count = affected.first()["affected"]
    if count:
        _swap(spark, path, _bucketed(remaining, key, buckets), columns, touched)
    return count


def append_logins(existing, logins, key, order, payload=None, provider="google"):
    """Login rows with provider, is_new and the JSON payload.

    A login is new when it is the first of a key that does not exist yet. First logins are found per key by aggregation
    and joined back on (key, order), which is unique, so a key with very many logins stays spread out.
    """
    payload = [c for c in logins.columns if c != order] if payload is None else payload
    firsts = logins.groupBy(key).agg(F.min(order).alias(order))
    new = firsts.join(existing.select(key).distinct(), key, "left_anti").withColumn("_new", F.lit(True))
    given = F.col("provider") if "provider" in logins.columns else F.lit(None).cast("string")
    joined = logins.withColumns({"raw_payload": F.to_json(F.struct(*payload)), "provider": F.coalesce(given, F.lit(provider))})
    return joined.join(new, [key, order], "left").withColumn("is_new", F.coalesce("_new", F.lit(False))).drop("_new")
