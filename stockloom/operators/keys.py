"""Joins by keys that may be NULL."""

from functools import reduce
from operator import and_


def join_by_keys(left, right, keys, how="inner"):
    """Join on all keys, NULL being equal to NULL; the columns of `left`, then those of `right` that are no keys."""
    named = right.select(*[right[k].alias(f"_right_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = reduce(and_, [left[k].eqNullSafe(named[f"_right_{k}"]) for k in keys])
    return left.join(named, same, how).drop(*[f"_right_{k}" for k in keys])


def spread(df, columns):
    """Rows dealt by the columns to as many tasks as the session has for a shuffle, at least four per core.

    A shuffle that Spark merges by size leaves as few tasks as there are cores, whatever the table; this one is not merged.
    """
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *columns)
