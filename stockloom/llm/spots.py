"""A map of bits by which a second reading of the texts passes over what a first one has ruled out.

Its size is fixed, whatever the number of keys: where several keys share a bit, rows come through that an exact join then drops."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

#: 8 MB; 32,768 bits to a row of the collected map.
SPOTS = 1 << 26


def marked(keys, column):
    """The map with the bits of a column of longs set, as bytes in a numpy array."""
    spot = F.pmod(F.col(column), F.lit(SPOTS)) + 1
    rows = keys.groupBy(F.bitmap_bucket_number(spot).alias("row")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias("bits")).collect()
    out = np.zeros(SPOTS // 8, np.uint8)
    for r in rows:
        out[(r["row"] - 1) * 4096 : r["row"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def set_in(spots, keys):
    """Which of the keys (numpy, signed 64 bits) have their bit set."""
    at = keys & (SPOTS - 1)
    return (spots[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def passes(spark, spots):
    """Column function key -> whether its bit is set."""
    shared = spark.sparkContext.broadcast(spots)

    def of(keys: pa.Array) -> pa.Array:
        return pa.array(set_in(shared.value, keys.to_numpy(zero_copy_only=False)))

    return F.arrow_udf(of, "boolean")
