"""Errors, exact quantiles and autocorrelation per key."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from stockloom.functions.records import null_nan
from stockloom.operators.keys import join_by_keys

# Fixed value: smallest denominator of the relative error, the double machine epsilon.
MAPE_FLOOR = 2.220446049250313e-16
STRIPS = 1024
#: Relative accuracy of the sketch that brackets a quantile is one in so many; keys of up to so many rows need none.
ACCURACY = 10_000
#: Ranges that the order of long series is cut into at most.
MOST_RANGES = 256


def rmse(df, actual, predicted, keys=()):
    error = F.col(actual) - F.col(predicted)
    return df.groupBy(*keys).agg(F.sqrt(F.avg(error * error)).alias("rmse"))


def mape(df, actual, predicted, keys=()):
    """Mean of |actual - predicted| / max(|actual|, eps); NULL as soon as one input is missing."""
    a, p = null_nan(F.col(actual)), null_nan(F.col(predicted))
    term = F.abs(a - p) / F.greatest(F.abs(a), F.lit(MAPE_FLOOR))
    whole = F.count(F.lit(1)) == F.count(term)
    return df.groupBy(*keys).agg(F.when(whole, F.avg(term)).alias("mape"))


def exact_quantile(df, value, q, keys=(), accuracy=None, out="quantile", size=None):
    """Exact quantile with linear interpolation per key, without collecting or sorting a whole key. NULL is a key like any other.

    The rows are read twice. A mergeable sketch brackets the wanted ranks; then one aggregate counts the rows below the bracket and, per
    distinct value, those inside, about n * 16 / accuracy. Of these only a strip around each rank is ordered. The sketch's error is at
    most n / accuracy, an eighth of the bracket's margin; should a bracket miss its ranks all the same, the query fails. Keys of up to
    `accuracy` rows need no bracket, so there is at most one bracket to `accuracy` rows: brackets go to the rows by broadcast, and no
    task gets all the rows of a key. `size` names a column for the number of values.
    """
    keys, accuracy = list(keys), accuracy or ACCURACY
    x = F.col("_x")
    rows = df.select(*keys, null_nan(F.col(value)).alias("_x")).filter(x.isNotNull())
    # Without keys all rows have one, which the optimizer cannot take for a constant: the value is never NaN.
    by = keys or ["_all"]
    rows = rows if keys else rows.withColumn("_all", F.isnan("_x"))

    margin = 8.0 / accuracy
    ends = [max(0.0, q - margin), min(1.0, q + margin)]
    sketch = rows.groupBy(*by).agg(F.count("_x").alias("_n"), F.percentile_approx("_x", ends, accuracy).alias("_e"))
    brackets = sketch.filter(F.col("_n") > accuracy).select(*by, F.col("_e")[0].alias("_b0"), F.col("_e")[1].alias("_b1"))
    below, above = x < F.col("_b0"), x > F.col("_b1")
    # Strips of equal width between the bracket's ends; a key without a bracket is one strip.
    share_of_width = F.try_divide(x - F.col("_b0"), F.col("_b1") - F.col("_b0"))
    inner = F.least(F.greatest(F.floor(F.coalesce(share_of_width, F.lit(0.0)) * STRIPS), F.lit(0)), F.lit(STRIPS - 1))
    strip = F.when(below, -1).when(above, STRIPS).otherwise(inner).cast("int")
    tagged = join_by_keys(rows, F.broadcast(brackets), by, "left").withColumn("_strip", strip)
    tagged = tagged.withColumn("_x", F.when(F.col("_strip").between(0, STRIPS - 1), x))
    values = tagged.groupBy(*by, "_strip", "_x").agg(F.count(F.lit(1)).alias("_c"))

    whole = Window.partitionBy(*by)
    before = whole.orderBy("_strip").rowsBetween(Window.unboundedPreceding, -1)
    strips = values.groupBy(*by, "_strip").agg(F.sum("_c").alias("_rows"))
    strips = strips.withColumns({"_start": F.coalesce(F.sum("_rows").over(before), F.lit(0)), "_n": F.sum("_rows").over(whole)})
    strips = strips.withColumn("_place", (F.col("_n") - 1) * F.lit(float(q)))
    lo, hi = F.floor("_place"), F.ceil("_place")
    wanted = strips.filter((F.col("_start") <= hi) & (lo < F.col("_start") + F.col("_rows")))
    missed = F.raise_error(F.lit("a quantile's bracket does not hold its ranks"))
    wanted = wanted.withColumn("_start", F.when(F.col("_strip").between(0, STRIPS - 1), F.col("_start")).otherwise(missed.cast("long")))
    kept = join_by_keys(values, wanted.drop("_rows"), [*by, "_strip"])

    upto = Window.partitionBy(*by, "_strip").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    ranked = kept.withColumn("_end", F.sum("_c").over(upto) + F.col("_start"))
    first = F.col("_end") - F.col("_c")

    def at(rank):
        return F.max(F.when((first <= rank) & (rank < F.col("_end")), x))

    low, high = at(lo), at(hi)
    counted = [F.max("_n").alias(size)] if size else []
    found = ranked.groupBy(*by).agg((low + (high - low) * F.max(F.col("_place") - lo)).alias(out), *counted)
    return found if keys else found.drop("_all")


def _errors(df, actual, predicted):
    return df.withColumn("_err", F.abs(F.col(actual) - F.col(predicted)))


def abs_error_quantile(df, actual, predicted, alpha=0.1, keys=()):
    """The 1 - alpha quantile of |actual - predicted|."""
    return exact_quantile(_errors(df, actual, predicted), "_err", 1 - alpha, keys, out="q")


def conformal_intervals(cal, test, actual="actual", predicted="predicted", alpha=0.1, keys=()):
    """Test rows with lower and upper: prediction minus and plus the error quantile of the calibration rows.

    Keys may be NULL; a key without calibration rows has NULL bounds. Keys of more than ACCURACY calibration rows, of which there are
    few, reach the test rows by broadcast; the others by a join, for which rows that have their quantile by then are dealt out evenly."""
    keys = list(keys)
    if keys:
        q = exact_quantile(_errors(cal, actual, predicted), "_err", 1 - alpha, keys, out="_q", size="_size")
        large = F.col("_size") > ACCURACY
        with_q = join_by_keys(test, F.broadcast(q.filter(large).drop("_size")), keys, "left")
        plain = [c for c, kind in test.dtypes if "map<" not in kind and "variant" not in kind]
        dealt = F.when(F.col("_q").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(*plain), F.lit(1 << 20)))
        rest = q.filter(~large).select(*keys, F.col("_q").alias("_rest"), F.when(large, 1).otherwise(0).cast("long").alias("_dealt"))
        with_q = join_by_keys(with_q.withColumn("_dealt", dealt.cast("long")), rest, [*keys, "_dealt"], "left")
        with_q = with_q.withColumn("q", F.coalesce("_q", "_rest")).drop("_q", "_rest", "_dealt")
    else:
        with_q = test.withColumn("q", abs_error_quantile(cal, actual, predicted, alpha).scalar())
    return with_q.withColumns({"lower": F.col(predicted) - F.col("q"), "upper": F.col(predicted) + F.col("q")}).drop("q")


def _dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)


def _let(value, body):
    """Evaluate a value once and use it in an expression as often as needed."""
    return F.transform(F.array(value), body)[0]


def _numbered(clean, keys, ranges):
    """Rows _o, _v with _n (rows of the key), _x (the value less the key's mean) and _pos (place in the key's order, from 0).

    The order is cut into ranges at approximate quantiles; rows are ranked within key and range, and ranges start where the counts of those
    before them end. So a key is never sorted as a whole, and where the cuts lie changes nothing but the size of the ranges.
    The quantiles, at most MOST_RANGES, are found at once, by a reading of their own."""
    shares = [F.lit(k / ranges) for k in range(1, ranges)]
    cuts = clean.agg(F.percentile_approx("_o", F.array(*shares), 10 * ranges)).first()[0] if shares else None
    dealt = clean.withColumn("_range", F.size(F.filter(F.lit(cuts), lambda c: c <= F.col("_o"))) if cuts else F.lit(0))
    counted = dealt.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_c"), F.sum("_v").alias("_s"))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("_c").over(whole)
    sized = counted.select(*keys, "_range", total.alias("_n"), (F.sum("_s").over(whole) / total).alias("_mean"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_from"))
    ranked = dealt.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys, "_range").orderBy("_o", "_v")))
    rows = join_by_keys(ranked, sized, [*keys, "_range"])
    return rows.select(*keys, "_n", (F.col("_v") - F.col("_mean")).alias("_x"), (F.col("_from") + F.col("_rn") - 1).alias("_pos"))


def _products(max_lag):
    """Column function: sums of x[i] * x[i + lag] over the block's own values i, per lag; NULL for lags that reach beyond the series."""

    def of(blocks: pa.Array, owns: pa.Array) -> pa.Array:
        out = []
        for block, own in zip(blocks, owns.to_pylist()):
            x = block.values.to_numpy(zero_copy_only=False)
            pairs = [min(own, len(x) - k) for k in range(max_lag + 1)]
            out.append([float(x[:n] @ x[k : k + n]) if n > 0 else None for k, n in enumerate(pairs)])
        return pa.array(out, pa.list_(pa.float64()))

    return F.arrow_udf(of, "array<double>")


def _acf_by_blocks(df, keys, order, value, max_lag, block):
    """acf_arrays without the points, for series of any length: a group holds one block and max_lag values behind it."""
    clean = df.select(*keys, F.col(order).alias("_o"), null_nan(F.col(value)).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    ranges = min(MOST_RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = _numbered(clean, keys, ranges)
    block = max(block, max_lag)
    own = F.floor(F.col("_pos") / block)
    # The first max_lag values of a block are shown to the one before it.
    shown = F.when((F.col("_pos") % block < max_lag) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    held = rows.select(*keys, "_n", "_pos", "_x", own.alias("_own"), F.explode(shown).alias("_block"))
    held = held.groupBy(*keys, "_block").agg(
        F.max("_n").alias("_n"),
        F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_x"))), lambda p: p["_x"]).alias("_x"),
        F.count_if(F.col("_own") == F.col("_block")).alias("_own"),
    )
    sums = held.select(*keys, "_n", F.posexplode(_products(max_lag)("_x", "_own")).alias("_lag", "_sum"))
    sums = sums.groupBy(*keys, "_lag").agg(F.max("_n").alias("_n"), F.sum("_sum").alias("_sum")).where(F.col("_lag") < F.col("_n"))
    by_lag = F.transform(F.array_sort(F.collect_list(F.struct("_lag", "_sum"))), lambda p: p["_sum"])
    series = sums.groupBy(*keys).agg(F.max("_n").cast("int").alias("n"), by_lag.alias("_sums"))
    square = F.col("_sums")[0]
    return series.select(*keys, "n", F.transform("_sums", lambda s: F.when(square > 0, s / square)).alias("r"))


def acf_arrays(df, keys, order, value, max_lag=52, points=False, block=None):
    """Per key the number of values and the array of autocorrelations for lag 0..max_lag, at most n - 1; with `points` the
    series itself too.

    The series of a key becomes one sorted array: the input has one row per period, so that is at most the number of periods
    in the calendar. The divisor is the sum of squares of the whole series. With `block`, for long series whose order is a number, date
    or time, a series is cut into blocks of that many values instead, whose lagged products are added up.
    """
    if block is not None:
        if points:
            raise ValueError("points are given for series in one piece only")
        return _acf_by_blocks(df, keys, order, value, max_lag, block)
    pair = F.struct(F.col(order).alias(order), null_nan(F.col(value)).alias("v"))
    clean = df.select(*keys, pair.alias("_p")).filter(F.col("_p.v").isNotNull())

    def centred(pairs):
        mean = F.aggregate(pairs, F.lit(0.0), lambda total, p: total + p["v"]) / F.size(pairs)
        return _let(mean, lambda m: F.transform(pairs, lambda p: p["v"] - m))

    def correlations(x):
        lags = F.sequence(F.lit(0), F.least(F.lit(max_lag), F.size(x) - 1))

        def at(k, square):
            shifted = _dot(F.slice(x, F.lit(1), F.size(x) - k), F.slice(x, k + 1, F.size(x) - k))
            return F.when(square > 0, shifted / square)

        return _let(_dot(x, x), lambda square: F.transform(lags, lambda k: at(k, square)))

    series = clean.groupBy(*keys).agg(F.array_sort(F.collect_list("_p")).alias("_p")).filter(F.size("_p") > 0)
    r = _let(F.col("_p"), lambda pairs: _let(centred(pairs), correlations))
    return series.select(*keys, F.size("_p").alias("n"), r.alias("r"), *(["_p"] if points else []))


def acf(df, keys, order, value, max_lag=52, block=None):
    """Autocorrelation per lag 0..max_lag; NULL when the series does not vary."""
    arrays = acf_arrays(df, keys, order, value, max_lag, block=block)
    return arrays.select(*keys, F.posexplode("r").alias("lag", "acf"))


def _partials(r, max_lag):
    """Partial autocorrelations from autocorrelations: each lag adds one coefficient and reflects those before it."""
    none = F.array().cast("array<double>")
    start = F.struct(none.alias("phi"), F.lit(1.0).alias("error"), F.slice(r, 1, 1).alias("out"))

    def step(acc, k):
        gap = F.element_at(r, k + 1) - _dot(acc["phi"], F.reverse(F.slice(r, F.lit(2), k - 1)))

        def grown(a):
            mirrored = F.zip_with(acc["phi"], F.reverse(acc["phi"]), lambda p, q: p - a * q)
            return F.struct(
                F.array_append(mirrored, a).alias("phi"),
                (acc["error"] * (1 - a * a)).alias("error"),
                F.array_append(acc["out"], a).alias("out"),
            )

        return _let(F.when(acc["error"] > 0, gap / acc["error"]), grown)

    lags = F.slice(F.sequence(F.lit(1), F.lit(max_lag)), F.lit(1), F.size(r) - 1)
    return F.aggregate(lags, start, step, lambda acc: acc["out"])


def pacf(df, keys, order, value, max_lag=52, block=None):
    """Partial autocorrelation (Yule-Walker on the unadjusted autocorrelations) per lag."""
    arrays = acf_arrays(df, keys, order, value, max_lag, block=block)
    partial = _let(F.col("r"), lambda r: _partials(r, max_lag))
    return arrays.select(*keys, F.posexplode(partial).alias("lag", "pacf"))


def _strongest(r):
    """Struct of the lag with the largest absolute autocorrelation, the first on ties, and its signed strength."""
    sized = F.transform(r, lambda x, i: F.struct(F.abs(x).alias("size"), (-i).alias("neg"), x.alias("strength")))
    lags = F.filter(sized, lambda s: (s["neg"] < 0) & s["size"].isNotNull())

    def named(best):
        return F.struct((-best["neg"]).alias("period_weeks"), best["strength"].alias("periodicity_strength"))

    return _let(F.array_max(lags), named)


def detect_periodicity(df, keys, order, value, max_lag=52, block=None):
    """Dominant period per key and its signed strength; NULL when the series does not vary."""
    arrays = acf_arrays(df, keys, order, value, max_lag, block=block)
    return arrays.select(*keys, "n", F.inline(F.array(_strongest(F.col("r")))))


def with_periodicity(df, keys, order, value, max_lag=52):
    """The points of each series, NULLs dropped, with length, dominant period and strength of the series on every row."""
    arrays = acf_arrays(df, keys, order, value, max_lag, points=True)
    found = arrays.select(*keys, "n", "_p", F.inline(F.array(_strongest(F.col("r")))))
    rows = found.select(*keys, "n", "period_weeks", "periodicity_strength", F.inline("_p"))
    return rows.withColumnRenamed("v", value)
