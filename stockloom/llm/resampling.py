"""Importance resampling towards a target distribution by hashed n-grams.

Texts become words and n-grams in Arrow: ascii_lower, split_pattern_regex and list_flatten give the words of a slice of texts in one
array, dictionary_encode numbers them; n-grams are pairs of a shorter n-gram's number and the next word's, shifted by one, within a text.
Each different pair is hashed once, by carrying its first part's CRC-32 on. A first reading counts the buckets of both tables, a second
one takes each bucket's gain, the log ratio of its shares in target and source, and reduces them to a mean per text.

The draw adds Gumbel noise from a hash of the id and takes the highest scores, ties to the smaller id. Scores are whole numbers, so
their counts fit in a small table whatever the number of documents; ranks are the count above a score and the place within it.

Null and empty texts have no words: weight 0, never drawn. A null id is hashed as an empty one and comes after all others in a tie.
Repeated rows are documents of their own, with scores alike and ranks one after the other. An empty table gives no rows; an empty target
leaves every gain to the source's counts. Long texts are read whole. Other columns play no part, whatever their names.
"""

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Window
from pyspark.sql import functions as F

from stockloom.session import shared_folder

BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LONGEST, BUCKETS, SEED, LEAST_WORDS, PERCENT = 1, 10_000, 2024, 20, 10
#: Bytes of text whose words are in memory at once, but for a longer single text.
SLICE_BYTES = 1 << 22
#: Ranks that one row is expanded to at once.
RUN = 100_000


def slices(texts):
    """Parts of a text column of about SLICE_BYTES each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(texts):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")))
        yield texts.slice(first, last - first)
        first = last


def grams(texts, longest, buckets):
    """For each length up to `longest`: text number and bucket of all n-grams, in the order of the texts."""
    lists = pc.split_pattern_regex(pc.ascii_lower(texts), BETWEEN)
    words, owner = pc.list_flatten(lists), pc.list_parent_indices(lists)
    full = pc.not_equal(words, "")
    words, owner = words.filter(full), owner.filter(full).to_numpy(zero_copy_only=False)
    coded = words.dictionary_encode()
    word, names = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), [w.encode() for w in coded.dictionary.to_pylist()]
    crcs = np.fromiter(map(zlib.crc32, names), np.int64, len(names))
    gram = word
    yield owner, (crcs % buckets)[gram]
    for n in range(1, longest):
        within = owner[n:] == owner[:-n]
        pairs, place = np.unique(gram[: len(word) - n][within] * len(names) + word[n:][within], return_inverse=True)
        first, second = np.divmod(pairs, max(1, len(names)))
        crcs = np.fromiter((zlib.crc32(b" " + names[w], int(crcs[g])) for g, w in zip(first, second)), np.int64, len(pairs))
        gram = np.zeros(len(within), np.int64)
        gram[within] = place
        yield owner[n:][within], (crcs % buckets)[place]


def bucket_counts(texts, longest, buckets):
    """bucket, n over a frame of one text column. Each task sends every bucket once."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch.column(0)):
                for _, bucket in grams(part, longest, buckets):
                    total += np.bincount(bucket, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    return texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source, target, buckets):
    """Per bucket the floored 1000 * ln of its smoothed share in the target over that in the source. Both frames: bucket, n."""
    counts = []
    for frame in (source, target):
        counts.append([0] * buckets)
        for row in frame.collect():  # at most one row per bucket
            counts[-1][row["bucket"]] = row["n"]
    all_s, all_t = (float(sum(c) + buckets) for c in counts)
    return np.array([math.floor(1000 * math.log((t + 1.0) * all_s / ((s + 1.0) * all_t))) for s, t in zip(*counts)], np.int64)


def weighed(docs, gain, longest, buckets, doc_id="doc_id", text="text"):
    """doc_id, n_words, n_features, weight (floored mean gain of the features) of all rows."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def weigh(batches):
        for batch in batches:
            sums, sizes, words = [], [], []
            for part in slices(batch.column("text")):
                total, size = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
                for n, (owner, bucket) in enumerate(grams(part, longest, buckets)):
                    if len(owner):
                        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                        total[owner[starts]] += np.add.reduceat(shared.value[bucket], starts)
                    size += (here := np.bincount(owner, minlength=len(part)))
                    if n == 0:
                        words.append(here)
                sums.append(total)
                sizes.append(size)
            sizes, words = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (sizes, words))
            weight = np.concatenate(sums) // np.maximum(sizes, 1) if sums else np.zeros(0, np.int64)
            columns = [batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(sizes, pa.int64()), pa.array(weight, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "weight"])

    return rows.mapInArrow(weigh, f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(doc_id, seed):
    """Floored 1000 * Gumbel noise from the first 32 bits of a hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(scored, least, percent):
    """The rows of scored (doc_id, n_words, n_features, weight, score) with rank, null where not drawn."""
    fit = scored.where(F.col("n_words") >= least)
    most = fit.count() * percent // 100
    # One row per score: scores are whole numbers within the range of the gains and the noise.
    levels = fit.groupBy("score").agg(F.count("*").alias("n"))
    above = F.sum("n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1))
    levels = levels.select("score", F.coalesce(above, F.lit(0)).alias("above")).where(F.col("above") < most).checkpoint()
    bar = levels.agg(F.min("score")).first()[0]
    if bar is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    in_draw = (F.col("n_words") >= least) & (F.col("score") >= bar)
    # Equal rows are one, counted, until they get their ranks.
    alike = scored.where(in_draw).groupBy("doc_id", "n_words", "n_features", "weight", "score").agg(F.count("*").alias("n"))
    place = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features", "weight", "n_words").rowsBetween(Window.unboundedPreceding, -1)
    runs = alike.join(levels, "score").withColumn("first", F.col("above") + F.coalesce(F.sum("n").over(place), F.lit(0)) + 1)
    runs = runs.withColumn("last", F.col("first") + F.col("n") - 1)
    runs = runs.withColumn("first", F.explode(F.sequence("first", "last", F.lit(RUN)))).repartition("first")
    rank = F.explode(F.sequence("first", F.least("last", F.col("first") + RUN - 1)))
    drawn = runs.select(*scored.columns, rank.alias("rank")).withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    return drawn.union(scored.where(~in_draw).withColumn("rank", F.lit(None).cast("long")))


def resampled(docs, target, longest=LONGEST, buckets=BUCKETS, seed=SEED, least=LEAST_WORDS, percent=PERCENT, doc_id="doc_id", text="text", target_text="text"):
    """One row per row of docs: doc_id, n_features, weight, score, and rank if it is drawn."""
    shared_folder(docs.sparkSession)
    source = bucket_counts(docs.select(F.col(text).alias("text")), longest, buckets)
    wanted = bucket_counts(target.select(F.col(target_text).alias("text")), longest, buckets)
    scored = weighed(docs, gains(source, wanted, buckets), longest, buckets, doc_id, text)
    scored = scored.withColumn("score", F.col("weight") + noise("doc_id", seed)).checkpoint()
    return ranked(scored, least, percent).select("doc_id", "n_features", "weight", "score", "rank")
