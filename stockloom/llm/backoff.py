"""Stupid-backoff scores from n-gram count tables.

A text's word is scored by the longest n-gram ending in it that other documents hold: its count over that of its context, times `alpha`
for each word that the n-gram is short of `order`. Counts are those of all documents less the scored one, so a text is not its own
evidence. A word that no other document holds counts as held once, after one more backoff. The score is the mean of the logarithms to
base ten; copies of a text raise each other's.

Documents travel in slots, compressed runs of rows as they were read, so that repeated rows spread like any others. Slots are dealt to
chunks of about CHUNK_CHARS characters, and n-grams to buckets by hash. The count table has one row per bucket and chunk: the chunk's
different n-grams of that bucket, each once however often it occurs, and their counts. Grouped by bucket the rows are added up; joined
back on the chunk, the sums meet the n-grams of its documents. So an n-gram that all documents hold is one entry per chunk. N-grams are
told apart by 64 bits. What is sent is packed: sorted keys as differences, numbers by byte planes, compressed. A task that runs again
must read its rows in the same order, as from files.

Words are those between ASCII white space, A-Z lower-cased. Texts without words (null, empty) have n_words 0 and no score; in a corpus
without other words the score is null as well, and an empty table gives no rows. Repeated rows are documents of their own, ties do not
arise, long texts are counted whole, and other columns play no part, whatever their names.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import functions as F

from stockloom.llm.wording import LOWER, as_bytes, spaced_words
from stockloom.session import shared_folder

ORDER, ALPHA = 3, 0.4
CHUNK_CHARS = 1 << 23
#: Bytes of the texts of a slot, but for a longer single text.
SLOT_BYTES = 1 << 18
#: Words whose own counts are looked at at once.
SLICE_WORDS = 1 << 18


def _mixed(a, b):
    """64 bits for the pair, order counting."""
    h = a * np.uint64(0x9E3779B97F4A7C15) + b
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


class Grams:
    """A chunk's n-grams: for each length the key of the one that ends at each word, and the sorted different keys."""

    def __init__(self, texts, order):
        known, hashes, ids, sizes = {}, [], [], []
        for text in texts:
            words = spaced_words(text, LOWER)
            for w in words:
                if w not in known:
                    known[w] = len(known)
                    hashes.append(xxhash.xxh64_intdigest(w))
            ids.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
            sizes.append(len(words))
        self.sizes = np.array(sizes, np.int64)
        del known
        self.doc = np.repeat(np.arange(len(sizes), dtype=np.int32), self.sizes)
        first = np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        self.at = (np.arange(len(self.doc)) - first).astype(np.int32)
        one = np.array(hashes, np.uint64)[np.concatenate(ids)] if hashes else np.zeros(0, np.uint64)
        self.keys = [one]
        for _ in range(order - 1):
            longer = _mixed(one, np.uint64(0))
            longer[1:] = _mixed(self.keys[-1][:-1], one[1:])
            self.keys.append(longer)
        whole = np.concatenate([k[self.at >= n] for n, k in enumerate(self.keys)])
        self.distinct, self.counts = np.unique(whole, return_counts=True)


def _bucket(keys, buckets):
    """Keys in order go to buckets in order."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _pack(numbers):
    """Bytes of whole numbers, the first bytes of all before the second ones, compressed."""
    planes = np.ascontiguousarray(numbers.view(np.uint8).reshape(len(numbers), numbers.itemsize).T)
    return len(numbers).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpack(packed, kind):
    n, size = int.from_bytes(packed[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(packed[8:], n * size, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).ravel()


def _pack_sorted(keys):
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_sorted(packed):
    return np.cumsum(_unpack(packed, np.uint64), dtype=np.uint64)


def _slots(size):
    """doc_id and text of some rows at a time, as a compressed table, with a number of their own."""

    def pack(batches):
        slot = TaskContext.get().partitionId() << 33
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
            first = 0
            while first < batch.num_rows:
                last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + size, "right")))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(batch.slice(first, last - first))
                yield pa.RecordBatch.from_pydict({"slot": pa.array([slot]), "rows": pa.array([sink.getvalue().to_pybytes()], pa.binary())})
                first, slot = last, slot + 1

    return pack


def _unslotted(table):
    return pa.concat_tables([pa.ipc.open_stream(rows).read_all() for rows in table["rows"].to_pylist()])


def _counted(order, buckets):
    """chunk -> (bucket, chunk, its different keys, their counts)."""

    def count(key, table):
        grams = Grams(as_bytes(_unslotted(table)["text"].combine_chunks()), order)
        ends = np.searchsorted(_bucket(grams.distinct, buckets), np.arange(buckets + 1).astype(np.uint64))
        full = np.flatnonzero(np.diff(ends))
        keys = [_pack_sorted(grams.distinct[ends[b] : ends[b + 1]]) for b in full]
        counts = [_pack(grams.counts[ends[b] : ends[b + 1]].astype(np.uint32)) for b in full]
        chunk = pa.array(np.full(len(full), key[0].as_py(), np.int64))
        return pa.table({"bucket": pa.array(full.astype(np.int64)), "chunk": chunk, "keys": pa.array(keys, pa.binary()), "counts": pa.array(counts, pa.binary())})

    return count


def _added(table):
    """A bucket's counts -> (chunk, bucket, sums in the order of the chunk's keys)."""
    keys = [_unpack_sorted(k) for k in table["keys"].to_pylist()]
    counts = [_unpack(c, np.uint32) for c in table["counts"].to_pylist()]
    _, place = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.bincount(place, weights=np.concatenate(counts)).astype(np.int64)[place]  # whole numbers, exact to 2**53
    cuts = np.cumsum([len(k) for k in keys])[:-1]
    return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "sums": pa.array([_pack(s) for s in np.split(sums, cuts)], pa.binary())})


def _word_scores(grams, words, totals, order, alpha):
    """Per word of some whole documents its logarithm, but for the corpus size of single words, and whether it is scored alone."""
    at, doc = grams.at[words], grams.doc[words].astype(np.int64)
    others = []  # per length: count in the other documents of the n-gram that ends at each word; 0 where the text is too short for it
    for n, keys in enumerate(grams.keys):
        here = at >= n
        place = np.searchsorted(grams.distinct, keys[words][here])
        _, own, times = np.unique(doc[here] * len(grams.distinct) + place, return_inverse=True, return_counts=True)
        count = np.zeros(len(at), np.int64)
        count[here] = totals[place] - times[own]
        others.append(count)
    logs, left = np.zeros(len(at)), np.ones(len(at), bool)
    longest = np.minimum(at, order - 1)  # a first word has no longer n-gram to back off from
    for n in range(order - 1, 0, -1):
        found = left & (others[n] > 0)
        k = np.flatnonzero(found)
        logs[k] = (longest[k] - n) * np.log10(alpha) + np.log10(others[n][k]) - np.log10(others[n - 1][k - 1])
        left &= ~found
    k = np.flatnonzero(left)
    single = others[0][k]
    logs[k] = longest[k] * np.log10(alpha) + np.where(single > 0, np.log10(np.maximum(single, 1)), np.log10(alpha))
    return logs, left


SCORES = "doc_id {kind}, n_words long, words_left long, backed_off long, logs double"


def _scored(order, alpha):
    """chunk and its sums -> per document the sum of logarithms, but for the corpus size of single words."""

    def score(slots, sums):
        table = _unslotted(slots)
        grams = Grams(as_bytes(table["text"].combine_chunks()), order)
        parts = sums.sort_by("bucket")["sums"].to_pylist()
        totals = np.concatenate([_unpack(p, np.int64) for p in parts]) if parts else np.zeros(0, np.int64)
        docs = len(grams.sizes)
        logs, left, back = np.zeros(docs), np.zeros(docs, np.int64), np.zeros(docs, np.int64)
        ends = np.cumsum(grams.sizes)
        first = 0
        while first < docs:  # whole documents, about SLICE_WORDS words at a time
            start = ends[first] - grams.sizes[first]
            last = max(first + 1, int(np.searchsorted(ends, start + SLICE_WORDS, "right")))
            words = slice(start, ends[last - 1])
            doc = grams.doc[words] - first
            values, alone = _word_scores(grams, words, totals, order, alpha)
            total = lambda w: np.bincount(doc, weights=w, minlength=last - first)  # noqa: E731, B023
            logs[first:last] = total(values)
            left[first:last] = total(alone)
            back[first:last] = total(alone & (grams.at[words] > 0))
            first = last
        columns = {"doc_id": table["doc_id"], "n_words": pa.array(grams.sizes), "words_left": pa.array(left), "backed_off": pa.array(back), "logs": pa.array(logs)}
        return pa.table(columns)

    return score


def scores(docs, order=ORDER, alpha=ALPHA, doc_id="doc_id", text="text", chunk_chars=CHUNK_CHARS):
    """One row per row of docs: doc_id, n_words, backed_off (words scored alone although another precedes them), score."""
    shared_folder(docs.sparkSession)
    chars = docs.agg(F.sum(F.length(text))).first()[0] or 0
    chunks = -(-chars // chunk_chars) or 1
    buckets = chunks
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    slots = rows.mapInArrow(_slots(min(SLOT_BYTES, chunk_chars)), "slot long, rows binary")
    work = slots.withColumn("chunk", F.pmod(F.xxhash64("slot"), F.lit(chunks)))
    counted = work.groupBy("chunk").applyInArrow(_counted(order, buckets), "bucket long, chunk long, keys binary, counts binary")
    sums = counted.groupBy("bucket").applyInArrow(_added, "chunk long, bucket long, sums binary")
    scored = work.groupBy("chunk").cogroup(sums.groupBy("chunk")).applyInArrow(_scored(order, alpha), SCORES.format(kind=kind)).checkpoint()
    total = scored.agg(F.sum("n_words")).first()[0] or 0
    rest = F.lit(total) - F.col("n_words")
    mean = (F.col("logs") - F.col("words_left") * F.log10(rest.cast("double"))) / F.col("n_words")
    return scored.select("doc_id", "n_words", "backed_off", F.when((F.col("n_words") > 0) & (rest > 0), F.round(mean, 6)).alias("score"))
