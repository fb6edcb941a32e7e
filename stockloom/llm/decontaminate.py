"""Benchmark decontamination by Wu-Manber search over words.

Each benchmark text is cut into windows of consecutive words. A shift table over blocks of two words says how far the search may
jump; where it says zero, the bucket of the block at the window's end lists the windows to compare word by word.

Nulls and empty texts have no words. A benchmark row without id marks words but is no item. Repeated rows are judged one by one;
repeated items count once. An empty benchmark leaves every text clean.
Long texts are read whole, an empty documents table gives no rows, and other columns stay as they are, whatever their names.
"""

import pyarrow as pa
from pyspark.sql import functions as F

from stockloom.llm.wording import ALPHANUMERIC, as_bytes, packed, spaced_words
from stockloom.session import shared_folder

#: Characters of benchmark text whose tables are sent to the executors at once.
BLOCK_CHARS = 2_000_000
STATE = "struct<n_words:bigint,n_hit:bigint,hits:binary,items:array<string>>"


def windows(text, size):
    """The windows of one text: runs of `size` words, or all of a shorter text."""
    words = spaced_words(text, ALPHANUMERIC)
    if not words:
        return set()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def search_tables(patterns):
    """Per pattern length: (length, block, shifts, buckets). A bucket is found by the block that ends a pattern, then by its first word."""
    tables = []
    for length in sorted({len(p) for p in patterns}):
        block = min(2, length)
        shifts, buckets = {}, {}
        for pattern in patterns:
            if len(pattern) != length:
                continue
            for end in range(block, length + 1):
                key = pattern[end - block : end]
                shifts[key] = min(shifts.get(key, length), length - end)
            buckets.setdefault(pattern[-block:], {}).setdefault(pattern[0], []).append(pattern)
        tables.append((length, block, shifts, buckets))
    return tables


def occurrences(words, tables):
    """(start, pattern) of every place where a pattern stands."""
    n = len(words)
    for length, block, shifts, buckets in tables:
        furthest = length - block + 1
        shift_of = shifts.get
        end = length
        while end <= n:
            key = (words[end - 2], words[end - 1]) if block == 2 else (words[end - 1],)
            step = shift_of(key, furthest)
            if step:
                end += step
                continue
            start = end - length
            for pattern in buckets[key].get(words[start], ()):
                if tuple(words[start:end]) == pattern:
                    yield start, pattern
                    break
            end += 1


def _scan(tables, more):
    """Column function (text, state so far) -> state with these tables' hits; the marks of single words are kept if more tables follow."""

    def scan(texts: pa.Array, state: pa.Array) -> pa.Array:
        known, out = tables.value, []
        for text, before in zip(as_bytes(texts), state.to_pylist()):
            words = spaced_words(text, ALPHANUMERIC)
            marks = bytearray(before["hits"]) if before else bytearray(len(words))
            items = set(before["items"]) if before else set()
            for start, pattern in occurrences(words, known["tables"]):
                marks[start : start + len(pattern)] = b"\1" * len(pattern)
                items.update(known["items"][pattern])
            out.append({"n_words": len(words), "n_hit": marks.count(1), "hits": bytes(marks) if more else None, "items": sorted(items)})
        kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("hits", pa.binary()), ("items", pa.list_(pa.string()))])
        return pa.array(out, kind)

    return F.arrow_udf(scan, STATE).asNondeterministic()


def with_hits(docs, benchmark, window=13, text="text", item_id="item_id", item_text="text", block_chars=BLOCK_CHARS):
    """Columns `row` (struct of all columns of docs) and `hits` (n_words, n_hit, items: sorted ids of the items found, as strings).

    The benchmark is read in blocks of about `block_chars` characters, by hash, each sent to the executors in turn and run against all
    texts: its size is not limited. Between blocks the state is written to the shared folder."""
    spark = docs.sparkSession
    tests = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("text")).where("text is not null")
    chars = tests.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // block_chars) or 1
    found = packed(docs, text=text).withColumn("hits", F.lit(None).cast(STATE))
    for k in range(blocks):
        rows = tests.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).collect()
        items = {}
        for row in rows:
            for pattern in windows(row["text"].encode(), window):
                items.setdefault(pattern, set()).update([row["item"]] if row["item"] is not None else [])
        tables = spark.sparkContext.broadcast({"tables": search_tables(items), "items": items})
        found = found.withColumn("hits", _scan(tables, k + 1 < blocks)("text", "hits"))
        if k + 1 < blocks:
            shared_folder(spark)
            found = found.checkpoint()
    return found.select("row", "hits")


def contaminated(hits="hits"):
    """At least one word in twenty lies inside an occurrence."""
    return (F.col(f"{hits}.n_hit") > 0) & (20 * F.col(f"{hits}.n_hit") >= F.col(f"{hits}.n_words"))


def without_contaminated(docs, benchmark, **options):
    """The rows of docs that are not contaminated, columns unchanged."""
    return with_hits(docs, benchmark, **options).where(~contaminated()).select("row.*")


def report(docs, benchmark, doc_id="doc_id", **options):
    """One row per document: words, words hit, items found and the verdict."""
    found = with_hits(docs, benchmark, **options)
    return found.select(
        F.col(f"row.{doc_id}").alias("doc_id"),
        F.col("hits.n_words").alias("n_words"),
        F.col("hits.n_hit").alias("n_hit"),
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "hits.items"), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )
