"""Removal of repeated lines and sentences by hashing.

Units are a text's lines, and the sentences within them: pieces that end in . ! or ? before white space. A unit of `least` words or
more is normalised (A-Z lower-cased, white space runs made one space) and hashed to 128 bits. Of all units with one digest, of either
kind, the one of the least document id is kept (then the least text hash, then the least start); the others are removed. Offsets are
those of the original text, in characters, so removed pieces can be traced and the rest put together.

Shorter pieces are units together with their neighbours: from each one on, and up to each one, the least run of pieces, over lines as
well, that has `least` words. So a passage of short lines or sentences goes whole, and a short sentence that many texts hold by itself
stays. Where a text repeats itself in shorter steps than that, equal runs overlap: of these the leftmost count that do not. Of a unit
to remove, `cleaned` leaves what lies inside a unit that is kept, so each unit's words still stand in one piece somewhere.

Texts are read twice: first for digests, of which those met twice set their bits in a map of fixed size, then for the units of such
digests. Null and empty texts have no units. A null id comes before all others. Repeated rows are one document: they lose the same units.
Long texts are read whole, an empty table gives no rows, and other columns stay as they are, whatever their names.
"""

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from stockloom.llm import spots
from stockloom.llm.wording import LOWER, packed, text_hash
from stockloom.session import fresh_folder

LEAST_WORDS = 8
SENTENCE = re.compile(r"\S.*?(?:[.!?]+(?=[ \t\x0b\f\r])|$)")


def units(text, least):
    """(start, end, digest) of a text's lines, of the sentences of lines that have several, and of the runs around short pieces, from
    left to right; of equal ones that overlap only the first."""
    at, row, found = 0, [], []
    for line in (text or "").split("\n"):
        pieces = [m.span() for m in SENTENCE.finditer(line)]
        single = len(pieces)
        if single != 1:
            pieces.append((0, len(line)))
        for k, (start, end) in enumerate(pieces):
            words = line[start:end].encode().translate(LOWER).split()
            if len(words) >= least:
                found.append((at + start, at + end, xxhash.xxh3_128_digest(b" ".join(words))))
            if words and k < single:
                row.append((at + start, at + end, words))
        at += len(line) + 1
    for a, b in _runs([len(words) for *_, words in row], least):
        found.append((row[a][0], row[b][1], xxhash.xxh3_128_digest(b" ".join(w for *_, words in row[a : b + 1] for w in words))))
    ends = {}
    for unit in sorted(found):
        if unit[0] >= ends.get(unit[2], 0):
            ends[unit[2]] = unit[1]
            yield unit


def _runs(sizes, least):
    """(first, last) of the least runs of `least` words from each short piece on and up to each, every run once."""
    found = set()
    for k, size in enumerate(sizes):
        if size >= least:
            continue
        for step, stop in ((1, len(sizes)), (-1, -1)):
            words = 0
            for m in range(k, stop, step):
                words += sizes[m]
                if words >= least:
                    found.add((min(k, m), max(k, m)))
                    break
    return sorted(found)


def _spot(digest):
    return int.from_bytes(digest[:8], "little", signed=True)


def _digests(least):
    """How often a batch has each digest, by the bits that find its spot."""

    def count(batches):
        for batch in batches:
            keys = [_spot(u[2]) for text in batch.column("text") for u in units(text.as_py(), least)]
            every, times = np.unique(np.array(keys, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(every), pa.array(times)], names=["spot", "n"])

    return count


def _exploded(least, shared):
    """Units whose digest has its bit set."""

    def explode(batches):
        for batch in batches:
            ids, found = [], []
            for k, text in enumerate(batch.column("text")):
                own = list(units(text.as_py(), least))
                ids.extend([k] * len(own))
                found.extend(own)
            kept = np.flatnonzero(spots.set_in(shared.value, np.array([_spot(u[2]) for u in found], np.int64)))
            rows = pa.array(np.array(ids, np.int64)[kept])
            starts, ends, digests = ([found[k][c] for k in kept] for c in range(3))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(rows), batch.column("text_hash").take(rows), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(digests, pa.binary())],
                names=["doc_id", "text_hash", "start", "end", "digest"],
            )

    return explode


def _place():
    return F.struct("doc_id", "text_hash", "start", "end")


def found_twice(docs, least=LEAST_WORDS, doc_id="doc_id", text="text"):
    """Two written tables: doc_id, text_hash, start, end, digest of the units whose digest is met twice (and some others), and
    digest, first of those that stand in two places."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_hash(text).alias("text_hash"), F.col(text).alias("text")).where("text <> ''")
    kind = rows.schema["doc_id"].dataType.simpleString()
    often = rows.select("text").mapInArrow(_digests(least), "spot long, n long").groupBy("spot").agg(F.sum("n").alias("n")).where("n > 1")
    shared = spark.sparkContext.broadcast(spots.marked(often, "spot"))
    path = fresh_folder(spark, "units")
    rows.mapInArrow(_exploded(least, shared), f"doc_id {kind}, text_hash long, start long, end long, digest binary").write.parquet(path)
    found = spark.read.parquet(path)
    firsts = found.groupBy("digest").agg(F.min(_place()).alias("first"), F.max(_place()).alias("last")).where(~F.col("first").eqNullSafe(F.col("last")))
    # Both written, so that the join has two plain sides and adaptive execution can split a unit that very many texts have.
    return found, firsts.select("digest", "first").checkpoint()


def _again(found, firsts):
    again = found.join(firsts, "digest").where(~_place().eqNullSafe(F.col("first")))
    return again.select("doc_id", "text_hash", "start", "end", "digest", F.col("first.doc_id").alias("first_doc_id"), F.col("first.start").alias("first_start"))


def repeated_units(docs, least=LEAST_WORDS, doc_id="doc_id", text="text"):
    """doc_id, text_hash, start, end, digest, first_doc_id, first_start: the units that repeat one, and where that one stands."""
    return _again(*found_twice(docs, least, doc_id, text))


def _merged(spans):
    out = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def outside(spans, kept):
    """The parts of the spans that lie in none of the kept ones, in order."""
    out, kept, k = [], _merged(kept), 0
    for start, end in _merged(spans):
        while k < len(kept) and kept[k][1] <= start:
            k += 1
        at = k
        while at < len(kept) and kept[at][0] < end:
            if kept[at][0] > start:
                out.append((start, kept[at][0]))
            start = max(start, kept[at][1])
            at += 1
        if start < end:
            out.append((start, end))
    return out


def _without(text, spans):
    out, at = [], 0
    for start, end in spans:
        out.append(text[at:start])
        at = end
    out.append(text[at:])
    return "".join(out)


CUT = "struct<text:string,removed:array<struct<start:bigint,end:bigint>>>"


def _cut(texts: pa.Array, spans: pa.Array, kept: pa.Array) -> pa.Array:
    out = []
    for text, gone, stay in zip(texts, spans, kept):
        pairs = [[(s["start"], s["end"]) for s in own.as_py() or ()] for own in (gone, stay)]
        left = outside(*pairs)
        out.append({"text": None if text.as_py() is None else _without(text.as_py(), left), "removed": [{"start": a, "end": b} for a, b in left]})
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    return pa.array(out, pa.struct([("text", pa.string()), ("removed", pa.list_(span))]))


def cleaned(docs, least=LEAST_WORDS, doc_id="doc_id", text="text"):
    """`row` (all columns of docs as they were), `text` (what stays) and `removed`: the (start, end) removed, sorted."""
    keys = {"unnamed": F.col("doc_id").isNull(), "name": F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_hash": F.col("text_hash")}
    named = [c.alias(n) for n, c in keys.items()]
    found, firsts = found_twice(docs, least, doc_id, text)
    gone = _again(found, firsts).select(*named, F.struct("start", "end").alias("span"))
    gone = gone.groupBy(*keys).agg(F.array_sort(F.collect_set("span")).alias("gone"))
    kept = firsts.select("first.*").select(*named, F.struct("start", "end").alias("span")).groupBy(*keys).agg(F.collect_set("span").alias("kept"))
    spans = gone.join(kept, list(keys), "left").checkpoint()
    rows = packed(docs, doc_id=doc_id, text_hash=text_hash(text), text=text).select("row", "text", *named)
    cut = F.arrow_udf(_cut, CUT)
    return rows.join(spans, list(keys), "left").select("row", cut("text", "gone", "kept").alias("cut")).select("row", "cut.text", "cut.removed")


def report(docs, **options):
    """One row per unit that repeats one: doc_id, start, end, and the document and start of the one that is kept."""
    return repeated_units(docs, **options).select("doc_id", "start", "end", "first_doc_id", "first_start").distinct()
