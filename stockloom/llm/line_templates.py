"""Line dedup by a log-template tree.

A line is parsed by its number of tokens and its first tokens, which lead to a leaf of the tree; tokens with a digit, an @ or a :// are
variable fields from the start. Within a leaf a token stays at its place if enough different lines of the leaf have it there, and is a
variable field otherwise. If enough of the line is fixed, the generalised line is its template; else the line is its own. A template
that stands in enough documents recurs: its lines are dropped, except the first one in the document with the least id.

How many lines are enough depends on the leaf: where fields take the same values again and again, a value is in many lines of a large
leaf. So a line is generalised at several levels, each of which asks STEP times as many lines for a token, up to all of the leaf's. Its
template is that of the first level that recurs: rare templates of a crowded leaf recur at low levels, fields of few values vanish at high ones.

Leaves are counted, not gathered: lines meet as counts per leaf, place and token, so no group has to fit in a task, and the result
does not depend on the order of lines. Documents are told apart by id and text: repeated rows count once and lose the same lines.
Null and empty texts have no lines and stay as they are. A null id comes before all others. Lines of fewer than `least` tokens are
not generalised: such a line is its own template, its variable fields masked only if enough of it stays. No document is dropped.
Long texts are read whole, an empty table gives no rows, and other columns stay as they are, whatever their names.
"""

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from stockloom.llm.wording import as_bytes, packed, text_hash
from stockloom.session import shared_folder

FIELD = "<*>"
VARIABLE = re.compile(rb"[0-9@]|://")
LEAST_TOKENS, DEPTH, SUPPORT, FIXED, MIN_DOCS = 6, 3, 3, 70, 5
#: Bits of the map that tells the second reading which leaves to look at; 32,768 to a row of it, 8 MB in all.
SPOTS = 1 << 26
#: Times as many lines as at the level before.
STEP = 2


def parsed(text, least, depth, fixed):
    """(line number, leaf, tokens) of the lines with a token, variable fields masked. A short line has a leaf of its own."""
    for k, line in enumerate(text.split(b"\n")):
        tokens = line.split()
        if not tokens:
            continue
        long = len(tokens) >= least
        if VARIABLE.search(line):
            masked = [b"<*>" if VARIABLE.search(t) else t for t in tokens]
            if long or 100 * (len(masked) - masked.count(b"<*>")) >= fixed * len(masked):
                tokens = masked
        leaf = xxhash.xxh3_64_intdigest(b"%d %s" % (len(tokens), b" ".join(tokens[:depth] if long else tokens)))
        yield k, leaf - (leaf >> 63 << 64), tokens


def occurrences(docs, doc_id="doc_id", text="text", least=LEAST_TOKENS, depth=DEPTH, fixed=FIXED):
    """doc_id, text_hash, line_no, leaf, sig of all lines with a token: digests of the leaf's path and of the masked line."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_hash(text).alias("text_hash"), F.col(text).alias("text")).where("text <> ''")

    def parse(batches):
        for batch in batches:
            at, numbers, leaves, sigs = [], [], [], []
            for k, value in enumerate(as_bytes(batch.column("text"))):
                for number, leaf, tokens in parsed(value, least, depth, fixed):
                    at.append(k)
                    numbers.append(number)
                    leaves.append(leaf)
                    sigs.append(xxhash.xxh3_128_digest(b" ".join(tokens)))
            at = pa.array(at, pa.int64())
            columns = [batch.column("doc_id").take(at), batch.column("text_hash").take(at), pa.array(numbers, pa.int32()), pa.array(leaves, pa.int64()), pa.array(sigs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "line_no", "leaf", "sig"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(parse, f"doc_id {kind}, text_hash long, line_no int, leaf long, sig binary")


def _marked(leaves):
    """Rows of 4,096 bytes of the map of spots; its size does not depend on how many leaves there are."""
    spot = F.pmod("leaf", F.lit(SPOTS)) + 1
    rows = leaves.groupBy(F.bitmap_bucket_number(spot).alias("row")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias("bits")).collect()
    out = np.zeros(SPOTS // 8, np.uint8)
    for r in rows:
        out[(r["row"] - 1) * 4096 : r["row"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def counted(lines):
    """leaf, sig, n: how many lines are alike."""
    return lines.groupBy("leaf", "sig").agg(F.count("*").alias("n"))


def templates(docs, lines, text="text", least=LEAST_TOKENS, depth=DEPTH, support=SUPPORT, fixed=FIXED):
    """sig, level, template, pattern of the lines that are generalised: those whose leaf has enough different lines to fix a token.

    Texts are read again for the lines of such leaves only, so that no other text is shuffled."""
    leaves = counted(lines).groupBy("leaf").agg(F.count("*").alias("sigs")).where(F.col("sigs") >= support).select("leaf").checkpoint()
    marked = docs.sparkSession.sparkContext.broadcast(_marked(leaves))

    def read(batches):
        spots = marked.value
        for batch in batches:
            leaf_of, masked = [], []
            for value in as_bytes(batch.column("text")):
                for _, leaf, tokens in parsed(value, least, depth, fixed):
                    spot = leaf % SPOTS
                    if spots[spot >> 3] >> (spot & 7) & 1:
                        leaf_of.append(leaf)
                        masked.append(b" ".join(tokens))
            sigs = [xxhash.xxh3_128_digest(m) for m in masked]
            yield pa.RecordBatch.from_arrays([pa.array(leaf_of, pa.int64()), pa.array(sigs, pa.binary()), pa.array([m.decode() for m in masked], pa.string())], names=["leaf", "sig", "masked"])

    found = docs.select(F.col(text).alias("text")).where("text <> ''").mapInArrow(read, "leaf long, sig binary, masked string")
    open_lines = found.groupBy("leaf", "sig").agg(F.first("masked").alias("masked")).join(leaves, "leaf", "left_semi")
    places = open_lines.select("leaf", "sig", F.posexplode(F.split("masked", " ")).alias("place", "token"))
    known = places.groupBy("leaf", "place", "token").agg(F.count("*").alias("lines")).where(F.col("lines") >= support)
    cut = places.join(known, ["leaf", "place", "token"], "left").select("leaf", "sig", F.struct("place", "token", "lines").alias("at"))
    whole = cut.groupBy("leaf", "sig").agg(F.array_sort(F.collect_list("at")).alias("at"))
    # A level asks for support * STEP ** level lines; the token that most lines have is variable from the level after `top` on.
    top = F.floor(F.log(F.array_max(F.transform("at", lambda a: a["lines"])) / support) / math.log(STEP) + 1e-9).cast("int")
    cut_at = lambda level: F.transform("at", lambda a: F.when(a["lines"] >= support * F.pow(F.lit(STEP), level), a["token"]).otherwise(F.lit(FIELD)))
    enough = lambda tokens: 100 * F.size(F.filter(tokens, lambda t: t != FIELD)) >= fixed * F.size(tokens)
    levels = F.array_distinct(F.filter(F.transform(F.sequence(F.lit(0), top), cut_at), enough))
    whole = whole.where(top.isNotNull()).select("sig", F.posexplode(levels).alias("level", "tokens"))
    whole = whole.select("sig", "level", F.concat_ws(" ", "tokens").alias("pattern"))
    return whole.withColumn("template", F.unhex(F.md5("pattern")))


def dropped_lines(docs, doc_id="doc_id", text="text", least=LEAST_TOKENS, depth=DEPTH, support=SUPPORT, fixed=FIXED, min_docs=MIN_DOCS):
    """doc_id, text_hash, line_no of the lines to drop, and their template's digest."""
    shared_folder(docs.sparkSession)
    lines = occurrences(docs, doc_id, text, least, depth, fixed).checkpoint()
    found = templates(docs, lines, text, least, depth, support, fixed).select("sig", "level", "template")
    # Of the other lines only those can recur of which there are enough.
    live = counted(lines).where(F.col("n") >= min_docs).select("sig").join(found, "sig", "full")
    live = live.select("sig", F.coalesce("level", F.lit(0)).alias("level"), F.coalesce("template", "sig").alias("template")).checkpoint()
    by_doc = lines.select("doc_id", "text_hash", "sig").join(live, "sig").select("template", "doc_id", "text_hash").distinct()
    often = by_doc.groupBy("template").agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs).select("template")
    chosen = live.join(often, "template").groupBy("sig").agg(F.min_by("template", "level").alias("template")).checkpoint()
    held = lines.select("doc_id", "text_hash", "line_no", "sig").join(chosen, "sig").select("doc_id", "text_hash", "line_no", "template").checkpoint()
    recurring = held.groupBy("template").agg(F.min(F.struct("doc_id", "text_hash", "line_no")).alias("first"))
    # Both written, so that the join has two plain sides and adaptive execution can split a template that very many lines have.
    recurring = recurring.checkpoint()
    same = F.struct("doc_id", "text_hash", "line_no").eqNullSafe(F.col("first"))
    return held.join(recurring, "template").where(~same).select("doc_id", "text_hash", "line_no", "template")


def without_recurring(docs, doc_id="doc_id", text="text", **options):
    """Columns `row` (all columns of docs as they were), `text` (the lines that stay), `lines` and `dropped` (numbers of lines)."""
    gone = dropped_lines(docs, doc_id, text, **options)
    keys = {"unnamed": F.col("doc_id").isNull(), "name": F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_hash": F.col("text_hash")}
    gone = gone.select(*[c.alias(n) for n, c in keys.items()], "line_no").groupBy(*keys).agg(F.collect_set("line_no").alias("gone"))
    rows = packed(docs, doc_id=doc_id, text_hash=text_hash(text), text=text).select("row", "text", *[c.alias(n) for n, c in keys.items()])
    lines = F.split("text", "\n")
    stay = F.array_join(F.filter(lines, lambda line, k: ~F.array_contains("gone", k)), "\n")
    dropped = F.coalesce(F.size("gone"), F.lit(0))
    return rows.join(gone, list(keys), "left").select(
        "row",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(stay).alias("text"),
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(dropped).cast("long").alias("dropped"),
    )


def report(docs, doc_id="doc_id", **options):
    """One row per document: its lines, those dropped, and a digest of the text that stays."""
    cleaned = without_recurring(docs, doc_id, **options)
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    return cleaned.select(F.col(f"row.{doc_id}").alias("doc_id"), "lines", "dropped", digest.alias("text_sha256"))


def cleaned(docs, text="text", length=None, **options):
    """The rows of docs with recurring lines dropped from the text, and the column `length`, if named, set to the new length."""
    done = without_recurring(docs, text=text, **options)
    new = {text: F.col("text")} | ({length: F.length("text").cast(docs.schema[length].dataType)} if length else {})
    return done.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
