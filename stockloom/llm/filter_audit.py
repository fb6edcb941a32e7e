"""How five filters on texts interact, in every order of applying them.

A document fails A with under 50 words, B if under 65 % of its words are different, C if over 5 % of its code points are A-Z, D if it
holds one of #$%&*|, and E if its text is that of any document with a smaller id. A to D are read off each text. E is an existential
self-join: documents whose text hash occurs under several ids are joined, left-semi, with the least id of each of their texts, on hash,
exact text and a smaller id. The join's ids are put together with the ids that fail another filter, and counted by the combination of
filters that they fail. All orders follow from the counts of these at most 31 combinations per part.

Parts are the values of the source column, a null being the empty one. Null texts are empty texts: they fail A and can be copies of each
other. A null id is neither smaller than another nor has it a smaller one. Repeated rows are documents of their own, and no copies of one
another. A document counts as good or toxic if any label row of its id says so; null ids have no label. An empty table has no parts.
Texts of any length are read whole. Other columns of the tables play no part, whatever their names.
"""

from itertools import permutations

from pyspark.sql import functions as F

from stockloom.llm import spots
from stockloom.session import shared_folder

LETTERS = "ABCDE"
BIT = {letter: 1 << k for k, letter in enumerate(LETTERS)}
WORD = r"[^\x20\x09-\x0D]+"
#: A: least words. B: least share of different words. C: most share of capitals, in percent. D: signs.
LEAST_WORDS, LEAST_DIFFERENT, MOST_CAPITALS, SIGNS = 50, 65, 5, "[#$%&*|]"


def failed_alone(text):
    """Bits of A to D that a text fails."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = {
        "A": F.size(words) < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < LEAST_DIFFERENT * F.size(words),
        "C": 100 * capitals > MOST_CAPITALS * F.length(text),
        "D": text.rlike(SIGNS),
    }
    return sum((F.when(c, BIT[letter]).otherwise(0) for letter, c in fails.items()), F.lit(0))


def _rows(docs, doc_id, text, part):
    whole = F.coalesce(F.col(text), F.lit(""))
    named = F.coalesce(F.col(part).cast("string"), F.lit(""))
    return docs.select(F.col(doc_id).alias("doc_id"), named.alias("part"), whole.alias("text"), F.xxhash64(whole).alias("hash"))


def later_copies(rows, hashes):
    """The rows (doc_id, part, text, hash) whose text a smaller id has too. hashes: column hash, at least all that such texts have."""
    spark = rows.sparkSession
    often = rows.where(spots.passes(spark, spots.marked(hashes, "hash"))("hash"))
    firsts = often.groupBy("hash", "text").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    # Written, so that the join has two plain sides and adaptive execution can split a text that very many documents have.
    firsts = firsts.select(F.col("hash").alias("first_hash"), F.col("text").alias("first_text"), "least").checkpoint()
    same = (F.col("hash") == F.col("first_hash")) & (F.col("text") == F.col("first_text")) & (F.col("least") < F.col("doc_id"))
    return often.join(firsts, same, "left_semi")


def combinations(docs, labels, doc_id="doc_id", text="text", part="source"):
    """One row per part: part, documents (all of them), and `failed`: an array of (bits, n, good, toxic) for the combinations met."""
    shared_folder(docs.sparkSession)
    rows = _rows(docs, doc_id, text, part)
    marks = rows.select("doc_id", "part", "hash", failed_alone(F.col("text")).alias("bits")).checkpoint()
    several = marks.groupBy("hash").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("hash")
    copies = later_copies(rows, several).select("doc_id", "part", "hash", F.lit(BIT["E"]).alias("bits"), F.lit(0).alias("alone"), F.lit(1).alias("copied"))
    failed = marks.where("bits > 0").withColumns({"alone": F.lit(1), "copied": F.lit(0)}).union(copies)
    # Repeated rows fail alike: either half counts them all.
    by_id = failed.groupBy("doc_id", "part", "hash").agg(F.bit_or("bits").alias("bits"), F.greatest(F.sum("alone"), F.sum("copied")).alias("n"))
    named = labels.select(F.col(doc_id).alias("doc_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    named = named.groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic")).where("good or toxic").checkpoint()
    sums = [F.sum("n").alias("n"), *[F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")]]
    counts = by_id.join(named, "doc_id", "left").groupBy("part", "bits").agg(*sums)
    counts = counts.groupBy("part").agg(F.collect_list(F.struct("bits", "n", "good", "toxic")).alias("failed"))
    none = F.expr("cast(array() as array<struct<bits:int,n:bigint,good:bigint,toxic:bigint>>)")
    totals = marks.groupBy("part").agg(F.count("*").alias("documents"))
    return totals.join(counts, "part", "left").withColumn("failed", F.coalesce("failed", none))


def _added(what, condition):
    """Sum of a field over the combinations that meet the condition."""
    return F.aggregate("failed", F.lit(0).cast("long"), lambda total, c: total + F.when(condition(c["bits"]), c[what]).otherwise(0))


def audit(docs, labels, **options):
    """One row per part, order of the filters and step."""
    orders = F.explode(F.array(*[F.lit("".join(p)) for p in permutations(LETTERS)]))
    steps = combinations(docs, labels, **options).select("*", orders.alias("filter_order"))
    steps = steps.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))).alias("step"))
    letter = F.col("filter_order").substr(F.col("step"), F.lit(1))
    position = F.create_map(*[F.lit(x) for pair in BIT.items() for x in pair])
    bit = position[letter]
    before = F.aggregate(F.sequence(F.lit(1), F.col("step")), F.lit(0), lambda total, k: total + position[F.col("filter_order").substr(k, F.lit(1))]) - bit
    steps = steps.select("*", bit.alias("bit"), before.alias("before"))
    fails = lambda b: b.bitwiseAND(F.col("bit")) > 0
    gone = lambda b: b.bitwiseAND(F.col("before")) > 0
    # Of a document's failed filters each comes first in as many of all orders.
    first_in = F.aggregate(
        "failed", F.lit(0).cast("long"), lambda total, c: total + F.when(fails(c["bits"]), c["n"] * (F.lit(120) / F.bit_count(c["bits"])).cast("long")).otherwise(0)
    )
    return steps.select(
        "part",
        "filter_order",
        "step",
        (F.col("documents") - _added("n", lambda b: fails(b) | gone(b))).alias("kept"),
        _added("n", lambda b: fails(b) & ~gone(b)).alias("removed"),
        _added("n", lambda b: fails(b) & gone(b)).alias("redundant"),
        _added("n", lambda b: b == F.col("bit")).alias("unique_fails"),
        _added("good", lambda b: fails(b) & ~gone(b)).alias("good_lost"),
        _added("toxic", lambda b: fails(b) & ~gone(b)).alias("toxic_lost"),
        first_in.alias("shapley"),
    )
