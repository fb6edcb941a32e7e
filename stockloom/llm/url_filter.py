"""URL filter: rules first, then naive Bayes over words that run together in hosts and paths.

Runs of letters in host and path are split into words by unigram Viterbi: the split of least cost, where a known word costs the
logarithm of the corpus size over its count, and an unknown stretch ten to the power of its length as much. Ties go to the known word,
then to the longer one. Words of the corpus are known up to `longest` letters. Multinomial naive Bayes with add-one smoothing, fitted on all
labelled addresses, scores the words. It never sees the words that the labels were made from, so it learns from the words beside them.

Null addresses and those without :// have empty host and path. Addresses without words, and all if labels of one kind are missing, are
allowed. Equal addresses are scored once. Letters are a-z and all that is not ASCII.
Repeated rows are judged alike, an empty table gives no rows, and other columns play no part, whatever their names.
"""

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from stockloom.llm.wording import as_bytes
from stockloom.session import shared_folder

LONGEST_WORD = 20
LETTERS = r"([a-z\u0080-\x{10FFFF}]+)"
#: Lower-cases A-Z and turns all that is no letter into spaces.
LETTERS_ONLY = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Different words a task counts before it passes them on.
HELD_WORDS = 200_000


def host_and_path(url):
    """Columns for the part after the first :// up to / ? # (lower-cased A-Z), and what follows up to ? #."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def matching_rule(rules, host, path):
    """Struct (size, rule, verdict) of the longest rule (host, path prefix) that fits, or null. rules: (verdict, "host/path") pairs."""
    fits = []
    for verdict, rule in rules:
        own, slash, prefix = rule.partition("/")
        on_host = (host == own) | host.endswith(f".{own}")
        found = F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        fits.append(F.when(on_host & path.startswith(slash + prefix), found))
    none = F.expr("cast(null as struct<size:int,rule:string,verdict:string>)")
    return F.array_max(F.array(none, *fits))


def word_counts(texts, column, markup=False):
    """word, n over all texts; with `markup`, tags are left out. Each task adds up what it reads."""
    text = F.regexp_replace(column, "<[^>]*>", " ") if markup else F.col(column)

    def count(batches):
        held = Counter()
        for batch in batches:
            for value in as_bytes(batch.column(0)):
                held.update((value or b"").translate(LETTERS_ONLY).split())
                if len(held) > HELD_WORDS:
                    yield table(held)
                    held = Counter()
        yield table(held)

    def table(held):
        return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    return texts.select(text.alias("text")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def split_words(piece, known, total):
    """The words of one run of letters. known: (start, length, count) of the stretches that are words."""
    by_end = {}
    for start, length, n in sorted(known):
        by_end.setdefault(start + length, []).append((start, math.log10(total / n)))
    unknown_cost = math.log10(total) - 1 if total else 0.0
    best, came = [0.0], [None]  # least cost up to here; start of the last word
    inside, inside_from = math.inf, None  # the same for an open unknown stretch
    for end in range(1, len(piece) + 1):
        fresh = best[end - 1] + unknown_cost + 1
        if fresh < inside + 1:
            inside, inside_from = fresh, end - 1
        else:
            inside += 1
        cost, start = math.inf, None
        for at, price in by_end.get(end, ()):
            if best[at] + price < cost:
                cost, start = best[at] + price, at
        if inside < cost:
            cost, start = inside, inside_from
        best.append(cost)
        came.append(start)
    words, end = [], len(piece)
    while end:
        words.append(piece[came[end] : end])
        end = came[end]
    return words[::-1]


def _splitter(total):
    def split(pieces: pa.Array, known: pa.Array) -> pa.Array:
        rows = zip(pieces.to_pylist(), known.to_pylist())
        return pa.array([split_words(p, [(k["start"], k["length"], k["n"]) for k in ks or ()], total) for p, ks in rows], pa.list_(pa.string()))

    return F.arrow_udf(split, "array<string>")


def segmented(pieces, counts, longest=LONGEST_WORD):
    """piece, words for the distinct values of the column `piece`. Only stretches of pieces are looked up, by a join, so the vocabulary
    may be of any size."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    pieces = pieces.select("piece").distinct()
    starts = pieces.select("piece", F.explode(F.sequence(F.lit(1), F.length("piece"))).alias("at"))
    lengths = F.sequence(F.lit(1), F.least(F.lit(longest), F.length("piece") - F.col("at") + 1))
    stretches = starts.select("piece", "at", F.explode(lengths).alias("length")).withColumn("word", F.substring("piece", F.col("at"), F.col("length")))
    found = stretches.join(counts, "word").select("piece", F.struct((F.col("at") - 1).alias("start"), "length", "n").alias("known"))
    known = found.groupBy("piece").agg(F.collect_list("known").alias("known"))
    return pieces.join(known, "piece", "left").select("piece", _splitter(total)("piece", "known").alias("words"))


def bayes_scores(words):
    """host, path, score: logarithm of block over allow. words: host, path, label (true: block, null: not labelled), word."""
    addresses = words.groupBy("label").agg(F.count_distinct("host", "path").alias("n")).where("label is not null").collect()
    addresses = {r["label"]: r["n"] for r in addresses}
    if len(addresses) < 2:
        return words.select("host", "path", F.lit(None).cast("double").alias("score")).distinct()
    # Written, so that the join below has two plain sides and adaptive execution can split a word that very many addresses have.
    counted = words.where("label is not null").groupBy("word").agg(F.count_if("label").alias("bad"), F.count_if(~F.col("label")).alias("good")).checkpoint()
    size = counted.agg(F.count("*"), F.sum("bad"), F.sum("good")).first()
    weight = F.ln((F.col("bad") + 1) / (size[1] + size[0])) - F.ln((F.col("good") + 1) / (size[2] + size[0]))
    unseen = math.log(1 / (size[1] + size[0])) - math.log(1 / (size[2] + size[0]))
    weighed = words.groupBy("host", "path", "word").agg(F.count("*").alias("n")).join(counted.select("word", weight.alias("weight")), "word", "left")
    prior = math.log(addresses[True] / addresses[False])
    return weighed.groupBy("host", "path").agg((F.lit(prior) + F.sum(F.col("n") * F.coalesce("weight", F.lit(unseen)))).alias("score"))


def judged(pages, rules, label, counts, hidden=(), page_id="page_id", url="url", longest=LONGEST_WORD):
    """page_id, host, path, rule, verdict, score. label: function of the columns host and path, true for block, false for allow, or null;
    it marks the addresses that naive Bayes is fitted on. counts: word, n. hidden: words that the label is made from, which are left out."""
    shared_folder(pages.sparkSession)
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    known = rows.where("host <> '' or path <> ''").select("host", "path").distinct()
    runs = F.regexp_extract_all(F.translate(F.concat_ws(" ", "host", "path"), UPPER, LOWER), F.lit(LETTERS), 1)
    pieces = known.select("host", "path", label(F.col("host"), F.col("path")).alias("label"), F.explode(runs).alias("piece"))
    counts = counts.checkpoint()  # read twice: for its sum, and by the join
    words = pieces.join(segmented(pieces, counts, longest), "piece").select("host", "path", "label", F.explode("words").alias("word"))
    words = words.where(~F.col("word").isin(*hidden)).checkpoint()
    found = rows.join(bayes_scores(words), ["host", "path"], "left").withColumn("match", matching_rule(rules, F.col("host"), F.col("path")))
    by_words = F.when(F.col("score") > 0, F.lit("block")).otherwise("allow")
    verdict = F.coalesce("match.verdict", by_words)
    return found.select("page_id", "host", "path", F.col("match.rule").alias("rule"), verdict.alias("verdict"), F.round("score", 6).alias("score"))


def names_any(host, seeds):
    """Whether a host's parts between characters other than a-z have one of these words."""
    return F.arrays_overlap(F.split(host, "[^a-z]+"), F.array(*[F.lit(s) for s in seeds]))
