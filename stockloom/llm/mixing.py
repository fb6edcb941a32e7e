"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in the order of their ids' hashes, are cut into blocks of equal length. A source with w of the T shares owns
block j (from 1) in a window: released at slot floor((j - 1) T / w), due by slot ceil(j T / w). Every slot goes to the released block
that is due first (then to the first source by name), so at any slot each source is less than one block from its share, until the
first source runs out; its later slots stay empty and nothing is dropped. The plan repeats after T slots, so only T slots are laid out
and a block's slot is found from its number alone.

A null source is a source of its own. Null and empty texts have length zero and share the block of the next text. Repeated rows follow
each other. Sources without a weight get none and are listed last, after all slots, in block order; a weight below one is refused.
Long texts count in whole, an empty table gives no rows, and other columns stay as they are, whatever their names.
"""

import heapq
import math

from pyspark.sql import Window
from pyspark.sql import functions as F

BLOCK_CHARS = 1 << 15
#: Slots of one round of the plan at most; shares are asked for in whole numbers, so this bounds what is sent to the executors.
MOST_SLOTS = 1 << 20


def plan(shares):
    """(source, turn, slot, release, due) for the w blocks each source has in one round of T slots. shares: source -> whole number."""
    if any(w < 1 for w in shares.values()):
        raise ValueError("a share is a whole number from 1")
    total = sum(shares.values())
    if total > MOST_SLOTS:
        raise ValueError(f"the shares add up to {total}; give smaller whole numbers, {MOST_SLOTS} in all")
    names = sorted(shares, key=lambda s: (s is not None, s or ""))

    def window(k, j):
        w = shares[names[k]]
        return (j * total) // w, -(-(j + 1) * total // w)

    waiting = [(0, k, 0) for k in range(len(names))]  # (release, source, turn)
    due, out = [], []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, k, j = heapq.heappop(waiting)
            heapq.heappush(due, (window(k, j)[1], k, j))
        _, k, j = heapq.heappop(due)
        out.append((names[k], j, slot, *window(k, j)))
        if j + 1 < shares[names[k]]:
            heapq.heappush(waiting, (window(k, j + 1)[0], k, j + 1))
    return out


def tempered_shares(docs, parts=100, source="source", text="text"):
    """Whole shares by the square root of each source's length: `parts` for a source that has everything, at least 1 for any."""
    rows = docs.groupBy(F.col(source).alias("source")).agg(F.sum(F.coalesce(F.length(text), F.lit(0))).alias("chars")).collect()
    total = max(1, sum(r["chars"] for r in rows))
    return {r["source"]: max(1, math.floor(parts * math.sqrt(r["chars"] / total) + 0.5)) for r in rows}


def _in_order(docs, doc_id, source, text, keep):
    """source, key, chars, before: the length of all earlier texts of the source.

    Order and sums are by hash prefix first: a source with most of all rows is spread over 4,096 groups."""
    rows = docs.select(
        F.col(source).alias("source"),
        F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).alias("key"),
        F.coalesce(F.length(text), F.lit(0)).cast("long").alias("chars"),
        F.md5(F.coalesce(F.col(text), F.lit(""))).alias("tie"),
        *[c.alias(n) for n, c in keep.items()],
    ).withColumns({"named": F.col("source").isNotNull(), "source": F.coalesce("source", F.lit("")), "part": F.substring("key", 1, 3)})
    group = ["named", "source", "part"]
    parts = rows.groupBy(*group).agg(F.sum("chars").alias("sum"))
    so_far = Window.partitionBy("named", "source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*group, F.coalesce(F.sum("sum").over(so_far), F.lit(0)).alias("start"))
    here = Window.partitionBy(*group).orderBy("key", "tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("chars").over(here), F.lit(0)))
    return rows.join(parts, group).withColumn("before", F.col("start") + F.col("inside"))


def scheduled(docs, shares, keep, block_chars=BLOCK_CHARS, doc_id="doc_id", source="source", text="text"):
    """One row per row of docs: source, block (from 0), slot, release, due, place (characters of the block before the text).

    keep: further columns, name -> expression. slot, release and due are null for sources without a share."""
    spark = docs.sparkSession
    total = sum(shares.values())
    turns = spark.createDataFrame(plan(shares), "source string, turn long, slot long, release long, due long")
    named = {"named": F.col("source").isNotNull(), "source": F.coalesce("source", F.lit(""))}
    shared = spark.createDataFrame(list(shares.items()), "source string, share long").withColumns(named)
    ordered = _in_order(docs, doc_id, source, text, keep).withColumn("block", F.floor(F.col("before") / block_chars))
    # One row per source, then one per turn: MOST_SLOTS at most.
    placed = ordered.join(F.broadcast(shared), ["named", "source"], "left").withColumn("turn", F.col("block") % F.col("share"))
    placed = placed.join(F.broadcast(turns.withColumns(named)), ["named", "source", "turn"], "left")
    past = F.floor(F.col("block") / F.col("share")) * total
    return placed.select(
        *keep,
        F.when(F.col("named"), F.col("source")).alias("source"),
        "block",
        *[(past + F.col(c)).alias(c) for c in ("slot", "release", "due")],
        (F.col("before") % block_chars).alias("place"),
    )


def report(docs, shares, doc_id="doc_id", **options):
    """doc_id, source, block, slot, release, due and place of every document."""
    return scheduled(docs, shares, {"doc_id": F.col(doc_id)}, doc_id=doc_id, **options)


def interleaved(docs, shares, **options):
    """The columns of docs in a struct `row`, then source, block, slot, release, due, place. Reading order is slot, source, place."""
    return scheduled(docs, shares, {"row": F.struct("*")}, **options)
