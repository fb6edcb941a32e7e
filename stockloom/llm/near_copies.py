"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint's 64 bits are dealt to partitions, correlated bits together. Each fingerprint spreads `distance` + 1 errors over the
partitions (none: the partition is skipped; e: values of up to e - 1 differing bits are probed) so that the estimated candidates
and probes are fewest, by dynamic programming over counts of all fingerprints. If two fingerprints differed in each partition by as
many bits as were dealt to it, they would differ in more than `distance`; so every pair within it is probed, and then verified.

Texts without words (null, empty) have fingerprint zero, linked like any other. Equal fingerprints are searched once. Rows without id
take part; a component's id is its smallest known id.
Repeated rows have one fingerprint and so one component. Long texts are read whole, an empty table gives no rows, and other columns stay as they are,
whatever their names.
"""

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from stockloom.llm.components import stars
from stockloom.llm.wording import LOWER, as_bytes, packed, spaced_words, text_hash
from stockloom.session import shared_folder

SEED = 42
CHUNK = 16
STEP = 1 << 16


def fingerprint(text, size):
    """Signed 64 bits: those set in more than half of the hashes of the text's shingles of `size` words."""
    words = spaced_words(text, LOWER)
    if not words:
        return 0
    size = min(size, len(words))
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, n: a + 1 + n))
    starts = [0, *(e + 1 for e in ends[: len(ends) - size])]
    ends = ends[size - 1 :]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(ends), STEP):
        hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[at : at + STEP], ends[at : at + STEP])], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(ends), bitorder="little").view("<i8")[0])


def fingerprints(size):
    """Column function text -> fingerprint."""

    def of(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t, size) for t in as_bytes(texts)], pa.int64())

    return F.arrow_udf(of, "long").asNondeterministic()


def _bits(prints):
    return np.unpackbits(prints.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_pairs(prints):
    """64 x 64 counts of fingerprints that have both bits, summed over all of them."""

    def count(batches):
        total = np.zeros((64, 64))
        for batch in batches:
            bits = _bits(batch.column(0).to_numpy()).astype(np.float64)
            total += bits.T @ bits
        i, j = np.divmod(np.arange(4096), 64)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel().astype(np.int64))], names=["i", "j", "n"])

    rows = prints.mapInArrow(count, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    out = np.zeros((64, 64))
    for row in rows:
        out[row["i"], row["j"]] = row["n"]
    return out


def correlated_groups(pairs, n, widths):
    """Lists of bits of these widths: each starts with the closest pair left and takes the bit closest to it, again and again."""
    share = np.diag(pairs) / max(n, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    close = np.abs(pairs / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread)
    left, groups = list(range(64)), []
    for width in widths:
        group = list(max(combinations(left, 2), key=lambda p: close[p])) if len(left) > 1 else left[:]
        rest = [b for b in left if b not in group]
        while len(group) < width:
            nearest = max(rest, key=lambda b: close[b, group].sum())
            group.append(nearest)
            rest.remove(nearest)
        groups.append(group)
        left = rest
    return groups


def widths_for(n, distance):
    """Partition widths with the fewest probes and candidates for n evenly spread fingerprints."""

    def cost(m):
        total = 0
        for k in range(m):
            width, errors = 64 // m + (k < 64 % m), (distance + 1) // m + (k < (distance + 1) % m)
            probes = sum(_choose(width, e) for e in range(errors))
            total += probes * (1 + n / 2**width)
        return total

    m = min(range(2, 8), key=cost)
    return [64 // m + (k < 64 % m) for k in range(m)]


def _choose(n, k):
    out = 1
    for i in range(k):
        out = out * (n - i) // (i + 1)
    return out


def _value(prints, bits):
    """The bits' value, lowest first."""
    out = np.zeros(len(prints), np.int64)
    for k, bit in enumerate(bits):
        out |= ((prints >> bit) & 1) << k
    return out


def _chunks(group):
    """A partition's bits, cut into equal parts of at most 16."""
    parts = -(-len(group) // CHUNK)
    return [group[len(group) * k // parts : len(group) * (k + 1) // parts] for k in range(parts)]


def chunk_counts(prints, groups):
    """Per chunk of each partition: how many fingerprints have each value. At most 65,536 numbers a chunk, 64 bits in all."""
    chunks = [c for g in groups for c in _chunks(g)]

    def count(batches):
        totals = [np.zeros(1 << len(c), np.int64) for c in chunks]
        for batch in batches:
            values = batch.column(0).to_numpy()
            for total, bits in zip(totals, chunks):
                total += np.bincount(_value(values, bits), minlength=len(total))
        for k, total in enumerate(totals):
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(at), pa.array(total[at])], names=["k", "v", "n"])

    rows = prints.mapInArrow(count, "k long, v long, n long").groupBy("k", "v").agg(F.sum("n").alias("n")).toArrow()
    out = [np.zeros(1 << len(c)) for c in chunks]
    k, v, n = (rows.column(i).to_numpy() for i in range(3))
    for i, total in enumerate(out):
        total[v[k == i]] = n[k == i]
    return out


def by_distance(counts, most):
    """counts of values -> (most + 1) x values: fingerprints at exactly that many differing bits."""
    width = int(np.log2(len(counts)))
    near = np.zeros((most + 1, len(counts)))
    near[0] = counts
    for k in range(width):
        other = near[:, np.arange(len(counts)) ^ (1 << k)]
        near[1:] += other[:-1]
    return near


def allotments(prints, groups, near, n, distance):
    """Per fingerprint and partition: errors + 1 that it is dealt, `distance` + 1 in all, with the fewest estimated candidates and probes."""
    costs, at = [], 0
    for group in groups:
        exact = None
        for chunk in _chunks(group):
            here = near[at][:, _value(prints, chunk)]
            at += 1
            if exact is None:
                exact = here
            else:  # parts taken as independent
                exact = np.stack([sum(exact[i] * here[d - i] for i in range(d + 1)) for d in range(distance + 1)]) / max(n, 1)
        probes = np.cumsum([_choose(len(group), e) for e in range(distance + 1)])
        costs.append(np.vstack([np.zeros(len(prints)), np.cumsum(exact, axis=0) + probes[:, None]]))
    best = costs[0]
    picks = []
    for cost in costs[1:]:
        options = np.stack([np.stack([best[total - e] + cost[e] if e <= total else np.full(len(prints), np.inf) for e in range(distance + 2)]) for total in range(distance + 2)])
        picks.append(options.argmin(axis=1))
        best = options.min(axis=1)
    left, out = np.full(len(prints), distance + 1), []
    rows = np.arange(len(prints))
    for pick in reversed(picks):
        take = pick[left, rows]
        out.append(take)
        left = left - take
    return [left, *reversed(out)]


def _keys(part, values):
    return (np.int64(part) << 40) | values


def close_pairs(prints, distance):
    """(a, b) with a < b: all pairs of the distinct fingerprints in column fp that differ in at most `distance` bits."""
    spark = prints.sparkSession
    n = prints.count()
    groups = correlated_groups(bit_pairs(prints), n, widths_for(n, distance))
    near = [by_distance(c, distance) for c in chunk_counts(prints, groups)]
    model = spark.sparkContext.broadcast(near)  # at most 4 x 65,536 x (distance + 1) numbers, whatever n is

    def index(batches):
        for batch in batches:
            values = batch.column(0).to_numpy()
            for part, bits in enumerate(groups):
                yield pa.RecordBatch.from_arrays([pa.array(_keys(part, _value(values, bits))), pa.array(values)], names=["key", "b"])

    def probe(batches):
        for batch in batches:
            values = batch.column(0).to_numpy()
            for part, (bits, errors) in enumerate(zip(groups, allotments(values, groups, model.value, n, distance))):
                for flips in range(distance + 1):
                    chosen = values[errors > flips]
                    base = _value(chosen, bits)
                    for places in combinations(range(len(bits)), flips) if len(chosen) else ():
                        keys = _keys(part, base ^ sum(1 << p for p in places))
                        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(chosen)], names=["key", "a"])

    probes, known = prints.mapInArrow(probe, "key long, a long"), prints.mapInArrow(index, "key long, b long")
    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    return probes.join(known, (probes["key"] == known["key"]) & close).select("a", "b").distinct()


def near_groups(docs, size=3, distance=3, doc_id="doc_id", text="text"):
    """One row per row of docs: doc_id, text_hash (xxhash64 of the text), fp, root (the component's smallest fingerprint)."""
    shared_folder(docs.sparkSession)
    marked = docs.select(F.col(doc_id).alias("doc_id"), text_hash(text).alias("text_hash"), fingerprints(size)(text).alias("fp")).checkpoint()
    prints = marked.select("fp").distinct().checkpoint()
    roots = stars(close_pairs(prints, distance)).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    # Written, so that the join has two plain sides and adaptive execution can split a fingerprint that very many texts have.
    labels = prints.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")).checkpoint()
    return marked.join(labels, "fp").select("doc_id", "text_hash", "fp", "root")


def report(docs, **options):
    """doc_id, fingerprint as 16 hex digits, component_id: the smallest doc_id that can be reached over links."""
    marked = near_groups(docs, **options)
    least = marked.groupBy("root").agg(F.min("doc_id").alias("component_id")).checkpoint()
    return marked.join(least, "root").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs, doc_id="doc_id", text="text", **options):
    """The row with the smallest id of each component (of equal ids the least text hash; of equal rows any one), columns unchanged."""
    marked = near_groups(docs, doc_id=doc_id, text=text, **options)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")).alias("first")
    kept = marked.groupBy("root").agg(first).select("first.doc_id", "first.text_hash")
    keys = {"unnamed": F.col("doc_id").isNull(), "name": F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_hash": F.col("text_hash")}
    rows = packed(docs, doc_id=doc_id, text_hash=text_hash(text)).select("row", *[c.alias(n) for n, c in keys.items()])
    kept = kept.select(*[c.alias(n) for n, c in keys.items()])
    return rows.join(kept, list(keys), "left_semi").groupBy(*keys).agg(F.first("row").alias("row")).select("row.*")
