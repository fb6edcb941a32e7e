"""Jaccard join of word-shingle sets by T-occurrence search with DivideSkip.

A text's set are its different shingles of `size` words, told apart by 64 bits; equal sets are one from then on. Two sets link if
100 * intersection >= `least` * union. A set of n has its partners among those that are on T = ceil(least * n / 100) of its n inverted
lists at least. DivideSkip merges the short lists with a heap, keeps what is on T - L of them, and looks for these in the L longest lists
by binary search, until the overlap that both sizes ask for is reached or out of reach.

The lists are cut by documents, into shards. All sets order their shingles alike, those of the longest lists last. If each takes its first
n - T + 1 + EXTRA * n / 100 ones, sets that link have more than EXTRA * T / 100 of these in common. Sets that share fewer with all others
together have no partner. The others live in the shard of their most shared one, with about SHARD sets each at most, so likely partners
live together; the shards of one shingle are a home. First each shard is searched for its own sets and for one anchor of its home, which
joins the shards that a large group is cut into. Then a set visits the shards of homes that hold enough of its first shingles, where
they have a set of another component. Shards write a link only between sets not yet joined: what comes out are the components of all
links, with fewer links than sets and visits, however many pairs a group has.

Words stand between ASCII white space, A-Z lower-cased. A text with fewer words than `size` has all of them as its one shingle; without
words (null, empty) its set is empty and links with nothing, its component is its own id. Repeated rows have equal sets. A component's
id is its smallest known id, null if it has none. Long texts are read whole. An empty table gives no rows. Other columns play no
part, whatever their names.
"""

import heapq
import math
from bisect import bisect_left
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import functions as F

from stockloom.llm import spots
from stockloom.llm.components import stars
from stockloom.llm.wording import LOWER, as_bytes, spaced_words
from stockloom.session import shared_folder

SIZE, LEAST = 4, 85
#: Most shingles that are known to have long lists, and how often a task must see one before it reports it. They only set the order.
LONG_LISTS, OFTEN = 1 << 16, 4
#: First shingles beyond the n - T + 1 that any partner shares one of, in percent of n.
EXTRA = 5
#: Sets of a shard, visitors of a shard that are searched for together, and sets of the shards that one group holds.
SHARD, VISITORS, PACK = 256, 1024, 512
#: Weight of a list's length against the number of lists when they are divided.
MU = 0.0085


class Shingles:
    """text -> sorted 64-bit shingles (numpy, unsigned). Words are hashed once for each batch."""

    def __init__(self, size):
        self.size, self.known = size, {}

    def __call__(self, text):
        words = spaced_words(text, LOWER)
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        size = min(self.size, len(words))
        out = np.full(len(words) - size + 1, size, np.uint64)
        for k in range(size):
            out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + len(out)]
            out ^= out >> np.uint64(32)
            out *= np.uint64(0xD6E8FEB86659FD93)
            out ^= out >> np.uint64(29)
        return np.unique(out)


def set_key(shingles):
    """Signed 64 bits for a set."""
    return int.from_bytes(xxhash.xxh3_64_digest(shingles.tobytes()), "little", signed=True)


def threshold(n, least):
    """Overlap that any partner of a set of n has at least."""
    return -(-least * n // 100)


def needed(n, m, least):
    """Overlap at which sets of n and m link."""
    return -(-least * (n + m) // (100 + least))


def long_lists(texts, size):
    """Sorted shingles of the longest lists, and how often each was seen. At most LONG_LISTS, whatever the number of texts."""

    def count(batches):
        for batch in batches:
            of, seen = Shingles(size), {}
            for text in as_bytes(batch.column(0)):
                shingles = of(text)
                seen[set_key(shingles)] = shingles
            every, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *seen.values()]), return_counts=True)
            often = times >= OFTEN
            yield pa.RecordBatch.from_arrays([pa.array(every[often].view(np.int64)), pa.array(times[often])], names=["shingle", "n"])

    counts = texts.mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).checkpoint()
    powers = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).agg(F.count("*").alias("lists")).collect()
    bar, held = 64, 0
    for row in sorted(powers, key=lambda r: -r["power"]):
        held += row["lists"]
        if held > LONG_LISTS:
            break
        bar = row["power"]
    table = counts.where(F.floor(F.log2("n")) >= bar).toArrow()
    shingles, n = (table.column(c).to_numpy() for c in ("shingle", "n"))
    order = np.argsort(shingles.view(np.uint64))
    return shingles.view(np.uint64)[order], n[order]


def first_shingles(shingles, long, least):
    """The first ones of a set in the common order: those of long lists last, by length, the others by their bits."""
    length = np.zeros(len(shingles), np.int64)
    if len(long[0]):
        at = np.minimum(np.searchsorted(long[0], shingles), len(long[0]) - 1)
        length = np.where(long[0][at] == shingles, long[1][at], 0)
    n = len(shingles)
    return shingles[np.lexsort((shingles, length))][: n - threshold(n, least) + 1 + EXTRA * n // 100]


def fewest_shared(n, least):
    """First shingles that a set of n (a column) has in common with any partner, less one."""
    return F.floor(EXTRA * F.ceil(least * n / 100) / 100)


def marked_sets(docs, size, least, doc_id="doc_id", text="text"):
    """doc_id, n_shingles, set (null: empty) and first (the first shingles; none where the batch has had the set) of all rows."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(long_lists(rows.select("text"), size))

    def mark(batches):
        for batch in batches:
            of, sizes, keys, first, seen = Shingles(size), [], [], [], {None}
            for text in as_bytes(batch.column("text")):
                shingles = of(text)
                sizes.append(len(shingles))
                keys.append(set_key(shingles) if len(shingles) else None)
                first.append(np.zeros(0, np.int64) if keys[-1] in seen else first_shingles(shingles, shared.value, least).view(np.int64))
                seen.add(keys[-1])
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.array(first, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "set", "first"])

    return rows.mapInArrow(mark, f"doc_id {kind}, n_shingles long, set long, first array<long>")


def live_postings(marks):
    """set, n, shingle, sets: the first shingles that several sets have among theirs, and how many have."""
    # Copies count as several here, so that sets need not be brought together first; the second count is of sets.
    rough = marks.select(F.explode("first").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("rows")).where("rows > 1")
    shared = marks.sparkSession.sparkContext.broadcast(spots.marked(rough, "shingle"))

    def emit(batches):
        for batch in batches:
            first = batch.column("first")
            at, values = pc.list_parent_indices(first).to_numpy(), pc.list_flatten(first).to_numpy()
            kept = spots.set_in(shared.value, values)
            at = pa.array(at[kept])
            yield pa.RecordBatch.from_arrays([batch.column("set").take(at), batch.column("n").take(at), pa.array(values[kept])], names=["set", "n", "shingle"])

    sets = marks.select("set", F.col("n_shingles").alias("n"), "first").where("set is not null")
    found = sets.mapInArrow(emit, "set long, n long, shingle long").distinct().checkpoint()
    lists = found.groupBy("shingle").agg(F.count("*").alias("sets")).where("sets > 1").checkpoint()
    return found.join(lists, "shingle")


def homes(live, least):
    """set, n, home (its most shared first shingle), shard, of the sets that share enough to have a partner."""
    most = F.max(F.struct("sets", "shingle")).alias("most")
    out = live.groupBy("set", "n").agg(F.count("*").alias("shared"), most).where(F.col("shared") > fewest_shared(F.col("n"), least))
    out = out.select("set", "n", F.col("most.shingle").alias("home"), F.col("most.sets").alias("sets"))
    part = F.pmod(F.xxhash64("set"), F.ceil(F.col("sets") / SHARD))
    return out.select("set", "n", "home", F.xxhash64("home", part).alias("shard"))


def bodies(docs, places, size, text="text"):
    """set, shard, shingles (bytes) of the sets that have a home. Texts are read again; those of other sets are passed over."""
    shared = docs.sparkSession.sparkContext.broadcast(spots.marked(places, "set"))

    def read(batches):
        for batch in batches:
            of, held = Shingles(size), {}
            for text in as_bytes(batch.column(0)):
                shingles = of(text)
                held[set_key(shingles)] = shingles
            keys = np.fromiter(held, np.int64, len(held))
            kept = spots.set_in(shared.value, keys)
            values = [s.tobytes() for s, k in zip(held.values(), kept) if k]
            yield pa.RecordBatch.from_arrays([pa.array(keys[kept]), pa.array(values, pa.binary())], names=["set", "shingles"])

    found = docs.select(F.col(text).alias("text")).mapInArrow(read, "set long, shingles binary").dropDuplicates(["set"])
    return found.join(places.select("set", "shard"), "set")


class Joined:
    """Union-find over labels."""

    def __init__(self):
        self.above = {}

    def root(self, x):
        above = self.above
        while (up := above.get(x, x)) != x:
            above[x] = x = above.get(up, up)
        return x

    def join(self, x, y):
        self.above[self.root(x)] = self.root(y)


class Lists:
    """Inverted lists of some sets, by their numbers."""

    def __init__(self, sets):
        self.sizes = [len(s) for s in sets]
        every = np.concatenate([np.zeros(0, np.uint64), *sets])
        order = np.argsort(every, kind="stable")
        self.numbers = np.repeat(np.arange(len(sets)), self.sizes)[order].tolist()
        self.shingles, starts = np.unique(every[order], return_index=True)
        self.bounds = np.r_[starts, len(every)]

    def partners(self, shingles, least, below=None, skip=lambda number: False):
        """Numbers of the sets (under `below`) that link with this one. skip: those that need not be found, asked as late as possible."""
        if not len(self.shingles):
            return
        n = len(shingles)
        at = np.minimum(np.searchsorted(self.shingles, shingles), len(self.shingles) - 1)
        at = at[self.shingles[at] == shingles]
        t = threshold(n, least)
        if len(at) < t:
            return
        starts, ends = self.bounds[at], self.bounds[at + 1]
        order = np.argsort(ends - starts, kind="stable")
        spans = list(zip(starts[order].tolist(), ends[order].tolist()))
        longest = spans[-1][1] - spans[-1][0]
        far = min(t - 1, int(t / (MU * math.log2(longest) + 1)))
        numbers = self.numbers
        stop = len(self.sizes) if below is None else below
        short = (numbers[a : bisect_left(numbers, stop, a, b)] for a, b in spans[: len(spans) - far])
        long = spans[len(spans) - far :]
        for number, run in groupby(heapq.merge(*short)):
            found = sum(1 for _ in run)
            if found < t - far or skip(number):
                continue
            wanted = needed(n, self.sizes[number], least)
            left = far
            for a, b in long:
                if found >= wanted or found + left < wanted:
                    break
                k = bisect_left(numbers, number, a, b)
                found += k < b and numbers[k] == number
                left -= 1
            if found >= wanted:
                yield number


def _searched(least):
    """Shards with their visitors -> links between sets not yet joined."""

    def search(table):
        links = []
        shard, part, visits, keys, labels = (table.column(c).to_pylist() for c in ("shard", "part", "visits", "set", "label"))
        shingles = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
        rows = sorted(range(len(keys)), key=lambda k: (shard[k], part[k], visits[k], len(shingles[k]), keys[k]))
        for (_, piece), group in groupby(rows, key=lambda k: (shard[k], part[k])):
            group = list(group)
            own = [k for k in group if not visits[k]]
            lists, joined = Lists([shingles[k] for k in own]), Joined()
            for at, k in enumerate(group):
                if not visits[k] and piece:
                    continue  # a shard's own sets are searched for in its first part
                same = lambda number: joined.root(labels[own[number]]) == joined.root(labels[k])  # noqa: E731, B023
                for number in lists.partners(shingles[k], least, None if visits[k] else at, same):
                    if not same(number):
                        joined.join(labels[own[number]], labels[k])
                        links.append((keys[k], keys[own[number]]))
        a, b = zip(*links) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return search


def searched(whole, visits, least, own):
    """(a, b) links found in the shards. whole: set, shard, label, shingles; visits: set, shard. own: also among the shard's own sets."""
    counts = visits.groupBy("shard").agg(F.ceil(F.count("*") / VISITORS).alias("parts")).checkpoint()
    if own:
        held = whole.join(counts, "shard", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    else:
        held = whole.join(counts, "shard")
    # Parts of a shard's visitors are numbered from 1 where its own sets are not searched for.
    first = F.lit(0 if own else 1)
    held = held.select("shard", F.explode(F.sequence(first, F.col("parts") - 1 + first)).alias("part"), F.lit(False).alias("visits"), "set", "label", "shingles")
    guests = visits.join(counts, "shard").select("set", "shard", (F.pmod(F.xxhash64("set"), F.col("parts")) + first).alias("part"))
    guests = guests.join(whole.select("set", "label", "shingles"), "set").select("shard", "part", F.lit(True).alias("visits"), "set", "label", "shingles")
    packs = -(-whole.count() // PACK) or 1
    grouped = held.union(guests).groupBy(F.pmod(F.xxhash64("shard", "part"), F.lit(packs)).alias("pack"))
    return grouped.applyInArrow(_searched(least), "a long, b long")


def visiting(held, labels, least):
    """set, shard: the sets that go to the shards of other homes, or to others of their own, since a partner of another label may be there.
    Of two sets that may link one goes. held: shingle, set, n, home, shard, label; labels: the same without shingles."""
    two = lambda c: [F.min(c).alias(f"low_{c}"), F.max(c).alias(f"high_{c}")]
    other = (F.col("low_label") != F.col("label")) | (F.col("high_label") != F.col("label"))
    fits = (100 * F.col("high_n") >= least * F.col("n")) & (least * F.col("low_n") <= 100 * F.col("n"))
    there = held.groupBy("shingle", F.col("home").alias("there")).agg(*two("label"), *two("n")).checkpoint()
    go = held.join(there, "shingle").where((F.col("there") <= F.col("home")) & fits & other)
    go = go.groupBy("set", "n", "home", "shard", "label", "there").agg(F.count("*").alias("shared"))
    go = go.where(F.col("shared") > fewest_shared(F.col("n"), least)).drop("shared").checkpoint()
    shards = labels.groupBy(F.col("home").alias("there"), F.col("shard").alias("to")).agg(*two("label"), *two("n")).checkpoint()
    before = (F.col("there") < F.col("home")) | (F.col("to") < F.col("shard"))
    return go.join(shards, "there").where(before & fits & other).select("set", F.col("to").alias("shard"))


def roots(docs, marks, size, least, text="text"):
    """(u, v) for every set u that is joined with a smaller one: v is the smallest set of its component."""
    live = live_postings(marks).checkpoint()
    places = homes(live, least).checkpoint()
    whole = bodies(docs, places, size, text).checkpoint()
    # The anchor of a home visits all of its shards but its own.
    anchors = places.groupBy("home").agg(F.min(F.struct("set", "shard")).alias("anchor"), F.min("shard").alias("low"), F.max("shard").alias("high"))
    anchors = anchors.where("low < high").select("home", "anchor")
    visits = places.select("home", "shard").distinct().join(anchors, "home").where("shard <> anchor.shard").select(F.col("anchor.set").alias("set"), "shard")
    links = searched(whole.withColumn("label", F.col("set")), visits.checkpoint(), least, own=True).checkpoint()
    near = stars(links)
    labels = places.join(near.select(F.col("u").alias("set"), F.col("v").alias("label")), "set", "left")
    labels = labels.select("set", "n", "home", "shard", F.coalesce("label", "set").alias("label")).checkpoint()
    visits = visiting(live.select("set", "shingle").join(labels, "set").checkpoint(), labels, least).checkpoint()
    more = searched(whole.join(labels.select("set", "label"), "set"), visits, least, own=False)
    return stars(links.union(more))


def report(docs, size=SIZE, least=LEAST, doc_id="doc_id", text="text"):
    """One row per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    shared_folder(docs.sparkSession)
    marks = marked_sets(docs, size, least, doc_id, text).checkpoint()
    joined = roots(docs, marks, size, least, text).select(F.col("u").alias("set"), F.col("v").alias("root"))
    ids = marks.where("set is not null").groupBy("set").agg(F.min("doc_id").alias("least")).join(joined, "set", "left")
    ids = ids.select("set", F.coalesce("root", "set").alias("root"), "least").checkpoint()
    component = ids.groupBy("root").agg(F.min("least").alias("component_id")).checkpoint()
    # Written, so that the join has two plain sides and adaptive execution can split a set that very many documents have.
    component = ids.join(component, "root").select("set", "component_id").checkpoint()
    named = marks.where("set is not null").join(component, "set").select("doc_id", "n_shingles", "component_id")
    return named.union(marks.where("set is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
