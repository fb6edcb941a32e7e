"""The list under a key of large JSON documents, cut into its elements by many tasks.

A document is read in blocks of bytes, three times. First each block says how it changes the scanner's state (outside or inside quotes, after
a backslash) and the depth of brackets, for every state that it may start in; a scan over these summaries, one row per block, gives each
block its true start. Then the blocks look for the key among the names of the outermost object, and for the bracket that closes its list.
At last each block cuts the elements that begin in it, and reads on where the last one ends in a later block. No task holds more than a piece of
a block and one element.
"""

import json
import re
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import functions as F

from stockloom.session import fresh_folder, shared_folder

BLOCK, PIECE, BATCH = 64 << 20, 1 << 20, 4 << 20
#: States of the scanner.
OUTSIDE, INSIDE, ESCAPED = 0, 1, 2
OTHER, OPEN, CLOSE, COMMA, QUOTE = range(5)
KINDS = np.zeros(256, np.uint8)
KINDS[[123, 91]], KINDS[[125, 93]], KINDS[44], KINDS[34] = OPEN, CLOSE, COMMA, QUOTE


def opened(uri):
    """A file of any file system that Arrow knows, by the name that Spark gives it."""
    uri = re.sub(r"^file:/(?!/)", "file:///", re.sub(r"^s3[an]://", "s3://", uri))
    system, path = fs.FileSystem.from_uri(quote(uri, safe="/:@"))
    return system.open_input_file(path)


def signs(data, state):
    """Places and kinds of the brackets, commas and closing or opening quotes that are signs and not text, whether a quote there opens a
    text, and the state after the data."""
    codes = np.frombuffer(data, np.uint8)
    escaped = np.zeros(len(codes) + 1, bool)
    escaped[0] = state == ESCAPED
    slashes = np.flatnonzero(codes == 92)
    if len(slashes):
        first = np.r_[True, np.diff(slashes) > 1]
        place = np.arange(len(slashes)) - np.flatnonzero(first)[np.cumsum(first) - 1]
        if escaped[0] and slashes[0] == 0:  # the first one belongs to the piece before
            place[np.cumsum(first) == 1] += 1
        escaped[slashes[place % 2 == 0] + 1] = True
    kinds = KINDS[codes]
    kinds[escaped[:-1]] = OTHER
    at = np.flatnonzero(kinds)
    kinds = kinds[at]
    quotes = kinds == QUOTE
    inside = (np.cumsum(quotes) + (state != OUTSIDE)) % 2 == 1
    sign = quotes | ~inside
    last = bool((quotes.sum() + (state != OUTSIDE)) % 2)
    return at[sign], kinds[sign], inside[sign], (ESCAPED if escaped[-1] else INSIDE) if last else OUTSIDE


def pieces(file, start, end, state, depth, size=PIECE):
    """Pieces of a file from `start` on: offset, data, places, kinds, opening quotes, depth after each sign, state and depth at the end."""
    file.seek(start)
    while start < end:
        data = file.read(min(size, end - start))
        if not data:
            return
        at, kinds, opens, state = signs(data, state)
        depths = depth + np.cumsum((kinds == OPEN).astype(np.int64) - (kinds == CLOSE))
        depth = int(depths[-1]) if len(depths) else depth
        yield start, data, at + start, kinds, opens, depths, state, depth
        start += len(data)


def change(file, start, end, size=PIECE):
    """For each state at the start of a block: state at its end and change of depth."""
    now = {s: (s, 0) for s in (OUTSIDE, INSIDE, ESCAPED)}
    file.seek(start)
    while start < end:
        data = file.read(min(size, end - start))
        after = {}
        for state in {s for s, _ in now.values()}:
            _, kinds, _, last = signs(data, state)
            after[state] = last, int((kinds == OPEN).sum()) - int((kinds == CLOSE).sum())
        now = {s: (after[state][0], depth + after[state][1]) for s, (state, depth) in now.items()}
        start += len(data)
    return now


def is_list_of(file, at, key):
    """Where the list begins if the text that opens at `at` is a name equal to `key` with a list as its value, else None."""
    size = 6 * len(key.encode()) + 2  # at most six bytes stand for one
    while True:
        file.seek(at)
        data = file.read(size + 64)
        text = re.match(rb'"(?:[^"\\]|\\.)*"', data, re.DOTALL)
        if not text or text.end() > 6 * len(key.encode()) + 2 or json.loads(text.group()) != key:
            return None
        value = re.compile(rb"\s*:\s*(\S)").match(data, text.end())
        if value:
            return at + value.end() if value.group(1) == b"[" else None
        if len(data) < size + 64 or data[text.end() :].strip() not in (b"", b":"):
            return None
        size *= 2


def elements(file, start, end, state, depth, first, last):
    """Elements of the list between `first` and `last` that begin in the block from `start` to `end`, as bytes."""
    begin, held = None, bytearray()
    if start <= first < end:
        begin = first
    # Signs are looked at beyond the block for the end of its last element only.
    for offset, data, at, kinds, _, depths, _, _ in pieces(file, start, last, state, depth):
        done = 0
        cut = at[(kinds == COMMA) & (depths == 2) & (at >= first)]
        for place in cut.tolist():
            if begin is not None:
                yield bytes(held + data[max(done, begin - offset) : place - offset])
                held.clear()
            begin = place + 1 if place < end else None
            if begin is None:
                return
            done = place + 1 - offset
        if begin is None:
            if offset + len(data) >= end:
                return
        else:
            held += data[max(done, begin - offset) :]
    if begin is not None:
        yield bytes(held)


def over_blocks(blocks, task, schema):
    """task(file, block) yields tuples of the schema for each block; files stay open while the blocks of one follow each other."""
    fields = [part.split() for part in schema.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    target = pa.schema([(name, kinds[kind]) for name, kind in fields])

    def run(batches):
        path, file = None, None
        for batch in batches:
            for block in batch.to_pylist():
                if block["path"] != path:
                    path, file = block["path"], opened(block["path"])
                rows, size = [], 0
                for row in task(file, block):
                    rows.append(row)
                    size += sum(len(v) for v in row if isinstance(v, bytes))
                    if size > BATCH:
                        yield made(rows)
                        rows, size = [], 0
                if rows:
                    yield made(rows)

    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), target)], schema=target)

    return blocks.mapInArrow(run, schema)


def with_states(blocks):
    """The blocks with state and depth at their starts, from what each changes: a scan over one small row per block."""
    summary = "path string, start long, stop long, state0 int, state1 int, state2 int, depth0 long, depth1 long, depth2 long"

    def summed(file, b):
        now = change(file, b["start"], b["stop"])
        yield (b["path"], b["start"], b["stop"], *[now[s][0] for s in range(3)], *[now[s][1] for s in range(3)])

    def scanned(rows):
        state, depth, out = OUTSIDE, 0, []
        for row in rows.sort_values("start").itertuples():
            out.append((row.path, row.start, row.stop, state, depth))
            state, depth = getattr(row, f"state{state}"), depth + getattr(row, f"depth{state}")
        if state != OUTSIDE or depth != 0:
            raise ValueError(f"{out[0][0]} is no whole JSON document")
        return pd.DataFrame(out, columns=["path", "start", "stop", "state", "depth"])

    changes = over_blocks(blocks, summed, summary)
    return changes.groupBy("path").applyInPandas(scanned, "path string, start long, stop long, state int, depth long")


def lists_found(blocks, key):
    """path, first, last: from the first byte of each list under the key to its closing bracket."""

    def search(file, b):
        begins, closed = [], []
        for _, _, at, kinds, opens, depths, _, _ in pieces(file, b["start"], b["stop"], b["state"], b["depth"]):
            names = at[(kinds == QUOTE) & opens & (depths == 1)]
            closed += at[(kinds == CLOSE) & (depths == 1)].tolist()
            back = file.tell()
            begins += [p for p in (is_list_of(file, n, key) for n in names.tolist()) if p is not None]
            file.seek(back)
        # A list that begins here, or in a later block by its bracket, ends at the first closing bracket behind its start.
        wanted = {min((c for c in closed if c >= p), default=None) for p in begins} | set(closed[:1])
        yield from [(b["path"], p, 1) for p in begins] + [(b["path"], c, 0) for c in wanted if c is not None]

    found = over_blocks(blocks, search, "path string, place long, begins int")
    begins = found.where("begins = 1").select("path", F.col("place").alias("first"))
    ends = found.where("begins = 0").select("path", "place")
    spans = begins.join(ends, "path").where("place >= first")
    return spans.groupBy("path", "first").agg(F.min("place").alias("last"))


def json_list(spark, path, key, block=BLOCK):
    """The elements of the list under a top-level key of each document (one per file) as JSON texts, in a column `value`.

    The lists of a name that a document repeats are all read. Files must not be compressed. A document that is cut off is an error."""
    listed = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    packed = listed.where(F.col("path").rlike(r"\.(gz|bz2|zst|lz4|snappy|deflate)$"))
    if not packed.isEmpty():
        raise ValueError("compressed files cannot be read in blocks: see read_json_rows")
    start = F.explode(F.sequence(F.lit(0), F.col("length") - 1, F.lit(block))).alias("start")
    blocks = listed.select("path", "length", start).select("path", "start", F.least(F.col("start") + block, F.col("length")).alias("stop"))
    # The rows are tiny, so their number and not their size has to say how many tasks there are: one per block, or as many as the session
    # has for a shuffle. A task goes through its blocks one after the other; small blocks of many files would else be more tasks than work.
    number = listed.select(F.sum(F.ceil(F.col("length") / block))).first()[0] or 0
    most = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    tasks = max(1, min(number, most))
    shared_folder(spark)
    states = with_states(blocks.repartition(tasks, "path", "start")).repartition(tasks, "path", "start").checkpoint()
    spans = lists_found(states, key).checkpoint()
    if spans.isEmpty():
        raise ValueError(f"no list under the key '{key}'")
    parts = states.join(spans, "path").where("stop > first and start <= last")

    def cut(file, b):
        for text in elements(file, b["start"], b["stop"], b["state"], b["depth"], b["first"], b["last"]):
            if text.strip():
                yield (text.strip(),)

    cuts = over_blocks(parts.repartition(tasks, "path", "start"), cut, "value binary")
    return cuts.select(F.col("value").cast("string").alias("value"))


def column_type(variant):
    """The type of a column from that of its variants: whole numbers and texts stay, other numbers are doubles, what differs is text."""
    change = {"OBJECT": "STRUCT", "VOID": "STRING", "VARIANT": "STRING"}

    def one(found):
        word = found.group()
        if found["name"]:
            return word
        if word.startswith("DECIMAL"):
            return word if word.endswith(",0)") else "DOUBLE"
        return change.get(word, word)

    return re.sub(r"`(?:``|[^`])*`|DECIMAL\(\d+,\d+\)|(?P<name>\w+)(?=\s*:)|\b(?:OBJECT|VOID|VARIANT)\b", one, variant)


def read_json_list(spark, path, key, block=BLOCK):
    """Rows of the list under a top-level key, with the types that all rows give together. The elements are kept as variants in the
    shared folder, so the documents are not read again for the types. Names are columns; elements that are no objects are an error."""
    folder = fresh_folder(spark, "json-list")
    json_list(spark, path, key, block).select(F.parse_json("value").alias("v")).write.parquet(folder)
    rows = spark.read.parquet(folder)
    found = rows.where("not is_variant_null(v)").agg(F.schema_of_variant_agg("v")).first()[0]
    kind = column_type(found)
    if not kind.startswith("STRUCT"):
        raise ValueError(f"the list under the key '{key}' does not hold objects")
    return rows.select(F.expr(f"cast(v as {kind})").alias("row")).select("row.*")
