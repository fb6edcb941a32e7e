"""Token counts from flat token files without an index.

A file is a run of token ids of one width; each document ends with the end-of-document id. Files are read in blocks, by any task; in
a block all separators are found at once. A prefix scan over the blocks' summaries (number of separators, last one) then gives each
block the number of documents before it and the start of the one that runs into it.

Two separators in a row enclose an empty document; what follows a file's last separator is a document that is not closed. An empty
file has none, and bytes at the end that make no whole token are not counted. Null texts are written as empty documents.
Repeated rows are documents of their own, long texts are encoded whole, and other columns play no part, whatever their names.
"""

import base64

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F

from stockloom.session import fresh_folder

BLOCK_BYTES = 1 << 22
# Fixed values of the public byte-level vocabulary of 50,257 ids: its file, its pattern for pieces of text, its end-of-document id.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END = 50256


def _open(path):
    """File system and path of a URI or a plain path."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pa.fs.FileSystem.from_uri(path)


def encoder(vocabulary=VOCABULARY, pieces=PIECES):
    import tiktoken

    fs, path = _open(vocabulary)
    with fs.open_input_stream(path) as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f.readall().splitlines())}
    return tiktoken.Encoding("flat", pat_str=pieces, mergeable_ranks=ranks, special_tokens={})


def write_tokens(docs, folder, vocabulary=VOCABULARY, end=END, width=2, doc_id="doc_id", text="text"):
    """Writes one flat file per partition of docs into the folder; returns (file, ordinal, doc_id) of all documents, kept in the folder.

    A file appears under its name only when it is whole, so a task that runs again changes nothing."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    fs, root = _open(folder)
    fs.create_dir(f"{root}/flat")
    fs.create_dir(f"{root}/unfinished")

    def write(batches):
        task = TaskContext.get()
        fs, root = _open(folder)  # anew in each task
        encode = encoder(vocabulary).encode_ordinary
        name = f"tokens-{task.partitionId():06d}.bin"
        part = f"{root}/unfinished/{name}.{task.taskAttemptId()}"
        count = 0
        with fs.open_output_stream(part) as out:
            for batch in batches:
                for value in batch.column("text"):
                    out.write(np.array([*encode(value.as_py()), end], f"<u{width}").tobytes())
                rows = len(batch)
                yield pa.RecordBatch.from_arrays([pa.array([name] * rows), pa.array(np.arange(count, count + rows)), batch.column("doc_id")], names=["file", "ordinal", "doc_id"])
                count += rows
        if fs.get_file_info(f"{root}/flat/{name}").type == pa.fs.FileType.NotFound:
            fs.move(part, f"{root}/flat/{name}")
        else:  # another attempt was first, with the same tokens
            fs.delete_file(part)

    schema = f"file string, ordinal long, doc_id {kind}"
    rows.mapInArrow(write, schema).write.mode("overwrite").parquet(f"{folder}/names")
    return docs.sparkSession.read.schema(schema).parquet(f"{folder}/names")


def _search(end, width):
    """(path, block, start, bytes) -> (path, block, tokens, ends: places of all separators in the file)."""

    def search(batches):
        for batch in batches:
            found, tokens = [], []
            for path, start, size in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "bytes"))):
                fs, own = _open(path)
                with fs.open_input_file(own) as f:
                    ids = np.frombuffer(f.read_at(size, start), f"<u{width}")
                found.append(np.flatnonzero(ids == end) + start // width)
                tokens.append(len(ids))
            yield pa.RecordBatch.from_arrays(
                [batch.column("path"), batch.column("block"), pa.array(tokens, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["path", "block", "tokens", "ends"]
            )

    return search


def document_spans(spark, folder, end=END, width=2, block_bytes=BLOCK_BYTES, glob="*.bin"):
    """path, ordinal, start, n_tokens, closed of every document in the folder's files; start and n_tokens in tokens, without separators."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", (F.col("length") - F.col("length") % width).alias("length"))
    step = max(width, block_bytes - block_bytes % width)
    blocks = files.where("length > 0").select("path", "length", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(step))).alias("block", "start"))
    blocks = blocks.select("path", F.col("block").cast("long").alias("block"), "start", F.least(F.lit(step), F.col("length") - F.col("start")).alias("bytes"))
    # Each block is one row, whose reading is the work: rows are dealt out, and not merged again for being small.
    dealt = blocks.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
    found = dealt.mapInArrow(_search(end, width), "path string, block long, tokens long, ends array<long>").checkpoint()
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    scan = found.select("path", "block", "tokens", F.size("ends").cast("long").alias("n"), F.try_element_at("ends", F.lit(-1)).alias("last"))
    scan = scan.select(
        "path",
        "block",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
        F.coalesce(F.max("last").over(earlier), F.lit(-1)).alias("previous"),
        F.sum("tokens").over(Window.partitionBy("path").orderBy("block")).alias("read"),
        F.lead("block").over(Window.partitionBy("path").orderBy("block")).isNull().alias("final"),
    )
    stitched = found.join(scan, ["path", "block"])
    # A file's last block also closes what no separator ends.
    last_end = F.greatest("previous", F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(-1)))
    open_end = F.when(F.col("final") & (F.col("read") > last_end + 1), F.array("read")).otherwise(F.expr("cast(array() as array<bigint>)"))
    starts = F.concat(F.array("previous"), "ends")
    pieces = stitched.select("path", "before", "read", "final", starts.alias("starts"), F.posexplode(F.concat("ends", open_end)).alias("k", "stop"))
    start = F.element_at("starts", F.col("k") + 1) + 1
    return pieces.select(
        "path",
        (F.col("before") + F.col("k")).alias("ordinal"),
        start.alias("start"),
        (F.col("stop") - start).alias("n_tokens"),
        (~(F.col("final") & (F.col("stop") == F.col("read")))).alias("closed"),
    )


def report(docs, doc_id="doc_id", text="text", vocabulary=VOCABULARY):
    """doc_id and n_tokens of every document, counted in flat files written from the texts."""
    folder = fresh_folder(docs.sparkSession, "tokens")
    names = write_tokens(docs, folder, vocabulary, doc_id=doc_id, text=text)
    spans = document_spans(docs.sparkSession, f"{folder}/flat")
    spans = spans.withColumn("file", F.element_at(F.split("path", "/"), -1))
    return names.join(spans, ["file", "ordinal"]).select("doc_id", "n_tokens")
