"""Detection streams: read, encode, ingest into routed tables, per-class state."""

import time

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from stockloom.functions.records import with_detection_defaults
from stockloom.operators.aggregate import detection_summary
from stockloom.schemas import DETECTION_SCHEMA
from stockloom.session import setting
from stockloom.sources.tables import append_routed
from stockloom.streaming.archives import TopicArchive

KAFKA_DEFAULTS = {"startingOffsets": "latest", "minOffsetsPerTrigger": "100", "maxTriggerDelay": "10s"}
# Messages that a stream's Python function takes at once. Spark's worker keeps up to 57 such frames of a group before it lets go of the first.
MESSAGES_AT_ONCE = 1000


def read_detections(spark, source, schema=DETECTION_SCHEMA):
    """Detection stream. `source` is a dict of reader options with `format`.

    Kafka delivers JSON values, which are parsed. `arrival` is then (broker time, partition, offset): offsets alone order only
    the messages of one partition. Unless told otherwise reading starts at the latest offset, and a micro-batch waits for 100
    messages or 10 seconds, whichever comes first. `topic_archive` (see archives) delivers the same columns. File formats deliver the columns of the schema; `path` names the folder.
    """
    options = dict(source)
    fmt = options.pop("format")
    reader = spark.readStream.format(fmt)
    if fmt == TopicArchive.name():
        spark.dataSource.register(TopicArchive)
    if fmt in ("kafka", TopicArchive.name()):
        raw = reader.options(**({**KAFKA_DEFAULTS, **options} if fmt == "kafka" else options)).load()
        parsed = F.from_json(F.col("value").cast("string"), schema).alias("_d")
        arrival = F.struct("timestamp", "partition", "offset").alias("arrival")
        return raw.select(parsed, arrival).select("_d.*", "arrival")
    return reader.schema(schema).options(**options).load()


def detections_to_json(df, conf=0.25):
    """Detections at or above the confidence as JSON texts in a column `value`, ready for a topic."""
    fields = ["timestamp", "class", "confidence", "source"]
    return df.filter(F.col("confidence") >= conf).select(F.to_json(F.struct(*fields)).alias("value"))


def detections_from_json(df, schema=DETECTION_SCHEMA):
    return df.select(F.from_json(F.col("value").cast("string"), schema).alias("_d")).select("_d.*")


def send_detections(df, sink, checkpoint, conf=0.25, available_now=False):
    """Start a query that sends detections as JSON values. `sink` is a dict of writer options with `format`, such as kafka with
    topic and servers."""
    options = dict(sink)
    writer = detections_to_json(df, conf).writeStream.format(options.pop("format")).options(**options)
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def ingest_detections(stream, target, checkpoint, interval="10 seconds", available_now=False):
    """Start a query that appends every micro-batch to the tables named by its `table` column.

    How many messages a batch takes is an option of the source (maxOffsetsPerTrigger, maxFilesPerTrigger). The batch id is
    part of the folder, so a batch that is replayed after a failure replaces itself. Python functions of the stream get at most
    MESSAGES_AT_ONCE messages at a time, so what a worker holds does not grow with the messages of a route.
    """

    def write(batch, batch_id):
        append_routed(with_detection_defaults(batch), target, batch_id=batch_id)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    most = "spark.sql.execution.arrow.maxRecordsPerBatch"
    given = int(stream.sparkSession.conf.get(most))
    # Zero and less stand for no limit.
    with setting(stream.sparkSession, most, str(min(given, MESSAGES_AT_ONCE) if given > 0 else MESSAGES_AT_ONCE)):
        return writer.start()


def flushed_by_count_or_time(stream, route_col="table", default="default", most=100, seconds=10, lanes=1):
    """The messages of a stream, each once the buffer of its route is flushed: at `most` messages, or `seconds` after the last flush.

    Buffers are state with processing-time timers, so they outlive a restart and any source will do; an idle stream still flushes, at
    the next trigger. Adds `flush`, the number of the flush within its route and lane. The messages of a route with very many are
    dealt to several `lanes`, each with a buffer of its own, by a hash of the message. `route_col` of the result is never empty.
    A query with timers has always another batch to run, so it does not end by itself; see stop_when_idle.
    """
    kinds = stream.schema
    given = F.col(route_col).cast("string")
    routed = stream.withColumn(route_col, F.when(F.coalesce(given, F.lit("")) == "", F.lit(default)).otherwise(given))
    value = F.to_json(F.struct(*stream.columns))
    packed = routed.select(F.col(route_col).alias("route"), F.pmod(F.xxhash64(value), F.lit(lanes)).alias("lane"), value.alias("value"))

    def hold(key, frames, state):
        held, last, flush = state.get if state.exists else ([], state.getCurrentProcessingTimeMs(), 0)
        held = list(held)
        now = state.getCurrentProcessingTimeMs()

        def out(values):
            return pd.DataFrame({"route": key[0], "lane": key[1], "flush": flush, "value": values})

        for frame in frames if not state.hasTimedOut else ():
            held += frame["value"].tolist()
            while len(held) >= most:
                yield out(held[:most])
                held, last, flush = held[most:], now, flush + 1
        if held and now - last >= 1000 * seconds:
            yield out(held)
            held, last, flush = [], now, flush + 1
        state.update((held, last, flush))
        if held:
            state.setTimeoutDuration(max(1, last + 1000 * seconds - now))

    flushed = packed.groupBy("route", "lane").applyInPandasWithState(
        hold, "route string, lane long, flush long, value string", "held array<string>, last long, flush long", "append", GroupStateTimeout.ProcessingTimeTimeout
    )
    message = F.from_json("value", kinds).alias("m")
    return flushed.select("route", "flush", message).select(*[F.col("route").alias(c) if c == route_col else F.col(f"m.`{c}`") for c in stream.columns], "flush")


def stop_when_idle(query, poll=0.2):
    """Stop a query once it has run two batches without input: the first after a restart may be one planned before it."""
    while query.isActive:
        last = {p["batchId"]: p["numInputRows"] for p in query.recentProgress[-3:]}
        if len(last) > 1 and not any(list(last.values())[-2:]):
            query.stop()
        time.sleep(poll)
    if query.exception() is not None:
        raise query.exception()


def track_classes(stream, arrival="arrival"):
    """Running state per class: count, last seen and source in order of arrival. One row of state per class."""
    return detection_summary(with_detection_defaults(stream), arrival)


def store_state(state, target, checkpoint, available_now=False, interval="10 seconds"):
    """Start a query that stores the whole state after each micro-batch; see read_state.

    Two folders take turns, so the state before stays readable while the next is written, and no more than two are kept."""

    def write(batch, batch_id):
        batch.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{target}/turn={batch_id % 2}")

    writer = state.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()


def read_state(spark, target):
    """The state after the last micro-batch."""
    stored = spark.read.parquet(target)
    last = stored.agg(F.max("batch_id").alias("last"))
    return stored.filter(F.col("batch_id") == last.scalar()).drop("batch_id", "turn")


def store_changes(state, target, checkpoint, available_now=False, interval="10 seconds"):
    """Start a query that stores, after each micro-batch, only the classes that it changed, as a version of each; see read_versions.

    A batch has a folder of its own, which a replay after a failure replaces."""

    def write(batch, batch_id):
        batch.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(target)

    writer = state.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()


def read_versions(spark, target, key="class", upto=None):
    """The latest version of each key, or the latest up to a batch."""
    stored = spark.read.parquet(target)
    stored = stored if upto is None else stored.where(F.col("batch_id") <= upto)
    rest = [c for c in stored.columns if c != key]
    latest = stored.groupBy(key).agg(F.max_by(F.struct(*rest), "batch_id").alias("_latest"))
    return latest.select(key, *[F.col(f"_latest.{c}").alias(c) for c in rest if c != "batch_id"])


def compact_versions(spark, target, compacted, before, key="class"):
    """Write the latest version of each key among the batches before `before` to another folder, as one version of batch `before` - 1.
    The folders read together are the table then; drop the closed batches when readers use both."""
    latest = read_versions(spark, target, key, before - 1).withColumn("batch_id", F.lit(before - 1).cast("long"))
    latest.write.mode("overwrite").partitionBy("batch_id").parquet(compacted)


def running_state(spark, checkpoint, operator=0):
    """What a running or stopped query holds per key just now, read from its state store: the key's columns and `value`."""
    return spark.read.format("statestore").option("operatorId", operator).load(checkpoint).select("key.*", "value")
