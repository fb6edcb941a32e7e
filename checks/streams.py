"""Streams over the events: routed ingest and per-class state."""

from pyspark.sql import functions as F

from checks.base import DETECTIONS, as_detections, query, table
from stockloom.session import fresh_folder
from stockloom.sources.tables import read_routed
from stockloom.streaming import archives
from stockloom.streaming import detections as streaming


def detection_stream(spark, d):
    schema = table(spark, d, "events").schema
    source = {"format": "parquet", "path": d, "pathGlobFilter": "events.parquet"}
    return as_detections(streaming.read_detections(spark, source, schema))


@query(
    f"""SELECT coalesce("table", 'default') AS "table", class, coalesce(source, 'unknown') AS source, count(*) AS n,
  sum(arrival)::bigint AS arrivals FROM ({DETECTIONS}) GROUP BY ALL"""
)
def stream_ingest(spark, d):
    target = fresh_folder(spark, "ingest")
    running = streaming.ingest_detections(detection_stream(spark, d), f"{target}/tables", f"{target}/checkpoint", available_now=True)
    running.awaitTermination()
    stored = read_routed(spark, f"{target}/tables")
    return stored.groupBy("table", "class", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("arrival").alias("arrivals"))


@query(
    f"""SELECT class, arg_max(timestamp, arrival) AS last_seen, count(*) AS count, arg_max(coalesce(source, 'unknown'), arrival) AS source
FROM ({DETECTIONS}) GROUP BY 1"""
)
def stream_class_state(spark, d):
    target = fresh_folder(spark, "state")
    state = streaming.track_classes(detection_stream(spark, d))
    streaming.store_state(state, f"{target}/state", f"{target}/checkpoint", available_now=True).awaitTermination()
    return streaming.read_state(spark, f"{target}/state")


def event_files(spark, d, files=4):
    """The events as detections in several files, for a stream of several micro-batches."""
    path = fresh_folder(spark, "events")
    events = as_detections(table(spark, d, "events"))
    events.repartition(files, F.col("arrival") % files).write.parquet(path)
    return path, events.schema


@query(
    f"""SELECT class, arg_max(timestamp, arrival) AS last_seen, count(*) AS count, arg_max(coalesce(source, 'unknown'), arrival) AS source
FROM ({DETECTIONS}) GROUP BY 1"""
)
def stream_class_versions(spark, d):
    """The state as versions: each micro-batch stores the classes that it changed."""
    path, schema = event_files(spark, d)
    target = fresh_folder(spark, "versions")
    stream = streaming.read_detections(spark, {"format": "parquet", "path": path, "maxFilesPerTrigger": 1}, schema)
    streaming.store_changes(streaming.track_classes(stream), f"{target}/versions", f"{target}/checkpoint", available_now=True).awaitTermination()
    return streaming.read_versions(spark, f"{target}/versions")


@query(
    f"""WITH r AS (SELECT coalesce("table", 'default') AS "table", count(*) AS n FROM ({DETECTIONS}) GROUP BY 1)
SELECT "table", (n // 100)::bigint AS flushes, (n // 100 * 100)::bigint AS messages FROM r WHERE n >= 100"""
)
def stream_flushed_by_count(spark, d):
    """Routes leave their buffers in hundreds; what is left over stays in the state, since no time runs out."""
    path, schema = event_files(spark, d)
    target = fresh_folder(spark, "flushed")
    stream = streaming.read_detections(spark, {"format": "parquet", "path": path, "maxFilesPerTrigger": 1}, schema)
    flushed = streaming.flushed_by_count_or_time(stream, seconds=86_400)
    running = streaming.ingest_detections(flushed, f"{target}/tables", f"{target}/checkpoint", interval="0 seconds")
    streaming.stop_when_idle(running)
    stored = read_routed(spark, f"{target}/tables").select(F.col("table"), "flush")
    return stored.groupBy("table").agg(F.countDistinct("flush").alias("flushes"), F.count(F.lit(1)).alias("messages"))


@query(
    f"""WITH m AS (SELECT class, timestamp, coalesce(source, 'unknown') AS source, e.user_id % 3 AS part, e.ts AS ts, arrival
  FROM ({DETECTIONS}) JOIN events e ON e.event_id = arrival WHERE confidence >= 0.25)
SELECT class, timestamp AS last_seen, count(*) OVER (PARTITION BY class) AS count, source FROM m
QUALIFY row_number() OVER (PARTITION BY class ORDER BY ts DESC, part DESC, arrival DESC) = 1"""
)
def stream_topic_state(spark, d):
    """Detections as JSON messages of a topic with three partitions: parsed, and put in order of arrival over the partitions. The first half
    is read by a run of the query, the rest by a second one that goes on from its checkpoint."""
    root = fresh_folder(spark, "topic")
    events = table(spark, d, "events")
    broker = events.select(F.col("event_id").alias("arrival"), "ts", (F.col("user_id") % 3).alias("partition"))
    sent = as_detections(events).where(F.col("confidence") >= 0.25).join(broker, "arrival")
    value = F.to_json(F.struct("timestamp", "class", "confidence", "source")).alias("value")
    sent = sent.select(value, F.col("ts").alias("timestamp"), "partition", "arrival")
    middle = sent.agg(F.floor(F.avg("arrival")).alias("middle")).scalar()
    halves = sent.withColumn("early", F.col("arrival") <= middle)
    for early, first in ((True, None), (False, archives.next_offsets)):
        first = first and first(spark, f"{root}/topic")
        archives.write_archive(halves.where(F.col("early") == early), f"{root}/topic", ["arrival"], first, segment=1000)
        stream = streaming.read_detections(spark, {"format": "topic_archive", "path": f"{root}/topic", "startingOffsets": "earliest"})
        streaming.store_changes(streaming.track_classes(stream), f"{root}/versions", f"{root}/checkpoint", available_now=True).awaitTermination()
    return streaming.read_versions(spark, f"{root}/versions")
