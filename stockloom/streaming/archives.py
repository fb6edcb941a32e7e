"""Archives of a topic, read as a stream: the messages with value, broker time, partition and offset, as a broker delivers them.

An archive is Parquet in folders partition=P/segment=S, where a segment holds the offsets from S up to the next one's. `write_archive` makes
one; `topic_archive` is the name of the source. A micro-batch takes all offsets that were written since the last one, a task per segment.
Options: path, and startingOffsets (latest, the default, or earliest).
"""

import posixpath
import re

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SEGMENT = 100_000
SCHEMA = "value binary, timestamp timestamp, partition int, offset long"


def write_archive(messages, path, order, first=None, segment=SEGMENT):
    """Add messages (value, timestamp, partition) to an archive, with offsets in the given order within their partition. `first` is a frame
    (partition, next) of the offsets to go on from. A segment that is continued gets another file."""
    place = F.row_number().over(Window.partitionBy("partition").orderBy(*order)) - 1
    numbered = messages.withColumn("_place", place.cast("long"))
    if first is None:
        numbered = numbered.withColumn("offset", F.col("_place"))
    else:
        numbered = numbered.join(first, "partition", "left").withColumn("offset", F.col("_place") + F.coalesce("next", F.lit(0)))
    rows = numbered.select(
        F.col("value").cast("binary").alias("value"),
        F.unix_micros(F.col("timestamp").cast("timestamp")).alias("micros"),
        "offset",
        F.col("partition").cast("int").alias("partition"),
        (F.col("offset") - F.col("offset") % segment).alias("segment"),
    )
    rows.write.mode("append").partitionBy("partition", "segment").parquet(path)


def next_offsets(spark, path):
    """partition, next: the offset that the next message of each partition gets."""
    return spark.read.parquet(path).groupBy("partition").agg((F.max("offset") + 1).alias("next"))


def located(path):
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def children(system, folder, name):
    """Numbers of the folders name=number."""
    found = (re.fullmatch(rf"{name}=(\d+)", posixpath.basename(f.path)) for f in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)))
    return sorted(int(f[1]) for f in found if f)


def segment_files(system, folder, partition, segment):
    selector = fs.FileSelector(f"{folder}/partition={partition}/segment={segment}", allow_not_found=True)
    return sorted(f.path for f in system.get_file_info(selector) if f.path.endswith(".parquet"))


class Segment(InputPartition):
    """Offsets from `start` to `end` of one segment."""

    def __init__(self, partition, segment, start, end):
        self.partition, self.segment, self.start, self.end = partition, segment, start, end


class ArchiveReader(DataSourceStreamReader):
    def __init__(self, options):
        self.path, self.starting = options["path"], options.get("startingoffsets", "latest")

    def latestOffset(self):
        """Only the last segment of a partition is looked into, and there only the footers."""
        system, folder = located(self.path)
        ends = {}
        for partition in children(system, folder, "partition"):
            last = children(system, f"{folder}/partition={partition}", "segment")[-1]
            ends[str(partition)] = last + sum(pq.read_metadata(f, filesystem=system).num_rows for f in segment_files(system, folder, partition, last))
        return ends

    def initialOffset(self):
        ends = self.latestOffset()
        return ends if self.starting == "latest" else {p: 0 for p in ends}

    def partitions(self, start, end):
        system, folder = located(self.path)
        tasks = []
        for partition, stop in end.items():
            begin = start.get(partition, 0)  # a partition that came later is read from its beginning
            segments = children(system, f"{folder}/partition={partition}", "segment") if begin < stop else []
            for segment, following in zip(segments, [*segments[1:], stop]):
                if segment < stop and following > begin:
                    tasks.append(Segment(int(partition), segment, max(begin, segment), min(stop, following)))
        return tasks

    def read(self, part):
        system, folder = located(self.path)
        for name in segment_files(system, folder, part.partition, part.segment):
            with pq.ParquetFile(system.open_input_file(name)) as file:
                for batch in file.iter_batches(columns=["value", "micros", "offset"]):
                    batch = batch.filter(pc.and_(pc.greater_equal(batch["offset"], part.start), pc.less(batch["offset"], part.end)))
                    if batch.num_rows:
                        time = batch["micros"].cast(pa.timestamp("us", tz="UTC"))
                        number = pa.array([part.partition] * batch.num_rows, pa.int32())
                        yield pa.RecordBatch.from_arrays([batch["value"], time, number, batch["offset"]], names=["value", "timestamp", "partition", "offset"])


class TopicArchive(DataSource):
    @classmethod
    def name(cls):
        return "topic_archive"

    def schema(self):
        return SCHEMA

    def streamReader(self, schema):
        return ArchiveReader({k.lower(): v for k, v in self.options.items()})
