import json

import pytest
from pyspark.sql import functions as F

from stockloom.session import fresh_folder
from stockloom.streaming import archives, detections


@pytest.fixture()
def folder(spark):
    return fresh_folder(spark, "archive")


def send(spark, folder, rows, segment=3):
    """rows: (place, partition, broker's second, class)."""
    values = [(json.dumps({"class": c, "confidence": 0.5, "source": f"cam{n}"}), s, p, n) for n, p, s, c in rows]
    messages = spark.createDataFrame(values, "value string, second long, partition int, n int").withColumn("timestamp", F.timestamp_seconds("second"))
    try:
        first = archives.next_offsets(spark, folder)
        first.schema
    except Exception:
        first = None
    archives.write_archive(messages, folder, ["n"], first, segment)


def read(spark, folder, out, starting="earliest"):
    stream = detections.read_detections(spark, {"format": "topic_archive", "path": folder, "startingOffsets": starting})
    flat = stream.select("class", "source", "arrival.*")
    writer = flat.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint")
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.exception() is None
    rows = spark.read.schema(flat.schema).parquet(f"{out}/rows").collect()
    return sorted((r.partition, r.offset, r["class"], r.source, r.timestamp.second) for r in rows)


def test_offsets_go_on_over_runs_and_segments(spark, folder):
    send(spark, f"{folder}/topic", [(n, n % 2, 10 + n, "abc"[n % 3]) for n in range(9)])
    want = [(n % 2, n // 2, "abc"[n % 3], f"cam{n}", 10 + n) for n in range(9)]
    assert read(spark, f"{folder}/topic", f"{folder}/out") == sorted(want)
    assert read(spark, f"{folder}/topic", f"{folder}/out") == sorted(want)  # nothing new, nothing twice
    # More messages for one partition, into a segment that was read in part, and a partition that is new.
    send(spark, f"{folder}/topic", [(20, 0, 30, "d"), (21, 7, 31, "e"), (22, 0, 32, "f"), (23, 0, 33, None)])
    want += [(0, 5, "d", "cam20", 30), (7, 0, "e", "cam21", 31), (0, 6, "f", "cam22", 32), (0, 7, None, "cam23", 33)]
    assert read(spark, f"{folder}/topic", f"{folder}/out") == sorted(want, key=lambda r: r[:2])


def test_latest_sees_only_what_comes_later(spark, folder):
    send(spark, f"{folder}/topic", [(n, 0, n, "a") for n in range(4)])
    assert read(spark, f"{folder}/topic", f"{folder}/out", "latest") == []
    send(spark, f"{folder}/topic", [(9, 0, 9, "b")])
    assert read(spark, f"{folder}/topic", f"{folder}/out", "latest") == [(0, 4, "b", "cam9", 9)]


def test_ranges_of_segments(tmp_path):
    """The tasks of a micro-batch cover its offsets, each once, whatever borders the segments have."""
    for partition, segments in ((0, [0, 3, 6]), (1, [0])):
        for segment in segments:
            (tmp_path / f"partition={partition}" / f"segment={segment}").mkdir(parents=True)
    reader = archives.ArchiveReader({"path": str(tmp_path)})
    for start in range(8):
        for end in range(start, 8):
            parts = reader.partitions({"0": start}, {"0": end, "1": 2})
            got = [o for p in parts if p.partition == 0 for o in range(p.start, p.end)]
            assert got == list(range(start, end))
            assert all(p.start < p.end for p in parts)
            assert [(p.start, p.end) for p in parts if p.partition == 1] == [(0, 2)]
