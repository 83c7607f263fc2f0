"""Capture files: round trips, cut records, restarts, and tasks that are dealt files by bytes."""

import struct

import pytest
from pyspark.sql import functions as F

from driftglass.session import scratch
from driftglass.sources import capture
from driftglass.streaming import jobs

ROWS = [(1, 1000, b"one"), (2, 2000, b""), (1, 3000, bytes(range(256))), (4_000_000_000, 4000, b"x" * 5000)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "link long, ms long, data binary").select("link", F.timestamp_millis("ms").alias("ts"), "data")


def read(df):
    return sorted((r["link"], r["ms"], bytes(r["data"])) for r in df.select("link", F.unix_millis("ts").alias("ms"), "data").collect())


def test_round_trip(spark):
    folder = scratch(spark, "t")
    rows = [*ROWS, (None, 1, b"no link"), (3, None, b"no time"), (3, 5, None)]
    assert capture.captured(frame(spark, rows).withColumn("file", F.lit("clash")).repartition(3), folder) >= 1
    got = capture.captures(spark, folder, stream=False)
    assert read(got) == sorted(ROWS) and got.select("file").distinct().count() >= 1
    assert capture.captures(spark, scratch(spark, "nothing"), stream=False).count() == 0


def test_cut_and_hidden_files(spark, tmp_path):
    whole = b"".join(struct.pack(capture.RECORD, link, ms, len(data)) + data for link, ms, data in ROWS[:2])
    (tmp_path / "1.cap").write_bytes(whole + struct.pack(capture.RECORD, 9, 9, 100) + b"cut")
    (tmp_path / "2.cap").write_bytes(whole[:7])
    (tmp_path / "3.cap").write_bytes(b"")
    (tmp_path / ".4.cap").write_bytes(whole)
    (tmp_path / "5.txt").write_bytes(whole)
    assert read(capture.captures(spark, f"file://{tmp_path}", stream=False)) == sorted(ROWS[:2])


def test_files_are_dealt_by_bytes(tmp_path, monkeypatch):
    monkeypatch.setattr(capture, "A_TASK", 100)
    for i, size in enumerate([60, 30, 30, 500, 10, 90]):
        (tmp_path / f"{i}.cap").write_bytes(bytes(size))
    dealt = lambda *a: [t.names for t in capture._Folder(f"file://{tmp_path}").dealt(*a)]
    assert dealt() == [("0.cap", "1.cap"), ("2.cap",), ("3.cap",), ("4.cap", "5.cap")]
    assert dealt("1.cap", "3.cap") == [("2.cap",), ("3.cap",)] and dealt("5.cap") == []


def test_files_roll(spark, monkeypatch):
    folder = scratch(spark, "t")
    monkeypatch.setattr(capture, "ROLL", 1000)
    rows = [(i, i, bytes(400)) for i in range(10)]
    n = capture.captured(frame(spark, rows).coalesce(1), folder)
    assert n >= 1 and read(capture.captures(spark, folder, stream=False)) == sorted(rows)


@pytest.mark.parametrize("dedup", [False, True])
def test_a_restart_repeats_nothing(spark, dedup):
    root = scratch(spark, "t")

    def run():
        rows = capture.captures(spark, f"{root}/in").select("link", "ts", "data")
        rows = jobs.without_duplicates(rows, "link", "1 day") if dedup else rows
        rows.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
        return read(spark.read.parquet(f"{root}/out"))

    capture.captured(frame(spark, ROWS[:2]), f"{root}/in")
    assert run() == sorted(ROWS[:2]) == run()
    capture.captured(frame(spark, ROWS[2:]), f"{root}/in")  # link 1 comes again
    want = sorted([*ROWS[:2], ROWS[3]] if dedup else ROWS)
    assert run() == want == run()
