"""Binary packet captures as a source: a folder of files of length-prefixed frames, read in batches or as a stream.

A file is a run of records: link (4 bytes), time in milliseconds (8), length of the frame (4), the frame; all big-endian. Files are
closed when they show under their name, and names rise with time, so a stream's offset is the name of the last file it has read: a
restart from a checkpoint goes on behind it and repeats nothing.
"""

from __future__ import annotations

import struct
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

RECORD, HEAD, SUFFIX = ">IQI", struct.calcsize(">IQI"), ".cap"
#: Bytes after which a writer begins a new file, those of files that a task reads at most (but for one larger file), and of frames that
#: it hands over at once.
ROLL, A_TASK, AT_ONCE = 16 << 20, 64 << 20, 4 << 20
SCHEMA = "file string, link long, ts timestamp, data binary"
_ARROW = pa.schema([("file", pa.string()), ("link", pa.int64()), ("ts", pa.timestamp("us", "UTC")), ("data", pa.binary())])


def captured(rows: DataFrame, folder: str) -> int:
    """Writes rows (link, ts, data) to capture files in a folder that driver and executors share; returns how many. A task that runs
    again writes its files again, under the same names. Rows without link, time or frame are left out."""
    stamp = f"{time.time_ns() // 1_000_000:015d}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, at = fs.FileSystem.from_uri(folder)
        part, files, out, size = TaskContext.get().partitionId(), [], None, 0

        def close() -> None:
            out.close()
            place.move(f"{at}/.{files[-1]}", f"{at}/{files[-1]}")  # from here on it can be seen

        for batch in batches:
            for link, ms, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    place.create_dir(at)
                    files.append(f"{stamp}-{part:07d}-{len(files):05d}{SUFFIX}")
                    out, size = place.open_output_stream(f"{at}/.{files[-1]}"), 0
                out.write(struct.pack(RECORD, link, ms, len(data)) + data)
                size += HEAD + len(data)
                if size >= ROLL:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([len(files)], pa.int64())], ["n"])

    whole = rows.where(F.col("link").isNotNull() & F.col("ts").isNotNull() & F.col("data").isNotNull())
    return whole.select(F.col("link").cast("long"), F.unix_millis(F.col("ts").cast("timestamp")), "data").mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0


def records(stream: pa.NativeFile) -> Iterator[tuple[int, int, bytes]]:
    """(link, ms, frame) of a file; a record that is cut short ends it."""
    while len(head := stream.read(HEAD)) == HEAD:
        link, ms, size = struct.unpack(RECORD, head)
        if len(data := stream.read(size)) < size:
            return
        yield link, ms, data


@dataclass
class Files(InputPartition):
    names: tuple[str, ...]

    def __init__(self, names: tuple[str, ...]) -> None:
        super().__init__(names)
        self.names = names


class _Folder:
    def __init__(self, folder: str) -> None:
        self.folder = folder

    def listed(self, after: str = "", to: str | None = None) -> list[tuple[str, int]]:
        """(name, bytes) of the closed files with names beyond `after`, up to `to`, in order."""
        place, at = fs.FileSystem.from_uri(self.folder)
        found = place.get_file_info(fs.FileSelector(at, allow_not_found=True))
        names = sorted((f.base_name, f.size) for f in found if f.is_file and f.base_name.endswith(SUFFIX) and not f.base_name.startswith("."))
        return [(n, s) for n, s in names if n > after and (to is None or n <= to)]

    def dealt(self, after: str = "", to: str | None = None) -> list[Files]:
        """The files by tasks, of A_TASK bytes each."""
        tasks: list[list[str]] = []
        room = 0
        for name, size in self.listed(after, to):
            if not tasks or size > room:
                tasks.append([])
                room = A_TASK
            tasks[-1].append(name)
            room -= size
        return [Files(tuple(t)) for t in tasks]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        place, at = fs.FileSystem.from_uri(self.folder)
        for name in partition.names:
            rows, size = [], 0
            with place.open_input_stream(f"{at}/{name}") as stream:
                for link, ms, data in records(stream):
                    rows.append((name, link, ms * 1000, data))
                    size += len(data) + 64
                    if size >= AT_ONCE:
                        yield _batch(rows)
                        rows, size = [], 0
            if rows:
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class _Stream(_Folder, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        names = self.listed()
        return {"after": names[-1][0] if names else ""}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return self.dealt(start["after"], end["after"])


class _Batch(_Folder, DataSourceReader):
    def partitions(self) -> list[Files]:
        return self.dealt() or [Files(())]


class Captures(DataSource):
    """spark.read / readStream.format("captures").load(folder)."""

    @classmethod
    def name(cls) -> str:
        return "captures"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(self.options["path"])

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(self.options["path"])


def captures(spark: SparkSession, folder: str, stream: bool = True) -> DataFrame:
    """(file, link, ts, data) of a folder's captures."""
    spark.dataSource.register(Captures)
    return (spark.readStream if stream else spark.read).format("captures").load(folder)
