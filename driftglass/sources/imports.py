"""Folders of documents of many formats as a data source: tasks are planned by bytes, filters on the file's name are pushed down to the
listing, and what cannot be read is a value. The driver lists one folder at a time and tells a task no more than the first and last file
of each of its folders, which the task lists again.

    read_imports(spark, folder, told=F.col("filename").endswith(".rtf"))
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith
from pyspark.sql.types import StructType

from driftglass.functions.text import SIGNATURES
from driftglass.session import beside
from driftglass.sources.files import MOST_BYTES, TO_OPEN, cleaned, read_text

#: Bytes of files that a task reads at most (but for one larger file), and characters that it hands over at once.
A_TASK, AT_ONCE = 64 << 20, 4 << 20
#: Files of a folder that is listed again by its tasks, at most; the files of a larger one are named to them. Files that below() puts in a folder,
#: on average.
LISTED_AGAIN, A_FOLDER = 1 << 16, 4096
SCHEMA = "path string, filename string, length long, format string, raw_text string, raw_title string, error string"
_ARROW = pa.schema([("path", pa.string()), ("filename", pa.string()), ("length", pa.int64()), ("format", pa.string()), ("raw_text", pa.string()), ("raw_title", pa.string()), ("error", pa.string())])


def sniffed(raw: bytes) -> str:
    """text.sniff() of bytes at hand."""
    head = raw[:8].hex().upper()
    return next((kind for start, kind in SIGNATURES if head.startswith(start)), "text")


def passes(name: str, told: Filter) -> bool:
    """Whether a file's name meets a filter that is pushed down."""
    kind, value = type(told), told.value
    if kind is In:
        return name in value
    return {EqualTo: name == value, StringStartsWith: name.startswith(str(value)), StringEndsWith: name.endswith(str(value)), StringContains: str(value) in name}[kind]


def visible(place: fs.FileSystem, folder: str, told: Iterable[Filter] = ()) -> tuple[list[tuple[str, int]], list[str]]:
    """(path, bytes) of a folder's files whose names pass, and its folders, both in order. Hidden ones don't count."""
    found = [f for f in place.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if not f.base_name.startswith((".", "_"))]
    return sorted((f.path, f.size) for f in found if f.is_file and all(passes(f.base_name, t) for t in told)), sorted(f.path for f in found if f.type == fs.FileType.Directory)


@dataclass
class Files(InputPartition):
    """A task's files: those between the first and the last of each range (folder, first, last), and those that are named."""

    folder: str
    told: tuple[Filter, ...]
    ranges: list[tuple[str, str, str]]
    named: list[tuple[str, int]]

    def __init__(self, folder: str, told: Iterable[Filter]) -> None:
        super().__init__(folder)
        self.folder, self.told, self.ranges, self.named = folder, tuple(told), [], []

    def add(self, folder: str, path: str, size: int, named: bool) -> None:
        if named:
            self.named.append((path, size))
        elif self.ranges and self.ranges[-1][0] == folder:
            self.ranges[-1] = (folder, self.ranges[-1][1], path)
        else:
            self.ranges.append((folder, path, path))

    @property
    def paths(self) -> Iterator[tuple[str, int]]:
        place, _ = fs.FileSystem.from_uri(self.folder)
        for folder, first, last in self.ranges:
            yield from (f for f in visible(place, folder, self.told)[0] if first <= f[0] <= last)
        yield from self.named


class ImportReader(DataSourceReader):
    """Reads the files under a folder. Hidden ones, as unfinished uploads are, don't count."""

    def __init__(self, folder: str, most: int) -> None:
        self.folder, self.most = folder, most
        self.told: list[Filter] = []

    def folders(self) -> Iterator[tuple[str, list[tuple[str, int]]]]:
        """Each folder with (path, bytes) of its files whose names pass, in order."""
        place, at = fs.FileSystem.from_uri(self.folder)
        todo = [at]
        while todo:
            found, below = visible(place, folder := todo.pop(), self.told)
            todo += reversed(below)
            yield folder, found

    def listed(self) -> Iterator[tuple[str, int]]:
        """(path, bytes) of the files whose names pass."""
        return (f for _, found in self.folders() for f in found)

    def partitions(self) -> list[Files]:
        tasks: list[Files] = []
        room = 0
        for folder, found in self.folders():
            for path, size in found:
                cost = TO_OPEN + (size if size <= self.most else 0)  # a larger one is not read
                if not tasks or cost > room:
                    tasks.append(Files(self.folder, self.told))
                    room = A_TASK
                tasks[-1].add(folder, path, size, len(found) > LISTED_AGAIN)
                room -= cost
        return tasks or [Files(self.folder, ())]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        place, _ = fs.FileSystem.from_uri(self.folder)
        rows, held = [], 0
        for path, size in partition.paths:
            kind = text = title = None
            error: str | None = "too-large"
            if size <= self.most:
                with place.open_input_stream(path) as f:
                    raw = f.read()
                kind = sniffed(raw)
                text, title, error = read_text(raw, kind)
            rows.append((path, path.rsplit("/", 1)[-1], size, kind, text, title, error))
            held += len(text or "") + 256
            if held >= AT_ONCE:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


class PushedReader(ImportReader):
    """An ImportReader that takes filters on the file's name to the listing."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) == ("filename",) and type(f) in (EqualTo, In, StringStartsWith, StringEndsWith, StringContains):
                self.told.append(f)
            else:
                yield f


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class Imports(DataSource):
    @classmethod
    def name(cls) -> str:
        return "imports"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        kind = PushedReader if self.options.get("pushed") == "true" else ImportReader
        return kind(self.options["path"], int(self.options.get("most", MOST_BYTES)))


def read_imports(spark: SparkSession, folder: str, most: int = MOST_BYTES, told: Column | None = None) -> DataFrame:
    """(path, filename, length, format, error, text, title) of the files under a folder that driver and executors share: pages, RTF and
    word-processor files, and text in UTF-8 or UTF-16. Files of more than `most` bytes are errors (too-large), as are those that are
    unsupported, damaged, binary or empty; an error has no text. A folder that isn't there has no files.

    told: which files are asked for. What it says of the name goes to the listing, so that other files are not opened. (Spark keeps what
    is pushed with the table that was loaded, so a frame whose filters are pushed must not be filtered otherwise in a second place of a
    plan; hence the filter is given here, and each call loads anew.)"""
    own = beside(spark, spark__sql__python__filterPushdown__enabled="true")
    own.dataSource.register(Imports)
    rows = own.read.format("imports").option("most", most).option("pushed", "false" if told is None else "true").load(folder)
    return cleaned(rows if told is None else rows.where(told))


def exported(rows: DataFrame, folder: str) -> int:
    """Writes rows (filename, raw) as files, each seen under its name once it is whole; returns how many. Rows that repeat a name are one
    file, that of the last one to be written. Where rows have `below`, that names the folder under `folder` that a file goes to."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, root = fs.FileSystem.from_uri(folder)
        made: set[str] = set()
        n = 0
        for batch in batches:
            for name, raw, *below in zip(*batch.columns, strict=True):
                at = "/".join([root, *map(str, below)])
                if at not in made:
                    place.create_dir(at)
                    made.add(at)
                with place.open_output_stream(f"{at}/.{name}") as f:
                    f.write(raw.as_py())
                place.move(f"{at}/.{name}", f"{at}/{name}")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    whole = rows.where(F.col("filename").isNotNull() & F.col("raw").isNotNull()).select("filename", "raw", *(c for c in rows.columns if c == "below"))
    return whole.mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0


def below(filename: Column, files: int) -> Column:
    """The folder that one of so many files goes to, by its name, so that no folder has very many."""
    return F.format_string("%06d", F.pmod(F.xxhash64(filename), F.lit(-(-files // A_FOLDER) or 1)))


def folders_of(folder: str) -> list[str]:
    """The folders under a folder."""
    place, at = fs.FileSystem.from_uri(folder)
    return [f"{folder}/{path.rsplit('/', 1)[-1]}" for path in visible(place, at)[1]]
