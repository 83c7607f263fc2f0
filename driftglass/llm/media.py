"""Media columns: content-addressed payloads in tar shards (operator 7).

A payload (bytes, padded with blanks to whole rows) is stored as an 8-bit RGB PNG, 64 pixels wide: its samples are the payload.
PNGs go to tar shards in the shared folder, one for each task that writes, a member for each distinct payload of the task, named
by its digest. Rows carry digest, shard, offset and length only. Metadata columns come from range reads of a PNG's first 33 bytes.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftglass.llm.common import scratch, staged, table

ROW, WIDTH, LEVEL = 192, 64, 6
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER = 33  # signature and IHDR


def padded(raw: bytes) -> bytes:
    return raw.ljust(max(1, -(-len(raw) // ROW)) * ROW)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    """Samples as they are (filter 0 in each row). The same payload gives the same bytes."""
    height = len(payload) // ROW
    rows = np.zeros((height, ROW + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, ROW)
    head = struct.pack(">IIBBBBB", WIDTH, height, 8, 2, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.data, LEVEL)) + _chunk(b"IEND", b"")


def read_header(head: bytes) -> tuple[int, int, int]:
    """(width, height, bits a sample) from the first HEADER bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR" or zlib.crc32(head[12:29]) != struct.unpack(">I", head[29:33])[0]:
        raise ValueError("not a PNG header")
    return struct.unpack(">IIB", head[16:25])


def from_png(png: bytes) -> bytes:
    width, height, _ = read_header(png[:HEADER])
    at, data = 8, []
    while at < len(png):
        size, kind = struct.unpack(">I4s", png[at : at + 8])
        body = png[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", png[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("damaged PNG")
        if kind == b"IDAT":
            data.append(body)
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, 3 * width + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:].tobytes()


def features(payload: bytes, width: int, height: int) -> str:
    """What the samples look like: size, mean, deviation and entropy of the values (to 3 places)."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    share = counts / len(payload)
    values = np.arange(256)
    mean = float((share * values).sum())
    spread = float(np.sqrt((share * (values - mean) ** 2).sum()))
    some = share[share > 0]
    return f"{width}x{height} mean={mean:.3f} std={spread:.3f} bits={float(-(some * np.log2(some)).sum()):.3f}"


def store(rows: DataFrame, folder: str) -> DataFrame:
    """(doc_id, n_bytes, digest, shard, offset, length) for rows (doc_id, raw binary), after writing tar shards to folder.

    A task that runs again writes a shard of another name, and only the shards of tasks that ended are in the result, which is
    staged, so no shard is written twice for it. Texts that one task meets twice are stored once; a shard holds no more than one
    task's payloads.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, at = fs.FileSystem.from_uri(folder)
        shard = f"{uuid.uuid4().hex}.tar"
        out, offset = None, 0
        known: dict[bytes, tuple[str, int, int]] = {}
        for batch in batches:
            found = []
            for raw in batch.column(1):
                raw = raw.as_py() or b""
                key = hashlib.sha256(raw).digest()
                if key not in known:
                    if out is None:
                        place.create_dir(at)
                        out = place.open_output_stream(f"{at}/{shard}")
                    png = to_png(padded(raw))
                    digest = hashlib.sha256(png).hexdigest()
                    info = tarfile.TarInfo(f"{digest}.png")
                    info.size = len(png)
                    head = info.tobuf(tarfile.USTAR_FORMAT)
                    out.write(head)
                    out.write(png)
                    out.write(bytes(-len(png) % 512))
                    known[key] = digest, offset + len(head), len(png)
                    offset += len(head) + len(png) + -len(png) % 512
                found.append((len(raw), *known[key]))
            size, digest, start, length = zip(*found, strict=True) if found else ((),) * 4
            columns = [batch.column(0), pa.array(size, pa.int64()), pa.array(digest, pa.string()), pa.array([shard] * len(found), pa.string()), pa.array(start, pa.int64()), pa.array(length, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
        if out is not None:
            out.write(bytes(1024))
            out.close()

    return staged(rows.mapInArrow(write, "doc_id long, n_bytes long, digest string, shard string, offset long, length long"), "media-index")


def _read(index: DataFrame, folder: str, schema: str, take: Callable, head_only: bool) -> DataFrame:
    """A row of take(bytes) for each distinct stored payload (shard, offset, length, digest), read where it lies."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, at = fs.FileSystem.from_uri(folder)
        for batch in batches:
            out = []
            for shard, group in batch.sort_values(["shard", "offset"]).groupby("shard", sort=False):
                with place.open_input_file(f"{at}/{shard}") as f:
                    for offset, length, digest in zip(group.offset, group.length, group.digest, strict=True):
                        out.append((shard, offset, *take(f.read_at(min(HEADER, length) if head_only else length, offset), digest)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    payloads = index.select("shard", "offset", "length", "digest").repartition("shard").dropDuplicates(["shard", "offset"])
    return payloads.mapInPandas(read, schema)


def with_metadata(index: DataFrame, folder: str) -> DataFrame:
    """index plus width, height and bits, from range reads of headers alone."""
    heads = _read(index, folder, "shard string, offset long, width long, height long, bits long", lambda head, _: read_header(head), True)
    return index.join(heads, ["shard", "offset"])


def read_back(index: DataFrame, folder: str) -> DataFrame:
    """index plus payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature, from the stored bytes.

    A payload whose digest differs from its name raises ValueError.
    """

    def take(png: bytes, digest: str) -> tuple:
        stored = hashlib.sha256(png).hexdigest()
        if stored != digest:
            raise ValueError(f"{digest}: the stored bytes have digest {stored}")
        width, height, _ = read_header(png[:HEADER])
        payload = from_png(png)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(png), stored, features(payload, width, height)

    schema = "shard string, offset long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return index.join(_read(index, folder, schema, take, False), ["shard", "offset"])


def media_columns(docs: DataFrame) -> DataFrame:
    """Stores every text of docs (doc_id, text) and reads it back: a row for each row of docs.

    Null and empty texts: a payload of one row of blanks. Null doc_id and repeated rows: rows as any other. Very long texts are
    stored whole. Ties: equal payloads are one to a task. Empty table: no rows,
    no shard. Equal texts give equal digests, wherever they are stored. Extra columns are left out.
    """
    folder = scratch(docs.sparkSession, "media")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary"))
    return read_back(store(rows, folder), folder)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = scratch(spark, "media")
    index = store(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")), folder)
    return with_metadata(read_back(index, folder), folder).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "digest", "length", "width", "height", "bits"
    )
