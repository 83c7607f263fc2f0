"""Conflict-constrained best-fit packing of documents into sequences (operator 5)."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftglass.llm.common import SPACE, table
from driftglass.llm.mixing import word_count

#: Words in a sequence, rows that a shard has on average, and documents of one source that a bin takes.
CAPACITY, SHARD_ROWS, SAME_SOURCE = 2048, 2000, 3


class Bins:
    """Open bins in the order of what they have left. Each carries, as bitmaps over the shard's own numbering, the duplicate
    clusters that it holds and, for its sources, `same` planes: a source's bit in plane i says that more than i of its documents
    are in."""

    def __init__(self, capacity: int, same: int):
        self.capacity, self.same = capacity, same
        self.order: list[tuple[int, int]] = []
        self.sources: list[list[int]] = []
        self.clusters: list[int] = []
        self.filled: list[int] = []

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, offset) of the tightest bin that has room and no conflict: the search starts at the smallest remainder that
        fits and goes on to each next larger one; a new bin is opened where none is compatible."""
        s, c = 1 << source, 1 << cluster
        for at in range(bisect_left(self.order, (size, -1)), len(self.order)):
            left, b = self.order[at]
            if not self.clusters[b] & c and not self.sources[b][-1] & s:
                del self.order[at]
                break
        else:
            left, b = self.capacity, len(self.filled)
            self.sources.append([0] * self.same)
            self.clusters.append(0)
            self.filled.append(0)
        planes = self.sources[b]
        free = next(i for i in range(self.same) if not planes[i] & s)
        planes[free] |= s
        self.clusters[b] |= c
        offset, self.filled[b] = self.filled[b], self.filled[b] + size
        if left > size:
            insort(self.order, (left - size, b))
        return b, offset


def pieces(size: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, words) of the pieces of a document: full sequences and the rest; a document of no words is one empty piece."""
    yield from ((at, min(capacity, size - at)) for at in range(0, max(size, 1), capacity))


def pack_shard(rows: Iterable[tuple[int, int, object, object]], capacity: int = CAPACITY, same: int = SAME_SOURCE) -> list[tuple[int, int, int, int, int, int]]:
    """(row, piece, start, words, bin, offset) from (row, size, source, cluster), largest pieces first.

    Pieces of capacity fill a bin of their own. A null cluster conflicts with none; a null source is a source.
    """
    sources: dict[object, int] = {}
    clusters: dict[object, int] = {}
    todo = []
    for row, size, source, cluster in rows:
        s = sources.setdefault(source, len(sources))
        c = clusters.setdefault(("row", row) if cluster is None else ("cluster", cluster), len(clusters))
        todo += [(-n, row, k, at, s, c) for k, (at, n) in enumerate(pieces(size, capacity))]
    bins = Bins(capacity, same)
    return [(row, k, at, -n, *bins.place(-n, s, c)) for n, row, k, at, s, c in sorted(todo)]


def text_cluster(text: Column) -> Column:
    """A cluster for each text: equal but for case and white space."""
    return F.when(text.isNotNull(), F.md5(F.regexp_replace(F.lower(text), SPACE + "+", " ")))


def pack(docs: DataFrame, *, capacity: int = CAPACITY, same: int = SAME_SOURCE, shard_rows: int = SHARD_ROWS, cluster: Column | None = None) -> DataFrame:
    """doc_id, piece, start, n_words, bin_id, bin_offset: where each piece of each row of docs (doc_id, text, source) goes.

    Size: words between ASCII white space. `cluster`: which rows may not share a bin (text_cluster by default); at most `same`
    documents of a source share one. Rows are dealt to shards by hash whatever their source, cluster or length, only ids, sizes,
    sources and clusters travel, and each shard is packed by itself, which leaves about one half-full bin for each.

    Null text: size 0, one empty piece. Null source: a source of its own. Null doc_id: a row as any other, dealt out by the rest of
    the row. Repeated rows are each
    packed, in different bins as they are one cluster. Very long texts are cut into full
    sequences and a rest. Ties: equal residuals go to the bin that was opened first, equal pieces by row. Empty table: no rows. Extra
    columns are left out.
    """
    key = text_cluster(F.col("text")) if cluster is None else cluster
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), key.cast("string").alias("cluster"))
    shards = max(1, -(-docs.count() // shard_rows))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64(F.lit("pack"), F.coalesce("doc_id", F.xxhash64("cluster", "source", "size"))), F.lit(shards)))

    def one(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["doc_id", "size", "source", "cluster"], na_position="first").reset_index(drop=True)
        none = lambda x: None if pd.isna(x) else x
        got = pack_shard(((i, int(n), none(s), none(c)) for i, n, s, c in zip(range(len(shard)), shard["size"], shard.source, shard.cluster, strict=True)), capacity, same)
        out = pd.DataFrame(got, columns=["row", "piece", "start", "n_words", "bin", "bin_offset"])
        ids = shard.doc_id.astype("Int64").iloc[out.row].array
        return out.assign(doc_id=ids, bin_id=(f"{shard.shard.iloc[0]}-" + out.bin.astype(str)))[["doc_id", "piece", "start", "n_words", "bin_id", "bin_offset"]]

    return rows.groupBy("shard").applyInPandas(one, "doc_id long, piece long, start long, n_words long, bin_id string, bin_offset long")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
