"""Exact nearest vectors over int8 blocks: approximate products with a bound on their error decide which vectors are scored in double.

A block is a row of A_BLOCK vectors at most: their ids, their int8 components, and for each its scale and the length of what rounding
took from it. By Cauchy and Schwarz a query's product with a vector lies within |query| * that length of its product with the
rounded vector; so a vector whose upper end stays below the k-th best lower end is none of the k nearest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftglass.functions.vectors import dot
from driftglass.operators.lexical import top_k
from driftglass.operators.search import MOST_QUERY_BYTES
from driftglass.session import staged

#: Vectors of a block.
A_BLOCK = 1024
#: What the sums of products of unit-size numbers may be off by in 32 bits, for each component.
EPS = 2.0**-23
BLOCKS = "n int, dim int, ids binary, q binary, scales binary, errors binary"


def blocks(vectors: DataFrame, vec: str = "vec_id", column: str = "embedding") -> DataFrame:
    """int8 blocks of vectors (vec, column), staged. Rows without id or vector are left out; a block's vectors are of one length. A
    vector with a component that is null or no finite number gets an error beyond all bounds: it is always scored in double."""

    def pack(rows: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        odd = ~np.isfinite(rows).all(1)
        rows = np.where(odd[:, None], 0.0, rows)
        top = np.abs(rows).max(1, initial=0.0) / 127
        scale = np.where(top > 0, top, 1.0)
        q = np.clip(np.floor(rows / scale[:, None] + 0.5), -127, 127)
        error = np.sqrt(((rows - q * scale[:, None]) ** 2).sum(1)) * (1 + 1e-9)
        error[odd] = np.inf
        values = [len(ids), rows.shape[1], ids.tobytes(), q.astype(np.int8).tobytes(), scale.tobytes(), error.tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, [pa.int32()] * 2 + [pa.binary()] * 4, strict=True)], ["n", "dim", "ids", "q", "scales", "errors"])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), A_BLOCK):
                part = batch.slice(at, A_BLOCK)
                ids, sizes = part.column(0).to_numpy(), np.diff(part.column(1).offsets.to_numpy())
                flat = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(float)  # nulls become NaN
                start = np.cumsum(sizes) - sizes
                for size in np.unique(sizes):
                    own = np.flatnonzero(sizes == size)
                    yield pack(flat[start[own][:, None] + np.arange(size)], ids[own])

    rows = vectors.where(F.col(vec).isNotNull() & F.col(column).isNotNull()).select(F.col(vec).cast("long"), F.col(column).cast("array<double>"))
    return staged(rows.mapInArrow(made, BLOCKS), "int8-blocks")


def candidates(packed: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, lower, upper) of the vectors that may be among a query's k nearest (query_id, query_vector): of each task those
    whose upper end reaches the k-th best lower end of the task. Queries go to every task, as many at a time as MOST_QUERY_BYTES has room
    for."""
    dim = queries.agg(F.coalesce(F.max(F.size("query_vector")), F.lit(1))).first()[0]
    parts = max(1, -(-queries.count() // max(1, MOST_QUERY_BYTES // (8 * max(1, dim)))))
    out = None
    for part in range(parts):
        asked = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part).select(F.col("query_id").cast("long"), F.col("query_vector").cast("array<double>")).toArrow()
        names, matrix = asked["query_id"].to_numpy(), np.array(asked["query_vector"].to_pylist(), float).reshape(asked.num_rows, -1)
        sizes = np.sqrt((matrix * matrix).sum(1))

        def near(batches: Iterator[pa.RecordBatch], names: np.ndarray = names, matrix: np.ndarray = matrix, sizes: np.ndarray = sizes) -> Iterator[pa.RecordBatch]:
            held = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0))] * len(names)
            low = matrix.astype(np.float32)
            for batch in batches:
                for row in batch.to_pylist():  # a block's bytes; blocks are a few hundred KB
                    if row["dim"] != matrix.shape[1]:
                        continue  # no product with a query of another length
                    ids, scale, error = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["scales"]), np.frombuffer(row["errors"])
                    q = np.frombuffer(row["q"], np.int8).reshape(row["n"], row["dim"]).astype(np.float32)
                    mid = (q @ low.T) * scale[:, None]
                    lengths = np.sqrt((q.astype(float) ** 2).sum(1)) * scale
                    off = error[:, None] * sizes + (row["dim"] + 2) * EPS * lengths[:, None] * sizes
                    for j in range(len(names)):
                        upper, lower = mid[:, j] + off[:, j], mid[:, j] - off[:, j]
                        keep = upper >= _kth(held[j][1], k)
                        i, lo, up = np.append(held[j][0], ids[keep]), np.append(held[j][1], lower[keep]), np.append(held[j][2], upper[keep])
                        keep = up >= _kth(lo, k)
                        held[j] = i[keep], lo[keep], up[keep]
            counts = [len(h[0]) for h in held]
            if sum(counts):
                yield pa.record_batch([pa.array(np.repeat(names, counts)), *[pa.array(np.concatenate([h[c] for h in held])) for c in range(3)]], ["query_id", "vec_id", "lower", "upper"])

        found = packed.mapInArrow(near, "query_id long, vec_id long, lower double, upper double")
        out = found if out is None else out.unionByName(found)
    return out


def _kth(values: np.ndarray, k: int) -> float:
    return -np.inf if len(values) < k else float(np.partition(values, len(values) - k)[len(values) - k])


#: Pairs of a query and a candidate that are broadcast at most (24 bytes each); more are joined as any other table.
MOST_PAIRS = 1 << 20


def to_rescore(packed: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id), staged: the vectors whose upper end reaches the k-th best lower end of all."""
    found = staged(candidates(packed, queries, k), "int8-candidates")
    order = Window.partitionBy("query_id").orderBy(F.col("lower").desc())
    kth = found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") == k).select("query_id", F.col("lower").alias("least"))
    rows = found.join(F.broadcast(kth), "query_id", "left")  # a row a query, as many as were sent to the tasks
    return staged(rows.where(F.col("least").isNull() | (F.col("upper") >= F.col("least"))).select("query_id", "vec_id"), "int8-rescored")


def vector_top_k_quantised(packed: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, vec: str = "vec_id", column: str = "embedding", pairs: DataFrame | None = None) -> DataFrame:
    """(query_id, vec, score, rank) as search.vector_top_k() gives them: the exact k nearest of each query (query_id, query_vector) among
    vectors, whose blocks() are packed; ties by id. Only pairs of to_rescore() are scored in double; pairs: these, where they are known.

    Vectors of another length than the query are no candidates; null ids and vectors, as in blocks(), neither.
    """
    pairs = to_rescore(packed, queries, k) if pairs is None else pairs
    rows = vectors.select(F.col(vec).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("_v"))
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("query_vector").cast("array<double>").alias("_q"))
    pairs = F.broadcast(pairs) if pairs.count() <= MOST_PAIRS else pairs
    scores = rows.join(pairs, "vec_id").join(asked, "query_id").select("query_id", F.col("vec_id").alias(vec), dot(F.col("_v"), F.col("_q")).alias("score"))
    return top_k(scores, k, doc=vec)
