"""Connected components: contraction within tasks, then alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftglass.llm.common import few, released, staged, with_group

MAX_ROUNDS = 60
#: Edges that a task contracts at a time.
A_TIME = 1 << 18


def least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, the smallest node that it reaches) for the edges a, b: minima over edges, then over the minima themselves."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    top = np.arange(len(nodes))
    while True:
        low = np.minimum(top[u], top[v])
        new = top.copy()
        np.minimum.at(new, top[u], low)
        np.minimum.at(new, top[v], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == top).all():
            return nodes, nodes[top]
        top = new


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (u > v) that connect what edges (a, b) connect: each task hangs the nodes that its own edges connect, A_TIME of them
    at a time, on the smallest. No more edges than there were; where few tasks hold the edges, little is left to do."""

    def hang(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def close() -> pa.RecordBatch:
            a, b = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            node, top = least_reached(a, b)
            held.clear()
            keep = node != top
            return pa.record_batch([pa.array(node[keep]), pa.array(top[keep])], ["u", "v"])

        n = 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            n += len(batch)
            if n >= A_TIME:
                n = 0
                yield close()
        if held:
            yield close()

    return edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").mapInArrow(hang, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of edges (a long, b long): component is the smallest node that it reaches. An edge of a
    node with itself names no node; nulls are no edges. edges are read twice: staged, or cheap to compute.

    First each task contracts its own edges. Then a round hangs each node's larger neighbours on its smallest one, and the smaller
    ones likewise. Both are a grouped minimum and an equi-join by parts of a node's neighbours (see with_group()), so that a hub's
    neighbours are never gathered, nor joined, in one group. Rounds grow with the logarithm of a component's
    diameter. Ends when a round changes nothing.
    """

    def sums(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def with_least(rows: DataFrame) -> DataFrame:
        return with_group(rows, "u", F.col("v"), m=(F.min, F.col("v")))

    edges = edges.where("a is not null and b is not null")
    n = edges.count()
    now = staged(few(contracted(few(edges, n)), n), "cc")
    mark = sums(now)
    for _ in range(MAX_ROUNDS):
        if not mark[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        small = with_least(large).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        before, now = now, staged(few(small.select("e.u", "e.v").where("u <> v").distinct(), n), "cc")
        released(before)
        if (found := sums(now)) == mark:
            break
        mark = found
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
