"""Floods and routes over links between nodes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftglass.session import staged


def both_ways(links: DataFrame) -> DataFrame:
    """(a, b) in either direction, once."""
    return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def flood(links: DataFrame, origins: DataFrame, ttl: int) -> DataFrame:
    """(origin, node, hops, via): what a flood that each node passes on once reaches within ttl hops, the origin at 0, and the
    neighbour that it came from (of several at once the least; none at the origin). A node that has it doesn't take it again, so it goes
    back over no link.

    One join for each hop; nodes that are reached already drop out, so the frontier, and not the graph, is what travels. Each
    hop is staged, and an empty one is the last.
    """
    edges = staged(both_ways(links), "links")
    seen = staged(origins.select(F.col("node").alias("origin"), "node", F.lit(0).alias("hops"), F.lit(None).cast(edges.schema["a"].dataType).alias("via")), "flood")
    frontier = seen
    for hop in range(1, ttl + 1):
        step = frontier.select("origin", F.col("node").alias("a")).join(edges, "a").groupBy("origin", F.col("b").alias("node")).agg(F.min("a").alias("via"))
        fresh = step.join(seen.select("origin", "node"), ["origin", "node"], "left_anti")
        frontier = staged(fresh.select("origin", "node", F.lit(hop).alias("hops"), "via"), "flood")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def routes_back(flooded: DataFrame) -> DataFrame:
    """(node, dst, via, hops): what each node learns from a flood() that it hears: the way to where it came from."""
    return flooded.where("hops > 0").select("node", F.col("origin").alias("dst"), "via", "hops")


def way_back(flooded: DataFrame, answers: DataFrame) -> DataFrame:
    """(origin, node, way): the nodes that a reply of answers (origin, node) passes, from the node to the origin, each sending it on by
    its own route. As many joins as the flood has hops; answers that it didn't reach have no row."""
    routes = flooded.select("origin", F.col("node").alias("_at"), F.col("via").alias("_via"), "hops")
    rows = answers.select("origin", "node", F.col("node").alias("_at"), F.array("node").alias("way"))
    first = rows.join(routes, ["origin", "_at"])
    arrived, going = first.where("hops = 0").select("origin", "node", "way"), first.where("hops > 0")
    most = going.agg(F.max("hops")).first()[0] or 0
    for _ in range(most):
        moved = going.select("origin", "node", F.col("_via").alias("_at"), F.array_append("way", F.col("_via")).alias("way")).join(routes, ["origin", "_at"])
        moved = staged(moved, "way")
        arrived, going = arrived.unionByName(moved.where("hops = 0").select("origin", "node", "way")), moved.where("hops > 0")
    return arrived


def learned_routes(heard: DataFrame, stale_s: int = 30) -> DataFrame:
    """(node, via, hops, at): the route to each node that packets heard (node, via, hops, at) teach in a batch: of the latest stale_s
    seconds the fewest hops, then the latest. The stream's own rule depends on the order of arrival: see streaming.jobs.learn_routes."""
    last = heard.groupBy("node").agg(F.max("at").alias("_last"))
    fresh = heard.join(last, "node").where(F.unix_timestamp("_last") - F.unix_timestamp("at") <= stale_s)
    best = F.min_by(F.struct("via", "hops", "at"), F.struct("hops", -F.unix_timestamp("at"), "via"))
    return fresh.groupBy("node").agg(best.alias("r")).select("node", "r.*")


def live_routes(routes: DataFrame, links: DataFrame, now: Column, expiry_s: int = 30) -> DataFrame:
    """Routes that are fresh and whose next hop is still a link."""
    return routes.where(F.unix_timestamp(now) - F.unix_timestamp("at") <= expiry_s).join(links.select(F.col("peer").alias("via")).distinct(), "via", "left_semi")


def delivery(packet: DataFrame, routes: DataFrame, self_id: int) -> DataFrame:
    """packet (msg_id, src_id, dst_id, ttl, seen_before) plus `fate`: own, duplicate, deliver, expired, forward or flood."""
    known = routes.select(F.col("node").alias("dst_id"), F.lit(True).alias("_known"))
    fate = (
        F.when(F.col("src_id") == self_id, "own").when(F.col("seen_before"), "duplicate").when(F.col("dst_id") == self_id, "deliver")
        .when(F.col("ttl") <= 1, "expired").when((F.col("dst_id") != 0) & F.col("_known"), "forward").otherwise("flood")
    )
    return packet.join(known, "dst_id", "left").withColumn("fate", fate).drop("_known")


def hops_travelled(flags: Column, ttl: Column) -> Column:
    """From the first time to live, which flags carry (4 where 0), and the present one."""
    return F.greatest(F.lit(1), F.when(flags == 0, 4).otherwise(flags) - ttl + 1)


def node_of_link(links: DataFrame, routes: DataFrame) -> DataFrame:
    """links (peer: a link's name) with node_id: the node that a route (node, via_peer) reaches over it (the smallest of several),
    else the name read as a hexadecimal number of 32 bits, else 0, as for the names `flood` and `local`."""
    by = routes.groupBy(F.col("via_peer").alias("peer")).agg(F.min("node").alias("_node"))
    digits = F.regexp_extract("peer", "^[ ]*(?:0[xX])?([0-9a-fA-F]{1,8})", 1)
    parsed = F.conv(F.nullif(digits, F.lit("")), 16, 10).cast("long")
    own = F.when(F.col("peer").isin("flood", "local"), F.lit(0)).otherwise(F.coalesce("_node", parsed, F.lit(0)))
    return links.join(by, "peer", "left").withColumn("node_id", own.cast("long")).drop("_node")


def with_routes(peers: DataFrame, routes: DataFrame) -> DataFrame:
    """peers (node_id, hops, via) with the present route's hops and via laid over; what was last known stays where there is none."""
    now = routes.select(F.col("node").alias("node_id"), F.col("hops").alias("_hops"), F.col("via").alias("_via"))
    rows = peers.join(now, "node_id", "left")
    return rows.withColumns({"hops": F.coalesce("_hops", "hops"), "via": F.coalesce("_via", "via")}).drop("_hops", "_via")


def cut_polyline(points: Column, fraction: Column) -> Column:
    """struct(x, y): the point at a fraction (0 to 1) of the length of an array of struct(x, y)."""
    n = F.size(points)
    length = lambda i: F.hypot(points[i + 1]["x"] - points[i]["x"], points[i + 1]["y"] - points[i]["y"])
    goal = F.least(F.lit(1.0), F.greatest(F.lit(0.0), fraction)) * polyline_length(points)
    # The goal is carried along: a step that computes it would go through the whole line.
    start = F.struct(F.lit(0.0).alias("gone"), goal.alias("goal"), F.lit(None).cast("struct<x:double,y:double>").alias("at"))

    def step(a: Column, i: Column) -> Column:
        size = length(i)
        part = F.when(size > 0, (a["goal"] - a["gone"]) / size).otherwise(0.0)
        between = lambda c: (points[i][c] + part * (points[i + 1][c] - points[i][c])).alias(c)
        here = F.when(a["at"].isNull() & (a["gone"] + size >= a["goal"]), F.struct(between("x"), between("y"))).otherwise(a["at"])
        return F.struct((a["gone"] + size).alias("gone"), a["goal"].alias("goal"), here.alias("at"))

    last = F.struct(points[n - 1]["x"].cast("double").alias("x"), points[n - 1]["y"].cast("double").alias("y"))
    found = F.aggregate(F.sequence(F.lit(0), n - 2), start, step, lambda a: a["at"])
    return F.when(n >= 2, F.coalesce(found, last)).when(n == 1, last)


def _shares(xs: pd.Series, ys: pd.Series) -> pd.Series:
    """Running lengths of lines over their whole lengths, in one pass over each line."""
    out = []
    for x, y in zip(xs, ys, strict=True):
        if x is None or y is None:
            out.append(None)
            continue
        x, y = np.asarray(x, float), np.asarray(y, float)
        gone = np.concatenate([[0.0], np.cumsum(np.hypot(np.diff(x), np.diff(y)))])[: len(x)]
        out.append(gone / gone[-1] if len(x) and gone[-1] > 0 else np.zeros(len(x)))
    return pd.Series(out, dtype=object)


def stops(points: Column) -> Column:
    """The share of a polyline's length at which each of its points lies; 0 for a line without length."""
    return F.pandas_udf(_shares, "array<double>")(F.transform(points, lambda p: p["x"].cast("double")), F.transform(points, lambda p: p["y"].cast("double")))


def polyline_length(points: Column) -> Column:
    """Of an array of struct(x, y)."""
    steps = F.transform(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), lambda p, i: F.hypot(p["x"] - points[i]["x"], p["y"] - points[i]["y"]))
    return F.aggregate(steps, F.lit(0.0), lambda a, s: a + s)


def layers(reach: DataFrame, width: float = 100.0) -> DataFrame:
    """reach (origin, node, hops) plus x and y: a band for each hop, nodes spread evenly in it."""
    own = Window.partitionBy("origin", "hops")
    n = F.count(F.lit(1)).over(own)
    return reach.withColumns({"x": (F.row_number().over(own.orderBy("node")) - 0.5) / n * width, "y": F.col("hops").cast("double")})
