"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks (operator 9).

Everything here is DataFrame operations. Rows of a source are dealt to shards by a hash of their id, and no window holds more than
a shard of a source, or CHUNK shards, or the quotients round the last seat of a source, which are narrowed down to NARROW by
aggregates alone (equal quotients, which no threshold parts, stay together). Sources themselves are ranked in one window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftglass.llm.common import SPACE, apart, few, kept, released, staged, table

#: Words in a block, rows in a shard, and the weights that sources get in turn.
BLOCK, SHARD_ROWS, WEIGHTS, CAP, SEED = 32, 256, (1, 2, 3), 3, "mix-1"
#: Quotients of a source that a window ranks, thresholds that one pass tries, passes at most, and shards that a window runs over.
NARROW, THRESHOLDS, PASSES, CHUNK = 4096, 32, 6, 4096
#: Sources whose sums are broadcast at most; more are joined as any other table.
MOST_SOURCES = 50_000


def _seats(df: DataFrame, within: Sequence[str], votes: str, total: str, seats: str, tie: Sequence[Column]) -> DataFrame:
    """Adds `got`: the seats of each row after `seats` of them went to the highest quotients votes / (2k + 1) of its group; for
    groups of a few parties, as sources are.

    A party's seats lie within n * share / 2 + 1/2 of its exact quota, n parties being in the group; so those below that span
    are certain, those above it impossible, and only the quotients of the span are made and ranked: a number of rows in
    proportion to the parties.
    """
    group = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    exact = F.col(seats) * F.col(votes) / F.col(total)
    span = F.ceil(F.count(F.lit(1)).over(group) * F.col(votes) / F.col(total) / 2) + 2
    df = df.withColumns({"_q": F.when(F.col(total) > 0, exact).otherwise(0.0), "_span": F.when(F.col(total) > 0, span).otherwise(1)})
    df = df.withColumn("_sure", F.greatest(F.lit(0), F.floor("_q") - F.col("_span")))
    df = df.withColumn("_open", F.col(seats) - F.sum("_sure").over(group))
    k = df.withColumn("_k", F.explode(F.sequence(F.col("_sure"), F.ceil("_q") + F.col("_span"))))
    rank = F.row_number().over(group.orderBy((F.col(votes) / (2 * F.col("_k") + 1)).desc(), *tie))
    k = k.withColumn("_won", ((rank <= F.col("_open")) & (F.col(votes) > 0)).cast("long"))
    names = [c for c in df.columns if not c.startswith("_")]
    return k.groupBy(*names, "_sure").agg(F.sum("_won").alias("_more")).select(*names, (F.col("_sure") + F.col("_more")).alias("got"))


def _shard_seats(cells: DataFrame) -> DataFrame:
    """cells (rank, shard, cell, source_size, source_blocks, …) plus `got`: the seats of each shard after source_blocks of them went
    to the highest quotients cell / (2k + 1) of its source, ties by shard.

    A threshold t gives a shard the seats floor((cell / t + 1) / 2), those whose quotient is t or more. Two thresholds hold the last
    seat's quotient between them; a pass tries THRESHOLDS of them at once, until no source has more than NARROW quotients in
    between. What lies above is certain, and only what lies between is made and ranked.
    """
    seats = lambda t: F.floor((F.col("cell") / t + 1) / 2)
    voting = cells.where("cell > 0")
    n = F.count(F.lit(1))
    by = voting.groupBy("rank").agg(n.alias("n"), F.max("cell").alias("top"), F.first("source_size").alias("all"), F.first("source_blocks").alias("blocks")).where("blocks > 0")
    lo = F.col("all") / (2 * F.col("blocks") + F.col("n")) * (1 - 1e-9)
    hi = F.least(F.col("top"), F.when(2 * F.col("blocks") > F.col("n"), F.col("all") / (2 * F.col("blocks") - F.col("n"))).otherwise(F.col("top"))) * (1 + 1e-9)
    bounds = staged(by.select("rank", "blocks", "n", lo.alias("lo"), F.greatest(hi, lo).alias("hi")), "mix-bounds")
    for _ in range(PASSES):
        if (bounds.agg(F.max("n")).first()[0] or 0) <= NARROW:
            break
        at = [F.col("lo") * F.pow(F.col("hi") / F.col("lo"), F.lit(i / THRESHOLDS)) for i in range(THRESHOLDS + 1)]
        tried = voting.join(bounds, "rank").groupBy("rank", "blocks", "lo", "hi").agg(F.array(*[F.sum(seats(t)) for t in at]).alias("sums"))
        enough = F.size(F.filter("sums", lambda x: x >= F.col("blocks")))  # sums fall as thresholds rise
        i = F.least(F.lit(THRESHOLDS), F.greatest(F.lit(1), enough))
        t = F.array(*at)
        narrower = tried.select("rank", "blocks", (F.get("sums", i - 1) - F.get("sums", i)).alias("n"), F.get(t, i - 1).alias("lo"), F.get(t, i).alias("hi"))
        before, bounds = bounds, staged(narrower, "mix-bounds")
        released(before)
    rows = voting.select("rank", "shard", "cell").join(bounds.select("rank", "blocks", "lo", "hi"), "rank").withColumn("sure", seats(F.col("hi")))
    open_ = rows.groupBy("rank").agg((F.first("blocks") - F.sum("sure")).alias("open"))
    k = rows.where(seats(F.col("lo")) > F.col("sure")).withColumn("k", F.explode(F.sequence(F.col("sure"), seats(F.col("lo")) - 1))).join(open_, "rank")
    place = F.row_number().over(Window.partitionBy("rank").orderBy((F.col("cell") / (2 * F.col("k") + 1)).desc(), "shard"))
    more = k.withColumn("place", place).where(F.col("place") <= F.col("open")).groupBy("rank", "shard").agg(n.alias("more"))
    got = rows.select("rank", "shard", "sure").join(more, ["rank", "shard"], "left").select("rank", "shard", (F.col("sure") + F.coalesce("more", F.lit(0))).alias("got"))
    return cells.join(got, ["rank", "shard"], "left").withColumn("got", F.coalesce("got", F.lit(0)))


def _running(df: DataFrame, by: Sequence[str], shard: str, value: str, name: str) -> DataFrame:
    """df, one row for each shard of a group, plus the sum of `value` over the group's earlier shards; chunk by chunk."""
    chunk, base = apart("chunk"), apart("base")
    df = df.withColumn(chunk, F.floor(F.col(shard) / CHUNK))
    sums = df.groupBy(*by, chunk).agg(F.sum(value).alias(base))
    sums = sums.withColumn(base, F.coalesce(F.sum(base).over(Window.partitionBy(*by).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.coalesce(F.sum(value).over(Window.partitionBy(*by, chunk).orderBy(shard).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    keys = [apart(c) for c in by]
    sums = sums.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col(chunk).alias(chunk + "_"), base)
    same = F.col(chunk) == F.col(chunk + "_")
    for c, k in zip(by, keys, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(k))
    return df.withColumn(name, own).join(sums, same).withColumn(name, F.col(name) + F.col(base)).drop(chunk, chunk + "_", base, *keys)


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, rank, target) from (source, size).

    Sources by code point, null last, weigh as `weights` in turn and share all words; a target stops at cap times the
    source's size, and the excess goes to the others by weight until none is above: target = least(cap, weight * level),
    where the level follows from the sources sorted by cap / weight.
    """
    everything = Window.partitionBy(F.lit(0))
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by = by.withColumn("rank", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())))
    by = by.withColumns({
        "w": F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("long"),
        "cap": F.col("source_size") * cap,
    })
    up = everything.orderBy(F.col("cap") / F.col("w"), "rank")
    by = by.withColumns({
        "capped": F.coalesce(F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "rest": F.sum("w").over(up.rowsBetween(0, Window.unboundedFollowing)),
        "all": F.sum("source_size").over(everything),
    })
    by = by.withColumn("level", (F.col("all") - F.col("capped")) / F.col("rest"))
    first = F.first(F.when(F.col("level") * F.col("w") < F.col("cap"), F.col("level")), ignorenulls=True)
    by = by.withColumn("level", first.over(up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("w") * F.col("level"), F.col("cap").cast("double")))
    return by.select("source", "source_size", "rank", "all", target.alias("target"))


def word_count(text: Column) -> Column:
    """The number of runs of characters other than ASCII white space: splits at such space, less the empty ends."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE + "+")
    ends = F.coalesce(text, F.lit("")).rlike(f"^{SPACE}").cast("int") + F.coalesce(text, F.lit("")).rlike(rf"{SPACE}\z").cast("int")
    return F.when(F.coalesce(text, F.lit("")).rlike(f"^{SPACE}*\\z"), F.lit(0)).otherwise(F.size(parts) - ends).cast("long")


def _row_key() -> Column:
    """What tells rows of documents apart: a digest of id, source and text, nulls included."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in ("doc_id", "source", "text")]
    return F.md5(F.concat_ws("\0", *parts))


def mix_sources(docs: DataFrame, *, seed: str = SEED, block: int = BLOCK, shard_rows: int = SHARD_ROWS, weights: Sequence[int] = WEIGHTS, cap: int = CAP, row: str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row of docs (doc_id, text, source; other columns are left out, but
    for `row`, which is carried along where it is named).

    1. Sizes are counted once and kept. 2. targets() shares all words among the sources. 3. Blocks of `block` words go to
    the sources, then each source's blocks to its shards, by highest Sainte-Laguë quotient. 4. A shard takes its rows in the
    order of a seeded hash, over and over, until its blocks are used up; the last block may end inside a text. A shard stops at
    `cap` times its words: where its last block would go beyond, the rest of that block is taken by nobody.

    Null text: size 0, nothing taken. Null source: a source of its own, the last. Null doc_id: a row as any other, dealt to its
    shard by its text. Rows that repeat a doc_id each count, and are taken one after the other. Very long texts count whole, and may be
    taken in part. Ties among quotients go by rank and shard, among rows by id and size. Empty table: no rows. Reruns give
    the same rows.
    """
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("~"), F.md5(F.coalesce("text", F.lit("")))))
    key = F.md5(F.concat(name, F.lit(":" + seed)))
    also = [row] if row else []
    sizes = kept(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("key"), *also))
    n_shards = max(1, -(-sizes.count() // shard_rows))
    sizes = sizes.withColumn("shard", F.conv(F.substring("key", 1, 8), 16, 10).cast("long") % F.lit(n_shards))
    by = targets(sizes, weights, cap).withColumn("blocks", F.floor(F.col("all") / block + 0.5))
    by = by.withColumn("voted", F.sum("target").over(Window.partitionBy(F.lit(0))))
    by = _seats(by, [], "target", "voted", "blocks", [F.col("rank")]).withColumnRenamed("got", "source_blocks")
    cells = sizes.groupBy("source", "shard").agg(F.sum("size").alias("cell"))
    known = by.select(F.col("source").alias("_s"), "source_size", "rank", "target", "source_blocks")
    cells = cells.join(known, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    cells = _shard_seats(staged(few(cells, n_shards), "mix-cells"))
    cells = cells.withColumn("quota", F.least(F.col("got") * block, F.col("cell") * cap))
    cells = cells.withColumn("rounds", F.when(F.col("cell") > 0, F.floor(F.col("quota") / F.col("cell"))).otherwise(F.lit(0)))
    cells = cells.select(F.col("source").alias("_s"), F.col("shard").alias("_h"), "source_size", "target", "rounds", (F.col("quota") - F.col("rounds") * F.col("cell")).alias("left"))
    rows = sizes.join(cells, F.col("source").eqNullSafe(F.col("_s")) & (F.col("shard") == F.col("_h")))
    before = Window.partitionBy("source", "shard").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.coalesce(F.sum("size").over(before), F.lit(0))))
    return rows.select(*also, "doc_id", "source", "size", "source_size", "target", (F.col("rounds") * F.col("size") + part).cast("long").alias("taken"))


def _whole_copies(mix: DataFrame, rows: int, shard_rows: int, cap: int) -> DataFrame:
    """(row, copies) for the `rows` rows of mix_sources(): taken / size, rounded, and then evened out.

    A source whose rounding loses or adds words of at least two texts of its mean size gives them to, or takes them from, further
    whole texts: what was lost by long texts (more than twice the mean) goes to long ones that fit, all the rest to short ones,
    so that the source comes within about a mean text of its words if it has short texts left. Texts are met in an order by
    hash, shard by shard.
    """
    mix = mix.where("size > 0").select("row", "source", "size", "taken", F.floor(F.col("taken") / F.col("size") + 0.5).cast("int").alias("copies"))
    mix = staged(few(mix, rows, 100_000), "mix-rounded")
    lost = F.col("taken") - F.col("copies") * F.col("size")
    by = mix.groupBy("source").agg(F.sum(lost).alias("lack"), (2 * F.avg("size")).alias("most"), F.floor(F.sum("taken") / F.sum("size")).alias("even"))
    by = by.withColumn("sign", F.when(F.abs("lack") < F.col("most"), 0).otherwise(F.signum("lack")).cast("int")).withColumnRenamed("source", "_s")
    by = staged(by.coalesce(1), "mix-lack")
    sent = F.broadcast if by.count() <= MOST_SOURCES else lambda df: df
    own = mix.join(sent(by), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    may = F.when(F.col("sign") > 0, (F.col("copies") <= F.col("even")) & (F.col("copies") < cap)).otherwise((F.col("sign") < 0) & (F.col("copies") > F.col("even")))
    shards = max(1, -(-rows // shard_rows))
    own = own.withColumns({"may": may, "long": F.col("size") > F.col("most"), "hash": F.xxhash64(F.lit(11), "row")})
    own = own.withColumns({"step": F.when(F.col("may"), F.col("size")).otherwise(0), "shard": F.pmod("hash", F.lit(shards))})
    cells = _running(own.groupBy("source", "long", "shard").agg(F.sum("step").alias("cell")), ["source", "long"], "shard", "cell", "from")
    cells = cells.select(F.col("source").alias("_s"), F.col("long").alias("_l"), F.col("shard").alias("_h"), "from")
    own = own.join(cells, F.col("source").eqNullSafe(F.col("_s")) & (F.col("long") == F.col("_l")) & (F.col("shard") == F.col("_h"))).drop("_s", "_l", "_h")
    before = Window.partitionBy("source", "long", "shard").orderBy("hash", "row", "size").rowsBetween(Window.unboundedPreceding, -1)
    own = staged(few(own.withColumn("before", F.col("from") + F.coalesce(F.sum("step").over(before), F.lit(0))), rows, 100_000), "mix-order")
    long = own.where("long").groupBy("source").agg(F.sum(lost).alias("lost")).withColumnRenamed("source", "_s")
    out = own.join(sent(long), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    room = F.least(F.abs("lack"), F.col("sign") * F.coalesce("lost", F.lit(0)))
    out = out.withColumn("far", F.col("may") & F.col("long") & (F.col("before") + F.col("size") <= room))
    gone = out.groupBy("source").agg(F.sum(F.when(F.col("far"), F.col("size")).otherwise(0)).alias("gone")).withColumnRenamed("source", "_s")
    out = out.join(sent(gone), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    near = F.col("may") & ~F.col("long") & (F.col("before") + F.col("size") / 2 <= F.abs("lack") - F.col("gone"))
    return out.select("row", (F.col("copies") + F.when(F.col("far") | near, F.col("sign")).otherwise(0)).alias("copies"))


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """docs, with its columns, as the mix has them: a row comes taken / size times, rounded, so that texts stay whole, and what the
    rounding loses of a source's words goes to further texts of it (see _whole_copies()).

    Rows of size 0 (null, empty or blank texts) don't come. Null source and null doc_id: as any other. Rows of one doc_id with other
    texts or sources are rows of their own; rows equal in all three come as often as the mix takes them together, with the further
    columns of one of them. Very long texts stay whole. Empty table: no rows. Columns of docs may have any names.
    """
    i = apart("row")
    keyed = docs.withColumn(i, _row_key())
    mix = mix_sources(keyed, row=i, **settings).withColumnRenamed(i, "row")
    copies = _whole_copies(mix, docs.count(), settings.get("shard_rows", SHARD_ROWS), settings.get("cap", CAP))
    n = apart("copies")
    copies = copies.groupBy(F.col("row").alias(i)).agg(F.sum("copies").alias(n)).where(F.col(n) > 0)
    rows = keyed.dropDuplicates([i]).join(copies, i)
    return rows.withColumn(i, F.explode(F.sequence(F.lit(1), F.col(n).cast("int")))).select(*docs.columns)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
