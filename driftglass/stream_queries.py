"""Queries of the streaming jobs that keep state by timers, read binary captures, and merge into keyed tables, and of tables that are
laid out for their keys; the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftglass.functions import codec
from driftglass.mesh_queries import WHOLE, _frame_fields, _framed, _texts_of
from driftglass.queries import ORACLES, _stream, query
from driftglass.session import scratch, table
from driftglass.sources import capture, layouts
from driftglass.streaming import jobs, leases, upserts


def _in_epochs(spark: SparkSession, rows: DataFrame, epoch: Column, job: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a streaming job makes of rows that arrive epoch by epoch, each in micro-batches of its own."""
    root, n = scratch(spark, "stream"), spark.sparkContext.defaultParallelism
    rows = rows.withColumn("_epoch", epoch)
    for r in rows.select("_epoch").distinct().orderBy("_epoch").collect():  # years or the like
        rows.where(F.col("_epoch").eqNullSafe(r[0])).drop("_epoch").repartition(n).write.mode("append").parquet(f"{root}/in")
    own = leases.stateful_session(spark)
    source = own.readStream.schema(rows.drop("_epoch").schema).option("maxFilesPerTrigger", n).parquet(f"{root}/in")
    job(source).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out")


_LIVES = """n AS (SELECT *, lag(ts) OVER w AS before, lead(ts) OVER w AS after FROM c WINDOW w AS (PARTITION BY key, member ORDER BY ts)),
wm AS (SELECT max(ts) - {late} AS wm FROM c),
e AS (SELECT key, member, 'start' AS event, ts AS "at" FROM n WHERE before IS NULL OR ts - before > before_lease
  UNION ALL SELECT key, member, 'end', ts + lease FROM n, wm WHERE after - ts > lease OR (after IS NULL AND ts + lease < wm))"""


_CLAIMS = f"""c AS (SELECT DISTINCT l_partkey AS key, l_suppkey AS member, l_shipdate::TIMESTAMP AS ts, INTERVAL 90 DAY AS lease, INTERVAL 90 DAY AS before_lease FROM lineitem),
{_LIVES.format(late="INTERVAL 9612 HOUR")}"""


def _claim_events(spark: SparkSession, d: str) -> DataFrame:
    """Claims of a supplier that it has a part, each good for 90 days, year by year; they may come 400 days and a half late."""
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("doc_id"), F.col("l_suppkey").alias("node_id"), F.col("l_shipdate").cast("timestamp").alias("ts"))
    return _in_epochs(spark, rows, F.year("ts"), lambda s: leases.expiring_claims(s, 90 * 86_400, late="9612 hours"))


@query(f'WITH {_CLAIMS} SELECT key, member, event, "at" FROM e')
def claim_expiry_stream(spark: SparkSession, d: str) -> DataFrame:
    return _claim_events(spark, d).withColumn("at", F.col("at").cast("timestamp_ntz"))


@query(f"""WITH {_CLAIMS} SELECT key, member, "at" FROM (SELECT *, row_number() OVER (PARTITION BY key, member ORDER BY "at" DESC, event DESC) AS k FROM e) WHERE k = 1 AND event = 'start'""")
def claim_holders_stream(spark: SparkSession, d: str) -> DataFrame:
    """Who is left once the stream has ended: claims whose time was not up by the last watermark."""
    return leases.holders_at(_claim_events(spark, d)).withColumn("at", F.col("at").cast("timestamp_ntz"))


#: A user's events are a node's beacons; a purchase is one that others passed on. Hours stand for the protocol's seconds.
_BEACONS = f"""b AS (SELECT user_id AS key, user_id AS member, date_trunc('milliseconds', ts) AS ts, min(CASE event_type WHEN 'purchase' THEN INTERVAL 45 HOUR ELSE INTERVAL 13 HOUR END) AS l FROM events WHERE user_id IS NOT NULL GROUP BY ALL),
c AS (SELECT key, member, ts, l AS lease, lag(l) OVER (PARTITION BY key ORDER BY ts) AS before_lease FROM b),
{_LIVES.format(late="INTERVAL 1000 MINUTE")}"""


@query(f'WITH {_BEACONS} SELECT key AS node_id, event, "at" FROM e')
def liveness_stream(spark: SparkSession, d: str) -> DataFrame:
    hops = F.when(F.col("event_type") == "purchase", 3).otherwise(1)
    rows = table(spark, d, "events").select(F.col("user_id").alias("node_id"), hops.alias("hops"), F.col("ts").cast("timestamp").alias("ts"))
    events = _in_epochs(spark, rows, F.weekofyear("ts"), lambda s: leases.liveness(s, 13 * 3600, 45 * 3600, late="1000 minutes"))
    return events.select(F.col("key").alias("node_id"), "event", F.col("at").cast("timestamp_ntz").alias("at"))


#: A user's events are what a peer's catalog is asked by: a purchase teaches something, a signup says that there is nothing; hours stand
#: for the protocol's seconds. The fold carries (since, tries, done) and what was asked, as tries * 10^13 + time.
_SYNC = """e AS (SELECT user_id AS peer, list({'ms': epoch_us(ts) // 1000, 'k': CASE event_type WHEN 'purchase' THEN 'learned' WHEN 'signup' THEN 'empty' ELSE 'tick' END}
    ORDER BY ts, CASE event_type WHEN 'purchase' THEN 'learned' WHEN 'signup' THEN 'empty' ELSE 'tick' END) AS es FROM events GROUP BY 1),
f AS (SELECT peer, list_reduce(
    list_prepend({'ms': 0::BIGINT, 'k': '', 'since': es[1].ms, 'tries': 0::BIGINT, 'done': false, 'asked': []::BIGINT[]}, list_transform(es, lambda x: {'ms': x.ms, 'k': x.k, 'since': 0::BIGINT, 'tries': 0::BIGINT, 'done': false, 'asked': []::BIGINT[]})),
    lambda a, b: CASE WHEN b.k = 'learned' THEN {'ms': b.ms, 'k': '', 'since': b.ms, 'tries': 0::BIGINT, 'done': false, 'asked': a.asked}
      WHEN b.k = 'empty' THEN {'ms': b.ms, 'k': '', 'since': a.since, 'tries': a.tries, 'done': true, 'asked': a.asked}
      WHEN NOT a.done AND a.tries < 4 AND b.ms - a.since >= CASE WHEN a.tries > 0 THEN 32400000 ELSE 18000000 END
        THEN {'ms': b.ms, 'k': '', 'since': b.ms, 'tries': a.tries + 1, 'done': false, 'asked': list_append(a.asked, (a.tries + 1) * 10000000000000 + b.ms)}
      ELSE {'ms': b.ms, 'k': '', 'since': a.since, 'tries': a.tries, 'done': a.done, 'asked': a.asked} END).asked AS asked FROM e)"""


@query(f'WITH {_SYNC} SELECT peer, (x // 10000000000000)::INT AS attempt, make_timestamp((x % 10000000000000) * 1000) AS "at" FROM (SELECT peer, unnest(asked) AS x FROM f)')
def sync_requests_stream(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "learned").when(F.col("event_type") == "signup", "empty").otherwise("tick")
    rows = table(spark, d, "events").select(F.col("user_id").alias("peer"), kind.alias("kind"), F.col("ts").cast("timestamp").alias("ts"))
    asked = _stream(spark, rows, lambda s: jobs.sync_requests(s, 5 * 3600, 9 * 3600))
    return asked.withColumn("at", F.date_trunc("MILLISECOND", "at").cast("timestamp_ntz"))


@query("""WITH f AS (SELECT l_suppkey AS link, l_orderkey::VARCHAR AS packet_key, l_linenumber AS idx, l_shipdate AS ts FROM lineitem),
b AS (SELECT link, packet_key FROM (SELECT link, packet_key, min(ts) AS t FROM f GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY link ORDER BY t DESC, packet_key DESC) <= 64)
SELECT link, packet_key, count(*) AS frames, min(idx) AS first FROM f JOIN b USING (link, packet_key) GROUP BY ALL""")
def pending_packets(spark: SparkSession, d: str) -> DataFrame:
    """Of each link's unfinished packets those that began last."""
    frames = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("link"), F.col("l_orderkey").cast("string").alias("packet_key"), F.col("l_linenumber").alias("idx"), F.lit(9).alias("cnt"), F.col("l_shipdate").cast("timestamp").alias("ts"))
    return jobs.within_pending(frames).groupBy("link", "packet_key").agg(F.count(F.lit(1)).alias("frames"), F.min("idx").alias("first"))


def _from_captures(spark: SparkSession, rows: DataFrame, job: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a streaming job makes of rows (link, ts, data) that it reads from capture files."""
    root = scratch(spark, "captures")
    capture.captured(rows, f"{root}/in")
    job(capture.captures(spark, f"{root}/in")).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out")


@query("SELECT DISTINCT user_id * 1000 + floor(value)::BIGINT AS msg_id FROM events")
def capture_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Message ids that come several times in the captures, once each."""
    rows = table(spark, d, "events").select(F.col("user_id").alias("link"), "ts", codec.unsigned(F.col("user_id") * 1000 + F.floor("value"), 8).alias("data"))
    seen = lambda s: jobs.without_duplicates(s.select(F.conv(F.hex("data"), 16, 10).cast("long").alias("msg_id"), "ts"), within="60 days")
    return _from_captures(spark, rows, seen).select("msg_id")


@query(WHOLE)
def capture_reassembly(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts through frames in capture files, each document on a link of its own."""
    rows = _framed(spark, d).select(F.col("doc_id").alias("link"), F.timestamp_seconds(F.lit(1_700_000_000)).alias("ts"), "data")
    return _texts_of(_from_captures(spark, rows, lambda s: jobs.reassembled_packets(_frame_fields(s))))


@query("SELECT user_id % 5 AS link, count(*) AS frames, sum(octet_length(encode(props)))::BIGINT AS bytes, min(date_trunc('milliseconds', ts)) AS first, max(date_trunc('milliseconds', ts)) AS last FROM events GROUP BY 1")
def capture_summary(spark: SparkSession, d: str) -> DataFrame:
    """Captures read in one batch."""
    root = scratch(spark, "captures")
    capture.captured(table(spark, d, "events").select((F.col("user_id") % 5).alias("link"), "ts", F.encode("props", "UTF-8").alias("data")), root)
    by = capture.captures(spark, root, stream=False).groupBy("link").agg(F.count(F.lit(1)).alias("frames"), F.sum(F.octet_length("data")).alias("bytes"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return by.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first", "last")})


@query(ORACLES["upsert_log"])
def upsert_keyed(spark: SparkSession, d: str) -> DataFrame:
    """Events merged into a table of users, week by week."""
    rows = table(spark, d, "events").select("user_id", "event_id", F.floor("value").alias("version"), F.weekofyear("ts").alias("week"))
    root, n = scratch(spark, "upserts"), spark.sparkContext.defaultParallelism
    for r in rows.select("week").distinct().orderBy("week").collect():
        rows.where(F.col("week") == r["week"]).drop("week").repartition(n).write.mode("append").parquet(f"{root}/in")
    users = upserts.KeyedTable(f"{root}/users", rows.drop("week").schema, "user_id", "version", "event_id")
    stream = spark.readStream.schema(users.schema).option("maxFilesPerTrigger", n).parquet(f"{root}/in")
    jobs.periodically(stream, "reconcile", users.write, f"{root}/state", once=True).awaitTermination()
    users.vacuum(spark)
    return users.rows(spark)


@query("SELECT o_orderpriority AS priority, count(*) AS items, round(sum(l_extendedprice), 2) AS price FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def keyed_join(spark: SparkSession, d: str) -> DataFrame:
    """Orders and their items, joined where they lie."""
    n = 8
    orders = layouts.keyed(table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("priority")), "key", n, "orders")
    items = layouts.keyed(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_extendedprice").alias("price")), "key", n, "items")
    rows = spark.table(orders).hint("merge").join(spark.table(items), "key")
    return rows.groupBy("priority").agg(F.count(F.lit(1)).alias("items"), F.round(F.sum("price"), 2).alias("price"))


@query("SELECT l_orderkey AS key, l_linenumber AS line, l_partkey AS part FROM lineitem WHERE l_orderkey IN (SELECT item_id FROM benchmark)")
def keyed_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Items of the orders that are asked for, by a key that the table is laid out for."""
    items = layouts.keyed(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part")), "key", 8, "items")
    asked = table(spark, d, "benchmark").select("item_id").distinct()
    return layouts.looked_up(spark, items, "key", asked)


@query("""SELECT doc_id, md5(text) AS text, CASE doc_id % 3 WHEN 0 THEN 'und' ELSE lang END AS lang, CASE WHEN doc_id % 3 < 2 THEN 'unknown' ELSE source END AS source, doc_id % 3 + 1 AS layout FROM documents""")
def mixed_layouts(spark: SparkSession, d: str) -> DataFrame:
    """Documents in files of three layouts: without language and source, without source, and with both."""
    docs, root = table(spark, d, "documents"), scratch(spark, "layouts")
    for i, columns in enumerate((["doc_id", "text"], ["doc_id", "text", "lang"], ["doc_id", "text", "lang", "source"])):
        docs.where(F.pmod("doc_id", F.lit(3)) == i).select(*columns).write.parquet(f"{root}/layout={i + 1}")
    rows = layouts.all_layouts(spark, root, {"lang": (2, F.lit("und")), "source": (3, F.lit("unknown"))})
    return rows.select("doc_id", F.md5("text").alias("text"), "lang", "source", F.col("layout").cast("long").alias("layout"))
