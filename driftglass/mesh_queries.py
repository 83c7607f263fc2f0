"""Queries over claims, caches, routes, identities and payloads, with the same in SQL; see queries.py for what stands for what."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftglass.functions import codec, hashing, identity, text, vectors
from driftglass.operators import ingest, placement, search, state
from driftglass.plans import graph
from driftglass.queries import FNV, NODES, _mix, _nodes, _stream, query
from driftglass.session import scratch, table
from driftglass.streaming import jobs


def _be(x: str, size: int) -> str:
    """A number as hex of `size` bytes."""
    return f"printf('%0{2 * size}X', ({x})::BIGINT)"


def _str(x: str, most: int) -> str:
    """A text's capped UTF-8 with its length, as hex."""
    raw = f"substr(hex(encode({x})), 1, {2 * most})"
    return f"(printf('%04X', (len({raw}) // 2)::BIGINT) || {raw})"


# Sources and sinks


@query("SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return state.looked_up(table(spark, d, "customer"), wanted, "c_custkey").select("c_custkey", "c_name", "c_nationkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey) AS place FROM lineitem WHERE l_suppkey = 7")
def index_scan(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").where("l_suppkey = 7").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey"))).drop("l_suppkey")


OUTBOX = "box AS (SELECT o_orderkey AS id, o_custkey AS dst_id, o_orderdate AS queued_at, o_orderdate + INTERVAL 5 DAY AS expires_at FROM orders)"


def _outbox(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("dst_id"), F.col("o_orderdate").alias("queued_at"), (F.col("o_orderdate") + F.expr("INTERVAL 5 DAYS")).alias("expires_at"))


@query(f"WITH {OUTBOX} SELECT dst_id, id, row_number() OVER (PARTITION BY dst_id ORDER BY queued_at, id) AS place FROM box WHERE expires_at >= TIMESTAMP '1997-06-01'")
def outbox_due(spark: SparkSession, d: str) -> DataFrame:
    return state.outbox_due(_outbox(spark, d), F.lit("1997-06-01").cast("timestamp_ntz")).select("dst_id", "id", "place")


@query(f"WITH {OUTBOX} SELECT dst_id, count(*) AS expired FROM box WHERE expires_at < TIMESTAMP '1997-06-01' GROUP BY 1")
def outbox_expired(spark: SparkSession, d: str) -> DataFrame:
    return state.outbox_expired(_outbox(spark, d), F.lit("1997-06-01").cast("timestamp_ntz")).groupBy("dst_id").agg(F.count(F.lit(1)).alias("expired"))


@query("SELECT user_id, max(event_id) FILTER (n = 1) AS event_id, max(version) AS version FROM (SELECT user_id, event_id, floor(value)::BIGINT AS version, row_number() OVER (PARTITION BY user_id ORDER BY floor(value) DESC, event_id) AS n FROM events) GROUP BY 1")
def upsert_log(spark: SparkSession, d: str) -> DataFrame:
    root = scratch(spark, "upserts")
    rows = table(spark, d, "events").select("user_id", "event_id", F.floor("value").alias("version")).orderBy("event_id")
    rows.write.parquet(f"{root}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{root}/in")
    jobs.periodically(stream, "reconcile", jobs.upserting(f"{root}/log", "user_id", "version", "event_id"), f"{root}/state", once=True).awaitTermination()
    return jobs.upserted_rows(spark, f"{root}/log", "user_id", "version", "event_id")


@query("""WITH new AS (SELECT c_nationkey AS key, c_name AS name, c_custkey AS came FROM customer), old AS (SELECT s_nationkey AS key, min(s_name) AS name FROM supplier WHERE s_acctbal > 5000 GROUP BY 1)
SELECT key, name FROM old UNION ALL SELECT key, arg_min(name, came) AS name FROM new WHERE key NOT IN (SELECT key FROM old) GROUP BY key""")
def insert_ignored(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("key")).agg(F.min("s_name").alias("name"))
    new = table(spark, d, "customer").select(F.col("c_nationkey").alias("key"), F.col("c_name").alias("name"), F.col("c_custkey").alias("at"))
    return state.inserted_or_ignored(old, new, "key", "at")


@query("""WITH new AS (SELECT c_nationkey AS key, max(c_acctbal) AS v FROM customer WHERE c_acctbal > 9000 GROUP BY 1), old AS (SELECT s_nationkey AS key, max(s_acctbal) AS v FROM supplier GROUP BY 1)
SELECT key, v FROM new UNION ALL SELECT key, v FROM old WHERE key NOT IN (SELECT key FROM new)""")
def upserted_rows(spark: SparkSession, d: str) -> DataFrame:
    best = lambda t, k, v: table(spark, d, t).groupBy(F.col(k).alias("key")).agg(F.max(v).alias("v"))
    new = table(spark, d, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("key")).agg(F.max("c_acctbal").alias("v"))
    return state.upserted(best("supplier", "s_nationkey", "s_acctbal"), new, "key")


@query("""WITH gone AS (SELECT p_partkey AS doc FROM part WHERE p_size > 3), meta AS (SELECT p_partkey AS doc, p_type AS parent FROM part WHERE p_partkey NOT IN (SELECT doc FROM gone))
SELECT 'meta' AS what, count(*) AS n FROM meta UNION ALL SELECT 'parents', count(DISTINCT p_type) FROM part WHERE p_type IN (SELECT parent FROM meta) UNION ALL SELECT 'claims', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT doc FROM gone)""")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part")
    meta = parts.select(F.col("p_partkey").alias("doc"), F.col("p_type").alias("parent"))
    claims = table(spark, d, "lineitem").select(F.col("l_partkey").alias("doc"))
    left = state.cascade_delete(parts.where("p_size > 3").select(F.col("p_partkey").alias("doc")), "doc", meta, meta.select("parent").distinct(), "parent", claims)
    counted = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(w).alias("what"), "n") for w, t in zip(("meta", "parents", "claims"), left, strict=True)]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


@query("SELECT l_orderkey AS doc_key, min(l_shipdate) AS created_at, sum(len(l_returnflag || l_linestatus))::BIGINT AS bytes, count(*) AS chunk_count, arg_min(l_returnflag, (l_linenumber, l_returnflag)) AS title, 'mesh' AS provenance FROM lineitem WHERE l_linestatus <> 'O' GROUP BY 1")
def legacy_migration(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_key"), F.col("l_linenumber").alias("seq"), F.col("l_returnflag").alias("title"), F.concat("l_returnflag", "l_linestatus").alias("text"), F.col("l_shipdate").alias("added_at"), F.when(F.col("l_linestatus") == "O", "seed").alias("provenance"))
    return state.with_missing_columns(ingest.legacy_documents(ingest.purged(rows)), {"provenance": F.lit("mesh")})


# Text


@query("""WITH r AS (SELECT doc_id, CASE doc_id % 13 WHEN 0 THEN '25504446' WHEN 1 THEN '504B0304' WHEN 2 THEN '504B0506' WHEN 3 THEN '7B5C727466' WHEN 4 THEN 'D0CF11E0' WHEN 5 THEN '89504E47' WHEN 6 THEN 'FFD8FF' WHEN 7 THEN '47494638' WHEN 8 THEN '1F8B' WHEN 9 THEN '7F454C46' WHEN 10 THEN '4D5A' ELSE '' END || hex(encode(text)) AS h FROM documents)
SELECT doc_id, CASE WHEN h LIKE '25504446%' THEN 'pdf' WHEN h LIKE '504B0304%' OR h LIKE '504B0506%' THEN 'zip' WHEN h LIKE '7B5C727466%' THEN 'rtf' WHEN h LIKE 'D0CF11E0%' OR h LIKE '89504E47%' OR h LIKE 'FFD8FF%' OR h LIKE '47494638%' OR h LIKE '1F8B%' OR h LIKE '7F454C46%' OR h LIKE '4D5A%' THEN 'binary' ELSE 'text' END AS format FROM r""")
def format_sniff(spark: SparkSession, d: str) -> DataFrame:
    heads = F.array(*[F.lit(h) for h, _ in text.SIGNATURES], F.lit(""), F.lit(""))
    raw = F.concat(F.unhex(F.get(heads, (F.col("doc_id") % 13).cast("int"))), F.encode("text", "UTF-8"))
    return table(spark, d, "documents").select("doc_id", text.sniff(raw).alias("format"))


@query("""WITH r AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN replace(text, 'e', chr(1)) ELSE text END AS t FROM documents), h AS (SELECT doc_id, left(t, 4096) AS t FROM r)
SELECT doc_id, len(t) - len(regexp_replace(t, '[\\x{FFFD}\\x00-\\x08\\x0E-\\x1F]', '', 'g')) > 0.02::DOUBLE * len(t) AS wreck FROM h""".replace("\\\\", "\\"))
def wreckage_flag(spark: SparkSession, d: str) -> DataFrame:
    damaged = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("e"), F.lit("\x01"))).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", text.wreckage(damaged).alias("wreck"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(replace(replace(text, chr(10), chr(13) || chr(10)), chr(13) || chr(10), chr(10)), '^[\s\x{FEFF}\x{A0}]+', ''), '[\s\x{FEFF}\x{A0}]+$', '') AS clean FROM documents")
def upload_normalise(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit("﻿"), F.replace("text", F.lit("\n"), F.lit("\r\n")))
    return table(spark, d, "documents").select("doc_id", text.upload_text(raw).alias("clean"))


@query(r"SELECT page_id, regexp_matches(url, '(?i)\.(html?|xhtml)$') OR regexp_matches(left(html, 2048), '(?i)<!doctype\s+html|<html[\s>]|<body[\s>]') AS html, regexp_matches(url, '(?i)\.(md|markdown)$') AS markdown FROM pages")
def page_formats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.is_html(F.col("html"), F.col("url")).alias("html"), text.is_markdown(F.col("url")).alias("markdown"))


@query(r"""SELECT page_id, coalesce(CASE WHEN page_id % 3 = 0 THEN 'stated ' || page_id END, CASE WHEN regexp_matches(t, '(?m)^#[ \t]') THEN regexp_extract_all(t, '(?m)^#[ \t]+(.*?)[ \t]*$', 1)[-1] END, regexp_replace('page-' || page_id || '.html', '\.[A-Za-z0-9]+$', '')) AS title
FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'x' || chr(10) || '# first' || chr(10) || '# of ' || url || '  ' || chr(10) || 'y' ELSE url END AS t FROM pages)""")
def import_title(spark: SparkSession, d: str) -> DataFrame:
    body = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("x\n# first\n# of "), "url", F.lit("  \ny"))).otherwise(F.col("url"))
    stated = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("stated "), F.col("page_id").cast("string")))
    return table(spark, d, "pages").select("page_id", text.title_of(stated, body, F.concat(F.lit("page-"), F.col("page_id").cast("string"), F.lit(".html"))).alias("title"))


_HIGH = " ".join(f"WHEN {0x80 + i} THEN '{chr(c) if c else ''}'" for i, c in enumerate(text.CP1252))


@query(f"SELECT s_suppkey, 128 + s_suppkey % 128 AS byte, CASE 128 + s_suppkey % 128 {_HIGH} ELSE chr((128 + s_suppkey % 128)::INT) END AS sign FROM supplier")
def cp1252_text(spark: SparkSession, d: str) -> DataFrame:
    byte = 128 + F.col("s_suppkey") % 128
    return table(spark, d, "supplier").select("s_suppkey", byte.alias("byte"), text.cp1252_text(codec.unsigned(byte, 1)).alias("sign"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text ELSE lang || ' ' || source || ' ' || left(text, 200) END AS scored, left(CASE WHEN source <> '' THEN source || ': ' || left(text, 200) ELSE left(text, 200) END, 200) AS sent FROM documents")
def lexical_texts(spark: SparkSession, d: str) -> DataFrame:
    snippet, body = F.left("text", F.lit(200)), F.when(F.col("doc_id") % 3 == 0, F.col("text"))
    return table(spark, d, "documents").select("doc_id", text.lexical_text(F.col("lang"), F.col("source"), snippet, body).alias("scored"), text.sectioned_snippet(F.col("source"), snippet).alias("sent"))


@query("WITH s AS (SELECT doc_id, left(CASE WHEN doc_id % 2 = 0 THEN source || ': ' ELSE '' END || replace(text, ': ', ':'), 200) AS s FROM documents) SELECT doc_id, CASE WHEN contains(s, ': ') THEN split_part(s, ': ', 1) ELSE '' END AS section, CASE WHEN contains(s, ': ') THEN substr(s, strpos(s, ': ') + 2) ELSE s END AS snippet FROM s")
def snippet_parts(spark: SparkSession, d: str) -> DataFrame:
    section = F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise("")
    sent = text.sectioned_snippet(section, F.replace("text", F.lit(": "), F.lit(":")))
    return table(spark, d, "documents").select("doc_id", text.snippet_parts(sent).alias("p")).select("doc_id", "p.*")


# Hashes and codecs


@query("SELECT event_id, ('0x' || left(md5(event_id || ':' || user_id || ':' || event_type), 8))::BIGINT AS msg_id FROM events")
def message_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", hashing.message_id(F.col("event_id"), F.col("user_id"), F.col("event_type")).alias("msg_id"))


@query("SELECT doc_id, base64(encode(text)) AS b64, lower(hex(encode(lang || source))) AS hexed, true AS same FROM documents")
def binary_text(spark: SparkSession, d: str) -> DataFrame:
    raw = F.encode("text", "UTF-8")
    b64 = codec.to_base64(raw)
    return table(spark, d, "documents").select("doc_id", b64.alias("b64"), codec.to_hex(F.encode(F.concat("lang", "source"), "UTF-8")).alias("hexed"), (codec.from_base64(b64) == raw).alias("same"))


@query(f"SELECT doc_id, {_str('text', 160)} AS capped, substr(hex(encode(lang || source)) || repeat('0', 64), 1, 64) AS padded FROM documents")
def byte_caps(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.hex(codec.capped_utf8(F.col("text"), 160)).alias("capped"), F.hex(codec.fixed_width(F.encode(F.concat("lang", "source"), "UTF-8"), 32)).alias("padded"))


@query("SELECT doc_id, greatest(1, ceil(octet_length(encode(text)) / 181))::INT AS segments, printf('%02X', (((greatest(1, ceil(octet_length(encode(text)) / 181))::BIGINT - 1) % 128) * 2 + 1)::BIGINT) AS last_head, CASE WHEN octet_length(encode(text)) <= 98304 THEN sha256(encode(text)) END AS whole FROM documents")
def segment_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", codec.segments(F.encode("text", "UTF-8"), 185).alias("s"))
    data = F.transform("s", lambda s: s["data"])
    return rows.select("doc_id", F.size("s").alias("segments"), F.hex(F.substring(F.element_at(data, -1), 1, 1)).alias("last_head"), F.sha2(codec.rejoined(data), 256).alias("whole"))


@query(f"SELECT s_suppkey, {_be('s_suppkey % 4', 1)} || {_be('s_suppkey * 7', 4)} || {_be('s_suppkey', 4)} || {_be('s_nationkey', 2)} || {_be('s_suppkey * 3', 4)} || {_str('s_name', 32)} AS packet, s_suppkey * 7 AS known, s_suppkey * 3 AS free_kb, s_name AS name FROM supplier")
def hello_codec(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("s_suppkey")
    made = codec.hello(key % 4, key * 7, key, F.col("s_nationkey"), key * 3, F.col("s_name"))
    return table(spark, d, "supplier").select("s_suppkey", F.hex(made).alias("packet"), codec.read_hello(made).alias("h")).select("s_suppkey", "packet", "h.known", "h.free_kb", "h.name")


@query("SELECT vec_id, round(list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x)))::FLOAT::DOUBLE, 9) AS scale, list_transform(embedding::DOUBLE[], lambda x: floor(x * 100 + 0.5::DOUBLE)::INT) AS q, 11 + len(embedding) + 2 + octet_length(encode('q ' || vec_id)) AS bytes, 'q ' || vec_id AS text FROM embeddings")
def query_codec(spark: SparkSession, d: str) -> DataFrame:
    q = F.transform("embedding", lambda x: F.floor(x.cast("double") * 100 + 0.5).cast("int"))
    scale = F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double"))))
    made = codec.query_payload(F.col("vec_id"), F.lit(4), scale, q, F.concat(F.lit("q "), F.col("vec_id").cast("string")))
    rows = table(spark, d, "embeddings").select("vec_id", made.alias("b")).select("vec_id", F.octet_length("b").alias("bytes"), codec.read_query(F.col("b")).alias("r"))
    return rows.select("vec_id", F.round("r.scale", 9).alias("scale"), F.transform("r.q", lambda x: x.cast("int")).alias("q"), F.col("bytes").cast("long").alias("bytes"), "r.text")


_HIT = f"{_be('l_partkey', 4)} || {_be('floor(l_discount * 65535 + 0.5::DOUBLE)', 2)} || {_be('l_suppkey', 4)} || {_str('l_returnflag', 80)} || {_str("l_linestatus || ' of ' || l_partkey", 200)}"


@query(f"""SELECT l_orderkey, {_be('l_orderkey % 4294967296', 4)} || '02' || {_be('count(*)', 1)} || string_agg({_HIT}, '' ORDER BY l_linenumber, l_partkey, l_discount, l_suppkey) AS packet, count(*) AS hits, sum(l_partkey)::BIGINT AS ids, round(sum(floor(l_discount * 65535 + 0.5::DOUBLE)) / 65535, 6) AS scores, string_agg(l_linestatus || ' of ' || l_partkey, '|' ORDER BY l_linenumber, l_partkey, l_discount, l_suppkey) AS snippets FROM lineitem GROUP BY l_orderkey""")
def result_codec(spark: SparkSession, d: str) -> DataFrame:
    hit = F.struct("l_linenumber", F.col("l_partkey").alias("doc_id"), F.col("l_discount").alias("score"), F.col("l_suppkey").alias("holder"), F.col("l_returnflag").alias("title"), F.concat("l_linestatus", F.lit(" of "), F.col("l_partkey").cast("string")).alias("snippet"))
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(hit)).alias("hits"))
    rows = rows.withColumn("b", codec.result_payload(F.col("l_orderkey"), F.lit(2), F.col("hits"))).withColumn("r", codec.read_result(F.col("b")))
    total = lambda f, zero: F.aggregate(F.transform("r.hits", f), zero, lambda a, x: a + x)
    return rows.select("l_orderkey", F.hex("b").alias("packet"), F.size("r.hits").cast("long").alias("hits"), total(lambda h: h["doc_id"], F.lit(0).cast("long")).alias("ids"), F.round(total(lambda h: h["score"], F.lit(0.0)), 6).alias("scores"), F.array_join(F.transform("r.hits", lambda h: h["snippet"]), "|").alias("snippets"))


#: What of a text's first 4,000 bytes reads back: whole characters, and U+FFFD for one that the cap cuts.
_READ = """ch AS (SELECT doc_id, generate_subscripts(cs, 1) AS i, unnest(cs) AS c FROM (SELECT doc_id, string_split(left(text, 4001), '') AS cs FROM documents)),
ends AS (SELECT doc_id, i, c, sum(octet_length(encode(c))) OVER (PARTITION BY doc_id ORDER BY i) AS e, octet_length(encode(c)) AS n FROM ch),
got AS (SELECT doc_id, coalesce(string_agg(c, '' ORDER BY i) FILTER (e <= 4000), '') || CASE WHEN bool_or(e > 4000 AND e - n < 4000) THEN chr(65533) ELSE '' END AS t FROM ends GROUP BY 1)"""


@query(f"""WITH {_READ} SELECT doc_id, {_be('doc_id', 4)} || {_str('lang', 120)} || {_str('source', 120)} || {_str('text', 4000)} || {_str("'https://' || source", 200)} AS packet, lang AS title, 'https://' || source AS source,
coalesce(len(t), 0) AS chars, sha256(coalesce(t, '')) AS read FROM documents LEFT JOIN got USING (doc_id)""")
def document_codec(spark: SparkSession, d: str) -> DataFrame:
    made = codec.document_reply(F.col("doc_id"), F.col("lang"), F.col("source"), F.col("text"), F.concat(F.lit("https://"), "source"))
    rows = table(spark, d, "documents").withColumn("b", made).select("doc_id", F.hex("b").alias("packet"), codec.read_document_reply(F.col("b")).alias("r"))
    return rows.select("doc_id", "packet", "r.title", "r.source", F.length("r.text").cast("long").alias("chars"), F.sha2("r.text", 256).alias("read"))


HELD_BY = "entries AS (SELECT l_orderkey AS doc_key, l_partkey AS doc_id, sum(l_linenumber)::BIGINT AS hits, list(DISTINCT l_suppkey ORDER BY l_suppkey)[1:8] AS holders FROM lineitem GROUP BY ALL)"


@query(f"""WITH {HELD_BY} SELECT doc_key, {_be('doc_key', 4)} || {_be('count(*)', 1)} || string_agg({_be('doc_id', 4)} || {_be('hits', 4)} || {_be('len(holders)', 1)} || array_to_string(list_transform(holders, lambda h: printf('%08X', h)), ''), '' ORDER BY doc_id) AS packet, sum(hits)::BIGINT AS hits, sum(len(holders))::BIGINT AS holders FROM entries GROUP BY doc_key""")
def holders_codec(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_key"), F.col("l_partkey").alias("doc_id")).agg(F.sum("l_linenumber").alias("hits"), F.sort_array(F.collect_set("l_suppkey")).alias("holders"))
    rows = rows.groupBy("doc_key").agg(F.sort_array(F.collect_list(F.struct("doc_id", "hits", "holders"))).alias("entries"))
    rows = rows.withColumn("b", codec.holders_payload(F.col("doc_key"), F.col("entries"))).withColumn("r", codec.read_holders(F.col("b")))
    total = lambda f: F.aggregate("r.entries", F.lit(0).cast("long"), lambda a, e: a + f(e))
    return rows.select("doc_key", F.hex("b").alias("packet"), total(lambda e: e["hits"]).alias("hits"), total(lambda e: F.size(e["holders"])).alias("holders"))


@query(f"""WITH m AS (SELECT l_orderkey AS doc_key, string_agg({_be('l_partkey', 4)} || {_be('l_linenumber', 2)} || '0001' || {_be('least(65535, l_quantity * 2000)', 2)} || {_be('l_suppkey', 4)} || {_be('l_linenumber', 4)} || {_str('l_returnflag', 100)} || {_str('l_linestatus', 200)} || '3F000000' || '0002' || '01FF' || '01' || {_be('l_suppkey', 4)}, '' ORDER BY l_linenumber, l_partkey, l_quantity, l_suppkey, l_returnflag) AS es, count(*) AS n FROM lineitem GROUP BY 1)
SELECT doc_key, {_be('doc_key', 4)} || {_str('o_orderpriority', 120)} || {_str('o_orderstatus', 120)} || {_be('1000', 4)} || {_be('n', 2)} || {_be('o_custkey', 4)} || {_be('epoch(o_orderdate)', 4)} || upper(sha256(doc_key::VARCHAR)) || CASE WHEN o_custkey % 2 = 0 THEN '01' || repeat('AB', 32) || repeat('CD', 64) ELSE '00' END || {_be('n', 1)} || es AS packet FROM m JOIN orders ON o_orderkey = doc_key""")
def announce_codec(spark: SparkSession, d: str) -> DataFrame:
    entry = F.struct(
        F.col("l_linenumber").alias("_n"), F.col("l_partkey").alias("doc_id"), F.col("l_linenumber").alias("seq"), F.lit(1).alias("version"), (F.col("l_quantity") * 2000).cast("long").alias("bytes"), F.col("l_suppkey").alias("origin_id"), F.col("l_linenumber").alias("hits"),
        F.col("l_returnflag").alias("section"), F.col("l_linestatus").alias("snippet"), F.lit(0.5).alias("scale"), F.array(F.lit(1), F.lit(-1)).alias("q"), F.array("l_suppkey").alias("holders"),
    )
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_key")).agg(F.sort_array(F.collect_list(entry)).alias("entries")).join(table(spark, d, "orders").withColumnRenamed("o_orderkey", "doc_key"), "doc_key")
    signed = F.col("o_custkey") % 2 == 0
    doc = F.struct(
        "doc_key", F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("source"), F.lit(1000).alias("bytes"), F.size("entries").alias("chunk_count"), F.col("o_custkey").alias("origin_id"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("created_s"),
        F.unhex(F.sha2(F.col("doc_key").cast("string"), 256)).alias("doc_hash"), F.when(signed, F.unhex(F.lit("AB" * 32))).alias("author_key"), F.unhex(F.lit("CD" * 64)).alias("sig"),
    )
    return rows.select("doc_key", F.hex(codec.announce_payload(doc, F.col("entries"))).alias("packet"))


@query(f"SELECT s_suppkey, upper(sha256(s_name)) || {_str('s_name', 32)} || repeat('07', 16) || repeat('0', 128) AS reply, s_name AS name, repeat('07', 16) || {_be('s_suppkey', 4)} || {_str('s_name', 32)} AS challenge, {_be('s_suppkey', 4)} || {_be('24', 2)} AS catalog_request FROM supplier")
def identity_codec(spark: SparkSession, d: str) -> DataFrame:
    nonce = F.unhex(F.lit("07" * 16))
    made = codec.identity_reply(F.unhex(F.sha2("s_name", 256)), F.col("s_name"), codec.identity_request(nonce), F.lit(b""))
    return table(spark, d, "supplier").select("s_suppkey", F.hex(made).alias("reply"), codec.read_identity_reply(made)["name"].alias("name"), F.hex(identity.challenge_bytes(nonce, F.col("s_suppkey"), F.col("s_name"))).alias("challenge"), F.hex(codec.catalog_request(F.col("s_suppkey"), F.lit(24))).alias("catalog_request"))


# Search


@query("SELECT vec_id, floor(least(1, greatest(0, (embedding[1]::DOUBLE + 1) / 2)) * 65535 + 0.5::DOUBLE)::INT AS wire, round(floor(least(1, greatest(0, (embedding[1]::DOUBLE + 1) / 2)) * 65535 + 0.5::DOUBLE) / 65535 * 2 - 1, 9) AS back FROM embeddings WHERE label = 3")
def wire_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = search.usable_vectors(table(spark, d, "embeddings"), "label", 3).withColumn("wire", vectors.wire_score(F.col("embedding")[0].cast("double")))
    return rows.select("vec_id", "wire", F.round(vectors.from_wire_score(F.col("wire")), 9).alias("back"))


@query("SELECT doc_id, lang || ' - ' || source || '. ' || text AS input, coalesce(nullif(doc_id % 6, 0), 4) AS k, least(coalesce(nullif(doc_id % 6, 0), 4), 4) AS capped FROM documents")
def embedding_inputs(spark: SparkSession, d: str) -> DataFrame:
    wanted = F.col("doc_id") % 6
    return table(spark, d, "documents").select("doc_id", vectors.embedding_input(F.col("lang"), F.col("source"), F.col("text")).alias("input"), search.asked_k(wanted).alias("k"), search.asked_k(wanted, capped=True).alias("capped"))


CLAIMS = "claims AS (SELECT l_partkey AS doc_id, l_suppkey AS node_id, l_orderkey * 10 + l_linenumber AS arrival FROM lineitem), live AS (SELECT s_suppkey AS node_id FROM supplier WHERE s_acctbal > 2000), held AS (SELECT p_partkey AS doc_id FROM part WHERE p_size > 25)"


def _claims(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("doc_id"), F.col("l_suppkey").alias("node_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("arrival"))


def _live(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").where("s_acctbal > 2000").select(F.col("s_suppkey").alias("node_id"))


def _held(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("text"))


@query(f"WITH {CLAIMS} SELECT doc_id, arg_min(node_id, (CASE WHEN node_id = 5 THEN 0 ELSE 1 END, arrival, node_id)) AS holder FROM claims WHERE (node_id = 5 OR node_id IN (SELECT node_id FROM live)) AND (node_id <> 5 OR doc_id IN (SELECT doc_id FROM held)) GROUP BY doc_id")
def holder_choice(spark: SparkSession, d: str) -> DataFrame:
    return search.chosen_holder(_claims(spark, d), _live(spark, d), _held(spark, d), 5)


@query(f"""WITH {CLAIMS}, other AS (SELECT doc_id, arg_min(node_id, (arrival, node_id)) AS h FROM claims WHERE node_id <> 5 AND node_id IN (SELECT node_id FROM live) GROUP BY 1), r AS (SELECT p_partkey AS doc_id, p_size > 25 AS stored_here, CASE WHEN p_size > 25 THEN 5 ELSE coalesce(h, 0) END AS holder, CASE WHEN p_size > 25 THEN p_name END AS text FROM part LEFT JOIN other ON doc_id = p_partkey)
SELECT doc_id, stored_here, holder, text, coalesce(s_name, '') AS holder_name FROM r LEFT JOIN supplier ON s_suppkey = holder""")
def local_hits(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "supplier").select(F.col("s_suppkey").alias("node_id"), F.col("s_name").alias("name"))
    hits = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"))
    return search.local_hits(hits, _held(spark, d), _claims(spark, d), _live(spark, d), names, 5)


REPLIES = "replies AS (SELECT l_orderkey AS query_id, l_linenumber AS node, 0 AS started, (l_quantity * 200)::BIGINT AS came FROM lineitem)"


@query(f"""WITH {REPLIES}, f AS (SELECT query_id, node, min(came) AS a FROM replies WHERE node <= 2 GROUP BY ALL), s AS (SELECT query_id, count(*) AS n, max(a) AS all_at FROM f GROUP BY 1)
SELECT query_id, node, started, came AS "at" FROM replies LEFT JOIN s USING (query_id) WHERE came <= least(started + 6000, CASE WHEN n >= 2 THEN all_at + 400 ELSE 1000000 END)""")
def collection_window(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("node"), F.lit(0).alias("started"), (F.col("l_quantity") * 200).cast("long").alias("at"))
    return search.in_window(rows, spark.range(1, 3).select(F.col("id").cast("int").alias("node")))


@query("SELECT count_if(l_suppkey = 5)::BIGINT AS local, count_if(l_suppkey <> 5)::BIGINT AS remote, count_if(l_suppkey <> 5 AND l_returnflag = 'R')::BIGINT AS fetched, count_if(l_returnflag <> 'R')::BIGINT AS snippet_only FROM lineitem")
def result_counters(spark: SparkSession, d: str) -> DataFrame:
    return search.result_counters(table(spark, d, "lineitem").select((F.col("l_suppkey") == 5).alias("local"), (F.col("l_returnflag") == "R").alias("has_body")))


@query("SELECT conv_id AS query_id, string_agg('[' || n || '] ' || role || ' - ' || turn || chr(10) || text, chr(10) || chr(10) ORDER BY n) AS prompt FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS n FROM conversations) GROUP BY 1")
def prompt_text(spark: SparkSession, d: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role"))
    return search.prompt_of(table(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), rank.alias("rank"), F.col("role").alias("title"), F.col("turn").cast("string").alias("section"), "text"))


@query(f"""WITH q AS (SELECT DISTINCT conv_id AS query_id FROM conversations), p AS (SELECT DISTINCT conv_id AS query_id FROM conversations WHERE role = 'assistant' AND turn > 1), s AS (SELECT conv_id AS query_id, string_agg(text || ' [' || turn || ']', ' ' ORDER BY turn) AS told FROM conversations WHERE role = 'user' AND conv_id % 2 = 0 GROUP BY 1),
g AS (SELECT conv_id AS query_id, trim(min(text)) AS made FROM conversations WHERE turn = 0 GROUP BY 1), r AS (SELECT query_id, p.query_id IS NOT NULL AS found, told, made FROM q LEFT JOIN p USING (query_id) LEFT JOIN s USING (query_id) LEFT JOIN g USING (query_id))
SELECT query_id, CASE WHEN found AND coalesce(len(made) >= 60, false) THEN 'generated' ELSE 'extractive' END AS mode, CASE WHEN found AND coalesce(len(made) >= 60, false) THEN made WHEN found AND told IS NOT NULL THEN told ELSE '{search.NOT_FOUND}' END AS text FROM r""")
def answer_state(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").withColumnRenamed("conv_id", "query_id")
    told = rows.where("role = 'user' and query_id % 2 = 0").select("query_id", F.col("turn").alias("rank"), F.col("text").alias("sentence"), F.col("turn").alias("citation"))
    made = rows.where("turn = 0").groupBy("query_id").agg(F.min("text").alias("text"))
    return search.answer_states(rows.select("query_id").distinct(), rows.where("role = 'assistant' and turn > 1"), told, made, 60)


# Claims, counters, windows


@query(f"WITH {CLAIMS}, r AS (SELECT doc_id, node_id FROM claims WHERE node_id <> 5 UNION SELECT doc_id, 5 FROM held) SELECT doc_id, list(node_id ORDER BY node_id) AS holders FROM r GROUP BY 1")
def holder_map(spark: SparkSession, d: str) -> DataFrame:
    return state.holder_map(_claims(spark, d), _held(spark, d), "doc_id", "node_id", 5)


@query(f"WITH {CLAIMS} SELECT doc_id, node_id, arrival FROM claims WHERE node_id <> 5 UNION ALL SELECT doc_id, 5, 999 FROM held")
def self_claims(spark: SparkSession, d: str) -> DataFrame:
    return state.self_claims(_claims(spark, d), _held(spark, d), "doc_id", "node_id", "arrival", F.lit(999).cast("long"), 5)


@query(f"WITH {CLAIMS} SELECT doc_id, node_id, arrival FROM claims WHERE node_id <> 5 AND doc_id IN (SELECT doc_id FROM held)")
def admitted_claims(spark: SparkSession, d: str) -> DataFrame:
    return state.admitted_claims(_claims(spark, d), _held(spark, d), "doc_id", "node_id", 5)


@query("SELECT p_partkey, greatest(90, ceil(p_partkey / 24) * 8 / 0.5::DOUBLE) AS ttl_s, greatest(60, p_size * 2) AS ttl_web FROM part")
def claim_ttls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", state.claim_ttl_seconds(F.col("p_partkey")).alias("ttl_s"), state.claim_ttl_web(F.col("p_size")).alias("ttl_web"))


@query("WITH r AS (SELECT l_suppkey AS node, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) - 1 AS p, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem) SELECT node, l_orderkey, l_linenumber, floor((((p - 7) % n + n) % n) / 24)::BIGINT AS batch FROM r")
def rotating_batches(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("node"), "l_orderkey", "l_linenumber")
    return state.rotated(rows, 24, 7, [F.col("l_orderkey"), F.col("l_linenumber")], ["node"])


@query("SELECT event_id, event_type, user_id FROM events QUALIFY row_number() OVER (ORDER BY event_id DESC) <= 200")
def activity_log(spark: SparkSession, d: str) -> DataFrame:
    return jobs.activity(table(spark, d, "events").select("event_id", "event_type", "user_id", F.col("event_id").alias("seq"))).drop("seq")


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 8")
def recent_tail(spark: SparkSession, d: str) -> DataFrame:
    return state.tail_of(table(spark, d, "events").select("user_id", "event_id"), F.col("event_id"), 8, "user_id")


@query("SELECT event_id, event_type FROM events WHERE event_id > 900 ")
def fresh_rows(spark: SparkSession, d: str) -> DataFrame:
    return state.fresh_since(table(spark, d, "events").select("event_id", "event_type"), "event_id", F.lit(900))


@query("WITH asked AS (SELECT DISTINCT o_custkey AS g, o_orderkey AS m FROM orders), done AS (SELECT DISTINCT l_orderkey AS m FROM lineitem WHERE l_quantity > 10) SELECT g AS customer, count(*) = count(done.m) AS all_done FROM asked LEFT JOIN done USING (m) GROUP BY 1")
def all_answered(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "orders").select(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("m"))
    done = table(spark, d, "lineitem").where("l_quantity > 10").select(F.col("l_orderkey").alias("m")).distinct().join(asked, "m")
    return state.all_of(asked, done, "customer", "m")


@query("SELECT user_id, count_if(event_type = 'view')::BIGINT AS received, count_if(event_type = 'error')::BIGINT AS dropped, (count_if(event_type = 'view') - count(DISTINCT CASE WHEN event_type = 'view' THEN floor(value) END))::BIGINT AS duplicates FROM events GROUP BY 1")
def router_counters(spark: SparkSession, d: str) -> DataFrame:
    view = F.col("event_type") == "view"
    by = table(spark, d, "events").groupBy("user_id").agg(F.count_if(view).alias("received"), F.count_if(F.col("event_type") == "error").alias("dropped"), F.countDistinct(F.when(view, F.floor("value"))).alias("_d"))
    return by.select("user_id", "received", "dropped", (F.col("received") - F.col("_d")).alias("duplicates"))


@query("""SELECT source, doc_id, sent_before FROM (SELECT source, doc_id, (coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS sent_before FROM documents WHERE doc_id > 60) WHERE sent_before < 9000""")
def catalog_since(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("source", "doc_id", "n_chars")
    return state.catalog_page(docs, [F.col("doc_id")], "n_chars", 9000, ["source"], F.col("doc_id") > 60, F.floor(F.col("doc_id") / 1000)).select("source", "doc_id", "sent_before")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def uploads_left(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return state.difference(table(spark, d, "customer"), done, "c_custkey").select("c_custkey", "c_name")


# Policy


FACTS = "facts AS (SELECT s_suppkey AS n, (s_suppkey * 13) % 250 AS expected, (s_suppkey * 29) % 230 AS requests, s_suppkey * 3 AS counter FROM supplier)"


@query(f"""WITH {FACTS} SELECT n, CASE WHEN expected >= 200 OR requests >= 200 THEN floor(counter / 2)::BIGINT ELSE counter END AS decayed, least(8, greatest(1, ceil(n / 5)))::INT AS announced, (({_mix('n', '24301')} % 1024) % greatest(1, n))::BIGINT AS cursor, least(4, n + 1) AS shown_target, least(4, greatest(1, n)) AS meta_target,
floor(greatest(0, 1048576 - n * 20000) / 1024)::BIGINT AS free_kb, greatest(1024, n * 30) AS budget, CASE WHEN counter > 0 THEN least(100, floor(100 * n / counter + 0.5::DOUBLE)) ELSE 0 END::INT AS share FROM facts""")
def policy_scalars(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n")
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("n"), ((F.col("s_suppkey") * 13) % 250).alias("expected"), ((F.col("s_suppkey") * 29) % 230).alias("requests"), (F.col("s_suppkey") * 3).alias("counter"))
    return rows.select(
        "n", placement.decayed(F.col("counter"), F.col("expected"), F.col("requests")).alias("decayed"), placement.announce_rate(n).alias("announced"), placement.announce_cursor(n, n).alias("cursor"),
        placement.shown_meta_target(n).alias("shown_target"), placement.meta_target(n).alias("meta_target"), placement.free_kb(F.lit(1048576), n * 20000).alias("free_kb"), placement.storage_budget(n * 30).alias("budget"), placement.share_percent(n, F.col("counter")).alias("share"),
    )


@query(f"WITH {NODES} SELECT round(coalesce(avg(r), 1), 6) AS reliability FROM weighed WHERE r > 0.5")
def self_reliability(spark: SparkSession, d: str) -> DataFrame:
    return placement.self_reliability(_nodes(spark, d).where("least(1, reliability) > 0.5")).select(F.round("reliability", 6).alias("reliability"))


META = f"""{NODES}, ranked AS (SELECT doc_id, node_id, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, node_id) AS place FROM (
SELECT p_partkey AS doc_id, node_id, r / -ln(({_mix("p_partkey", "node_id")} + 0.5::DOUBLE) / 4294967296::DOUBLE) AS score FROM part, weighed WHERE r >= 0.05::DOUBLE)),
keeps AS (SELECT p_partkey AS doc_id, p_size % 20 AS origin_id, coalesce(place <= 4, false) AS keeps, p_size > 40 AS held FROM part LEFT JOIN (SELECT * FROM ranked WHERE node_id = 30) ON doc_id = p_partkey)"""


def _meta(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    meta = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), (F.col("p_size") % 20).alias("origin_id"))
    return meta, placement.keeps_meta(meta, _nodes(spark, d), 30), table(spark, d, "part").where("p_size > 40").select(F.col("p_partkey").alias("doc_id"))


@query(f"WITH {META} SELECT doc_id, keeps FROM keeps")
def keeps_meta(spark: SparkSession, d: str) -> DataFrame:
    return _meta(spark, d)[1]


@query(f"WITH {META} SELECT doc_id, origin_id FROM keeps WHERE keeps OR held OR origin_id = 7")
def announce_admission(spark: SparkSession, d: str) -> DataFrame:
    return placement.admitted(*_meta(spark, d), 7)


@query(f"WITH {META} SELECT doc_id, origin_id FROM keeps WHERE NOT (keeps OR held OR origin_id = 7)")
def meta_evictions(spark: SparkSession, d: str) -> DataFrame:
    return placement.meta_evictions(*_meta(spark, d), 7)


@query("""WITH a AS (SELECT l_partkey AS doc_key, l_returnflag AS title, l_suppkey AS origin_id, CASE l_linenumber % 3 WHEN 0 THEN 'verified' WHEN 1 THEN 'unsigned' ELSE 'forged' END AS authorship, l_orderkey * 10 + l_linenumber AS arrival FROM lineitem),
known AS (SELECT p_partkey AS doc_key, p_brand AS title, 0 AS origin_id FROM part WHERE p_size > 30), f AS (SELECT doc_key, arg_min((title, origin_id, authorship), arrival) AS r FROM a WHERE doc_key NOT IN (SELECT doc_key FROM known) GROUP BY 1)
SELECT doc_key, title, origin_id, 'unsigned' AS authorship, NULL AS author_key, 'local' AS provenance FROM known UNION ALL SELECT doc_key, r[1], r[2], r[3], CASE WHEN r[3] = 'verified' THEN 'k' || r[2] END, CASE WHEN r[2] = 5 THEN 'local' ELSE 'mesh' END FROM f""")
def document_admission(spark: SparkSession, d: str) -> DataFrame:
    kind = F.coalesce(F.get(F.array(F.lit("verified"), F.lit("unsigned")), F.col("l_linenumber") % 3), F.lit("forged"))
    told = table(spark, d, "lineitem").select(F.col("l_partkey").alias("doc_key"), F.col("l_returnflag").alias("title"), F.col("l_suppkey").alias("origin_id"), kind.alias("authorship"), F.concat(F.lit("k"), F.col("l_suppkey").cast("string")).alias("author_key"), F.lit("s").alias("sig"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("arrival"), F.struct("_metadata.file_path", "_metadata.row_index").alias("place"))
    known = table(spark, d, "part").where("p_size > 30").select(F.col("p_partkey").alias("doc_key"), F.col("p_brand").alias("title"), F.lit(0).cast("long").alias("origin_id"), F.lit("unsigned").alias("authorship"), F.lit(None).cast("string").alias("author_key"), F.lit("local").alias("provenance"))
    return placement.admitted_documents(known, told, 5)


@query("""WITH m AS (SELECT p_partkey AS doc_id, p_brand AS doc_key FROM part), h AS (SELECT l_partkey AS doc_id, list(DISTINCT l_suppkey ORDER BY l_suppkey) AS holders FROM lineitem WHERE l_quantity > 49 GROUP BY 1), s AS (SELECT l_partkey AS doc_id, count(*) AS hits FROM lineitem WHERE l_suppkey = 5 GROUP BY 1),
r AS (SELECT doc_key, doc_id, coalesce(len(holders), 0) AS n, coalesce(hits, 0) AS hits FROM m LEFT JOIN h USING (doc_id) LEFT JOIN s USING (doc_id)) SELECT doc_key, count(*)::INT AS entries, sum(n)::BIGINT AS claims, sum(hits)::BIGINT AS hits FROM r WHERE n > 0 OR hits > 0 GROUP BY 1""")
def holder_refresh(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    holders = lines.where("l_quantity > 49").groupBy(F.col("l_partkey").alias("doc_id")).agg(F.sort_array(F.collect_set("l_suppkey")).alias("holders"))
    shares = lines.where("l_suppkey = 5").groupBy(F.col("l_partkey").alias("doc_id")).agg(F.count(F.lit(1)).alias("hits"))
    out = placement.holder_refresh(table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_brand").alias("doc_key")), holders, shares)
    total = lambda f: F.aggregate("entries", F.lit(0).cast("long"), lambda a, e: a + f(e))
    return out.select("doc_key", F.size("entries").alias("entries"), total(lambda e: F.size(e["holders"])).alias("claims"), total(lambda e: e["hits"]).alias("hits"))


# Routes and graphs


HEARD = "heard AS (SELECT user_id AS node, event_id % 7 AS via, (event_id % 4)::INT AS hops, date_trunc('second', ts) AS seen FROM events)"


def _heard(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("node"), (F.col("event_id") % 7).alias("via"), (F.col("event_id") % 4).cast("int").alias("hops"), F.date_trunc("second", F.col("ts").cast("timestamp")).alias("at"))


ROUTES = f"{HEARD}, latest AS (SELECT node, max(seen) AS l FROM heard GROUP BY 1), routes AS (SELECT node, via, hops, seen AS \"at\" FROM heard JOIN latest USING (node) WHERE epoch(l) - epoch(seen) <= 30000 QUALIFY row_number() OVER (PARTITION BY node ORDER BY hops, seen DESC, via) = 1)"


def _routes(spark: SparkSession, d: str) -> DataFrame:
    return graph.learned_routes(_heard(spark, d), 30_000)


@query(f"WITH {ROUTES} SELECT * FROM routes")
def learned_routes(spark: SparkSession, d: str) -> DataFrame:
    return _routes(spark, d).withColumn("at", F.col("at").cast("timestamp_ntz"))


@query(f"""WITH {ROUTES} SELECT * FROM routes WHERE epoch(TIMESTAMP '2024-01-30') - epoch("at") <= 86400 AND via IN (SELECT s_nationkey FROM supplier)""")
def live_routes(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("peer"))
    return graph.live_routes(_routes(spark, d), links, F.lit("2024-01-30").cast("timestamp"), 86_400).withColumn("at", F.col("at").cast("timestamp_ntz"))


@query(f"""WITH {ROUTES}, p AS (SELECT event_id AS msg_id, user_id AS src_id, (event_id * 7) % 160 AS dst_id, event_id % 4 AS ttl, event_id % 11 = 0 AS seen_before FROM events)
SELECT msg_id, CASE WHEN src_id = 3 THEN 'own' WHEN seen_before THEN 'duplicate' WHEN dst_id = 3 THEN 'deliver' WHEN ttl <= 1 THEN 'expired' WHEN dst_id <> 0 AND dst_id IN (SELECT node FROM routes) THEN 'forward' ELSE 'flood' END AS fate FROM p""")
def delivery_fates(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    packets = table(spark, d, "events").select(e.alias("msg_id"), F.col("user_id").alias("src_id"), ((e * 7) % 160).alias("dst_id"), (e % 4).alias("ttl"), (e % 11 == 0).alias("seen_before"))
    return graph.delivery(packets, _routes(spark, d), 3).select("msg_id", "fate")


@query(f"WITH {ROUTES} SELECT s_suppkey AS node_id, coalesce(r.hops, s_nationkey) AS hops, coalesce(r.via, 99) AS via FROM supplier LEFT JOIN routes r ON r.node = s_suppkey")
def route_overlay(spark: SparkSession, d: str) -> DataFrame:
    peers = table(spark, d, "supplier").select(F.col("s_suppkey").alias("node_id"), F.col("s_nationkey").alias("hops"), F.lit(99).cast("long").alias("via"))
    return graph.with_routes(peers, _routes(spark, d))


@query("WITH r AS (SELECT printf('%X', c_custkey) AS peer, min(c_nationkey) AS node FROM customer WHERE c_acctbal > 8000 GROUP BY 1) SELECT p.peer, CASE WHEN p.peer IN ('flood', 'local') THEN 0 ELSE coalesce(r.node, p.n) END AS node_id FROM (SELECT printf('%X', c_custkey) AS peer, c_custkey AS n FROM customer UNION ALL SELECT 'flood', 0) p LEFT JOIN r USING (peer)")
def link_nodes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer")
    routes = rows.where("c_acctbal > 8000").select(F.col("c_nationkey").cast("long").alias("node"), F.hex("c_custkey").alias("via_peer"))
    links = rows.select(F.hex("c_custkey").alias("peer")).unionByName(spark.range(1).select(F.lit("flood").alias("peer")))
    return graph.node_of_link(links, routes)


@query("SELECT doc_id, doc_key, coalesce(p_name, '') AS doc_title, coalesce(p_type, '') AS doc_source FROM (SELECT l_orderkey * 10 + l_linenumber AS doc_id, l_partkey + 5 AS doc_key FROM lineitem) LEFT JOIN part ON p_partkey = doc_key")
def passage_documents(spark: SparkSession, d: str) -> DataFrame:
    meta = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("doc_id"), (F.col("l_partkey") + 5).alias("doc_key"))
    return ingest.described(meta, table(spark, d, "part").select(F.col("p_partkey").alias("doc_key"), F.col("p_name").alias("title"), F.col("p_type").alias("source")))


@query("SELECT n_regionkey AS origin, n_nationkey AS node, n_regionkey % 3 AS hops, (row_number() OVER w - 0.5::DOUBLE) / count(*) OVER (PARTITION BY n_regionkey, n_regionkey % 3) * 100 AS x, (n_regionkey % 3)::DOUBLE AS y FROM nation WINDOW w AS (PARTITION BY n_regionkey, n_regionkey % 3 ORDER BY n_nationkey)")
def layered_layout(spark: SparkSession, d: str) -> DataFrame:
    return graph.layers(table(spark, d, "nation").select(F.col("n_regionkey").alias("origin"), F.col("n_nationkey").alias("node"), (F.col("n_regionkey") % 3).alias("hops")))


@query("""WITH p AS (SELECT s_nationkey AS line, s_suppkey AS i, s_suppkey::DOUBLE AS x, s_acctbal / 100 AS y FROM supplier), s AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM p WINDOW w AS (PARTITION BY line ORDER BY i)),
c AS (SELECT *, coalesce(sqrt((x - px) ** 2 + (y - py) ** 2), 0) AS step FROM s), g AS (SELECT *, sum(step) OVER (PARTITION BY line ORDER BY i) AS gone, sum(step) OVER (PARTITION BY line) AS whole, count(*) OVER (PARTITION BY line) AS n FROM c),
m AS (SELECT line, arg_min(CASE WHEN step > 0 THEN px + (0.3::DOUBLE * whole - (gone - step)) / step * (x - px) ELSE x END, i) AS mx FROM g WHERE px IS NOT NULL AND gone >= 0.3::DOUBLE * whole GROUP BY 1)
SELECT line, round(max(whole), 6) AS length, round(sum(CASE WHEN whole > 0 THEN gone / whole ELSE 0 END), 6) AS stops, round(coalesce(max(mx), max(x)), 6) AS cut_x FROM g LEFT JOIN m USING (line) GROUP BY line""")
def polylines(spark: SparkSession, d: str) -> DataFrame:
    point = F.struct("s_suppkey", F.col("s_suppkey").cast("double").alias("x"), (F.col("s_acctbal") / 100).alias("y"))
    rows = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("line")).agg(F.sort_array(F.collect_list(point)).alias("p"))
    rows = rows.withColumn("p", F.transform("p", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))))
    stops = F.aggregate(graph.stops(F.col("p")), F.lit(0.0), lambda a, x: a + x)
    return rows.select("line", F.round(graph.polyline_length(F.col("p")), 6).alias("length"), F.round(stops, 6).alias("stops"), F.round(graph.cut_polyline(F.col("p"), F.lit(0.3))["x"], 6).alias("cut_x"))


# Streams


@query("""SELECT c.o_orderkey || ':' || (c.o_orderkey % 3) AS pair, c.o_orderkey AS waiter, c.o_orderdate AS asked_at, r.at AS answered_at FROM orders c LEFT JOIN (SELECT l_orderkey AS node, l_linenumber % 3 AS nonce, l_shipdate AS at FROM lineitem) r
ON r.node = c.o_orderkey AND r.nonce = c.o_orderkey % 3 AND r.at BETWEEN c.o_orderdate AND c.o_orderdate + INTERVAL 10 DAY""")
def challenge_response(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "orders").select(F.col("o_orderkey").alias("node_id"), (F.col("o_orderkey") % 3).alias("nonce"), F.col("o_orderdate").cast("timestamp").alias("ts"))
    told = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("node_id"), (F.col("l_linenumber") % 3).cast("long").alias("nonce"), F.col("l_shipdate").cast("timestamp").alias("ts"))
    return jobs.challenged(asked, told, "10 days").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("asked_at", "answered_at")})


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type AS kind, max(event_id) AS seq FROM events GROUP BY ALL")
def snapshot_coalescing(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("kind"), F.col("ts").cast("timestamp").alias("ts"))
    return jobs.latest_by_kind(rows, "6 hours").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT user_id AS node_id, count(*) AS beacons, count_if(event_id % 3 = 0)::BIGINT AS floods FROM events GROUP BY 1")
def beacon_floods(spark: SparkSession, d: str) -> DataFrame:
    rows = jobs.every_third(table(spark, d, "events").select(F.col("user_id").alias("node_id"), F.col("event_id").alias("seq")))
    return rows.groupBy("node_id").agg(F.count(F.lit(1)).alias("beacons"), F.count_if("flood").alias("floods"))


PARKED = "e AS (SELECT user_id AS dst_id, event_id AS msg_id, event_type = 'click' AS park, event_type = 'view' AS beacon, ts FROM events WHERE event_type IN ('click', 'view'))"


@query(f"""WITH {PARKED}, f AS (SELECT p.dst_id, p.msg_id, p.ts, min((b.ts, b.msg_id)) AS flushed FROM e p JOIN e b ON b.dst_id = p.dst_id AND b.beacon AND (b.ts, b.msg_id) > (p.ts, p.msg_id) WHERE p.park GROUP BY ALL)
SELECT dst_id, msg_id, flushed[1] AS "at" FROM f WHERE epoch_ms(flushed[1]) - epoch_ms(ts) <= 86400000""")
def outbox_stream(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "park").otherwise("beacon")
    rows = table(spark, d, "events").where("event_type in ('click', 'view')").select(F.col("user_id").alias("dst_id"), kind.alias("kind"), F.col("event_id").alias("msg_id"), F.col("ts").cast("timestamp").alias("ts"))
    return _stream(spark, rows, lambda s: jobs.outbox(s, 86_400)).withColumn("at", F.col("at").cast("timestamp_ntz"))


#: Frames of a packet that a text's bytes are dealt to; a longer text goes in several packets.
_FRAMES_A_PACKET, _MTU = 200, 206


WHOLE = "SELECT doc_id, octet_length(encode(text)) AS bytes, sha256(encode(text)) AS whole FROM documents"


def _framed(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, part, data): the frames of whole texts; a long one's bytes go in several packets, whose number the frames carry."""
    a_packet, raw = _FRAMES_A_PACKET * (_MTU - codec.FRAME_HEADER), F.col("raw")
    # Bytes and packets are columns of their own before they are cut: a function over an array would make them anew for each frame.
    last = F.greatest(F.lit(0), F.ceil(F.octet_length(raw) / a_packet).cast("int") - 1)
    packets = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("part"), F.substring(raw, i * a_packet + 1, F.lit(a_packet)).alias("packet")))
    rows = table(spark, d, "documents").select("doc_id", F.explode(F.array(F.encode("text", "UTF-8"))).alias("raw"))
    rows = rows.select("doc_id", F.explode(packets).alias("p"))
    return rows.select("doc_id", F.explode(codec.frames(F.col("p.packet"), F.col("p.part"), _MTU)).alias("f")).select("doc_id", "f.data")


def _frame_fields(rows: DataFrame) -> DataFrame:
    """Frames (link, data) as reassembled_packets() takes them: a link's packets are told apart by their number."""
    rows = rows.select("link", codec.frame_fields(F.col("data")).alias("g"))
    key = F.concat_ws(":", F.col("link").cast("string"), F.col("g.frag_id").cast("string"))
    return rows.select(key.alias("packet_key"), "g.idx", "g.cnt", "g.body", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("g.idx")).alias("ts"))


def _texts_of(packets: DataFrame) -> DataFrame:
    """(doc_id, bytes, whole) of packets (packet_key, data): a document's in order."""
    rows = packets.select(F.split("packet_key", ":").alias("k"), "data")
    whole = rows.groupBy(F.col("k")[0].cast("long").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct(F.col("k")[1].cast("int").alias("part"), F.hex("data").alias("h")))).alias("parts"))
    return whole.withColumn("data", F.unhex(F.array_join("parts.h", ""))).select("doc_id", F.octet_length("data").alias("bytes"), F.sha2("data", 256).alias("whole"))


@query(WHOLE)
def reassembly_stream(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts through frames, which a stream puts together again."""
    frames = _frame_fields(_framed(spark, d).withColumnRenamed("doc_id", "link"))
    return _texts_of(_stream(spark, frames, jobs.reassembled_packets))


@query("""WITH r AS (SELECT l_orderkey AS query_id, l_suppkey % 4 AS node, (l_quantity * 200)::BIGINT AS ms FROM lineitem), f AS (SELECT query_id, node, min(ms) AS a FROM r GROUP BY ALL), t AS (SELECT query_id, list_sort(list(a))[3] AS third FROM f GROUP BY 1)
SELECT query_id, node, count(*) AS replies FROM r JOIN t USING (query_id) WHERE ms <= least(6000, CASE WHEN third <= 6000 THEN third + 400 ELSE 6000 END) GROUP BY ALL""")
def collect_stream(spark: SparkSession, d: str) -> DataFrame:
    start = F.lit("2024-01-01").cast("timestamp")
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), (F.col("l_suppkey") % 4).alias("node"), start.alias("started"), F.timestamp_millis(F.unix_millis(start) + (F.col("l_quantity") * 200).cast("long")).alias("ts"))
    return _stream(spark, rows, lambda s: jobs.collected(s, 3)).groupBy("query_id", "node").agg(F.count(F.lit(1)).alias("replies"))


# Identity


@query(f"SELECT doc_id, hex(encode('{identity.MANIFEST_TAG.strip()}')) || '0A' || {_be('doc_id', 4)} || {_be('doc_id % 50', 4)} || {_be('3', 4)} || {_be('n_chars', 4)} || {_be('1700000000 + doc_id', 4)} || printf('%04X', octet_length(encode(lang))::BIGINT) || hex(encode(lang)) || printf('%04X', octet_length(encode(source))::BIGINT) || hex(encode(source)) || upper(sha256(text)) AS bytes FROM documents")
def manifest_bytes(spark: SparkSession, d: str) -> DataFrame:
    made = identity.manifest_bytes(F.col("doc_id"), F.col("doc_id") % 50, F.lit(3), F.col("n_chars"), F.col("doc_id") + 1_700_000_000, F.col("lang"), F.col("source"), F.sha2("text", 256))
    return table(spark, d, "documents").select("doc_id", F.hex(made).alias("bytes"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 4 = 0 AND l_linenumber % 3 = 0 THEN 'unsigned' WHEN l_linenumber % 4 <> 0 AND l_linenumber % 3 <> 0 AND l_suppkey = l_partkey % 100 AND l_returnflag <> 'R' THEN 'verified' ELSE 'forged' END AS verdict FROM lineitem")
def authorship(spark: SparkSession, d: str) -> DataFrame:
    key, sig = F.when(F.col("l_linenumber") % 4 != 0, F.lit(b"k")), F.when(F.col("l_linenumber") % 3 != 0, F.lit(b"s"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", identity.authorship(key, sig, F.col("l_suppkey"), F.col("l_partkey") % 100, F.col("l_returnflag") != "R").alias("verdict"))


@query("""WITH b AS (SELECT o_custkey AS doc_key, count(*) AS n FROM orders WHERE o_totalprice > 20000 GROUP BY 1), a AS (SELECT o_custkey AS doc_key, count(*) AS chunk_count FROM orders GROUP BY 1)
SELECT c_custkey AS doc_key, CASE WHEN c_custkey % 5 <> 0 AND coalesce(n, 0) = chunk_count THEN c_custkey % 3 <> 0 END AS intact FROM customer JOIN a ON a.doc_key = c_custkey LEFT JOIN b ON b.doc_key = c_custkey""")
def intact_documents(spark: SparkSession, d: str) -> DataFrame:
    meta = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("doc_key"), F.col("o_orderkey").alias("seq"), F.concat("o_orderpriority", F.col("o_orderkey").cast("string")).alias("text"), "o_totalprice")
    whole = meta.groupBy("doc_key").agg(F.count(F.lit(1)).alias("chunk_count"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda r: r["text"]), "\n").alias("body"))
    docs = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_key"), F.col("c_name").alias("title")).join(whole, "doc_key")
    told = F.when(F.col("doc_key") % 5 == 0, "").when(F.col("doc_key") % 3 == 0, "00").otherwise(identity.document_hash(F.col("title"), F.col("body")))
    return ingest.intact_documents(docs.select("doc_key", "title", told.alias("doc_hash"), "chunk_count"), meta, meta.where("o_totalprice > 20000"))


@query("SELECT s_suppkey, greatest(1, " + FNV.format(seed=hashing.FNV_SEED, s="sha256(s_name)") + ") AS node_id, list_transform(range(0, 5), lambda i: (('0x' || substr(sha256(s_name), (2 * i + 1)::INT, 2))::BIGINT % 32)::INT) AS icons FROM supplier")
def node_identity(spark: SparkSession, d: str) -> DataFrame:
    key = F.sha2("s_name", 256)
    return table(spark, d, "supplier").select("s_suppkey", hashing.node_id(key).alias("node_id"), identity.icons(key, 5).alias("icons"))


@query("""WITH r AS (SELECT event_id, event_id % 2 = 0 AS asked, event_id % 3 <> 0 AS nonce_ok, event_id % 5 <> 0 AS id_ok, event_id % 7 <> 0 AS sig_ok, CASE WHEN event_id % 11 = 0 THEN 'old' WHEN event_id % 13 = 0 THEN 'now' END AS known, event_id % 4 = 0 AS trusted FROM events), j AS (SELECT *, CASE WHEN NOT asked THEN 'unsolicited' WHEN NOT nonce_ok THEN 'wrong-nonce' WHEN NOT id_ok THEN 'wrong-id' WHEN NOT sig_ok THEN 'bad-signature' WHEN known = 'old' THEN 'key-changed' WHEN trusted THEN 'trusted' ELSE 'verified' END AS judged FROM r)
SELECT event_id, judged, CASE WHEN judged = 'verified' THEN 'trusted' ELSE judged END AS confirmed, CASE WHEN sig_ok THEN 'verified' ELSE 'unknown' END AS revoked, CASE WHEN sig_ok THEN 'signed' ELSE 'beaconed' END AS shown FROM j""")
def trust_states(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    known = F.when(e % 11 == 0, "old").when(e % 13 == 0, "now")
    judged = identity.judged(e % 2 == 0, e % 3 != 0, e % 5 != 0, e % 7 != 0, known, F.lit("now"), e % 4 == 0)
    at = F.when(e % 7 != 0, e + 1).otherwise(0)
    return table(spark, d, "events").select("event_id", judged.alias("judged"), identity.confirmed(judged).alias("confirmed"), identity.revoked(at).alias("revoked"), identity.shown_name(at, F.lit("signed"), F.lit("beaconed")).alias("shown"))
