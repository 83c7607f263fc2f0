"""The library's queries over the driver's tables, and the same in SQL.

Passages: documents, parts (ids) and embeddings (vectors). Questions: benchmark and conversations. Nodes: suppliers. Claims and
accesses: lineitem. Packets and beacons: events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftglass.functions import codec, hashing, identity, text, vectors
from driftglass.operators import hybrid, ingest, lexical, placement, search, state
from driftglass.plans import graph
from driftglass.session import scratch, staged, table
from driftglass.streaming import jobs

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _in(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _tokens(column: str) -> str:
    return rf"list_filter(regexp_split_to_array(regexp_replace(lower(coalesce({column}, '')), '[^a-z0-9\s.]', ' ', 'g'), '\s+'), lambda x: len(x) > 1 AND x NOT IN ({_in(text.STOP_WORDS)}))"


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


BM25 = f"""
post AS (SELECT doc_id, t AS term, count(*) AS tf FROM (SELECT doc_id, unnest({_tokens("text")}) AS t FROM documents) GROUP BY doc_id, t),
lens AS (SELECT doc_id, len({_tokens("text")}) AS l FROM documents),
tot AS (SELECT count(*) AS n, sum(l) / count(*) AS avg_len FROM lens),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
q AS (SELECT item_id AS query_id, t AS term, count(*) AS times FROM (SELECT item_id, unnest({_tokens("text")}) AS t FROM benchmark) GROUP BY item_id, t),
scores AS (SELECT query_id, doc_id, sum(times * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.5::DOUBLE) / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / avg_len)) ORDER BY term) AS score
  FROM q JOIN post USING (term) JOIN df USING (term) JOIN lens USING (doc_id), tot GROUP BY query_id, doc_id)
"""


@query(f"WITH {BM25} SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scores QUALIFY rank <= 5")
def bm25_search(spark: SparkSession, d: str) -> DataFrame:
    return lexical.best_by_terms(table(spark, d, "documents"), _questions(spark, d), 5)


@query(f"SELECT t AS term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_tokens('text')}) AS t FROM documents) GROUP BY t")
def token_document_frequency(spark: SparkSession, d: str) -> DataFrame:
    return lexical.documents_with(table(spark, d, "documents"))


@query(f"""WITH q AS (SELECT item_id AS query_id, list_distinct({_tokens("text")}) AS qs FROM benchmark), w AS (SELECT doc_id, list_distinct({_tokens("text")}) AS ws FROM documents),
pairs AS (SELECT query_id, doc_id, count(*) / max(len(qs)) AS score FROM (SELECT query_id, qs, unnest(qs) AS t FROM q) a JOIN (SELECT doc_id, unnest(ws) AS t FROM w) b USING (t) GROUP BY ALL)
SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM pairs QUALIFY rank <= 3""")
def term_coverage_top(spark: SparkSession, d: str) -> DataFrame:
    return lexical.best_by_terms(table(spark, d, "documents"), _questions(spark, d), 3, coverage=True)


#: Characters beyond U+FFFF count as two units.
_UNITS = "flatten(list_transform(string_split({s}, ''), lambda c: CASE WHEN unicode(c) > 65535 THEN [55296 + ((unicode(c) - 65536) >> 10), 56320 + ((unicode(c) - 65536) & 1023)] ELSE [unicode(c)] END))::HUGEINT[]"
FNV = "list_reduce(list_prepend({seed}::HUGEINT, " + _UNITS + "), lambda h, c: (xor(h::BIGINT, c::BIGINT)::HUGEINT * 16777619) % 4294967296)::BIGINT"


@query("SELECT doc_id, " + FNV.format(seed=hashing.FNV_SEED, s="concat(source, ':', doc_id)") + " AS id, " + FNV.format(seed=hashing.SIGN_SEED, s="lang") + " % 2 AS odd FROM documents")
def fnv1a_ids(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.col("source"), F.lit(":"), F.col("doc_id").cast("string"))
    return table(spark, d, "documents").select("doc_id", hashing.fnv1a(name).alias("id"), (hashing.fnv1a(F.col("lang"), hashing.SIGN_SEED) % 2).alias("odd"))


def _mix(a: str, b: str) -> str:
    """The mixer's last value as a scalar subquery's column h4, from a row's a and b."""
    h1 = f"((xor(xor({a}::BIGINT, {hashing.MIX_XOR}), {b}::BIGINT)::HUGEINT * {hashing.MIX_FIRST}) % 4294967296)::BIGINT"
    h2 = f"list_transform([{h1}], lambda h: ((xor(h, h >> 13)::HUGEINT * {hashing.MIX_SECOND}) % 4294967296)::BIGINT)"
    return f"list_transform({h2}, lambda h: xor(h, h >> 16))[1]"


@query(f"SELECT o_orderkey, {_mix('o_orderkey', 'o_custkey')} AS mixed FROM orders")
def mix32_pairs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", hashing.mix32(F.col("o_orderkey"), F.col("o_custkey")).alias("mixed"))


@query("""SELECT q.vec_id AS query_id, e.vec_id, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score,
row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id) AS rank
FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0 QUALIFY rank <= 5""")
def vector_topk_exact(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    return search.vector_top_k(rows, rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")), 5)


@query("""WITH s AS (SELECT vec_id, embedding::DOUBLE[] AS e, list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x))) / 127 AS m FROM embeddings),
t AS (SELECT vec_id, e, CASE WHEN m > 0 THEN m ELSE 1 END AS scale FROM s), q AS (SELECT vec_id, e, scale, list_transform(e, lambda x: least(127, greatest(-127, floor(x / scale + 0.5::DOUBLE)))) AS q FROM t)
SELECT vec_id, round(scale, 9) AS scale, list_sum(q)::BIGINT AS q_sum, round(list_dot_product(e, q) / sqrt(list_dot_product(q, q)), 6) AS cosine, floor(least(1, greatest(0, (e[1] + 1) / 2)) * 65535 + 0.5::DOUBLE)::INT AS wire FROM q""")
def quantise_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").withColumn("z", vectors.quantize(F.col("embedding")))
    back = vectors.dequantize(F.col("z.q"), F.col("z.scale"))
    total = F.aggregate("z.q", F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("vec_id", F.round("z.scale", 9).alias("scale"), total.alias("q_sum"), F.round(vectors.dot(F.col("embedding"), back), 6).alias("cosine"), vectors.wire_score(F.col("embedding")[0].cast("double")).alias("wire"))


#: The hashing embedder in SQL: words, pairs and runs of four letters of each text; then the buckets' weights, as unit vectors.
EMBED = f"""
texts AS (SELECT 'd' AS kind, doc_id AS id, text AS t FROM documents UNION ALL SELECT 'q', item_id, text FROM benchmark),
toks AS (SELECT kind, id, {_tokens("t")} AS ws FROM texts),
feats AS (
  SELECT kind, id, unnest(ws) AS f, 1.0::DOUBLE AS w FROM toks UNION ALL
  SELECT kind, id, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])), 0.7::DOUBLE FROM toks WHERE len(ws) > 1 UNION ALL
  SELECT kind, id, unnest(list_transform(range(1, len(x) - 2), lambda i: substr(x, i, 4))), 0.35::DOUBLE FROM (SELECT kind, id, unnest(ws) AS x FROM toks) WHERE len(x) >= 4),
names AS (SELECT DISTINCT f FROM feats),
hashed AS (SELECT f, {FNV.format(seed=hashing.FNV_SEED, s="f")} % 384 AS bucket, CASE WHEN {FNV.format(seed=hashing.SIGN_SEED, s="f")} % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sign FROM names),
raw AS (SELECT kind, id, bucket, sum(sign * w) AS w FROM feats JOIN hashed USING (f) GROUP BY ALL),
sized AS (SELECT kind, id, sqrt(sum(w * w)) AS n FROM raw GROUP BY ALL),
vec AS (SELECT kind, id, bucket, w / n AS w FROM raw JOIN sized USING (kind, id) WHERE abs(w) > 1e-12),
cos AS (SELECT q.id AS query_id, d.id AS doc_id, sum(q.w * d.w) AS c FROM vec q JOIN vec d USING (bucket) WHERE q.kind = 'q' AND d.kind = 'd' GROUP BY ALL)"""


@query(f"WITH {EMBED} SELECT id AS doc_id, count(*) AS buckets, round(sum(w), 6) AS total, round(max(abs(w)), 6) AS top, round(sum(w * bucket), 4) AS moment FROM vec WHERE kind = 'd' GROUP BY id")
def hash_embedding(spark: SparkSession, d: str) -> DataFrame:
    rows = search.embeddings(table(spark, d, "documents"), "doc_id", "text")
    held = F.filter(F.transform("vector", lambda x, i: F.struct(i.alias("bucket"), x.alias("weight"))), lambda e: F.abs(e["weight"]) > 1e-12)
    total = lambda f: F.aggregate(F.transform("held", f), F.lit(0.0), lambda a, x: a + x)
    rows = rows.select("doc_id", held.alias("held"))
    return rows.select("doc_id", F.size("held").cast("long").alias("buckets"), F.round(total(lambda e: e["weight"]), 6).alias("total"), F.round(F.array_max(F.transform("held", lambda e: F.abs(e["weight"]))), 6).alias("top"), F.round(total(lambda e: e["weight"] * e["bucket"]), 4).alias("moment"))


def _hybrid_sql(profile: search.Profile) -> str:
    dense = f"SELECT query_id, doc_id FROM cos QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(c, 9) DESC, doc_id) <= {5 * profile.factor}"
    ids = f"({dense}) UNION SELECT query_id, doc_id FROM scores" if profile.lexical_candidates else dense
    if not profile.factor:
        ids = "SELECT item_id AS query_id, doc_id FROM benchmark, documents"
    return f"""WITH {BM25}, {EMBED}, ids AS ({ids}), lex AS (SELECT query_id, doc_id, score / max(score) OVER (PARTITION BY query_id) AS lexical FROM scores),
qw AS (SELECT item_id AS query_id, list_distinct({_tokens("text")}) AS qs FROM benchmark), dw AS (SELECT doc_id, list_distinct({_tokens("text")}) AS ws FROM documents),
rel AS (SELECT query_id, doc_id, round(least(1, coalesce(c, 0) + {profile.coverage_weight}::DOUBLE * CASE WHEN len(qs) > 0 THEN len(list_intersect(qs, ws)) / len(qs) ELSE 0 END), 9) AS relevance, coalesce(lexical, 0) AS lexical
  FROM ids LEFT JOIN cos USING (query_id, doc_id) LEFT JOIN lex USING (query_id, doc_id) JOIN qw USING (query_id) JOIN dw USING (doc_id)),
r AS (SELECT query_id, doc_id, relevance, round(relevance + {profile.lexical_weight}::DOUBLE * lexical, 9) AS rank_score FROM rel WHERE relevance >= {profile.gate}::DOUBLE)
SELECT query_id, doc_id, round(relevance, 6) AS relevance, round(rank_score, 6) AS rank_score, row_number() OVER (PARTITION BY query_id ORDER BY rank_score DESC, doc_id) AS rank FROM r QUALIFY rank <= 5"""


def _hybrid(spark: SparkSession, d: str, profile: search.Profile) -> DataFrame:
    return hybrid.hybrid_search(table(spark, d, "documents").select("doc_id", "text"), _questions(spark, d), 5, profile)


@query(_hybrid_sql(search.MOBILE))
def hybrid_search_mobile(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d, search.MOBILE)


@query(_hybrid_sql(search.WEB))
def hybrid_search_web(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d, search.WEB)


@query(_hybrid_sql(search.exhaustive(search.MOBILE)))
def exhaustive_search(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d, search.exhaustive(search.MOBILE))


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("doc_id"), F.col("l_discount").alias("score"), (F.col("l_orderkey") % 7).alias("holder"),
        F.col("l_linenumber").alias("hops"), F.col("l_orderkey").alias("arrival"), F.col("l_linenumber").alias("node"), F.col("l_returnflag").alias("section"),
    )


HITS = "hits AS (SELECT l_suppkey AS query_id, l_partkey AS doc_id, l_discount AS score, l_orderkey % 7 AS holder, l_linenumber AS hops, l_orderkey AS arrival, l_linenumber AS node, l_returnflag AS section FROM lineitem)"


@query(f"WITH {HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY hops, holder) AS n, max(score) OVER (PARTITION BY query_id, doc_id) AS best FROM hits) SELECT query_id, doc_id, best AS score, holder, hops FROM r WHERE n = 1")
def mesh_merge(spark: SparkSession, d: str) -> DataFrame:
    return search.merge_results(_hits(spark, d))


@query(f"""WITH {HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY arrival, node) AS n, row_number() OVER (PARTITION BY query_id, doc_id, holder = 0 ORDER BY arrival, node) AS m FROM hits)
SELECT query_id, doc_id, max(score) FILTER (n = 1) AS score, coalesce(max(holder) FILTER (m = 1 AND holder <> 0), 0) AS holder FROM r GROUP BY query_id, doc_id""")
def mesh_merge_first(spark: SparkSession, d: str) -> DataFrame:
    return search.merge_first(_hits(spark, d))


@query(f"WITH {HITS} SELECT query_id, count(DISTINCT node) AS answered, count(DISTINCT node) FILTER (doc_id IS NOT NULL) AS responded FROM hits GROUP BY query_id")
def responded_nodes(spark: SparkSession, d: str) -> DataFrame:
    return search.answered(_hits(spark, d))


@query(f"""WITH {HITS}, u AS (SELECT query_id, doc_id, max(score) AS score, min(section) AS section FROM hits GROUP BY ALL), b AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM u),
c AS (SELECT * FROM b WHERE score >= best - 0.14::DOUBLE), s AS (SELECT *, row_number() OVER (PARTITION BY query_id, section ORDER BY score DESC, doc_id) AS n FROM c)
SELECT query_id, doc_id, score, section, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE n <= 2 QUALIFY rank <= 6""")
def passage_select(spark: SparkSession, d: str) -> DataFrame:
    hits = _hits(spark, d).groupBy("query_id", "doc_id").agg(F.max("score").alias("score"), F.min("section").alias("section"))
    return search.select_passages(hits)


@query("""WITH n AS (SELECT source AS query_id, doc_id, lang, text FROM documents WHERE length(trim(text)) > 0),
r AS (SELECT query_id, doc_id, sum(length(text) + length(lang) + length(query_id) + 16) OVER w::BIGINT AS used, row_number() OVER w AS rank FROM n WINDOW w AS (PARTITION BY query_id ORDER BY doc_id))
SELECT query_id, rank, doc_id, used FROM r WHERE used <= 12000 OR rank = 1""")
def context_fit(spark: SparkSession, d: str) -> DataFrame:
    """What of each source's documents, by id, fits a prompt."""
    rows = table(spark, d, "documents").select(F.col("source").alias("query_id"), F.col("doc_id").alias("rank"), F.col("lang").alias("title"), F.col("source").alias("section"), "text")
    some = search.fit_context(rows, 12000).select("query_id", F.col("rank").alias("doc_id"), F.col("used").cast("long").alias("used"))
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id")))  # as few as fit


@query(rf"""WITH q AS (SELECT conv_id AS query_id, text AS question FROM conversations WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1),
a AS (SELECT conv_id AS query_id, turn AS citation, text FROM conversations WHERE role = 'assistant'),
s AS (SELECT query_id, citation, unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS raw, generate_subscripts(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), 1) AS place FROM a),
k AS (SELECT query_id, list_filter(regexp_split_to_array(regexp_replace(lower(question), '[^a-z0-9\s]', ' ', 'g'), '\s+'), lambda w: len(w) > 2 AND w NOT IN ({_in(text.ANSWER_STOP_WORDS)})) AS ks FROM q),
c AS (SELECT query_id, citation, place, trim(raw) AS sentence, len(list_filter(ks, lambda w: contains(lower(trim(raw)), w))) + CASE WHEN regexp_matches(trim(raw), '^(?i)({search.IMPERATIVES})') THEN 0.75 ELSE 0 END AS score FROM s JOIN k USING (query_id) WHERE length(trim(raw)) > 25),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id, left(sentence, 40) ORDER BY score DESC, citation, place) AS n FROM c WHERE score > 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, citation, place) AS rank, sentence, citation, score::DOUBLE AS score FROM f WHERE n = 1 QUALIFY rank <= 4""")
def extractive_answer(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations")
    first = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    asked = rows.where("role = 'user'").withColumn("n", first).where("n = 1").select(F.col("conv_id").alias("query_id"), F.col("text").alias("question"))
    told = rows.where("role = 'assistant'").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("citation"), "text")
    return search.extractive_answer(told.join(asked, "query_id"))


def _html(column: str) -> str:
    # One expression in Spark; the engine that runs this SQL has no back-references, so here it goes over the page tag by tag.
    for tag in text.HIDDEN_TAGS:
        column = rf"regexp_replace({column}, '(?is)<{tag}\b.*?</{tag}\s*>', ' ', 'g')"
    column = rf"regexp_replace(regexp_replace(regexp_replace({column}, '(?s)<!--.*?-->', ' ', 'g'), '(?i)<h[1-6]\b[^>]*>', chr(10) || '## ', 'g'), '(?i)</h[1-6]\s*>', chr(10), 'g')"
    column = rf"regexp_replace(regexp_replace({column}, '(?i)</?({'|'.join(text.BLOCK_TAGS)})\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g')"
    return _squeezed(_entities(column))


def _entities(column: str) -> str:
    """Texts between entities, and the entities' values, put together again: each is decoded once."""
    entity = "&(?:#[xX]?[0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);"
    named = " ".join(f"WHEN '&{name};' THEN '{value.replace(chr(39), chr(39) * 2)}'" for name, value in text.ENTITIES.items())
    number = "CASE WHEN lower(e) LIKE '&#x%' THEN TRY_CAST('0x' || substr(e, 4, len(e) - 4) AS BIGINT) WHEN e LIKE '&#%' THEN TRY_CAST(nullif(regexp_extract(e, '^&#([0-9]+)', 1), '') AS BIGINT) END"
    value = f"CASE lower(e) {named} ELSE CASE WHEN {number} > 0 AND {number} <= 1114111 AND NOT {number} BETWEEN 55296 AND 57343 THEN chr(({number})::INT) ELSE e END END"
    return (
        f"list_transform([{column}], lambda t: array_to_string(list_transform(list_zip(regexp_split_to_array(t, '{entity}'), list_transform(regexp_extract_all(t, '{entity}'), lambda e: {value})), lambda z: z[1] || coalesce(z[2], '')), ''))[1]"
    )


def _squeezed(column: str) -> str:
    column = rf"regexp_replace(regexp_replace({column}, '[\t\r\f\v ]+', ' ', 'g'), ' ?\n ?', chr(10), 'g')"
    return rf"regexp_replace(regexp_replace(regexp_replace({column}, '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+', ''), '\s+$', '')"


@query(f"SELECT page_id, {_html('html')} AS body FROM pages")
def html_extract(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.html_text(F.col("html")).alias("body"))


@query(rf"SELECT page_id, nullif(trim(regexp_replace({_entities(r'''regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)''')}, '\s+', ' ', 'g')), '') AS title FROM pages")
def html_title(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.html_title(F.col("html")).alias("title"))


@query(r"""SELECT doc_id, coalesce(nullif(left(regexp_replace(regexp_replace(lower(trim(text)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 48), ''), 'note') || '.md' AS file,
left(trim(regexp_replace(text, '[\x00-\x1F\x7F]', '', 'g')), 24) AS name, CASE WHEN n_chars < 1024 THEN printf('%d B', n_chars) WHEN n_chars < 10240 THEN printf('%.1f KB', floor(n_chars / 102.4::DOUBLE + 0.5::DOUBLE) / 10) WHEN n_chars < 1048576 THEN printf('%.0f KB', floor(n_chars / 1024 + 0.5::DOUBLE)) ELSE printf('%.1f MB', n_chars / 1048576) END AS label FROM documents""")
def text_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.note_filename(F.col("text")).alias("file"), text.clean_name(F.col("text")).alias("name"), text.size_label(F.col("n_chars")).alias("label"))


@query(r"""SELECT source, count(*) AS documents, sum(octet_length(encode(text)))::BIGINT AS bytes, sum(len(list_filter(regexp_split_to_array(array_to_string(list_filter(string_split(text, chr(10)), lambda s: NOT regexp_matches(s, '^#|^(?i)source:')), ' '), '\s+'), lambda w: w <> '')))::BIGINT AS words FROM documents GROUP BY source""")
def corpus_manifest(spark: SparkSession, d: str) -> DataFrame:
    return ingest.manifest(table(spark, d, "documents"), "source")


@query("SELECT part, sum(h)::BIGINT AS hits FROM (SELECT l_partkey AS part, l_suppkey AS node, max(l_linenumber) AS h FROM lineitem GROUP BY ALL) GROUP BY part")
def gcounter_popularity(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("node"), F.col("l_linenumber").alias("hits"))
    return state.counter_values(state.counter_shares(log, "part", "node"), "part")


@query("""SELECT l_partkey AS part, l_suppkey AS node, max(l_shipdate) AS seen FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)
GROUP BY ALL HAVING epoch(TIMESTAMP '1998-08-01') - epoch(max(l_shipdate)) <= 7776000""")
def holder_live_set(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("node"), F.col("l_shipdate").alias("seen"))
    live = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("node"))
    return state.live_claims(log.join(live, "node", "left_semi"), "part", "node", "seen", F.lit("1998-08-01"), 7_776_000)


@query("SELECT user_id, event_id, event_type, version FROM (SELECT user_id, event_id, event_type, floor(value)::BIGINT AS version, row_number() OVER (PARTITION BY user_id ORDER BY floor(value) DESC, event_id) AS n FROM events) WHERE n = 1")
def lww_merge(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "events").select("user_id", "event_id", "event_type", F.floor("value").alias("version"))
    return state.newest(log, "user_id", "version", "event_id")


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    reliability = 0.02 + (F.col("s_suppkey") % 50) / 60
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("node_id"), reliability.alias("reliability"), F.floor(F.col("s_acctbal") * 300).alias("free_bytes"))


NODES = """nodes AS (SELECT s_suppkey AS node_id, 0.02::DOUBLE + (s_suppkey % 50) / 60 AS reliability, floor(s_acctbal * 300) AS free_bytes FROM supplier),
weighed AS (SELECT node_id, least(1, reliability) AS r, CASE WHEN free_bytes <= 0 OR reliability < 0.05::DOUBLE THEN 0 ELSE least(1, reliability) * least(1, free_bytes / 2097152) END AS w FROM nodes)"""
RANKED = f"""ranked AS (SELECT doc_id, node_id, round(score, 6) AS score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, node_id) - 1 AS rank FROM (
SELECT p_partkey AS doc_id, node_id, w / -ln(({_mix("p_partkey", "node_id")} + 0.5::DOUBLE) / 4294967296::DOUBLE) AS score FROM part, weighed WHERE w > 0))"""


@query(f"WITH {NODES}, {RANKED} SELECT * FROM ranked WHERE rank < 5")
def hrw_rank(spark: SparkSession, d: str) -> DataFrame:
    return placement.rank_nodes(table(spark, d, "part").select(F.col("p_partkey").alias("doc_id")), _nodes(spark, d), 5)


TARGETS = """eligible AS (SELECT count(*) AS n, avg(r) AS mean FROM weighed WHERE w > 0), hits AS (SELECT l_partkey AS doc_id, count(*) AS hits FROM lineitem GROUP BY 1),
targets AS (SELECT doc_id, hits, greatest(least(greatest(2 + floor(2 * least(1, ln(1 + hits) / ln(33)) + 0.5::DOUBLE), ceil(1.5::DOUBLE / mean)), least(5, n)), least(2, n))::INT AS desired FROM hits, eligible)"""


def _targets(spark: SparkSession, d: str) -> DataFrame:
    weight = placement.node_weight(F.col("reliability"), F.col("free_bytes"))
    one = _nodes(spark, d).where(weight > 0).agg(F.count(F.lit(1)).alias("n"), F.avg(placement.clamped(F.col("reliability"))).alias("mean"))
    hits = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("doc_id")).agg(F.count(F.lit(1)).alias("hits"))
    return hits.join(F.broadcast(one)).select("doc_id", "hits", placement.replica_target(F.col("hits"), F.col("n"), F.col("mean")).alias("desired"))


@query(f"WITH {NODES}, {TARGETS} SELECT doc_id, hits, desired FROM targets")
def replica_target(spark: SparkSession, d: str) -> DataFrame:
    return _targets(spark, d)


HELD = "held AS (SELECT l_partkey AS doc_id, l_suppkey AS self_id, count(*) AS own FROM lineitem GROUP BY ALL), live AS (SELECT doc_id, count(*) AS live FROM held GROUP BY 1)"
PLANS = f"""{NODES}, {RANKED}, {TARGETS}, {HELD}, pairs AS (SELECT doc_id, self_id FROM held UNION SELECT doc_id, node_id FROM ranked WHERE rank < 5),
facts AS (SELECT p.doc_id, p.self_id, t.desired, coalesce(k.rank, -1) AS rank, l.live, h.own IS NOT NULL AS have, p.self_id % 10 = 0 AS pressure, t.hits FROM pairs p JOIN targets t USING (doc_id) JOIN live l USING (doc_id)
 LEFT JOIN (SELECT * FROM ranked WHERE rank < 5) k ON k.doc_id = p.doc_id AND k.node_id = p.self_id LEFT JOIN held h ON h.doc_id = p.doc_id AND h.self_id = p.self_id),
plans AS (SELECT doc_id, self_id, desired, rank, live, hits, CASE WHEN have AND live <= 1 THEN 'hold' WHEN rank >= 0 AND rank < desired AND NOT have THEN 'pull' WHEN have AND pressure AND live > 2 THEN 'evict'
 WHEN have AND NOT (rank >= 0 AND rank < desired) AND live > desired THEN 'evict' WHEN have THEN 'hold' ELSE 'none' END AS action FROM facts)"""


def _plans(spark: SparkSession, d: str) -> DataFrame:
    held = state.incremented(table(spark, d, "lineitem").select(F.col("l_partkey").alias("doc_id"), F.col("l_suppkey").alias("self_id")), "doc_id", "self_id")
    live = held.groupBy("doc_id").agg(F.count(F.lit(1)).alias("live"))
    ranked = hrw_rank(spark, d).select("doc_id", F.col("node_id").alias("self_id"), F.col("rank"))
    rows = held.select("doc_id", "self_id", F.lit(True).alias("have")).join(ranked, ["doc_id", "self_id"], "full")
    rows = rows.join(_targets(spark, d), "doc_id").join(live, "doc_id")
    rows = rows.withColumns({"rank": F.coalesce("rank", F.lit(-1)), "have": F.coalesce("have", F.lit(False)), "pressure": F.col("self_id") % 10 == 0})
    action, reason = placement.plan(F.col("desired"), F.col("rank"), F.col("live"), F.col("have"), F.col("pressure"))
    return rows.select("doc_id", "self_id", "desired", F.col("rank").cast("long").alias("rank"), "live", "hits", action.alias("action"), reason.alias("reason"))


@query(f"WITH {PLANS} SELECT doc_id, self_id, desired, rank, live, action FROM plans")
def reconcile_plan(spark: SparkSession, d: str) -> DataFrame:
    return _plans(spark, d).drop("reason", "hits")


@query(f"""WITH {PLANS}, w AS (SELECT self_id, doc_id, live, hits, p_size * 1000 AS bytes FROM plans JOIN part ON p_partkey = doc_id WHERE action = 'pull'),
o AS (SELECT *, row_number() OVER v AS rank, (coalesce(sum(bytes) OVER (PARTITION BY self_id ORDER BY live, hits DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS spent FROM w WINDOW v AS (PARTITION BY self_id ORDER BY live, hits DESC, doc_id)),
k AS (SELECT *, min(CASE WHEN 120000 - spent >= 3 * bytes THEN 1 ELSE 0 END) OVER (PARTITION BY self_id ORDER BY rank) AS ok FROM o)
SELECT self_id, doc_id, live, hits, bytes, rank, spent FROM k WHERE ok = 1 AND rank <= 2""")
def pull_plan(spark: SparkSession, d: str) -> DataFrame:
    sizes = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), (F.col("p_size") * 1000).alias("bytes"))
    wanted = _plans(spark, d).where("action = 'pull'").join(sizes, "doc_id").select("self_id", "doc_id", "live", "hits", "bytes")
    return placement.pull_plan(wanted, 120_000)


@query(f"""WITH {PLANS}, t AS (SELECT l_partkey AS doc_id, l_suppkey AS self_id, max(l_shipdate) AS touched_at FROM lineitem GROUP BY ALL)
SELECT self_id, doc_id, row_number() OVER (PARTITION BY self_id ORDER BY live DESC, hits, touched_at, doc_id) AS rank FROM plans JOIN t USING (doc_id, self_id) WHERE action = 'evict'""")
def evict_order(spark: SparkSession, d: str) -> DataFrame:
    touched = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("doc_id"), F.col("l_suppkey").alias("self_id")).agg(F.max("l_shipdate").alias("touched_at"))
    return placement.eviction_order(_plans(spark, d).where("action = 'evict'").join(touched, ["doc_id", "self_id"])).select("self_id", "doc_id", "rank")


@query(f"""WITH {NODES}, {TARGETS}, {HELD} SELECT p_brand AS brand, round(avg(live), 6) AS mean_live, sum(hits)::BIGINT AS hits, max(desired) AS desired,
CASE WHEN avg(live) <= 1 THEN 'at risk' WHEN avg(live) + 0.001::DOUBLE < max(desired) THEN 'short' ELSE 'OK' END AS availability, count_if(live < desired)::BIGINT AS short_of, count_if(live <= 1)::BIGINT AS at_risk, count_if(p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_suppkey = 5))::BIGINT AS stored_here
FROM part JOIN targets ON doc_id = p_partkey JOIN live USING (doc_id) GROUP BY 1""")
def doc_replica_report(spark: SparkSession, d: str) -> DataFrame:
    live = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("doc_id")).agg(F.countDistinct("l_suppkey").alias("live"), F.max(F.col("l_suppkey") == 5).alias("here"))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_brand").alias("brand")).join(_targets(spark, d), "doc_id").join(live, "doc_id")
    by = rows.groupBy("brand").agg(F.avg("live").alias("m"), F.sum("hits").alias("hits"), F.max("desired").alias("desired"), F.count_if(F.col("live") < F.col("desired")).alias("short_of"), F.count_if(F.col("live") <= 1).alias("at_risk"), F.count_if("here").alias("stored_here"))
    return by.select("brand", F.round("m", 6).alias("mean_live"), "hits", "desired", placement.availability(F.col("m"), F.col("desired")).alias("availability"), "short_of", "at_risk", "stored_here")


@query("""WITH c AS (SELECT user_id, count_if(event_type = 'view') AS seen, count(*) // 3 AS expected, count_if(event_type = 'click') AS requests, count_if(event_type = 'purchase') AS responses FROM events GROUP BY 1)
SELECT user_id, seen::BIGINT AS seen, round(least(1, greatest(0, 0.7::DOUBLE * (seen + 2) / (greatest(seen, expected) + 4) + 0.3::DOUBLE * (responses + 1) / (greatest(responses, requests) + 2))), 6) AS reliability FROM c""")
def peer_reliability(spark: SparkSession, d: str) -> DataFrame:
    kind = lambda k: F.count_if(F.col("event_type") == k)
    by = table(spark, d, "events").groupBy("user_id").agg(kind("view").alias("seen"), F.floor(F.count(F.lit(1)) / 3).alias("expected"), kind("click").alias("requests"), kind("purchase").alias("responses"))
    return by.select("user_id", "seen", F.round(placement.reliability(F.col("seen"), F.col("expected"), F.col("requests"), F.col("responses")), 6).alias("reliability"))


#: Suppliers and orders are nodes, line items their links; floods start at five suppliers. A level has what was not there before.
_FLOOD = """e AS (SELECT DISTINCT l_suppkey AS a, 1000000 + l_orderkey AS b FROM lineitem), both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT r_regionkey + 1::BIGINT AS origin, r_regionkey + 1::BIGINT AS node, 0 AS hops FROM region UNION SELECT r.origin, l.b, r.hops + 1 FROM reach r JOIN both_ways l ON r.node = l.a WHERE r.hops < 4),
hops AS (SELECT origin, node, min(hops) AS hops FROM reach GROUP BY ALL)"""


def _flooded(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_orderkey") + 1_000_000).alias("b"))
    return graph.flood(links, table(spark, d, "region").select((F.col("r_regionkey").cast("long") + 1).alias("node")), 4)


@query(f"WITH RECURSIVE {_FLOOD} SELECT origin, node, hops FROM hops")
def flood_reach(spark: SparkSession, d: str) -> DataFrame:
    return _flooded(spark, d).select("origin", "node", "hops")


_VIA = "via AS (SELECT h.origin, h.node, h.hops, min(l.a) AS via FROM hops h JOIN both_ways l ON l.b = h.node JOIN hops p ON p.origin = h.origin AND p.node = l.a AND p.hops = h.hops - 1 GROUP BY ALL)"


@query(f"WITH RECURSIVE {_FLOOD}, {_VIA} SELECT node, origin AS dst, via, hops FROM via")
def flood_routes(spark: SparkSession, d: str) -> DataFrame:
    """The routes that a flood teaches: back to its origin, over the link that it came by."""
    return graph.routes_back(_flooded(spark, d))


@query(f"""WITH RECURSIVE {_FLOOD}, {_VIA}, asked AS (SELECT origin, node FROM hops WHERE hops = 4 OR node = origin),
back AS (SELECT origin, node, 0 AS step, node AS at_node FROM asked UNION ALL SELECT b.origin, b.node, b.step + 1, v.via FROM back b JOIN via v ON v.origin = b.origin AND v.node = b.at_node)
SELECT origin, node, string_agg(at_node::VARCHAR, '>' ORDER BY step) AS way FROM back GROUP BY ALL""")
def replies_back(spark: SparkSession, d: str) -> DataFrame:
    """The ways that replies take from where floods end, link by link."""
    tree = _flooded(spark, d)
    return graph.way_back(tree, tree.where("hops = 4 or node = origin").select("origin", "node")).withColumn("way", F.array_join("way", ">"))


@query("SELECT event_type, count(*) AS packets, round(sum(value), 4) AS total, count(DISTINCT user_id) AS peers FROM events GROUP BY 1")
def traffic_stats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("packets"), F.round(F.sum("value"), 4).alias("total"), F.countDistinct("user_id").alias("peers"))


def _packets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.col("user_id").alias("node_id"), "event_type", F.col("ts").cast("timestamp").alias("ts"), F.octet_length("props").cast("long").alias("bytes"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS packets, sum(octet_length(encode(props)))::BIGINT AS bytes FROM events GROUP BY ALL")
def rate_budget(spark: SparkSession, d: str) -> DataFrame:
    return jobs.rates(_packets(spark, d), "1 hour", "1 hour", "event_type").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH g AS (SELECT user_id AS node_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT node_id, ts, sum(n) OVER (PARTITION BY node_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT node_id, min(ts) AS "start", max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS beacons FROM s GROUP BY node_id, s""")
def beacon_sessions(spark: SparkSession, d: str) -> DataFrame:
    rows = jobs.sessions(_packets(spark, d), "node_id", "6 hours")
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("""SELECT o_orderkey AS doc_id, o_custkey AS waiter, o_orderdate AS asked_at, l_shipdate AS answered_at FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 8 DAY""")
def request_reply_join(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("waiter"), F.col("o_orderdate").cast("timestamp").alias("ts"))
    told = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_shipdate").cast("timestamp").alias("ts"))
    rows = jobs.matched(asked, told, within="8 days")
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("asked_at", "answered_at")})


@query("""SELECT source, doc_id, sent_before FROM (SELECT source, doc_id, (coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS sent_before FROM documents) WHERE sent_before < 20000""")
def catalog_page(spark: SparkSession, d: str) -> DataFrame:
    return state.catalog_page(table(spark, d, "documents").select("source", "doc_id", "n_chars"), [F.col("doc_id")], "n_chars", 20_000, ["source"], chunk=F.floor(F.col("doc_id") / 1000)).select("source", "doc_id", "sent_before")


@query("SELECT l_suppkey AS node, l_orderkey, l_linenumber, floor((row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) - 1) / 24)::BIGINT AS batch FROM lineitem")
def holder_batches(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("node"), "l_orderkey", "l_linenumber")
    return state.in_batches(rows, 24, [F.col("l_orderkey"), F.col("l_linenumber")], ["node"])


def _key(c: str) -> Column:
    return F.unhex(F.sha2(F.col(c).cast("string"), 256))


_GROUP = "lpad((('0x' || substr(dg, {at}, 6))::BIGINT % 100000)::VARCHAR, 5, '0')"


@query("WITH k AS (SELECT s_suppkey AS node, sha256(s_suppkey::VARCHAR) AS a, sha256(s_name) AS b FROM supplier), p AS (SELECT node, a, sha256(unhex(least(a, b) || greatest(a, b))) AS dg, sha256(unhex(a)) AS f FROM k) SELECT node, "
       + " || ' ' || ".join(_GROUP.format(at=6 * g + 1) for g in range(6)) + " AS number, upper(substr(f, 1, 4) || ' ' || substr(f, 5, 4) || ' ' || substr(f, 9, 4) || ' ' || substr(f, 13, 4)) AS print FROM p")
def safety_number(spark: SparkSession, d: str) -> DataFrame:
    a, b = _key("s_suppkey"), _key("s_name")
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"), identity.safety_number(a, b).alias("number"), identity.fingerprint(a).alias("print"))


@query("SELECT doc_id, sha256('" + identity.CONTENT_TAG.strip() + "' || chr(10) || source || chr(10) || text) AS hash FROM documents")
def doc_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", identity.document_hash(F.col("source"), F.col("text")).alias("hash"))


@query("""SELECT event_id, printf('03%02X040%X%08X%08X%08X', 1 + event_id % 12, event_id % 5, (event_id * 2654435761) % 4294967296, user_id, 0) || hex(encode(props)) AS packet,
greatest(1, CASE WHEN event_id % 5 = 0 THEN 4 ELSE event_id % 5 END - 4 + 1)::INT AS hops FROM events""")
def packet_codec(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events")
    kind, msg = (1 + F.col("event_id") % 12), (F.col("event_id") * F.lit(2654435761).cast("long")) % F.lit(4294967296)
    made = codec.encode_packet(kind, F.lit(4), F.col("event_id") % 5, msg, F.col("user_id"), F.lit(0), F.encode("props", "UTF-8"))
    rows = rows.withColumn("b", made).withColumn("p", codec.decode_packet(F.col("b")))
    again = codec.encode_packet(F.col("p.type"), F.col("p.ttl"), F.col("p.flags"), F.col("p.msg_id"), F.col("p.src_id"), F.col("p.dst_id"), F.col("p.payload"))
    return rows.select("event_id", F.hex(again).alias("packet"), graph.hops_travelled(F.col("p.flags"), F.col("p.ttl")).alias("hops"))


@query("SELECT doc_id, CASE WHEN octet_length(encode(text)) <= 494 * 255 THEN greatest(1, ceil(octet_length(encode(text)) / 494))::INT END AS frames, CASE WHEN octet_length(encode(text)) <= 494 * 255 THEN sha256(encode(text)) END AS whole FROM documents")
def frame_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.explode_outer(codec.frames(F.encode("text", "UTF-8"), F.col("doc_id"), 500)).alias("f"))
    rows = rows.select("doc_id", codec.frame_fields(F.col("f.data")).alias("g"))
    by = rows.groupBy("doc_id").agg(F.max("g.cnt").alias("frames"), codec.reassembled(F.col("g.idx"), F.col("g.cnt"), F.col("g.body")).alias("b"))
    return by.select("doc_id", "frames", F.sha2("b", 256).alias("whole"))


def _passages(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("filename"), "text")
    return ingest.passages(docs)


def _chunked(spark: SparkSession, d: str) -> DataFrame:
    """The passages, cut once for all tables that are made of them."""
    return staged(_passages(spark, d), "passages")


_STRIP = r"regexp_replace(regexp_replace({0}, '^[\s ]+', ''), '[\s ]+$', '')"
_CAP = ingest.PASSAGE_CHARS
#: The chunker in SQL: lines of each section; pieces of lines over the cap; and pieces put together as long as they fit, by a fold
#: over lists of (passages done, passage that is open).
CHUNKS = rf"""
files AS (SELECT 'doc-' || doc_id || '.md' AS filename, text FROM documents WHERE text IS NOT NULL),
heads AS (SELECT filename, coalesce(nullif(regexp_extract_all(text, '(?m)^#[ \t]+(.*?)[ \t]*$', 1)[-1], ''), CASE WHEN regexp_matches(text, '(?m)^#[ \t]') THEN '' END, regexp_replace(filename, '\.[A-Za-z0-9]+$', '')) AS title,
  coalesce(nullif(trim(regexp_extract(text, '(?im)^source:[ \t]*(.*)$', 1)), ''), filename) AS source,
  regexp_split_to_array(regexp_replace(regexp_replace(chr(10) || text, '\n#[ \t][^\n]*', chr(10), 'g'), '(?i)\nsource:[^\n]*', chr(10), 'g'), '\n##[ \t]+') AS parts FROM files),
sections AS (SELECT filename, title, source, generate_subscripts(parts, 1) AS i, unnest(parts) AS p FROM heads),
lines AS (SELECT filename, title, source, i, CASE WHEN i = 1 THEN '' ELSE trim(string_split(p, chr(10))[1]) END AS section,
  list_filter(list_transform(string_split(CASE WHEN i = 1 THEN p WHEN contains(p, chr(10)) THEN regexp_replace(p, '^[^\n]*\n', '') ELSE '' END, chr(10)), lambda x: {_STRIP.format("x")}), lambda x: x <> '') AS ls FROM sections),
cut AS (SELECT * EXCLUDE ls, list_filter(flatten(list_transform(flatten(list_transform(ls, lambda x: CASE WHEN len(x) <= {_CAP} THEN [x] ELSE string_split(regexp_replace(x, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) END)),
  lambda x: CASE WHEN len(x) <= {_CAP} THEN [x] ELSE list_transform(range(0, ((len(x) - 1) // {_CAP}) + 1), lambda j: substr(x, (j * {_CAP} + 1)::INT, {_CAP})) END)), lambda x: x IS NOT NULL) AS xs FROM lines),
folded AS (SELECT * EXCLUDE xs, list_reduce(list_transform(xs, lambda x: {{'done': []::VARCHAR[], 'open': x}}), lambda a, x: CASE WHEN a.open = '' OR len(a.open) + 1 + len(x.open) <= {_CAP}
  THEN {{'done': a.done, 'open': CASE WHEN a.open = '' THEN x.open ELSE a.open || chr(10) || x.open END}} ELSE {{'done': list_append(a.done, a.open), 'open': x.open}} END) AS f FROM cut WHERE len(xs) > 0),
packed AS (SELECT filename, title, source, i, section, CASE WHEN f.open = '' THEN f.done ELSE list_append(f.done, f.open) END AS ps FROM folded),
flat AS (SELECT filename, title, source, i, section, generate_subscripts(ps, 1) AS j, unnest(ps) AS text FROM packed),
seqs AS (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY i, j) - 1 AS seq FROM flat),
whole AS (SELECT filename, string_agg(text, chr(10) ORDER BY seq) AS body FROM seqs GROUP BY 1),
keyed AS (SELECT s.*, {FNV.format(seed=hashing.FNV_SEED, s="(title || chr(10) || body)")} AS doc_key FROM seqs s JOIN whole USING (filename)),
passages AS (SELECT doc_key, seq::INT AS seq, title, source, section, text, {FNV.format(seed=hashing.FNV_SEED, s="concat(doc_key, ':', seq, ':', text)")} AS doc_id FROM keyed)"""


@query(f"WITH {CHUNKS} SELECT doc_key, seq, title, source, section, text, doc_id FROM passages")
def chunk_passages(spark: SparkSession, d: str) -> DataFrame:
    return _passages(spark, d)


@query(f"""WITH {CHUNKS}, m AS (SELECT doc_id, doc_key FROM passages), b AS (SELECT doc_id FROM passages), k AS (SELECT doc_key, count(*) AS known, count(b.doc_id) AS stored FROM m LEFT JOIN b USING (doc_id) GROUP BY 1),
t AS (SELECT doc_key, title, source, sum(len(text))::BIGINT AS bytes, count(*) AS chunk_count FROM passages GROUP BY ALL) SELECT doc_key, title, source, bytes, chunk_count, known, stored FROM t LEFT JOIN k USING (doc_key)""")
def doc_summary(spark: SparkSession, d: str) -> DataFrame:
    docs, meta, bodies = ingest.tables(_chunked(spark, d))
    return docs.join(ingest.document_counts(meta, bodies.select("doc_id", "text")), "doc_key", "left")


@query(f"""WITH {CHUNKS} SELECT doc_key, count(*) AS known, count_if(len(text) > 300)::BIGINT AS stored FROM passages GROUP BY doc_key""")
def partly_held(spark: SparkSession, d: str) -> DataFrame:
    _, meta, bodies = ingest.tables(_chunked(spark, d), F.length("text") > 300)
    return ingest.document_counts(meta, bodies)


@query(f"""WITH {CHUNKS} SELECT doc_id, CASE WHEN len(text) > 300 THEN text ELSE left(text, {ingest.SNIPPET_CHARS}) END AS text, len(text) > 300 AS held FROM passages""")
def shown_passages(spark: SparkSession, d: str) -> DataFrame:
    _, meta, bodies = ingest.tables(_chunked(spark, d), F.length("text") > 300)
    return ingest.shown_text(meta, bodies)


@query(f"""WITH {CHUNKS}, m AS (SELECT count(*) AS known, sum({ingest.META_BYTES} + len(title) + len(section) + len(left(text, {ingest.SNIPPET_CHARS})))::BIGINT AS meta_bytes, count(*) AS stored, sum(len(text))::BIGINT AS body_chars FROM passages)
SELECT (SELECT count(*) FROM (SELECT DISTINCT doc_key, title, source FROM passages)) AS documents, known, meta_bytes, stored, body_chars, greatest(0, 1048576 - meta_bytes - body_chars)::BIGINT AS free_bytes FROM m""")
def catalog_stats(spark: SparkSession, d: str) -> DataFrame:
    return ingest.catalog_stats(*ingest.tables(_chunked(spark, d)))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(173), '', 'g'), '([a-z])-\n([a-z])', '\1\2', 'g'),
'[\t\r\f\v ]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '(\p{L}|,)\n(\p{Ll})', '\1 \2', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS tidied FROM documents""")
def text_tidy(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.tidy(F.col("text")).alias("tidied"))


def _stream(spark: SparkSession, rows: DataFrame, job, mode: str = "append") -> DataFrame:
    """What a streaming job makes of rows, all of them read as a stream from the shared folder and written back there."""
    root = scratch(spark, "stream")
    rows.write.parquet(f"{root}/in")
    source = spark.readStream.schema(rows.schema).parquet(f"{root}/in")
    job(source).writeStream.outputMode(mode).format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out")


@query("SELECT DISTINCT user_id * 1000 + floor(value)::BIGINT AS msg_id FROM events")
def dedup_stream(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select((F.col("user_id") * 1000 + F.floor("value")).alias("msg_id"), F.col("ts").cast("timestamp").alias("ts"))
    return _stream(spark, rows, lambda s: jobs.without_duplicates(s, within="60 days")).select("msg_id")


KINDS = "CASE event_type WHEN 'view' THEN 'hello' WHEN 'click' THEN 'request' WHEN 'purchase' THEN 'response' ELSE 'tick' END"


@query(f"""WITH e AS (SELECT user_id, list({KINDS} ORDER BY event_id) AS ks FROM events GROUP BY 1),
f AS (SELECT user_id, list_reduce(list_prepend({{'k': '', 's': 0::BIGINT, 'x': 0::BIGINT, 'q': 0::BIGINT, 'r': 0::BIGINT}}, list_transform(ks, lambda k: {{'k': k, 's': 0::BIGINT, 'x': 0::BIGINT, 'q': 0::BIGINT, 'r': 0::BIGINT}})),
 lambda a, b: list_transform([{{'s': a.s + (b.k = 'hello')::BIGINT, 'x': CASE b.k WHEN 'hello' THEN greatest(a.x, a.s + 1) WHEN 'tick' THEN a.x + 1 ELSE a.x END, 'q': a.q + (b.k = 'request')::BIGINT, 'r': a.r + (b.k = 'response')::BIGINT}}],
 lambda n: CASE WHEN n.x >= {jobs.HALVE_AT} OR n.q >= {jobs.HALVE_AT} THEN {{'k': '', 's': n.s // 2, 'x': n.x // 2, 'q': n.q // 2, 'r': n.r // 2}} ELSE {{'k': '', 's': n.s, 'x': n.x, 'q': n.q, 'r': n.r}} END)[1]) AS z FROM e)
SELECT user_id AS node_id, z.s AS hello_seen, z.x AS hello_expected, z.q AS requests, z.r AS responses FROM f""")
def reliability_stream(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "hello").when(F.col("event_type") == "click", "request").when(F.col("event_type") == "purchase", "response").otherwise("tick")
    rows = table(spark, d, "events").select(F.col("user_id").alias("node_id"), kind.alias("kind"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"))
    return _stream(spark, rows, jobs.reliability_counters)
