"""SQL for the operators whose rows DuckDB can make by itself: license scans, mixing, chat formatting, ranked
search and the filter audit.

Each goes a plainer way than the operator: license places by comparing every position of a text, seats by ranking every quotient.
"""

from __future__ import annotations

from driftglass.llm import chat, licenses, mixing
from driftglass.llm import filter_audit as filter_audit_operator
from driftglass.llm import ranked_search as ranked_search_operator

_SPACED = r"[^\x20\x09-\x0D]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _values(rows: list[tuple]) -> str:
    shown = lambda x: str(x) if isinstance(x, int) else "'" + x + "'"
    return ", ".join("(" + ", ".join(map(shown, r)) + ")" for r in rows)


def license_scan() -> str:
    """Every position of every text is compared with every phrase; a template's places are folded word by word, as the operator
    does, so that sums of IDF are added in one order."""
    phrases = [(i, label, o, w) for i, (p, label) in enumerate(licenses.BASE.items()) for o, w in enumerate(p.split())]
    keys, whole = [], []
    for i, (label, words, key) in enumerate(licenses.TEMPLATES):
        ws, ks = words.split(), key.split()
        at = next(j for j in range(len(ws)) if ws[j : j + len(ks)] == ks)
        keys += [(i, label, at + o, w) for o, w in enumerate(ks)]
        whole += [(i, o, w) for o, w in enumerate(ws)]
    places = """SELECT rid, id, start FROM (SELECT w.rid, p.id, w.place - p.o AS start, count(*) AS n FROM {p} p JOIN w USING (word) GROUP BY ALL) JOIN (SELECT id, count(*) AS n FROM {p} GROUP BY id) USING (id, n)"""
    return rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), base(id, label, o, word) AS (VALUES {_values(phrases)}
), keyed(id, label, o, word) AS (VALUES {_values(keys)}
), whole(id, o, word) AS (VALUES {_values(whole)}
), vocabulary AS (
  SELECT word FROM base UNION SELECT word FROM whole
), w AS (
  SELECT rid, place, word FROM (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS place FROM d) JOIN vocabulary USING (word)
), idf AS (
  SELECT word, ln(1 + (n + 1) / (coalesce(df, 0) + 0.5::DOUBLE)) AS idf
  FROM vocabulary LEFT JOIN (SELECT word, count(DISTINCT rid) AS df FROM w GROUP BY word) USING (word), (SELECT count(*) AS n FROM d)
), base_at AS (
  {places.format(p="base")}
), key_at AS (
  {places.format(p="keyed")}
), fold(rid, id, o, starts, part, total) AS (
  SELECT rid, id, 0, list(start), 0::DOUBLE, 0::DOUBLE FROM key_at GROUP BY rid, id
  UNION ALL
  SELECT rid, id, o + 1, CASE WHEN len(hit) > 0 THEN hit ELSE starts END, CASE WHEN len(hit) > 0 THEN part + idf ELSE part END, total + idf
  FROM (SELECT f.*, i.idf, list_filter(f.starts, lambda s: s + f.o >= 0 AND list_extract(d.ws, (s + f.o + 1)::BIGINT) = t.word) AS hit
        FROM fold f JOIN whole t ON t.id = f.id AND t.o = f.o JOIN idf i ON i.word = t.word JOIN d ON d.rid = f.rid)
), best AS (
  SELECT rid, max(part / total) AS score FROM (SELECT * FROM fold QUALIFY o = max(o) OVER (PARTITION BY rid, id)) GROUP BY rid
), b AS (
  SELECT rid, count(*) AS n, min(start) AS first, max(start) AS last FROM base_at GROUP BY rid
), named AS (
  SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (own = 0) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT rid, label, 0 AS own FROM base_at JOIN (SELECT DISTINCT id, label FROM base) USING (id)
        UNION ALL SELECT rid, label, 1 FROM key_at JOIN (SELECT DISTINCT id, label FROM keyed) USING (id)) GROUP BY rid
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, first::BIGINT AS first_word, last::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, least(1::DOUBLE, coalesce(score, 0)) AS score
FROM d LEFT JOIN b USING (rid) LEFT JOIN named USING (rid) LEFT JOIN best USING (rid)
"""


def mix_sources() -> str:
    """Every quotient of every party is made and ranked."""
    block, cap, weights = mixing.BLOCK, mixing.CAP, mixing.WEIGHTS
    return rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_SPACED}')) AS size, md5(doc_id || ':{mixing.SEED}') AS key FROM documents
), n AS (
  SELECT greatest(1, ceil(count(*) / {mixing.SHARD_ROWS}))::BIGINT AS shards, sum(size) AS everything FROM d
), e AS (
  SELECT d.*, ('0x' || substr(key, 1, 8))::BIGINT % shards AS shard FROM d, n
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source
), w AS (
  SELECT *, [{", ".join(map(str, weights))}][(rank - 1) % {len(weights)} + 1] AS w, source_size * {cap} AS most FROM s
), capped AS (
  SELECT *, (everything - coalesce(sum(most) OVER (ORDER BY most / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY most / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w, n
), level AS (
  SELECT arg_min(level, (most / w, rank)) AS level FROM capped WHERE level * w < most
), t AS (
  SELECT c.source, source_size, rank, least(most::DOUBLE, coalesce(w * l.level, most::DOUBLE)) AS target, floor(everything / {block} + 0.5::DOUBLE)::BIGINT AS blocks FROM capped c, level l
), seats AS (
  SELECT rank, count(*) AS blocks FROM (
    SELECT rank, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, rank, k) AS won, blocks FROM (SELECT *, unnest(range(blocks)) AS k FROM t WHERE target > 0)
  ) WHERE won <= blocks GROUP BY rank
), cells AS (
  SELECT t.rank, source_size, shard, sum(size)::BIGINT AS cell, any_value(coalesce(seats.blocks, 0)) AS blocks
  FROM e JOIN t ON e.source IS NOT DISTINCT FROM t.source LEFT JOIN seats ON seats.rank = t.rank GROUP BY ALL
), got AS (
  SELECT rank, shard, count(*) AS got FROM (
    SELECT rank, shard, blocks, row_number() OVER (PARTITION BY rank ORDER BY cell / (2 * k + 1) DESC, shard, k) AS won
    FROM (SELECT *, unnest(range(blocks)) AS k FROM cells WHERE cell > 0)
  ) WHERE won <= blocks GROUP BY ALL
), quota AS (
  SELECT rank, shard, cell, least(coalesce(got, 0) * {block}, cell * {cap}) AS quota FROM cells LEFT JOIN got USING (rank, shard)
), rounds AS (
  SELECT *, CASE WHEN cell > 0 THEN quota // cell ELSE 0 END AS rounds FROM quota
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (rounds * size + greatest(0, least(size, quota - rounds * cell - coalesce(sum(size) OVER (PARTITION BY t.rank, e.shard ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))))::BIGINT AS taken
FROM e JOIN t ON e.source IS NOT DISTINCT FROM t.source JOIN rounds r ON r.rank = t.rank AND r.shard = e.shard
"""


def chat_format() -> str:
    said = chat.PROBE
    escaped = lambda c: f"replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    fixed = len(chat.OPEN) + len(chat.CLOSE) + len(chat.END)
    return rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{said}' UNION ALL SELECT -7, 1, 'assistant', '{said}'
), t AS (
  SELECT *, {escaped("text")} AS content, len(regexp_extract_all(text, '{_SPACED}')) AS words FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, content)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, content) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({fixed} + length({escaped("role")}) + length(content))::BIGINT AS formatted_chars,
  count(*) FILTER (role = 'assistant') AS n_loss_spans, 0::BIGINT AS n_attachments, sum(words)::BIGINT AS expanded_tokens
FROM t GROUP BY conv_id
"""


def filter_audit() -> str:
    """Orders are made by joining the letters; the documents of a part that fail alike are counted first and then replayed."""
    letters = ", ".join(f"('{f}', {1 << i})" for i, f in enumerate(filter_audit_operator.FILTERS))
    joined = "".join(f" JOIN f f{i} ON f{i}.c NOT IN ({', '.join(f'f{j}.c' for j in range(1, i))})" for i in range(2, 6))
    return rf"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS ws FROM documents
), d AS (
  SELECT doc_id, part, (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT
    + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT
    + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS fails FROM w
), l AS (
  SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), g AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM d LEFT JOIN l USING (doc_id) GROUP BY part, fails
), f(c, bit) AS (VALUES {letters}
), o AS (
  SELECT f1.c || f2.c || f3.c || f4.c || f5.c AS filter_order, [f1.bit, f2.bit, f3.bit, f4.bit, f5.bit] AS bits FROM f f1{joined}
), s AS (
  SELECT filter_order, k AS step, bits[k] AS bit, list_sum(bits[1:k - 1])::INT AS earlier FROM (SELECT *, unnest(range(1, 6)) AS k FROM o)
), r AS (
  SELECT part, filter_order, step, bit, sum(n) FILTER (fails & (coalesce(earlier, 0) | bit) = 0) AS kept,
    sum(n) FILTER (fails & bit > 0 AND fails & coalesce(earlier, 0) = 0) AS removed, sum(n) FILTER (fails & bit > 0 AND fails & coalesce(earlier, 0) > 0) AS redundant,
    sum(n) FILTER (fails = bit) AS unique_fails, sum(good) FILTER (fails & bit > 0 AND fails & coalesce(earlier, 0) = 0) AS good_lost,
    sum(toxic) FILTER (fails & bit > 0 AND fails & coalesce(earlier, 0) = 0) AS toxic_lost
  FROM g CROSS JOIN s GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley
FROM r
"""


def ranked_search() -> str:
    """Each item's terms meet each document's counts, and every pair's sum is ranked."""
    found = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')".format(_LOWER)
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, {found} AS ws FROM documents
), s AS (
  SELECT count(*)::BIGINT AS n, sum(len(ws))::BIGINT AS total FROM d WHERE len(ws) > 0
), q AS (
  SELECT id, item_id, term, count(*) AS times FROM (SELECT row_number() OVER () AS id, item_id, unnest({found}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL
), p AS (
  SELECT rid, term, count(*)::BIGINT AS tf FROM (SELECT rid, unnest(ws) AS term FROM d) SEMI JOIN q USING (term) GROUP BY ALL
), w AS (
  SELECT term, floor({ranked_search_operator.WEIGHT} * ln((2 * n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s
), m AS (
  SELECT rid, doc_id, 100 - {ranked_search_operator.SHARE} + ({ranked_search_operator.SHARE} * len(ws) * n) // total AS m FROM d, s WHERE len(ws) > 0
), x AS (
  SELECT id, item_id, rid, doc_id, sum(times * w * (({ranked_search_operator.SCALE} * tf) // ({ranked_search_operator.TF} * tf + {ranked_search_operator.M} * m)))::BIGINT AS score
  FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (rid) GROUP BY ALL
)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, doc_id) AS rank FROM x WHERE score > 0
) WHERE rank <= {ranked_search_operator.TOP}
"""


ORACLES = {"op11_ranked_search": ranked_search(), "op13_filter_audit": filter_audit(), "op8_license_scan": license_scan(), "op9_mix_sources": mix_sources(), "op10_chat_format": chat_format()}
