"""Byte-level BPE, encoding and decoding, by recursive DuckDB queries over each partition's rows (operator 12).

A task cuts its texts into words by the tokenizer's pattern and hands them to its own in-memory DuckDB, some A_BATCH words at a time:

1. Words that the partition has not met are told apart. One that is a token by itself is done. Each byte of the others becomes a
   row (word, position, token), and a recursive query joins neighbouring rows with the merge table and contracts each word's leftmost
   pair of the least rank, until no pair of it merges.
2. Words meet their ids, and ordered aggregation joins the ids of a document.
3. Decoding joins each id with its bytes and aggregates these in the ids' order.

Rows are put in order once and then aggregated as they come (the connection has one thread and keeps the order of rows), which takes
half the time of an order within each aggregate.

In a step, a pair of the least rank that stands further right is contracted too, where it would be next by the same rule: it overlaps
with none that is contracted, and no pair that a contraction makes can rank below it. Which tokens can be in such a pair is known from
the merge table (`alone`). So a word of n equal letters takes a number of steps in proportion to log n, not n.

Nothing is exchanged: the vocabulary goes to each task (its size is checked), and a task's tables are cleared when they hold A_TABLE
words, so that memory doesn't grow with the partition.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import islice

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftglass.llm.common import table

#: Words that go through DuckDB at once, and distinct words that a task remembers.
A_BATCH, A_TABLE = 400_000, 1_500_000
#: Bytes of a vocabulary file that is sent to all tasks at most.
MOST_BYTES = 32 << 20

_CONTRACT = """
WITH RECURSIVE t(w, pos, npos, id, step) AS (
  SELECT w, i, CASE WHEN i < n THEN i + 1 END, id, 0 FROM (
    SELECT w, length(hex) // 2 AS n, unnest(range(1, length(hex) // 2 + 1)) AS i, substr(hex, 2 * i - 1, 2) AS byte FROM parts
  ) JOIN bytes ON bytes.hex = byte
  UNION ALL
  (WITH pairs AS MATERIALIZED (
    SELECT a.w, a.pos, a.npos, b.npos AS nnpos, m.merged, m.alone
    FROM t a JOIN t b ON b.w = a.w AND b.pos = a.npos JOIN merges m ON m.l = a.id AND m.r = b.id
  ), least AS MATERIALIZED (
    SELECT w, first >> 32 AS merged, first & 4294967295 AS spot FROM (SELECT w, min(merged::BIGINT << 32 | pos) AS first FROM pairs GROUP BY w)
  ), hits AS NOT MATERIALIZED (
    SELECT p.*, lag(p.npos) OVER (PARTITION BY p.w ORDER BY p.pos) IS NOT DISTINCT FROM p.pos AS laps
    FROM pairs p JOIN least q ON q.w = p.w AND q.merged = p.merged AND (NOT p.alone OR q.spot = p.pos)
  ), chains AS (
    SELECT *, max(CASE WHEN laps THEN 0 ELSE pos END) OVER (PARTITION BY w ORDER BY pos) AS head FROM hits
  ), taken AS MATERIALIZED (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY w, head ORDER BY pos) AS k FROM chains) WHERE k % 2 = 1
  )
  SELECT t.w, t.pos, CASE WHEN k.w IS NULL THEN t.npos ELSE k.nnpos END, coalesce(k.merged, t.id), t.step + 1
  FROM t SEMI JOIN least ON least.w = t.w LEFT JOIN taken k ON k.w = t.w AND k.pos = t.pos ANTI JOIN taken g ON g.w = t.w AND g.npos = t.pos)
)
SELECT w, list(id) AS ids FROM (SELECT w, id FROM t JOIN (SELECT w, max(step) AS step FROM t GROUP BY w) USING (w, step) ORDER BY w, pos) GROUP BY w
"""


def ranks_of(raw: bytes) -> dict[bytes, int]:
    """Tokens with their ranks, from a rank file: a line each, the token in base 64 and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line)}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[int, int, int, bool]]:
    """(left, right, merged, alone): each pair of tokens that together are a token; a pair's rank is that token's. alone: the merged
    token is part of a pair that ranks below it, so that contracting it may change what is next."""
    rows = [(ranks[token[:i]], ranks[token[i:]], rank) for token, rank in ranks.items() for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
    alone = {part for left, right, merged in rows for part in (left, right) if merged < part}
    return [(*row, row[2] in alone) for row in rows]


class Coder:
    """A task's DuckDB with a vocabulary. Every single byte must be a token."""

    def __init__(self, raw: bytes) -> None:
        ranks = ranks_of(raw)
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"bytes without a token: {missing[:9]}")
        self.con = duckdb.connect(config={"threads": 1, "preserve_insertion_order": True})
        tokens = pa.table({"id": pa.array(ranks.values(), pa.int32()), "hex": [t.hex().upper() for t in ranks]})
        left, right, merged, alone = zip(*merges_of(ranks), strict=True) if len(ranks) > 256 else ((),) * 4
        pairs = pa.table({"l": pa.array(left, pa.int32()), "r": pa.array(right, pa.int32()), "merged": pa.array(merged, pa.int32()), "alone": pa.array(alone, pa.bool_())})
        for name, rows in (("vocabulary", tokens), ("merges", pairs)):
            self.con.register("given", rows)
            self.con.execute(f"CREATE TABLE {name} AS FROM given")
        self.con.execute("CREATE TABLE bytes AS FROM vocabulary WHERE length(hex) = 2")
        self.con.execute("CREATE TABLE known (word VARCHAR, ids INTEGER[])")

    def encode(self, words: pa.Table) -> pa.Table:
        """(doc, ids): the ids of each document's words (doc, pos, word), in the order of pos."""
        run, cut = self.con.execute, words["word"].combine_chunks().dictionary_encode()
        self.con.register("codes", pa.table({"code": pa.array(range(len(cut.dictionary)), pa.int32()), "word": cut.dictionary}))
        self.con.register("given", pa.table({"doc": words["doc"], "pos": words["pos"], "code": cut.indices}))
        if run("SELECT count(*) FROM known").fetchone()[0] > A_TABLE:
            run("DELETE FROM known")
        run("CREATE OR REPLACE TEMP TABLE fresh AS SELECT code AS w, word, hex(encode(word)) AS hex FROM codes ANTI JOIN known USING (word)")
        run("INSERT INTO known SELECT word, [id] FROM fresh JOIN vocabulary USING (hex)")
        run("CREATE OR REPLACE TEMP TABLE parts AS SELECT w, hex FROM fresh ANTI JOIN vocabulary USING (hex)")
        run(f"INSERT INTO known SELECT word, ids FROM fresh JOIN ({_CONTRACT}) USING (w)")
        run("CREATE OR REPLACE TEMP TABLE here AS SELECT code, ids FROM codes JOIN known USING (word)")
        return self.con.sql("SELECT doc, flatten(list(ids)) AS ids FROM (SELECT doc, ids FROM given JOIN here USING (code) ORDER BY pos) GROUP BY doc ORDER BY doc").to_arrow_table()

    def said(self, coded: pa.Table) -> list[tuple[int, int, str]]:
        """(doc, n, text): how many ids each document has, and the ids in decimal, joined by blanks."""
        self.con.register("coded", coded)
        return self.con.execute("SELECT doc, len(ids), array_to_string(ids, ' ') FROM coded").fetchall()

    def decode(self, coded: pa.Table) -> pa.Table:
        """(doc, raw): the bytes that each document's ids (doc, ids) stand for. An id beyond the vocabulary raises ValueError."""
        self.con.register("coded", coded)
        rows = self.con.sql(
            """SELECT doc, unhex(string_agg(hex, '')) AS raw, bool_or(hex IS NULL) AS odd FROM (
              SELECT doc, hex FROM (SELECT doc, unnest(ids) AS id, doc::BIGINT << 32 | generate_subscripts(ids, 1) AS place FROM coded) LEFT JOIN vocabulary USING (id) ORDER BY place
            ) GROUP BY doc ORDER BY doc"""
        ).to_arrow_table()
        if any(rows["odd"].to_pylist()):
            raise ValueError("an id that is no token's")
        return rows.select(["doc", "raw"])


_coders: dict[bytes, Coder] = {}


def _coder(raw: bytes) -> Coder:
    """A worker process keeps its coder from task to task."""
    key = hashlib.sha256(raw).digest()
    if key not in _coders:
        _coders.clear()
        _coders[key] = Coder(raw)
    return _coders[key]


def words_of(texts: Iterator[str], pattern: str) -> Iterator[pa.Table]:
    """(doc, pos, word): the words of each text in order, in tables of about A_BATCH rows; a long text's go on in the next."""
    cut = regex.compile(pattern)

    def tabled() -> pa.Table:
        return pa.table({"doc": pa.array(np.repeat(docs, sizes).astype(np.int32)), "pos": pa.array(np.arange(len(words), dtype=np.int32)), "word": pa.array(words, pa.string())})

    words, docs, sizes = [], [], []
    for doc, text in enumerate(texts):
        found = (m[0] for m in cut.finditer(text)) if len(text) > A_BATCH else iter(cut.findall(text))
        while part := list(islice(found, A_BATCH)):
            words += part
            docs.append(doc)
            sizes.append(len(part))
            if len(words) >= A_BATCH:
                yield tabled()
                words, docs, sizes = [], [], []
    if words:
        yield tabled()


def read_vocabulary(path: str | None = None) -> tuple[bytes, str]:
    """A rank file and the pattern that cuts texts into words; without a path, those of the installed public vocabulary."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        raw = f.read(MOST_BYTES + 1)
    if len(raw) > MOST_BYTES:
        raise ValueError(f"a vocabulary of more than {MOST_BYTES} bytes is not sent to the tasks")
    return raw, public_tokenizers.PATTERN


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) for each row of docs (doc_id, text): no special tokens; each word is encoded by itself.

    Null and empty texts have no ids (an empty array). Null doc_ids and rows that repeat: rows as any other. Very long texts and very
    long words are encoded whole. Ties: pairs of one rank stand for one token, the leftmost goes first. Empty table: no rows. Extra
    columns are left out.
    """
    raw, pattern = read_vocabulary(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(raw)
        for batch in batches:
            ids: list[list[int]] = [[] for _ in range(batch.num_rows)]
            for words in words_of((t.as_py() for t in batch.column(1)), pattern):
                for row in coder.encode(words).to_pylist():
                    ids[row["doc"]] += row["ids"]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return _texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decoded(coded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, raw) for each row of coded (doc_id, ids): the bytes that the ids stand for, in order; null or no ids: none. An id that
    is no token's, or null, raises ValueError."""
    raw, _ = read_vocabulary(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(raw)
        for batch in batches:
            out = [b""] * batch.num_rows
            for row in coder.decode(pa.table({"doc": pa.array(range(batch.num_rows), pa.int32()), "ids": batch.column(1)})).to_pylist():
                out[row["doc"]] = row["raw"]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "raw"])

    return coded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, raw binary")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row of docs: encoded() and decoded() in one pass, whose ids and bytes
    don't leave the task. Edge cases as there; a text without ids has the digests of nothing."""
    raw, pattern = read_vocabulary(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(raw)
        for batch in batches:
            n, ids, back = [0] * batch.num_rows, [hashlib.sha256() for _ in range(batch.num_rows)], [hashlib.sha256() for _ in range(batch.num_rows)]
            for words in words_of((t.as_py() for t in batch.column(1)), pattern):
                coded = coder.encode(words)
                for doc, count, text in coder.said(coded):
                    ids[doc].update((" " if n[doc] else "").encode() + text.encode())
                    n[doc] += count
                for doc, part in zip(*coder.decode(coded).to_pydict().values(), strict=True):
                    back[doc].update(part)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array([h.hexdigest() for h in ids]), pa.array([h.hexdigest() for h in back])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))
