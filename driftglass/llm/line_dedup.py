"""Reversible line dedup: sharded cuckoo filters backed by exact reference-count tables (operator 1).

A line's key is the line without ASCII white space at its ends, A-Z lower-cased; keys of at least MIN_CHARS code points count.
An Index holds three tables in the shared folder:

- refs (key, doc_id): which document has which key, once each;
- counts (shard, key, n_docs, keeper): the exact reference count of a key and the largest doc_id that has it;
- filters (shard, payload): a cuckoo filter of the shard's keys.

insert() sums the new references to one row for each key before they go to their shard, so a line that a third of all
documents share is one row there. The shard's filter then tells keys that the index has never seen, which need no look-up, from
those that it may hold, which alone are joined with the counts. delete() takes references away again: a key whose count falls to
zero leaves both the table and its filter, which is what cuckoo filters, unlike Bloom filters, allow. Keys are 128-bit digests.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftglass.llm.common import SPACE_BYTES, apart, few, staged, table

MIN_CHARS, MIN_DOCS, KEYS_A_SHARD, REFS_A_FILE = 20, 3, 20_000, 500_000
#: A key that has more than a HOT-th of all references is hot.
HOT = 1024
_STRIP = SPACE_BYTES


def line_key(line: bytes) -> bytes | None:
    """The digest of a line's key, or None where the key is too short to count."""
    key = line.strip(_STRIP).lower()  # bytes: A-Z only
    if len(key) < MIN_CHARS or len(key) < 4 * MIN_CHARS and len(key.decode("utf-8", "replace")) < MIN_CHARS:
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; a key's two buckets follow from its digest and from each other.

    When an insertion finds no room after KICKS moves, a further table of twice the size is opened, so no key is ever refused.
    """

    SLOTS, KICKS = 4, 200

    def __init__(self, keys: int = 0):
        self.tables: list[array] = []
        if keys:
            self._open(keys)

    def _open(self, keys: int) -> None:
        buckets = 1 << max(2, (int(keys / self.SLOTS / 0.85)).bit_length())
        self.tables.append(array("H", bytes(2 * self.SLOTS * buckets)))

    @staticmethod
    def _print(key: bytes) -> tuple[int, int]:
        return int.from_bytes(key[:8], "little"), int.from_bytes(key[8:10], "little") or 1

    @staticmethod
    def _other(bucket: int, mark: int, mask: int) -> int:
        return bucket ^ (mark * 0x5BD1E995 & mask)

    def __contains__(self, key: bytes) -> bool:
        place, mark = self._print(key)
        for t in self.tables:
            mask = len(t) // self.SLOTS - 1
            a = place & mask
            if mark in t[4 * a : 4 * a + 4]:
                return True
            b = self._other(a, mark, mask)
            if mark in t[4 * b : 4 * b + 4]:
                return True
        return False

    def add(self, key: bytes) -> None:
        place, mark = self._print(key)
        if not self.tables:
            self._open(64)
        t = self.tables[-1]
        mask = len(t) // self.SLOTS - 1
        b = a = place & mask
        undo = []
        for turn in range(self.KICKS):
            for b in (a, self._other(a, mark, mask)):
                for i in range(4 * b, 4 * b + 4):
                    if not t[i]:
                        t[i] = mark
                        return
            i = 4 * b + (turn + mark) % 4
            undo.append((i, t[i]))
            t[i], mark = mark, t[i]
            a = self._other(b, mark, mask)
        for i, was in reversed(undo):
            t[i] = was
        self._open(len(t))
        self.add(key)

    def remove(self, key: bytes) -> bool:
        place, mark = self._print(key)
        for t in reversed(self.tables):
            mask = len(t) // self.SLOTS - 1
            a = place & mask
            for b in (a, self._other(a, mark, mask)):
                for i in range(4 * b, 4 * b + 4):
                    if t[i] == mark:
                        t[i] = 0
                        return True
        return False

    def to_bytes(self) -> bytes:
        return b"".join(len(t).to_bytes(8, "little") + t.tobytes() for t in self.tables)

    @classmethod
    def from_bytes(cls, payload: bytes) -> CuckooFilter:
        out, at = cls(), 0
        while at < len(payload):
            n = int.from_bytes(payload[at : at + 8], "little")
            out.tables.append(array("H", payload[at + 8 : at + 8 + 2 * n]))
            at += 8 + 2 * n
        return out


def references(docs: DataFrame) -> DataFrame:
    """(key, doc_id), once each, of docs (doc_id, text). Null ids and null texts have none."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), strict=True):
                own = {k for line in (text.as_py() or b"").split(b"\n") if len(line) >= MIN_CHARS and (k := line_key(line))}
                ids += [doc] * len(own)
                found += own
            yield pa.record_batch([pa.array(found, pa.binary()), pa.array(ids, pa.int64())], ["key", "doc_id"])

    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(keys, "key binary, doc_id long").distinct()


@dataclass
class Index:
    """shards: how many the keys are dealt to; 0 until the first insertion, which takes one for each KEYS_A_SHARD references that it
    brings, and a shard that has twice as many keys later on is a reason to index anew."""

    spark: SparkSession
    shards: int
    refs: DataFrame
    counts: DataFrame
    filters: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession, shards: int = 0) -> Index:
        make = lambda schema: spark.createDataFrame([], schema)
        return cls(spark, shards, make("key binary, doc_id long"), make("shard int, key binary, n_docs long, keeper long"), make("shard int, payload binary"))

    def _shard(self) -> F.Column:
        return F.pmod(F.xxhash64("key"), F.lit(self.shards)).cast("int").alias("shard")

    def _sums(self, refs: DataFrame) -> DataFrame:
        return refs.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper")).select(self._shard(), "key", "n_docs", "keeper")

    def insert(self, docs: DataFrame) -> Index:
        """The index with docs added. Documents that it already holds line by line change nothing."""
        refs = references(docs)
        docs_here = docs.count()
        if self.shards:
            refs = refs.join(self.refs, ["key", "doc_id"], "left_anti")
        refs = staged(few(refs, docs_here, REFS_A_FILE // 8), "line-refs")
        n = refs.count()
        if not self.shards:
            self = Index(self.spark, max(1, -(-n // KEYS_A_SHARD)), self.refs, self.counts, self.filters)

        def probe(new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
            cuckoo = CuckooFilter.from_bytes(old.payload.iloc[0]) if len(old) else CuckooFilter(len(new))
            seen = [k in cuckoo for k in new.key]
            for k, known in zip(new.key, seen, strict=True):
                if not known:
                    cuckoo.add(k)
            out = new.assign(seen=seen, payload=None)
            shard = (new if len(new) else old).shard.iloc[0]
            return pd.concat([out, pd.DataFrame({"shard": [shard], "key": [None], "n_docs": [0], "keeper": [0], "seen": [False], "payload": [cuckoo.to_bytes()]})])

        met = self._sums(refs).groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInPandas(probe, "shard int, key binary, n_docs long, keeper long, seen boolean, payload binary")
        met = staged(few(met, n, REFS_A_FILE), "line-probe")
        seen = met.where("seen").select("shard", "key", "n_docs", "keeper")
        fresh = met.where("key is not null and not seen").select("shard", "key", "n_docs", "keeper")
        # A key that the filter only seems to know finds no count, and starts one; its own fingerprint goes into the filter too, as
        # delete() takes one out for each key.
        held = self.counts.join(seen.select("key", F.col("n_docs").alias("_n"), F.col("keeper").alias("_k")), "key", "left")
        held = held.select("shard", "key", (F.col("n_docs") + F.coalesce("_n", F.lit(0))).alias("n_docs"), F.greatest("keeper", "_k").alias("keeper"))
        filters = met.where("key is null").select("shard", "payload")
        if self.counts.isEmpty():
            counts = fresh
        else:
            missed = staged(seen.join(self.counts, "key", "left_anti").select("shard", "key", "n_docs", "keeper").coalesce(self.shards), "line-missed")
            counts = held.unionByName(missed).unionByName(fresh)

            def put(keys: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
                cuckoo = CuckooFilter.from_bytes(old.payload.iloc[0])
                for k in keys.key:
                    cuckoo.add(k)
                return old.assign(payload=[cuckoo.to_bytes()])

            if not missed.isEmpty():
                more = missed.select("shard", "key").groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(put, "shard int, payload binary")
                filters = staged(few(more, n, REFS_A_FILE), "line-filters")
        return Index(self.spark, self.shards, self.refs.unionByName(refs), counts, filters)

    def delete(self, doc_ids: DataFrame) -> Index:
        """The index without the documents whose doc_id is in doc_ids, as if they had never come."""
        gone = doc_ids.select("doc_id").distinct()
        lost = self.refs.join(gone, "doc_id", "left_semi").select("key").distinct()
        n = self.refs.count()
        refs = staged(few(self.refs.join(gone, "doc_id", "left_anti").select("key", "doc_id"), n, REFS_A_FILE), "line-refs")
        again = self._sums(refs.join(lost, "key", "left_semi"))
        counts = self.counts.join(lost, "key", "left_anti").unionByName(again).select("shard", "key", "n_docs", "keeper")
        counts = staged(few(counts, n, REFS_A_FILE), "line-counts")
        dead = lost.join(again.select("key"), "key", "left_anti").select(self._shard(), "key")

        def drop(keys: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
            if not len(old):
                return old
            cuckoo = CuckooFilter.from_bytes(old.payload.iloc[0])
            for k in keys.key:
                cuckoo.remove(k)
            return old.head(1).assign(payload=[cuckoo.to_bytes()])

        filters = staged(dead.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInPandas(drop, "shard int, payload binary"), "line-filters")
        return Index(self.spark, self.shards, refs, counts, filters)

    def drops(self, min_docs: int = MIN_DOCS) -> DataFrame:
        """(doc_id, keys): the keys that a document loses. A hot key is one with more than a HOT-th of all references: there are fewer
        than HOT of them, whatever the index holds, so they are sent to every task and meet their references where these are. Only
        the others are dealt out by key."""
        many = self.counts.where(F.col("n_docs") >= min_docs).select("key", "keeper", "n_docs")
        is_hot = F.col("n_docs") * HOT > self.refs.count()
        hot = F.broadcast(many.where(is_hot).drop("n_docs"))
        rest = self.refs.join(hot.select("key"), "key", "left_anti").join(many.where(~is_hot).drop("n_docs"), "key")
        lost = self.refs.join(hot, "key").unionByName(rest).where("doc_id < keeper")
        return lost.groupBy("doc_id").agg(F.collect_list("key").alias("keys"))

    def apply(self, docs: DataFrame, min_docs: int = MIN_DOCS, report: bool = True) -> DataFrame:
        """docs with `text` less its dropped lines, and, where asked to report, n_lines, n_dropped and kept_sha256 in place of columns
        of these names that docs has; without them docs keeps all its columns. A null text stays null and counts as one empty line;
        texts of rows without id lose nothing. Kept lines are joined by \\n as they were."""
        told = ["n_lines", "n_dropped", "kept_sha256"] if report else []
        columns = [c for c in docs.columns if c not in told]
        rest, text, keys, i = apart("own"), apart("text"), apart("keys"), apart("id")
        rows = docs.select(F.struct(*[c for c in columns if c != "text"]).alias(rest), F.col("text").cast("string").alias(text), F.col("doc_id").cast("long").alias(i))
        rows = rows.join(self.drops(min_docs).select(F.col("doc_id").alias(i), F.col("keys").alias(keys)), i, "left").select(rest, text, keys)
        kind = pa.string()

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, lines, dropped, digests = [], [], [], []
                for raw, lost in zip(batch.column(1).cast(pa.large_binary()), batch.column(2), strict=True):
                    raw, gone = raw.as_py(), set(lost.as_py() or ())
                    parts = (raw or b"").split(b"\n")
                    kept = [x for x in parts if len(x) < MIN_CHARS or line_key(x) not in gone] if gone else parts
                    left = b"\n".join(kept)
                    texts.append(None if raw is None else left)
                    lines.append(len(parts))
                    dropped.append(len(parts) - len(kept))
                    digests.append(hashlib.sha256(left).hexdigest() if told else None)
                out = [batch.column(0), pa.array(texts, pa.large_binary()).cast(pa.large_string()).cast(kind), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(digests, kind)]
                yield pa.RecordBatch.from_arrays(out, [rest, text, "n_lines", "n_dropped", "kept_sha256"])

        schema = rows.select(rest, text).schema.add("n_lines", "long").add("n_dropped", "long").add("kept_sha256", "string")
        return rows.mapInArrow(cut, schema).select(*[F.col(rest)[c].alias(c) if c != "text" else F.col(text).alias(c) for c in columns], *told)


def dedup_lines(docs: DataFrame, *, increments: int = 2, min_docs: int = MIN_DOCS, report: bool = True) -> DataFrame:
    """Index.apply() over an index of all of docs, which come in `increments`, as they do where a corpus grows.

    Repeated rows of a doc_id are one document to the counts, and each loses its lines. Null ids lose nothing and count for
    nothing, null texts stay null (one empty line); very long texts are split whole. Ties: of equal keys the largest doc_id keeps its
    lines, all rows of that id do. Columns of docs may have any names, but for those of the report, which give way. Empty table: no rows.
    """
    narrow = docs.select("doc_id", "text")
    index = Index.empty(docs.sparkSession)
    for i in range(increments):
        index = index.insert(narrow.where(F.pmod(F.xxhash64("doc_id"), F.lit(increments)) == i))
    return index.apply(docs, min_docs, report)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents
), keyed AS (
  SELECT doc_id, i, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), many AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.doc_id, k.i, k.line, m.key IS NOT NULL AND k.doc_id < m.keeper AS gone FROM keyed k LEFT JOIN many m ON k.key = m.key
)
SELECT doc_id, count(*) AS n_lines, count_if(gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
