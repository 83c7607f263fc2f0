"""Ranked lexical search by windowed bucket scoring (operator 11).

1. indexed(): each task numbers its documents as they stand; WINDOW numbers in a row are a window. A window is one row of the index:
   its documents' ids and lengths, and for each asked term a posting list of (number within the window, occurrences). Terms that no
   item asks for count for lengths and go no further. Nothing is exchanged.
2. statistics(): N, L and each term's df, summed over the windows: exact, over all documents.
3. scored(): a window's postings are traversed once for each item, term after term; each list is added at its documents' places in
   one array of WINDOW 64-bit scores (32 KB), with a bit for each place that was met. What is occupied goes to the item's heap of
   the k best. A task returns k rows an item at most, whatever its windows hold.
4. The tasks' best rows are ranked, dealt out first, so that no task gets an item's rows of all tasks.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftglass.llm.common import staged, table

#: Documents of a window, and results of an item.
WINDOW, TOP = 4096, 10
#: Characters of the items that are asked in one pass over the documents: what is sent to the tasks is bounded by them. More items
#: are asked in further passes.
A_PASS = 16_000_000
#: Bytes of a text that are cut into terms at once.
A_CUT = 1 << 20
#: Groups that the tasks' best rows of an item are dealt to.
SALT = 16
#: Fixed values of the score: a term's weight and frequency scale, and the share of a document's length in m.
WEIGHT, SCALE, TF, M, SHARE = 1000, 1_000_000_000, 1000, 8, 75

#: The characters that are in no term.
_DELIMITERS = {*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)}
#: A-Z lower-cased, what is in no term a blank; bytes of characters beyond ASCII stay.
_FOLD = bytes(32 if b in _DELIMITERS else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def terms(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text (UTF-8) in order, in lists of about A_CUT bytes each."""
    raw, at = raw.translate(_FOLD), 0
    while at < len(raw):
        end = raw.find(b" ", at + A_CUT)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def _numbers(x: np.ndarray) -> bytes:
    """x in the fewest of 1, 2, 4 or 8 bytes each."""
    most = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.int64).tobytes()


def _of(raw: bytes, n: int) -> np.ndarray:
    """What _numbers() packed of n values."""
    return np.frombuffer(raw, {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}[len(raw) // n] if n else np.uint8).astype(np.int64)


INDEX = "docs long, total long, doc_ids array<long>, lens binary, terms array<int>, df array<int>, places binary, tfs binary"
_INDEX = pa.schema([("docs", pa.int64()), ("total", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lens", pa.binary()), ("terms", pa.list_(pa.int32())), ("df", pa.list_(pa.int32())), ("places", pa.binary()), ("tfs", pa.binary())])


def indexed(docs: DataFrame, asked: dict[bytes, int], window: int = WINDOW) -> DataFrame:
    """The index of docs (doc_id, text) for the asked terms (term: number), staged: a row for each window.

    Null and empty texts, and those without a term, are in no window. Rows without doc_id and rows that repeat one are documents of
    their own. Very long texts are cut into terms piece by piece.
    """

    def built(ids: list[int | None], lens: list[int], found: list[Counter]) -> pa.RecordBatch:
        sizes = [len(c) for c in found]
        n = sum(sizes)
        term = np.fromiter((t for c in found for t in c), np.int64, n)
        tf = np.fromiter((v for c in found for v in c.values()), np.int64, n)
        place = np.repeat(np.arange(len(found)), sizes)
        by = np.argsort(term, kind="stable")  # within a list, places rise
        known, df = np.unique(term, return_counts=True)
        row = [len(ids), sum(lens), ids, _numbers(np.array(lens, np.int64)), known.tolist(), df.tolist(), _numbers(place[by]), _numbers(tf[by])]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _INDEX, strict=True)], schema=_INDEX)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lens, found = [], [], []
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                n, count = 0, Counter()
                for part in terms(text.as_py() or b""):
                    n += len(part)
                    count.update(map(asked.get, part))
                if not n:
                    continue
                count.pop(None, None)
                ids.append(doc.as_py())
                lens.append(n)
                found.append(count)
                if len(ids) == window:
                    yield built(ids, lens, found)
                    ids, lens, found = [], [], []
        if ids:
            yield built(ids, lens, found)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary"))
    return staged(rows.mapInArrow(windows, INDEX), "windows")


def statistics(index: DataFrame) -> tuple[int, int, dict[int, int]]:
    """N, L and df by term number. As many rows as there are asked terms come to the driver."""
    n, total = index.agg(F.sum("docs"), F.sum("total")).first()
    found = index.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).groupBy("x.terms").agg(F.sum("x.df").alias("df"))
    return n or 0, total or 0, {r["terms"]: r["df"] for r in found.collect()}


def weight(n: int, df: int) -> int:
    return math.floor(WEIGHT * math.log((2 * n + 2) / (2 * df + 1)))


def scored(index: DataFrame, items: list[list[tuple[int, int]]], n: int, total: int, k: int = TOP) -> DataFrame:
    """(item, score, doc_id): for each task and item (its terms' numbers with their weights, repeats multiplied in) the task's k best
    documents of a score above 0. Equal scores: by ascending doc_id, rows without one last."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: list[list[tuple[int, bool, int]]] = [[] for _ in items]
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1).to_pylist()[0]
                size, df = row["docs"], np.array(row["df"], np.int64)
                ids = np.array([i or 0 for i in row["doc_ids"]], np.int64)
                named = np.array([i is not None for i in row["doc_ids"]])
                m = 100 - SHARE + (SHARE * _of(row["lens"], size) * n) // total
                count = int(df.sum())
                places, tfs = _of(row["places"], count), _of(row["tfs"], count)
                impact = (SCALE * tfs) // (TF * tfs + M * m[places])
                ends = np.cumsum(df)
                lists = {t: (a, b) for t, a, b in zip(row["terms"], (ends - df).tolist(), ends.tolist(), strict=True)}
                scores, met = np.zeros(size, np.int64), np.zeros(size, bool)
                for heap, asked in zip(heaps, items, strict=True):
                    for t, w in asked:
                        if t in lists:
                            a, b = lists[t]
                            at = places[a:b]  # no place twice
                            scores[at] += w * impact[a:b]
                            met[at] = True
                    hits = np.flatnonzero(met)
                    got = scores[hits]
                    best = got >= (heap[0][0] if len(heap) == k else 1)
                    for i in _first(hits[best], got[best], named, ids, k):
                        entry = (int(scores[i]), bool(named[i]), -int(ids[i]))
                        heapq.heappushpop(heap, entry) if len(heap) == k else heapq.heappush(heap, entry)
                    scores[hits], met[hits] = 0, False
        out = [(i, s, -d if named else None) for i, heap in enumerate(heaps) for s, named, d in heap]
        columns = zip(*out, strict=True) if out else ((),) * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()), strict=True)], ["item", "score", "doc_id"])

    return index.mapInArrow(search, "item int, score long, doc_id long")


def _first(hits: np.ndarray, got: np.ndarray, named: np.ndarray, ids: np.ndarray, k: int) -> list[int]:
    """The k first of the hits by score, then by id."""
    if len(hits) > k:
        least = np.partition(got, len(got) - k)[len(got) - k]
        hits, got = hits[got >= least], got[got >= least]
    return hits[np.lexsort((ids[hits], ~named[hits], -got))[:k]].tolist()


def best(rows: DataFrame, k: int, *by: str | Column) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP, *, window: int = WINDOW, a_pass: int = A_PASS) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item of items (item_id, text) the k documents of docs (doc_id, text) with the highest
    scores above 0, fewer where there are fewer. Terms are the maximal runs of letters, digits and characters beyond ASCII, A-Z
    lower-cased; every text is read whole.

    Equal scores go by ascending doc_id, then by nothing: rows that repeat a doc_id are documents of their own, each of which is
    ranked. A row without doc_id is ranked with a null, after those of equal score. Null and empty texts have no terms: as documents
    they don't count, as items they have no rows. Rows that repeat an item_id and its text are one item; of one item_id with several
    texts each is an item. Empty tables: no rows. Extra columns, whatever their names, are left out.
    """
    spark = docs.sparkSession
    asked = items.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    passes = -(-int(asked.agg(F.sum(F.length("text"))).first()[0] or 0) // a_pass)
    out = spark.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")
    for i in range(passes):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == i).collect()  # about a_pass characters
        counts = [Counter(t for part in terms(r["text"].encode()) for t in part) for r in rows]
        number = {t: j for j, t in enumerate(sorted(set().union(*counts)))}
        index = indexed(docs, number, window)
        n, total, df = statistics(index)
        weights = {t: w for t, d in df.items() if (w := weight(n, d))}
        weighed = [[(number[t], times * weights[number[t]]) for t, times in c.items() if number[t] in weights] for c in counts]
        found = scored(index, weighed, n, max(1, total), k).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)))
        top = best(best(found, k, "item", "salt"), k, "item")
        names = spark.createDataFrame([(j, r["item_id"]) for j, r in enumerate(rows)], f"item int, item_id {items.schema['item_id'].dataType.simpleString()}")
        out = out.unionByName(top.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))  # as many names as are asked at once
    return out


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
