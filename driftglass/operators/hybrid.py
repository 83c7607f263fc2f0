"""Hybrid search in place: the questions go to the passages' tasks, and of all pairs of the two only the best leave them.

1. prepared(): a row for each passage with its vector, its length, and the asked terms that it holds.
2. A first pass finds, for each question, its highest BM25 score and where its dense candidates end.
3. A second pass scores blocks of passages against all questions: cosines as one product of matrices, BM25 and coverage by adding
   posting lists, then candidates, gate and rank. A task returns k rows a question at most.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftglass.functions.text import tokenize
from driftglass.functions.vectors import EMBED_DIM
from driftglass.operators.lexical import Lists, counted_terms, first_of, pieces, top_k
from driftglass.operators.search import MOBILE, MOST_QUERY_BYTES, SCORES_A_TIME, Profile, unit_vectors
from driftglass.session import released, spread, staged

PREPARED = "doc_id long, vector binary, len long, terms array<int>, tfs array<int>"


@dataclass(frozen=True)
class Questions:
    """Questions as arrays. terms: for each its terms' numbers with how often it has them, in the terms' order."""

    ids: np.ndarray
    vectors: np.ndarray
    terms: list[list[tuple[int, int]]]


def asked_of(rows: list, number: dict[str, int]) -> Questions:
    words = [r["words"] for r in rows]
    terms = [sorted((number[t], n) for t, n in Counter(w).items()) for w in words]
    return Questions(np.array([r["query_id"] for r in rows], np.int64), unit_vectors(pa.array(words, pa.list_(pa.string()))), terms)


def prepared(passages: DataFrame, number: dict[str, int]) -> DataFrame:
    """passages (doc_id, text) as rows (doc_id, vector, len, terms, tfs); number: the asked terms, numbered in their order. A text without
    words has no vector; rows without id are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = pa.array(number, pa.string())
        for batch in batches:
            for part in pieces(batch, 1):
                vectors = unit_vectors(part.column(1))
                raw = pa.array([v.tobytes() if some else None for v, some in zip(vectors, vectors.any(1), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), raw, *counted_terms(part.column(1), terms)], ["doc_id", "vector", "len", "terms", "tfs"])

    rows = spread(passages.where(F.col("doc_id").isNotNull()).select("doc_id", "text")).select(F.col("doc_id").cast("long"), tokenize(F.col("text")).alias("words"))
    return staged(rows.mapInArrow(run, PREPARED), "hybrid-passages")


class Block:
    """Some passages, with what each question makes of them."""

    def __init__(self, batch: pa.RecordBatch, asked: Questions, idf: np.ndarray, avg_len: float) -> None:
        self.ids = batch.column(0).to_numpy()
        raw = batch.column(1).to_pylist()
        self.embedded = np.array([v is not None for v in raw])
        vectors = np.frombuffer(b"".join(v or bytes(8 * EMBED_DIM) for v in raw)).reshape(len(raw), EMBED_DIM)
        self.cosines = np.round(vectors @ asked.vectors.T, 9)
        self.lists, self.asked, self.idf = Lists(*batch.columns[2:], avg_len), asked, idf

    def lexical(self, q: int) -> tuple[np.ndarray, np.ndarray]:
        """(BM25 scores, how many of the question's terms) of each passage."""
        return self.lists.scores(self.asked.terms[q], self.idf)


def _blocks(batches: Iterator[pa.RecordBatch], *of: object) -> Iterator[Block]:
    step = max(64, SCORES_A_TIME // max(1, len(of[0].ids)))
    for batch in batches:
        for at in range(0, len(batch), step):
            yield Block(batch.slice(at, step), *of)


def hybrid_search(passages: DataFrame, queries: DataFrame, k: int, profile: Profile = MOBILE) -> DataFrame:
    """(query_id, doc_id, relevance, rank_score, rank) from passages (doc_id, text) and queries (query_id, query).

    Candidates: the dense best factor * k of a query and, for MOBILE, all that match a term; without a factor (search.exhaustive()) all.
    Relevance: cosine plus weighted term coverage, 1 at most. What passes the gate is ranked by relevance plus weighted BM25, as a share
    of the query's best; ties by id. A cosine is that of the hashing embedder, 0 for a text without words. The gate and the ranks go by 9
    places, as sums of floats differ in their last places with their order.

    A stated set of questions against all passages: as many go to the tasks at a time as MOST_QUERY_BYTES has room for, so all are asked,
    in as many passes as that takes. Questions without id are left out; null texts are empty.
    """
    spark = passages.sparkSession
    rows = queries.where(F.col("query_id").isNotNull()).select(F.col("query_id").cast("long").alias("query_id"), tokenize(F.col("query")).alias("words"))
    parts = max(1, -(-rows.count() * 8 * EMBED_DIM // MOST_QUERY_BYTES))
    found = []
    for part in range(parts):
        some = rows.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part).collect()  # MOST_QUERY_BYTES at most as vectors
        number = {t: i for i, t in enumerate(sorted({w for r in some for w in r["words"]}))}
        asked = asked_of(some, number)
        docs = prepared(passages, number)
        found.append(staged(_best(docs, asked, len(number), k, profile), "hybrid-best"))
        released(docs)
    none = spark.createDataFrame([], "query_id long, doc_id long, relevance double, rank_score double")
    best = top_k(reduce(DataFrame.unionByName, found, none), k, score="rank_score")
    return best.select("query_id", "doc_id", F.round("relevance", 6).alias("relevance"), "rank_score", "rank")


def _best(docs: DataFrame, asked: Questions, terms: int, k: int, profile: Profile) -> DataFrame:
    """(query_id, doc_id, relevance, rank_score): each task's k best of each question."""
    total = docs.agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("len")).first()
    n, avg_len = total["n"], (total["len"] or 0) / max(1, total["n"]) or 1.0
    df = np.zeros(terms)
    for r in docs.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # as many rows as terms are asked for
        df[r["t"]] = r["count"]
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    dense, numbers = profile.factor * k, range(len(asked.ids))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = np.zeros(len(asked.ids))
        near = [(np.zeros(0), np.zeros(0, np.int64))] * len(asked.ids)
        for block in _blocks(batches, asked, idf, avg_len):
            for q in numbers:
                most[q] = max(most[q], block.lexical(q)[0].max(initial=0.0))
                if dense and asked.vectors[q].any():
                    c, ids = np.append(near[q][0], block.cosines[block.embedded, q]), np.append(near[q][1], block.ids[block.embedded])
                    at = first_of(c, ids, dense)
                    near[q] = c[at], ids[at]
        out = [(q, 0.0, None, float(most[q])) for q in numbers] + [(q, c, i, None) for q in numbers for c, i in zip(*(x.tolist() for x in near[q]), strict=True)]
        columns = zip(*out, strict=True) if out else ((),) * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.float64(), pa.int64(), pa.float64()), strict=True)], ["q", "c", "doc_id", "most"])

    found = staged(docs.mapInArrow(ends, "q int, c double, doc_id long, most double"), "hybrid-ends")
    top, last = np.zeros(len(asked.ids)), [(-np.inf, 0)] * len(asked.ids)
    for r in found.groupBy("q").agg(F.max("most").alias("most")).collect():
        top[r["q"]] = r["most"] or 0.0
    order = F.row_number().over(Window.partitionBy("q").orderBy(F.col("c").desc(), "doc_id"))
    for r in found.where("doc_id is not null").withColumn("_n", order).where(F.col("_n") == dense).collect() if dense else ():
        last[r["q"]] = r["c"], r["doc_id"]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [tuple(np.zeros(0, t) for t in (np.int64, float, float))] * len(asked.ids)
        for block in _blocks(batches, asked, idf, avg_len):
            for q in numbers:
                scores, met = block.lexical(q)
                c = block.cosines[:, q]
                if dense:
                    close = block.embedded & ((c > last[q][0]) | (c == last[q][0]) & (block.ids <= last[q][1])) & asked.vectors[q].any()
                    close = close | (met > 0) if profile.lexical_candidates else close
                else:
                    close = np.ones(len(c), bool)
                at = np.flatnonzero(close)
                share = met[at] / max(1, len(asked.terms[q]))
                relevance = np.round(np.minimum(1.0, c[at] + profile.coverage_weight * share), 9)
                at, relevance = at[relevance >= profile.gate], relevance[relevance >= profile.gate]
                rank = np.round(relevance + profile.lexical_weight * (scores[at] / top[q] if top[q] > 0 else 0.0), 9)
                ids, relevance, rank = (np.append(a, b) for a, b in zip(held[q], (block.ids[at], relevance, rank), strict=True))
                keep = first_of(rank, ids, k)
                held[q] = ids[keep], relevance[keep], rank[keep]
        sizes = [len(h[0]) for h in held]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(asked.ids, sizes)), *[pa.array(np.concatenate([np.zeros(0, t), *[h[i] for h in held]])) for i, t in enumerate((np.int64, float, float))]], ["query_id", "doc_id", "relevance", "rank_score"])

    return docs.mapInArrow(best, "query_id long, doc_id long, relevance double, rank_score double")
