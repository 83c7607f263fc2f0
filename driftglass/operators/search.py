"""Dense and hybrid search, merging of several nodes' results, passage selection and extractive answers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftglass.functions.hashing import FNV_PRIME, FNV_SEED, SIGN_SEED, fnv1a_on
from driftglass.functions.text import keywords, sentences, tokenize
from driftglass.functions.vectors import EMBED_DIM, LETTERS, N_LETTERS, PAIR, WORD
from driftglass.operators.lexical import pieces, top_k
from driftglass.session import spread

#: How an imperative sentence starts.
IMPERATIVES = "do not|never|apply|keep|give|move|cool|call|check|stop|place|remove"


@dataclass(frozen=True)
class Profile:
    """How candidates are found, gated and ranked."""

    factor: int  # dense candidates for each of k results
    lexical_candidates: bool
    coverage_weight: float
    gate: float
    lexical_weight: float


#: Fixed values of the two builds.
MOBILE = Profile(4, True, 0.6, 0.4, 0.1)
WEB = Profile(3, False, 0.0, 0.42, 0.3)


def units_of(words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """(units, sizes): the UTF-16 units of words, one after the other, and how many each has."""
    size = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int32)
    units = np.frombuffer(words.buffers()[2] or b"", np.uint8)[size[0] : size[-1]] if len(words) else np.zeros(0, np.uint8)
    if units.size and units.max() > 127:
        raw = [w.encode("utf-16-le", "surrogatepass") for w in words.to_pylist()]
        return np.frombuffer(b"".join(raw), "<u2"), np.array([len(r) // 2 for r in raw], np.int64)
    return units, np.diff(size).astype(np.int64)


def unit_vectors(words: pa.ListArray, dim: int = EMBED_DIM) -> np.ndarray:
    """The hashing embedder's vectors of texts that are cut into words, a row each; a text without words has zeros. All is made from the
    words' units as they lie in memory: a pair's hash goes on from that of its first word, runs (of units) are hashed side by side. What is
    added in a bucket are whole numbers, so no order changes a sum."""
    n, of = len(words), np.repeat(np.arange(len(words)), words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    units, sizes = units_of(words.flatten())
    end = np.cumsum(sizes)
    hashes = fnv1a_on(np.full(len(sizes), FNV_SEED, np.uint32), units, end - sizes, sizes)
    second = np.flatnonzero(of[1:] == of[:-1]) + 1
    pairs = fnv1a_on((hashes[second - 1] ^ np.uint32(ord(" "))) * np.uint32(FNV_PRIME), units, (end - sizes)[second], sizes[second])
    start = np.flatnonzero(np.arange(N_LETTERS, len(units) + 1) <= np.repeat(end, sizes)[: max(0, len(units) - N_LETTERS + 1)])
    runs = np.full(max(0, len(units) - N_LETTERS + 1), FNV_SEED, np.uint32)
    for j in range(N_LETTERS):
        runs = (runs ^ units[j : j + len(runs)]) * np.uint32(FNV_PRIME)
    # The prime is odd, so a hash is odd as the seed and its units say: the signs need no hashes of their own.
    odd = np.concatenate([[0], np.cumsum(units & 1, dtype=np.int64)])
    ones = odd[end] - odd[end - sizes]

    def added(rows: np.ndarray, h: np.ndarray, ones: np.ndarray) -> np.ndarray:
        return np.bincount(rows * dim + h % np.uint32(dim), 1.0 - 2 * ((SIGN_SEED + ones) & 1), n * dim)

    flat = WORD * added(of, hashes, ones) + PAIR * added(of[second], pairs, ones[second - 1] + ones[second] + ord(" ")) + LETTERS * added(np.repeat(of, sizes)[start], runs[start], odd[start + N_LETTERS] - odd[start])
    flat = flat.reshape(-1, dim)
    size = np.sqrt((flat * flat).sum(1))
    return flat / np.where(size > 0, size, 1.0)[:, None]


def embeddings(texts: DataFrame, doc: str, text: str, dim: int = EMBED_DIM) -> DataFrame:
    """(doc, vector) of the hashing embedder: words, pairs of neighbours and runs of four letters, each added with its sign to the bucket of
    its hash; a unit vector. They are made in arrays where the texts are, so that no feature leaves its task. Texts without words have no row; doc is a number, null ones have none either."""

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1):
                vectors = unit_vectors(part.column(1), dim)
                kept = vectors.any(1)
                ids = part.column(0).filter(pa.array(kept))
                yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * dim), pa.array(vectors[kept].ravel()))], [doc, "vector"])

    return spread(texts.where(F.col(doc).isNotNull()).select(doc, text)).select(F.col(doc).cast("long"), tokenize(F.col(text)).alias("words")).mapInArrow(embed, f"{doc} long, vector array<double>")


#: Bytes of query vectors that are sent to every task at most, and scores that a task holds at a time.
MOST_QUERY_BYTES, SCORES_A_TIME = 64 << 20, 1 << 22


def _products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Dot products, each summed in the same way wherever its row stands, so that equal rows are ties."""
    return (rows * query).sum(1)


def best_rows(ids: np.ndarray, rows: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query the (ids, products) of its k best rows, ties by id, in no order."""
    near = rows @ queries.T
    for q in range(len(queries)):
        own = near[:, q]
        at = np.arange(len(own)) if len(own) <= k else np.flatnonzero(own >= np.partition(own, -k)[-k] - 1e-9)
        exact = _products(rows[at], queries[q])
        keep = np.lexsort((ids[at], -exact))[:k]
        yield ids[at[keep]], exact[keep]


def vector_top_k(vectors: DataFrame, queries: DataFrame, k: int, vec: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(query_id, vec, score, rank): the exact k nearest of each query vector (query_id, query_vector), by dot product in double
    precision; ties by id. A stated set of queries against all rows: the queries go to every task, as many at a time as
    MOST_QUERY_BYTES has room for, and each task keeps its best k before anything is exchanged."""
    dim = queries.agg(F.coalesce(F.max(F.size("query_vector")), F.lit(1))).first()[0]
    room = max(1, MOST_QUERY_BYTES // (8 * max(1, dim)))
    parts = -(-queries.count() // room)
    found = []
    for part in range(max(1, parts)):
        own = queries if parts <= 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part)
        asked = own.select(F.col("query_id").cast("long"), F.col("query_vector").cast("array<double>")).toArrow()
        names = asked["query_id"].to_numpy()
        matrix = np.array(asked["query_vector"].to_pylist(), float).reshape(len(names), -1)

        def best(batches: Iterator[pa.RecordBatch], names: np.ndarray = names, matrix: np.ndarray = matrix) -> Iterator[pa.RecordBatch]:
            step = max(k, SCORES_A_TIME // max(1, len(names)))
            held: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0))] * len(names)
            for batch in batches:
                for at in range(0, len(batch), step):
                    rows = batch.slice(at, step)
                    flat = rows.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
                    for q, (ids, score) in enumerate(best_rows(rows.column(0).to_numpy(), flat, matrix, k) if len(names) else ()):
                        ids, score = np.append(held[q][0], ids), np.append(held[q][1], score)
                        keep = np.lexsort((ids, -score))[:k]
                        held[q] = ids[keep], score[keep]
            sizes = [len(ids) for ids, _ in held]
            if sum(sizes):
                yield pa.record_batch([pa.array(np.repeat(names, sizes)), pa.array(np.concatenate([x for x, _ in held])), pa.array(np.concatenate([x for _, x in held]))], ["query_id", vec, "score"])

        rows = vectors.where(F.col(vec).isNotNull() & F.col(column).isNotNull()).select(F.col(vec).cast("long"), F.col(column).cast("array<double>"))
        found.append(rows.mapInArrow(best, f"query_id long, {vec} long, score double"))
    return top_k(reduce(DataFrame.unionByName, found), k, doc=vec)


def exhaustive(profile: Profile) -> Profile:
    """The profile without a candidate step: every passage is scored."""
    return replace(profile, factor=0)


def asked_k(wanted: Column, most: int = 4, capped: bool = False) -> Column:
    """How many results a request asks for: `most` where it names none, and never more where requests are capped."""
    k = F.coalesce(F.nullif(wanted, F.lit(0)), F.lit(most))
    return F.least(k, F.lit(most)) if capped else k


def usable_vectors(vectors: DataFrame, version: str, now: int) -> DataFrame:
    """vectors of the present embedding version; those of another are as good as none."""
    return vectors.where(F.col(version) == now)


def chosen_holder(claims: DataFrame, live: DataFrame, held: DataFrame, self_id: int) -> DataFrame:
    """(doc_id, holder): of the claims (doc_id, node_id, arrival) of live nodes (node_id) the node itself, if it holds the body (held:
    doc_id), else the first claim to come. A claim of the node itself for a body that it lacks counts for nothing."""
    ok = claims.join(live.select("node_id").unionByName(live.sparkSession.range(1).select(F.lit(self_id).cast("long").alias("node_id"))).distinct(), "node_id", "left_semi")
    ok = ok.join(held.select("doc_id", F.lit(True).alias("_held")), "doc_id", "left").where((F.col("node_id") != self_id) | F.col("_held"))
    return ok.groupBy("doc_id").agg(F.min_by("node_id", F.struct(F.col("node_id") != self_id, "arrival", "node_id")).alias("holder"))


def local_hits(hits: DataFrame, bodies: DataFrame, claims: DataFrame, live: DataFrame, names: DataFrame, self_id: int) -> DataFrame:
    """hits (doc_id, …) as a node tells them: holder is the node itself where it has the body, else a live claimant, else 0; the
    holder's name ('' for none), and the text where the body is held. bodies (doc_id, text), names (node_id, name)."""
    holder = chosen_holder(claims.where(F.col("node_id") != self_id), live, bodies, self_id)
    rows = hits.join(bodies.select("doc_id", "text", F.lit(True).alias("_has")), "doc_id", "left").join(holder, "doc_id", "left")
    rows = rows.withColumn("stored_here", F.coalesce("_has", F.lit(False))).withColumn("holder", F.when(F.col("stored_here"), F.lit(self_id)).otherwise(F.coalesce("holder", F.lit(0))).cast("long"))
    named = names.select(F.col("node_id").alias("holder"), F.col("name").alias("holder_name"))
    return rows.join(named, "holder", "left").withColumn("holder_name", F.coalesce("holder_name", F.lit(""))).drop("_has")


def merge_results(hits: DataFrame) -> DataFrame:
    """(query_id, doc_id, score, holder, hops) from all nodes' hits (query_id, doc_id, score, holder, hops): a passage's best
    score, and the holder that the fewest hops reach (ties by holder)."""
    return hits.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"), F.min_by("holder", F.struct("hops", "holder")).alias("holder"), F.min("hops").alias("hops"))


def merge_first(hits: DataFrame) -> DataFrame:
    """(query_id, doc_id, score, holder): the first answer's (by arrival, then node), its missing holder filled by the next that
    names one; holder 0 is unknown."""
    order = F.struct("arrival", "node")
    named = F.when(F.col("holder") != 0, F.col("holder"))
    return hits.groupBy("query_id", "doc_id").agg(F.min_by("score", order).alias("score"), F.coalesce(F.min_by(named, F.when(named.isNotNull(), order)), F.lit(0)).alias("holder"))


def answered(hits: DataFrame) -> DataFrame:
    """(query_id, answered, responded): nodes that replied, and those with a hit; a reply without hits has a null doc_id."""
    return hits.groupBy("query_id").agg(F.countDistinct("node").alias("answered"), F.countDistinct(F.when(F.col("doc_id").isNotNull(), F.col("node"))).alias("responded"))


def in_window(replies: DataFrame, known: DataFrame, window_ms: int = 6000, grace_ms: int = 400) -> DataFrame:
    """replies (query_id, node, at, started; all in ms) that come before their query closes: window_ms after it started, or
    grace_ms after the last of the known nodes (node) has answered."""
    peers = known.count()
    seen = replies.join(known, "node").groupBy("query_id", "node").agg(F.min("at").alias("first")).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("first").alias("all_at"))
    rows = replies.join(seen, "query_id", "left")
    close = F.least(F.col("started") + window_ms, F.when(F.col("n") >= peers, F.col("all_at") + grace_ms))
    return rows.where(F.col("at") <= close).select(*replies.columns)


def select_passages(hits: DataFrame, limit: int = 6, cutoff: float = 0.14, a_section: int = 2) -> DataFrame:
    """hits (query_id, doc_id, section, score) within `cutoff` of their query's best, `a_section` of a section and `limit` in
    all, with their rank."""
    by_query = Window.partitionBy("query_id")
    order = [F.col("score").desc(), F.col("doc_id")]
    rows = hits.withColumn("_best", F.max("score").over(by_query)).where(F.col("score") >= F.col("_best") - cutoff)
    rows = rows.withColumn("_s", F.row_number().over(Window.partitionBy("query_id", "section").orderBy(*order))).where(F.col("_s") <= a_section)
    return rows.withColumn("rank", F.row_number().over(by_query.orderBy(*order))).where(F.col("rank") <= limit).drop("_best", "_s")


def fit_context(passages: DataFrame, budget: int, overhead: int = 16) -> DataFrame:
    """passages (query_id, rank, title, section, text) that fit `budget` characters: the longest prefix by rank, the first in
    any case; empty texts take no part."""
    rows = passages.where(F.length(F.trim("text")) > 0)
    cost = F.length("text") + F.length("title") + F.length("section") + overhead
    order = Window.partitionBy("query_id").orderBy("rank")
    # Each costs `overhead` at least, so no more than these can fit: what else a query has never leaves its task.
    rows = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= max(1, budget // overhead))
    rows = rows.withColumn("used", F.sum(cost).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where((F.col("used") <= budget) | (F.col("_n") == 1)).drop("_n")


def prompt_of(passages: DataFrame) -> DataFrame:
    """(query_id, prompt): the passages by rank, numbered from 1."""
    by = passages.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "title", "section", "text"))).alias("rows"))
    line = lambda r, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), r["title"], F.lit(" - "), r["section"], F.lit("\n"), r["text"])
    return by.select("query_id", F.array_join(F.transform("rows", line), "\n\n").alias("prompt"))


def sentence_score(question: Column, sentence: Column) -> Column:
    """1 for each keyword occurrence in the question that the sentence contains, and 0.75 for an imperative."""
    lower = F.lower(sentence)
    found = F.size(F.filter(keywords(question), lambda k: lower.contains(k)))
    return found + F.when(F.trim(sentence).rlike(f"(?i)^({IMPERATIVES})"), 0.75).otherwise(0.0)


def extractive_answer(passages: DataFrame, most: int = 4) -> DataFrame:
    """(query_id, rank, sentence, citation, score): the sentences (over 25 characters) of passages (query_id, question, citation,
    text) that speak to the question; of those with the same first 40 characters the first; ties by passage and place."""
    rows = passages.select("query_id", "question", "citation", F.posexplode(sentences(F.col("text"))).alias("place", "raw"))
    rows = rows.withColumn("sentence", F.trim("raw")).where(F.length("sentence") > 25)
    rows = rows.withColumn("score", sentence_score(F.col("question"), F.col("sentence"))).where("score > 0")
    order = [F.col("score").desc(), F.col("citation"), F.col("place")]
    first = F.row_number().over(Window.partitionBy("query_id", F.left("sentence", F.lit(40))).orderBy(*order))
    rows = rows.withColumn("_n", first).where("_n = 1")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= most).select("query_id", "rank", "sentence", "citation", "score")


#: Fixed value: what is said where no node has an answer.
NOT_FOUND = "Not in the mesh — no node holds an answer to that."


def answer_states(questions: DataFrame, passages: DataFrame, sentences: DataFrame, generated: DataFrame, shortest: int = 20) -> DataFrame:
    """(query_id, mode, text) for questions (query_id): what is generated (query_id, text; null where no model ran), if it has
    `shortest` characters or more; else the sentences of extractive_answer() with their citations; NOT_FOUND where a question has
    no passage (query_id), or nothing was generated and no sentence speaks to it."""
    told = sentences.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "sentence", "citation"))).alias("rows"))
    line = lambda r: F.concat(r["sentence"], F.lit(" ["), r["citation"].cast("string"), F.lit("]"))
    told = told.select("query_id", F.array_join(F.transform("rows", line), " ").alias("_told"))
    rows = questions.select("query_id").join(passages.select("query_id", F.lit(True).alias("_any")).distinct(), "query_id", "left")
    rows = rows.join(told, "query_id", "left").join(generated.select("query_id", F.trim("text").alias("_made")), "query_id", "left")
    made = F.col("_any").isNotNull() & (F.length("_made") >= shortest)
    text = F.when(made, F.col("_made")).when(F.col("_any").isNotNull() & F.col("_told").isNotNull(), F.col("_told")).otherwise(NOT_FOUND)
    return rows.select("query_id", F.when(made, "generated").otherwise("extractive").alias("mode"), text.alias("text"))


def result_counters(hits: DataFrame) -> DataFrame:
    """Counts of a result set (local, has_body): local, remote, body fetched from others, snippet only."""
    return hits.agg(
        F.count_if(F.col("local")).alias("local"), F.count_if(~F.col("local")).alias("remote"),
        F.count_if(~F.col("local") & F.col("has_body")).alias("fetched"), F.count_if(~F.col("has_body")).alias("snippet_only"),
    )
