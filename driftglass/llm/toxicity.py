"""Toxicity: a support vector machine over a subsequence string kernel with Nyström landmarks (operator 2).

Kernel of two tokens: their common subsequences of LETTERS letters, each weighted by DECAY to the length that it spans in both,
normalised and squared. So an insult with letters put in between, left out or stretched stays close to the insult.

A sentence is as toxic as its most toxic token. Sentences carry the label of their document; in a toxic document the machine
itself says which token of which sentence made it so, first by how telling it is, then by its own decision (a latent SVM), while
every token of a clean sentence is a negative example. A document's TOP highest decisions over its distinct tokens and its length
give its probability, by a logistic regression on the documents: one token that is close to an insult by chance is little in a
long text, several are much.

Training takes a bounded sample of the labelled rows that are not held out: `train_rows` documents of each label at most, chosen by
a hash of their id, `negatives` tokens of clean documents, those nearest to the landmarks, and `a_document` tokens of each toxic one,
the most telling. All three bounds, and `landmarks`, are parameters of train(). What comes to the driver has that size whatever the
corpus is, as packed floats. Scoring reads every whole text.

The kernel looks at tokens between white space, and at letters that stand one by one, whatever white space is between them. An insult
cut in two longer pieces by white space is two tokens to it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from heapq import nlargest
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from driftglass.llm.common import apart, few, held_out, released, staged, table

LETTERS, DECAY = 3, 0.6
#: Letters in the stems whose odds, beside those of whole tokens, tell which tokens are likely landmarks.
STEM = 4
TOP = 5
TRAIN_ROWS, LANDMARKS, NEGATIVES, A_DOCUMENT = 2500, 24, 20_000, 6
#: Landmarks that stand for plain tokens, and candidates that are landmarks whatever chance would give.
PLAIN, FEWEST = 4, 8
#: Longer tokens are read as windows of WINDOW letters that overlap by half.
WINDOW = 24
RIDGE, COST = 1e-3, 1.0
#: Decisions that a worker remembers, and texts whose tokens it holds at a time.
CACHE, A_TIME = 300_000, 256

_MARKS = {ord(c): None for c in ".,;:!?-_*'\"()[]{}<>/\\|~^+=#$%&@`…·"}
_SPACED = re.compile(r"(?<!\S)\w(?:\s+\w){2,}(?!\S)")


def tokens(sentence: str) -> set[str]:
    """Lower-cased tokens between white space, without marks inside; letters that stand one by one are read as a word too."""
    plain = sentence.lower().translate(_MARKS)
    found = set(plain.split())
    if _SPACED.search(plain):
        found |= {"".join(m.group().split()) for m in _SPACED.finditer(plain)}
    return found


def sentences(text: str) -> list[str]:
    return [s for s in re.split(r"(?<=[.!?])\s+|\n", text) if s.strip()]


def windows(token: str) -> list[str]:
    return [token] if len(token) <= WINDOW else [token[i : i + WINDOW] for i in range(0, len(token) - WINDOW // 2, WINDOW // 2)]


def _codes(words: list[str]) -> np.ndarray:
    """(words of one length) as rows of code points."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1)


def _common(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The weighted count of common subsequences of three letters, for rows of s (n, l) and t (n, m) or (1, m)."""
    n, m = len(s), t.shape[1]
    steps = np.arange(m)[None, :] - np.arange(m)[:, None]
    move = np.where(steps >= 0, DECAY ** (steps + 2.0), 0).astype(np.float32)
    one, two, out = np.zeros((n, m), np.float32), np.zeros((n, m), np.float32), np.zeros(n, np.float32)
    for i in range(s.shape[1]):
        same = (s[:, i : i + 1] == t).astype(np.float32)
        out += DECAY**2 * (same[:, 1:] * two[:, :-1]).sum(1)
        last = np.zeros((n, m), np.float32)
        last[:, 1:] = same[:, 1:] * one[:, :-1]
        two = DECAY * two + last @ move
        one = DECAY * one + same @ move
    return out


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """(len(words), len(landmarks)): the kernel.

    The landmarks' subsequences are few, so a word's subsequences are looked up among them, all words of a length at once; the
    words without any are 0, and only the others need their norm.
    """
    out = np.zeros((len(words), len(landmarks)), np.float32)
    letter = {c: i for i, c in enumerate(sorted(set("".join(landmarks))), 1)}
    base = len(letter) + 1
    weight: dict[int, dict[int, float]] = {}
    for j, mark in enumerate(landmarks):
        own: dict[int, float] = {}
        for x, y, z in combinations(range(len(mark)), LETTERS):
            code = (letter[mark[x]] * base + letter[mark[y]]) * base + letter[mark[z]]
            own[code] = own.get(code, 0.0) + DECAY ** (z - x + 1)
        size = np.sqrt(sum(w * w for w in own.values())) or 1.0
        for code, w in own.items():
            weight.setdefault(code, {})[j] = w / size
    place = np.zeros(base**LETTERS, np.int32)  # 0: no landmark has it
    table = np.zeros((len(weight) + 1, len(landmarks)), np.float32)
    for i, (code, row) in enumerate(weight.items(), 1):
        place[code] = i
        table[i, list(row)] = list(row.values())
    code_of = np.zeros(0x110000, np.int16)
    for c, i in letter.items():
        code_of[ord(c)] = i
    by: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        if len(w) >= LETTERS:
            by.setdefault(len(w), []).append(i)
    for size, all_rows in by.items():
        x, y, z = np.array(list(combinations(range(size), LETTERS))).T
        spans = (DECAY ** (z - x + 1.0)).astype(np.float32)
        step = max(1, 2_000_000 // len(x))
        for at in range(0, len(all_rows), step):
            rows = np.array(all_rows[at : at + step])
            points = _codes([words[i] for i in rows])
            a = code_of[points].astype(np.int32)
            found = place[(a[:, x] * base + a[:, y]) * base + a[:, z]]
            row, which = np.nonzero(found)
            if not len(row):
                continue
            hit, first = np.unique(row, return_index=True)
            sums = np.add.reduceat(table[found[row, which]] * spans[which][:, None], first)
            norm = np.sqrt(np.maximum(_common(points[hit], points[hit]), 1e-12))
            out[rows[hit]] = sums / norm[:, None]
    return out**2


@dataclass
class Model:
    landmarks: list[str]
    weights: np.ndarray  # on kernel values, the Nyström map folded in
    bias: float
    head: np.ndarray  # of the logistic regression, its constant last

    def decide(self, words: list[str]) -> np.ndarray:
        """A decision for each word."""
        parts = [windows(w) for w in words]
        flat = [p for ps in parts for p in ps]
        if not flat:
            return np.zeros(0)
        got = kernel(flat, self.landmarks) @ self.weights + self.bias
        return np.maximum.reduceat(got, np.cumsum([0, *map(len, parts[:-1])]))

    def probability(self, features: np.ndarray) -> np.ndarray:
        x = np.hstack([features, np.ones((len(features), 1))])
        return 1 / (1 + np.exp(-np.clip(x @ self.head, -30, 30)))


_cache: dict[str, float] = {}
_cached: list[bytes] = [b""]


def features(model: Model, texts: Iterable[str | None]) -> np.ndarray:
    """A row for each text: its TOP highest decisions over distinct tokens, filled up with the decision of a token like no
    landmark, and the logarithm of its number of distinct tokens."""
    if _cached[0] != (tag := model.weights.tobytes() + "\0".join(model.landmarks).encode() + np.float64(model.bias).tobytes()):
        _cache.clear()
        _cached[0] = tag
    rows = []
    texts = list(texts)
    for at in range(0, len(texts), A_TIME):
        own = [tokens(t) if t else set() for t in texts[at : at + A_TIME]]
        if len(_cache) > CACHE:
            _cache.clear()
        new = list(set().union(*own) - _cache.keys())
        _cache.update(zip(new, model.decide(new).tolist(), strict=True))
        top = [nlargest(TOP, map(_cache.__getitem__, t)) for t in own]
        rows += [[*t, *[model.bias] * (TOP - len(t)), np.log1p(len(w))] for t, w in zip(top, own, strict=True)]
    return np.array(rows, float).reshape(-1, TOP + 1)


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Weights (bias last) of the squared-hinge SVM, by Newton steps on the rows inside the margin."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        inside = y * (x @ w) < 1
        a = x[inside] * cost[inside, None]
        new = np.linalg.solve(x[inside].T @ a + np.diag([1.0] * (x.shape[1] - 1) + [1e-6]), a.T @ y[inside])
        if np.abs(new - w).max() < 1e-6:
            break
        w = (w + new) / 2 if _ > 20 else new
    return w


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights, constant last, by Newton steps; the labels weigh as they come."""
    x = np.hstack([x, np.ones((len(x), 1))])
    keep = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + keep, x.T @ (p - y) + keep @ w)
        w -= step * min(1, 3 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-7:
            break
    return w


def _sample(labels: DataFrame, rows: int) -> DataFrame:
    """doc_id, toxic: at most `rows` of each label."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out(F.col("doc_id")))
    order = F.md5(F.concat(F.lit("toxic:"), F.col("doc_id").cast("string")))
    return known.where("toxic = 1").orderBy(order).limit(rows).unionByName(known.where("toxic = 0").orderBy(order).limit(rows))


def _packed(rows: Iterable[np.ndarray]) -> list[bytes]:
    return [np.ascontiguousarray(r, np.float32).tobytes() for r in rows]


def _unpacked(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), np.float32).reshape(-1, width).astype(float)


def train(docs: DataFrame, labels: DataFrame, *, train_rows: int = TRAIN_ROWS, landmarks: int = LANDMARKS, negatives: int = NEGATIVES, a_document: int = A_DOCUMENT) -> Model:
    """A model of docs (doc_id, text) and labels (doc_id, toxic).

    Without a label of each kind, or a token that tells them apart, it scores every text next to 0. Null doc_ids and null labels teach
    nothing, null texts neither; empty texts teach only what their length (0) is worth. A doc_id that is labelled twice has the higher
    label; rows that repeat a doc_id are each an example. Ties among candidates are broken by the token, so reruns agree.
    """
    picked = staged(_sample(labels, train_rows).coalesce(1), "toxic-sample")  # two lists of at most train_rows ids
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = staged(rows.join(F.broadcast(picked), "doc_id").select("doc_id", "toxic", "text"), "toxic-train")  # in as many tasks as the scan has

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for t, text in zip(batch.toxic, batch.text, strict=True):
                own = {w for s in sentences(text) for w in tokens(s) if len(w) >= LETTERS}
                stems: dict[str, str] = {}
                for w in sorted(own, key=lambda w: (len(w), w)):
                    if len(w) <= WINDOW:
                        for i in range(len(w) - STEM + 1):
                            stems.setdefault(w[i : i + STEM], w)
                out += [(True, w, int(t), w) for w in own] + [(False, g, int(t), w) for g, w in stems.items()]
            yield pd.DataFrame(out, columns=["whole", "word", "toxic", "of"])

    counted = rows.mapInPandas(split, "whole boolean, word string, toxic int, of string").groupBy("whole", "word")
    example = F.min(F.when(F.col("toxic") == 1, F.struct(F.length("of"), F.col("of").alias("of"))))["of"]
    words = counted.agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"), example.alias("of"))
    words = staged(few(words, 2 * train_rows, 500), "toxic-words")
    sizes = dict(rows.groupBy("toxic").count().collect())
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    none = Model(["\0\0\0"], np.zeros(1), 0.0, np.array([0.0] * (TOP + 1) + [-30.0]))
    if not n1 or not n0:
        return none
    # How much likelier the word's rows are under its own share of toxic documents than under the sample's: chance alone gives
    # the best of n words a log likelihood ratio of about log(n).
    n, r = F.col("bad") + F.col("good"), n1 / (n1 + n0)
    ratio = F.col("bad") * F.log(F.col("bad") / n / r) + F.when(F.col("good") > 0, F.col("good") * F.log(F.col("good") / n / (1 - r))).otherwise(0.0)
    likely = words.where(F.col("bad") > r * n).where("bad > 1").withColumn("ratio", ratio).orderBy(F.col("ratio").desc(), "word").limit(40 * landmarks).collect()
    chance = np.log(max(2, words.count()))
    told = [r for i, r in enumerate(likely) if len(r["of"]) <= WINDOW and (i < FEWEST or r["ratio"] >= chance)]
    if not told:
        return none
    names = list(dict.fromkeys(r["of"] for r in told))[: 10 * landmarks]
    near = np.sqrt(kernel(names, names))
    taken: list[int] = []
    for i in range(len(names)):
        if len(taken) < landmarks and (not taken or near[i, taken].max() < 0.5):
            taken.append(i)
    plain = [r["word"] for r in words.where("whole and bad = 0").orderBy(F.col("good").desc(), "word").limit(PLAIN).collect() if len(r["word"]) <= WINDOW]
    marks = [names[i] for i in taken] + plain
    lead = len(taken)
    weight = {(r["whole"], r["word"]): float(r["ratio"]) for r in told}
    most = max(weight.values())
    sure = {r["word"] for r in told if r["whole"] and r["good"] <= 0.02 * r["bad"]}

    def told_of(w: str) -> float:
        """How telling a token is, or the most telling of its stems."""
        return max([weight.get((True, w), 0.0), *(weight.get((False, w[i : i + STEM]), 0.0) for i in range(len(w) - STEM + 1))]) / most

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            flat = batch.word.tolist()
            cut = [windows(w) for w in flat]
            k = kernel([p for ps in cut for p in ps], marks)
            best = [int(np.argmax(k[a : a + len(ps), :lead].max(1))) + a for ps, a in zip(cut, np.cumsum([0, *map(len, cut[:-1])]), strict=True)] if flat else []
            yield pd.DataFrame({"word": flat, "near": k[best, :lead].max(1).astype(float) if flat else [], "x": _packed(k[best]) if flat else []})

    hard = words.where("whole and bad = 0").select("word").mapInPandas(compared, "word string, near double, x binary").orderBy(F.col("near").desc(), "word").limit(negatives).select("x").toArrow()

    def latent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for at in range(0, len(batch), A_TIME):
                part = batch.iloc[at : at + A_TIME]
                own = [sorted({p for s in sentences(t) for w in tokens(s) if len(w) >= LETTERS for p in windows(w)}) for t in part.text]
                all_of = sorted(set().union(*own))
                place = {w: i for i, w in enumerate(all_of)}
                k = kernel(all_of, marks)
                lift = k[:, :lead].max(1) + np.array([2 * told_of(w) for w in all_of]) if all_of else np.zeros(0)
                for doc, ws in zip(part.doc_id, own, strict=True):
                    rows_of = np.array([place[w] for w in ws], int)
                    best = rows_of[np.argsort(-lift[rows_of], kind="stable")[:a_document]]
                    out += [(doc, all_of[i] in sure, float(lift[i]), x) for i, x in zip(best, _packed(k[best]), strict=True)]
            yield pd.DataFrame(out, columns=["doc_id", "sure", "lift", "x"])

    bags = rows.where("toxic = 1").select("doc_id", "text").mapInPandas(latent, "doc_id long, sure boolean, lift double, x binary").toArrow()
    between = kernel(marks, marks).astype(float) + RIDGE * np.eye(len(marks))
    values, vectors = np.linalg.eigh(between)
    to_features = vectors / np.sqrt(np.maximum(values, RIDGE)) @ vectors.T
    negative = _unpacked(hard["x"], len(marks)) @ to_features
    docs_of, lift = bags["doc_id"].to_numpy(), bags["lift"].to_numpy()
    cand = _unpacked(bags["x"], len(marks)) @ to_features
    clear = np.flatnonzero(bags["sure"].to_numpy())  # tokens that all but toxic documents lack
    w = np.zeros(len(marks) + 1)
    for _ in range(4):
        order = np.lexsort((-lift, docs_of))
        first = np.union1d(order[np.r_[True, docs_of[order][1:] != docs_of[order][:-1]]], clear)
        x = np.vstack([cand[first], negative])
        y = np.r_[np.ones(len(first)), -np.ones(len(negative))]
        cost = np.where(y > 0, COST * max(1.0, len(negative) / max(1, len(first))) ** 0.5, COST)
        w = _svm(x, y, cost)
        lift = np.hstack([cand, np.ones((len(cand), 1))]) @ w
    model = Model(marks, to_features @ w[:-1], float(w[-1]), np.zeros(TOP + 2))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"toxic": batch.toxic, "x": _packed(features(model, batch.text))})

    seen = rows.select("toxic", "text").mapInPandas(measure, "toxic int, x binary").toArrow()
    model.head = _logistic(_unpacked(seen["x"], TOP + 1), seen["toxic"].to_numpy().astype(float))
    released(picked, rows, words)
    return model


def score(docs: DataFrame, model: Model, name: str = "toxicity") -> DataFrame:
    """docs plus the column `name`, the probability that the whole text is toxic. A column of docs that has this name gives way.

    Null and empty texts have no token, and get the score of a text without anything like an insult. Very long texts are read
    whole. Null doc_ids and repeated rows: rows as any other, equal texts get equal scores, so ties stay ties. Empty table: no rows.
    """
    docs = docs.drop(name)
    text = docs.schema.names.index("text")

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = model.probability(features(model, batch.column(text).to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64())], [*batch.schema.names, name])

    return docs.mapInArrow(rate, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def clean_documents(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """docs less the rows that score 0.5 or more; its columns, whatever their names, as they were."""
    name = apart("toxicity")
    return score(docs, train(docs, labels, **settings), name).where(F.col(name) < 0.5).drop(name)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rated = score(docs, train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")))
    return rated.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
