"""Quality classifier: random Fourier features, ridge regression from partition sums, isotonic calibration (operator 6).

A document is a row of statistics of its whole text. Random Fourier features of the standardised statistics approximate a
Gaussian kernel; each partition sums its part of the normal equations, the parts are added up row by row, and only the matrix of
their fixed size comes to the driver. Labelled rows of the last learning fold take no part in the fit: they calibrate its scores,
summed in BINS bins, by pooling adjacent violators.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftglass.llm.common import held_out, staged, table

FEATURES, SEED, RIDGE, BINS = 256, 11, 1.0, 1024

STATISTICS = (
    "log_bytes", "log_words", "word_bytes", "word_spread", "upper", "digits", "bangs", "bars", "marks", "blanks", "lines",
    "beyond_ascii", "distinct_words", "top_word", "same_next", "longest_run", "shouted", "lone_marks", "repeated_lines", "entropy", "packed",
)


def statistics(raw: bytes) -> list[float]:
    """STATISTICS of a text's bytes; all 0 for an empty one."""
    words = raw.split()
    if not words:
        return [0.0] * len(STATISTICS)
    n, w = len(raw), len(words)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = counts[counts > 0] / n
    sizes = np.fromiter(map(len, words), np.int64, w)
    upper, digits = counts[65:91].sum(), counts[48:58].sum()
    letters = upper + counts[97:123].sum()
    run = best = same = 0
    last = None
    for x in words:
        if x == last:
            same += 1
            run += 1
            best = max(best, run)
        else:
            run = 0
        last = x
    lines = raw.split(b"\n")
    marks = counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum()
    few = sum(map(bytes.isupper, words))
    lone = sum(1 for x in words if len(x) == 1 and not x.isalnum())
    times = Counter(words)
    return [
        np.log1p(n), np.log1p(w), sizes.mean(), sizes.std(), upper / max(1, letters), digits / n, counts[33] / n, counts[124] / n, marks / n, (n - sizes.sum()) / n,
        len(lines) / w, counts[128:].sum() / n, len(times) / w, max(times.values()) / w, same / w, best / w, few / w, lone / w,
        1 - len(set(lines)) / len(lines), float(-(share * np.log2(share)).sum()), len(zlib.compress(raw, 1)) / n,
    ]


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of each row of docs (doc_id, text)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t.as_py() or b"") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary")).mapInArrow(rows, "doc_id long, x array<double>")


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    low: float
    high: float
    steps: np.ndarray  # calibrated score at each bin

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        made = np.random.default_rng(SEED)
        across = made.normal(size=(len(STATISTICS), FEATURES)) / np.sqrt(len(STATISTICS))
        turn = made.uniform(0, 2 * np.pi, FEATURES)
        return np.hstack([np.cos(z @ across + turn) * np.sqrt(2 / FEATURES), np.ones((len(z), 1))])

    def bins(self, x: np.ndarray) -> np.ndarray:
        raw = self.features(x) @ self.weights
        return np.clip((raw - self.low) / max(self.high - self.low, 1e-9) * (BINS - 1), 0, BINS - 1).round().astype(int)

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.steps[self.bins(x)]


def isotonic(good: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The rising sequence nearest to good / n, weighted by n; between pooled blocks it is interpolated, so that ties are few."""
    blocks: list[list[float]] = []
    for at in np.flatnonzero(n):
        blocks.append([good[at], n[at], at, at])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            g, m, _, to = blocks.pop()
            blocks[-1] = [blocks[-1][0] + g, blocks[-1][1] + m, blocks[-1][2], to]
    if not blocks:
        return np.full(len(n), 0.5)
    centres = [(a + b) / 2 for _, _, a, b in blocks]
    return np.interp(np.arange(len(n)), centres, [(g + 0.5 * g / m) / (m + 0.5) for g, m, *_ in blocks])


def train(rows: DataFrame, labels: DataFrame) -> Model:
    """A model of rows (doc_id, x) and labels (doc_id, quality): all labelled rows but those held out.

    Without any such label, every score is 0.5.
    """
    width = len(STATISTICS)
    marks = rows.agg(*[F.avg(F.col("x")[i]) for i in range(width)], *[F.stddev_pop(F.col("x")[i]) for i in range(width)]).first()
    mean, spread = (np.array([v or 0.0 for v in marks[a : a + width]]) for a in (0, width))
    model = Model(mean, np.maximum(spread, 1e-6), np.zeros(FEATURES + 1), 0.0, 1.0, np.full(BINS, 0.5))
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("y")).where(~held_out(F.col("doc_id")))
    last = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 4
    known = staged(rows.join(known, "doc_id").withColumn("last", last), "quality-labelled")
    size = FEATURES + 1

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            if len(batch):
                f = model.features(np.array(batch.x.tolist()))
                total += f.T @ np.hstack([f, batch.y.to_numpy(float)[:, None]])
        yield pd.DataFrame({"i": range(size), "part": [r.tobytes() for r in total]})

    def add(parts: pd.DataFrame) -> pd.DataFrame:
        whole = sum(np.frombuffer(p) for p in parts.part)
        return pd.DataFrame({"i": parts.i.head(1), "part": [whole.tobytes()]})

    got = known.where("not last").mapInPandas(sums, "i int, part binary").groupBy("i").applyInPandas(add, "i int, part binary").orderBy("i").collect()
    if not got:
        return model
    total = np.array([np.frombuffer(r["part"]) for r in got])
    model.weights = np.linalg.solve(total[:, :size] + np.diag([RIDGE] * (size - 1) + [1e-6]), total[:, size])

    def raw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            r = model.features(np.array(batch.x.tolist()).reshape(-1, width)) @ model.weights
            yield pd.DataFrame({"r": r, "y": batch.y})

    held = known.where("last").select("x", "y").mapInPandas(raw, "r double, y int")
    ends = held.agg(F.min("r"), F.max("r")).first()
    if ends[0] is None:
        return model
    model.low, model.high = ends[0], max(ends[1], ends[0] + 1e-6)

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"bin": model.bins(np.array(batch.x.tolist()).reshape(-1, width)), "y": batch.y})

    bins = known.where("last").select("x", "y").mapInPandas(binned, "bin int, y int").groupBy("bin").agg(F.sum("y").alias("good"), F.count(F.lit(1)).alias("n")).collect()
    good, n = np.zeros(BINS), np.zeros(BINS)
    for r in bins:
        good[r["bin"]], n[r["bin"]] = r["good"], r["n"]
    model.steps = isotonic(good, n)
    return model


def score(rows: DataFrame, model: Model) -> DataFrame:
    """(doc_id, quality) for rows (doc_id, x)."""

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).flatten()).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x), pa.float64())], ["doc_id", "quality"])

    return rows.select("doc_id", "x").mapInArrow(rate, "doc_id long, quality double")


def rated(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, quality) for every row of docs (doc_id, text): the probability that its quality is 1.

    Null, empty and blank texts have statistics of 0 and are scored from them. Very long texts are read whole. Null doc_id: scored,
    never learned from. Repeated rows: each scored; their labels count once for each. A doc_id that is labelled twice has the
    higher label. Equal texts get equal scores. Empty table: no rows. Extra columns, whatever their names, are left out.
    """
    rows = staged(measured(docs), "quality")
    return score(rows, train(rows, labels))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality").alias("score"), (F.col("quality") >= 0.3).cast("int").alias("predicted"))
