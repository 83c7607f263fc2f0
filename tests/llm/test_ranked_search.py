"""Ranked search against brute force, with windows of a few documents, and its edge cases."""

import math
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from driftglass.llm import oracles, ranked_search

DATA = "/root/testdata/sf0.001"
WORDS = [a + b for a in ("ka", "lo", "mi", "ru", "Te", "só") for b in ("ban", "dir", "fol", "gem", "7")]


def found(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+", low)


def brute(docs, items, k=10):
    """Rows (item text, rank, doc_id, score)."""
    counts = [(i, Counter(found(t)), len(found(t))) for i, t in docs if found(t)]
    n, total = len(counts), sum(c[2] for c in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in {(i, t) for i, t in items if t is not None}:
        scores = []
        for doc, c, size in counts:
            m = 25 + (75 * size * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in found(text) if t in c)
            if s > 0:
                scores.append((-s, doc is None, doc or 0))
        out += [(item, r + 1, None if none else doc, -s) for r, (s, none, doc) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def rows(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


def tables(spark, docs, items, extra=False):
    d, q = spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string")
    if extra:
        for c in ("item", "score", "rank", "term", "salt", "df", "docs", "total"):
            d, q = d.withColumn(c, F.lit("clash")), q.withColumn(c, F.lit("clash"))
    return d, q


@pytest.mark.parametrize("window", [3, 64, 4096])
def test_brute_force(spark, window):
    r = random.Random(5)
    docs = [(i, " ".join(r.choices(WORDS, weights=range(1, len(WORDS) + 1), k=r.randint(0, 40)))) for i in range(300)]
    docs += [(1000 + i, docs[7][1]) for i in range(25)]  # ties by the dozen
    items = [(i, " ".join(r.choices(WORDS, k=r.randint(0, 9)))) for i in range(30)] + [(99, docs[7][1])]
    assert rows(ranked_search.ranked(*tables(spark, docs, items), window=window)) == brute(docs, items)


@pytest.mark.parametrize("extra", [False, True])
def test_edges(spark, extra):
    docs = [(1, None), (2, ""), (3, " \n#"), (4, "Alpha beta"), (4, "alpha BETA"), (None, "alpha beta"), (None, None), (5, "ÀLPHA àlpha"), (6, "x " * 700_000 + "gamma"), (7, "alpha-beta_gamma9 9"), (8, "a" * 3_000_000), (9, "ſ K k")]
    items = [(1, "alpha"), (1, "alpha"), (1, "beta gamma"), (None, "àlpha x"), (2, None), (3, ""), (4, "nowhere"), (5, "gamma gamma9 9 9"), (6, "k K"), (7, "a" * 3_000_000)]
    assert rows(ranked_search.ranked(*tables(spark, docs, items, extra))) == brute(docs, items)


def test_empty_tables_and_passes(spark):
    docs, items = [(1, "one two"), (2, "two three")], [(i, w) for i, w in enumerate(["one", "two", "three", "three two", "two one one"])]
    d, q = tables(spark, docs, items)
    assert rows(ranked_search.ranked(d.limit(0), q)) == rows(ranked_search.ranked(d, q.limit(0))) == []
    assert rows(ranked_search.ranked(d, q, a_pass=4)) == brute(docs, items)


def test_terms_of_very_long_texts(monkeypatch):
    text = " ".join(f"w{i}" for i in range(5000)).encode()
    monkeypatch.setattr(ranked_search, "A_CUT", 64)
    parts = list(ranked_search.terms(text))
    assert len(parts) > 100 and [t for p in parts for t in p] == text.split()


def test_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    said = con.execute(oracles.ORACLES["op11_ranked_search"])
    names = [c[0] for c in said.description]
    got = [tuple(r[n] for n in names) for r in ranked_search.op11(spark, DATA).collect()]
    assert got and sorted(got) == sorted(said.fetchall())
