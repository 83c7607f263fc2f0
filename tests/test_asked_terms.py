"""Searches by terms, and counts of documents, in arrays: the same in SQL on odd tables, and what is exchanged."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftglass.functions import hashing, text, vectors
from driftglass.operators import lexical, search
from driftglass.queries import ORACLES, QUERIES

ODD = ["", None, "a the of", "burn burn burn", "cool the burn. under\twater\x1cnow", "KKelvin été x y z", "日本 burn water", "wound. wound", "W" * 300 + " burn"]


def tables(spark, tmp_path, docs, asked):
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    return con


def same(spark, tmp_path, con, name):
    got = QUERIES[name](spark, str(tmp_path))
    want = con.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    plain = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    assert sorted([plain(r[n]) for n in names] for r in got.collect()) == sorted(list(map(plain, r)) for r in want.fetchall())


@pytest.mark.parametrize("name", ["bm25_search", "term_coverage_top", "hash_embedding", "hybrid_search_mobile", "hybrid_search_web", "exhaustive_search"])
def test_odd_documents(spark, tmp_path, name, monkeypatch):
    monkeypatch.setattr(lexical, "TEXTS", 7)
    random.seed(5)
    words = "burn water cool wound. press ice aloe 12 x9 keep bandage sterile".split()
    docs = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, " ".join(random.choices(words, k=random.randint(1, 30)))) for i in range(120)] + [(500 + i, "press ice aloe") for i in range(9)]
    docs += [(None, "aloe burn")] if name in ("bm25_search", "term_coverage_top") else []
    asked = [(1, "cool burn burn water"), (2, "nothing matches this"), (3, ""), (4, "Press ICE, aloe!"), (5, "kkelvin t wound."), (6, None)]
    same(spark, tmp_path, tables(spark, tmp_path, docs, asked), name)


def test_documents_that_share_an_id_count_once(spark, tmp_path):
    docs = [*enumerate(ODD), (3, "burn aloe aloe"), (3, "burn cool"), (4, "cool"), (None, "burn nowhere"), (None, "nowhere")]
    same(spark, tmp_path, tables(spark, tmp_path, docs, [(1, "burn")]), "token_document_frequency")


def test_no_pair_of_document_and_term_is_exchanged(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"burn water w{i % 3}") for i in range(60)], "doc_id long, text string")
    plan = lexical.documents_with(docs)._jdf.queryExecution().toString()
    assert "hashpartitioning(term" in plan and "hashpartitioning(doc_id" not in plan
    asked = spark.createDataFrame([(1, "burn w1"), (2, "w2 water")], "query_id long, query string")
    best = lexical.best_by_terms(docs, asked, 2)
    assert {(r["query_id"], r["doc_id"]) for r in best.collect()} == {(1, 1), (1, 4), (2, 2), (2, 5)}
    slow = lexical.top_k(lexical.bm25_scores(docs, asked), 2)
    assert sorted(map(tuple, best.collect())) == sorted(map(tuple, slow.select(*best.columns).collect()))


def test_words_as_they_were_cut_before(spark):
    df = spark.createDataFrame([(t,) for t in [*ODD, "i. a.b ..", "İstanbul", "x" * 5000 + "-y1"]], "t string")
    old = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce("t", F.lit(""))), r"[^a-z0-9\s.]", " "), r"\s+"), lambda w: (F.length(w) > 1) & ~w.isin(*text.STOP_WORDS))
    assert all(r["a"] == r["b"] for r in df.select(old.alias("a"), text.tokenize(F.col("t")).alias("b")).collect())


def test_vectors_of_any_words():
    """Words beyond ASCII, very long ones, and slices of a batch."""
    texts = [["skipped"], ["ab", "été", "burning", "burning"], [], ["x" * 700, "日本語テキスト", "burn"], ["q" * 9] * 40]
    got = search.unit_vectors(pa.array(texts, pa.list_(pa.string())).slice(1))
    for words, v in zip(texts[1:], got, strict=True):
        want = np.zeros(vectors.EMBED_DIM)
        features = [(w, 1.0) for w in words] + [(f"{a} {b}", 0.7) for a, b in zip(words, words[1:], strict=False)] + [(w[i : i + 4], 0.35) for w in words for i in range(len(w) - 3)]
        for (f, weight), h, s in zip(features, hashing.fnv1a_of([f for f, _ in features]), hashing.fnv1a_of([f for f, _ in features], hashing.SIGN_SEED), strict=True):
            want[h % vectors.EMBED_DIM] += weight if s % 2 == 0 else -weight
        assert np.allclose(v, want / (np.linalg.norm(want) or 1), atol=1e-12)
