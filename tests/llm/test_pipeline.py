"""Each stage of corpus_pipeline.py against brute force or SQL, on the rows that the stage before it kept."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from driftglass.llm import line_dedup, minhash, oracles, packing, toxicity

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Each stage's rows, from `documents` on, as pandas."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs.toPandas()]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.staged(stage(spark, docs, DATA), f"test-{name}")
        out.append(docs.toPandas())
    return out


def rows_of(sql, documents):
    con = duckdb.connect()
    con.register("documents", documents)
    said = con.execute(sql)
    names = [c[0] for c in said.description]
    return [dict(zip(names, r, strict=True)) for r in said.fetchall()]


def test_stages_keep_the_columns(stages):
    for rows in stages[1:-1]:
        assert list(rows.columns) == list(stages[0].columns)


def test_toxic_documents_go(spark, stages):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "toxic"))
    rows = docs.select("doc_id", F.col("text")).toPandas()
    bad = model.probability(toxicity.features(model, rows.text.tolist())) >= 0.5
    assert sorted(stages[1].doc_id) == sorted(rows.doc_id[~bad]) and 0 < bad.sum() < len(rows)


def test_repeated_lines_go(stages):
    want = {r["doc_id"]: r["kept_sha256"] for r in rows_of(line_dedup.ORACLE, stages[1])}
    got = {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in zip(stages[2].doc_id, stages[2].text, strict=True)}
    assert got == want
    assert all(n == len(t) for t, n in zip(stages[2].text, stages[2].n_chars, strict=True) if t is not None)


def test_one_document_of_a_group_stays(stages):
    want = sorted(r["doc_id"] for r in rows_of(minhash.ORACLE, stages[2]) if r["kept"])
    assert sorted(stages[3].doc_id) == want


def test_the_mix_repeats_documents(stages):
    want = {r["doc_id"]: int(r["taken"] / r["size"] + 0.5) for r in rows_of(oracles.mix_sources(), stages[3]) if r["taken"] > 0}
    assert stages[4].doc_id.value_counts().to_dict() == {i: n for i, n in want.items() if n}


def test_every_word_is_packed_once(stages):
    docs, packed = stages[4], stages[5]
    words = {}
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        words[i] = words.get(i, 0) + len((t or "").encode().split())
    assert packed.groupby("doc_id").n_words.sum().to_dict() == words
    source, text = dict(zip(docs.doc_id, docs.source, strict=True)), {i: " ".join((t or "").lower().split()) for i, t in zip(docs.doc_id, docs.text, strict=True)}
    for _, own in packed.groupby("bin_id"):
        spans = sorted(zip(own.bin_offset, own.n_words, strict=True))
        assert sum(n for _, n in spans) <= packing.CAPACITY and all(a + n <= b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))
        assert len({text[i] for i in own.doc_id}) == len(own)
        assert own.doc_id.map(lambda i: source[i]).value_counts(dropna=False).max() <= packing.SAME_SOURCE


def test_stages_on_edge_cases(spark, tmp_path):
    """Nulls in any column, empty and long texts, ties, repeated rows, clashing names, an empty table."""
    rows = [
        (1, None, "en", "a", None), (2, "", None, "a", 0), (3, " \n\t", "en", None, 3), (4, "one line that many documents share\nx y", "en", "b", 9), (5, "ONE line that many documents share \nz", "en", "b", 9),
        (6, "one line that many documents share", "en", "b", 9), (6, "one line that many documents share", "en", "b", 9), (None, "one line that many documents share", "en", "c", 9), (8, " ".join(f"w{i % 997}" for i in range(50_000)), "en", "a", 9),
        (9, " ".join(f"w{i % 997}" for i in range(50_000)), "en", "a", 9),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("_id", "_copies", "toxicity", "n_lines", "digest", "row", "component", "size"):
        docs = docs.withColumn(c, F.lit(c))
    spark.createDataFrame([(4, 0), (5, 1), (None, 1), (6, None)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.staged(stage(spark, docs, str(tmp_path)), f"edge-{name}")
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        if name != "packing":
            assert out.columns == docs.columns
            assert all(r[c] == c for r in out.collect() for c in ("_id", "_copies", "toxicity", "n_lines", "digest", "row", "component", "size"))
            docs = out
        if name == "minhash_near_dedup":
            assert sorted(r["doc_id"] or 0 for r in out.collect()) == [0, 1, 2, 3, 4, 5, 6, 8]
    assert out.groupBy("bin_id").agg(F.sum("n_words").alias("n")).agg(F.max("n")).first()[0] <= packing.CAPACITY
