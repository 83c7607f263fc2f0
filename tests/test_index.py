"""Kept indexes: increments against an index built afresh, what they read, blocks that are skipped, int8 bounds."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftglass.operators import lexical, postings, quantised, search
from driftglass.session import scratch

WORDS = [f"{a}{b}" for a in ("kal", "lom", "mir", "rut", "tev", "son") for b in ("ban", "dir", "fol", "gem", "hus", "nap", "pit")]


def texts(n, seed, most=30):
    r = random.Random(seed)
    return [(i, " ".join(r.choices(WORDS, weights=range(1, len(WORDS) + 1), k=r.randint(0, most)))) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def asked(spark, n=12, seed=3):
    r = random.Random(seed)
    return spark.createDataFrame([(i, " ".join(r.choices(WORDS, k=r.randint(1, 5)))) for i in range(n)], "query_id long, query string")


def found(df):
    return sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect())


def whole(spark, rows, queries, k):
    return found(lexical.top_k(lexical.bm25_scores(frame(spark, rows), queries), k))


def pruned(df):
    """The partition filters of a plan's scans."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.split("PartitionFilters: [")[1:]]


@pytest.mark.parametrize("window", [4, 1000])
def test_increments_equal_an_index_built_afresh(spark, window):
    rows, more = dict(texts(150, 1)), dict(texts(60, 2))
    index = postings.Index(spark, scratch(spark, "t"), 4, window)
    assert index.search(asked(spark), 3).count() == 0 and index.generations() == []
    index.update(frame(spark, list(rows.items())))
    new = {i * 4: t for i, t in more.items()}  # some are known, some are not
    index.update(frame(spark, list(new.items())))
    rows |= new
    gone = [3, 8, 40, 99_999, 236]
    index.update(None, frame(spark, [(i, None) for i in gone]))
    index.update(frame(spark, [(8, "kalban again"), (7, None)]), frame(spark, [(8, None), (11, None)]))
    rows = {i: t for i, t in rows.items() if i not in [*gone, 11]} | {8: "kalban again", 7: None}
    queries = asked(spark)
    assert index.generations() == [1, 2, 3, 4]
    assert found(index.search(queries, 5)) == whole(spark, list(rows.items()), queries, 5)
    afresh = postings.Index(spark, scratch(spark, "t"), 4, window)
    afresh.update(frame(spark, list(rows.items())))
    state = lambda x: (sorted(x.frequencies().collect()), x._counts(), sorted(x.documents().collect()))
    assert state(index) == state(afresh)
    index.merge()
    assert index.generations() == [5] and state(index) == state(afresh)
    index.vacuum()
    assert found(index.search(queries, 5)) == whole(spark, list(rows.items()), queries, 5)
    assert index._read("totals", postings._TOTALS).count() == 1
    index.update(None, frame(spark, [(i, None) for i in rows]))
    assert index._counts() == (0, 0.0) and index.search(queries, 5).count() == 0


def test_an_increment_reads_the_buckets_it_changes_alone(spark):
    index = postings.Index(spark, scratch(spark, "t"), 8)
    index.update(frame(spark, texts(200, 4)))
    ids = frame(spark, [(5, None)]).select("doc_id")
    read = pruned(index.documents(ids))
    assert len(index._buckets_of(ids, "doc_id")) == 1 and len(read) == 1 and "bucket" in read[0].split("]")[0]
    terms = spark.createDataFrame([("kalban",)], "term string")
    read = pruned(index.blocks(terms))
    assert len(index._buckets_of(terms, "term")) == 1 and len(read) == 1 and "bucket" in read[0].split("]")[0]
    scan = index.blocks(terms)
    scan.collect()
    rows = index._read("postings", postings._POSTINGS).select("bucket").distinct().count()
    assert rows > 1 and scan.select("bucket").distinct().count() == 1


def test_a_generation_without_totals_does_not_count(spark):
    index = postings.Index(spark, scratch(spark, "t"), 2)
    index.update(frame(spark, texts(40, 5)))
    before = found(index.search(asked(spark), 3))
    from driftglass.session import deleted

    index.update(frame(spark, [(1, "kalban kalban"), (77, "kalban")]))
    deleted(spark, f"{index.root}/totals/gen=2")  # as if the job had died before its last step
    assert index.generations() == [1] and found(index.search(asked(spark), 3)) == before
    index.update(frame(spark, [(2, "lomdir")]))
    assert index.generations() == [1, 2]
    rows = dict(texts(40, 5)) | {2: "lomdir"}
    assert found(index.search(asked(spark), 3)) == whole(spark, list(rows.items()), asked(spark), 3)


def test_blocks_are_skipped(spark):
    rows = [(i, "kalban " * 1 + "lomdir " * 40) for i in range(400)] + [(1000 + i, "kalban kalban mirfol") for i in range(6)]
    index = postings.Index(spark, scratch(spark, "t"), 4, 8)
    index.update(frame(spark, rows))
    queries = spark.createDataFrame([(1, "kalban mirfol"), (2, "nowhere")], "query_id long, query string")
    one = postings.Search(index, queries, 5, seeds=2)
    assert found(one.best()) == whole(spark, rows, queries, 5)
    report = {r["query_id"]: (r["blocks"], r["read"]) for r in one.report().collect()}
    assert report.keys() == {1} and report[1][0] > 50 > 8 > report[1][1] > 0


def test_ties_nulls_and_rows_that_repeat(spark):
    rows = [(9, "kalban"), (3, "kalban"), (5, "kalban"), (None, "kalban"), (7, None), (8, ""), (3, "kalban")]
    index = postings.Index(spark, scratch(spark, "t"), 2, 4)
    index.update(frame(spark, rows).withColumn("len", F.lit("clash")).withColumn("terms", F.lit(1)))
    got = found(index.search(spark.createDataFrame([(1, "kalban KALBAN"), (2, None), (3, "")], "query_id long, query string"), 2))
    assert [g[:3] for g in got] == [(1, 1, 3), (1, 2, 5)] and index._counts() == (5, 3 / 5)


def vectors(n, dim, seed):
    r = np.random.default_rng(seed)
    base = r.normal(size=(8, dim))
    v = base[r.integers(0, 8, n)] + 0.02 * r.normal(size=(n, dim))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def test_int8_is_exact(spark):
    v = vectors(700, 32, 1)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(700, v[3].tolist()), (701, [0.0] * 32), (702, None), (None, v[5].tolist()), (703, (1e-300 * v[7]).tolist()), (704, (9 * v[9]).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)
    queries = df.where("vec_id % 70 = 0 or vec_id = 701").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    packed = quantised.blocks(df)
    pairs = quantised.to_rescore(packed, queries, 5)
    rank = lambda x: {(r["query_id"], r["rank"]): (r["vec_id"], round(r["score"], 9)) for r in x.collect()}
    want = rank(search.vector_top_k(df, queries, 5))
    assert rank(quantised.vector_top_k_quantised(packed, df, queries, 5, pairs=pairs)) == want
    told = pairs.where("query_id <> 701").count()  # every vector is as near to the zero vector
    assert told < 0.5 * (queries.count() - 1) * 705


def test_int8_bounds_hold(spark):
    v = vectors(300, 48, 2)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(vectors(9, 48, 3))], "query_id long, query_vector array<double>")
    rows = quantised.candidates(quantised.blocks(df), queries, 300).collect()
    q = {r["query_id"]: np.array(r["query_vector"]) for r in queries.collect()}
    assert len(rows) == 2700 and all(r["lower"] <= float(v[r["vec_id"]] @ q[r["query_id"]]) <= r["upper"] for r in rows)
    assert max(r["upper"] - r["lower"] for r in rows) < 0.05


def test_int8_takes_what_is_no_number_along(spark):
    rows = [(1, [1.0, 0.0]), (2, [float("inf"), 1.0]), (3, [0.5, 0.5]), (4, [0.1]), (5, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, query_vector array<double>")
    pairs = quantised.to_rescore(quantised.blocks(df), queries, 1)
    assert {r["vec_id"] for r in pairs.collect()} == {1, 2}
    assert quantised.blocks(df.limit(0)).count() == 0


def test_words_are_counted_in_place(spark):
    """No exchange before the postings' one: a document's words don't travel one by one, and postings of a window are grouped where they lie."""
    index = postings.Index(spark, scratch(spark, "t"), 2, 4)
    index.update(frame(spark, texts(40, 6)))
    docs = spark.read.parquet(f"{index.root}/documents").select("doc_id", F.lit("kalban x9 kalban .").alias("text"))
    plan = postings._forward(docs)
    nodes = plan._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in nodes and "Generate" not in nodes
    assert {(r["len"], tuple(map(tuple, r["terms"]))) for r in plan.collect()} == {(3, (("kalban", 2), ("x9", 1)))}


def test_what_a_change_does_to_postings(spark):
    t = lambda **tf: [(k, v) for k, v in sorted(tf.items())]
    rows = [(1, t(a=2, b=1), None), (2, None, t(a=1, c=4)), (3, t(a=2, b=1, d=1), t(a=1, b=1, c=4)), (4, [], [])]
    df = spark.createDataFrame(rows, f"id int, new {postings._TERMS}, old {postings._TERMS}")
    got = {r["id"]: [tuple(x) for x in r["d"]] for r in df.select("id", postings._difference(F.col("new"), F.col("old")).alias("d")).collect()}
    assert got == {1: [("a", 2, 1), ("b", 1, 1)], 2: [("a", 0, -1), ("c", 0, -1)], 3: [("a", 2, 0), ("b", 1, 0), ("c", 0, -1), ("d", 1, 1)], 4: []}


def test_increments_of_many_ids(spark, monkeypatch):
    """Beyond the ids that are broadcast the whole index is looked through; the same comes out."""
    monkeypatch.setattr(postings, "MOST_IDS", 3)
    index = postings.Index(spark, scratch(spark, "t"), 2, 4)
    index.update(frame(spark, [(i, "kalban mirfol") for i in range(30)]))
    index.update(frame(spark, [(i, "lomdir") for i in range(10)]), frame(spark, [(i, None) for i in range(8, 15)]))
    assert {r["term"]: r["df"] for r in index.frequencies().collect()} == {"kalban": 15, "mirfol": 15, "lomdir": 10}
    assert index._counts() == (25, 40 / 25)


def test_an_increment_is_held_on_disk_few_documents_at_a_time(spark, monkeypatch):
    """What executors hold of an increment's changes doesn't grow with it, and what it staged goes."""
    from pyspark import StorageLevel

    held, write = [], postings.Index._write
    monkeypatch.setattr(postings.Index, "_write", lambda self, changes, *a, **b: (write(self, changes, *a, **b), held.append((changes.storageLevel, changes.sparkSession.conf.get("spark.sql.inMemoryColumnarStorage.batchSize"), memory(spark)))))
    staged = []
    monkeypatch.setattr(postings, "staged", lambda df, name, f=postings.staged: (staged.append(f(df, name)), staged[-1])[1])
    before = spark.conf.get("spark.sql.inMemoryColumnarStorage.batchSize")
    index = postings.Index(spark, scratch(spark, "t"), 4)
    index.update(frame(spark, texts(300, 1)))
    index.update(frame(spark, texts(200, 2)), frame(spark, [(250, None)]))
    assert held[1] == (StorageLevel.DISK_ONLY, postings.HELD_AT_ONCE, 0) and spark.conf.get("spark.sql.inMemoryColumnarStorage.batchSize") == before
    at = spark._jvm.org.apache.hadoop.fs.Path
    assert len(staged) == 2 and not any(at(x._folder).getFileSystem(spark._jsc.hadoopConfiguration()).exists(at(x._folder)) for x in staged)
    assert index._counts()[0] == 299
    read = index.documents().sparkSession.conf
    assert read.get("spark.sql.parquet.columnarReaderBatchSize") == postings.READ_AT_ONCE


def memory(spark):
    """Bytes of memory that held tables take."""
    return sum(x.memSize() for x in spark.sparkContext._jsc.sc().getRDDStorageInfo())
