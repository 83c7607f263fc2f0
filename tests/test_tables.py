"""Merged tables: replays, untouched buckets, batches that die; layouts by key and of several generations."""

import random

import pytest
from pyspark.sql import functions as F

from driftglass.operators import state
from driftglass.session import deleted, scratch
from driftglass.sources import layouts
from driftglass.streaming import upserts

SCHEMA = "user long, note string, version long, came long"


def batch(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def made(n, seed, users=40):
    r = random.Random(seed)
    return [(r.choice([None, *range(users)]), f"n{r.randint(0, 999)}", r.randint(0, 9), seed * 10_000 + i) for i in range(n)]


def table_of(spark, buckets=4):
    return upserts.KeyedTable(scratch(spark, "t"), batch(spark, []).schema, "user", "version", "came", buckets)


def rows(df):
    return sorted((tuple(r[c] for c in ("user", "note", "version", "came")) for r in df.collect()), key=str)


def test_batches_and_replays_equal_one_pass(spark):
    users, parts = table_of(spark), [made(60, s) for s in range(1, 5)]
    assert rows(users.rows(spark)) == []
    for epoch in (0, 1, 1, 2, 2, 2, 3):  # some come again
        users.write(batch(spark, parts[epoch]).withColumn("bucket", F.lit("clash")), epoch)
    users.write(batch(spark, []), 4)
    whole = batch(spark, [r for p in parts for r in p])
    want = rows(state.newest(whole, "user", "version", "came"))
    assert rows(users.rows(spark)) == want
    users.vacuum(spark)
    assert rows(users.rows(spark)) == want and users._manifests(spark).select("epoch").distinct().count() == 1


def test_untouched_buckets_keep_their_files(spark):
    users = table_of(spark, 8)
    users.write(batch(spark, made(200, 1)), 0)
    before = set(users.rows(spark).inputFiles())
    users.write(batch(spark, [(5, "new", 99, 99_999)]), 1)
    after = set(users.rows(spark).inputFiles())
    assert len(users.state(spark)) == 8 and len(before & after) == 7 and len(after - before) == 1
    assert sorted(users.state(spark).values()) == [0] * 7 + [1]


def test_a_batch_without_manifest_does_not_count(spark):
    users = table_of(spark)
    users.write(batch(spark, made(50, 1)), 0)
    before = rows(users.rows(spark))
    users.write(batch(spark, made(50, 2)), 1)
    after = rows(users.rows(spark))
    deleted(spark, f"{users.root}/manifests/epoch=1")  # as if the job had died before its last step
    assert rows(users.rows(spark)) == before != after
    users.write(batch(spark, made(50, 2)), 1)
    assert rows(users.rows(spark)) == after


@pytest.fixture
def tables(spark):
    names = []
    yield names
    layouts.dropped(spark, *names)


def test_keyed_tables_are_joined_where_they_lie(spark, tables):
    a = spark.range(5000).select((F.col("id") % 700).alias("key"), F.col("id").alias("x"))
    b = spark.range(900).select(F.when(F.col("id") < 890, F.col("id")).alias("key"), (F.col("id") * 2).alias("y"))
    tables += [layouts.keyed(a, "key", 4, "a"), layouts.keyed(b, "key", 4, "b")]
    joined = spark.table(tables[0]).hint("merge").join(spark.table(tables[1]), "key")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, a.join(b, "key").collect()))


def test_lookups_open_their_buckets_alone(spark, tables):
    rows = spark.range(4000).select((F.col("id") % 1000).alias("key"), F.col("id").alias("x"))
    tables.append(layouts.keyed(rows, "key", 8, "c"))
    asked = spark.createDataFrame([(3,), (4_000_000,)], "k long")
    got = layouts.looked_up(spark, tables[0], "key", asked)
    assert "PushedFilters: [In(key" in got._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # so that the plan says what is opened
    try:
        plan = layouts.looked_up(spark, tables[0], "key", asked)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert "SelectedBucketsCount: 2 out of 8" in plan or "SelectedBucketsCount: 1 out of 8" in plan
    assert sorted(map(tuple, got.collect())) == [(3, 3), (3, 1003), (3, 2003), (3, 3003)]


def test_many_keys_are_joined(spark, tables, monkeypatch):
    monkeypatch.setattr(layouts, "MOST_KEYS", 2)
    tables.append(layouts.keyed(spark.range(100).select(F.col("id").alias("key")), "key", 4, "d"))
    asked = spark.range(90, 110)
    assert sorted(r["key"] for r in layouts.looked_up(spark, tables[0], "key", asked).collect()) == list(range(90, 100))


def test_layouts_of_all_generations(spark):
    root = scratch(spark, "t")
    spark.createDataFrame([(1, "a")], "id long, text string").write.parquet(f"{root}/layout=1")
    spark.createDataFrame([(2, "b", None), (3, "c", "de")], "id long, text string, lang string").write.parquet(f"{root}/layout=2")
    since = {"lang": (2, F.lit("und")), "kept": (3, F.lit(0).cast("long"))}
    got = lambda: sorted((r["id"], r["text"], r["lang"], r["kept"]) for r in layouts.all_layouts(spark, root, since).collect())
    assert got() == [(1, "a", "und", 0), (2, "b", None, 0), (3, "c", "de", 0)]  # a null that was written stays
    spark.createDataFrame([(4, "fr", 7, None)], "id long, lang string, kept long, text string").write.parquet(f"{root}/layout=3")
    assert got() == [(1, "a", "und", 0), (2, "b", None, 0), (3, "c", "de", 0), (4, None, "fr", 7)]


def test_jobs_run_at_their_intervals(spark, monkeypatch):
    import time

    from driftglass.streaming import jobs

    monkeypatch.setitem(jobs.EVERY, "outbox", "1 second")
    users, root = table_of(spark), scratch(spark, "t")
    batch(spark, made(20, 1)).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(users.schema).parquet(f"{root}/in")
    job = jobs.periodically(stream, "outbox", users.write, f"{root}/state")
    try:
        for seed in (2, 3):
            before = len(users._manifests(spark).select("epoch").distinct().collect())
            until = time.time() + 60
            while len(users._manifests(spark).select("epoch").distinct().collect()) <= before - (seed == 2) and time.time() < until:
                time.sleep(0.5)
            batch(spark, made(20, seed)).write.mode("append").parquet(f"{root}/in")
        job.processAllAvailable()
    finally:
        job.stop()
    whole = batch(spark, [r for s in (1, 2, 3) for r in made(20, s)])
    assert rows(users.rows(spark)) == rows(state.newest(whole, "user", "version", "came")) and len(users.state(spark)) > 0
