"""Leases: refreshed and late words, restarts from a checkpoint, members that never lapse."""

import random
from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from driftglass.session import scratch
from driftglass.streaming import leases

T0 = 1_700_000_000


def at(s):
    return datetime.utcfromtimestamp(T0 + s)


def run(spark, batches, job, root=None):
    """Each batch is there before the job is started anew from its checkpoint."""
    root = root or scratch(spark, "t")
    own = leases.stateful_session(spark)
    for batch in batches:
        rows = spark.createDataFrame(batch, "doc_id long, node_id long, s long").select("doc_id", "node_id", F.timestamp_seconds(F.lit(T0) + F.col("s")).alias("ts"), F.lit("clash").alias("member"), F.lit(1).alias("event"))
        rows.coalesce(1).write.mode("append").parquet(f"{root}/in")
        source = own.readStream.schema(rows.schema).parquet(f"{root}/in")
        job(source).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return sorted(((r["key"], r["member"], r["event"], int(r["at"].timestamp()) - T0) for r in spark.read.parquet(f"{root}/out").withColumn("at", F.col("at")).collect()), key=lambda e: (e[0], e[1], e[3], e[2]))


def test_claims_expire_are_refreshed_and_start_again(spark):
    job = lambda s: leases.expiring_claims(s, 90, late="5 seconds")
    first = [(1, 7, 0), (1, 7, 50), (1, 7, 30), (1, 8, 10), (2, 7, 20), (None, 7, 1), (1, None, 1)]  # 30 comes after 50
    second = [(1, 7, 139), (2, 9, 140)]  # just in time for 7; 8 lapses at 100, 7 at 110 for document 2
    third = [(1, 8, 400), (3, 1, 395), (1, 7, 20)]  # 20 is behind the watermark
    got = run(spark, [first, second, third], job)
    assert got == [
        (1, 7, "start", 0), (1, 7, "end", 229), (1, 8, "start", 10), (1, 8, "end", 100), (1, 8, "start", 400), (2, 7, "start", 20), (2, 7, "end", 110), (2, 9, "start", 140), (2, 9, "end", 230), (3, 1, "start", 395),
    ]


def test_a_restart_repeats_nothing(spark):
    root, job = scratch(spark, "t"), lambda s: leases.expiring_claims(s, 10, late="1 second")
    once = run(spark, [[(1, 7, 0), (1, 7, 100)]], job, root)
    assert once == [(1, 7, "start", 0), (1, 7, "end", 10), (1, 7, "start", 100)]
    again = run(spark, [[(5, 5, 101)]], job, root)
    assert again == [*once, (5, 5, "start", 101)]


def test_what_a_node_holds_itself_does_not_expire(spark):
    got = run(spark, [[(1, 7, 0), (1, 8, 0)], [(2, 7, 500)], [(2, 7, 900), (1, 7, 901)]], lambda s: leases.expiring_claims(s, 10, self_id=7, late="1 second"))
    assert got == [(1, 7, "start", 0), (1, 8, "start", 0), (1, 8, "end", 10), (2, 7, "start", 500)]


def test_liveness_has_two_limits(spark):
    """Node 1 is heard directly, node 2 through others (odd seconds: three hops)."""
    job = lambda s: leases.liveness(s.withColumn("hops", F.when(F.second("ts") % 2 == 0, 1).otherwise(3)), late="1 second")
    even = -T0 % 2  # an even second
    got = run(spark, [[(0, 1, even), (0, 1, even + 14), (0, 2, even + 1), (0, 2, even + 45), (0, 1, even + 200)]], job)
    assert got == [(1, 1, "start", even), (1, 1, "end", even + 13), (1, 1, "start", even + 14), (1, 1, "end", even + 27), (1, 1, "start", even + 200), (2, 2, "start", even + 1), (2, 2, "end", even + 90)]


def test_holders_after_the_events(spark):
    rows = [(1, 7, "start", at(0)), (1, 7, "end", at(9)), (1, 8, "start", at(0)), (1, 8, "end", at(5)), (1, 8, "start", at(5))]
    got = leases.holders_at(spark.createDataFrame(rows, leases.EVENTS)).collect()
    assert [(r["key"], r["member"], r["at"]) for r in got] == [(1, 8, at(5))]


def test_keys_share_shelves(spark):
    """No more state rows than shelves, however many keys: 3,000 keys, of which a third is refreshed and a third lapses."""
    root = scratch(spark, "t")
    first = [(k, 1, 0) for k in range(3000)]
    got = run(spark, [first, [(k, 1, 50) for k in range(0, 3000, 3)], [(k, 1, 200) for k in range(1, 3000, 3)], [(9999, 1, 400)]], lambda s: leases.expiring_claims(s, 90, late="1 second"), root)
    want = [(k, 1, "start", 0) for k in range(3000)] + [(k, 1, "end", 140 if k % 3 == 0 else 90) for k in range(3000)]
    want += [(k, 1, e, t) for k in range(1, 3000, 3) for e, t in (("start", 200), ("end", 290))] + [(9999, 1, "start", 400)]
    assert got == sorted(want, key=lambda e: (e[0], e[1], e[3], e[2]))
    state = leases.stateful_session(spark).read.format("statestore").option("stateVarName", "held").option("batchId", 0).load(f"{root}/state")
    assert 0 < state.count() <= leases.SHELVES


def test_told_equals_words_one_by_one():
    r = random.Random(5)
    held = {}
    table = np.empty((0, 4), np.int64)
    for now in range(0, 400, 40):
        words = [(r.randrange(3), r.randrange(3), now + r.randrange(60), r.choice([-1, 5, 30])) for _ in range(r.randrange(12))]
        events = []
        for key, member, at, lease in sorted(words, key=lambda w: (w[2], w[3])):
            if (key, member) in held and at <= held[key, member][0]:
                continue
            if (key, member) in held and at > held[key, member][1]:
                events.append((key, member, "end", held.pop((key, member))[1]))
            if (key, member) not in held:
                events.append((key, member, "start", at))
            held[key, member] = at, at + lease if lease >= 0 else leases.NEVER
        events += [(*k, "end", v[1]) for k, v in held.items() if v[1] < now]
        held = {k: v for k, v in held.items() if v[1] >= now}
        table, starts, ends = leases.told(table, np.array(words, np.int64).reshape(-1, 4), now)
        got = [(k, m, "start", t) for k, m, t in starts.tolist()] + [(k, m, "end", t) for k, m, t in ends.tolist()]
        assert sorted(got) == sorted(events) and sorted(table.tolist()) == sorted([*k, *v] for k, v in held.items())
