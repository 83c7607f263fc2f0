"""Properties of the operators, against plain Python models."""

import math
import os
import random
import time

import numpy as np
from pyspark.sql import functions as F

from driftglass.functions import codec, hashing, identity, text, vectors
from driftglass.operators import ingest, placement, search, state
from driftglass.plans import graph


def one(spark, column, *args):
    names = [f"c{i}" for i in range(len(args))]
    return spark.createDataFrame([args], names).select(column(*map(F.col, names)).alias("x")).first()["x"]


def fnv(s, h=hashing.FNV_SEED):
    units = s.encode("utf-16-be", "surrogatepass")
    for i in range(0, len(units), 2):
        h = (h ^ int.from_bytes(units[i : i + 2])) * hashing.FNV_PRIME & 0xFFFFFFFF
    return h


def mix(a, b):
    h = a ^ hashing.MIX_XOR
    h = (h ^ b) * hashing.MIX_FIRST & 0xFFFFFFFF
    h = (h ^ h >> 13) * hashing.MIX_SECOND & 0xFFFFFFFF
    return h ^ h >> 16


def test_hashes(spark):
    random.seed(1)
    rows = [(random.getrandbits(32), random.getrandbits(32), "".join(chr(random.randint(32, 900)) for _ in range(random.randint(0, 30)))) for _ in range(200)]
    rows += [(178096950, 2907280096, ""), (4140640039, 0, "a"), (1, 1, "a😀b"), (2, 2, "􏿿\uffff𐀀")]
    got = spark.createDataFrame(rows, "a long, b long, s string").select("a", "b", "s", hashing.mix32(F.col("a"), F.col("b")).alias("m"), hashing.fnv1a(F.col("s")).alias("f")).collect()
    for r in got:
        assert r["m"] == mix(r["a"], r["b"])
        assert r["f"] == fnv(r["s"])
    assert {r["s"]: r["f"] for r in got}["a😀b"] == 2412414209  # two surrogates, not one code point


def test_tokenize(spark):
    assert one(spark, text.tokenize, "How do I cool a Burn? 38.5C  wound. .. x") == ["do", "cool", "burn", "38.5c", "wound.", ".."]
    assert one(spark, text.keywords, "How do I cool a burn. at 38.5C") == ["cool", "burn", "5c"] or one(spark, text.keywords, "How do I cool a burn. at 38.5C") == ["cool", "burn"]


def test_html(spark):
    page = "<!doctype html><title>A &amp; B</title><style>x{}</style><h1 class=a>Head</h1><p>One&nbsp;&lt;two&#62; &#x41;</p><!-- no --><div>three</div><script>var a;</script>&unknown;"
    assert one(spark, text.html_text, page) == "A & B\n## Head\n\nOne <two> A\n\nthree\n&unknown;"
    assert one(spark, text.html_title, page) == "A & B"
    assert one(spark, text.html_text, "A<!-- <script> --> kept? </script>B") == "A<!-- B"  # elements go first, comments after
    assert one(spark, text.html_text, "&#x0000000000000000000041;&#00000000000000000000000000066;&#x110000;&#99999999999999999999;&#0;&#x;") == "AB&#x110000;&#99999999999999999999;&#0;&#x;"
    assert one(spark, text.tidy, "a hyphen-\nation of, \nlines\nand Well-\nKnown") == "a hyphenation of, lines and Well-\nKnown"


def test_labels(spark):
    assert one(spark, text.note_filename, " Hello, World! ") == "hello-world.md"
    assert one(spark, text.note_filename, "!!") == "note.md"
    assert one(spark, text.size_label, 1280) == "1.3 KB"
    assert one(spark, text.title_of, "", "# One\n# Two\ntext", "x.md") == "Two"
    assert one(spark, text.title_of, "", "text", "x.md") == "x"
    assert one(spark, text.sniff, bytearray(b"%PDF-1.4")) == "pdf"
    assert one(spark, text.wreckage, "\x00\x01abc") is True


def test_vectors(spark):
    random.seed(2)
    v = [random.gauss(0, 1) for _ in range(384)]
    n = math.sqrt(sum(x * x for x in v))
    v = [x / n for x in v]
    row = spark.createDataFrame([(v,)], "v array<double>").select("v", vectors.quantize(F.col("v")).alias("z")).select(vectors.dot(F.col("v"), vectors.dequantize(F.col("z.q"), F.col("z.scale"))).alias("c")).first()
    assert row["c"] > 0.999
    zero = spark.createDataFrame([([0.0, 0.0],)], "v array<double>").select(vectors.quantize(F.col("v")).alias("z")).first()["z"]
    assert zero["scale"] == 1.0 and list(zero["q"]) == [0, 0]


def test_embedding(spark):
    rows = spark.createDataFrame([(1, "cool the burn under water"), (2, "burning burns cooled with water"), (3, "bake sourdough bread at home"), (4, "")], "id long, text string")
    asked = search.embeddings(rows.select(F.col("id").alias("query_id"), "text"), "query_id", "text").withColumnRenamed("vector", "query_vector")
    cos = {(r["query_id"], r["id"]): r["score"] for r in search.vector_top_k(search.embeddings(rows, "id", "text"), asked, 3, "id", "vector").collect()}
    assert cos[1, 2] > cos.get((1, 3), 0)
    assert abs(cos[1, 1] - 1) < 1e-9
    slow = {}
    for r in rows.select("id", text.tokenize(F.col("text")).alias("words")).collect():
        words, v = r["words"], np.zeros(vectors.EMBED_DIM)
        features = [(w, 1.0) for w in words] + [(f"{a} {b}", 0.7) for a, b in zip(words, words[1:], strict=False)] + [(w[i : i + 4], 0.35) for w in words for i in range(len(w) - 3)]
        for f, weight in features:
            v[fnv(f) % vectors.EMBED_DIM] += weight if fnv(f, hashing.SIGN_SEED) % 2 == 0 else -weight
        if words:
            slow[r["id"]] = v / np.linalg.norm(v)
    fast = {r["id"]: r["vector"] for r in search.embeddings(rows.unionByName(rows.limit(0)), "id", "text").collect()}
    assert slow.keys() == fast.keys() and all(len(v) == vectors.EMBED_DIM for v in fast.values())
    assert all(abs(a - b) < 1e-12 for i in slow for a, b in zip(slow[i], fast[i], strict=True))


def test_chunks(spark):
    body = "# First\nsource: Red Book\nintro line\n## Cuts\n" + "Press on it. " * 200 + "\n## Empty\n## Burns\nCool it.\nKeep it cool.\n# Last"
    rows = ingest.passages(spark.createDataFrame([("a.md", body)], ["filename", "text"])).orderBy("seq").collect()
    assert {r["title"] for r in rows} == {"Last"} and {r["source"] for r in rows} == {"Red Book"}
    assert [r["section"] for r in rows] == ["", *["Cuts"] * (len(rows) - 2), "Burns"]
    assert max(len(r["text"]) for r in rows) <= ingest.PASSAGE_CHARS
    assert "".join(r["text"] for r in rows if r["section"] == "Cuts").replace("\n", " ").count("Press on it.") == 200
    assert rows[-1]["text"] == "Cool it.\nKeep it cool."
    assert len({r["doc_id"] for r in rows}) == len(rows)
    again = ingest.passages(spark.createDataFrame([("b.md", body)], ["filename", "text"])).first()
    assert again["doc_key"] == rows[0]["doc_key"]


def test_passages_of_one_id_stay_apart(spark):
    columns = "doc_id long, doc_key long, seq int, title string, source string, section string, text string"
    rows = [(7, 1, 0, "a", "a", "", "x" * 400), (7, 2, 0, "b", "b", "", "y"), (7, 3, 4, "c", "c", "", "z" * 500), (9, 4, 0, "d", "d", "", "w" * 600), (9, 4, 0, "d", "e", "", "w" * 600)]
    _, meta, bodies = ingest.tables(spark.createDataFrame(rows, columns), F.length("text") > 300)
    shown = sorted((r["doc_id"], r["text"][0], len(r["text"]), r["held"]) for r in ingest.shown_text(meta, bodies).collect())
    assert shown == [(7, "x", 400, True), (7, "y", 1, False), (7, "z", 500, True), (9, "w", 600, True), (9, "w", 600, True)]
    assert sorted(map(tuple, ingest.document_counts(meta, bodies).collect())) == [(1, 1, 1), (2, 1, 0), (3, 1, 1), (4, 2, 2)]


def test_stops_of_a_long_line(spark):
    n = 20_000
    line = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.struct((3.0 * i).alias("x"), (4.0 * i).alias("y"))).alias("p"))
    began = time.perf_counter()
    r = line.select(graph.stops(F.col("p")).alias("s"), graph.cut_polyline(F.col("p"), F.lit(0.25))["x"].alias("x")).first()
    assert time.perf_counter() - began < 20  # one pass; a pass for each point takes minutes
    assert len(r["s"]) == n + 1 and r["s"][0] == 0 and r["s"][-1] == 1 and abs(r["s"][n // 2] - 0.5) < 1e-12 and abs(r["x"] - 0.75 * n) < 1e-6
    few = spark.createDataFrame([([],), (None,), ([(1.0, 1.0)],), ([(1.0, 1.0), (1.0, 1.0)],)], "p array<struct<x:double,y:double>>")
    assert [x["s"] for x in few.select(graph.stops(F.col("p")).alias("s")).collect()] == [[], None, [0.0], [0.0, 0.0]]


def nodes(spark, n, reliability=0.95):
    return spark.createDataFrame([(1000 + 7919 * i, reliability, 1 << 30) for i in range(n)], "node_id long, reliability double, free_bytes long")


def test_placement_moves_little(spark):
    docs = spark.range(1, 1501).select(F.col("id").alias("doc_id"))
    first = {r["doc_id"]: r["node_id"] for r in placement.rank_nodes(docs, nodes(spark, 10), 1).collect()}
    fewer = {r["doc_id"]: r["node_id"] for r in placement.rank_nodes(docs, nodes(spark, 9), 1).collect()}
    gone = 1000 + 7919 * 9
    assert all(first[d] == fewer[d] for d in first if first[d] != gone)
    counts = [list(first.values()).count(1000 + 7919 * i) for i in range(10)]
    assert min(counts) > 100 and max(counts) < 210


def test_first_of_equal_arrivals_is_told_by_place(spark):
    known = spark.createDataFrame([(0, "k")], "key long, who string")
    told = spark.createDataFrame([(1, f"n{i}", 5, i) for i in reversed(range(40))] + [(1, "late", 6, -1), (1, "never", None, -2), (0, "x", 1, 0)], "key long, who string, at long, place long").repartition(4)
    got = state.inserted_or_ignored(known, told, "key", "at", "place").collect()
    assert sorted(map(tuple, got)) == [(0, "k"), (1, "n0")]


def test_best_nodes_through_ranges():
    rng = np.random.default_rng(3)
    dense, sparse = np.arange(70_000, dtype=np.int64) + 60_000, np.unique(rng.integers(-(2**33), 2**40, 900))
    for every in (dense, sparse, np.unique(np.concatenate([dense[:3000], sparse, np.arange(600) + 2**33]))):
        weights = np.where(rng.random(len(every)) < 0.3, 0.25, rng.random(len(every)) + 1e-6)
        ids = np.concatenate([np.arange(150) + 65_500, rng.integers(0, 2**40, 50), np.arange(-50, 0)])
        got, want = placement.NodeRanges(every, weights).best(ids, 5), placement.best_nodes(ids, every, weights, 5)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_ranking_scores_few_nodes(monkeypatch):
    scored = []
    whole = placement._mixed
    monkeypatch.setattr(placement, "_mixed", lambda a, b: scored.append(len(a) * len(b)) or whole(a, b))
    ranges = placement.NodeRanges(np.arange(50_000, dtype=np.int64), np.full(50_000, 0.5))
    ranges.best(np.arange(40_000, dtype=np.int64), 5)
    assert sum(scored) < 1 << 18  # hashes of ranges, not of 2 * 10^9 pairs


def test_targets_and_plans(spark):
    t = lambda *a: one(spark, placement.replica_target, *a)
    assert t(0, 10, 0.95) == 2 and t(32, 10, 0.95) == 4 and t(10**6, 10, 0.2) == 5 and t(5, 1, 0.9) == 1 and t(5, 0, 0.0) == 0
    rows = [(2, 0, 1, True, True), (2, 0, 2, False, False), (2, 3, 3, True, True), (2, 3, 3, True, False), (2, 0, 2, True, False), (2, 5, 2, False, False), (2, 0, 3, True, True)]
    df = spark.createDataFrame(rows, "desired int, rank int, live long, have boolean, pressure boolean")
    action, _ = placement.plan(*map(F.col, df.columns))
    assert [r["a"] for r in df.select(action.alias("a")).collect()] == ["hold", "pull", "evict", "evict", "hold", "none", "evict"]
    assert one(spark, placement.reliability, 0, 0, 0, 0) == 0.5


def test_pulls_stop_where_the_budget_ends(spark):
    rows = [(1, 10, 1, 5, 100), (1, 11, 1, 9, 400), (1, 12, 2, 1, 10), (2, 10, 1, 1, 10)]
    got = placement.pull_plan(spark.createDataFrame(rows, "self_id long, doc_id long, live long, hits long, bytes long"), 1000, most=3)
    assert sorted((r["self_id"], r["doc_id"]) for r in got.collect()) == [(2, 10)]


def test_state(spark):
    log = spark.createDataFrame([(1, "a", 3), (1, "a", 5), (1, "b", 2), (2, "a", 1)], "k long, n string, hits long")
    got = {r["k"]: r["hits"] for r in state.counter_values(state.counter_shares(log, "k", "n"), "k").collect()}
    assert got == {1: 7, 2: 1}
    again = {r["k"]: r["hits"] for r in state.counter_values(state.counter_shares(log.union(log), "k", "n"), "k").collect()}
    assert again == got
    rows = spark.createDataFrame([(1, 2, 10, "old"), (1, 2, 11, "late"), (1, 1, 12, "less"), (2, 5, 1, "x")], "k long, v long, arrival long, s string")
    assert {r["k"]: r["s"] for r in state.newest(rows, "k", "v", "arrival").collect()} == {1: "old", 2: "x"}
    meta = spark.createDataFrame([(1, 10), (2, 10), (3, 11)], "doc_id long, doc_key long")
    left, parents, bodies = state.cascade_delete(meta.where("doc_id = 3"), "doc_id", meta, meta.select("doc_key").distinct(), "doc_key", meta.select("doc_id"))
    assert left.count() == 2 and [r["doc_key"] for r in parents.collect()] == [10] and bodies.count() == 2


def test_floods(spark):
    line = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (7, 8)], "a long, b long")
    got = {r["node"]: r["hops"] for r in graph.flood(line, spark.createDataFrame([(1,)], "node long"), 3).collect()}
    assert got == {1: 0, 2: 1, 3: 2, 4: 3}
    ring = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 1)], "a long, b long")
    assert {r["node"]: r["hops"] for r in graph.flood(ring, spark.createDataFrame([(1,)], "node long"), 16).collect()} == {1: 0, 2: 1, 3: 2, 4: 1}


def test_frames_and_packets(spark):
    data = bytes(range(256)) * 9
    rows = spark.createDataFrame([(bytearray(data),)], "b binary").select(F.explode(codec.frames(F.col("b"), F.lit(7), 185)).alias("f")).select(codec.frame_fields(F.col("f.data")).alias("g"), F.octet_length("f.data").alias("n"))
    assert rows.agg(F.max("n")).first()[0] == 185
    twice = rows.union(rows.orderBy(F.col("g.idx").desc()))
    assert bytes(twice.agg(codec.reassembled(F.col("g.idx"), F.col("g.cnt"), F.col("g.body"))).first()[0]) == data
    assert twice.where("g.idx <> 2").agg(codec.reassembled(F.col("g.idx"), F.col("g.cnt"), F.col("g.body"))).first()[0] is None
    assert one(spark, codec.decode_packet, bytearray(b"\x02" * 20)) is None and one(spark, codec.decode_packet, bytearray(b"\x03")) is None
    assert bytes(one(spark, lambda s: codec.capped_utf8(s, 4), "aaé€")) == b"\x00\x04aa\xc3\xa9"
    assert bytes(one(spark, lambda s: codec.capped_utf8(s, 5), "aaé€")) == b"\x00\x05aa\xc3\xa9\xe2"  # cut inside a character


def test_identity(spark):
    a, b = bytearray(b"\x01" * 32), bytearray(b"\x02" * 32)
    assert one(spark, identity.safety_number, a, b) == one(spark, identity.safety_number, b, a)
    rows = [(a, b, 5, 5, True), (bytearray(), bytearray(), 5, 5, None), (a, bytearray(), 5, 5, True), (a, b, 6, 5, True), (a, b, 5, 5, False)]
    df = spark.createDataFrame(rows, "k binary, s binary, i long, a long, ok boolean")
    assert [r["v"] for r in df.select(identity.authorship(*map(F.col, df.columns)).alias("v")).collect()] == ["verified", "unsigned", "forged", "forged", "forged"]


def test_collection_window(spark):
    replies = spark.createDataFrame([(1, 1, 100, 0), (1, 2, 200, 0), (1, 2, 700, 0), (2, 1, 5900, 0), (2, 1, 6100, 0)], "query_id long, node long, at long, started long")
    got = sorted((r["query_id"], r["at"]) for r in search.in_window(replies, spark.createDataFrame([(1,), (2,)], "node long")).collect())
    assert got == [(1, 100), (1, 200), (2, 5900)]


def test_entities_are_decoded_once(spark):
    cases = {
        "&#38;amp;": "&amp;", "&amp;lt;": "&lt;", "&amp;#38;": "&#38;", "&LT;b&gt;": "<b>", "&#x41;&#66;": "AB", "&#0;&#xD800;&#1114112;&nope;&": "&#0;&#xD800;&#1114112;&nope;&",
        "&#99999999999999999999;": "&#99999999999999999999;", "a && b &": "a && b &", "&#x1F600;": "\U0001f600", "": "", "&amp": "&amp",
    }
    df = spark.createDataFrame(list(cases.items()), "t string, want string").withColumn("got", text.decode_entities(F.col("t")))
    for r in df.collect():
        assert r["got"] == r["want"], r["t"]


def test_nodes_are_ranked_by_exact_scores(spark):
    """Nodes of little room have scores below the sixth place; both ways of ranking agree with a plain model."""
    rows = [(i, 0.5 + i % 5 / 10, 1 + 3 * i) for i in range(1, 60)]
    few = spark.createDataFrame(rows, "node_id long, reliability double, free_bytes long")
    docs = spark.range(1, 40).select(F.col("id").alias("doc_id"))
    key = lambda r: (r["doc_id"], r["rank"])
    by_arrays = [(r["doc_id"], r["node_id"]) for r in sorted(placement.rank_nodes(docs, few, 3).collect(), key=key)]
    by_window = [(r["doc_id"], r["node_id"]) for r in sorted(placement.rank_nodes(docs, few).where("rank < 3").collect(), key=key)]
    want = []
    for d in range(1, 40):
        score = lambda n: min(1, n[1]) * min(1, n[2] / placement.HEADROOM) / -math.log((mix(d, n[0]) + 0.5) / 2**32)  # noqa: B023, E731
        want += [(d, n[0]) for n in sorted(rows, key=lambda n: (-score(n), n[0]))[:3]]
    assert by_arrays == by_window == want


def test_best_nodes_with_ties():
    import numpy as np

    ids, nodes_, weights = np.arange(1, 30), np.arange(1, 200), np.full(199, 0.5)
    some, scores = placement.best_nodes(ids, nodes_, weights, 4)  # by a partition
    whole, _ = placement.best_nodes(ids, nodes_, weights, 199)
    assert (some == whole[:, :4]).all() and (np.diff(scores, axis=1) <= 0).all()


def test_vector_top_k_in_parts(spark, monkeypatch):
    """Queries that don't fit are asked part by part; equal vectors are ties, broken by id."""
    r = random.Random(1)
    rows = [(i, [r.choice([-1.0, 0.0, 1.0]) for _ in range(3)]) for i in range(300)] + [(300, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 50 = 0 and vec_id < 300").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    want = []
    for q in range(0, 300, 50):
        best = sorted((-sum(a * b for a, b in zip(v, rows[q][1], strict=True)), i) for i, v in rows[:300])[:7]
        want += [(q, n + 1, i) for n, (_, i) in enumerate(best)]
    for room in (1 << 20, 48):
        monkeypatch.setattr(search, "MOST_QUERY_BYTES", room)
        assert sorted((x["query_id"], x["rank"], x["vec_id"]) for x in search.vector_top_k(df, asked, 7).collect()) == want


def test_floats_and_segments(spark):
    import struct

    for x in (0.0, 1.0, -2.5, 0.1, 3.4e38, 1.2e-38, -7.25e-5, 65504.0, 2.0**-30):
        raw = bytes(one(spark, codec.float32, x))
        assert raw == struct.pack(">f", x)
        assert one(spark, lambda b: codec.from_float32(b, 0), bytearray(raw)) == struct.unpack(">f", raw)[0]
    data = bytes(range(256)) * 150
    parts = [bytes(p["data"]) for p in one(spark, lambda b: codec.segments(b, 23), bytearray(data))]
    assert len(parts) == -(-len(data) // 19) and parts[-1][0] & 1 and all(len(p) <= 20 for p in parts)
    join = lambda ps: spark.createDataFrame([([bytearray(p) for p in ps],)], "d array<binary>").select(codec.rejoined(F.col("d")).alias("x")).first()["x"]
    assert bytes(join(parts)) == data
    parts = parts[:99] + parts[-1:]
    assert join(parts[:5] + parts[6:99]) is None and join(parts[:99]) is None
    short = [bytes(p["data"]) for p in one(spark, lambda b: codec.segments(b, 23), bytearray(b"x" * 50))]
    assert bytes(join(short[:2] + short)) == b"x" * 50  # a first segment starts afresh


def test_shared_folder_must_be_named_off_one_machine(spark):
    import pytest

    from driftglass import session

    class Elsewhere:
        class conf:
            @staticmethod
            def get(name, default=None):
                return {"spark.master": "yarn"}.get(name, default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Elsewhere)
    kept = session.staged(spark.range(3), "kept")
    assert kept.count() == 3
    session.released(kept)
    assert not os.path.exists(kept._folder.removeprefix("file://"))


def test_policy_of_metadata(spark):
    """What is admitted and what may be forgotten are each other's rest."""
    meta = spark.createDataFrame([(i, i % 4) for i in range(60)], "doc_id long, origin_id long")
    keeps = placement.keeps_meta(meta, nodes(spark, 12), 1000)
    held = meta.where("doc_id % 7 = 0").select("doc_id")
    stay = {r["doc_id"] for r in placement.admitted(meta, keeps, held, 2).collect()}
    gone = {r["doc_id"] for r in placement.meta_evictions(meta, keeps, held, 2).collect()}
    assert stay | gone == set(range(60)) and not stay & gone
    assert {i for i in range(60) if i % 7 == 0 or i % 4 == 2} <= stay
    assert {r["keeps"] for r in placement.keeps_meta(meta, nodes(spark, 4), 1000).collect()} == {True}  # four nodes carry all


def test_hashes_of_many_texts():
    r = random.Random(3)
    texts = ["", *("".join(chr(r.choice([r.randint(32, 126), r.randint(160, 0xD7FF), r.randint(0x10000, 0x10FFFF)])) for _ in range(r.choice([1, 4, 9, 400]))) for _ in range(300)), "x" * 3000, "😀" * 5000]
    for some in (texts, texts[:5], texts[-3:], []):
        for seed in (hashing.FNV_SEED, hashing.SIGN_SEED):
            assert hashing.fnv1a_of(some, seed).tolist() == [fnv(t, seed) for t in some]


def test_passages_have_the_ids_of_their_texts(spark):
    body = "# Tïtle 😀\nintro line\n## One\n" + "A sentence here. " * 150 + "\n" + "x" * 2600 + "\n\n## Two\nlast 🚀"
    docs = spark.createDataFrame([("a.md", body), ("b.md", "# only a title"), ("c.md", ""), ("d.md", None), ("e.md", "plain")], "filename string, text string").withColumn("seq", F.lit("clash"))
    rows = ingest.passages(docs).collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r["source"], r["seq"])):
        by.setdefault(r["source"], []).append(r)
    assert by.keys() == {"a.md", "e.md"} and [r["seq"] for r in by["a.md"]] == list(range(len(by["a.md"])))
    for own in by.values():
        key = fnv("\n".join([own[0]["title"], *(r["text"] for r in own)]))
        assert all(r["doc_key"] == key and r["doc_id"] == fnv(f"{key}:{r['seq']}:{r['text']}") and len(r["text"]) <= ingest.PASSAGE_CHARS for r in own)
    assert [r["section"] for r in by["a.md"]][0] == "" and by["a.md"][-1]["section"] == "Two"


def test_passages_are_packed():
    assert ingest.packed(["ab", "cd", "efg"], 5) == ["ab\ncd", "efg"]
    assert ingest.packed(["One. Two! Three four five six?"], 10) == ["One.\nTwo!", "Three four", " five six?"]
    assert ingest.packed([], 5) == [] and ingest.packed(["abcdefgh"], 3) == ["abc", "def", "gh"]


def test_catalog_pages_by_chunks(spark):
    r = random.Random(4)
    rows = [(r.choice(["a", "b", None]), i, r.choice([0, 0, 3, 50]), r.choice([None, "x"])) for i in range(300)]
    docs = spark.createDataFrame(rows, "source string, doc_id long, n long, _sum string")
    told = lambda **k: sorted(((x["source"], x["doc_id"], x["sent_before"]) for x in state.catalog_page(docs, [F.col("doc_id")], "n", 700, ["source"], **k).collect()), key=str)
    whole = told()
    assert 30 < len(whole) < 300
    for size in (1, 7, 1000):
        assert told(chunk=F.floor(F.col("doc_id") / size)) == whole
    since = F.col("doc_id") > 60
    assert told(since=since, chunk=F.floor(F.col("doc_id") / 20)) == told(since=since)
