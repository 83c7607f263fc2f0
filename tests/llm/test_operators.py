"""Brute force, round trips and edge cases for the operators of driftglass.llm. Small tables, so each runs in seconds."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from driftglass.llm import chat, components, embedding_dedup, licenses, line_dedup, media, minhash, mixing, oracles, packing, quality, queries, toxicity
from driftglass.llm.common import held_out

DATA = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in ("ka", "lo", "mi", "ru", "te", "so") for b in ("ban", "dir", "fol", "gem", "hus", "nap", "pit", "ver")]


def text(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 99)) for _ in range(n))


def frame(spark, rows, extra=False):
    """Rows (doc_id, text, source); with extra, columns whose names the operators use themselves."""
    df = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOC)
    if extra:
        for c in ("key", "size", "keys", "component", "shard", "taken", "x", "marks", "words", "n", "row"):
            df = df.withColumn(c, F.lit("clash"))
    return df


EDGES = [
    (1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, text(3, 1), "b"), (5, text(200, 2), "b"), (6, text(200, 2), None), (7, "same line over twenty chars\nx", "c"),
    (8, "SAME line over twenty chars \ny", "c"), (9, "same LINE over twenty chars\nsame line over twenty chars", "c"), (10, text(30_000, 3), "a"), (4, text(3, 1), "b"), (None, text(50, 4), "b"),
]


@pytest.mark.parametrize("name,columns", [("line_dedup.ORACLE", None), ("minhash.ORACLE", None), ("embedding_dedup.ORACLE", None)])
def test_sql(spark, name, columns):
    module = {"line_dedup": (line_dedup, line_dedup.op1), "minhash": (minhash, minhash.op4), "embedding_dedup": (embedding_dedup, embedding_dedup.op3)}[name.split(".")[0]]
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = module[1](spark, DATA).collect()
    said = con.execute(module[0].ORACLE)
    names = [c[0] for c in said.description]
    assert sorted(tuple(r[n] for n in names) for r in got) == sorted(said.fetchall())


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_plain_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    said = con.execute(oracles.ORACLES[name])
    names = [c[0] for c in said.description]
    got = [tuple(r[n] for n in names) for r in queries.QUERIES[name](spark, DATA).collect()]
    assert sorted(got, key=str) == sorted(said.fetchall(), key=str)


@pytest.mark.parametrize("extra", [False, True])
def test_line_dedup_edges(spark, extra):
    docs = frame(spark, EDGES, extra)
    out = line_dedup.dedup_lines(docs)
    rows = {r["doc_id"]: r for r in out.collect()}
    assert set(docs.columns) <= set(out.columns) and out.count() == len(EDGES)
    assert (rows[7]["n_lines"], rows[7]["n_dropped"], rows[7]["text"]) == (2, 1, "x")
    assert rows[8]["text"] == "y" and rows[9]["n_dropped"] == 0 and rows[1]["text"] is None and rows[1]["n_lines"] == 1
    assert rows[2]["kept_sha256"] == hashlib.sha256(b"").hexdigest() and rows[None]["n_dropped"] == 0
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_line_dedup_is_reversible(spark):
    docs = frame(spark, [(i, f"shared line number {i % 3} of all\nown line of document {i}", "a") for i in range(12)])
    state = lambda x: sorted((bytes(r["key"]), r["n_docs"], r["keeper"]) for r in x.counts.collect())
    base = line_dedup.Index.empty(spark, 4).insert(docs.where("doc_id < 8"))
    more = base.insert(docs.where("doc_id >= 6"))
    assert state(more) == state(line_dedup.Index.empty(spark, 4).insert(docs))
    back = more.delete(docs.where("doc_id >= 8").select("doc_id"))
    assert state(back) == state(base)
    held = {r["shard"]: line_dedup.CuckooFilter.from_bytes(bytes(r["payload"])) for r in back.filters.collect()}
    assert all(bytes(r["key"]) in held[r["shard"]] for r in back.counts.collect())
    gone = more.counts.join(back.counts, "key", "left_anti").collect()
    assert gone and sum(bytes(r["key"]) in held[r["shard"]] for r in gone) < len(gone)


def test_line_dedup_keys_of_one_fingerprint(spark):
    met = {}
    for i in range(5000):
        line = f"line number {i} of all documents"
        place, mark = line_dedup.CuckooFilter._print(line_dedup.line_key(line.encode()))
        first, second = met.setdefault((place & 3, mark), line), line  # a filter of one key has four buckets
        if first != second:
            break
    docs = frame(spark, [(1, first, "a"), (2, second, "a"), (3, first, "a")])
    state = lambda x: sorted((bytes(r["key"]), r["n_docs"], r["keeper"]) for r in x.counts.collect())
    make = lambda x: line_dedup.Index.empty(spark, 1).insert(docs.where(x))
    back = make("doc_id = 1").insert(docs.where("doc_id = 2")).delete(docs.where("doc_id = 2").select("doc_id"))
    held = line_dedup.CuckooFilter.from_bytes(bytes(back.filters.first()["payload"]))
    assert first != second and all(bytes(r["key"]) in held for r in back.counts.collect())
    assert state(back.insert(docs.where("doc_id = 3"))) == state(make("doc_id in (1, 3)"))


def test_cuckoo_filter():
    keys = [hashlib.blake2b(str(i).encode(), digest_size=16).digest() for i in range(20_000)]
    f = line_dedup.CuckooFilter(1000)  # opens further tables
    for k in keys[:10_000]:
        f.add(k)
    f = line_dedup.CuckooFilter.from_bytes(f.to_bytes())
    assert all(k in f for k in keys[:10_000]) and sum(k in f for k in keys[10_000:]) < 100
    for k in keys[:5_000]:
        assert f.remove(k)
    assert all(k in f for k in keys[5_000:10_000]) and sum(k in f for k in keys[:5_000]) < 100


def jaccard_groups(rows):
    sets = {i: set(minhash.shingles((t or "").encode()).tolist()) for i, t, _ in rows if i is not None}
    top = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both) and top[b] < top[a]:
                    top[a], changed = top[b], True
    return top


def test_minhash_against_brute_force(spark):
    r = random.Random(7)
    rows = list(EDGES)
    for g in range(6):
        base = text(150, 100 + g).split()
        for k in range(25):
            words = list(base)
            for _ in range(r.randint(0, 6)):
                words[r.randrange(len(words))] = f"edit{r.random()}"
            rows.append((100 + 30 * g + k, " ".join(words), "s"))
    got = {r["doc_id"]: r for r in minhash.near_duplicates(frame(spark, rows, True)).collect()}
    want = jaccard_groups(rows)
    assert {i: got[i]["component_id"] for i in want} == want
    assert got[None]["kept"] and got[None]["component_id"] is None and got[1]["n_shingles"] == 0 and got[4]["n_shingles"] == 1
    assert minhash.near_duplicates(frame(spark, rows).limit(0)).count() == 0
    left = minhash.deduplicated(frame(spark, rows))
    assert sorted(r["doc_id"] for r in left.where("doc_id is not null").collect()) == sorted(i for i, c in want.items() if i == c)


def test_minhash_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BUCKET_BLOCK", 4)
    monkeypatch.setattr(minhash, "CLUSTER_BLOCK", 5)
    base = text(120, 9).split()
    rows = [(i, " ".join([*base[:i], f"e{i}", *base[i + 1 :]]), "s") for i in range(30)]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == jaccard_groups(rows)


def test_circulant_signature_estimates_jaccard():
    a = minhash.shingles(text(400, 1).encode())
    b = np.unique(np.concatenate([a[:300], minhash.shingles(text(150, 2).encode())]))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    same = (minhash.signature(a, 1024) == minhash.signature(b, 1024)).mean()
    assert abs(same - true) < 0.06


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)]
    got = {x["node"]: x["component"] for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    top = {n: n for e in edges for n in e}
    for _ in range(100):
        for a, b in edges:
            top[a] = top[b] = min(top[a], top[b])
    assert got == {n: t for n, t in top.items() if n in got} and all(a == b or a in got for a, b in edges)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_embeddings_edges_and_recall(spark, monkeypatch):
    r = np.random.default_rng(5)
    rows, n = [], 0
    for g in range(60):
        base = r.normal(size=16)
        for _ in range(1 + g % 9):
            rows.append((n, (base + r.normal(size=16) * 0.04).tolist(), g % 2))
            n += 1
    rows += [(n, rows[0][1], 0), (n + 1, rows[0][1], 0), (n + 2, rows[0][1], 1), (n + 3, rows[0][1], None), (n + 4, None, 0), (n + 5, [0.0] * 16, 0), (n + 6, [1.0, None], 0), (n + 7, [float("nan")] * 16, 0), (n + 8, [], 0), (n + 9, [1.0, 2.0], 0)]
    rows += [(None, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("key", F.lit(1)).withColumn("n", F.lit(1))
    monkeypatch.setattr(embedding_dedup, "BLOCK", 20)
    monkeypatch.setattr(embedding_dedup, "SHARD", 15)
    monkeypatch.setattr(embedding_dedup, "DEEP", 40)
    out, share = embedding_dedup.near_vectors(df, audited=5)
    got = {x["vec_id"]: x for x in out.collect()}
    good = [(i, np.array(v, np.float32).astype(float), lab) for i, v, lab in rows if i is not None and lab is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = {i: [j for j, w, m in good if j != i and m == lab and len(w) == len(v) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.98] for i, v, lab in good}
    assert {i: got[i]["n_links"] for i in links} == {i: len(x) for i, x in links.items()}
    for i, x in links.items():
        assert all(got[j]["component_id"] == got[i]["component_id"] for j in x)
    assert all(got[n + k]["n_links"] == 0 and got[n + k]["component_id"] == n + k for k in (3, 4, 5, 6, 7, 8))
    assert got[None]["component_id"] is None and got[None]["kept"]
    assert share == 1.0
    assert embedding_dedup.near_vectors(df.limit(0))[0].count() == 0


def vector_links(spark, v):
    """(n_links by near_vectors, by brute force, number of components) for vectors of one label."""
    df = spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
    got = sorted(map(tuple, embedding_dedup.near_vectors(df)[0].select("vec_id", "n_links", "component_id").collect()))
    w = v / np.sqrt((v * v).sum(1, keepdims=True))
    want = np.concatenate([(w[i : i + 1000] @ w.T >= 0.98).sum(1) - 1 for i in range(0, len(w), 1000)])
    return [n for _, n, _ in got], want.tolist(), len({c for _, _, c in got})


def test_embeddings_large_tight_group(spark):
    r = np.random.default_rng(6)
    near = r.normal(size=64) + r.normal(size=(10_000, 64)) * 0.1
    got, want, groups = vector_links(spark, np.concatenate([near, r.normal(size=(500, 64))]))
    assert got == want and min(want[:10_000]) > 5000 and groups == 501


def test_linked_vectors_meet_at_one_home():
    r = np.random.default_rng(8)
    v = embedding_dedup.unit((r.normal(size=(40, 16)).repeat(60, 0) + r.normal(size=(2400, 16)) * 0.15).tolist())
    c = embedding_dedup.unit(r.normal(size=(12, 16)).tolist())
    at = embedding_dedup.shards_of(v, c)
    for a, b in np.argwhere(v @ v.T >= 0.98).tolist():
        assert min(at[a][0], at[b][0]) in at[a] and min(at[a][0], at[b][0]) in at[b]


def test_embeddings_tight_groups_apart_from_the_medoid(spark):
    r = np.random.default_rng(7)
    a, away, b = np.linalg.qr(r.normal(size=(32, 3)))[0].T
    tight = lambda x, n: x + r.normal(size=(n, 32)) * 0.0015
    across = np.cos(0.17) * a + np.sin(0.17) * away  # cosine 0.986
    got, want, groups = vector_links(spark, np.concatenate([tight(a, 80), tight(across, 80), tight(b, 200)]))
    assert got == want and set(want[:160]) == {159} and groups == 2


@pytest.mark.parametrize("dim,spread", [(3, 0.3), (8, 0.05), (16, 0.05)])
def test_vector_search_is_complete(dim, spread):
    r = np.random.default_rng(9)
    v = embedding_dedup.unit((r.normal(size=(30, dim)).repeat(20, 0) + r.normal(size=(600, dim)) * spread).tolist())
    true = (v @ v.T >= 0.98) & ~np.eye(600, dtype=bool)
    assert (embedding_dedup.linked(v, None) == true).all()
    lists = embedding_dedup.graph(v)
    assert lists is None or (embedding_dedup.linked(v, lists) == true).all()


def test_united_lists_are_searched(spark):
    """Two overlapping shards: each is searched over what both know, and nothing that is in either is missed."""
    r = np.random.default_rng(10)
    v = embedding_dedup.unit((r.normal(size=(60, 16)).repeat(10, 0) + r.normal(size=(600, 16)) * 0.05).tolist())
    v = v[r.permutation(600)]
    shards = [np.arange(0, 400), np.arange(200, 600)]
    own = [(int(ids[i]), [int(ids[x]) for x in near]) for ids in shards for i, near in enumerate(embedding_dedup.graph(v[ids]))]
    rows = spark.createDataFrame([*own, (7, None)], "rep long, near array<long>")
    near = {x["rep"]: x["near"] for x in embedding_dedup.united(rows).collect()}
    want = {}
    for rep, some in own:
        want.setdefault(rep, set()).update(some)
    assert {rep: set(some) for rep, some in near.items()} == {rep: some for rep, some in want.items() if some}
    both = set(range(200, 400))
    assert any(set(near[x]) - both for x in both if x in near)  # lists reach beyond the overlap
    for ids in shards:
        lists = embedding_dedup.local(ids, near)
        assert (embedding_dedup.linked(v[ids], lists) == (v[ids] @ v[ids].T >= 0.98) & ~np.eye(len(ids), dtype=bool)).all()


@pytest.mark.parametrize("extra", [False, True])
def test_packing(spark, extra):
    rows = EDGES + [(100 + i, text(5 + i * 7 % 300, i), f"s{i % 3}") for i in range(120)] + [(300 + i, text(60, 77), "s1") for i in range(15)]
    docs = frame(spark, rows, extra)
    got = packing.pack(docs, capacity=500, same=2, shard_rows=60).collect()
    words = sum(len((t or "").split()) for _, t, _ in rows)
    assert sum(r["n_words"] for r in got) == words
    bins = {}
    for r in got:
        bins.setdefault(r["bin_id"], []).append(r)
    source, content = {i: s for i, _, s in rows}, {i: " ".join((t or "").lower().split()) for i, t, _ in rows}
    for rs in bins.values():
        spans = sorted((r["bin_offset"], r["n_words"]) for r in rs)
        assert sum(n for _, n in spans) <= 500 and all(a + n <= b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))
        own = [content[r["doc_id"]] for r in rs if r["doc_id"] not in (1, 2, 3)]
        assert len(own) == len(set(own))
        assert max([sum(source[r["doc_id"]] == s for r in rs) for s in {source[r["doc_id"]] for r in rs}]) <= 2
    assert packing.pack(docs.limit(0)).count() == 0


def test_packing_takes_the_tightest_bin():
    got = packing.pack_shard([(0, 70, "a", None), (1, 60, "b", None), (2, 30, "c", None), (3, 28, "d", "z"), (4, 10, "e", "z")], 100, 1)
    at = {row: b for row, _, _, _, b, _ in got}
    assert at[2] == at[0] and at[3] == at[1] and at[4] not in (at[3], at[0])


def test_quality_learns(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.rated(docs.select("doc_id", F.col("text")), labels).withColumnRenamed("quality", "score").join(labels, "doc_id").where(held_out(F.col("doc_id")))
    assert got.select(F.avg(((F.col("score") >= 0.3).cast("int") == F.col("quality")).cast("double"))).first()[0] > 0.95


def test_quality_and_toxicity_edges(spark):
    docs = frame(spark, EDGES, True)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["quality"] for r in quality.rated(docs, none).collect()] == [0.5] * len(EDGES)
    assert quality.rated(docs.limit(0), none).count() == 0
    out = toxicity.score(docs, toxicity.train(docs, none))
    assert set(docs.columns) < set(out.columns) and all(r["toxicity"] < 0.01 for r in out.collect())
    assert (np.diff(quality.isotonic(np.array([0.0, 5, 1, 9]), np.array([5.0, 9, 9, 9]))) >= 0).all()


def test_partition_sums_give_the_ridge_solution(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{DATA}/labels.parquet")
    rows = quality.measured(docs)
    model = quality.train(rows.repartition(5), labels)
    got = {r["doc_id"]: r["x"] for r in rows.collect()}
    known = {r["doc_id"]: r["quality"] for r in labels.where("quality is not null").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 in (1, 2, 3)}
    f = model.features(np.array([got[i] for i in known]))
    want = np.linalg.solve(f.T @ f + np.diag([quality.RIDGE] * quality.FEATURES + [1e-6]), f.T @ np.array(list(known.values()), float))
    assert np.allclose(f @ model.weights, f @ want, atol=1e-6)


def test_string_kernel():
    def naive(s, t):
        from itertools import combinations

        def weights(x):
            out = {}
            for i in combinations(range(len(x)), toxicity.LETTERS):
                key = "".join(x[j] for j in i)
                out[key] = out.get(key, 0) + toxicity.DECAY ** (i[-1] - i[0] + 1)
            return out

        a, b = weights(s), weights(t)
        dot = sum(w * b.get(k, 0) for k, w in a.items())
        size = (sum(w * w for w in a.values()) * sum(w * w for w in b.values())) ** 0.5
        return (dot / size) ** 2 if size else 0.0

    words = ["idiot", "id1iot", "i-d-i-o-t", "moron", "ababab", "xx", "", "dio", "straßeö"]
    marks = ["idiot", "moronic", "abab", "straße"]
    got = toxicity.kernel(words, marks)
    assert np.allclose(got, [[naive(w, m) for m in marks] for w in words], atol=1e-5)
    assert got[1, 0] > 0.3 > got[3, 0]
    assert toxicity.tokens("You s t u p i d i.d.i.o.t!") == {"you", "s", "t", "u", "p", "i", "d", "stupid", "idiot"}


def test_toxicity_learns_inserted_letters(spark):
    r = random.Random(4)
    rows, marks = [], []
    for i in range(400):
        words = text(40, 1000 + i).split()
        bad = i % 4 == 0
        if bad:
            word = r.choice(["blockhead", "nitwitted", "scoundrel"])
            at = r.randrange(1, len(word))
            words[r.randrange(40)] = word[:at] + r.choice(["", "x", "-", "*"]) + word[at:]
        rows.append((i, " ".join(words), "a"))
        marks.append((i, int(bad)))
    docs, labels = frame(spark, rows), spark.createDataFrame(marks, "doc_id long, toxic int")
    out = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id").where(held_out(F.col("doc_id"))).collect()
    assert sum((r["toxicity"] >= 0.5) == bool(r["toxic"]) for r in out) >= 0.95 * len(out)


@pytest.mark.parametrize("extra", [False, True])
def test_media(spark, extra, tmp_path):
    docs = frame(spark, EDGES, extra)
    got = media.media_columns(docs).collect()
    want = {}
    for i, t, _ in EDGES:
        raw = (t or "").encode()
        want.setdefault(i, []).append((len(raw), hashlib.sha256(media.padded(raw)).hexdigest(), zlib.crc32(media.padded(raw)[-16:])))
    assert len(got) == len(EDGES) and all((r["n_bytes"], r["payload_sha256"], r["tail_crc32"]) in want[r["doc_id"]] for r in got)
    assert all(r["payload_bytes"] % 192 == 0 and r["payload_bytes"] > 0 for r in got)
    assert len({r["media_sha256"] for r in got if r["doc_id"] in (5, 6)}) == 1
    assert media.media_columns(docs.limit(0)).count() == 0


def test_media_shards_are_tar_files(spark, tmp_path):
    import tarfile

    folder = "file://" + str(tmp_path / "m")
    docs = frame(spark, EDGES).select("doc_id", F.col("text").cast("binary"))
    index = media.store(docs.coalesce(2), folder)
    meta = media.with_metadata(index, folder).collect()
    for r in meta:
        with tarfile.open(tmp_path / "m" / r["shard"]) as t:
            member = next(m for m in t if m.name == f"{r['digest']}.png")
            raw = t.extractfile(member).read()
        assert member.offset_data == r["offset"] and len(raw) == r["length"] and (r["width"], r["bits"]) == (64, 8)
        assert media.from_png(raw).rstrip(b" ") == dict((i, (x or "").encode()) for i, x, _ in EDGES)[r["doc_id"]].rstrip(b" ")


def base_scan(t):
    import re

    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    places, labels = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_licenses(spark):
    rows = EDGES + [
        (20, "Released UNDER the MIT-License. under the mit license", "a"), (21, "Apache License, Version 2.0 and CC BY-NC 4.0", "a"), (22, "licensed under the GNU General Public License, version 3", "a"),
        (23, "under the mit licenses under the\nmit license", "a"), (24, "cc by nc " * 3000, "a"), (25, "ünder the mit license", "a"), (26, "Kcc by nc K", "a"),
    ]
    got = {r["doc_id"]: r for r in licenses.scan(frame(spark, rows, True)).collect()}
    for i, t, _ in rows:
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base_scan(t), i
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert got[22]["labels"] == "gpl" and got[20]["labels"] == "mit" and got[21]["labels"] == "apache-2,cc-by-nc" and got[5]["score"] == 0
    assert licenses.scan(frame(spark, rows).limit(0)).count() == 0


def water(sizes, weights, cap):
    total, target, open_ = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    left = float(total)
    while open_:
        share = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if weights[i] * share >= cap * sizes[i]}
        if not full:
            for i in open_:
                target[i] = weights[i] * share
            break
        for i in full:
            target[i] = float(cap * sizes[i])
            left -= target[i]
        open_ -= full
    return target


def test_mixing(spark):
    rows = EDGES + [(1000 + i, text(5 + i % 90, i), f"s{min(i % 11, 6)}") for i in range(400)] + [(2000, text(4, 1), "tiny"), (2001, None, "none")]
    out = mixing.mix_sources(frame(spark, rows, True), shard_rows=40, block=8).collect()
    assert len(out) == len(rows) and all(0 <= r["taken"] <= 3 * r["size"] for r in out)
    by = {}
    for r in out:
        by.setdefault(r["source"], []).append(r)
    names = sorted((s for s in by if s is not None), key=lambda s: s.encode()) + [None]
    sizes = [sum(len((t or "").split()) for _, t, s in rows if s == n) for n in names]
    want = water(sizes, [(1, 2, 3)[i % 3] for i in range(len(names))], 3)
    for n, s, w in zip(names, sizes, want, strict=True):
        assert by[n][0]["source_size"] == s and abs(by[n][0]["target"] - w) < 1e-6
        assert abs(sum(r["taken"] for r in by[n]) - w) <= max(40, 0.02 * w)
    again = mixing.mix_sources(frame(spark, rows).repartition(7), shard_rows=40, block=8).collect()
    key = lambda rs: sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in rs)
    assert key(out) == key(again)
    assert mixing.mix_sources(frame(spark, rows).limit(0)).count() == 0
    assert mixing.mixed_documents(frame(spark, rows)).columns == frame(spark, rows).columns


@pytest.mark.parametrize("weights", [(1, 6), (2, 3)])
def test_mixed_words_are_the_targets(spark, weights):
    """Very long texts in the one source, and another with about one text in each shard."""
    rows = [(i, " ".join(["w"] * (6000 if i % 100 == 0 else 20 + i % 60)), "hot") for i in range(2000)]
    rows += [(5000 + i, " ".join(["w"] * (100 + i % 40)), "sparse") for i in range(60)]
    rows += [(6000 + i, " ".join(["w"] * (200 + i % 90)), "third") for i in range(500)]
    docs = frame(spark, rows)
    said = dict(weights=(*weights, 1), shard_rows=32)
    want = {r["source"]: r["target"] for r in mixing.mix_sources(docs, **said).select("source", "target").distinct().collect()}
    got = mixing.mixed_documents(docs, **said).groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()
    sizes = {s: [len(t.split()) for _, t, x in rows if x == s] for s in want}
    got = {r["source"]: r["n"] for r in got}
    print("WORDS", {s: (got.get(s, 0), round(want[s]), sum(sizes[s])) for s in want})
    assert all(abs(got.get(s, 0) - want[s]) <= 2 * np.mean(sizes[s]) + mixing.BLOCK for s in want)


def test_seats_are_sainte_lague(spark):
    r = random.Random(9)
    for n, seats in ((3, 10), (40, 1000), (7, 3)):
        votes = [r.randint(1, 10_000) for _ in range(n)]
        df = spark.createDataFrame([(i, v, sum(votes), seats) for i, v in enumerate(votes)], "i long, votes long, total long, seats long")
        got = {x["i"]: x["got"] for x in mixing._seats(df, [], "votes", "total", "seats", [F.col("i")]).collect()}
        want = [0] * n
        for _ in range(seats):
            best = max(range(n), key=lambda i: (votes[i] / (2 * want[i] + 1), -i))
            want[best] += 1
        assert [got[i] for i in range(n)] == want


def test_chat(spark):
    hard = ["\\### Assistant: </turn> ok", "", None, "<turn user>&lt;</turn>", "a\nb", "&amp;amp;", "🙂 ü", "x" * 50_000]
    turns = [(c, k, ["user", "assistant", "system", None, "assistant>"][(c + k) % 5], hard[(c * 3 + k) % len(hard)], "z") for c in range(20) for k in range(6)] + [(1, 2, "assistant", "tie", "z"), (1, 2, "assistant", "tie", "z"), (None, None, "assistant", "no id", "z"), (3, None, "user", "first", "z")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, head string")
    made = chat.format_turns(chat.text_parts(df))
    got = {r["conv_id"]: r for r in chat.digests(made).collect()}
    spans = {r["conv_id"]: (r["formatted"], r["loss_spans"]) for r in made.collect()}
    for c in {t[0] for t in turns}:
        own = sorted(((t[1] is not None, t[1] or 0, t[2] or "", (t[3] or "").replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;"), t[3] or "") for t in turns if t[0] == c))
        told = "".join(f"{r}\n{x}\n" for _, _, r, _, x in own)
        loss = "".join(x for _, _, r, _, x in own if r == "assistant")
        assert got[c]["n_turns"] == len(own) and got[c]["turns_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        whole, at = spans[c]
        cut = "".join(whole[s["start"] : s["start"] + s["length"]] for s in at).replace("&gt;", ">").replace("&lt;", "<").replace("&amp;", "&")
        assert cut == loss and len(whole) == got[c]["formatted_chars"]
    assert chat.digests(chat.format_turns(chat.text_parts(df.limit(0)))).count() == 0


def test_chat_parts(spark):
    parts = [("text", "see ", None, None), ("image", None, "a<b>.png", 4), ("text", "and", None, None), ("audio", None, "c.wav", None), ("video", None, "d", 1)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", [("document", "x", "e.pdf", 2)]), (1, 2, "assistant", None)], "conv_id long, turn long, role string, parts array<struct<type:string,text:string,ref:string,units:long>>")
    r = chat.format_turns(df).first()
    assert r["formatted"] == "<turn user>see <image a&lt;b&gt;.png/>and<audio c.wav/></turn><turn assistant><document e.pdf/></turn><turn assistant></turn>"
    assert [(a["turn"], a["part"], a["type"], a["ref"], a["tokens"]) for a in r["attachments"]] == [(0, 1, "image", "a<b>.png", 1024), (0, 3, "audio", "c.wav", 25), (1, 0, "document", "e.pdf", 800)]
    assert r["expanded_tokens"] == 1 + 1024 + 1 + 25 + 800


def test_vectors_are_dealt_out_again(spark, monkeypatch):
    """Shards of too many classes get centroids of their own, and no link is lost or counted twice."""
    monkeypatch.setattr(embedding_dedup, "SHARD", 30)
    monkeypatch.setattr(embedding_dedup, "SAMPLE", 60)
    monkeypatch.setattr(embedding_dedup, "DEEP", 50)
    r = np.random.default_rng(2)
    base = r.normal(size=(150, 8))
    v = np.repeat(base, 4, 0) + r.normal(size=(600, 8)) * 0.05
    got, want, _ = vector_links(spark, v)
    assert got == want and sum(want) > 1000


def test_large_groups_lose_no_link(spark, monkeypatch):
    """Buckets and clusters of several blocks: pivots first, then what is left as pairs of blocks."""
    for name, n in (("BUCKET_BLOCK", 8), ("CLUSTER_BLOCK", 4), ("PIVOTS", 1)):
        monkeypatch.setattr(minhash, name, n)
    r = random.Random(5)
    rows = []
    for g in range(3):
        words = text(60, g).split()
        for _ in range(25):
            own = list(words)
            for _ in range(r.randint(0, 3)):
                own[r.randrange(60)] = f"other{r.randint(0, 9)}"
            rows.append((len(rows), " ".join(own), "a"))
    sets = {i: set(minhash.shingles(t.encode()).tolist()) for i, t, _ in rows}
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in sets:
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                top[b] = a
    got = {x["doc_id"]: x["component_id"] for x in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == {i: find(i) for i in sets}


def test_contraction(spark):
    r = random.Random(8)
    a, b = (np.array([r.randint(0, 200) for _ in range(150)]) for _ in range(2))
    node, top = components.least_reached(a, b)
    want = {}
    for x in set(a.tolist() + b.tolist()):
        seen, todo = {x}, [x]
        while todo:
            i = todo.pop()
            for p, q in zip(a.tolist(), b.tolist(), strict=True):
                for n, m in ((p, q), (q, p)):
                    if n == i and m not in seen:
                        seen.add(m)
                        todo.append(m)
        want[x] = min(seen)
    assert dict(zip(node.tolist(), top.tolist(), strict=True)) == want


def packed_by_hand(rows, capacity, same):
    """Best fit without an order or bitmaps: every open bin is looked at."""
    todo = []
    for row, size, source, cluster in rows:
        for k, at in enumerate(range(0, max(size, 1), capacity)):
            todo.append((-min(capacity, size - at), row, k, at, source, cluster if cluster is not None else ("row", row)))
    bins, out = [], []
    for n, row, k, at, source, cluster in sorted(todo, key=lambda t: t[:4]):
        fits = [(b["left"], i) for i, b in enumerate(bins) if b["left"] >= -n and b["left"] > 0 and cluster not in b["clusters"] and b["sources"].count(source) < same]
        if fits:
            i = min(fits)[1]
        else:
            i = len(bins)
            bins.append({"left": capacity, "clusters": set(), "sources": []})
        b = bins[i]
        out.append((row, k, at, -n, i, capacity - b["left"]))
        b["left"] += n
        b["clusters"].add(cluster)
        b["sources"].append(source)
    return out


def test_packing_is_best_fit(spark):
    r = random.Random(4)
    for _ in range(20):
        rows = [(i, r.choice([r.randint(1, 60), r.randint(1, 250)]), r.choice(["a", "b", None]), r.choice([None, r.randint(0, 9)])) for i in range(80)]
        assert packing.pack_shard(rows, 100, 3) == packed_by_hand(rows, 100, 3)
    docs = [(i, text(r.randint(1, 90), r.randint(0, 30)), r.choice("ab")) for i in range(120)]
    got = sorted(map(tuple, packing.pack(frame(spark, docs, True), capacity=64, same=2, shard_rows=1000).select("doc_id", "piece", "start", "n_words", "bin_offset", "bin_id").collect()))
    by_hand = packed_by_hand([(i, len(t.split()), s, t) for i, t, s in docs], 64, 2)
    assert [x[:5] for x in got] == sorted((row, k, at, n, offset) for row, k, at, n, _, offset in by_hand)
    assert len({x[5] for x in got}) == len({b for *_, b, _ in by_hand})


CLASHES = ("_id", "_copy", "_copies", "_n", "_s", "toxicity", "n_lines", "n_dropped", "kept_sha256", "component_id", "digest", "row", "key", "component", "shard", "ij", "marks", "words", "taken", "size", "n", "own", "keys")


def clashing(spark, rows):
    df = frame(spark, rows)
    for c in CLASHES:
        df = df.withColumn(c, F.concat(F.lit(f"{c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    return df


def test_stages_keep_clashing_columns(spark):
    """What filters documents returns the columns of docs with their own values."""
    docs = clashing(spark, EDGES)
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 9)], "doc_id long, toxic int")
    whole = {tuple(r) for r in docs.drop("text", "n_chars").collect()}
    for f in (lambda d: toxicity.clean_documents(d, labels), lambda d: line_dedup.dedup_lines(d, report=False), minhash.deduplicated, mixing.mixed_documents):
        out = f(docs)
        assert out.columns == docs.columns
        assert {tuple(r) for r in out.drop("text", "n_chars").collect()} <= whole
        assert f(docs.limit(0)).count() == 0


def test_rows_of_one_id_keep_their_texts(spark):
    rows = [(1, text(30, 1), "a"), (1, text(30, 2), "a"), (1, text(30, 1), "a"), (2, text(30, 1), "a"), (3, None, "a"), (3, "", "a"), (None, text(30, 1), "a")]
    left = sorted((r["doc_id"] or 0, r["text"] or "") for r in minhash.deduplicated(frame(spark, rows)).collect())
    assert left == sorted([(1, text(30, 1)), (1, text(30, 2)), (3, ""), (0, text(30, 1))])


def insulted(r, i, bad):
    words = text(40, 5000 + i).split()
    if bad:
        words[r.randrange(40)] = r.choice(["blockhead", "b.l.o.c.k.h.e.a.d", "bloxckhexad", "b l o c k h e a d"])
    return " ".join(words)


def test_toxicity_edges_with_a_model(spark):
    """A model that knows an insult: empty, null and very long texts, rows without id, repeats and ties."""
    r = random.Random(6)
    rows = [(i, insulted(r, i, i % 4 == 0), "a") for i in range(1, 500)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(1, 500)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(frame(spark, rows), labels, train_rows=300)
    long = text(60_000, 77)
    edges = [(1, None, "a"), (2, "", "a"), (3, " \n\t", "a"), (4, long, "a"), (5, "ka blockhead lo " * 3, "a"), (5, "ka blockhead lo " * 3, "a"), (None, "mi b\tl  o\nc k h e a d ru", "a"), (7, "blockhead" * 4000 + " mi", "a")]
    got = toxicity.score(clashing(spark, edges), model).collect()
    by = {x["doc_id"]: x["toxicity"] for x in got}
    assert len(got) == len(edges) and all(0 <= x["toxicity"] <= 1 for x in got)
    assert by[1] == by[2] == by[3] < 0.5 and max(by[1], by[4]) < min(by[5], by[None])
    assert len({x["toxicity"] for x in got if x["doc_id"] == 5}) == 1
    # Brute force: a document's decisions one token at a time.
    texts = [t for _, t, _ in rows[:40]]
    slow = []
    for t in texts:
        own = sorted((float(model.decide([w])[0]) for w in toxicity.tokens(t)), reverse=True)
        x = [*own[: toxicity.TOP], *[model.bias] * (toxicity.TOP - len(own)), np.log1p(len(own))]
        slow.append(1 / (1 + np.exp(-(np.array([*x, 1.0]) @ model.head))))
    assert np.allclose(model.probability(toxicity.features(model, texts)), slow, atol=1e-5)
    assert toxicity.score(frame(spark, edges).limit(0), model).count() == 0


def test_inserting_in_parts_equals_an_index_built_afresh(spark):
    """Counts and filters after random insertions and deletions."""
    r = random.Random(9)
    lines = [f"line number {i} of the common stock" for i in range(30)]
    docs = frame(spark, [(i, "\n".join(r.sample(lines, 6)), "a") for i in range(40)])
    index = line_dedup.Index.empty(spark, 3).insert(docs.where("doc_id < 25"))
    index = index.delete(docs.where("doc_id % 3 = 0")).insert(docs.where("doc_id >= 25")).delete(docs.where("doc_id = 31"))
    afresh = line_dedup.Index.empty(spark, 3).insert(docs.where("not (doc_id < 25 and doc_id % 3 = 0) and not (doc_id >= 25 and doc_id % 93 = 31) and doc_id <> 31"))
    want = afresh.counts
    deleted = index
    rows = lambda x: sorted((bytes(k["key"]), k["n_docs"], k["keeper"]) for k in x.collect())
    assert rows(deleted.counts) == rows(want)
    sizes = lambda x: sorted((f["shard"], sum(v != 0 for t in line_dedup.CuckooFilter.from_bytes(bytes(f["payload"])).tables for v in t)) for f in x.filters.collect())
    assert sizes(deleted) == sizes(afresh)


def test_seats_by_thresholds(spark, monkeypatch):
    """Seats of shards are those of the highest quotients, ties by shard, however far thresholds narrow them."""
    r = random.Random(3)
    cells = [(rank, shard, r.choice([0, 5, 5, 40, r.randint(1, 300)])) for rank in (1, 2) for shard in range(60)]
    total = {k: sum(c for q, _, c in cells if q == k) for k in (1, 2)}
    blocks = {1: 37, 2: 411}
    df = spark.createDataFrame([(k, s, c, total[k], blocks[k]) for k, s, c in cells], "rank int, shard long, cell long, source_size long, source_blocks long")
    want = {}
    for k in (1, 2):
        best = sorted(((-c / (2 * i + 1), s) for q, s, c in cells if q == k and c for i in range(blocks[k] + 1)))[: blocks[k]]
        for _, s in best:
            want[k, s] = want.get((k, s), 0) + 1
    for narrow in (4096, 3):
        monkeypatch.setattr(mixing, "NARROW", narrow)
        got = {(x["rank"], x["shard"]): x["got"] for x in mixing._shard_seats(df).collect()}
        assert {k: v for k, v in got.items() if v} == want


def test_media_by_hand(spark):
    """feature, media_bytes and media_sha256 of each text, computed beside the store."""
    texts = ["", "a", "x" * 191, "y" * 192, "z" * 193, "é" * 500, text(3000, 4)]
    got = {x["doc_id"]: x for x in media.media_columns(frame(spark, [(i, t, "a") for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        payload = media.padded(t.encode())
        png = media.to_png(payload)
        values = list(payload)
        mean = sum(values) / len(values)
        spread = (sum((v - mean) ** 2 for v in values) / len(values)) ** 0.5
        bits = -sum(values.count(v) / len(values) * np.log2(values.count(v) / len(values)) for v in set(values))
        assert got[i]["media_bytes"] == len(png) and got[i]["media_sha256"] == hashlib.sha256(png).hexdigest() and got[i]["tail_crc32"] == zlib.crc32(payload[-16:])
        assert got[i]["feature"] == f"64x{len(payload) // 192} mean={mean:.3f} std={spread:.3f} bits={bits:.3f}"


def test_loss_is_cut_by_the_mask(spark):
    """A mask that covers something else gives another digest: what is told is what the mask covers."""
    turns = spark.createDataFrame([(1, 0, "user", "a <b> & c"), (1, 1, "assistant", "d &amp; <e>"), (1, 2, "assistant", "é")], "conv_id long, turn long, role string, text string")
    formatted = chat.format_turns(chat.text_parts(turns))
    good = chat.digests(formatted).first()
    assert good["loss_sha256"] == hashlib.sha256("d &amp; <e>é".encode()).hexdigest() and good["loss_chars"] == 12
    wrong = chat.digests(formatted.withColumn("loss_spans", F.slice("loss_spans", 1, 1))).first()
    assert wrong["loss_chars"] == 11


def test_quality_edges_with_a_model(spark):
    """A model that has learned: empty, null and very long texts, rows without id, repeats, ties, an empty table, clashing names."""
    r = random.Random(2)
    rows = [(i, text(60, i) if i % 2 else " ".join(["!!! BUY"] * r.randint(20, 60)), "a") for i in range(1, 300)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 300)] + [(None, 1), (7, None)], "doc_id long, quality int")
    model = quality.train(quality.measured(frame(spark, rows)), labels)
    assert set(model.steps.tolist()) != {0.5} and (np.diff(model.steps) >= 0).all()
    edges = [(1, None, "a"), (2, "", "a"), (3, " \n\t ", "a"), (4, text(60_000, 3), "a"), (5, text(60, 900), "b"), (5, text(60, 900), "b"), (None, "!!! BUY " * 30, "a")]
    got = quality.score(quality.measured(clashing(spark, edges).withColumn("x", F.lit("x")).withColumn("quality", F.lit("q"))), model).collect()
    by = {x["doc_id"]: x["quality"] for x in got}
    assert len(got) == len(edges) and all(0 <= x["quality"] <= 1 for x in got)
    assert by[1] == by[2] == by[3] and by[5] > 0.5 > by[None] and len({x["quality"] for x in got if x["doc_id"] == 5}) == 1
    assert quality.score(quality.measured(frame(spark, edges).limit(0)), model).count() == 0
    # Brute force: the calibrated score of each row, from its statistics alone.
    x = np.array([quality.statistics((t or "").encode()) for _, t, _ in edges])
    z = np.clip((x - model.mean) / model.spread, -6, 6)
    made = np.random.default_rng(quality.SEED)
    across, turn = made.normal(size=(x.shape[1], quality.FEATURES)) / x.shape[1] ** 0.5, made.uniform(0, 2 * np.pi, quality.FEATURES)
    raw = [sum(w * np.cos(float(row @ a) + t) * (2 / quality.FEATURES) ** 0.5 for w, a, t in zip(model.weights, across.T, turn, strict=False)) + model.weights[-1] for row in z]
    want = [model.steps[int(round(min(max((v - model.low) / (model.high - model.low) * (quality.BINS - 1), 0), quality.BINS - 1)))] for v in raw]
    assert np.allclose(sorted(want), sorted(x["quality"] for x in got))


def test_hot_lines(spark, monkeypatch):
    """Keys of many documents take another way to their references, with the same result."""
    lines = [f"line number {i} of the common stock" for i in range(12)]
    r = random.Random(1)
    docs = frame(spark, [(i, "\n".join(x for j, x in enumerate(lines) if r.random() < j / 12), "a") for i in range(60)])
    plain = sorted(map(tuple, line_dedup.dedup_lines(docs).select("doc_id", "text", "n_dropped").collect()))
    for hot in (0, 10):  # none hot, some hot
        monkeypatch.setattr(line_dedup, "HOT", hot)
        assert sorted(map(tuple, line_dedup.dedup_lines(docs).select("doc_id", "text", "n_dropped").collect())) == plain


def test_wide_shards_send_few_copies(spark, monkeypatch):
    """A shard that no centroids divide is compared throughout: each vector goes to its pairs of blocks of WIDE bytes, in its own type."""
    r = np.random.default_rng(11)
    v = np.concatenate([r.normal(size=(2000, 64)), (r.normal(size=64) + r.normal(size=(400, 64)) * 0.1), np.repeat(r.normal(size=(100, 64)), 3, 0) + r.normal(size=(300, 64)) * 0.05])
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    classes = embedding_dedup.classes_of(df).selectExpr("vec_id as rep", "label", "embedding", "1L as copies")
    placed = embedding_dedup._placed(classes, {})
    assert placed.count() == len(v) and dict(placed.dtypes)["embedding"] == "array<float>"
    got, want, groups = vector_links(spark, v)
    assert got == want
    monkeypatch.setattr(embedding_dedup, "WIDE", 500 * 64 * 8)
    monkeypatch.setattr(embedding_dedup, "STRIP", 5000)
    assert embedding_dedup._placed(classes, {}).count() == 6 * len(v)
    again, want, same = vector_links(spark, v)
    assert again == want and same == groups


def test_throughout_at_the_threshold():
    """What single precision leaves open is decided in double; a pair counts where one of the two is at home."""
    r = np.random.default_rng(12)
    a = embedding_dedup.unit(r.normal(size=(300, 16)).tolist())
    away = embedding_dedup.unit([x - (x @ y) * y for x, y in zip(r.normal(size=(300, 16)), a)])
    cos = 0.98 + r.choice([-1e-9, 1e-9, 1e-3, -1e-3], 300)
    v = np.concatenate([a, cos[:, None] * a + np.sqrt(1 - cos[:, None] ** 2) * away])
    true = (v @ v.T >= 0.98) & ~np.eye(600, dtype=bool)
    home, copies = np.arange(600) % 4, r.integers(1, 5, 600)
    at_home = true & ((home[:, None] | home) == 3)
    every, half = np.arange(600), np.arange(300)
    links, top = embedding_dedup.linked_throughout(v, every, every, home, 3, copies)
    assert (links == at_home @ copies).all() and all(top[i] == top[j] for i, j in np.argwhere(at_home)) and len(set(top)) == 600 - np.triu(at_home).sum()
    links, _ = embedding_dedup.linked_throughout(v, half, half + 300, home * 0, 0, copies)
    cross = true & ((every[:, None] < 300) != (every < 300))
    assert (links == cross @ copies).all()
