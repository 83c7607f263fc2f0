"""Embedding near-dedup over a robust-pruned flat graph (operator 3).

1. Vectors that are equal, of one label, are one class; from here on a class is one vector.
2. Overlapping shards: centroids are fitted on a bounded sample, and those within reach of each other are one. A class has its
   home at the nearest centroid of its label and visits each one before it whose homes may hold a vector that links with it: so
   of two linked classes one is at home where the other is too. A pair counts there only, so links are counted once. A shard of
   more than DEEP classes is dealt out again in the same way, by centroids of a sample of its own, in up to LEVELS levels; a pair
   counts where one of the two is at home on every level.
3. Each shard of one block gets robust-pruned adjacency lists, made from all that is in range. A class's lists from all of its shards
   are united.
4. In each such shard every vector is searched for over the united lists, greedily from the shard's medoid; the search then expands
   through all that it finds in range (and a little beyond), q among them, which the pruning's ALPHA makes complete (see graph()). What
   it finds is verified by the cosine in double precision. A tight shard, where lists would be cut, and a large one that can't be dealt
   out further are compared throughout, which there takes less than the lists would: strip by strip, as pairs of blocks of WIDE bytes,
   so that few copies of a vector travel.
5. Each shard adds a spanning forest of its links to the components; links are never expanded. Recall is audited against brute force.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftglass.llm.common import released, staged, table, with_group
from driftglass.llm.components import components, least_reached
from driftglass.llm.minhash import in_blocks

SIMILAR = 0.98
#: The longest chord between unit vectors that link.
CHORD = (2 - 2 * SIMILAR) ** 0.5
#: Rows that centroids are fitted on, and their bytes, at most; classes that a shard has on average, and members of a shard that a
#: task holds at once.
SAMPLE, SAMPLE_BYTES, SHARD, BLOCK = 40_000, 64 << 20, 300, 1024
#: Classes of a shard that is dealt out again, rows that its own centroids are fitted on, levels at most, and classes that a task
#: assigns at a time.
DEEP, DEEP_SAMPLE, LEVELS, ASSIGN = 4096, 3000, 3, 4096
#: Bytes of a block's vectors where a shard is compared throughout, cosines that are computed at a time there, how often centroids may
#: place a class on average (or as often as its blocks would), and shards whose sizes are broadcast at most.
WIDE, STRIP, SPREAD, MOST_SHARDS = 32 << 20, 4 << 20, 2, 100_000
#: Vectors whose links are counted by brute force to measure recall.
AUDITED = 512
#: Neighbours, slack of the pruning, width of the greedy search, and how far below the range it goes on expanding.
DEGREE, ALPHA, BEAM, BEYOND = 24, 1.2, 8, 0.04


def usable(vector: Column, label: Column) -> Column:
    """Neither null nor zero nor empty, all components finite, label not null."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(label.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def classes_of(vectors: DataFrame) -> DataFrame:
    """vectors (vec_id, embedding, label) that are usable, with `key`, a 128-bit hash of label and components."""
    rows = vectors.where(usable(F.col("embedding"), F.col("label")) & F.col("vec_id").isNotNull())
    one, two = F.xxhash64("label", "embedding"), F.xxhash64(F.lit(7), "label", "embedding")
    narrow = vectors.schema["embedding"].dataType.simpleString() == "array<float>"  # floats are half the bytes; all arithmetic is in double
    return rows.select(F.col("vec_id").cast("long"), "label", F.col("embedding").cast("array<float>" if narrow else "array<double>"), F.struct(one.alias("a"), two.alias("b")).alias("key"))


def unit(rows: list) -> np.ndarray:
    v = np.array(rows, np.float64)
    v = v / np.abs(v).max(1, keepdims=True)  # no overflow
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def fit_centroids(sample: pd.DataFrame, total: int, shard: int = SHARD) -> dict[tuple, np.ndarray]:
    """Spherical k-means by (label, dimension): about a centroid for each `shard` of all classes, never more than a tenth of the
    sample's rows. Of centroids within two CHORDs, which would share all that they have, one stays. None where blocks of the
    whole label compare no more rows than the shards would, or where shards would hold classes too often (see SPREAD)."""
    out = {}
    for at, rows in sample.groupby(["label", sample.embedding.map(len)]):
        v = unit(rows.embedding.tolist())
        own = total * len(v) / len(sample)
        k = min(round(own / shard), len(v) // 10)
        if k < 2:
            continue
        c = v[np.random.default_rng(5).choice(len(v), k, replace=False)]
        for _ in range(8):
            near = np.concatenate([(v[i : i + BLOCK] @ c.T).argmax(1) for i in range(0, len(v), BLOCK)])
            c = np.array([v[near == i].sum(0) if (near == i).any() else c[i] for i in range(k)])
            c /= np.maximum(np.sqrt((c * c).sum(1, keepdims=True)), 1e-12)
        stay: list[int] = []
        for i in range(k):
            if not stay or (c[stay] @ c[i]).max() < 1 - 2 * CHORD**2:
                stay.append(i)
        c = c[stay]
        some = v[:2000]
        sizes = np.bincount(np.concatenate(shards_of(some, c)), minlength=len(c)) * own / len(some)
        wide = max(1, WIDE // (8 * v.shape[1]))
        placed = (sizes * np.ceil(sizes / wide)).sum() <= max(SPREAD * own, own * np.ceil(own / wide))
        if len(c) > 1 and placed and (sizes * np.ceil(sizes / BLOCK)).sum() < own * np.ceil(own / BLOCK):
            out[at] = c
    return out


def shards_of(v: np.ndarray, centroids: np.ndarray | None) -> list[list[int]]:
    """For each vector its home, the nearest centroid h, then each centroid c before h where a vector at home may be within CHORD.

    x at home at c has x(h - c) <= 0, so y within CHORD of x has y(h - c) <= CHORD |h - c|.
    """
    if centroids is None:
        return [[0]] * len(v)
    apart = np.sqrt(np.maximum(0, 2 - 2 * (centroids @ centroids.T)))
    out = []
    for at in range(0, len(v), BLOCK):
        near = v[at : at + BLOCK] @ centroids.T
        home = near.argmax(1)
        visits = near[np.arange(len(near)), home][:, None] - near <= CHORD * apart[home] + 1e-9
        visits &= np.arange(len(centroids)) < home[:, None]
        out += [[int(h), *np.flatnonzero(x).tolist()] for h, x in zip(home, visits, strict=True)]
    return out


def pruned(v: np.ndarray, i: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Robust pruning: the nearest of `others` is kept, and those that are ALPHA times nearer to it than to i go; and so on.
    Also those that neither were kept nor went when the list was full. Vectors of one direction never go for each other."""
    far = np.sqrt(np.maximum(0, 2 - 2 * (v[others] @ v[i])))
    order = np.argsort(far, kind="stable")
    others, far = others[order], far[order]
    kept = []
    while len(others) and len(kept) < DEGREE:
        kept.append(others[0])
        between = np.sqrt(np.maximum(0, 2 - 2 * (v[others] @ v[others[0]])))
        stay = (ALPHA * between > far) | (far < 1e-6)
        stay[0] = False
        others, far = others[stay], far[stay]
    return np.array(kept, np.int64), others


def graph(v: np.ndarray) -> list[np.ndarray] | None:
    """Adjacency lists of a shard's vectors: each vector's pruned neighbours among its nearest and all in range, then the reverse
    edges, pruned again where a list gets too long. None where a list is full before all in range are kept or went.

    With these lists, and with any that hold them, found_near() is complete. Let y be in range of q. Each list has y itself or some p at ALPHA times less
    from y, so there is a way from q to y; its first row is nearer to q than y, the next are within CHORD (1 + 1 / ALPHA ** 2) of
    q, which is less than BEYOND's chord: all are expanded.
    """
    n = len(v)
    lists: list[np.ndarray] = []
    for at in range(0, n, 256):
        near = v[at : at + 256] @ v.T
        near[np.arange(len(near)), np.arange(at, at + len(near))] = -2
        few = min(n - 1, 3 * DEGREE)
        best = np.argpartition(-near, few - 1, 1)[:, :few] if few else np.zeros((len(near), 0), np.int64)
        for i, b in enumerate(best):
            own, rest = pruned(v, at + i, np.union1d(b, np.flatnonzero(near[i] >= SIMILAR - 1e-9)))
            if (near[i][rest] >= SIMILAR - 1e-9).any():
                return None
            lists.append(own)
    back: list[list[int]] = [[] for _ in range(n)]
    for i, own in enumerate(lists):
        for j in own:
            back[j].append(i)
    for i in range(n):
        both = np.union1d(lists[i], np.array(back[i], np.int64)).astype(np.int64)
        lists[i] = both if len(both) <= 2 * DEGREE else np.union1d(pruned(v, i, both)[0], lists[i])
    return lists


def linked(v: np.ndarray, lists: list[np.ndarray] | None) -> np.ndarray:
    """Which rows of a shard are linked, as a matrix: by searches over their lists, or, without lists, by all cosines."""
    hit = np.zeros((len(v), len(v)), bool)
    if lists is None:
        for at in range(0, len(v), 256):
            hit[at : at + 256] = v[at : at + 256] @ v.T >= SIMILAR
    else:
        start = medoid(v)
        for q in range(len(v)):
            hit[q, found_near(v, lists, start, q)] = True
    hit |= hit.T
    np.fill_diagonal(hit, False)
    return hit


def linked_throughout(v: np.ndarray, one: np.ndarray, two: np.ndarray, home: np.ndarray, full: int, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs of rows `one` with rows `two` (which are the same, or have none in common), where one of a pair is at home: each
    row's links, by copies, and the least row that it reaches. Cosines are computed by strips in single precision; those that this leaves
    open, in double."""
    single, margin = v.astype(np.float32), 1e-6 + 2.4e-7 * v.shape[1]
    links, top = np.zeros(len(v), np.int64), np.arange(len(v))
    same = one is two
    at = 0
    while at < len(one):
        others = two[at:] if same else two
        rows = one[at : at + max(1, STRIP // max(1, len(others)))]
        near = single[rows] @ single[others].T
        a, b = np.divmod(np.flatnonzero(near >= SIMILAR - margin), max(1, len(others)))
        keep = b > a if same else np.ones(len(a), bool)
        open_ = np.flatnonzero(keep & (near[a, b] < SIMILAR + margin))
        for i in range(0, len(open_), BLOCK):
            part = open_[i : i + BLOCK]
            keep[part] = (v[rows[a[part]]] * v[others[b[part]]]).sum(1) >= SIMILAR
        a, b = rows[a[keep]], others[b[keep]]
        keep = (home[a] | home[b]) == full
        a, b = a[keep], b[keep]
        links += np.bincount(a, copies[b], len(v)).astype(np.int64) + np.bincount(b, copies[a], len(v)).astype(np.int64)
        apart = top[a] != top[b]
        if apart.any():
            nodes, least = least_reached(top[a[apart]], top[b[apart]])
            now = np.arange(len(v))
            now[nodes] = least
            top = now[top]
        at += len(rows)
    return links, top


def united(own: DataFrame) -> DataFrame:
    """(rep, near): of lists (rep, near) from several shards all that a class has in any."""
    flat = own.where("near is not null").select("rep", F.explode("near").alias("other")).distinct()
    return flat.groupBy("rep").agg(F.collect_list("other").alias("near"))


def local(ids: np.ndarray, near: dict[int, list[int]]) -> list[np.ndarray]:
    """United lists (by id) as places among the ids of a shard; a neighbour from elsewhere has no place there."""
    place = {x: i for i, x in enumerate(ids.tolist())}
    return [np.array([place[x] for x in near.get(x, ()) if x in place], np.int64) for x in ids.tolist()]


def forest(hit: np.ndarray) -> dict[int, list[int]]:
    """Edges that span the linked rows: for each row those that it is the first to reach."""
    left, out = np.ones(len(hit), bool), {}
    for first in np.flatnonzero(hit.any(1)).tolist():
        todo = [first] if left[first] else []
        left[first] = False
        while todo:
            i = todo.pop()
            new = np.flatnonzero(hit[i] & left).tolist()
            if new:
                left[new] = False
                out[i] = new
                todo += new
    return out


def found_near(v: np.ndarray, lists: list[np.ndarray], start: int, q: int, least: float = SIMILAR) -> np.ndarray:
    """What a range-expanding greedy search for q finds: rows of cosine `least` or more, q left out.

    First greedily from `start`, best row first, until the BEAM best rows are expanded. Then all rows in range or nearly so,
    q among them, are expanded wave by wave, until a wave finds no further one.
    """
    target, seen = v[q], np.zeros(len(v), bool)
    seen[[start, q]] = True
    near = float(v[start] @ target)
    todo, wide = [(-near, start)], [near]
    rows, cosines = [np.array([start])], [np.array([near])]

    def met(new: np.ndarray) -> np.ndarray:
        new = np.unique(new[~seen[new]])
        seen[new] = True
        rows.append(new)
        cosines.append(v[new] @ target)
        return cosines[-1]

    while todo:
        far, p = heapq.heappop(todo)
        if len(wide) >= BEAM and -far < wide[0]:
            break
        found = met(lists[p])
        for x, s in zip(rows[-1].tolist(), found.tolist(), strict=True):
            if len(wide) < BEAM or s > wide[0]:
                heapq.heappush(todo, (-s, x))
                heapq.heappush(wide, s)
                if len(wide) > BEAM:
                    heapq.heappop(wide)
    at, s = np.concatenate(rows), np.concatenate(cosines)
    wave = np.append(at[s >= least - BEYOND], q)
    while len(wave):
        s = met(np.concatenate([lists[i] for i in wave.tolist()]))
        wave = rows[-1][s >= least - BEYOND]
    at, s = np.concatenate(rows), np.concatenate(cosines)
    return at[(s >= least) & (at != q)]


def medoid(v: np.ndarray) -> int:
    return int((v @ v.sum(0)).argmax())


def _placed(classes: DataFrame, centroids: dict[tuple, np.ndarray]) -> DataFrame:
    """classes, a row for each of its shards (and pairs of blocks), and whether it is at home there."""
    vectors = classes.schema["embedding"].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, rows = batch.column(1).to_pylist(), [x.values.to_numpy() for x in batch.column(2)]
            out: list[list[int]] = [[] for _ in rows]
            by: dict[tuple, list[int]] = {}
            for i, (label, row) in enumerate(zip(labels, rows, strict=True)):
                by.setdefault((label, len(row)), []).append(i)
            for at, own in by.items():
                for i, s in zip(own, shards_of(unit([rows[i] for i in own]), centroids.get(at)), strict=True):
                    out[i] = s
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int32()))], [*batch.schema.names, "shards"])

    rows = classes.select("rep", "label", "embedding", "copies").mapInArrow(assign, f"rep long, label int, embedding {vectors}, copies long, shards array<int>")
    rows = rows.select("rep", "label", "embedding", "copies", F.posexplode("shards").alias("at", "s")).withColumns({"home": (F.col("at") == 0).cast("int"), "dim": F.size("embedding")})
    rows, most = _sized(rows.withColumn("shard", F.xxhash64("label", "dim", "s")).drop("at", "s"))
    full, before = 1, None
    for level in range(1, LEVELS):
        if most <= DEEP or (deeper := _deeper(rows, level)) is None:
            break
        deeper = staged(deeper, "vector-shards")
        if before is not None:
            released(before)
        before, (rows, most), full = deeper, _sized(deeper.drop("n")), full | 1 << level
    wide = WIDE // 8
    size = F.when(F.col("n") <= BLOCK, F.lit(1).cast("long")).otherwise(F.col("n") * F.col("dim"))
    rows = in_blocks(rows.withColumn("full", F.lit(full)), "shard", F.col("rep"), size, wide)
    return rows.withColumn("side", F.pmod(F.xxhash64("rep"), F.ceil(size / wide)).cast("int"))


def _sized(rows: DataFrame) -> tuple[DataFrame, int]:
    """rows with n, how many their shard has, and the greatest n. Vectors stay where they are, unless shards are very many."""
    sizes = staged(rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n")), "vector-sizes")
    shards, most = sizes.agg(F.count(F.lit(1)), F.max("n")).first()
    if shards <= MOST_SHARDS:
        return rows.join(F.broadcast(sizes), "shard"), most or 0
    return with_group(rows, "shard", F.col("rep"), n=(F.sum, F.lit(1))), most


def _deeper(rows: DataFrame, level: int) -> DataFrame | None:
    """rows (rep, label, embedding, copies, home, dim, shard, n) with the shards of more than DEEP classes dealt out again, and bit
    `level` of home set where a class is at home there. Where a shard is too tight for centroids of its own, it stays; None where
    all stay."""
    bit = 1 << level
    large = rows.where(F.col("n") > DEEP)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        found = list(fit_centroids(pdf[["label", "embedding"]], int(pdf.n.iloc[0])).values())
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "n": [pdf.n.iloc[0]], "centroids": [found[0].ravel().tolist() if found else None]})

    sample = large.where(F.pmod(F.xxhash64("rep", F.lit(level)), F.col("n")) < DEEP_SAMPLE)
    fitted = staged(sample.select("label", "embedding", "shard", "n").groupBy("shard").applyInPandas(fit, "shard long, n long, centroids array<double>"), "vector-centroids").where("centroids is not null")
    if (found := fitted.count()) == 0:
        return None
    parts = F.ceil(F.col("n") / ASSIGN).cast("int")
    centers = fitted.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).select("shard", "part", "centroids")
    divided = fitted.select("shard")
    divided = F.broadcast(divided) if found <= MOST_SHARDS else divided

    def assign(members: pd.DataFrame, center: pd.DataFrame) -> pd.DataFrame:
        if not len(members):
            return members.drop(columns="part")
        v = unit(members.embedding.tolist())
        shards = shards_of(v, np.array(center.centroids.iloc[0]).reshape(-1, v.shape[1]))
        at = np.repeat(np.arange(len(v)), [len(s) for s in shards])
        first = np.concatenate([[bit] + [0] * (len(s) - 1) for s in shards])
        sub = np.concatenate(shards)
        out = members.iloc[at].drop(columns="part")
        return out.assign(home=out.home.to_numpy() | first, shard=[hash_of(s, int(c)) for s, c in zip(out["shard"], sub, strict=True)])

    own = large.join(divided, "shard", "left_semi").withColumn("part", F.pmod(F.xxhash64("rep"), parts).cast("int"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    dealt = own.groupBy("shard", "part").cogroup(centers.groupBy("shard", "part")).applyInPandas(assign, schema)
    return rows.join(divided, "shard", "left_anti").withColumn("home", F.col("home").bitwiseOR(F.lit(bit))).unionByName(dealt)


def hash_of(shard: int, sub: int) -> int:
    """The number of a shard's part."""
    return xxhash.xxh3_64_intdigest(f"{shard}:{sub}".encode()) - (1 << 63)


GROUP = ("shard", "ij")


def near_vectors(vectors: DataFrame, *, audited: int = 0) -> tuple[DataFrame, float | None]:
    """(vec_id, n_links, component_id, kept) for every row of vectors (vec_id, embedding, label); and, where vectors are audited, the
    share of their links that was found (see recall()).

    Only rows of equal labels are compared. Vectors that are null, empty, zero or not finite throughout, null labels and vectors
    of other dimensions link with nothing; so do null vec_ids (component null, kept). Repeated rows: each is a vector of its own
    to n_links. Ties don't arise. Empty table: no rows. Extra columns, whatever their names, are left out. vectors is read three
    times: staged, or cheap to compute.
    """
    rows = classes_of(vectors)
    classes = rows.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.any_value("label").cast("int").alias("label"), F.any_value("embedding").alias("embedding"))
    # A vec_id may stand in rows of several vectors: a class is known by a number of its own.
    classes = staged(classes.select("key", F.col("rep").alias("least"), "copies", "label", "embedding", F.monotonically_increasing_id().alias("rep")), "vector-classes")
    n, dim = classes.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
    sample = vectors_here(classes.orderBy(F.xxhash64("key.a", "key.b"), "key").select("label", "embedding").limit(min(SAMPLE, max(1, SAMPLE_BYTES // (8 * dim)))))  # by hash
    centroids = fit_centroids(sample, n) if len(sample) else {}
    placed = _placed(classes, centroids)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, lists = pdf.rep.to_numpy(), graph(unit(pdf.embedding.tolist()))
        near = [None] if lists is None else [ids[x].tolist() for x in lists]
        at = pdf.ij.iloc[0]
        return pd.DataFrame({"shard": pdf["shard"].iloc[0], "i": at["i"], "j": at["j"], "rep": ids[: len(near)], "near": near})

    def search(pdf: pd.DataFrame, lists: pd.DataFrame) -> pd.DataFrame:
        v, ids, home = unit(pdf.embedding.tolist()), pdf.rep.to_numpy(), pdf.home.to_numpy()
        near = None if lists.tight.any() else local(ids, dict(zip(lists.rep.tolist(), lists.near.tolist(), strict=True)))
        hit = linked(v, near) & ((home[:, None] | home) == pdf.full.iloc[0])
        links, edges = hit @ pdf.copies.to_numpy(np.int64), forest(hit)
        out = pd.DataFrame({"rep": ids, "n_links": links, "other": [ids[edges[i]].tolist() if i in edges else None for i in range(len(v))]})
        return out[out.n_links > 0]

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, sides, at = pdf.rep.to_numpy(), pdf.side.to_numpy(), pdf.ij.iloc[0]
        one = np.flatnonzero(sides == at["i"])
        two = one if at["i"] == at["j"] else np.flatnonzero(sides == at["j"])
        links, top = linked_throughout(unit(pdf.embedding.tolist()), one, two, pdf.home.to_numpy(), int(pdf.full.iloc[0]), pdf.copies.to_numpy())
        out = pd.DataFrame({"rep": ids, "n_links": links, "other": [[int(ids[t])] if t != i else None for i, t in enumerate(top.tolist())]})
        return out[out.n_links > 0]

    listed = placed.where(F.col("n") <= BLOCK)
    built = listed.select(*GROUP, "rep", "embedding").groupBy(*GROUP).applyInPandas(build, "shard long, i int, j int, rep long, near array<long>")
    built = staged(built, "vector-lists")
    members = listed.select("shard", "ij.i", "ij.j", "full", "home", "rep", "embedding", "copies")
    known = listed.select(F.col("shard").alias("of"), F.col("ij.i").alias("one"), F.col("ij.j").alias("two"), F.col("rep").alias("node")).join(united(built).withColumnRenamed("rep", "node"), "node")
    known = known.select("of", "one", "two", F.col("node").alias("rep"), "near", F.lit(False).alias("tight"))
    tight = built.where("near is null").select("shard", "i", "j", "rep", "near", F.lit(True))  # a row for each group that lists can't hold
    dealt = known.union(tight).groupBy("of", "one", "two")
    got = members.groupBy("shard", "i", "j").cogroup(dealt).applyInPandas(search, "rep long, n_links long, other array<long>")
    wide = placed.where(F.col("n") > BLOCK).select(*GROUP, "full", "side", "home", "rep", "embedding", "copies")
    got = got.unionByName(wide.groupBy(*GROUP).applyInPandas(compare, "rep long, n_links long, other array<long>"))
    got = staged(got, "vector-links")
    links = got.groupBy("rep").agg(F.sum("n_links").alias("n_links"))
    tops = components(got.select(F.col("rep").alias("a"), F.explode("other").alias("b"))).select(F.col("node").alias("rep"), F.col("component").alias("top"))
    by = classes.select("key", "rep", "least", "copies").join(links, "rep", "left").join(tops, "rep", "left").withColumn("top", F.coalesce("top", "rep"))
    by = with_group(by, "top", F.col("rep"), component_id=(F.min, F.col("least")))
    by = by.select("key", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    near = rows.select("vec_id", "key").join(by, "key").select("vec_id", "n_links", "component_id")
    rest = vectors.where(~usable(F.col("embedding"), F.col("label")) | F.col("vec_id").isNull()).select(F.col("vec_id").cast("long"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    out = near.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    return out, recall(rows, near, audited) if audited else None


def vectors_here(rows: DataFrame) -> pd.DataFrame:
    """rows (label, embedding), of which there are few, on the driver, each vector as an array of doubles."""
    got = rows.toArrow().combine_chunks()
    column = got["embedding"].combine_chunks() if got.num_rows else None
    flat, ends = (column.values.to_numpy(), column.offsets.to_numpy()) if got.num_rows else (np.zeros(0), np.zeros(1, int))
    return pd.DataFrame({"label": got["label"].to_pandas(), "embedding": [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]})


def recall(rows: DataFrame, found: DataFrame, audited: int) -> float:
    """Of the links of rows whose vec_id is divisible by 100, the share that is found: links counted in found (vec_id, n_links), over
    links by brute force, each of `audited` such rows (the first by a hash, distinct ids) against all rows of its label. 1 where
    there are none. The asked rows are sent to every task."""
    asked = rows.where("vec_id % 100 = 0").dropDuplicates(["vec_id"]).orderBy(F.xxhash64("vec_id"), "vec_id").limit(audited).select("vec_id", "label", "embedding").toPandas()
    by = {at: (own.vec_id.to_numpy(), unit(own.embedding.tolist())) for at, own in asked.groupby(["label", asked.embedding.map(len)])} if len(asked) else {}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, int] = {}
        for batch in batches:
            for at, own in batch.groupby(["label", batch.embedding.map(len)]):
                if at in by:
                    v = unit(own.embedding.tolist())
                    for i in range(0, len(v), BLOCK):
                        for x, n in zip(by[at][0].tolist(), (by[at][1] @ v[i : i + BLOCK].T >= SIMILAR).sum(1).tolist(), strict=True):
                            sums[x] = sums.get(x, 0) + n
        yield pd.DataFrame({"vec_id": list(sums), "n": list(sums.values())})

    there = rows.select("label", "embedding").mapInPandas(count, "vec_id long, n long").groupBy("vec_id").agg((F.sum("n") - 1).alias("there"))
    got = found.dropDuplicates(["vec_id"]).join(F.broadcast(there), "vec_id").agg(F.sum(F.least("n_links", "there")).alias("found"), F.sum("there").alias("there")).first()
    return got["found"] / got["there"] if got["there"] else 1.0


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_vectors(), whose recall is measured in the same run; below 0.9 there is no result but an error."""
    out, share = near_vectors(table(spark, sf_dir, "embeddings"), audited=AUDITED)
    if share < 0.9:
        raise RuntimeError(f"recall {share:.3f}")
    return out


ORACLE = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
), u AS (
  SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE list_dot_product(e, e) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), top AS (
  SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
), n AS (
  SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a
)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM top LEFT JOIN n USING (vec_id)
"""
