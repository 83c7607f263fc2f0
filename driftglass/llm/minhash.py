"""MinHash near-dedup with circulant signatures (operator 4).

1. sketch(): a document's set is hashed, and two permutations give its whole signature: the first orders the set's elements,
   the second, shifted by k, gives coordinate k. Documents of equal sets (128-bit key and size) are one class; from here on a class
   is one row, known by a number of its own.
2. Banding: classes that agree in a band's coordinates meet in a bucket. Within a bucket, classes whose signatures agree in
   enough coordinates are linked by a spanning forest, which keeps the links' number below the members'.
3. The components of those links are clusters of candidates: all pairs that may be similar lie within one. Pairs of a cluster are
   confirmed on full sets, most promising first, unless the two are connected by then. What is confirmed gives the components that
   are returned.

A bucket or cluster of any size goes through connected(): its rows are dealt to blocks once, a few pivots to all of its blocks, so
that most of a large group of near copies hangs together after a pass in proportion to its rows. Only rows that still lie outside
the largest part then meet all others, as pairs of blocks; so no link is lost, and what is quadratic is what is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftglass.llm.common import apart, few, released, staged, table, with_group
from driftglass.llm.components import components

WORDS, SIMILAR = 5, (75, 100)
#: 32 bands of 4 coordinates: of pairs at similarity 0.75, 5 in a million meet in no band. A coordinate is kept as 8 bits for
#: comparisons; a pair at 0.75 agrees in fewer than AGREE of 128 coordinates 3 times in a million. Measured on random sets of 40 and
#: 400: none of 40,000 pairs at 0.75 lost by either; at 0.5, 11.0 % and 13.1 % meet in no band, where theory has 10.7 % and 12.5 %.
BANDS, ROWS, AGREE = 32, 4, 74
#: Members of a bucket, and of a cluster, that a block holds; pivots that each block of a larger one has; and shingles of a set
#: that count as one member of a cluster (a longer set counts as several).
BUCKET_BLOCK, CLUSTER_BLOCK, PIVOTS, A_MEMBER = 4096, 512, 16, 16_384
#: Large groups whose main parts are broadcast at most (32 bytes each); more are joined as any other table.
MOST_GROUPS = 100_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


#: Odd multipliers of the two permutations: the first orders a set's elements, the second is shifted.
FIRST, SECOND = (0x7FEB352D, 0x846CA68B), (0x2C1B3C6D, 0x297A2D39)


def _permuted(x: np.ndarray, by: tuple[int, int]) -> np.ndarray:
    """A permutation of the 32-bit integers (xor-shifts and odd multipliers can be undone)."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(by[0])
    x ^= x >> np.uint32(15)
    x *= np.uint32(by[1])
    x ^= x >> np.uint32(16)
    return x


def shingles(raw: bytes) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's 5-word shingles: words between ASCII white space, A-Z lower-cased. Fewer
    words than five make one shingle, none make none."""
    words = raw.lower().split()  # bytes: ASCII only
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), len(words))] if words else [], np.uint64)
    of = xxhash.xxh3_64_intdigest
    hashes = np.array([of(w) for w in words], np.uint64)
    n = len(words) - WORDS + 1
    out = hashes[:n].copy()
    for i in range(1, WORDS):
        out *= _MIX
        out ^= out >> np.uint64(29)
        out += hashes[i : n + i]
    out *= _MIX
    return np.unique(out ^ (out >> np.uint64(32)))


def signature(found: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """Circulant MinHash: coordinate k is the least second permutation of (first permutation + k)."""
    first = _permuted((found ^ (found >> np.uint64(32))).astype(np.uint32), FIRST)
    shifts = np.arange(size, dtype=np.uint32)
    out = np.full(size, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(first), 512):
        np.minimum(out, _permuted(first[at : at + 512, None] + shifts, SECOND).min(0), out=out)
    return out


def sketch(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, n_shingles, key, marks, bands) for each row of docs (doc_id, text); the last three are null for an empty
    set. digest: MD5 of the text, which tells rows of one doc_id apart."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, marks, bands = [], [], [], []
            for text in batch.column(2):
                found = shingles(text.as_py() or b"")
                n.append(len(found))
                if not len(found):
                    keys.append(None)
                    marks.append(None)
                    bands.append(None)
                    continue
                sig = signature(found)
                keys.append(set_key(found))
                marks.append(sig.astype(np.uint8).tobytes())
                rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
                h = np.arange(BANDS, dtype=np.uint64)
                for i in range(ROWS):
                    h = (h ^ rows[:, i]) * _MIX
                    h ^= h >> np.uint64(31)
                bands.append(h.astype(np.int64))
            columns = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(marks, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "n_shingles", "key", "marks", "bands"])

    text = F.col("text").cast("string").cast("binary")
    rows = docs.select(F.col("doc_id").cast("long"), F.md5(F.coalesce(text, F.lit(b""))).alias("digest"), text)
    return rows.mapInArrow(one, "doc_id long, digest string, n_shingles long, key binary, marks binary, bands array<long>")


def set_key(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def in_blocks(rows: DataFrame, group: str, member: Column, count: Column, block: int) -> DataFrame:
    """rows with `ij` (struct i, j): once for each pair of blocks that its block is part of, blocks being dealt by a hash of the
    member; a group of at most `block` rows is one block, and comes once."""
    n = F.ceil(count / block).cast("int")
    rows = rows.withColumns({"_n": n, "_b": F.pmod(F.xxhash64(member), n).cast("int")})
    pairs = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda o: F.struct(F.least(F.col("_b"), o).alias("i"), F.greatest(F.col("_b"), o).alias("j")))
    return rows.withColumn("ij", F.explode(pairs)).drop("_n", "_b")


def _forest(marks: np.ndarray, agree: int) -> Iterator[tuple[int, np.ndarray]]:
    """(i, rows that i is the first to reach) over the graph of rows that agree in enough coordinates, breadth first."""
    left = np.arange(len(marks))
    todo: list[int] = []
    while len(left):
        if not todo:
            todo, left = [int(left[0])], left[1:]
        i = todo.pop()
        near = (marks[left] == marks[i]).sum(1) >= agree
        if near.any():
            yield i, left[near]
            todo += left[near].tolist()
            left = left[~near]


def connected(rows: DataFrame, group: str, block: int, compare: Callable[[DataFrame], DataFrame], nodes: int) -> DataFrame:
    """(a, b): links that connect all like rows within each group. rows: `group` (long), node, n (how many members the group counts)
    and what compare() needs; staged or cheap to compute twice. nodes: how many nodes there are at most, for the number of files.

    compare() gets such rows with ij (their pair of blocks), side (their own block of the two) and top (their part so far), each
    row as often as it is compared, and returns (a, b) for pairs of rows of one (group, ij) that are of different parts and, where
    ij has two blocks, of different sides. First each block of a group is compared for itself, with the group's pivots; then what
    lies outside a group's largest part is compared with all of the group, as pairs of blocks.
    """
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    pivot = (blocks > 1) & (F.pmod(F.xxhash64(F.lit(3), "node"), F.col("n")) < PIVOTS)
    at = F.explode(F.when(pivot, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(own)))
    dealt = rows.withColumn("side", at).withColumns({"ij": F.struct(F.col("side").alias("i"), F.col("side").alias("j")), "top": F.col("node")})
    found = staged(few(compare(dealt).distinct(), nodes), "links")
    large = rows.where(F.col("n") > block)
    if large.isEmpty():
        return found
    large = large.join(components(found), "node", "left").withColumn("top", F.coalesce("component", "node")).drop("component")
    large = staged(few(large, large.count(), block * 8), "large")
    parts = large.groupBy(group, "top").agg(F.count(F.lit(1)).alias("m"))
    parts = parts.groupBy(group).agg(F.max(F.struct("m", "top")).alias("first"), F.sum("m").alias("all"))
    parts = parts.where("first.m < all").select(group, F.col("first.top").alias("main"), "all", F.col("first.m").alias("most"))
    parts = staged(parts, "parts")  # a row for some of the groups of more than `block` members
    left = large.join(F.broadcast(parts) if parts.count() <= MOST_GROUPS else parts, group)
    share = F.col("n") / F.col("all")  # members that a row counts as, on average
    n_rest = F.ceil((F.col("all") - F.col("most")) * share / block).cast("int")
    n_main = F.ceil(F.col("most") * share / block).cast("int")
    main = F.col("top") == F.col("main")
    side = F.when(main, n_rest + F.pmod(F.xxhash64("node"), n_main)).otherwise(F.pmod(F.xxhash64("node"), n_rest)).cast("int")
    left = left.withColumn("side", side)
    others = F.when(main, F.sequence(F.lit(0), n_rest - 1)).otherwise(F.sequence(F.lit(0), n_rest + n_main - 1))
    left = left.withColumn("o", F.explode(others)).withColumn("ij", F.struct(F.least("side", "o").alias("i"), F.greatest("side", "o").alias("j")))
    return found.unionByName(staged(few(compare(left.drop("main", "all", "most", "o")).distinct(), nodes), "links"))


def candidate_links(classes: DataFrame, agree: int = AGREE) -> DataFrame:
    """(a, b): in each bucket links that connect the classes (node, marks, bands; staged) of like signatures."""
    nodes = classes.count()
    placed = classes.select("node", F.explode("bands").alias("bucket"))
    met = with_group(placed, "bucket", F.col("node"), n=(F.sum, F.lit(1))).where("n > 1")
    rows = met.join(classes.select("node", "marks"), "node").select("bucket", "node", "n", "marks")
    rows = staged(few(rows, nodes * BANDS, 200_000), "minhash-buckets")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes, int, int]] = []
        group, a, b = None, [], []

        def close() -> None:
            if len(held) == 2:  # most buckets
                (ka, ma, sa, ta), (kb, mb, sb, tb) = held
                if ta != tb and (sa != sb or group[1] == group[2]) and sum(x == y for x, y in zip(ma, mb, strict=True)) >= agree:
                    a.append(ka)
                    b.append(kb)
            elif len(held) > 2:
                marks = np.frombuffer(b"".join(h[1] for h in held), np.uint8).reshape(len(held), -1)
                for i, near in _forest(marks, agree):
                    a.extend([held[i][0]] * len(near))
                    b.extend(held[j][0] for j in near)
            held.clear()

        for batch in batches:
            ij = batch.column(1)
            for *at, node, mark, side, top in zip(batch.column(0).to_pylist(), ij.field(0).to_pylist(), ij.field(1).to_pylist(), *(batch.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True):
                if at != group:
                    close()
                    group = at
                held.append((node, mark, side, top))
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
            a.clear()
            b.clear()
        close()
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def compare(rows: DataFrame) -> DataFrame:
        rows = rows.select("bucket", "ij", "node", "marks", "side", "top").repartition("bucket", "ij").sortWithinPartitions("bucket", "ij", "node")
        return rows.mapInArrow(link, "a long, b long")

    return connected(rows, "bucket", BUCKET_BLOCK, compare, nodes)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """100 * intersection >= 75 * union, of sorted distinct arrays."""
    part, whole = SIMILAR
    if len(a) > len(b):
        a, b = b, a
    if whole * len(a) < part * len(b):
        return False
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return whole * both >= part * (len(a) + len(b) - both)


def confirm(keys: list[int], marks: list[bytes], sets: list[np.ndarray], side: np.ndarray | None = None, top: np.ndarray | None = None, agree: int = AGREE) -> list[tuple[int, int]]:
    """Pairs of keys whose full sets are similar, enough to connect all that are: those already connected aren't compared again.

    side: where given, only pairs of different sides count. top: rows of equal tops are connected from the start.
    """
    root = list(range(len(keys)))
    if top is not None:
        first: dict[int, int] = {}
        root = [first.setdefault(t, i) for i, t in enumerate(top.tolist())]

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    pairs: list[tuple[int, int, int]] = []
    rows = np.frombuffer(b"".join(marks), np.uint8).reshape(len(keys), -1)
    part, whole = SIMILAR
    sizes = np.array([len(s) for s in sets])
    for i in range(len(keys) - 1):
        same = (rows[i + 1 :] == rows[i]).sum(1)
        ok = (same >= agree) & (whole * np.minimum(sizes[i + 1 :], sizes[i]) >= part * np.maximum(sizes[i + 1 :], sizes[i]))
        if side is not None:
            ok &= side[i + 1 :] != side[i]
        if top is not None:
            ok &= top[i + 1 :] != top[i]
        pairs += [(-int(same[j]), i, i + 1 + int(j)) for j in np.flatnonzero(ok)]
    pairs.sort()
    links = []
    for _, i, j in pairs:
        a, b = find(i), find(j)
        if a != b and similar(sets[i], sets[j]):
            root[a] = b
            links.append((keys[i], keys[j]))
    return links


def links(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): confirmed links between classes (node, key, doc_id, n_shingles, marks, bands; staged), enough to connect all similar
    ones."""
    nodes = classes.count()
    candidates = candidate_links(classes)
    clusters = components(candidates).select("node", F.col("component").alias("cluster"))
    wanted = clusters.join(classes.select("node", "key", "doc_id", "n_shingles", "marks"), "node")
    wanted = with_group(wanted, "cluster", F.col("node"), n=(F.sum, F.greatest(F.lit(1), F.ceil(F.col("n_shingles") / A_MEMBER))))
    wanted = wanted.select("key", "doc_id", "node", "cluster", "n", "marks")
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py() or b"") for t in batch.column(5)]
            right = pa.array([len(s) > 0 and set_key(s) == k for s, k in zip(found, batch.column(0).to_pylist(), strict=True)], pa.bool_())
            out = pa.RecordBatch.from_arrays([*(batch.column(i) for i in (1, 2, 3, 4)), pa.array([s.tobytes() for s in found], pa.binary())], ["node", "cluster", "n", "marks", "found"])
            yield out.filter(right)

    rows = wanted.join(texts, "doc_id").select("key", "node", "cluster", "n", "marks", "text")
    rows = staged(few(rows, nodes, 4_000).mapInArrow(sets, "node long, cluster long, n long, marks binary, found binary"), "minhash-sets")

    def group(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        once: dict[int, int] = {}
        for i, k in enumerate(t.column("node").to_pylist()):
            once.setdefault(k, i)  # repeated rows of a doc_id
        t = t.take(list(once.values()))
        nodes, two = t.column("node").to_pylist(), t.column("ij")[0].as_py()
        found = [np.frombuffer(x, np.uint64) for x in t.column("found").to_pylist()]
        side = t.column("side").to_numpy() if two["i"] != two["j"] else None
        got = confirm(nodes, t.column("marks").to_pylist(), found, side, t.column("top").to_numpy()) if len(nodes) > 1 else []
        return pa.table([pa.array([a for a, _ in got], pa.int64()), pa.array([b for _, b in got], pa.int64())], ["a", "b"])

    def compare(rows: DataFrame) -> DataFrame:
        return rows.select("cluster", "ij", "side", "top", "node", "marks", "found").groupBy("cluster", "ij").applyInArrow(group, "a long, b long")

    out = connected(rows, "cluster", CLUSTER_BLOCK, compare, nodes)
    released(candidates, rows)
    return out


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, n_shingles, top, component_id) for every row of docs; see near_duplicates(). top: a number of the component,
    null for rows without words or id."""
    sketches = staged(sketch(docs), "minhash")
    known = sketches.where("key is not null and doc_id is not null")
    classes = known.groupBy("key", "n_shingles").agg(F.min("doc_id").alias("doc_id"), F.any_value("marks").alias("marks"), F.any_value("bands").alias("bands"))
    classes = staged(few(classes, sketches.count(), 50_000).withColumn("node", F.monotonically_increasing_id()), "minhash-classes")
    tops = components(links(docs.where("doc_id is not null"), classes)).withColumnRenamed("component", "top")
    first = classes.select("node", "key", "n_shingles", F.col("doc_id").alias("first")).join(tops, "node", "left").withColumn("top", F.coalesce("top", "node"))
    by = with_group(first, "top", F.col("node"), component_id=(F.min, F.col("first"))).select("key", "n_shingles", "top", "component_id")
    rows = sketches.select("doc_id", "digest", "n_shingles", "key").join(by, ["key", "n_shingles"], "left")
    return rows.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))).select("doc_id", "digest", "n_shingles", "top", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text).

    component_id: the smallest doc_id that links of similarity 0.75 or more reach, the row's own included. Null or empty text, or
    white space alone: no shingles, linked with nothing. Null doc_id: found in no component (null), kept. Repeated rows: equal
    component and `kept`; rows of one doc_id with other texts go by their own text. Very long texts: read whole. Ties don't arise.
    Empty table: no rows. Extra columns, whatever their names, are left out.
    """
    return _rows(docs).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs, with its columns, less all but one text of each group: the one of the smallest doc_id, once.

    Rows without id stay, as do texts without words. Repeated rows: one stays. Rows of one doc_id with different texts: of each
    group they belong to one stays (the smallest MD5), so a text like no other is never lost. Empty table: no rows. Columns of docs
    may have any names.
    """
    rows = _rows(docs).where("doc_id is not null and doc_id = component_id")
    least = rows.where("n_shingles > 0").groupBy("doc_id", "top").agg(F.min("digest").alias("digest")).select("doc_id", "digest")
    i, d = apart("id"), apart("digest")
    kept = least.unionByName(rows.where("n_shingles = 0").select("doc_id", "digest").distinct()).select(F.col("doc_id").alias(i), F.col("digest").alias(d))
    own = docs.withColumn(d, F.md5(F.coalesce(F.col("text").cast("string").cast("binary"), F.lit(b"")))).withColumn(i, F.col("doc_id").cast("long"))
    return own.join(kept, [i, d]).dropDuplicates([i, d]).select(*docs.columns).unionByName(docs.where("doc_id is null"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a
), found AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, f.component_id, f.component_id = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN found f USING (doc_id)
"""
