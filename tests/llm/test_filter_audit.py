"""Filter interaction audit against a replay in plain Python, and its edge cases."""

import re
from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F

from driftglass.llm import filter_audit, oracles

DATA = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i}" for i in range(300))


def brute(docs, labels):
    """docs: (doc_id, text, lang); labels: (doc_id, quality, toxic)."""
    rows = []
    for i, text, lang in docs:
        t = text or ""
        ws = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        fails = {
            "A": len(ws) < 200,
            "B": 100 * len(set(ws)) < 50 * len(ws),
            "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs),
        }
        mine = [(q, x) for d, q, x in labels if d is not None and d == i]
        rows.append((lang or "", fails, any(q == 1 for q, _ in mine), any(x == 1 for _, x in mine)))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for o in map("".join, permutations("ABCDE")):
            for k, f in enumerate(o):
                left = [r for r in mine if not any(r[1][x] for x in o[:k])]
                gone = [r for r in left if r[1][f]]
                redundant = sum(r[1][f] for r in mine) - len(gone)
                unique = sum(r[1][f] and sum(r[1].values()) == 1 for r in mine)
                out[part, o, k + 1] = [len(left) - len(gone), len(gone), redundant, unique, sum(r[2] for r in gone), sum(r[3] for r in gone)]
                total[f] += len(gone)
        for (p, o, k), v in out.items():
            if p == part:
                v.append(total[o[k - 1]])
    return out


def got(df):
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    rows = [((r["part"], r["filter_order"], r["step"]), [r[n] for n in names]) for r in df.collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


EDGES = [
    (1, None, "en"), (2, "", "en"), (3, LONG, None), (4, LONG, ""), (4, LONG, "en"), (5, LONG + " #", "en"), (None, LONG, "en"), (None, None, "de"), (6, "A b " * 150, "de"),
    (7, "word " * 50_000, "en"), (8, " " + LONG, "en"), (9, "\t\n ", "de"), (10, LONG, "en"), (11, "É " * 250, "en"),
]
LABELS = [(3, 1, 0), (4, 0, 1), (4, 1, None), (7, None, 1), (None, 1, 1), (10, 1, 1), (99, 1, 1)]


@pytest.mark.parametrize("extra", [False, True])
def test_edges_by_brute_force(spark, extra):
    docs, labels = spark.createDataFrame(EDGES, "doc_id long, text string, lang string"), spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    if extra:
        for c in ("part", "fails", "step", "row", "same", "first", "good", "steps", "filter_order", "removed"):
            docs, labels = docs.withColumn(c, F.lit("clash")), labels.withColumn(c, F.lit("clash"))
    flagged = filter_audit.flags(docs, labels)
    assert flagged.count() == len(EDGES)
    assert got(filter_audit.audit(flagged)) == brute(EDGES, LABELS)


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame(EDGES, "doc_id long, text string, lang string"), spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert filter_audit.audit(filter_audit.flags(docs.limit(0), labels)).count() == 0
    unlabelled = got(filter_audit.audit(filter_audit.flags(docs, labels.limit(0))))
    assert unlabelled.keys() == brute(EDGES, []).keys() and not any(v[4] or v[5] for v in unlabelled.values())


def test_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    said = con.execute(oracles.ORACLES["op13_filter_audit"])
    names = [c[0] for c in said.description]
    rows = [tuple(r[n] for n in names) for r in filter_audit.op13(spark, DATA).collect()]
    assert rows and sorted(rows) == sorted(said.fetchall())


def test_steps_add_up(spark):
    rows = filter_audit.op13(spark, DATA).collect()
    whole = {r["lang"]: r["count"] for r in spark.read.parquet(f"{DATA}/documents.parquet").groupBy("lang").count().collect()}
    by = {}
    for r in rows:
        by.setdefault((r["part"], r["filter_order"]), []).append(r)
    for (part, _), steps in by.items():
        assert len(steps) == 5 and sum(r["removed"] for r in steps) + min(r["kept"] for r in steps) == whole[part]
