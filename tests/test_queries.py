"""Each query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from driftglass import import_queries, index_queries, mesh_queries, stream_queries  # noqa: F401  (they register their queries)
from driftglass.queries import ORACLES, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "as_tuple"):
        return round(float(v), 6)
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(str(plain(r[c])) for c in columns) for r in df.collect()))
    said = duck.execute(ORACLES[name])
    names = [c[0] for c in said.description]
    assert sorted(names) == columns
    want = sorted(tuple(str(plain(r[names.index(c)])) for c in columns) for r in said.fetchall())
    assert len(got) == len(want)
    assert got == want


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLES.keys()


def test_all_passages_are_stored(spark):
    rows = QUERIES["doc_summary"](spark, DATA).collect()
    assert rows and all(r["stored"] == r["known"] == r["chunk_count"] for r in rows)


def test_entry_without_training_data_operators(spark, monkeypatch):
    import importlib
    import sys

    monkeypatch.setitem(sys.modules, "driftglass.llm", None)
    entry = importlib.reload(importlib.import_module("__spark_entry__"))
    assert "bm25_search" in entry.queries() and not any(n.startswith("op") and n[2].isdigit() for n in entry.queries())
    assert entry.entry(spark).limit(1).count() == 1
