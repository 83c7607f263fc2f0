"""Admission of announced documents: the same in SQL on tables with nulls."""

import duckdb
import pytest

from driftglass import mesh_queries  # noqa: F401  (it registers its queries)
from driftglass.queries import ORACLES, QUERIES

LINES = [(1, 10, 5, 3, "A"), (1, 10, 6, 1, "B"), (2, 11, 7, None, "C"), (None, 12, 8, 3, "D"), (None, 12, 8, 1, None), (3, None, 5, 3, "E"), (4, 13, None, 3, "F"), (5, None, 9, 1, "G"), (6, 14, 5, 6, None), (7, 15, 4, -1, "H"), (8, 16, 3, -2, "I"), (1, None, 2, 2, "J"), (9, 20, 1, 1, "K"), (40, 21, 6, 4, "L")]


@pytest.mark.parametrize("parts", [[(9, "b", 31), (40, "c", 30), (41, None, 50), (42, "d", None)], [(9, "b", 31), (None, "n", 31)], [(9, "b", 3)]])
def test_nulls(spark, tmp_path, parts):
    lines = "l_partkey long, l_orderkey long, l_suppkey long, l_linenumber int, l_returnflag string"
    spark.createDataFrame(LINES, lines).repartition(3).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    for t in ("lineitem", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got, want = QUERIES["document_admission"](spark, str(tmp_path)), con.execute(ORACLES["document_admission"])
    names = [c[0] for c in want.description]
    assert sorted([str(r[n]) for n in names] for r in got.collect()) == sorted(list(map(str, r)) for r in want.fetchall())
