"""Tables laid out for their keys, and folders whose files have older and newer columns."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftglass.session import scratch


def keyed(rows: DataFrame, key: str, buckets: int, name: str = "keyed") -> str:
    """Writes rows as a table in buckets of `key`, sorted by it and with a bloom filter of it in each file, in the shared folder; returns
    the table's name. Two such tables of as many buckets are joined by their keys without an exchange, a lookup of keys opens their
    buckets alone, and there only the row groups that may have them.

    Rows are dealt to the buckets before they are written, so that there is a file for each bucket and no more; a key of very many rows
    makes its bucket large, as it would a join's partition. Null keys are a bucket's."""
    spark, table = rows.sparkSession, f"{name}_{uuid.uuid4().hex}"
    out = rows.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).format("parquet")
    out.option("path", scratch(spark, name)).option(f"parquet.bloom.filter.enabled#{key}", "true").saveAsTable(table)
    return table


#: Keys that go into a filter at most; more are joined in place, bucket by bucket.
MOST_KEYS = 1000


def looked_up(spark: SparkSession, table: str, key: str, keys: DataFrame) -> DataFrame:
    """A keyed() table's rows of some keys (one column, distinct)."""
    some = [r[0] for r in keys.limit(MOST_KEYS + 1).collect()]
    rows = spark.table(table)
    return rows.where(F.col(key).isin(some)) if len(some) <= MOST_KEYS else rows.join(keys.toDF(key), key, "left_semi")


def dropped(spark: SparkSession, *tables: str) -> None:
    """Forgets keyed() tables; their files stay in the application's folder until it is purged."""
    for table in tables:
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def all_layouts(spark: SparkSession, root: str, since: dict[str, tuple[int, Column]]) -> DataFrame:
    """The rows of all files under root/layout=N, as the newest layout has them: since names the columns that older files lack, with the
    layout that brought each and its value in rows from before. Nulls that a newer file holds stay. Files are read as they are, none is
    written anew."""
    rows = spark.read.option("mergeSchema", "true").parquet(root)
    lacks = lambda layout: F.col("layout") < layout
    return rows.withColumns({c: F.when(lacks(layout), value).otherwise(F.col(c) if c in rows.columns else F.lit(None)) for c, (layout, value) in since.items()})
