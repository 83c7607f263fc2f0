"""A keyed table that a stream is merged into: each batch rewrites the buckets of its own keys, and no others.

    data/epoch=E/bucket=B    the rows of bucket B as they were after batch E
    manifests/epoch=E        (bucket, at): which epoch's files each bucket has after batch E

A batch counts once its manifest is written, which is last and small. Until then readers see the table before it; a batch that comes again
begins from the manifest before its own and writes the same files anew. Files of untouched buckets stay as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from driftglass.operators.state import newest
from driftglass.session import deleted, released, staged


@dataclass(frozen=True)
class KeyedTable:
    """The newest row of each `key`: that of the highest `version`, of equal ones the one that came first by `arrival`. schema: the
    columns of its rows. Null keys are a key."""

    root: str
    schema: StructType
    key: str
    version: str
    arrival: str
    buckets: int = 16

    def _manifests(self, spark: SparkSession) -> DataFrame:
        try:
            return spark.read.schema("bucket int, at long, epoch long").parquet(f"{self.root}/manifests")
        except AnalysisException:  # nothing is written yet
            return spark.createDataFrame([], "bucket int, at long, epoch long")

    def state(self, spark: SparkSession, before: int | None = None) -> dict[int, int]:
        """Which epoch's files each bucket has, after the last batch or the last one before an epoch. At most `buckets` entries."""
        rows = self._manifests(spark)
        rows = rows if before is None else rows.where(F.col("epoch") < before)
        last = rows.agg(F.max("epoch")).first()[0]
        return {r["bucket"]: r["at"] for r in rows.where(F.col("epoch") == last).collect()} if last is not None else {}

    def _read(self, spark: SparkSession, state: dict[int, int]) -> DataFrame:
        paths = [f"{self.root}/data/epoch={at}/bucket={bucket}" for bucket, at in sorted(state.items())]
        return spark.read.schema(self.schema).parquet(*paths) if paths else spark.createDataFrame([], self.schema)

    def rows(self, spark: SparkSession) -> DataFrame:
        """The table after the last batch. Its files stay until vacuum()."""
        return self._read(spark, self.state(spark))

    def write(self, batch: DataFrame, epoch: int) -> None:
        """A foreachBatch function: merges a batch."""
        spark, names = batch.sparkSession, self.schema.fieldNames()
        state = self.state(spark, epoch)
        new = staged(newest(batch.select(*names), self.key, self.version, self.arrival).withColumn("_bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")), "upsert-new")
        touched = [r[0] for r in new.select("_bucket").distinct().collect()]
        if touched:
            old = self._read(spark, {b: state[b] for b in touched if b in state})
            merged = newest(old.unionByName(new.select(*names)), self.key, self.version, self.arrival)
            merged = merged.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))
            merged.repartition("bucket").sortWithinPartitions("bucket", self.key).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/data/epoch={epoch}")
        released(new)
        now = state | dict.fromkeys(touched, epoch)
        if now:
            spark.createDataFrame(sorted(now.items()), "bucket int, at long").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifests/epoch={epoch}")

    def vacuum(self, spark: SparkSession) -> None:
        """Deletes files that no bucket has any more, once nothing reads them, and manifests before the last."""
        rows = self._manifests(spark)
        last = rows.agg(F.max("epoch")).first()[0]
        kept = self.state(spark).items()
        for r in rows.select("bucket", "at").distinct().collect():
            if (r["bucket"], r["at"]) not in kept:
                deleted(spark, f"{self.root}/data/epoch={r['at']}/bucket={r['bucket']}")
        for r in rows.where(F.col("epoch") < last).select("epoch").distinct().collect() if last is not None else ():
            deleted(spark, f"{self.root}/manifests/epoch={r['epoch']}")
