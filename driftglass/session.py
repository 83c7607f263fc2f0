"""Session with the settings that the queries assume, and table reading."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, shuffle_partitions: int | None = None, **settings: str) -> SparkSession:
    """UTC, adaptive execution with skew-join splitting. Partitions and memory follow the cluster where they aren't given."""
    builder = SparkSession.builder.appName("driftglass").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def beside(spark: SparkSession, **settings: str) -> SparkSession:
    """A session of the same application with settings of its own: what spark itself is set to stays."""
    own = spark.newSession()
    for name in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled"):
        own.conf.set(name, spark.conf.get(name))
    for key, value in settings.items():
        own.conf.set(key.replace("__", "."), value)
    return own


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an input that is dealt out anew before work that is dear for each row: a scan of so few gives most cores nothing to do.
LITTLE = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """df, dealt to all cores where it is little by Spark's own estimate (one small file is one task, whatever it has to do); else as
    it is, as a larger scan has tasks enough. Rows stay the same."""
    little = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < LITTLE
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if little else df


_own = ""


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only on one machine (a local master, as in tests) does a
    temporary folder take its place where that is unset; elsewhere executors would each write to a disk of their own, so that
    raises."""
    global _own
    if not (root := spark.conf.get("spark.checkpoint.dir", None)):
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir is unset: on {master or 'a cluster'} it must name a folder that driver and executors share")
        root = _own = _own or "file://" + tempfile.mkdtemp(prefix="driftglass-")
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nobody else uses, in the folder of this application."""
    return f"{shared_dir(spark)}/driftglass/{spark.conf.get('spark.app.id', 'app')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back: the lineage ends there, so that a lost executor costs no more than the tasks
    it ran, and later steps don't compute df again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def deleted(spark: SparkSession, path: str) -> None:
    """Deletes a folder of a file system that Spark knows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def released(*tables: DataFrame) -> None:
    """Deletes the folders of staged() tables that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_folder", None):
            deleted(df.sparkSession, path)


def purge(spark: SparkSession) -> None:
    """Deletes all that this application has staged, once its results are written elsewhere."""
    deleted(spark, f"{shared_dir(spark)}/driftglass/{spark.conf.get('spark.app.id', 'app')}")
