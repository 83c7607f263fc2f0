"""What the operators of this folder share: scratch tables in the cluster's shared folder, and input columns."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftglass.session import purge, released, scratch, shared_dir, staged, table

__all__ = ["SPACE", "SPACE_BYTES", "apart", "few", "held_out", "kept", "let_go", "purge", "released", "scratch", "shared_dir", "staged", "table", "with_group", "words_of"]

#: ASCII white space, as the contracts name it.
SPACE = r"[\x20\x09-\x0D]"
SPACE_BYTES = b" \t\n\x0b\x0c\r"


def apart(name: str) -> str:
    """A column's name that no input has, for a column that stands beside an input's own for a while."""
    return f"{name}_{uuid.uuid4().hex}"


_kept: list[DataFrame] = []


def kept(df: DataFrame) -> DataFrame:
    """df, held on the executors' disks from its first use on: for narrow tables that a pure scan gives, which a lost executor's part
    is read again for. let_go() frees what is held."""
    df = df.persist(StorageLevel.DISK_ONLY)
    _kept.append(df)
    return df


def let_go() -> None:
    """Frees all tables that kept() holds, once the results that read them are written."""
    while _kept:
        _kept.pop().unpersist()


def few(df: DataFrame, rows: int, a_part: int = 500_000) -> DataFrame:
    """df in no more partitions than `rows` rows need at a_part rows each: fewer, larger files and tasks where there is little."""
    return df.coalesce(max(1, -(-rows // a_part)))


#: Parts that a group's rows are dealt to, so that a large group is no single group of a join.
PARTS = 32


def with_group(rows: DataFrame, group: str, member: Column, **aggregates: tuple[Callable[[Column], Column], Column]) -> DataFrame:
    """rows plus, for each name, (f, x): f over x of the row's group; f is a sum, a least or a greatest. The group's rows are dealt to
    PARTS by a hash of the member; parts are aggregated, then groups, and each part of a group gets the result, so that no task sees
    a large group whole."""
    part = apart("part")
    rows = rows.withColumn(part, F.pmod(F.xxhash64(member), F.lit(PARTS)))
    parts = rows.groupBy(group, part).agg(*[f(x).alias(name) for name, (f, x) in aggregates.items()])
    whole = parts.groupBy(group).agg(*[f(F.col(name)).alias(name) for name, (f, _) in aggregates.items()], F.collect_list(part).alias("parts"))
    return rows.join(whole.select(group, *aggregates, F.explode("parts").alias(part)), [group, part]).drop(part)


def words_of(text: Column) -> Column:
    """The runs of characters other than ASCII white space, as an array; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def held_out(doc_id: Column) -> Column:
    """The rows whose labels are never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0
