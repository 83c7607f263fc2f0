"""Filter interaction audit (operator 13): what each filter removes under every order of the filters, replayed as a relation.

1. flags(): a row per document, without its text: its part, which filters it fails, and its labels.
2. audit(): each such row meets every order of the filters (a fixed table of n! rows, broadcast) and is exploded to its steps. The
   first step whose filter the document fails is where it goes. Steps are counted by (part, order, step) with conditional sums, which
   the tasks combine before anything is exchanged: no more than parts * n! * n rows leave a task.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftglass.llm.common import staged, table, with_group, words_of

#: The filters, in the order of their bits.
FILTERS = "ABCDE"


def own_failures(text: Column) -> dict[str, Column]:
    """The failure conditions that a text alone decides. Null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = words_of(text)
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 50 * F.size(words).cast("long"),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 3 * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def flags(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, fails, good, toxic) for each row of docs (doc_id, text, lang): fails has bit i set where filter i of FILTERS fails.

    E: rows of one text share its SHA-256 and length; all but those of its smallest doc_id fail. The rows of a text are dealt out
    before they are grouped, so that a text of very many copies is no single task's.

    Null or empty text: an empty text (no words: A fails, B does not), and all empty texts are identical. Null lang: part ''. Null
    doc_id: never fails E, makes nobody fail it, and has no labels. Rows that repeat a doc_id are each a document; equal texts of one
    doc_id don't fail E by each other. A doc_id labelled twice has the higher labels; a null label is none. Very long texts are read
    whole. Extra columns, whatever their names, are left out. Empty tables: no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = own_failures(text)
    bits = sum((F.when(own[f], 1 << i).otherwise(0) for i, f in enumerate(FILTERS) if f in own), F.lit(0))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        bits.alias("bits"),
        F.unhex(F.concat(F.sha2(text, 256), F.lpad(F.hex(F.length(text)), 8, "0"))).alias("same"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = staged(rows, "audit-flags")  # narrow: texts are read once
    rows = with_group(rows, "same", F.col("row"), first=(F.min, F.col("doc_id")))
    fails = F.col("bits") + F.when(F.col("doc_id") > F.col("first"), 1 << FILTERS.index("E")).otherwise(0)
    said = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    known = rows.select("doc_id", "part", fails.alias("fails")).join(said, "doc_id", "left")
    return known.select("part", "fails", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def orders(spark: SparkSession, filters: str = FILTERS) -> DataFrame:
    """(filter_order, b1, b2, …): each order of the filters, with the bit of each of its steps."""
    rows = [("".join(o), *(1 << filters.index(f) for f in o)) for o in permutations(filters)]
    return spark.createDataFrame(rows, "filter_order string, " + ", ".join(f"b{i + 1} int" for i in range(len(filters))))


def audit(flagged: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) from rows (part, fails, good,
    toxic): a row for each part, order and step, zeros included. A table without rows has no parts and gives no rows. Ties don't
    arise: a document goes at one step of an order."""
    numbers = range(1, len(filters) + 1)
    fails_at = lambda bit: F.col("fails").bitwiseAND(bit) != 0
    replayed = flagged.crossJoin(F.broadcast(orders(flagged.sparkSession, filters)))  # a fixed n! rows
    gone = F.least(*[F.when(fails_at(F.col(f"b{i}")), i) for i in numbers])
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("step"), F.col(f"b{i}").alias("bit")) for i in numbers]))
    rows = replayed.select("part", "filter_order", "fails", "good", "toxic", gone.alias("gone"), steps.alias("s")).select("*", "s.step", "s.bit").drop("s")
    counted = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    here = F.col("gone") == F.col("step")
    by = rows.groupBy("part", "filter_order", "step").agg(
        counted(F.col("gone").isNull() | (F.col("gone") > F.col("step"))).alias("kept"),
        counted(here).alias("removed"),
        counted(fails_at(F.col("bit")) & (F.col("gone") < F.col("step"))).alias("redundant"),
        counted(F.col("fails") == F.col("bit")).alias("unique_fails"),
        counted(here & F.col("good")).alias("good_lost"),
        counted(here & F.col("toxic")).alias("toxic_lost"),
    )
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    return by.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", letter)))  # n! rows each, whatever the documents


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return audit(flags(docs, table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")))
