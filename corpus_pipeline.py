"""The corpus pipeline: toxic documents go, repeated lines go, one document of each near-duplicate group stays, sources are mixed
to their weights, and what is left is packed into sequences. Each stage reads all that the one before it kept.

All stages but the last return the columns of docs, whatever their names, and work on whole texts, however long. What they do with
nulls, empty texts, ties and repeated rows is said in each; an empty table gives no rows in any.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftglass.llm import line_dedup, minhash, mixing, packing, toxicity
from driftglass.llm.common import let_go, staged, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go. Null and empty texts have nothing like an insult and stay; rows without id are scored as
    any other; equal rows share their fate."""
    return toxicity.clean_documents(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of at least 20 code points that 3 documents or more have stay in the one of the largest doc_id; n_chars follows (null for
    a null text, which stays null). Rows without id lose nothing and count for nothing; rows that repeat a doc_id are one document."""
    out = line_dedup.dedup_lines(docs, report=False)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest doc_id stays, once. Texts without words and rows without id
    are like no other and stay; a doc_id with several texts keeps one of each group."""
    return minhash.deduplicated(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, rounded to whole texts. Texts without words are never taken; null sources are a
    source; equal rows are taken together."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes: a text without words is one empty piece; copies of a text never share a sequence."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("minhash_near_dedup", without_near_duplicates),
    ("mixing", mixed),
    ("packing", packed),
]

#: Toxicity is learned: no SQL gives it. tests/llm/test_pipeline.py runs the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        let_go()
    return docs
