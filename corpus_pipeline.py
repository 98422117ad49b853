"""The corpus pipeline: quality, near-duplicates, repeated passages, packing.

Every stage is written as Parquet in the shared folder and read again by the next, so
that executors lost in one don't repeat the ones before.

Defined cases, in every stage: null, empty and very long texts are judged and kept or packed
like others (a null text counts as empty); repeated rows are one document to the stage of near
duplicates, which keeps one (and every text of an id that has several), and rows of their own
to the others; rows without id stay unless
their text is rejected or cut; other columns, of whatever names, pass through all stages but
the last; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomspan.llm.order_minhash import one_of_each
from loomspan.llm.packing import digests, pack_documents
from loomspan.llm.quality import accepted
from loomspan.llm.repeated_spans import remove_repeats
from loomspan.llm.shared import table
from loomspan.llm.tokens import default_tokenizer


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality discriminant accepts."""
    return accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that an earlier place repeats."""
    return remove_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents packed into sequences."""
    return digests(pack_documents(docs, default_tokenizer()))


STAGES = [
    ("quality classifier", quality),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("packing", packing),
]

#: SQL can express none of the stages; a test holds the whole run to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
