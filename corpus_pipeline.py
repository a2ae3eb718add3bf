"""The corpus pipeline: five stages from raw documents to packed batches.

Every stage takes all that its predecessor kept. ``run`` stores each stage's rows as Parquet in the shared folder before the next one reads them, so
an executor that is lost costs one stage's tasks at most. Rows without doc_id pass the stages that compare documents unchanged.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from pageledger.llm import decontamination, near, packing, passages, quality_rules
from pageledger.llm.common import has_repeats, table
from pageledger.session import drop_tables, materialize, tables_made

_scratch: list[str] = []


def stage(fn: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage starts by deleting what the stage before stored for itself: that stage's result has been written by then."""

    @wraps(fn)
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_tables(spark, _scratch)
        before = len(tables_made)
        out = fn(spark, docs, sf_dir)
        _scratch[:] = tables_made[before:]
        return out

    return call


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    return quality_rules.passed(docs)


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (runs of five words, similarity 0.8) the document with the smallest doc_id stays."""
    # stored, so that Spark sees its size and moves the texts only if it is too large to send to all
    gone = materialize(near.near_classes(docs, n=5, percent=80).where("NOT kept AND doc_id IS NOT NULL").select("doc_id").distinct())
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    return left.dropDuplicates(["doc_id", "text"]) if has_repeats(docs) else left


@stage
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All but the first copy of a repeated passage of 50 words or more is cut from the texts; a text that loses all its words stays, empty."""
    cut = passages.without_passages(docs, passages.repeated_passages(docs))
    return cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


@stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, as it is or with other values, go."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's bucket, batch and slot."""
    return packing.packed(docs)


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_dedup),
    ("substring dedup", substring_dedup),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: No stage but the first can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES:
        docs = materialize(step(spark, docs, sf_dir))
    return docs
