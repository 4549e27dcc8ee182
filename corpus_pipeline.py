"""Corpus pipeline: five stages, each over all that its predecessor kept, written as Parquet in between.

Each stage calls one operator of ``tidewalk.llm`` and puts its decisions into effect, row by row, whatever the rows' ids. All but the last return the
columns of documents; the last returns pieces of packed sequences. Every stage takes null texts as empty, keeps rows without ids apart, passes other
columns on unseen, whatever their names, and gives no rows for an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewalk.llm import common, decontaminate, exact_dedup, jaccard_join, packing, quality


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labelled ones, accepts; without labels all have one score, 0.5, and stay."""
    model = quality.trained(docs, common.table(spark, sf_dir, "labels"))
    return quality.classify.accepted(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one that the content sort keeps: the longest, then the smallest id (null first), then any one of fully equal rows."""
    return exact_dedup.winners(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents the one with the smallest id (null last, of equal ids any one); documents without words stay."""
    return jaccard_join.kept(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item; documents without words stay."""
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences; a document without text is its end id alone, repeated documents are packed each for itself."""
    common.shipped(spark)
    return packing.packed(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("packing", pack),
]

#: The first and the last stage can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
