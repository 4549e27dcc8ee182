"""Exact deduplication by content sort (DataFrame operations only).

Texts are compared without blanks. Sampled splitters (Spark's range partitioner) deal the rows out by the first
bytes of the normalised text, then a hash of it; an external sort within each partition places equal texts side by side, and a window compares
neighbours' whole texts. A text that holds more than a partition's share of the rows gets salts, as many as it
needs, so that no group of copies lies in one task; the few winners of a salted text (one for each salt) are compared once more. The salt comes
from the id and the partition that the row was read in, so copies without ids, or with one and the same, are split as well.
The splitters see at most KEY_CHARS characters of a text, so the sample is small whatever the texts' lengths.

Defined results: null text counts as empty; the row with the most code points in the original text stays, then
the smallest doc_id (null before all others), then any one of fully equal rows; an empty table gives no rows; other columns stay out of
the comparison and, in `winners`, in the result, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

KEY_CHARS = 32
#: Rows of one text from which it is salted, at least.
LEAST_HOT = 64


def _salted(docs: DataFrame, text: str, id_col: str) -> tuple[DataFrame, int]:
    """docs with norm, len, hash and salts (1 for all but the hot texts), and the number of partitions."""
    parts = common.shuffle_partitions(docs.sparkSession)
    rows = docs.withColumn("__norm", common.squeezed(F.col(text))).withColumn("__len", F.length(F.coalesce(F.col(text), F.lit(""))).cast("long"))
    rows = rows.withColumn("__hash", F.xxhash64("__norm"))
    least = max(LEAST_HOT, docs.count() // (4 * parts))
    # at most 4 * parts texts can have that many rows, so the table below is small enough to broadcast
    hot = rows.groupBy("__hash").agg(F.count("*").alias("n")).where(F.col("n") > least)
    hot = hot.select("__hash", F.ceil(F.col("n") / least).alias("__salts"))
    rows = rows.join(F.broadcast(hot), "__hash", "left").withColumn("__salts", F.coalesce("__salts", F.lit(1).cast("long")))
    salt = F.pmod(F.xxhash64(F.col(id_col), F.lit("salt")) + F.spark_partition_id(), "__salts")
    return rows.withColumn("__salt", salt).withColumn("__key", F.substring("__norm", 1, KEY_CHARS)), parts


def _sorted(rows: DataFrame, parts: int, id_col: str) -> tuple[DataFrame, Window]:
    """Range-partitioned rows with their place among equals of the same salt."""
    place = ["__key", "__hash", "__salt"]
    equals = Window.partitionBy(*place, "__norm")
    ranked = equals.orderBy(F.desc("__len"), F.asc_nulls_first(id_col))
    rows = rows.repartitionByRange(parts, *place).withColumn("__rank", F.row_number().over(ranked))
    return rows, equals


def winners(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows that stay, with all their columns. Hot texts and the others are sorted apart, so each row is shuffled and read once."""
    # whatever the input's columns are called, they travel as one
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"), docs[id_col].alias("doc_id"), docs[text].alias("__text"))
    rows, parts = _salted(whole, "__text", "doc_id")
    rows = rows.drop("__text")
    cold, hot = (_sorted(rows.where(c), parts, "doc_id")[0].where("__rank = 1") for c in ("__salts = 1", "__salts > 1"))
    again = Window.partitionBy("__norm").orderBy(F.desc("__len"), F.asc_nulls_first("doc_id"))
    hot = hot.withColumn("__rank", F.row_number().over(again)).where("__rank = 1")
    return cold.select("__row.*").unionByName(hot.select("__row.*"))


def groups(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256."""
    rows, parts = _salted(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("__text")), "__text", "doc_id")
    rows, equals = _sorted(rows.select("doc_id", "__norm", "__len", "__hash", "__salts", "__salt", "__key"), parts, "doc_id")
    best = F.struct((-F.col("__len")).alias("less"), F.col("doc_id").isNotNull().alias("known"), F.col("doc_id").alias("id"))
    rows = rows.withColumn("__best", F.min(best).over(equals)).withColumn("__n", F.count("*").over(equals))
    slim = common.written(
        rows.select("doc_id", "__best", "__n", "__salts", "__salt", "__rank", F.sha2("__norm", 256).alias("text_sha256"), F.when((F.col("__salts") > 1) & (F.col("__rank") == 1), F.col("__norm")).alias("__norm")), "sorted",
    )
    # one row for each salt of a hot text, at most 8 * parts rows in all
    hot = slim.where("__norm is not null").groupBy("__norm", "text_sha256").agg(
        F.min(F.struct("__best", "__salt")).alias("top"), F.sum("__n").alias("all"),
    ).select("text_sha256", F.col("top.__best").alias("top_best"), F.col("top.__salt").alias("top_salt"), "all")
    out = slim.drop("__norm").join(F.broadcast(hot), "text_sha256", "left")
    best, here = F.coalesce("top_best", "__best"), F.coalesce(F.col("top_salt") == F.col("__salt"), F.lit(True))
    return out.select("doc_id", best["id"].alias("keep_id"), F.coalesce("all", "__n").alias("group_size"), (here & (F.col("__rank") == 1)).alias("kept"), "text_sha256")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(common.table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER best = 1 AS kept, sha256(t) AS text_sha256
FROM d WINDOW best AS (PARTITION BY t ORDER BY n DESC, doc_id)
"""
