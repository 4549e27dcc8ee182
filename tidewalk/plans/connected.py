"""Queries through the engine's own sources and sinks: a called source, transactions, matrix files, chunks of embeddings."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import vocabulary
from ..sources import connectors, feeds, tables
from . import operations, study, textual
from .study import P_SQL

R = X.rounded
QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


@query(operations.ORACLES["fetch_chunks"])
def source_chunks(spark: SparkSession, d: str) -> DataFrame:
    """A wide source read by spark.read.format: a partition asks for two variables; each call is refused once."""
    path, tables_ = f"{tables.scratch(spark)}/areas", study.areas(spark, d)
    tables_.write.parquet(path)
    names = ["n", "mean_balance", "mean_amount", "share_urgent", "share_building"]
    asked: list[tuple] = []

    def fetch(some: list[str]):
        if tuple(some) not in asked:
            asked.append(tuple(some))
            raise feeds.Busy
        from pyarrow import dataset, fs

        store, place = fs.FileSystem.from_uri(path)
        for batch in dataset.dataset(place, filesystem=store, format="parquet").to_batches(columns=["area", *some]):
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    tables.shipped(spark)
    spark.dataSource.register(connectors.call_source("areas", fetch, wait=lambda s: None))
    long = spark.read.format("areas").option("variables", ",".join(names)).option("chunk", 2).load()
    out = connectors.wide(long, names, {"n": "loans"})
    return out.select(F.col("key").alias("area"), F.col("loans").cast("long").alias("loans"), *names[1:])


@query(f"WITH {P_SQL} SELECT fold, model, arm, count(*) AS n, count(DISTINCT id) AS n_ids FROM p GROUP BY ALL")
def ledger_folds(spark: SparkSession, d: str) -> DataFrame:
    """Folds in transactions: two, the same again, one whose tasks fail halfway, then all that no mark says are complete."""
    rows, path = study.predictions(spark, d), f"{tables.scratch(spark)}/ledger"
    some = rows.where("fold <= 2")
    for _ in range(2):
        connectors.append(some, path, "folds 1-2", (1, 2))
    try:
        connectors.append(rows.where("fold = 3").withColumn("area", F.when(F.col("id") % 7 == 3, F.raise_error(F.lit("stopped"))).otherwise(F.col("area"))), path, "folds 3-", (3,))
    except Exception as e:  # whatever kind of error the task's failure comes up as
        if "stopped" not in str(e):
            raise
    done = {int(m) for m in connectors.marks(spark, path)}
    left = [r["fold"] for r in study.fold_table(spark, d).select("fold").collect() if r["fold"] not in done]
    connectors.append(rows.where(F.col("fold").isin(left)), path, "folds 3-", tuple(left))
    return connectors.read(spark, path, rows.schema).groupBy("fold", "model", "arm").agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_ids"))


@query(operations.ORACLES["sparse_round_trip"])
def matrix_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """TF-IDF rows as compressed-row matrices in numpy's archive format with their vocabulary, read back by binaryFile."""
    path = tables.scratch(spark)
    rows, words = textual._sparse(spark, d)
    terms = words.orderBy("column").toArrow()["term"].to_pylist()
    connectors.write_matrix(rows, terms, path, 512)
    back, terms = connectors.read_matrix(spark, path)
    names = vocabulary.numbered(pa.table({"term": pa.array(terms, pa.string())}), spark)
    return tables.long_rows(back, names, "id", "term", "tfidf").withColumn("tfidf", R("tfidf"))
