"""What the two text classifiers share: bounded training samples, and scoring of Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common


def bucket(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % parts


def training_rows(docs: DataFrame, labels: DataFrame, label: str, learn: Column, most: int, text: str = "text", id_col: str = "doc_id") -> pd.DataFrame:
    """At most `most` labelled rows (those with the smallest hashes of their ids), in order of id.

    The ids are chosen from the labels alone, so the documents are read once and only the chosen texts travel.
    """
    chosen = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & learn).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # where ids repeat, the longest text and then the smallest speaks for the id
    picked = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct(-F.length("text"), "text", "y")).alias("x"))
    return picked.select("doc_id", F.col("x.text").alias("text"), F.col("x.y").alias("y")).toPandas().sort_values("doc_id", ignore_index=True)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


Margins = Callable[[np.ndarray, np.ndarray], np.ndarray]


def margins_of(batch: pa.RecordBatch, name: str, margins: Margins) -> np.ndarray:
    out = np.zeros(batch.num_rows)
    for first, end, data, offsets in common.text_slices(batch.column(batch.schema.get_field_index(name))):
        out[first:end] = margins(data, offsets)
    return out


def scored(docs: DataFrame, margins: Margins, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, score, predicted of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = sigmoid(margins_of(batch, "text", margins))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return rows.mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def accepted(docs: DataFrame, margins: Margins, text: str = "text") -> DataFrame:
    """The rows, with all their columns, that the classifier gives label 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(sigmoid(margins_of(batch, text, margins)) >= 0.5))

    return docs.mapInArrow(run, docs.schema)


def by_text(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, offsets) of one text at a time."""
    for text in texts:
        data = np.frombuffer(text.encode(), np.uint8)
        yield data, np.array([0, len(data)])
