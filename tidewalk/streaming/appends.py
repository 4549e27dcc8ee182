"""Incremental runs: the study has no event-time streams, only folds that are appended and taken up again.

A file stream of predictions is written batch by batch with the batch sink, partitioned by batch and fold: a batch that is delivered twice replaces its own
partitions and changes nothing, and a fold may come in any number of batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..sources import tables


def prediction_stream(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).parquet(folder)


def append_stream(stream: DataFrame, path: str, checkpoint: str, fold: str = "fold", batch: str = "batch_id") -> StreamingQuery:
    """Writes all files that are there, then ends; a later call with the same checkpoint goes on where this one stopped."""

    def write(rows: DataFrame, number: int) -> None:
        tables.write_parts(rows.withColumn(batch, F.lit(number)), path, batch, fold)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
