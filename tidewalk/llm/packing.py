"""Harmonic packing of token sequences.

Lengths fall into reciprocal-capacity classes: class j holds pieces longer than C / (j + 1) and at most C / j, and each of its
bins takes exactly j pieces. Documents may be cut, so a document is cut to pieces that (nearly) fill such shares: whole
capacities first, then greedily the largest C / j that fits, until the rest is short or fits its class well.
Workers number the pieces of each class on their own; the counts of each worker and class, summed up, turn these numbers into
bins, so filling needs no common task. Only the last, incomplete bin of each class is repacked, first fit by decreasing length:
fewer than j pieces of each class, however large the input.

Ids are those of the byte-level BPE vocabulary, computed by a faster library from the same vocabulary's rank file; texts that it
can't take go through the first library. The driver reads the files and ships their bytes.

Defined results: a null or empty text is the end id alone; rows that share a doc_id (or have none) are packed each for itself, repeated rows alike; very long
texts are cut like others; sequences are numbered from 0; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

CAPACITY = 2048
END_ID = 1
#: A rest of at most so many tokens isn't cut further, nor one that fills such a share of its class's bins.
SHORT, FULL = 64, 0.97
ROWS_AT_ONCE = 256


def cuts(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of a document's pieces."""
    out, rest = [capacity] * (n // capacity), n % capacity
    while rest:
        if rest <= SHORT or rest * (capacity // rest) >= FULL * capacity:
            out.append(rest)
            break
        out.append(capacity // -(-capacity // rest))
        rest -= out[-1]
    return out


class Encoder:
    """Ids of texts; made on each worker from the vocabulary's files."""

    def __init__(self, ranks: bytes, vocabulary: bytes):
        self.ranks, self.vocabulary, self.fast, self.slow = ranks, vocabulary, None, None

    def __getstate__(self):
        return self.ranks, self.vocabulary

    def __setstate__(self, state):
        self.__init__(*state)

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is None:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.ranks.splitlines())}
            self.fast = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})
        try:
            return np.array([*self.fast.encode(text, allowed_special="all"), END_ID], "<u4")
        except BaseException as e:
            if type(e).__name__ != "PanicException":  # the library's own error, which isn't an Exception and has no importable name
                raise
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_buffer(self.vocabulary)
            return np.array([*self.slow.encode(text, add_special_tokens=False).ids, END_ID], "<u4")


def encoder(vocabulary: str | None = None, ranks: str | None = None) -> Encoder:
    with open(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as a, open(vocabulary or public_tokenizers.path("byte_bpe_50k.json"), "rb") as b:
        return Encoder(a.read(), b.read())


def pieces(docs: DataFrame, encode: Encoder, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, class, and the piece's number (from 0) among those of its class and worker."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "worker", "number"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker, counts = TaskContext.get().partitionId(), np.zeros(CAPACITY + 1, np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                out, which = [], []
                for i, t in enumerate(batch.column(1).to_pylist()):
                    ids, start = encode(t or ""), 0
                    for n in cuts(len(ids)):
                        j = CAPACITY // n
                        out.append((start, n, zlib.crc32(ids[start : start + n].tobytes()), len(ids), j, worker, counts[j]))
                        which.append(i)
                        counts[j] += 1
                        start += n
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which, pa.int64())), *[pa.array(c, pa.int64()) for c in np.array(out, np.int64).reshape(-1, 7).T]], names)

    return rows.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in names[1:]))


def first_fit(left: pd.DataFrame) -> pd.DataFrame:
    """Bins (from 0) of the pieces that no whole bin of their class has taken, by decreasing length."""
    left = left.sort_values(["length", "doc_id", "start", "bin"], ascending=[False, True, True, True], ignore_index=True)
    by_room: list[list[int]] = [[] for _ in range(CAPACITY + 1)]  # bins by the room that is left
    bins, made = np.zeros(len(left), np.int64), 0
    for i, n in enumerate(left["length"].tolist()):
        room = next((r for r in range(n, CAPACITY) if by_room[r]), CAPACITY)
        if room == CAPACITY:
            made += 1
        bins[i] = by_room[room].pop() if room < CAPACITY else made - 1
        by_room[room - n].append(int(bins[i]))
    return left.assign(bin=bins)


def packed(docs: DataFrame, encode: Encoder | None = None, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    cut = common.written(pieces(docs, encode or encoder(), text, id_col), "pieces")
    counts = cut.groupBy("class", "worker").agg(F.count("*").alias("n"))
    before = Window.partitionBy("class").orderBy("worker")
    counts = counts.withColumn("before", F.sum("n").over(before) - F.col("n")).withColumn("total", F.sum("n").over(Window.partitionBy("class")))
    classes = counts.groupBy("class").agg(F.first("total").alias("total")).withColumn("bins", F.expr("total div class"))
    # at most CAPACITY classes
    classes = classes.withColumn("base", F.sum("bins").over(Window.orderBy("class")) - F.col("bins")).withColumn("whole", F.sum("bins").over(Window.partitionBy(F.lit(1))))
    counts = counts.select("class", "worker", "before").join(F.broadcast(classes.select("class", "bins", "base", "whole")), "class")
    placed = cut.join(counts, ["class", "worker"]).withColumn("bin", F.expr("(before + number) div class"))
    shown = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    whole = placed.where("bin < bins").select(*shown, (F.col("base") + F.col("bin")).alias("sequence_id"))
    left = placed.where("bin >= bins").select(*shown, "whole", F.col("class").alias("bin"))
    left = left.groupBy("whole").applyInPandas(first_fit, left.schema)  # one value; fewer than j pieces of class j
    out = whole.unionByName(left.select(*shown, (F.col("whole") + F.col("bin")).alias("sequence_id")))
    place = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    return out.withColumn("offset", F.coalesce(F.sum("length").over(place), F.lit(0).cast("long")))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(common.table(spark, sf_dir, "documents"))
