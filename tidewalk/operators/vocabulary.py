"""Words of texts counted in arrays where the texts are: what term statistics need of a document leaves its task once, and texts never travel.

A batch of texts is cut into words as bytes, its different words are numbered, and everything after works on numbers. Words are longest runs of a-z and A-Z.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..sources import tables

#: Bytes of texts that are counted at once, about.
AT_ONCE = 1 << 25
#: Terms of a vocabulary that is broadcast; larger ones are joined.
MOST_KNOWN = 1 << 22
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def _slices(text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, offsets from 0, bytes) of about AT_ONCE bytes; a longer text comes alone."""
    text = text.cast(pa.large_string()).fill_null("")
    n = len(text)
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + n + 1] if n else np.zeros(1, np.int64)
    data, a = np.frombuffer(text.buffers()[2] or b"", np.uint8), 0
    while a < n:
        b = min(max(int(np.searchsorted(offsets, offsets[a] + AT_ONCE, "right")) - 1, a + 1), n)
        yield a, b, offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]]
        a = b


def _words(offsets: np.ndarray, data: np.ndarray, least: int, stop: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row and number of each word of `least` letters that is no stop word, and the words by number."""
    m = _LETTER[data]
    before, after = np.zeros(len(m), bool), np.zeros(len(m), bool)
    before[1:], after[:-1] = m[:-1], m[1:]
    edges = offsets[1:-1]  # no word runs on into the next text
    before[edges[edges < len(m)]] = False
    after[edges[edges > 0] - 1] = False
    starts, ends = np.flatnonzero(m & ~before), np.flatnonzero(m & ~after) + 1
    long = ends - starts >= least
    starts, ends = starts[long], ends[long]
    inside = np.zeros(len(m) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    joined = data[np.cumsum(inside[:-1], dtype=np.int8) > 0]
    places = np.concatenate([[0], np.cumsum(ends - starts)])
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(places.astype(np.int64)), pa.py_buffer(joined)).dictionary_encode()
    code, names = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary
    row = np.searchsorted(offsets, starts, "right") - 1
    if len(stop):
        kept = ~pc.is_in(names, value_set=stop).to_numpy(zero_copy_only=False)[code] if len(code) else np.zeros(0, bool)
        row, code = row[kept], code[kept]
    return row, code, names


def _cells(offsets: np.ndarray, data: np.ndarray, least: int, stop: pa.Array, bigrams: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Row, term's number and tf of each row's different terms, in order of row; the terms by number."""
    row, code, names = _words(offsets, data, least, stop)
    if bigrams and len(code):
        both = row[1:] == row[:-1]
        pair, which = pd.factorize(code[:-1][both] * len(names) + code[1:][both])
        row, code = np.concatenate([row, row[1:][both]]), np.concatenate([code, len(names) + pair])
        names = pa.concat_arrays([names, pc.binary_join_element_wise(names.take(pa.array(which // len(names))), names.take(pa.array(which % len(names))), pa.scalar(" ", pa.large_string()))])
    cell, tf = np.unique(row * max(len(names), 1) + code, return_counts=True)
    return *np.divmod(cell, max(len(names), 1)), tf, names


def _run(rows: DataFrame, text: str, schema: str, least: int, stop: tuple[str, ...], bigrams: bool, made: Callable) -> DataFrame:
    """What `made` (rows of the batch without its text, row, term's number, tf, terms by number) gives, slice by slice."""
    tables.shipped(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no = pa.array(stop, pa.large_string())
        for batch in batches:
            keys = [batch.column(i) for i in range(batch.num_columns - 1)]
            for a, b, offsets, data in _slices(batch.column(batch.num_columns - 1)):
                yield from made([k.slice(a, b - a) for k in keys], *_cells(offsets, data, least, no, bigrams))

    return rows.mapInArrow(run, schema)


#: Rows of a batch that goes back.
ROWS = 1 << 18


def _described(rows: DataFrame, *columns: str) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.select(*columns).schema)


def counted(rows: DataFrame, key: str, text: str, stop: tuple[str, ...] = (), bigrams: bool = True, keep: tuple[str, ...] = (), least: int = 3) -> DataFrame:
    """key, the kept columns, term, tf: the different terms of each row."""

    def made(keys: list[pa.Array], row: np.ndarray, code: np.ndarray, tf: np.ndarray, names: pa.Array) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(row), ROWS):
            at, own = pa.array(row[a : a + ROWS]), pa.array(code[a : a + ROWS])
            yield pa.RecordBatch.from_arrays([*[k.take(at) for k in keys], names.take(own).cast(pa.string()), pa.array(tf[a : a + ROWS])], [key, *keep, "term", "tf"])

    return _run(rows.select(key, *keep, text), text, _described(rows, key, *keep) + "term string, tf long", least, stop, bigrams, made)


def frequencies(rows: DataFrame, text: str, stop: tuple[str, ...] = (), bigrams: bool = True, least: int = 3) -> DataFrame:
    """term, df: in how many rows each term stands. Rows are counted where they are; one row for each slice and term travels."""

    def made(keys: list, row: np.ndarray, code: np.ndarray, tf: np.ndarray, names: pa.Array) -> Iterator[pa.RecordBatch]:
        df = np.bincount(code, minlength=len(names))
        used = np.flatnonzero(df)
        for a in range(0, len(used), ROWS):
            own = used[a : a + ROWS]
            yield pa.RecordBatch.from_arrays([names.take(pa.array(own)).cast(pa.string()), pa.array(df[own])], ["term", "n"])

    return _run(rows.select(text), text, "term string, n long", least, stop, bigrams, made).groupBy("term").agg(F.sum("n").alias("df"))


def known(weights: DataFrame) -> pa.Table | None:
    """A vocabulary (term, idf) in order of term, or None if it is too large to be broadcast."""
    found = weights.select("term", "idf").limit(MOST_KNOWN + 1).toArrow()
    return found.sort_by("term") if found.num_rows <= MOST_KNOWN else None


def weighted(rows: DataFrame, key: str, text: str, vocabulary: pa.Table, stop: tuple[str, ...] = (), least: int = 3) -> DataFrame:
    """key, columns (ascending places in the vocabulary), tfs, values: sublinear tf times idf of each row's words, l2-normalised. Rows without any known word are left out."""
    schema = _described(rows, key) + "columns array<int>, tfs array<long>, values array<double>"
    sent = rows.sparkSession.sparkContext.broadcast((vocabulary["term"].combine_chunks().cast(pa.large_string()), vocabulary["idf"].to_numpy()))

    def made(keys: list[pa.Array], row: np.ndarray, code: np.ndarray, tf: np.ndarray, names: pa.Array) -> Iterator[pa.RecordBatch]:
        terms, idf = sent.value
        place = pc.index_in(names, value_set=terms).fill_null(-1).to_numpy(zero_copy_only=False)[code].astype(np.int64)
        there = place >= 0
        row, place, tf = row[there], place[there], tf[there]
        if not len(row):
            return
        by = np.argsort(row * len(terms) + place)
        row, place, tf = row[by], place[by], tf[by]
        starts = np.concatenate([[0], np.flatnonzero(np.diff(row)) + 1])
        w = (1 + np.log(tf)) * idf[place]
        sizes = np.diff(np.concatenate([starts, [len(row)]]))
        w /= np.repeat(np.sqrt(np.add.reduceat(w * w, starts)), sizes)
        offsets = pa.array(np.concatenate([starts, [len(row)]]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (place.astype(np.int32), tf.astype(np.int64), w)]
        yield pa.RecordBatch.from_arrays([k.take(pa.array(row[starts])) for k in keys] + lists, [key, "columns", "tfs", "values"])

    return _run(rows.select(key, text), text, schema, least, stop, False, made)


def named(weighted_: DataFrame, vocabulary: pa.Table, key: str) -> DataFrame:
    """key, term, tf, tfidf of weighted rows, by a broadcast vocabulary."""
    names = numbered(vocabulary, weighted_.sparkSession)
    cells = weighted_.select(key, F.inline(F.arrays_zip("columns", "tfs", "values"))).toDF(key, "column", "tf", "tfidf")
    return cells.join(F.broadcast(names), "column").select(key, "term", "tf", "tfidf")  # at most MOST_KNOWN terms


def with_terms(weighted_: DataFrame, vocabulary: pa.Table) -> DataFrame:
    """The weighted rows with their terms, in order of name, beside the columns."""
    spark, schema = weighted_.sparkSession, weighted_.schema
    sent = spark.sparkContext.broadcast(vocabulary["term"].combine_chunks().cast(pa.large_string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.column("columns")
            terms = pa.ListArray.from_arrays(_offsets(columns), sent.value.take(columns.flatten()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, terms], [*batch.schema.names, "terms"])

    return weighted_.mapInArrow(run, StructType([*schema.fields, StructField("terms", ArrayType(StringType()))]))


def _offsets(lists: pa.Array) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int32))


def numbered(vocabulary: pa.Table, spark: SparkSession) -> DataFrame:
    """term, column: each term's place in the vocabulary."""
    return spark.createDataFrame(pa.table({"term": vocabulary["term"], "column": pa.array(np.arange(vocabulary.num_rows, dtype=np.int32))}))


def unique(rows: DataFrame, key: str) -> bool:
    """Whether no key is repeated."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").isEmpty()
