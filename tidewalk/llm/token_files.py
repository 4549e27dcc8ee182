"""Token ids in bit-packed files.

A file (a shard) holds the ids of its documents one after another, each in the fewest bits that the vocabulary needs. Ids are packed in blocks of
BLOCK ids, which end at a byte; the file says where each block begins and with which id each document begins. So any run of ids is read by
fetching the blocks that cover it, and a block is unpacked by numpy at once.

    magic, width (u32), ids in a block (u32) | blocks | begin of each block, and of what follows (u64) | begin of each document, in ids (u64)
    | document ids (an Arrow stream, any type) | begin of the three tables (u64 each), documents, ids (u64), magic

Numbers are little-endian; bit i of an id is the i-th of its bits, counted from the lowest of the first byte.

Rows are dealt out by ranges of document ids (sampled splitters; the place of the row parts ties, so copies of one id and rows without one don't meet in one
task), sorted, encoded and written where they are; a task holds one block and the begins of its documents. Each attempt of a task writes a file of
its own name and reports it. What the attempts that counted have reported, a row for each file, is written as the manifest, last of all: a reader sees
a whole set of files or none, and what lost attempts have left is never read. Files are reached through pyarrow's file systems, by the URI of the folder.

Defined results: null and empty texts are the end id alone; rows without an id come first; rows that share an id are kept each, in the order in which the
table has them; very long texts are one document like others; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .packing import Encoder, encoder

MAGIC = b"TWBITS01"
HEAD, TAIL = struct.Struct("<8sII"), struct.Struct("<QQQQQ8s")
BLOCK = 1 << 13
END_ID = 0
#: Bytes of text that go to one file, about.
SHARD_BYTES = 64 << 20
#: Ids that a reader of whole files unpacks at once, about.
IDS_AT_ONCE = 1 << 20
MANIFEST = "shard long, path string, first long, n_ids long, n_docs long, bytes long"


def width_of(vocabulary: int) -> int:
    """Bits that the ids 0 .. vocabulary - 1 need."""
    return max(1, (vocabulary - 1).bit_length())


def packed(ids: np.ndarray, width: int) -> bytes:
    """ids in width bits each."""
    if len(ids) and int(ids.max()) >> width:
        raise ValueError(f"an id doesn't fit in {width} bits")
    if width in (8, 16, 32):  # whole bytes: the same bits
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(len(ids), 4), axis=1, bitorder="little")[:, :width]
    return np.packbits(bits.ravel(), bitorder="little").tobytes()


def unpacked(data: bytes, n: int, width: int) -> np.ndarray:
    """The first n ids of width bits each."""
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", n).astype("<u4")
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    out = np.zeros((n, 32), np.uint8)
    out[:, :width] = bits
    return np.packbits(out, axis=1, bitorder="little").view("<u4").ravel()


class ShardWriter:
    """Writes documents one by one; holds less than a block of ids and the documents' begins."""

    def __init__(self, out, width: int, kind: pa.DataType, block: int = BLOCK):
        if block % 8:
            raise ValueError("a block ends at a byte")
        self.out, self.width, self.kind, self.block = out, width, kind, block
        self.begins, self.docs, self.doc_ids, self.n_ids = [HEAD.size], [0], [], 0
        self.open = np.zeros(0, "<u4")
        out.write(HEAD.pack(MAGIC, width, block))

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.n_ids += len(ids)
        self.docs.append(self.n_ids)
        held = np.concatenate([self.open, ids])
        whole = len(held) // self.block * self.block
        for at in range(0, whole, self.block):
            self._block(held[at : at + self.block])
        self.open = held[whole:]

    def _block(self, ids: np.ndarray) -> None:
        data = packed(ids, self.width)
        self.out.write(data)
        self.begins.append(self.begins[-1] + len(data))

    def close(self) -> int:
        """Writes the tables; the file's size."""
        if len(self.open):
            self._block(self.open)
        sink = pa.BufferOutputStream()
        column = pa.array(self.doc_ids, self.kind)
        with pa.ipc.new_stream(sink, pa.schema([("doc_id", self.kind)])) as stream:
            stream.write_batch(pa.RecordBatch.from_arrays([column], ["doc_id"]))
        tables = [np.array(self.begins, "<u8").tobytes(), np.array(self.docs, "<u8").tobytes(), sink.getvalue().to_pybytes()]
        at, places = self.begins[-1], []
        for table in tables:
            places.append(at)
            self.out.write(table)
            at += len(table)
        self.out.write(TAIL.pack(*places, len(self.doc_ids), self.n_ids, MAGIC))
        self.out.close()
        return at + TAIL.size


class Shard:
    """A file, opened for random access."""

    def __init__(self, path: str):
        store, place = fs.FileSystem.from_uri(path)
        self.file = store.open_input_file(place)
        size = self.file.size()
        at, docs, ids, n_docs, self.n_ids, end = TAIL.unpack(self.file.read_at(TAIL.size, size - TAIL.size))
        start, self.width, self.block = HEAD.unpack(self.file.read_at(HEAD.size, 0))
        if start != MAGIC or end != MAGIC:
            raise ValueError(f"{path} isn't a whole file of ids")
        self.begins = np.frombuffer(self.file.read_at(docs - at, at), "<u8").astype(np.int64)
        self.docs = np.frombuffer(self.file.read_at(8 * (n_docs + 1), docs), "<u8").astype(np.int64)
        self.doc_ids = pa.ipc.open_stream(self.file.read_at(size - TAIL.size - ids, ids)).read_all().column(0).combine_chunks()

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids start .. end - 1 of the file; only the blocks that cover them are read."""
        if start >= end:
            return np.zeros(0, "<u4")
        a, b = start // self.block, -(-end // self.block)
        data = self.file.read_at(int(self.begins[b] - self.begins[a]), int(self.begins[a]))
        return unpacked(data, min(b * self.block, self.n_ids) - a * self.block, self.width)[start - a * self.block : end - a * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.docs[i]), int(self.docs[i + 1]))

    def runs(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first document, end document, their ids) of runs of about IDS_AT_ONCE ids."""
        a = 0
        while a < len(self.doc_ids):
            b = max(a + 1, int(np.searchsorted(self.docs, self.docs[a] + IDS_AT_ONCE, "right")) - 1)
            yield a, b, self.ids(int(self.docs[a]), int(self.docs[b]))
            a = b


def write(docs: DataFrame, folder: str, encode: Encoder | None = None, vocabulary: str | None = None, text: str = "text", id_col: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """Writes the table's ids to a new folder, files in ascending order of document ids; returns the manifest, which is written there as well."""
    spark = docs.sparkSession
    common.shipped(spark)
    encode = encode or encoder(vocabulary)
    width = width_of(_vocabulary_size(vocabulary))
    n = max(common.shuffle_partitions(spark), -(-_bytes(docs, text) // SHARD_BYTES))
    store, place = fs.FileSystem.from_uri(folder)
    store.create_dir(place, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, shard = None, TaskContext.get().partitionId()
        path = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.bits"
        for batch in batches:
            if writer is None and batch.num_rows:
                store, place = fs.FileSystem.from_uri(path)
                writer = ShardWriter(store.open_output_stream(place), width, batch.schema.field(0).type, block)
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(value.as_py() or "")
                ids[-1] = END_ID
                writer.add(doc_id, ids)
        if writer is not None:
            size = writer.close()
            row = [[shard], [path], [0], [writer.n_ids], [len(writer.doc_ids)], [size]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in row], ["shard", "path", "first", "n_ids", "n_docs", "bytes"])

    rows, number = common.numbered(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")))
    dealt = rows.repartitionByRange(n, "doc_id", number).sortWithinPartitions("doc_id", number).select("doc_id", "text")
    # what the tasks report: one row for each file, which is what a commit needs to know
    files = sorted(tuple(r) for r in dealt.mapInArrow(run, MANIFEST).collect())
    first = np.concatenate([[0], np.cumsum([f[3] for f in files])]).tolist()
    manifest = spark.createDataFrame([(f[0], f[1], first[i], *f[3:]) for i, f in enumerate(files)], MANIFEST)
    manifest.coalesce(1).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def _bytes(docs: DataFrame, text: str) -> int:
    return docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0


def _vocabulary_size(vocabulary: str | None) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary or public_tokenizers.path("byte_bpe_50k.json")).get_vocab_size()


def digests(spark: SparkSession, folder: str, kind: str = "long") -> DataFrame:
    """Per document, from the files: doc_id (of the type kind), start, n_tokens, ids_crc32, and the file's number as shard."""
    common.shipped(spark)
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "shard"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, path, first in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                shard = Shard(path)
                for a, b, ids in shard.runs():
                    cuts = shard.docs[a : b + 1]
                    sums = [zlib.crc32(ids[i:j].tobytes()) for i, j in zip((cuts[:-1] - cuts[0]).tolist(), (cuts[1:] - cuts[0]).tolist(), strict=True)]
                    columns = [pa.array(first + cuts[:-1]), pa.array(np.diff(cuts)), pa.array(sums, pa.int64()), pa.array(np.full(b - a, number))]
                    yield pa.RecordBatch.from_arrays([shard.doc_ids.slice(a, b - a), *columns], names)

    return manifest.select("shard", "path", "first").repartitionByRange(max(1, manifest.count()), "shard").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in names[1:]))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    folder = f"{common.shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    write(docs, folder)
    out = common.written(digests(spark, folder, docs.schema["doc_id"].dataType.simpleString()), "digests")
    common.deleted(spark, folder)  # the query returns what it has read back; `write` is for those who want the files
    return out.select("doc_id", "start", "n_tokens", "ids_crc32")
