"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import ctypes
import gc
import hashlib
import shutil
import tempfile
import time
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Everything but ASCII digits, lower-case ASCII letters and non-ASCII characters ends a word.
WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Characters that a normalised text leaves out.
BLANKS = (" ", "\t", "\n", "\x0b", "\f", "\r")


#: Rows of an Arrow batch at most, and the session's setting that says so: rows hold whole texts, and a batch stands in memory on both sides at once.
TEXTS_AT_ONCE, AT_ONCE = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def shipped(spark: SparkSession) -> None:
    """Gives the package's modules to the executors, once for each session, so that they need no installation there; bounds the session's Arrow batches."""
    context, top = spark.sparkContext, Path(__file__).resolve().parents[1]
    if not 0 < int(spark.conf.get(AT_ONCE)) <= TEXTS_AT_ONCE:
        spark.conf.set(AT_ONCE, TEXTS_AT_ONCE)
    if getattr(context, "_tidewalk_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="tidewalk-")  # the driver's file server reads it as long as the session lasts
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = f"{folder}/{top.name}-modules.zip"
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(top.rglob("*.py")):
            out.write(file, str(file.relative_to(top.parent)))
    context.addPyFile(path)
    context._tidewalk_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    shipped(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number for each row in a column of a name that docs hasn't yet.

    The number is the row's partition and place, so docs must come straight from a table: then each reading gives the same.
    """
    name = "row"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, F.monotonically_increasing_id()), name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of text that one bucket of a grouped pass holds, about; what is made of them is held in arrays of some times that size.
BUCKET_BYTES = 6 << 20


def buckets(docs: DataFrame, text: str) -> int:
    """Number of buckets: one for each shuffle partition, and more where texts are so long that a bucket would outgrow a task."""
    size = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    return max(shuffle_partitions(docs.sparkSession), -(-size // BUCKET_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode, where all share the machine."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or getattr(context, "_tidewalk_shared", None)
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = context._tidewalk_shared = tempfile.mkdtemp(prefix="tidewalk-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    return named


def written(df: DataFrame, what: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    del df
    freed(spark)
    out = spark.read.schema(schema).parquet(path)
    out._scratch = path
    return out


def deleted(spark: SparkSession, folder: str) -> None:
    """Deletes a folder, wherever it is."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that `written` made, once nothing reads them any more."""
    for df in tables:
        deleted(df.sparkSession, df._scratch)


def freed(spark: SparkSession) -> None:
    """Lets the driver's cleaner drop the shuffle files of plans that nothing refers to any more.

    The second round takes what the first one has let go of on the other side of the bridge.
    """
    for pause in (0.3, 0.0):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(pause)
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # what was freed here goes back to the system, where its library can do that
        trim(0)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lower-cased. Null and wordless texts have none.

    Breaks are split off as a whole, so only the first and the last piece can be empty.
    """
    pieces = F.split(ascii_lower(F.coalesce(text, F.lit(""))), WORD_BREAK)
    return F.array_remove(pieces, "")


def squeezed(text: Column) -> Column:
    """The text without blanks (space, tab to carriage return); null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for blank in BLANKS:
        out = F.replace(out, F.lit(blank), F.lit(""))
    return out


def word_positions(rows: DataFrame, *keep: str) -> DataFrame:
    """One row for each word of `words`: the kept columns, `words`, `pos` (from 0); a wordless row stays with pos null.

    `words` is a reference inside one generated stage, so it isn't copied as long as no exchange follows at once.
    """
    return rows.select(*keep, "words", F.posexplode_outer("words").alias("pos", "word"))


def word_at(offset: int) -> Column:
    return F.get(F.col("words"), F.col("pos") + offset)


def gram_hash(k: int) -> Column:
    """64-bit hash of the k words from pos on; null where fewer are left."""
    return F.when(F.col("pos") + k <= F.size("words"), F.xxhash64(*[word_at(i) for i in range(k)]))


# --- vectorised work on Arrow batches -------------------------------------------------------------

#: Odd multiplier of the prefix hashes, its inverse modulo 2**64, and two mixing constants (fixed values).
PRIME = np.uint64(0x9E3779B97F4A7C15)
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash; a bijection."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX1
    x ^= x >> np.uint64(27)
    x *= MIX2
    x ^= x >> np.uint64(31)
    return x


def text_slices(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about `most` bytes; one longer text stays whole.

    Null texts are empty. offsets has one entry more than rows and starts at 0.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(column):
        return
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        end = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        end = min(max(end, first + 1), len(column))
        yield first, end, raw[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def byte_table(kept: str) -> np.ndarray:
    """Flags, by byte, of what belongs to a word: 'solid' (no blank) or 'word' (digits, letters, non-ASCII)."""
    flags = np.ones(256, bool)
    if kept == "solid":
        flags[[0x20, *range(0x09, 0x0E)]] = False
    else:
        flags[:0x30] = flags[0x3A:0x41] = flags[0x5B:0x61] = flags[0x7B:0x80] = False
    return flags


SOLID, WORDY = byte_table("solid"), byte_table("word")
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 0x20
#: A 64-bit value for each byte, so that prefix hashes don't depend on byte distances.
BYTE_VALUE = mixed(np.arange(1, 257, dtype=np.uint64) * PRIME)
#: Other values, for a second hash that collides independently of the first.
OTHER_VALUE = mixed(np.arange(1, 257, dtype=np.uint64) * MIX2)


def powers(n: int, base: np.uint64 = PRIME) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_INVERSE = np.uint64(pow(int(PRIME), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {"up": powers(0), "down": powers(0)}


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        _POWERS["up"], _POWERS["down"] = powers(n), powers(n, _INVERSE)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def prefix_hashes(data: np.ndarray, values: np.ndarray = BYTE_VALUE) -> np.ndarray:
    """Prefix polynomial hashes of bytes: entry i covers data[:i]."""
    up, _ = _grown(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * up, out=out[1:])
    return out


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Prefix polynomial hashes of 64-bit values, for range_hashes."""
    up, _ = _grown(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=out[1:])
    return out


def range_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] for each pair; equal bytes give equal hashes wherever they stand."""
    _, down = _grown(len(prefix))
    return mixed((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64) * MIX1)


def word_spans(data: np.ndarray, offsets: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in data, and for each row the number of its first word (one entry more than rows)."""
    inside = flags[data]
    edge = np.zeros(len(data) + 1, bool)
    if len(data):
        edge[0], edge[-1] = inside[0], False
        edge[1:-1] = inside[1:] & ~inside[:-1]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        edge[cuts] = inside[cuts]  # words don't run on into the next row
    starts = np.flatnonzero(edge)
    stop = np.zeros(len(data) + 1, bool)
    if len(data):
        stop[-1] = inside[-1]
        stop[1:-1] = inside[:-1] & ~inside[1:]
        stop[cuts] = inside[cuts - 1]
    return starts, np.flatnonzero(stop), np.searchsorted(starts, offsets)


#: Bytes of a word that are hashed by table; longer words get a cryptographic hash.
LANES = 48
#: A value for each place in a word and each byte: no two words of equal length have equal sums but by chance of 2^-64.
LANE_VALUE = mixed(np.arange(1, LANES * 256 + 1, dtype=np.uint64) * PRIME)


def word_hashes(data: np.ndarray, offsets: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (A-Z lower-cased) of all rows, and each row's first word."""
    folded = FOLD[data]
    starts, ends, rows = word_spans(folded, offsets, flags)
    if not len(starts):
        return np.zeros(0, np.uint64), rows
    place = np.arange(starts[0], len(folded), dtype=np.int32)
    place -= np.repeat(starts.astype(np.int32), np.diff(np.concatenate([starts, [len(folded)]])))
    np.minimum(place, LANES - 1, out=place)
    place <<= 8
    place |= folded[starts[0] :]
    total = np.zeros(len(place) + 1, np.uint64)
    np.cumsum(LANE_VALUE[place], out=total[1:])
    size = ends - starts
    out = mixed(total[ends - starts[0]] - total[starts - starts[0]] + size.astype(np.uint64) * MIX1)
    for i in np.flatnonzero(size > LANES).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(folded[starts[i] : ends[i]].data, digest_size=8).digest(), "little")
    return out, rows


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k neighbouring words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for i in range(1, k):
        out *= PRIME
        out += words[i : n + i]
    return mixed(out)
