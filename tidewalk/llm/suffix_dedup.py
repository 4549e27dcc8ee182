"""Removal of byte strings that a document with a smaller id holds too, by hash-compared suffix sort.

Suffixes are compared by prefix polynomial hashes, and not every suffix needs to be sorted: a string of
LENGTH bytes has GRAMS runs of GRAM bytes, and the run with the smallest hash (its anchor) is the same wherever the string
stands. So suffixes are sorted at anchors only (about 2 / (GRAMS + 1) of all places), by three growing extensions:

1. Suffixes are mergesorted by the hash of their first GRAM bytes and, among equals, by the hash of the anchor's region (all strings
   that have this anchor) and by document. Equal regions are resolved at once: all but the smallest document's go.
2. Where equal grams have several regions, extensions end within the region. There the strings themselves are hashed, one for each
   offset, sorted, and the smallest document of each is found.
3. Spans go back to their documents, where they are united and cut out.
4. Each span knows its witness, the place that the hashes took for equal. Spans that follow each other, with witnesses that do too, are one run; a run's
   bytes are sent to the witness' text and compared there. If any differ, all is done again with other byte values, so no result rests on hashes.

Entries meet if two hashes agree, 64 bits each, of independent byte values: the gram's and the region's in step 1, and both of the string in
step 2. A string that a false pair hid would show in step 4 as well, for a false pair always removes something.

Entries travel in packed blocks by hash. Each worker first sorts its own: of equal regions only the smallest document's goes
on, so a passage that a third of all documents share is one entry of each worker. A gram with very many regions is marked, and only
SHIPPED of a worker's entries go to the gram's task, the others straight to step 2. Texts go by a hash of id and text.

Defined results: null counts as empty text; a null doc_id is smaller than all others; rows with equal doc_ids don't remove from each other;
strings that only one document repeats stay; repeated rows lose the same bytes; an empty table gives no rows; other columns are
ignored, whatever their names; ids must be integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks, common

LENGTH = 50
GRAM = 26
GRAMS = LENGTH - GRAM + 1
#: Entries of one worker for one gram from which the gram is marked.
SHIPPED = 64
HELD = 600_000
#: Sets of byte values that are tried.
SEEDS = 3
#: Bytes of one text that are hashed at once.
SEGMENT = 1 << 23
PLACE_BITS = np.uint64(25)

#: key: hash of the gram; region: second hash, of the region; doc, row: id and hash of the text; at, count: first string and number of strings.
ENTRY = {"key": np.uint64, "region": np.uint64, "doc": np.int64, "row": np.int64, "at": np.uint32, "count": np.uint8, "marked": np.uint8}
#: row, at, count: strings that go; wrow, wat: where equal ones stand in a smaller document (their witness).
SPAN = {"row": np.int64, "at": np.uint32, "count": np.uint8, "wrow": np.int64, "wat": np.uint32}
NAMES, SPAN_NAMES = [*ENTRY, "wrow", "wat"], list(SPAN)
ENTRIES, REMOVED, ASKED = 0, 1, 2


def byte_values(seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of the bytes for two independent hashes."""
    both = common.mixed((np.arange(1, 513, dtype=np.uint64) + np.uint64(seed << 10)) * common.PRIME)
    return both[:256], both[256:]


def anchors(data: np.ndarray, offsets: np.ndarray, values: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first string, last string, gram hash, region hash) of each anchor of some texts that lie one after the other."""
    n = len(data)
    if n < LENGTH:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    prefix = common.prefix_hashes(data, values[0])
    place = np.arange(n - GRAM + 1)
    gram = common.range_hashes(prefix, place, place + GRAM)
    low = (np.uint64(1) << PLACE_BITS) - np.uint64(1)
    least = (gram & ~low) | place.astype(np.uint64)  # ties go to the first place
    for step in (1, 2, 4, 8):
        least = np.minimum(least[:-step], least[step:])
    least = np.minimum(least[: n - LENGTH + 1], least[GRAMS - 16 : n - LENGTH + 1 + GRAMS - 16])
    owner = (least & low).astype(np.int64)
    ok = np.ones(len(owner) + 1, bool)  # one entry more, for the end
    ok[-1] = False
    for end in offsets[1:-1].tolist():  # no string runs on into the next text
        ok[max(end - LENGTH + 1, 0) : end] = False
    starts = ok.copy()
    starts[1:-1] &= ~ok[:-2] | (owner[1:] != owner[:-1])
    first = np.flatnonzero(starts)
    ends = np.flatnonzero(ok[:-1] & (~ok[1:] | starts[1:]))
    region = common.range_hashes(common.prefix_hashes(data, values[1]), first, ends + LENGTH) + (owner[first] - first).astype(np.uint64) * common.MIX2
    return first, ends, gram[owner[first]], common.mixed(region)


def sorted_out(e: blocks.Columns) -> tuple[blocks.Columns, blocks.Columns, np.ndarray]:
    """Entries by key, region and document (sorted in place) but those that go; those, with their witnesses; first entries of the keys of both together.

    The first entry of a region is the witness of the others of larger documents.
    """
    e = blocks.narrowed(e, np.lexsort((e["doc"], e["region"], e["key"])))
    new_key = np.concatenate([[True], e["key"][1:] != e["key"][:-1]])
    new_region = np.flatnonzero(new_key | np.concatenate([[True], e["region"][1:] != e["region"][:-1]]))
    witness = np.repeat(new_region, np.diff(np.concatenate([new_region, [len(e["key"])]])))
    gone = np.flatnonzero(e["doc"] > e["doc"][witness])
    spans_ = {c: e[c][gone] for c in ("row", "at", "count")} | {"wrow": e["row"][witness[gone]], "wat": e["at"][witness[gone]]}
    return e, spans_, np.flatnonzero(new_key)


def spans(e: blocks.Columns, buckets: int, kind: int, names: list[str]) -> Iterator[dict]:
    """Blocks of spans, dealt out by row; strings that are only asked for have no witness yet. A row's spans lie side by side, which packs better."""
    by = np.lexsort((e["at"], e["row"]))
    columns = {c: e[c][by] for c in SPAN if c in e}
    for row in blocks.dealt(columns, columns["row"] % buckets, kind):
        yield {c: b"" for c in names} | row


def rest(e: blocks.Columns, gone: blocks.Columns) -> np.ndarray:
    """Flags of the entries that are not among the gone ones."""
    least = np.concatenate([[True], (e["key"][1:] != e["key"][:-1]) | (e["region"][1:] != e["region"][:-1])])
    first = np.flatnonzero(least)
    kept = e["doc"] == np.repeat(e["doc"][first], np.diff(np.concatenate([first, [len(least)]])))
    assert len(kept) - kept.sum() == len(gone["row"])
    return kept


def combined(e: blocks.Columns, buckets: int) -> Iterator[dict]:
    """A worker's own sort: what it resolves by itself, and the entries that go on."""
    if not len(e["key"]):
        return
    e, gone, _ = sorted_out(e)
    yield from spans(gone, buckets, REMOVED, NAMES)
    e = blocks.narrowed(e, rest(e, gone))
    by = np.lexsort((e["doc"], e["key"]))
    e = blocks.narrowed(e, by)
    first = np.flatnonzero(np.concatenate([[True], e["key"][1:] != e["key"][:-1]]))
    counts = np.diff(np.concatenate([first, [len(by)]]))
    nth = np.arange(len(by)) - np.repeat(first, counts)
    e["marked"] = np.maximum(e["marked"], np.repeat(counts > SHIPPED, counts).astype(np.uint8))
    yield from spans(blocks.picked(e, nth >= SHIPPED), buckets, ASKED, NAMES)
    e = blocks.narrowed(e, nth < SHIPPED)
    e = blocks.narrowed(e, np.argsort(e["row"], kind="stable"))  # equal ids side by side pack better
    yield from entries(e, buckets)


def entries(e: blocks.Columns, buckets: int) -> Iterator[dict]:
    for row in blocks.dealt(e, (common.mixed(e["key"]) % np.uint64(buckets)).astype(np.int64), ENTRIES):
        yield {c: b"" for c in NAMES} | row


def matched(buckets: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        through = pdf[pdf["kind"] != ENTRIES]
        e, out = blocks.unpacked(pdf[pdf["kind"] == ENTRIES], ENTRY), []
        if len(e["key"]):
            e, gone, keys = sorted_out(e)
            out += spans(gone, buckets, REMOVED, SPAN_NAMES)
            counts = np.diff(np.concatenate([keys, [len(e["key"])]]))
            marked = np.maximum.reduceat(e["marked"], keys) > 0
            docs = np.maximum.reduceat(e["doc"], keys) > np.minimum.reduceat(e["doc"], keys)
            regions = np.maximum.reduceat(e["region"], keys) > np.minimum.reduceat(e["region"], keys)
            asked = np.repeat(marked | (docs & regions), counts) & rest(e, gone)
            out += spans(blocks.picked(e, asked), buckets, ASKED, SPAN_NAMES)
        return pd.concat([through[["kind", "bucket", *SPAN_NAMES]], blocks.frame(iter(out), SPAN_NAMES)], ignore_index=True)

    return run


def segments(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(bytes, offsets, row numbers, start in the row) of texts, long ones in overlapping segments."""
    for first, end, data, offsets in common.text_slices(column):
        if len(data) <= SEGMENT:
            yield data, offsets, np.arange(first, end), 0
            continue
        for start in range(0, len(data) - LENGTH + 1, SEGMENT):
            part = data[start : start + SEGMENT + LENGTH - 1]
            yield part, np.array([0, len(part)]), np.array([first]), start


def scanned(buckets: int, seed: int):
    values = byte_values(seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            held, total = [], 0
            for batch in batches:
                docs, names = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                for data, offsets, which, start in segments(batch.column(2)):
                    first, last, gram, region = anchors(data, offsets, values)
                    row = np.searchsorted(offsets, first, "right") - 1
                    held.append({"key": gram, "region": region, "doc": docs[which[row]], "row": names[which[row]], "at": (first - offsets[row] + start).astype(np.uint32), "count": (last - first + 1).astype(np.uint8), "marked": np.zeros(len(first), np.uint8)})
                    total += len(first)
                    if total >= HELD:
                        yield from combined(blocks.drained(held), buckets)
                        total = 0
            if held:
                yield from combined(blocks.drained(held), buckets)

        yield from blocks.batches(rows(), NAMES)

    return run


def strings(buckets: int, seed: int):
    """Entries of the single strings that are asked for."""
    values = byte_values(seed)

    def run(texts: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        spans_ = blocks.unpacked(asked, {c: SPAN[c] for c in ("row", "at", "count")})
        by = np.argsort(spans_["row"], kind="stable")
        spans_ = blocks.picked(spans_, by)
        held, out, total = [], [], 0
        for doc, row, text in zip(texts["doc"], texts["row"], texts["text"], strict=True):
            a, b = np.searchsorted(spans_["row"], row, "left"), np.searchsorted(spans_["row"], row, "right")
            if a == b:
                continue
            counts = spans_["count"][a:b].astype(np.int64)
            at = np.repeat(spans_["at"][a:b].astype(np.int64) - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            at = np.unique(at)
            data = np.frombuffer(text.encode(), np.uint8)
            first, second = (common.range_hashes(common.prefix_hashes(data, v), at, at + LENGTH) for v in values)
            held.append({"key": first, "region": second, "doc": np.full(len(at), doc), "row": np.full(len(at), row), "at": at.astype(np.uint32), "count": np.ones(len(at), np.uint8), "marked": np.zeros(len(at), np.uint8)})
            total += len(at)
            if total >= HELD:
                out += sifted(blocks.drained(held))
                total = 0
        if held:
            out += sifted(blocks.drained(held))
        return blocks.frame(iter(out), NAMES)

    def sifted(e: blocks.Columns) -> Iterator[dict]:
        e, gone, _ = sorted_out(e)
        yield from spans(gone, buckets, REMOVED, NAMES)
        e = blocks.narrowed(e, rest(e, gone))
        e = blocks.narrowed(e, np.argsort(e["row"], kind="stable"))
        yield from entries(e, buckets)

    return run


def runs(at: np.ndarray, end: np.ndarray, wrow: np.ndarray, wat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first span) of the runs of spans that follow each other as their witnesses do; spans sorted by wrow, diagonal and start."""
    line = at - wat
    other = np.concatenate([[True], (wrow[1:] != wrow[:-1]) | (line[1:] != line[:-1])])
    apart = np.cumsum(other) << 33  # so that an end counts among the spans of its own diagonal only
    upto = np.maximum.accumulate(end + apart) - apart
    new = other | np.concatenate([[True], at[1:] > upto[:-1]])
    first = np.flatnonzero(new)
    return at[first], np.maximum.reduceat(end, first), first


def cut(buckets: int):
    """Per row of a bucket the digest columns and the spans that go; and what is to be compared, dealt out by the witness' row."""

    def run(texts: pd.DataFrame, removed: pd.DataFrame) -> pd.DataFrame:
        gone = blocks.unpacked(removed, SPAN)
        gone = blocks.picked(gone, np.argsort(gone["row"], kind="stable"))
        out, asked = [], {}
        for name, row, text in zip(texts["name"], texts["row"], texts["text"], strict=True):
            data = np.frombuffer(text.encode(), np.uint8)
            a, b = np.searchsorted(gone["row"], row, "left"), np.searchsorted(gone["row"], row, "right")
            at, wat, wrow = gone["at"][a:b].astype(np.int64), gone["wat"][a:b].astype(np.int64), gone["wrow"][a:b]
            end = at + gone["count"][a:b].astype(np.int64) + LENGTH - 1
            depth = np.zeros(len(data) + 1, np.int64)
            np.add.at(depth, at, 1)
            np.add.at(depth, end, -1)
            inside = np.cumsum(depth[:-1]) > 0
            edges = np.flatnonzero(np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))).reshape(-1, 2)
            out.append((name, len(data), int(inside.sum()), len(edges), hashlib.sha256(data[~inside].tobytes()).hexdigest(), edges.ravel().tolist(), None, None))
            if a < b:
                by = np.lexsort((at, at - wat, wrow))
                starts, ends, first = runs(at[by], end[by], wrow[by], wat[by])
                for i, j, other, there in zip(starts.tolist(), ends.tolist(), wrow[by][first].tolist(), wat[by][first].tolist(), strict=True):
                    asked.setdefault(other % buckets, []).append((other, there, data[i:j]))
        out += [(*[None] * 6, other, packed_runs(items)) for other, items in asked.items()]
        return pd.DataFrame(out, columns=["name", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "bucket", "items"], dtype=object)

    return run


def packed_runs(items: list[tuple[int, int, np.ndarray]]) -> bytes:
    """Row, start and length of each run, then all their bytes."""
    head = np.array([(row, at, len(x)) for row, at, x in items], np.int64)
    return np.int64(len(items)).tobytes() + head.tobytes() + b"".join(x.tobytes() for _, _, x in items)


def compared(texts: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """Number of runs of one bucket that don't equal their witnesses."""
    wanted: dict[int, list] = {}
    for blob in asked["items"]:
        n = int(np.frombuffer(blob, np.int64, 1)[0])
        at = 8 + 24 * n
        for row, there, size in np.frombuffer(blob, np.int64, 3 * n, 8).reshape(n, 3).tolist():
            wanted.setdefault(row, []).append((there, blob[at : at + size]))
            at += size
    false, seen = 0, set()
    for row, text in zip(texts["row"], texts["text"], strict=True):
        seen.add(row)
        if row in wanted:
            data = text.encode()
            false += sum(data[there : there + len(x)] != x for there, x in wanted[row])
    return pd.DataFrame({"false": [false + sum(len(v) for row, v in wanted.items() if row not in seen)]})


def removed_spans(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (starts and ends of what goes, in turn)."""
    common.shipped(docs.sparkSession)
    lowest = F.lit(-(1 << 63)).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), lowest).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    buckets = common.buckets(rows, "text")
    for seed in range(SEEDS):
        out, false = attempt(rows.withColumn("row", F.xxhash64(F.lit(seed), "doc_id", "text")), buckets, seed)
        if not false:
            return out
    raise RuntimeError("hashes of the texts collide whatever the byte values")


def attempt(rows: DataFrame, buckets: int, seed: int) -> tuple[DataFrame, int]:
    """The result by the hashes of one seed, and how many of its runs of bytes turned out to differ."""
    found = rows.select("doc", "row", "text").mapInArrow(scanned(buckets, seed), blocks.schema(dict.fromkeys(NAMES)))
    found = common.written(found.groupBy("bucket").applyInPandas(matched(buckets), blocks.schema(SPAN)), "anchors")
    texts = rows.withColumn("bucket", F.pmod("row", F.lit(buckets).cast("long")))
    asked = found.where(F.col("kind") == ASKED)
    again = texts.select("bucket", "doc", "row", "text").groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInPandas(strings(buckets, seed), blocks.schema(dict.fromkeys(NAMES)))
    again = common.written(again.groupBy("bucket").applyInPandas(matched(buckets), blocks.schema(SPAN)), "strings")
    gone = found.where(F.col("kind") == REMOVED).unionByName(again.where(F.col("kind") == REMOVED))
    kind = rows.schema["doc_id"].dataType.simpleString()
    done = texts.select("bucket", F.col("doc_id").cast("string").alias("name"), "row", "text").groupBy("bucket").cogroup(gone.groupBy("bucket")).applyInPandas(
        cut(buckets), "name string, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>, bucket long, items binary",
    )
    done = common.written(done, "cut")
    common.dropped(found, again)
    checks = done.where("items is not null").select("bucket", "items")
    false = texts.select("bucket", "row", "text").groupBy("bucket").cogroup(checks.groupBy("bucket")).applyInPandas(compared, "false long").agg(F.sum("false")).first()[0]
    return done.where("items is null").select(F.col("name").cast(kind).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"), false or 0


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_spans(common.table(spark, sf_dir, "documents")).drop("spans")


ORACLE_SQL = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
g AS MATERIALIZED (SELECT r, doc_id, p, md5_number(substr(h, (2 * p + 1)::BIGINT, {2 * LENGTH})) AS s FROM (SELECT *, unnest(range(0, length(h) // 2 - {LENGTH - 1})) AS p FROM d)),
m AS (SELECT s, min(doc_id) AS least FROM g GROUP BY s HAVING min(doc_id) < max(doc_id)),
x AS MATERIALIZED (SELECT r, p, coalesce(p - lag(p) OVER (PARTITION BY r ORDER BY p) > {LENGTH}, true) AS new FROM g JOIN m USING (s) WHERE doc_id > least),
y AS (SELECT r, p, sum(new::INT) OVER (PARTITION BY r ORDER BY p) AS span FROM x),
z AS (SELECT r, span, min(p) AS a, max(p) + {LENGTH} AS b FROM y GROUP BY r, span),
k AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS was FROM z),
t AS (
  SELECT r, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed, max(b) AS upto,
         string_agg(substr(h, (2 * was + 1)::BIGINT, (2 * (a - was))::BIGINT), '' ORDER BY a) AS kept
  FROM k JOIN d USING (r) GROUP BY r)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN upto IS NULL THEN h ELSE kept || substr(h, (2 * upto + 1)::BIGINT) END)) AS kept_sha256
FROM d LEFT JOIN t USING (r)
"""
