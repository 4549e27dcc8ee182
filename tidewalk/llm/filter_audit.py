"""Filter interaction audit on a fingerprint-routed RDD: what each filter removes in each order of the filters.

Each document gets a mask of the filters that it fails. Four of them look at the text alone; the fifth, identical to a smaller id's text, needs the
other documents. Rows are routed by the xxhash of their text, and the place that a fingerprint leads to keeps a chain of the different texts that share
it, each whole and with the smallest id seen so far. Of two rows with one text the one with the larger id is settled at once and leaves its text
behind, so a chain has one entry for each text, however many copies there are. The same is done before routing, in slices of at most HELD_BYTES: a
text travels once for each slice that holds it, and the losers travel as ids. Ids then meet their labels, and the count vectors of the masks
(all, good, toxic) are merged by part with combineByKey; the orders are read off these vectors.

Defined results: null texts count as empty, a null part as the empty string; a row without an id is compared with none and is never a copy; rows that share
id and text are counted each and are no copies of one another; labels are those of the id (any row of labels that says 1), rows of labels without an id are
passed over; an empty table has no parts and gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import xxhash
from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
CAPITALS, SIGNS = common.UPPER.encode(), b"#$%&*|"
#: Bytes of text that a task holds before it sends on what it has.
HELD_BYTES = 32 << 20
MASKS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
NAMES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in NAMES)


def own_failures(data: bytes, n_chars: int) -> int:
    """Mask of the filters that a text fails by itself (A to D). bytes.split knows the blanks that words end at: space, tab to carriage return."""
    words = data.split()
    mask = len(words) < LEAST_WORDS
    mask |= (100 * len(set(words)) < LEAST_DISTINCT * len(words)) << 1
    mask |= (100 * (len(data) - len(data.translate(None, CAPITALS))) > MOST_CAPITALS * n_chars) << 2
    return mask | (len(data.translate(None, SIGNS)) < len(data)) << 3


class Chains:
    """For each fingerprint the texts that have it, each with its smallest id, that id's mask and its rows by part."""

    def __init__(self) -> None:
        self.by_print: dict[int, list[list]] = {}
        self.held = 0

    def admit(self, mark: int, text: bytes, id_, mask: int, rows: dict[str, int]) -> Iterator[tuple]:
        """Takes rows of one id and text in; yields those that are settled now: (id, mask, part, n)."""
        chain = self.by_print.setdefault(mark, [])
        entry = next((e for e in chain if e[0] == text), None)
        if entry is None:
            chain.append([text, id_, mask, dict(rows)])
            self.held += len(text)
        elif id_ == entry[1]:
            for part, n in rows.items():
                entry[3][part] = entry[3].get(part, 0) + n
        else:
            lost, rows_lost = (id_, rows) if id_ > entry[1] else (entry[1], entry[3])
            if id_ < entry[1]:
                entry[1], entry[3] = id_, dict(rows)
            yield from ((lost, mask | COPY, part, n) for part, n in rows_lost.items())

    def entries(self) -> Iterator[tuple[int, list]]:
        for mark, chain in self.by_print.items():
            for entry in chain:
                yield mark, entry
        self.__init__()


def spread(id_) -> int:
    return xxhash.xxh64_intdigest(str(id_))


def before_routing(rows: Iterator) -> Iterator[tuple[int, tuple]]:
    """(route, settled row without text) or (fingerprint, chain entry)."""
    chains = Chains()
    for id_, part, n_chars, data in rows:
        text = bytes(data)
        mask = own_failures(text, n_chars)
        if id_ is None:
            yield xxhash.xxh64_intdigest(text), (None, None, mask, part, 1)
            continue
        for settled in chains.admit(xxhash.xxh64_intdigest(text), text, id_, mask, {part: 1}):
            yield spread(settled[0]), (None, *settled)
        if chains.held > HELD_BYTES:
            yield from ((mark, tuple(e)) for mark, e in chains.entries())
    yield from ((mark, tuple(e)) for mark, e in chains.entries())


def after_routing(rows: Iterator[tuple[int, tuple]]) -> Iterator[tuple]:
    """(id, mask, part, n): the rest of the copies, then what is smallest of its text."""
    chains = Chains()
    for mark, value in rows:
        if value[0] is None:
            yield value[1:]
        else:
            yield from chains.admit(mark, *value)
    for _, (_, id_, mask, parts) in chains.entries():
        yield from ((id_, mask, part, n) for part, n in parts.items())


def masked(docs: DataFrame, text: str = "text", id_col: str = "doc_id", part: str = "source") -> RDD:
    """(id, mask, part, n): n rows of that id and part fail the filters of the mask; every row is counted once."""
    common.shipped(docs.sparkSession)
    value = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id_col), F.coalesce(F.col(part).cast("string"), F.lit("")), F.length(value), value.cast("binary")).rdd
    return rows.mapPartitions(before_routing).partitionBy(common.buckets(docs, text), int).mapPartitions(after_routing)


def copies(docs: DataFrame, **columns: str) -> RDD:
    """The ids of rows whose text a smaller id has as well."""
    return masked(docs, **columns).filter(lambda row: row[1] & COPY).flatMap(lambda row: [row[0]] * row[3])


def _add(acc: np.ndarray, value) -> np.ndarray:
    flags, mask, n = value
    acc[0, mask] += n
    acc[1, mask] += n * (flags & 1)
    acc[2, mask] += n * (flags >> 1)
    return acc


def _with_flags(acc: tuple[int, dict], value: tuple[int, dict]) -> tuple[int, dict]:
    for cell, n in value[1].items():
        acc[1][cell] = acc[1].get(cell, 0) + n
    return acc[0] | value[0], acc[1]


def vectors(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", part: str = "source") -> RDD:
    """(part, counts): rows by mask, of these the good ones, of these the toxic ones (an array of 3 by 32)."""
    parts = common.shuffle_partitions(docs.sparkSession)
    flag = lambda c: F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))
    known = labels.where(F.col(id_col).isNotNull()).select(F.col(id_col), (flag("quality") + 2 * flag("toxic")).alias("flags")).where("flags > 0").rdd.map(lambda r: (r[0], (r[1], {})))
    rows = masked(docs, text, id_col, part).map(lambda r: (r[0], (0, {(r[2], r[1]): r[3]})))
    by_id = rows.union(known).combineByKey(lambda v: (v[0], dict(v[1])), _with_flags, _with_flags, parts, spread)
    cells = by_id.flatMap(lambda r: [(part, (r[1][0], mask, n)) for (part, mask), n in r[1][1].items()])
    return cells.combineByKey(lambda v: _add(np.zeros((3, MASKS), np.int64), v), _add, lambda a, b: a + b, parts, spread)


def orders(counts: np.ndarray) -> Iterator[tuple]:
    """filter_order, step and NAMES of one part, from its counts by mask."""
    masks = np.arange(MASKS)
    every, good, toxic = counts
    shapley = dict.fromkeys(FILTERS, 0)
    out = []
    for order in ORDERS:
        gone = np.zeros(MASKS, bool)
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            fails = masks & bit > 0
            here = fails & ~gone
            removed, redundant = int(every[here].sum()), int(every[fails & gone].sum())
            gone = gone | fails
            shapley[letter] += removed
            out.append((order, step, letter, int(every[~gone].sum()), removed, redundant, int(every[bit]), int(good[here].sum()), int(toxic[here].sum())))
    return ((order, step, *numbers, shapley[letter]) for order, step, letter, *numbers in out)


def audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """Per part, order of the filters and step: NAMES."""
    rows = vectors(docs, labels, **columns).flatMap(lambda r: [(r[0], *x) for x in orders(r[1])])
    return docs.sparkSession.createDataFrame(rows, SCHEMA, verifySchema=False)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         (len(w) < {LEAST_WORDS})::INT + 2 * (100 * len(list_distinct(w)) < {LEAST_DISTINCT} * len(w))::INT
         + 4 * (100 * (length(t) - length(translate(t, '{common.UPPER}', ''))) > {MOST_CAPITALS} * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
         + 16 * coalesce(min(d.doc_id) OVER (PARTITION BY t) < d.doc_id, false)::INT AS mask
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id
),
n AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM m GROUP BY part, mask),
f(l, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
s AS (SELECT filter_order, step::INT AS step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM o, range(1, 6) r(step)),
r AS (
  SELECT part, filter_order, step, bit,
         coalesce(sum(n) FILTER (mask & (bit | before) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before > 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
         coalesce(sum(g) FILTER (mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS good_lost, coalesce(sum(x) FILTER (mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost
  FROM n, s GROUP BY part, filter_order, step, bit
)
SELECT * EXCLUDE (bit), sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM r
"""
