"""Benchmark decontamination by a prefix-filtered set join (DataFrame operations only).

A window is a run of item words; its set is that of its word 3-grams (shorter windows: one gram). Grams are ordered by rarity,
counted over all documents. Containment of a whole window needs its rarest gram, so a prefix of one gram for each window is
joined with the grams of the documents; length and positional bounds drop places where the window
can't fit, and the words themselves are compared. Items are a stated query set: they are broadcast
while their windows take at most BROADCAST_BYTES. Beyond that the join is a shuffle of slim rows (document, place, gram): words are
brought back for the places that pass the bounds, and both ways give the same rows.

Defined results: null and wordless texts have no words and no hits, wordless items no windows; rows that share a
doc_id (or have none) are looked at each for itself, repeated rows alike; equal windows of several items count for each of these items; an empty table
of documents gives no rows, one of items no hits; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

WINDOW = 10
GRAM = 3
#: Bytes of windows (words and item ids) that are broadcast at most.
BROADCAST_BYTES = 64 << 20


def item_windows(items: DataFrame, text: str = "text", id_col: str = "item_id", size: int = WINDOW) -> DataFrame:
    """Distinct windows: wid, wwords, wlen, k (words in a gram), items."""
    rows = items.select(F.col(id_col).cast("string").alias("item"), common.words_of(F.col(text)).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1)))
    rows = rows.select("item", F.explode(F.transform(starts, lambda i: F.slice(F.col("words"), i, size))).alias("wwords"))
    out = rows.groupBy("wwords").agg(F.collect_set("item").alias("items")).withColumn("wlen", F.size("wwords"))
    return out.withColumn("wid", F.xxhash64("wwords")).withColumn("k", F.least("wlen", F.lit(GRAM)))


def window_grams(windows: DataFrame) -> DataFrame:
    """One row for each gram of each window: hash, off (its place in the window) and the window's columns."""
    rows = windows.select("*", F.posexplode("wwords").alias("off", "w0")).where(F.col("off") + F.col("k") <= F.col("wlen"))
    grams = F.when(F.col("k") == 1, F.xxhash64("w0")).when(F.col("k") == 2, F.xxhash64("w0", F.get("wwords", F.col("off") + 1)))
    return rows.withColumn("hash", grams.otherwise(F.xxhash64("w0", F.get("wwords", F.col("off") + 1), F.get("wwords", F.col("off") + 2)))).drop("w0")


def document_rows(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    """row, doc_id, words, n_words of every text."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), common.words_of(F.col(text)).alias("words"))
    return rows.select("row", "doc_id", "words", F.size("words").cast("long").alias("n_words"))


def document_grams(rows: DataFrame, sizes: list[int]) -> DataFrame:
    """row, doc_id, n_words, words, pos, hash: every gram of every text; a wordless text has one row with pos null."""
    places = common.word_positions(rows, "row", "doc_id", "n_words")
    if sizes == [GRAM]:
        return places.withColumn("hash", common.gram_hash(GRAM))
    # short items: grams of one or two words as well
    return places.select("*", F.explode(F.array(*[common.gram_hash(k) for k in sizes])).alias("hash"))


def window_bytes(windows: DataFrame) -> int:
    """Bytes that the windows take in memory, about: their words and item ids, and 32 for each of these."""
    size = sum(F.octet_length(F.array_join(c, "")) + 32 * F.size(c) for c in ("wwords", "items")) + 64
    return windows.agg(F.sum(size.cast("long"))).first()[0] or 0


def hits(docs: DataFrame, items: DataFrame, text: str = "text", id_col: str = "doc_id", item_id: str = "item_id", size: int = WINDOW) -> DataFrame:
    """Verified places of windows: row, doc_id, n_words, start, end, items; besides, a document may have one row with start null, and has it if there are no hits."""
    windows = common.written(item_windows(items, text, item_id, size), "windows")
    sizes = windows.agg(F.sort_array(F.collect_set("k"))).first()[0]
    slim = window_bytes(windows) > BROADCAST_BYTES
    small = (lambda df: df) if slim else F.broadcast
    rows = document_rows(docs, text, id_col)
    if slim:  # rows are named once and for all, for they meet again
        rows = common.written(rows, "words")
    grams = document_grams(rows, sizes or [GRAM])
    tokens = window_grams(windows)
    # rarity over all documents: one row for each gram of the items
    rarity = grams.select("hash").join(small(tokens.select("hash").distinct()), "hash").groupBy("hash").agg(F.count("*").alias("seen"))
    rarest = F.row_number().over(Window.partitionBy("wid", "wwords").orderBy("seen", "hash", "off"))
    prefix = tokens.join(small(common.written(rarity, "rarity")), "hash").withColumn("rarest", rarest).where("rarest = 1")
    # a window with a gram that no document has can't occur; the join above has left its other grams, and the bounds below remain exact
    start, shown = F.col("pos") - F.col("off"), ["row", "doc_id", "n_words", "start", "end", "items"]
    fits = (start >= 0) & (start + F.col("wlen") <= F.col("n_words"))
    if slim:
        prefix = common.written(prefix.select("hash", "off", "wlen", "wid", "wwords", "items"), "prefix")
        near = grams.select("row", "n_words", "pos", "hash").join(prefix.select("hash", "off", "wlen", "wid"), "hash").where(fits).select("row", start.alias("start"), "wlen", "wid")
        near = rows.join(near, "row").select("row", "doc_id", "n_words", "start", "wid", F.slice("words", F.col("start") + 1, F.col("wlen")).alias("wwords"))
        found = near.join(prefix.select("wid", "wwords", "items"), ["wid", "wwords"]).withColumn("end", F.col("start") + F.size("wwords")).select(*shown)
        none = F.lit(None).cast("int")
        return found.unionByName(rows.select("row", "doc_id", "n_words", none.alias("start"), none.alias("end"), F.lit(None).cast("array<string>").alias("items")))
    prefix = prefix.select("hash", "off", "wlen", "wwords", "items")
    found = grams.join(small(prefix), "hash", "left")
    same = F.when(fits, F.slice("words", F.greatest(start, F.lit(0)) + 1, F.col("wlen")) == F.col("wwords"))
    found = found.withColumn("same", F.coalesce(same, F.lit(False))).where(F.col("same") | F.coalesce(F.col("pos") == 0, F.lit(True)))
    if_same = lambda c: F.when(F.col("same"), c)
    return found.select("row", "doc_id", "n_words", if_same(start).alias("start"), if_same(start + F.col("wlen")).alias("end"), if_same(F.col("items")).alias("items"))


def decontaminated(docs: DataFrame, items: DataFrame, **columns: str) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    spans = F.sort_array(F.collect_set(F.when(F.col("start").isNotNull(), F.struct("start", "end"))))
    step = lambda acc, x: F.struct(
        (acc["n"] + F.greatest(x["end"] - F.greatest(x["start"], acc["upto"]), F.lit(0))).alias("n"), F.greatest(acc["upto"], x["end"]).alias("upto"),
    )
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    out = hits(docs, items, **columns).groupBy("row", "doc_id", "n_words").agg(spans.alias("spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    out = out.withColumn("n_hit", F.aggregate("spans", zero, step)["n"].cast("long"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, text: str = "text", id_col: str = "doc_id", **columns: str) -> DataFrame:
    """The rows without any window of an item, with all columns; docs is a table as read."""
    rows, number = common.numbered(docs)
    leaked = decontaminated(rows, items, text=text, id_col=number, **columns).where("contaminated").select(F.col("doc_id").alias(number))
    return rows.join(leaked, number, "left_anti").select(*[rows[c] for c in docs.columns])


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def _words_sql(text: str) -> str:
    return f"list_filter(regexp_split_to_array(translate(coalesce({text}, ''), '{common.UPPER}', '{common.LOWER}'), '{common.WORD_BREAK}'), lambda x: x <> '')"


ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_words_sql("text")} AS w FROM documents),
i AS (SELECT item_id::VARCHAR AS item, {_words_sql("text")} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, least(len(w), {WINDOW}) AS n, array_to_string(w[p:p + {WINDOW - 1}], ' ') AS t
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
g AS (
  SELECT r, p, s.n, array_to_string(w[p:p + s.n - 1], ' ') AS t
  FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM d) x JOIN (SELECT DISTINCT n FROM win) s ON p + s.n - 1 <= len(w)),
h AS (SELECT r, p, g.n, item FROM g JOIN win USING (n, t)),
c AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT r, p, n FROM h)) GROUP BY r),
k AS (SELECT r, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM h GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN k USING (r)
"""
