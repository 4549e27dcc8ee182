"""License scan by diagonal voting (DataFrame operations only).

Every rolling word 3-gram of every text is hashed and joined with the 3-gram positions of the license
templates, a table of fixed size that is broadcast. A match at word p of a text and word t of a template votes for
the diagonal p - t. Votes are summed by diagonal before they are shuffled; neighbouring diagonals (a word
more or less within the span) are merged; a span is verified by the words themselves and by the share of the
template's 3-grams that it holds.

Defined results: a null or empty text has no words, no places and score 0; repeated rows and rows that share a
doc_id (or have none) are scanned each for itself; further columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

GRAM = 3
#: Diagonals at most so far apart belong to one span.
NEAR = 2
#: Share of a template's 3-grams that a span of the method must hold.
COVERAGE = 0.75

#: Base phrases and their labels (fixed values).
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
#: Opening sentences of public licenses (fixed values); at most 62 words each, for votes are kept as bits of a long.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl-3", "licensed under the gnu affero general public license version 3"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
)


def templates() -> list[tuple[int, bool, str, list[str]]]:
    """(number, is a base phrase, label, words)."""
    both = [(True, *x) for x in PHRASES] + [(False, *x) for x in TEMPLATES]
    return [(i, base, label, text.split()) for i, (base, label, text) in enumerate(both)]


def template_positions(spark: SparkSession) -> DataFrame:
    """One row for each 3-gram of each template; a fixed number of rows."""
    rows = [(i, p, len(words) - GRAM + 1, base, label, *words[p : p + GRAM]) for i, base, label, words in templates() for p in range(len(words) - GRAM + 1)]
    df = spark.createDataFrame(rows, "tid int, tpos int, grams int, base boolean, label string, t0 string, t1 string, t2 string")
    return df.withColumn("hash", F.xxhash64("t0", "t1", "t2"))


def votes(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """A row for each match of a 3-gram with a template position, and at least one row (without one) for each document."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), common.words_of(F.col(text)).alias("words"))
    rows = rows.select("row", "doc_id", "words", F.size("words").cast("long").alias("n_words"))
    places = common.word_positions(rows, "row", "doc_id", "n_words").withColumn("hash", common.gram_hash(GRAM))
    hits = places.join(F.broadcast(template_positions(docs.sparkSession)), "hash", "left")
    same = F.col("tid").isNotNull() & (F.col("word") == F.col("t0")) & (common.word_at(1) == F.col("t1")) & (common.word_at(2) == F.col("t2"))
    found = lambda c: F.when(F.col("same"), F.col(c)).alias(c)
    hits = hits.withColumn("same", F.coalesce(same, F.lit(False))).where(F.col("same") | F.coalesce(F.col("pos") == 0, F.lit(True)))
    return hits.select("row", "doc_id", "n_words", *[found(c) for c in ("tid", "tpos", "grams", "base", "label")], F.when(F.col("same"), (F.col("pos") - F.col("tpos")).cast("long")).alias("diagonal"))


def spans(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Merged diagonals: row, doc_id, n_words, tid, label, base, first_word, places (whole base phrases), coverage.

    A document without any vote has one row with tid null.
    """
    group = ["row", "doc_id", "n_words", "tid", "grams", "base", "label"]
    bit = F.expr("shiftleft(1L, tpos)")
    lines = votes(docs, text, id_col).groupBy(*group, "diagonal").agg(F.bit_or(bit).alias("held"), F.count("tpos").alias("votes"))
    order = Window.partitionBy("row", "tid").orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(order)
    # whole base phrases are spans of their own; what the method merges are the other templates' diagonals
    lines = lines.withColumn("starts", F.when(gap.isNull() | (gap > NEAR) | F.col("base"), 1).otherwise(0))
    lines = lines.withColumn("span", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return lines.groupBy(*group, "span").agg(
        F.min("diagonal").alias("first_word"), (F.bit_count(F.bit_or("held")) / F.first("grams")).alias("coverage"),
    ).drop("span")


def scan(docs: DataFrame, text: str = "text", id_col: str = "doc_id", coverage: float = COVERAGE) -> DataFrame:
    """Per document: n_words, n_base, first_word, last_word, base_labels, labels, score (the largest verified coverage)."""
    whole = F.col("base") & (F.col("coverage") == 1)
    kept = whole | (~F.col("base") & (F.col("coverage") >= coverage))
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    return spans(docs, text, id_col).groupBy("row", "doc_id", "n_words").agg(
        F.count_if(whole).alias("n_base"), F.min(F.when(whole, F.col("first_word"))).alias("first_word"), F.max(F.when(whole, F.col("first_word"))).alias("last_word"),
        joined(F.when(whole, F.col("label"))).alias("base_labels"), joined(F.when(kept, F.col("label"))).alias("labels"),
        F.coalesce(F.max(F.when(kept, F.col("coverage"))), F.lit(0.0)).alias("score"),
    ).drop("row")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))


def _values(rows: list[tuple]) -> str:
    show = lambda x: f"'{x}'" if isinstance(x, str) else str(x).lower()
    return ", ".join(f"({', '.join(show(x) for x in row)})" for row in rows)


def _template_sql() -> str:
    rows = [(i, p, len(words) - GRAM + 1, base, label, " ".join(words[p : p + GRAM])) for i, base, label, words in templates() for p in range(len(words) - GRAM + 1)]
    return f"(VALUES {_values(rows)}) AS t(tid, tpos, grams, base, label, gram)"


ORACLE_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{common.UPPER}', '{common.LOWER}'), '{common.WORD_BREAK}'), lambda x: x <> '') AS w
  FROM documents),
g AS (
  SELECT r, p, w[p + 1] || ' ' || w[p + 2] || ' ' || w[p + 3] AS gram
  FROM (SELECT r, w, unnest(range(len(w) - {GRAM - 1})) AS p FROM d)),
v AS (
  SELECT r, tid, grams, base, label, p - tpos AS diagonal, bit_or(1::BIGINT << tpos) AS held
  FROM g JOIN {_template_sql()} USING (gram) GROUP BY ALL),
s AS (
  SELECT *, sum(starts) OVER (PARTITION BY r, tid ORDER BY diagonal) AS span FROM (
    SELECT *, CASE WHEN base OR coalesce(diagonal - lag(diagonal) OVER (PARTITION BY r, tid ORDER BY diagonal), 99) > {NEAR} THEN 1 ELSE 0 END AS starts FROM v)),
m AS (
  SELECT r, tid, base, label, span, min(diagonal) AS first_word, bit_count(bit_or(held)) / grams::DOUBLE AS coverage
  FROM s GROUP BY r, tid, grams, base, label, span),
k AS (SELECT *, base AND coverage = 1 AS whole, (base AND coverage = 1) OR (NOT base AND coverage >= {COVERAGE}) AS kept FROM m)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, count(*) FILTER (whole) AS n_base,
       min(first_word) FILTER (whole) AS first_word, max(first_word) FILTER (whole) AS last_word,
       coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (whole)), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (kept)), ','), '') AS labels,
       coalesce(max(coverage) FILTER (kept), 0)::DOUBLE AS score
FROM d LEFT JOIN k USING (r) GROUP BY d.r, d.doc_id, d.w
"""
