"""Sources behind a call: requests in chunks of variables, annotators asked in batches. What makes the call is injected; no network is used here."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import connectors, tables

#: Variables of one request, terms of one question, and the waits between attempts in seconds (fixed values).
VARIABLES, TERMS = 40, 50
ATTEMPTS, FIRST_WAIT, LONGEST_WAIT = 5, 1.0, 30.0


class Busy(Exception):
    """The other side asks to wait, or failed by itself: worth another attempt. Any other error is not."""


def chunks(names: list[str], size: int = VARIABLES) -> list[list[str]]:
    return [names[i : i + size] for i in range(0, len(names), size)]


def patiently(call: Callable, *args, attempts: int = ATTEMPTS, wait: Callable[[float], None] = time.sleep):
    """The call's result; after Busy it is made again, each wait twice the last."""
    pause = FIRST_WAIT
    for left in range(attempts - 1, -1, -1):
        try:
            return call(*args)
        except Busy:
            if not left:
                raise
            wait(pause)
            pause = min(2 * pause, LONGEST_WAIT)


def fetched(spark: SparkSession, fetch: Callable[[list[str]], DataFrame], variables: list[str], key: str, renamed: dict[str, str] | None = None, size: int = VARIABLES) -> DataFrame:
    """A wide source, asked for `size` variables at once; the answers are joined on their key, negative numbers are missing values."""
    wide = tables.merged_chunks([patiently(fetch, part) for part in chunks(variables, size)], key)
    return wide.withColumnsRenamed(renamed or {})


def annotated(terms: DataFrame, term: str, ask: Callable[[list[str]], str], categories: list[str], neutral: str, size: int = TERMS, attempts: int = ATTEMPTS, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """token, category, is_distress, rationale of each term that an annotator (called on the workers) has judged; terms are asked `size` at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[str] = []
        for batch in batches:
            held += batch[term].dropna().tolist()
            while len(held) >= size:
                yield pd.DataFrame({"answer": [patiently(ask, held[:size], attempts=attempts, wait=wait)]})
                held = held[size:]
        if held:
            yield pd.DataFrame({"answer": [patiently(ask, held, attempts=attempts, wait=wait)]})

    answers = terms.select(term).mapInPandas(run, "answer string")
    return tables.annotation_rows(answers, "answer", categories, neutral).drop("line")


#: Tokens of a text that an encoder sees, at most; texts encoded at once; parts that a large table is encoded in (fixed values).
MOST_TOKENS, AT_ONCE, PARTS = 256, 32, 64


def embedded(rows: DataFrame, key: str, text: str, encode: Callable[[list[str]], tuple[list, list]], width: int, size: int = AT_ONCE, most: int = MOST_TOKENS) -> DataFrame:
    """key, first (the first token's vector), mean (over the tokens that the mask names), both in single precision, n_tokens and has_text of each text.

    encode gives, for some texts, each one's token vectors (of `width` numbers) and mask; the first `most` tokens count. Empty texts don't reach it: they have
    zero vectors and no tokens.
    """
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch[text].fillna("")
            full = texts.str.len() > 0
            if (~full).any():
                yield pd.DataFrame({key: batch.loc[~full, key], "first": [np.zeros(width, np.float32)] * int((~full).sum()), "mean": [np.zeros(width, np.float32)] * int((~full).sum()), "n_tokens": 0, "has_text": False})
            some = batch[full]
            for start in range(0, len(some), size):
                part = some.iloc[start : start + size]
                vectors, masks = encode(part[text].tolist())
                yield pd.DataFrame([(k, *pooled(v, m)) for k, v, m in zip(part[key], vectors, masks, strict=True)], columns=[key, "first", "mean", "n_tokens", "has_text"])

    def pooled(vectors, mask) -> tuple:
        m = np.asarray(mask[:most], float)
        v = np.asarray(vectors[:most], float).reshape(len(m), width)
        first = v[0] if len(m) else np.zeros(width)
        return first.astype(np.float32), (m @ v / max(m.sum(), 1.0)).astype(np.float32), int(m.sum()), True

    return rows.select(key, text).mapInPandas(run, f"{key} {kind}, first array<float>, mean array<float>, n_tokens int, has_text boolean")


def embedded_parts(rows: DataFrame, key: str, text: str, encode: Callable[[list[str]], tuple[list, list]], width: int, path: str, parts: int = PARTS, **settings) -> DataFrame:
    """`embedded` part by part (by a hash of the key), each written in a transaction, so that a stopped run goes on with the parts that are missing. Keys are unique and known."""
    spark = rows.sparkSession
    wrong = rows.groupBy(key).agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col(key).isNull()).limit(1).count()
    if wrong:
        raise ValueError(f"{key} isn't a key")
    schema = embedded(rows, key, text, encode, width, **settings).schema
    done = connectors.marks(spark, path)
    for part in range(parts):
        if str(part) not in done:
            some = rows.where(F.pmod(F.xxhash64(key), F.lit(parts)) == part)
            connectors.append(embedded(some, key, text, encode, width, **settings), path, f"part {part}", (part,))
    return connectors.read(spark, path, schema)


def masked_mean(vectors: str, mask: str):
    """Mean of the vectors whose mask is 1; zeros if the mask names none, null without vectors."""
    n = F.aggregate(mask, F.lit(0), lambda a, m: a + m)
    zero = F.transform(F.try_element_at(vectors, F.lit(1)), lambda x: F.lit(0.0))
    weighted = F.zip_with(vectors, mask, lambda v, m: F.transform(v, lambda x: x.cast("double") * m))
    total = F.aggregate(weighted, zero, lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    return F.transform(total, lambda x: F.when(n > 0, x / n).otherwise(0.0))
