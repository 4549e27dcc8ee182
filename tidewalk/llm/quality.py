"""Quality classifier: supervised subword embeddings.

Each word and each run of three and of four characters of a text is hashed to a row of a learned embedding table (a word that repeats one of the
two before it to a row of its own); the rows are averaged over the
document, and a softmax layer gives the label. Table and layer are trained together by stochastic gradient
descent in numpy, on at most TRAIN_ROWS labelled rows in the driver. The average and the layer before the softmax are linear, so
scoring needs only each feature's margin (one number for each table row), which travels with the function.

Defined results: null counts as empty text; a text without features gets the bias' score; with no labelled rows, or with one
label only, each score is that label's smoothed share; rows that share a doc_id (or have none) are scored each for itself, repeated rows alike; labels of
null ids or null labels aren't learned from; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import classify, common

#: Labelled rows that are learned from, at most.
TRAIN_ROWS = 4_000
#: Characters of the n-grams, and table rows of the words and of the n-grams of each length.
GRAMS, BITS = (3, 4), 15
#: Further table rows: a word that repeats the one before it, and one that repeats the second before it.
REPEATS = 2
ROWS = ((1 + len(GRAMS)) << BITS) + REPEATS
DIM, EPOCHS, RATE, SEED = 16, 5, 2.0, 7


#: Odd multipliers of a character's hash, by its place (fixed values).
PLACES = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each character (its bytes), and each text's first character."""
    lead = (data & 0xC0) != 0x80
    lead[offsets[:-1][offsets[:-1] < len(data)]] = True
    at = np.flatnonzero(lead)
    size = np.diff(np.concatenate([at, [len(data)]]))
    out = data[at].astype(np.uint32)
    for back in (1, 2, 3):
        wide = np.flatnonzero(size > back)
        out[wide] |= data[at[wide] + back].astype(np.uint32) << np.uint32(8 * back)
    return out, np.concatenate([[0], np.cumsum(lead)])[offsets]


def features(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Table rows of the words and of the n-grams of each length, each with the first feature of every text (one entry more than texts)."""
    starts, ends, words_at = common.word_spans(data, offsets, common.SOLID)
    hashes = common.range_hashes(common.prefix_hashes(data), starts, ends)
    words = (hashes >> np.uint64(64 - BITS)).astype(np.int32)
    for back in range(1, REPEATS + 1):  # a repeat stands for its word
        again = np.flatnonzero(hashes[back:] == hashes[:-back]) + back
        words[again] = ROWS - back
    out = [(words, words_at)]
    chars, first = characters(data, offsets)
    for nth, n in enumerate(GRAMS, 1):
        grams = np.zeros(max(len(chars) - n + 1, 0), np.uint32)
        for i in range(n):
            grams += chars[i : i + len(grams)] * PLACES[i]
        grams ^= grams >> np.uint32(15)
        grams = ((grams * PLACES[0]) >> np.uint32(32 - BITS)).astype(np.int32)
        keep = np.ones(len(grams), bool)
        for back in range(1, n):  # no n-gram runs on into the next text
            cut = first[1:-1] - back
            keep[cut[(cut >= 0) & (cut < len(grams))]] = False
        out.append((grams[keep] + (nth << BITS), np.concatenate([[0], np.cumsum(keep)])[np.minimum(first, len(grams))]))
    return out


def summed(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values over the runs that begin at first[:-1]."""
    return np.diff(np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])[first])


@dataclass
class Model:
    margin: np.ndarray
    bias: float

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        found = features(data, offsets)
        total = sum(summed(self.margin[rows], first) for rows, first in found)
        return self.bias + total / np.maximum(sum(np.diff(first) for _, first in found), 1)


def fit(texts: list[str], y: np.ndarray) -> Model:
    y = np.asarray(y, dtype=np.int64)
    share = (y.sum() + 1) / (len(y) + 2)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(ROWS, np.float32), float(np.log(share / (1 - share))))
    parts = [np.unique(np.concatenate([rows for rows, _ in features(data, offsets)]), return_counts=True) for data, offsets in classify.by_text(texts)]
    at = np.concatenate([[0], np.cumsum([len(rows) for rows, _ in parts])]).tolist()
    # two long arrays instead of thousands of short ones
    every = np.concatenate([rows for rows, _ in parts])
    weights = np.concatenate([(counts / max(counts.sum(), 1)).astype(np.float32) for _, counts in parts])
    del parts
    rng = np.random.default_rng(SEED)
    table = rng.uniform(-1 / DIM, 1 / DIM, (ROWS, DIM)).astype(np.float32)
    layer, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    steps, done = EPOCHS * len(texts), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(texts)):
            rows, shares = every[at[i] : at[i + 1]], weights[at[i] : at[i + 1]]
            rate, done = np.float32(RATE * (1 - done / steps)), done + 1
            mean = shares @ table[rows]
            z = mean @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1  # gradient of the loss by z
            table[rows] -= rate * np.float32(len(rows) ** 0.5) * np.outer(shares, layer @ p)
            layer -= rate * np.outer(mean, p)
            bias -= rate * np.float32(0.1) * p
    return Model((table @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def trained(docs: DataFrame, labels: DataFrame, learn=None, rows: int = TRAIN_ROWS) -> Model:
    sample = classify.training_rows(docs, labels, "quality", F.lit(True) if learn is None else learn, rows)
    return fit(sample["text"].tolist(), sample["y"].to_numpy())


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = common.table(spark, sf_dir, "documents"), classify.bucket("doc_id", 3) == 1
    model = trained(docs, common.table(spark, sf_dir, "labels"), ~held_out)
    return classify.scored(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
