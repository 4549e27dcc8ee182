"""Toxicity: counterfactual-regularised classifier.

A logistic model over the set of a text's words (hashed, lower-cased). In training, each labelled text that names a group of people
is seen again with the identity term swapped for each other term of its list, and the squared change of the score (the probability) is penalised, so that
neutral mentions of one group don't score above those of another. A term that the text holds already can't come a second time: that swap only
takes the first one away.
Trained in numpy on at most TRAIN_ROWS labelled rows; scoring is vectorised over Arrow batches. The model's words are those that at least LEAST_ROWS of
these rows hold and whose share of label 1 is LEAST_Z standard errors off the common share, besides all identity terms; other words have the weight 0,
so words that are rare among the labelled rows can't learn the labels' noise. Both limits are parameters of `fit`.

Defined results: null counts as empty text; a text without known words gets the bias' score; with no labelled rows, or with one
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
TRAIN_ROWS = 12_000
#: A word gets a weight if so many labelled rows hold it, and if its share of label 1 is that many standard errors off the common share.
LEAST_ROWS, LEAST_Z = 8, 4.0
BITS = 18
STEPS, RATE, RIDGE, FAIR = 300, 0.3, 1e-4, 4.0

#: Identity terms, by list; terms of a list are swapped for each other (fixed values).
IDENTITY = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("old", "young", "elderly", "teenage"),
    ("deaf", "blind", "disabled", "paralyzed"),
    ("mujeres", "hombres"), ("frauen", "männer"), ("femmes", "hommes"),
)


def word_set(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, word) pairs of some texts: numbers of texts, hashed words."""
    words, first = common.word_hashes(data, offsets, common.WORDY)
    text = np.repeat(np.arange(len(offsets) - 1, dtype=np.uint64), np.diff(first))
    pairs = np.unique((text << np.uint64(BITS)) | (words >> np.uint64(64 - BITS)))
    return (pairs >> np.uint64(BITS)).astype(np.int64), (pairs & np.uint64((1 << BITS) - 1)).astype(np.int64)


def hashed(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(word_set(data, np.array([0, len(data)]))[1][0])


@dataclass
class Model:
    weight: np.ndarray
    bias: float

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        text, word = word_set(data, offsets)
        return self.bias + np.bincount(text, self.weight[word], len(offsets) - 1)


@dataclass
class Sample:
    """Training rows in columns of the model: (row, col) of each word, labels, and the counterfactual swaps (row, column that goes, column that comes or -1)."""

    row: np.ndarray
    col: np.ndarray
    y: np.ndarray
    swaps: np.ndarray

    def loss(self, w: np.ndarray, b: float, fair: float) -> tuple[float, np.ndarray, float]:
        """Mean log loss, ridge and fairness penalty; gradients by w and b."""
        n, width, m = len(self.y), len(w), max(len(self.swaps), 1)
        z = b + np.bincount(self.row, w[self.col], n)
        p = classify.sigmoid(z)
        error = (p - self.y) / n
        loss = float(np.mean(np.logaddexp(0, z) - self.y * z)) + RIDGE / 2 * float(w @ w)
        grad = RIDGE * w
        if len(self.swaps) and fair:
            row, goes, comes = self.swaps.T
            new = comes >= 0
            q = classify.sigmoid(z[row] - w[goes] + np.where(new, w[comes], 0))
            change = q - p[row]
            loss += fair * float(change @ change) / m
            by_q, by_p = 2 * fair * change * q * (1 - q) / m, -2 * fair * change * (p * (1 - p))[row] / m
            error = error + np.bincount(row, by_q + by_p, n)
            grad = grad - np.bincount(goes, by_q, width) + np.bincount(comes[new], by_q[new], width)
        return loss, grad + np.bincount(self.col, error[self.row], width), float(error.sum())


def swapped(sets: list[np.ndarray], lists: list[np.ndarray]) -> np.ndarray:
    """(text, term that goes, term that comes or -1 where the text holds it already) of every swap within a list; terms are hashed."""
    out = []
    for i, words in enumerate(sets):
        for terms in lists:
            here = np.isin(terms, words)
            if here.any():
                out += [(i, goes, -1 if held else comes) for goes in terms[here] for comes, held in zip(terms, here, strict=True) if comes != goes]
    return np.array(out, np.int64).reshape(-1, 3)


def fit(texts: list[str], y: np.ndarray, fair: float = FAIR, least_rows: int = LEAST_ROWS, least_z: float = LEAST_Z) -> Model:
    y = np.asarray(y, dtype=np.float64)
    share = (y.sum() + 1) / (len(y) + 2)
    bias = float(np.log(share / (1 - share)))
    weight = np.zeros(1 << BITS, np.float32)
    if len(set(y.tolist())) < 2:
        return Model(weight, bias)
    sets = [word_set(data, offsets)[1] for data, offsets in classify.by_text(texts)]
    lists = [np.array(sorted({hashed(x) for x in terms})) for terms in IDENTITY]
    seen = np.bincount(np.concatenate(sets), minlength=1 << BITS)
    toxic = np.bincount(np.concatenate([s for s, label in zip(sets, y, strict=True) if label]), minlength=1 << BITS)
    known = (seen >= least_rows) & (np.abs(toxic - seen * share) >= least_z * np.sqrt(np.maximum(seen, 1) * share * (1 - share)))
    known[np.concatenate(lists)] = True
    column = np.cumsum(known) - 1
    swaps = swapped(sets, lists)
    swaps = np.column_stack([swaps[:, 0], column[swaps[:, 1]], np.where(swaps[:, 2] < 0, -1, column[swaps[:, 2]])])
    sample = Sample(np.concatenate([np.full(known[s].sum(), i) for i, s in enumerate(sets)]), np.concatenate([column[s[known[s]]] for s in sets]), y, swaps)
    w, m, v, b = np.zeros(int(known.sum())), 0.0, 0.0, bias
    for step in range(1, STEPS + 1):
        _, grad, by_bias = sample.loss(w, b, fair)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-3)
        b -= RATE * by_bias
    weight[known] = w
    return Model(weight, float(b))


def trained(docs: DataFrame, labels: DataFrame, learn=None, rows: int = TRAIN_ROWS) -> Model:
    sample = classify.training_rows(docs, labels, "toxic", F.lit(True) if learn is None else learn, rows)
    return fit(sample["text"].tolist(), sample["y"].to_numpy())


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = common.table(spark, sf_dir, "documents"), classify.bucket("doc_id", 5) == 0
    model = trained(docs, common.table(spark, sf_dir, "labels"), ~held_out)
    return classify.scored(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
