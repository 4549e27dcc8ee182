"""Principal components by a randomised range finder, for vectors of any length: no matrix of all pairs of dimensions is made.

Each pass multiplies the rows by a thin matrix. A task keeps the triangle of its block's QR decomposition and one thin product; these are merged in two
steps, so the driver sees one triangle and one thin matrix, whatever the number of rows. The rows' orthonormal factor is never stored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Results of so many tasks are merged in one step.
FAN = 64


@dataclass
class Components:
    """Directions (one in each column), the mean that rows are centred on, and what share of the variance each direction explains."""

    directions: np.ndarray
    means: np.ndarray
    shares: list[float]
    n: int


def _blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[np.ndarray]:
    for batch in batches:
        if batch.num_rows:
            yield batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, d)


def _merged(parts: DataFrame, add) -> list[bytes] | None:
    """The columns a, b of all rows of g, a, b, merged by `add` in two steps; None without rows."""
    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = add([np.frombuffer(x) for x in pdf["a"]], [np.frombuffer(x) for x in pdf["b"]])
        return pd.DataFrame({"g": [0], "a": [a.tobytes()], "b": [b.tobytes()]})

    schema = "g long, a binary, b binary"
    row = parts.groupBy("g").applyInPandas(merge, schema).groupBy("g").applyInPandas(merge, schema).first()
    return None if row is None else [row["a"], row["b"]]


def _piece(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    g = TaskContext.get().partitionId() // FAN
    return pa.RecordBatch.from_arrays([pa.array([g], pa.int64()), pa.array([a.tobytes()], pa.binary()), pa.array([b.tobytes()], pa.binary())], ["g", "a", "b"])


def _moments(values: DataFrame, d: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means and sums of squared distances from them, for each dimension; blocks are merged with their own means, so nothing cancels."""
    def joined(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        n, mean, square = 0.0, np.zeros(d), np.zeros(d)
        for head, s in zip(a, b, strict=True):
            m, far = head[0], head[1:] - mean
            square = square + s + far * far * (n * m / (n + m))
            mean, n = mean + far * (m / (n + m)), n + m
        return np.concatenate([[n], mean]), square

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, squares = [], []
        for x in _blocks(batches, d):
            heads.append(np.concatenate([[len(x)], x.mean(0)]))
            squares.append(((x - x.mean(0)) ** 2).sum(0))
            if len(heads) == FAN:
                heads, squares = [[part] for part in joined(heads, squares)]
        if heads:
            yield _piece(*joined(heads, squares))

    found = _merged(values.mapInArrow(summed, "g long, a binary, b binary"), joined)
    head, square = np.frombuffer(found[0]), np.frombuffer(found[1])
    return int(head[0]), head[1:].copy(), square.copy()


def _triangle(blocks: list[np.ndarray], width: int) -> np.ndarray:
    """The triangle of the blocks' stack, padded with zeros where there are fewer rows than columns."""
    r = np.linalg.qr(np.vstack(blocks), mode="r")
    return np.vstack([r, np.zeros((width - len(r), width))]) if len(r) < width else r


def _pass(values: DataFrame, means: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(R, Z) for the centred rows X: R of the QR decomposition of X w, and Z = X' X w."""
    d, width = w.shape

    def joined(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return _triangle([r.reshape(width, width) for r in a], width), sum(b)

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, z, seen = np.zeros((width, width)), np.zeros((d, width)), False
        for x in _blocks(batches, d):
            x = x - means
            y = x @ w
            r, z, seen = _triangle([r, y], width), z + x.T @ y, True
        if seen:
            yield _piece(r, z.ravel())

    found = _merged(values.mapInArrow(multiplied, "g long, a binary, b binary"), joined)
    return np.frombuffer(found[0]).reshape(width, width), np.frombuffer(found[1]).reshape(d, width)


def _orthogonal(r: np.ndarray, z: np.ndarray) -> np.ndarray:
    """X' Q where X w = Q r and z = X' X w; directions that rounding alone fills are left out (zeros)."""
    return z @ np.linalg.pinv(r, rcond=1e-10)


def randomised(rows: DataFrame, vector: str, k: int = 50, extra: int = 10, power: int = 40, settled: float = 1e-6, seed: int = 242) -> Components:
    """The first k principal components of an array column, zero vectors included; rows without a vector are left out.

    `extra` columns beyond k and further passes sharpen the directions, until the explained share of all k grows by less than `settled` from one pass to
    the next, which is soon where variances fall off; after `power` passes it ends in any case. The start is drawn from `seed` alone, and each direction's largest entry is
    positive, so a run gives the same result again (up to the rounding of sums taken in another order). Vectors have one length, without nulls. Fewer components
    come back where there are fewer rows or dimensions; an empty table has none.
    """
    values = rows.where(F.col(vector).isNotNull()).select(F.transform(vector, lambda x: x.cast("double")).alias("v"))
    sizes = values.agg(F.min(F.size("v")).alias("low"), F.max(F.size("v")).alias("high"), F.count_if(F.exists("v", lambda x: x.isNull() | F.isnan(x))).alias("holes")).first()
    if not sizes["high"]:
        return Components(np.zeros((0, 0)), np.zeros(0), [], 0)
    if sizes["low"] != sizes["high"] or sizes["holes"]:
        raise ValueError(f"vectors of {vector} must have one length and no missing numbers")
    d = sizes["high"]
    n, means, square = _moments(values, d)
    k, width = min(k, d, n), min(k + extra, d)
    z = np.random.default_rng(seed).standard_normal((d, width))
    total, explained = max(square.sum(), 1e-300), -1.0
    for _ in range(power + 1):
        r, z = _pass(values, means, np.linalg.qr(z)[0])
        z = _orthogonal(r, z)
        left, found, _ = np.linalg.svd(z, full_matrices=False)
        before, explained = explained, float((found[:k] ** 2).sum() / total)
        if explained - before < settled:
            break
    directions = left[:, :k]
    directions = directions * np.where(directions[np.abs(directions).argmax(0), np.arange(k)] < 0, -1.0, 1.0)
    return Components(directions, means, (found[:k] ** 2 / total).tolist(), n)
