"""Packed blocks: many small entries travel as a few rows of arrays, dealt out by bucket."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

Columns = dict[str, np.ndarray]


def schema(kinds: dict[str, type]) -> str:
    return "kind int, bucket long, " + ", ".join(f"{c} binary" for c in kinds)


def dealt(columns: Columns, bucket: np.ndarray, kind: int = 0) -> Iterator[dict]:
    """One row of packed arrays for each bucket that has entries."""
    by = np.argsort(bucket, kind="stable")
    sorted_, cuts = bucket[by], np.concatenate([[0], np.flatnonzero(np.diff(bucket[by])) + 1, [len(by)]])
    columns = {c: x[by] for c, x in columns.items()}
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if a < b:
            yield {"kind": kind, "bucket": int(sorted_[a])} | {c: x[a:b].tobytes() for c, x in columns.items()}


def batches(rows: Iterator[dict], names: list[str], at_once: int = 64) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) == at_once:
            yield _batch(held, names)
            held = []
    if held:
        yield _batch(held, names)


def _batch(rows: list[dict], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64()] + [pa.binary()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in zip(["kind", "bucket", *names], kinds, strict=True)], ["kind", "bucket", *names])


def frame(rows: Iterator[dict], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(list(rows), columns=["kind", "bucket", *names])


def unpacked(pdf: pd.DataFrame, kinds: dict[str, type]) -> Columns:
    return {c: np.concatenate([np.frombuffer(x, t) for x in pdf[c]]) if len(pdf) else np.zeros(0, t) for c, t in kinds.items()}


def joined(parts: list[Columns]) -> Columns:
    return {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}


def drained(parts: list[Columns]) -> Columns:
    """The parts joined; the list is emptied, so that they don't stay in memory as well."""
    out = {}
    for c in list(parts[0]):
        out[c] = np.concatenate([p.pop(c) for p in parts])
    parts.clear()
    return out


def narrowed(columns: Columns, which: np.ndarray) -> Columns:
    """As picked, in place: column by column, so that there is no second copy of all."""
    for c in columns:
        columns[c] = columns[c][which]
    return columns


def picked(columns: Columns, which: np.ndarray) -> Columns:
    return {c: x[which] for c, x in columns.items()}
