"""Random forests of all folds on counted cells: rows whose features fall into the same bins are one cell, with how many rows of each label it holds.

Edges come from the folds' own training rows, as in boosting. A bootstrap sample of a cell's rows by independent Poisson weights is a Poisson draw of their number, so
nothing is lost by counting, and a forest's work doesn't grow with the rows once all cells are seen. Trees are independent: tasks get a fold's cells, sorted, and a run
of trees each, grow them to the end (no limit of depth), and send the cells of test rows along, so that no tree leaves its task. Probabilities are added as
whole numbers, so their order changes nothing. Folds with more than CELLS cells, or more combinations of bins than a long can number, aren't taken: `fits` says which are.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import tables
from . import boosting, walks
from .blocks import Blocks, summed
from .walks import Fold

#: Cells of a fold that a task takes, at most (some 100 bytes each); trees times cells that it should have, at least; tasks for each core.
CELLS, WORK, TASKS = 1 << 21, 1 << 20, 8
#: Numbers of a level's sums that are held at once; a probability of 1 as a whole number; rows of a label that share a number with those of the other.
HELD, ONE, PACKED = 1 << 18, 1 << 40, float(1 << 26)


@dataclass(frozen=True)
class Settings:
    """trees; least rows of a leaf; features tried at a node (0: the root of their number, rounded up); bins of a column; labels weigh the same (`balance`)."""

    trees: int = 500
    leaf: int = 20
    tried: int = 0
    bins: int = 32
    balance: bool = True
    seed: int = 42


def sizes(model: boosting.Model) -> list[int]:
    return [len(e) + 1 for e in model.edges]


def codes(bins: np.ndarray, of: list[int]) -> np.ndarray:
    """A number for each row of bins, of mixed radix."""
    out = np.zeros(len(bins), np.int64)
    for j, n in enumerate(of):
        out = out * n + bins[:, j]
    return out


def bins_of(code: np.ndarray, of: list[int]) -> np.ndarray:
    """The bins of numbered cells, a row for each feature."""
    out = np.zeros((len(of), len(code)), np.uint8 if max(of, default=0) <= 256 else np.uint16)
    for j in reversed(range(len(of))):
        code, out[j] = np.divmod(code, of[j])
    return out


def _split(own: np.ndarray, cell: np.ndarray, c0: np.ndarray, c1: np.ndarray, flat: np.ndarray, of: np.ndarray, chosen: np.ndarray, weights: tuple[float, float], leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """Best of the chosen features (-1: none) and its bin by node: cells of node own[i] hold c0 and c1 rows of each label."""
    n, nodes = len(flat) // len(of), len(chosen)
    width = of[chosen]
    ends = np.cumsum(width).reshape(width.shape)
    starts = ends - width
    key = (chosen * n).take(own, axis=0)
    key += cell[:, None]
    key = flat.take(key)  # bins, then their places among all of the nodes' bins
    key = (key + starts.take(own, axis=0)).reshape(-1)
    size, tried = int(ends[-1, -1]), chosen.shape[1]
    if c0.sum() + c1.sum() < PACKED:  # both counts in one number
        both = np.bincount(key, np.repeat(c0 + c1 * PACKED, tried), size)
        h1 = np.floor(both / PACKED)
        h0 = both - h1 * PACKED
    else:
        h0, h1 = np.bincount(key, np.repeat(c0, tried), size), np.bincount(key, np.repeat(c1, tried), size)
    u0, u1 = np.cumsum(h0), np.cumsum(h1)
    first, last, flatter = starts.reshape(-1), ends.reshape(-1) - 1, width.reshape(-1)
    base0, base1 = u0[first] - h0[first], u1[first] - h1[first]
    l0, l1 = u0 - np.repeat(base0, flatter), u1 - np.repeat(base1, flatter)
    all0, all1 = u0[last] - base0, u1[last] - base1
    left = l0 + l1
    enough = (left >= leaf) & (left <= np.repeat(all0 + all1 - leaf, flatter))
    at = np.flatnonzero(enough)  # a column's last bin leaves nothing on the right
    column, cut = np.full(nodes, -1), np.zeros(nodes, np.int64)
    if not len(at):
        return column, cut
    slot = np.searchsorted(first, at, "right") - 1
    node = slot // tried
    # Gini: what a split takes off is the sum of squares over sums, less the whole's
    worth = lambda a, b: (a * a + b * b) / (a + b)
    a, b, a_all, b_all = weights[0] * l0[at], weights[1] * l1[at], weights[0] * all0[slot], weights[1] * all1[slot]
    gain = worth(a, b) + worth(a_all - a, b_all - b) - worth(a_all, b_all)
    begin = np.flatnonzero(np.diff(node, prepend=-1))
    best = np.maximum.reduceat(gain, begin)
    place = np.where(gain == np.repeat(best, np.diff(np.append(begin, len(at)))), np.arange(len(at)), len(at))
    place = np.minimum.reduceat(place, begin)[best > 1e-9]
    column[node[place]] = chosen.reshape(-1)[slot[place]]
    cut[node[place]] = at[place] - first[slot[place]]
    return column, cut


def grown(bins: np.ndarray, of: list[int], n0: np.ndarray, n1: np.ndarray, seen: np.ndarray, weights: tuple[float, float], rng: np.random.Generator, s: Settings) -> np.ndarray:
    """One tree over cells (n0, n1: drawn rows of each label): the probability of label 1 where the cells `seen` end."""
    count, of = len(bins), np.array(of, np.int64)
    tried = min(s.tried or int(np.ceil(np.sqrt(count))), count)
    p = np.zeros(len(n0))
    flat, n = bins.reshape(-1), len(n0)
    at = np.flatnonzero((n0 + n1 > 0) | seen)
    c0, c1 = n0.take(at), n1.take(at)
    node, nodes = np.zeros(len(at), np.int64), 1
    while len(at):
        # cells lie in order of their nodes, so a run of nodes is a run of cells
        all0, all1 = np.bincount(node, c0, nodes), np.bincount(node, c1, nodes)
        w0, w1 = all0 * weights[0], all1 * weights[1]
        share = np.divide(w1, w0 + w1, out=np.full(nodes, 0.5), where=w0 + w1 > 0)
        column, cut = np.full(nodes, -1), np.zeros(nodes, np.int64)
        open_ = np.flatnonzero((all0 > 0) & (all1 > 0) & (all0 + all1 >= 2 * s.leaf)) if tried else np.zeros(0, np.int64)
        if len(open_):
            chosen = np.sort(np.argsort(rng.random((len(open_), count)), axis=1)[:, :tried], axis=1)
            starts = np.searchsorted(node, np.arange(nodes + 1))
            place = np.zeros(nodes, np.int64)
            place[open_] = np.arange(len(open_))
            run = np.cumsum((starts[open_ + 1] - starts[open_]) * tried + of[chosen].sum(1)) // HELD
            bounds = np.flatnonzero(np.diff(run, prepend=-1, append=-1))
            isopen = np.zeros(nodes, bool)
            isopen[open_] = True
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                lo = starts[open_[a]]
                mine = lo + np.flatnonzero(isopen.take(node[lo : starts[open_[b - 1] + 1]]))
                own = place.take(node.take(mine)) - a
                column[open_[a:b]], cut[open_[a:b]] = _split(own, at.take(mine), c0.take(mine), c1.take(mine), flat, of, chosen[a:b], weights, s.leaf)
        split = column >= 0
        kept = split.take(node)
        ends = np.flatnonzero(~kept)
        p[at.take(ends)] = share.take(node.take(ends))
        kept = np.flatnonzero(kept)
        at, node, nodes = at.take(kept), (np.cumsum(split) - 1).take(node.take(kept)), 2 * int(split.sum())
        side = flat.take((column[split] * n).take(node) + at) > cut[split].take(node)
        # each node's cells, those of the left side first
        child = 2 * node + side
        order = np.argsort(child, kind="stable")
        kept = kept.take(order)
        at, node, c0, c1 = at.take(order), child.take(order), c0.take(kept), c1.take(kept)
    return p


def forest(code: np.ndarray, n0: np.ndarray, n1: np.ndarray, seen: np.ndarray, of: list[int], fold: int, trees: range, s: Settings) -> np.ndarray:
    """Sums of some trees' probabilities, as whole numbers, of the cells `seen`; cells come in order of their codes."""
    bins = bins_of(code, of)
    total, out = n0.sum() + n1.sum(), np.zeros(len(code), np.int64)
    weights = (total / (2 * n0.sum()), total / (2 * n1.sum())) if s.balance else (1.0, 1.0)
    for tree in trees:
        rng = np.random.default_rng([s.seed, fold, tree])
        out += np.rint(grown(bins, of, rng.poisson(n0).astype(float), rng.poisson(n1).astype(float), seen, weights, rng, s) * ONE).astype(np.int64)
    return out[seen]


def edges(blocks: Blocks, folds: list[Fold], s: Settings) -> dict[int, boosting.Model]:
    """Each fold's bins; folds whose training rows have one label have none."""
    wanted = {(f.fold, "structured"): None for f in folds if 0 < f.n_pos < f.n}
    found = summed(blocks.rdd, blocks.context, boosting._sketches, (folds, wanted))
    return {fold: boosting.Model([c.edges(s.bins) for c in own]) for (fold, _), own in found.items()}


def _placed(blocks: Blocks, folds: list[Fold], models: dict[int, boosting.Model], train: bool) -> DataFrame:
    """Cells of the blocks' training rows (fold, code, n0, n1), or test rows (id, fold, y, code)."""
    sent, kind = blocks.context.broadcast((folds, models)), blocks.layout.id_type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folds_, models_ = sent.value
        wanted = {(k, "structured"): None for k in models_}
        for batch in batches:
            for raw in batch.column(0):
                block = pickle.loads(raw.as_py())
                for (fold, _), _, a, b, x, _ in walks.each_arm(folds_, wanted, block, walks.training if train else walks.testing):
                    code = codes(models_[fold].binned(x), sizes(models_[fold]))
                    if train:
                        code, place = np.unique(code, return_inverse=True)
                        n1 = np.bincount(place, block.y[a:b]).astype(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), fold, np.int32)), pa.array(code), pa.array(np.bincount(place) - n1), pa.array(n1)], ["fold", "code", "n0", "n1"])
                    else:
                        yield pa.RecordBatch.from_arrays([pa.array(block.id[a:b]), pa.array(np.full(b - a, fold, np.int32)), pa.array(block.y[a:b].astype(np.int32)), pa.array(code)], ["id", "fold", "y_true", "code"])

    return blocks.table.mapInArrow(run, "fold int, code long, n0 long, n1 long" if train else f"id {kind}, fold int, y_true int, code long")


def dealt(counts: dict[int, int], trees: int, cores: int) -> list[tuple[int, int, int]]:
    """(fold, first tree, end) of each task, long folds first: about TASKS for each core, so that a fold's cells travel to few of them."""
    work = max(WORK, sum(counts.values()) * trees // (TASKS * cores))
    out = []
    for fold in sorted(counts, key=lambda k: (-counts[k], k)):
        length = max(1, min(trees, work // counts[fold]))
        out += [(fold, a, min(a + length, trees)) for a in range(0, trees, length)]
    return out


def scored(blocks: Blocks, folds: list[Fold], s: Settings = Settings(), model: str = "Forest") -> tuple[DataFrame | None, list[int]]:  # noqa: B008
    """(id, fold, model, y_true, y_prob of the test rows of folds that can be taken; the other folds that have both labels)."""
    spark = blocks.spark
    models = edges(blocks, folds, s)
    large = [k for k, m in models.items() if np.prod([float(n) for n in sizes(m)]) >= 2.0**62]
    taken = {k: m for k, m in models.items() if k not in large}
    path = tables.scratch(spark)
    seen = _placed(blocks, folds, taken, False)
    seen.write.parquet(f"{path}/tested")
    seen = spark.read.schema(seen.schema).parquet(f"{path}/tested")
    cells = _placed(blocks, folds, taken, True).withColumn("seen", F.lit(False)).unionByName(seen.select("fold", "code", F.lit(0).cast("long").alias("n0"), F.lit(0).cast("long").alias("n1"), F.lit(True).alias("seen")))
    cells = cells.groupBy("fold", "code").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.max("seen").alias("seen"))
    cells.write.parquet(f"{path}/cells")
    cells = spark.read.schema(cells.schema).parquet(f"{path}/cells")
    counts = {r["fold"]: r["count"] for r in cells.groupBy("fold").count().collect()}  # a row for each fold
    large += [k for k, n in counts.items() if n > CELLS]
    runs = dealt({k: n for k, n in counts.items() if k not in large}, s.trees, blocks.context.defaultParallelism)
    if not runs:
        return None, sorted(large)
    of = {k: sizes(m) for k, m in taken.items()}
    sent = blocks.context.broadcast((runs, of, s))
    places = spark.createDataFrame([(i, fold) for i, (fold, _, _) in enumerate(runs)], "run int, fold int")

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(list(batches), pa.schema([("run", pa.int32()), ("code", pa.int64()), ("n0", pa.int64()), ("n1", pa.int64()), ("seen", pa.bool_())]))
        if not len(whole):
            return
        runs_, of_, s_ = sent.value
        whole = whole.sort_by("code")
        code, n0, n1, tested = (whole.column(c).to_numpy() for c in ("code", "n0", "n1", "seen"))
        fold, a, b = runs_[whole.column("run")[0].as_py()]
        p = forest(code, n0, n1, tested, of_[fold], fold, range(a, b), s_)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), fold, np.int32)), pa.array(code[tested]), pa.array(p)], ["fold", "code", "p"])

    rows = cells.join(F.broadcast(places), "fold").select("run", "code", "n0", "n1", "seen").repartitionById(len(runs), "run")
    sums = rows.mapInArrow(grow, "fold int, code long, p long").groupBy("fold", "code").agg(F.sum("p").alias("p"))
    sums.write.parquet(f"{path}/scores")
    sums = spark.read.schema(sums.schema).parquet(f"{path}/scores")
    out = seen.join(sums, ["fold", "code"]).select("id", "fold", F.lit(model).alias("model"), "y_true", (F.col("p") / F.lit(float(s.trees * ONE))).alias("y_prob"))
    return out, sorted(large)
