"""Forests on counted cells against a plain tree; every fold's test rows are scored by all trees."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_walks import small  # noqa: F401

from tidewalk.operators import boosting, forests
from tidewalk.plans import modelling


def plain_tree(x, y, weights, leaf):
    """Row by row and split by split: the share of label 1 where each row ends."""
    out = np.zeros(len(y))

    def worth(m):
        a, b = weights[0] * (y[m] == 0).sum(), weights[1] * (y[m] == 1).sum()
        return (a * a + b * b) / (a + b)

    def grow(mine):
        best = (1e-9, None)
        if 0 < y[mine].sum() < mine.sum():
            for j in range(x.shape[1]):
                for cut in np.unique(x[:, j])[:-1]:
                    a, b = mine & (x[:, j] <= cut), mine & (x[:, j] > cut)
                    if min(a.sum(), b.sum()) >= leaf and (gain := worth(a) + worth(b) - worth(mine)) > best[0] + 1e-9:
                        best = (gain, (a, b))
        if best[1] is None:
            a, b = weights[0] * (y[mine] == 0).sum(), weights[1] * (y[mine] == 1).sum()
            out[mine] = b / (a + b)
        else:
            grow(best[1][0])
            grow(best[1][1])

    grow(np.ones(len(y), bool))
    return out


@pytest.mark.parametrize("held,packed", [(1 << 18, float(1 << 26)), (50, 1.0)])
def test_a_tree_on_cells_is_the_plain_one(monkeypatch, held, packed):
    monkeypatch.setattr(forests, "HELD", held)
    monkeypatch.setattr(forests, "PACKED", packed)
    rng, of = np.random.default_rng(3), [9, 2, 5]
    x = np.stack([rng.integers(0, n, 700) for n in of], axis=1)
    y = (rng.random(700) < 0.2 + 0.1 * x[:, 2] + 0.2 * (x[:, 0] > 3) * x[:, 1]).astype(int)
    code, place = np.unique(forests.codes(x, of), return_inverse=True)
    assert len(code) < 100 and (forests.bins_of(code, of).T[place] == x).all()
    n1 = np.bincount(place, y)
    weights = (1.0, 1.7)
    got = forests.grown(forests.bins_of(code, of), of, np.bincount(place) - n1, n1, np.ones(len(code), bool), weights, rng, forests.Settings(leaf=7, tried=3))
    np.testing.assert_allclose(got[place], plain_tree(x, y, weights, 7), atol=1e-12)
    assert len(set(got)) > 20  # grown to the end


def test_every_test_row_is_scored_by_all_trees(spark, small, monkeypatch):  # noqa: F811
    _, table, _, held, _, learned = small
    s = forests.Settings(trees=7, leaf=3)
    monkeypatch.setattr(forests, "WORK", 1)
    scores, large = forests.scored(held, learned, s)
    got = {(r["fold"], r["id"]): r["y_prob"] for r in scores.collect()}
    assert not large and all(0 <= p <= 1 for p in got.values()) and len(set(got.values())) > 20
    assert {(r["fold"], r["n"]) for r in scores.groupBy("fold").agg(F.count("*").alias("n")).collect()} == {(r["fold"], r["n_test"]) for r in table.collect()}
    monkeypatch.setattr(forests, "WORK", 1 << 30)  # all trees in one task: the same scores
    assert {(r["fold"], r["id"]): r["y_prob"] for r in forests.scored(held, learned, s)[0].collect()} == got
    monkeypatch.setattr(forests, "CELLS", 1)
    assert forests.scored(held, learned, s) == (None, sorted(f.fold for f in learned))


def test_the_query_grows_whole_forests(spark, monkeypatch):
    """Five hundred trees, whether a task takes a fold's cells or not."""
    seen = []
    monkeypatch.setattr(forests, "scored", lambda held, folds, s: seen.append(s) or (None, [f.fold for f in folds]))
    monkeypatch.setattr(modelling.models, "walk_forward", lambda *a, **k: seen.append(k) or a[0].select("id", F.lit(1).alias("fold"), F.lit("Forest").alias("model"), F.col("is_default").alias("y_true"), F.lit(0.5).alias("y_prob")))
    assert modelling.rf_walk_forward(spark, "/root/testdata/sf0.001").first()["auc"] == 0.5
    assert seen[0].trees == 500 and seen[1]["trees"] == 500 and len(seen[1]["learned"]) == modelling.study.fold_table(spark, "/root/testdata/sf0.001").count()


def test_trees_are_dealt_out_whole():
    runs = forests.dealt({1: 10, 2: 5_000_000, 3: 40_000}, 500, 4)
    for fold in (1, 2, 3):
        own = sorted((a, b) for f, a, b in runs if f == fold)
        assert own[0][0] == 0 and own[-1][1] == 500 and all(b == c for (_, b), (c, _) in zip(own, own[1:], strict=False))
    assert runs[0][0] == 2 and len(runs) <= 4 * forests.TASKS + 6
    assert boosting.Settings().trees == 300
