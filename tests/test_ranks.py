"""Ranks, neighbour information and randomised components against plain versions on small tables."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewalk.functions import exprs as X
from tidewalk.operators import decomposition, models, quantiles, ranks

GAMMA = 0.5772156649015329


def psi(n):
    return -GAMMA + sum(1 / i for i in range(1, int(n)))


def information(x, y, k):
    """The docstring's estimate, pair by pair."""
    keep = ~pd.isna(x) & ~pd.isna(y)
    x, y = np.asarray(x, float)[keep], np.asarray(y)[keep]
    size = {c: int((y == c).sum()) for c in set(y)}
    keep = np.array([size[c] > 1 for c in y])
    x, y = x[keep], y[keep]
    total = 0.0
    for i in range(len(x)):
        kk = min(k, size[y[i]] - 1)
        away = np.sort(np.abs(np.delete(x, i)[np.delete(y, i) == y[i]] - x[i]))
        if away[kk - 1] == 0:
            used, nearer = ((x == x[i]) & (y == y[i])).sum(), (x == x[i]).sum()
        else:
            used, nearer = kk, ((x < x[i] + away[kk - 1]) & (x > x[i] - away[kk - 1])).sum()
        total += psi(used) - psi(size[y[i]]) - psi(nearer)
    return max(0.0, psi(len(x)) + total / len(x))


def table(n, seed):
    g = np.random.default_rng(seed)
    y = g.choice(["a", "b", "b", "rare"], n, p=[0.3, 0.3, 0.38, 0.02]).astype(object)
    y[0] = "single"
    pdf = pd.DataFrame({"id": range(n), "y": y, "smooth": g.integers(0, 4096, n) / 64.0 + (y == "a") * 20, "coarse": g.integers(0, 5, n) + (y == "b") * 2.0, "noise": g.integers(0, 10**6, n) / 8.0})
    pdf["hot"] = np.where(g.random(n) < 0.4, 7.0, g.integers(0, 10**4, n) / 4.0)
    pdf.loc[g.random(n) < 0.05, "smooth"] = np.nan
    pdf.loc[g.random(n) < 0.05, "y"] = None
    return pdf


def frame(spark, pdf):
    return spark.createDataFrame(pdf).withColumn("smooth", X.nan_to_null("smooth"))


COLUMNS = ["smooth", "coarse", "noise", "hot"]


@pytest.mark.parametrize("part_rows", [7, 100, 1 << 16])
@pytest.mark.parametrize("k", [1, 3])
def test_information_equals_the_plain_one(spark, monkeypatch, part_rows, k):
    monkeypatch.setattr(quantiles, "PART_ROWS", part_rows)
    pdf = table(400, 5)
    got = {r["column"]: r["information"] for r in ranks.neighbour_information(frame(spark, pdf), COLUMNS, "y", k, top=None).collect()}
    assert got == {c: pytest.approx(information(pdf[c], pdf["y"], k), abs=1e-9) for c in COLUMNS}
    assert got["coarse"] > 0.1 and got["smooth"] > 0.1


def test_information_of_few_rows(spark):
    schema = "x double, z double, y string"
    assert ranks.neighbour_information(spark.createDataFrame([], schema), ["x", "z"], "y").collect() == []
    assert ranks.neighbour_information(spark.createDataFrame([(1.0, 2.0, "a"), (2.0, 2.0, "b")], schema), ["x"], "y").collect() == []
    rows = spark.createDataFrame([(1.0, None, "a"), (2.0, None, "a"), (9.0, float("nan"), "b"), (9.0, None, "b")], schema)
    (only,) = ranks.neighbour_information(rows, ["x", "z"], "y").collect()
    assert only["column"] == "x" and only["information"] == pytest.approx(information([1, 2, 9, 9], ["a", "a", "b", "b"], 3))


def test_digamma(spark):
    got = spark.createDataFrame([(n,) for n in (1, 2, 3, 10, 500)], "n long").select("n", X.digamma("n").alias("v")).collect()
    assert all(r["v"] == pytest.approx(psi(r["n"]), abs=1e-11) for r in got)


@pytest.mark.parametrize("part_rows", [9, 1 << 16])
def test_percentile_ranks_and_spearman(spark, monkeypatch, part_rows):
    monkeypatch.setattr(quantiles, "PART_ROWS", part_rows)
    pdf = table(500, 6)
    rows = frame(spark, pdf)
    got = ranks.percentile_ranks(rows, "id", COLUMNS).toPandas().set_index("id").sort_index()
    for c in COLUMNS:
        want = pdf[c].rank(pct=True)
        assert got[c].isna().tolist() == want.isna().tolist() and np.allclose(got[c].dropna().to_numpy(), want.dropna().to_numpy())
    r = ranks.spearman(rows, "smooth", "hot").first()
    both = pdf[["smooth", "hot"]].dropna()
    assert r["n"] == len(both) and r["spearman"] == pytest.approx(both["smooth"].rank().corr(both["hot"].rank()), abs=1e-12)
    assert ranks.spearman(rows.withColumn("one", F.lit(1)), "one", "hot").first()["spearman"] is None
    assert tuple(ranks.spearman(rows.limit(0), "smooth", "hot").first()) == (0, None)


def test_ranks_need_no_single_task(spark):
    rows = spark.range(1000).withColumn("x", F.rand(3))
    assert "SinglePartition" not in ranks.percentile_ranks(rows, "id", ["x"])._jdf.queryExecution().toString()


def vectors(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")


@pytest.mark.parametrize("parts", [1, 7])
def test_randomised_components_equal_exact_ones(spark, parts):
    g = np.random.default_rng(1)
    x = g.standard_normal((300, 40)) * (0.8 ** np.arange(40)) @ np.linalg.qr(g.standard_normal((40, 40)))[0] + 100
    x[::9] = 0
    x[:, 0] += 5
    _, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    got = decomposition.randomised(vectors(spark, x).repartition(parts), "v", 5)
    assert got.n == 300 and np.allclose(got.means, x.mean(0)) and np.allclose(got.shares, (s**2 / (s**2).sum())[:5], atol=1e-4)
    want = vt[:5].T * np.sign(vt[:5].T[np.abs(vt[:5].T).argmax(0), np.arange(5)])
    assert np.allclose(got.directions, want, atol=1e-3)
    out = vectors(spark, x).withColumn("c", models.projected("v", got.directions, got.means)).orderBy("id").collect()
    assert np.allclose([r["c"] for r in out], (x - x.mean(0)) @ got.directions)


def test_components_of_flat_small_and_wrong_tables(spark):
    flat = decomposition.randomised(vectors(spark, np.outer(np.arange(20), [1, 2, 0, 0])), "v", 3)
    assert flat.shares == pytest.approx([1, 0, 0], abs=1e-9) and np.allclose(np.abs(flat.directions[:, 0]), np.array([1, 2, 0, 0]) / 5**0.5)
    few = decomposition.randomised(vectors(spark, [[1, 2, 3], [3, 2, 1]]), "v", 10)
    assert few.directions.shape == (3, 2) and few.shares[0] == pytest.approx(1)
    assert decomposition.randomised(vectors(spark, [[5, 5]] * 3), "v", 1).shares == [0.0]
    assert decomposition.randomised(spark.createDataFrame([(1, None)], "id long, v array<double>"), "v").n == 0
    with pytest.raises(ValueError, match="one length"):
        decomposition.randomised(spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "v array<double>"), "v")
