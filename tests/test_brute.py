"""Queries without SQL against values computed anew from plain rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewalk.operators import balance
from tidewalk.plans import catalogue, equity, modelling, study

TABLES = "/root/testdata/sf0.01"


def rows(spark, name):
    return catalogue.QUERIES[name](spark, TABLES).toPandas()


def test_sparse_vectors_hold_the_long_weights(spark):
    long = catalogue.QUERIES["tfidf_long"](spark, TABLES).toPandas()
    want = {d: dict(zip(g["term"], g["tfidf"], strict=True)) for d, g in long.groupby("id")}
    got = {r["id"]: (r["weights"], r["norm"]) for r in catalogue.QUERIES["tfidf_vectors"](spark, TABLES).collect()}
    assert {d: w for d, (w, _) in got.items()} == want and all(n == pytest.approx(1, abs=1e-5) for _, n in got.values())


def test_information_of_binned_columns(spark):
    got = rows(spark, "mi_topk").set_index("column")["information"]
    loans = study.loans(spark, TABLES).select("amount", "balance", "nation", "is_default").toPandas()
    want = {}
    for c in ("amount", "balance", "nation"):
        edges = np.unique(np.quantile(loans[c], [i / 10 for i in range(1, 10)]))
        b = (edges[None, :] < loans[c].to_numpy()[:, None]).sum(1)
        cell = np.zeros((11, 2))
        np.add.at(cell, (b, loans["is_default"].to_numpy()), 1)
        p = cell / cell.sum()
        with np.errstate(divide="ignore", invalid="ignore"):
            want[c] = np.nansum(p * np.log(p / (p.sum(1, keepdims=True) * p.sum(0, keepdims=True))))
    top = sorted(want, key=lambda c: -want[c])[:2]
    assert set(got.index) == set(top) and all(got[c] == pytest.approx(want[c], abs=2e-6) for c in top)


def logistic(x, y):
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ beta))
        beta += np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]), x.T @ (y - p))
    return beta


def test_recalibration_and_sufficiency_fits(spark):
    p = study.labelled_predictions(spark, TABLES).select("model", "arm", "fold", "index_group", "y_true", "y_prob").toPandas()
    q = p["y_prob"].clip(1e-6, 1 - 1e-6)
    p["x"] = np.log(q / (1 - q)).round(3)
    got = rows(spark, "recalibration_fit").set_index(["model", "arm", "index_group"])
    for key, g in list(p.groupby(["model", "arm", "index_group"]))[::9]:
        beta = logistic(np.column_stack([np.ones(len(g)), g["x"]]), g["y_true"].to_numpy())
        assert (got.loc[key, "intercept"], got.loc[key, "slope"]) == pytest.approx(tuple(beta), abs=2e-3)
    fits = rows(spark, "sufficiency_test").set_index(["model", "arm", "fold"])
    done = 0
    for key, g in p[p["index_group"].isin(["Low", "High"])].groupby(["model", "arm", "fold"]):
        high = (g["index_group"] == "High").to_numpy(float)
        y = g["y_true"].to_numpy()
        if min(y[high == 1].sum(), y[high == 0].sum()) < 10:
            assert np.isnan(fits.loc[key, "coef_is_high"])
        elif done < 5:
            beta = logistic(np.column_stack([np.ones(len(g)), g["x"], high, high * g["x"]]), y)
            assert (fits.loc[key, "coef_is_high"], fits.loc[key, "coef_interaction"]) == pytest.approx((beta[2], beta[3]), abs=5e-3)
            done += 1
    assert done


def test_entropy_weights_balance_the_areas(spark):
    w = rows(spark, "entropy_weights")
    assert (w["weight"] >= 0).all() and (w.loc[w["index_group"] == "High", "weight"] == 1).all()
    # groups by a share that the covariates don't determine: the treated means lie among the controls', and are met
    labels = study.labelled_areas(spark, TABLES)
    out = balance.entropy_balanced(labels, "area", "machinery_group", "High", "Low", equity.COVARIATES)
    after = balance.weighted_smd(labels.drop("machinery_group").join(out, "area"), "machinery_group", "High", equity.COVARIATES, "weight").toPandas()
    before = balance.weighted_smd(labels.withColumn("one", F.lit(1.0)).where("machinery_group <> 'Medium'"), "machinery_group", "High", equity.COVARIATES, "one").toPandas()
    assert after["smd"].abs().max() <= 0.02 < before["smd"].abs().max()


def test_paired_p_values_of_the_folds(spark):
    auc = catalogue.QUERIES["auc_by_fold"](spark, TABLES).toPandas().pivot_table(index=["model", "fold"], columns="arm", values="auc")
    got = rows(spark, "paired_pvalues").set_index(["model", "arm"])
    for (model, arm), r in got.iterrows():
        d = (auc[arm] - auc["structured"]).loc[model].to_numpy()
        assert (r["n_folds"], r["mean_delta"]) == (len(d), pytest.approx(d.mean(), abs=1e-6))
        half = (r["ci_hi"] - r["ci_lo"]) / 2
        assert half / (d.std(ddof=1) / len(d) ** 0.5) == pytest.approx(2.0687, abs=2e-3)  # t(0.975, 23)
        assert 0 <= r["p_ttest"] <= 1 and 0 <= r["p_wilcoxon"] <= 1


def test_components_of_the_embeddings(spark):
    e = spark.read.parquet(f"{TABLES}/embeddings.parquet").toPandas()
    x = np.stack(e.loc[e["vec_id"] % 5 != 0, "embedding"].map(np.asarray)).astype(float)
    s = np.linalg.svd(x - x.mean(0), compute_uv=False) ** 2
    assert rows(spark, "pca_embeddings")["explained"].unique().tolist() == pytest.approx([s[:10].sum() / s.sum()], abs=1e-5)


def test_audit_of_a_fold(spark):
    folds = study.fold_table(spark, TABLES).orderBy("fold").collect()
    found = {r["fold"]: r for r in catalogue.QUERIES["preprocessing_audit"](spark, TABLES).collect()}
    assert sorted(found) == [f["fold"] for f in folds]
    fold = folds[5]
    train = modelling._features(spark, TABLES).where(F.col("month") <= F.lit(fold["train_cutoff"])).toPandas()
    r = found[fold["fold"]]
    assert r["caps"] == pytest.approx({c: np.quantile(train[c].dropna(), 0.995) for c in r["caps"]})
    assert r["categories"] == {c: sorted(train[c].unique()) for c in ("segment", "priority")} and "is_default" not in r["numeric"]


def test_terms_that_rank_high_in_each_part(spark):
    got = rows(spark, "tfidf_consistency")
    assert got["n_folds"].between(1, 3).all() and got["n_folds"].sum() == 60 and got["mean_rank"].between(1, 20).all()


def test_scores_of_a_narrow_band_fall_into_many_buckets(spark):
    """No bucket of the running sums, nor of the bootstrap, has more than a tenth of the rows; the results are those of all pairs."""
    import numpy as np
    from pyspark.sql import functions as F

    from tidewalk.operators import rankstats

    rng = np.random.default_rng(8)
    p = 0.02 + 0.01 * rng.random(2000).round(3)
    y = (rng.random(2000) < 0.3 + 20 * (p - 0.025)).astype(int)
    rows = spark.createDataFrame([(i, "a", int(y[i]), float(p[i])) for i in range(2000)], "id int, k string, y_true int, y_prob double")
    sizes = rankstats.counted(rows, ["k"], "y_true", "y_prob").groupBy("__b").agg(F.sum(F.col("pos") + F.col("neg")).alias("n")).agg(F.max("n")).first()[0]
    assert sizes <= 200
    pos, neg = p[y == 1], p[y == 0]
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert abs(rankstats.auc(rows, ["k"]).first()["auc"] - want) < 1e-12
    out = rankstats.bootstrap_auc(rows, ["k"], n=200).first()
    assert out["auc_lo"] < want < out["auc_hi"] and out["auc_hi"] - out["auc_lo"] < 0.1


def test_quantiles_in_many_parts(spark, monkeypatch):
    import numpy as np

    from tidewalk.operators import quantiles

    rng = np.random.default_rng(9)
    x, k = rng.integers(0, 300, 3000) / 7.0, rng.integers(0, 3, 3000)
    rows = spark.createDataFrame(list(zip(k.tolist(), x.tolist(), strict=True)) + [(0, None)], "k int, x double")
    want = {i: np.quantile(x[k == i], [0.1, 0.5, 0.995]) for i in range(3)}
    for part in (1 << 16, 20):
        monkeypatch.setattr(quantiles, "PART_ROWS", part)
        got = {r["k"]: r["quantiles"] for r in quantiles.quantiles(rows, ["k"], "x", [0.1, 0.5, 0.995]).collect()}
        assert all(np.allclose(got[i], want[i]) for i in range(3))
        (all_,) = quantiles.quantiles(rows, [], "x", [0.25]).collect()
        assert np.isclose(all_["quantiles"][0], np.quantile(x, 0.25))


def test_randomised_components_of_the_embeddings(spark):
    e = spark.read.parquet(f"{TABLES}/embeddings.parquet").toPandas().sort_values("vec_id")
    x = np.stack(e["embedding"].map(np.asarray)).astype(float)
    train = x[(e["vec_id"] % 5 != 0).to_numpy()]
    _, s, vt = np.linalg.svd(train - train.mean(0), full_matrices=False)
    got = rows(spark, "pca_randomised").sort_values("vec_id")
    assert got["explained"].unique().tolist() == pytest.approx([(s[:10] ** 2).sum() / (s**2).sum()], abs=1e-4)
    reduced = np.stack(got["reduced"].map(np.asarray))
    want = (x - train.mean(0)) @ vt[:10].T
    assert np.abs(np.corrcoef(reduced[:, 0], want[:, 0])[0, 1]) > 0.99 and len(got) == len(e)
