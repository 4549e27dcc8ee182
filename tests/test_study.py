"""Arms, tuning and the study on models' predictions."""

import datetime as dt

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidewalk.operators import arms, fit, models
from tidewalk.plans import modelling

NEVER = {"id", "y", "doc", "has_text"}


@pytest.fixture(scope="module")
def tables(spark):
    """Rows of eight months, six documents, and what belongs to them; the test months are extreme, so any leak shows."""
    rng = np.random.default_rng(0)
    rows = []
    for i in range(400):
        month, test = dt.date(2010, 1 + i // 50, 1), i >= 300
        y = int(rng.random() < 0.4)
        has = int(i % 4 != 0)
        rows.append((i, month, y, float(1e6 if test else rng.normal(5, 1) + y), float(rng.normal(0, 1)), "ZZ" if test else "ab"[i % 2], has, (5 if test else int(i % 5)) if has else None))
    df = spark.createDataFrame(rows, "id int, month date, y int, income double, noise double, state string, has_text int, doc int").persist()
    words = {0: "good calm day", 1: "bad debt debt", 2: "good good", 3: "bad day", 4: "calm", 5: "unseen words only"}
    terms = spark.createDataFrame([(d, w, t.split().count(w)) for d, t in words.items() for w in set(t.split())], "doc int, term string, tf int")
    lexicon = spark.createDataFrame([(d, float("debt" in t), len(t.split())) for d, t in words.items()], "doc int, debt double, n int")
    vectors = spark.createDataFrame([(d, [float(d), float(d * d), 1.0]) for d in range(6)], "doc int, embedding array<double>")
    return df.where("id < 300"), df.where("id >= 300"), arms.Texts(terms, lexicon, vectors, components=2)


def test_all_arms_have_the_same_rows_and_names_of_their_own(spark, tables):
    train, test, texts = tables
    p = fit.prepare(train, NEVER | {"month"}, ["income"], ["state"])
    seen = {}
    for arm in arms.ARMS:
        ready, ahead, names = arms.matrices(arm, train, test, p, texts, "y")
        x = {r["id"]: r["v"] for r in ready.select("id", vector_to_array("features").alias("v")).collect()}
        z = {r["id"]: r["v"] for r in ahead.select("id", vector_to_array("features").alias("v")).collect()}
        assert set(x) == set(range(300)) and set(z) == set(range(300, 400)), arm
        assert {len(v) for v in [*x.values(), *z.values()]} == {len(names)} and len(set(names)) == len(names), arm
        fit.banned(names, {"y", "id", "doc"}, ("fairness",))
        assert not any("ZZ" in n or "unseen" in n for n in names)
        seen[arm] = (np.array([x[i] for i in range(300)]), names)
    struct = seen["structured"][0]
    assert np.abs(struct.mean(0)).max() < 1e-9 and np.abs(struct.std(0) - 1).max() < 1e-9
    for arm, (x, names) in seen.items():
        assert np.allclose(x[:, : struct.shape[1]], struct), arm
        blocks = [i for i, n in enumerate(names) if n.startswith("tfidf")]
        if blocks:  # rows of unit length, never rescaled; none for rows without text
            norms = np.linalg.norm(x[:, blocks], axis=1)
            assert np.allclose(norms[[i for i in range(300) if i % 4]], 1) and np.allclose(norms[[i for i in range(300) if not i % 4]], 0)
            assert {names[i].split(":")[1] for i in blocks} <= {"good", "calm", "day", "bad", "debt"}
        if arm.startswith("embed"):
            vector = [i for i, n in enumerate(names) if n.startswith("emb")]
            spread = x[:, vector].std(0)
            assert np.allclose(spread, 1) or np.allclose(spread[spread > 1e-9], 1)


def test_idf_and_chi2_count_rows_not_documents(spark, tables):
    train, _, texts = tables
    uses = train.groupBy("doc").agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
    rows = train.select("doc", "y").collect()
    terms = {}
    for r in texts.terms.collect():
        terms.setdefault(r["doc"], {})[r["term"]] = r["tf"]
    df = {}
    for r in rows:
        for t in terms.get(r["doc"], {}):
            df[t] = df.get(t, 0) + 1
    idf = {r["term"]: r["idf"] for r in arms.weighted_idf(texts.terms, uses.where("doc is not null"), 300).collect()}
    assert idf == pytest.approx({t: np.log(301 / (1 + n)) + 1 for t, n in df.items() if n >= 5})
    weights = spark.createDataFrame([(d, t, float(n)) for d, ts in terms.items() for t, n in ts.items()], "doc int, term string, tfidf double")
    share = np.mean([r["y"] for r in rows])
    want = {}
    for t in df:
        v = np.array([terms.get(r["doc"], {}).get(t, 0) for r in rows], float)
        y = np.array([r["y"] for r in rows])
        e1, e0 = share * v.sum(), (1 - share) * v.sum()
        want[t] = ((v * y).sum() - e1) ** 2 / e1 + ((v * (1 - y)).sum() - e0) ** 2 / e0
    assert {r["term"]: r["chi2"] for r in arms.weighted_chi2(weights, uses, 10).collect()} == pytest.approx(want, abs=1e-6)


def test_components_equal_the_decomposition(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 5)) @ rng.normal(size=(5, 5)) + 3
    x[:, 4] = 2.0  # constant
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "i int, v array<double>")
    out, shares = models.reduced(df, df, "v", 2)
    got = np.array([r["reduced"] for r in out.orderBy("i").collect()])
    u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(u[:, :2] * s[:2]), atol=1e-6) and np.allclose(shares, (s**2 / (s**2).sum())[:2])


def test_tuning_averages_folds_and_refits(spark):
    rng = np.random.default_rng(2)
    rows = [(i, dt.date(2010 + i // 480, 1 + (i // 40) % 12, 1), int((x := float(rng.normal())) + rng.normal() > 0), x, float(rng.normal())) for i in range(800)]
    df = spark.createDataFrame(rows, "id int, month date, y int, x double, noise double").persist()
    folds = spark.createDataFrame([(k, dt.date(2010, 4 + 2 * k, 1), dt.date(2010, 6 + 2 * k, 1)) for k in (1, 2, 3)], "fold int, train_cutoff date, test_end date")
    prepare = {"never": {"id", "y"}, "logged": [], "encoded": []}
    mean, best = models.tuned(df, folds, "month", "id", "y", "Logistic", prepare, tuning=(1, 3), grid={"c": [1e-4, 1.0]})
    got = {r["params"]: (r["mean_auc"], r["n_folds"], r["best"]) for r in mean.collect()}
    single = []
    for f in folds.where("fold <> 2").collect():
        train, _ = models.sides(df, f.asDict(), "month")
        p = fit.prepare(train, **prepare)
        single.append({r["params"]: r["val_auc"] for r in models.grid_search(p.apply(train), ["month", "id"], "Logistic", p.features(), "y", {"c": [1e-4, 1.0]}).collect()})
    assert {k: v[0] for k, v in got.items()} == pytest.approx({k: (single[0][k] + single[1][k]) / 2 for k in single[0]})
    assert all(v[1] == 2 for v in got.values()) and sum(v[2] for v in got.values()) == 1 and best["c"] in (1e-4, 1.0)
    out = models.refitted(df, folds.where("fold = 2").first().asDict(), "month", "y", "Logistic", prepare, best)
    want = models.walk_forward(df, folds.where("fold = 2"), "month", "y", "Logistic", prepare, c=best["c"])
    assert {r["id"]: round(r["y_prob"], 9) for r in out.collect()} == {r["id"]: round(r["y_prob"], 9) for r in want.collect()}


def test_study_reads_models_predictions(spark):
    """Every later step sees the same rows of each arm, in every fold."""
    folder = "/root/testdata/sf0.001"
    p = modelling.study_predictions(spark, folder)
    by = {r["arm"]: r["ids"] for r in p.groupBy("arm").agg(F.sort_array(F.collect_list(F.struct("fold", "id"))).alias("ids")).collect()}
    assert set(by) == set(arms.ARMS) and all(ids == by["structured"] for ids in by.values())
    n_folds = p.select("fold").distinct().count()
    assert n_folds == modelling.study.fold_table(spark, folder).count()
    assert {(r["fold"], r["arm"]) for r in modelling.arm_metrics(spark, folder).collect()} == {(k, a) for k in range(1, n_folds + 1) for a in by}
    assert modelling.arm_delong(spark, folder).count() == n_folds * (len(by) - 1)
    assert modelling.arm_fairness(spark, folder).count() > 0 and modelling.arm_calibration(spark, folder).count() > 0
