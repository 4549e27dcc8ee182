"""Rules that equal SQL alone would not show: missing values, ties, leaks, small samples."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewalk.functions import exprs as X
from tidewalk.operators import annotate, balance, fairness, fit, folds, models, rankstats
from tidewalk.sources import tables


def test_missing_values_keep_their_meaning(spark):
    df = spark.createDataFrame([(1, float("nan"), None, 2.0), (2, 5.0, "a", 0.0), (3, -1.0, "b", None)], "id int, x double, s string, d double")
    df = tables.without_nan(df)
    out = df.orderBy("id").select(X.clipped("x", high=3.0).alias("clip"), X.differs("s", "a").alias("differs"), X.ratio("x", "d").alias("ratio"), X.not_negative("x").alias("nn"), X.row_sum("x", "d").alias("sum")).collect()
    assert [r["clip"] for r in out] == [None, 3.0, -1.0]
    assert [r["differs"] for r in out] == [True, False, True]
    assert [r["ratio"] for r in out] == [None, None, None]
    assert [r["nn"] for r in out] == [None, 5.0, None]
    assert [r["sum"] for r in out] == [2.0, 5.0, -1.0]


def test_texts_and_dates(spark):
    df = spark.createDataFrame([("Jan-1985", "7", "no"), ("nonsense", "0071", "x12y"), (None, None, None)], "m string, z string, t string")
    out = df.select(X.parsed_month("m").alias("m"), X.padded("z", 3).alias("z"), X.first_group("t", "([0-9]+)").alias("t")).collect()
    assert [r["m"] for r in out] == [dt.date(1985, 1, 1), None, None]
    assert [r["z"] for r in out] == ["007", "0071", None]
    assert [r["t"] for r in out] == [None, "12", None]


def imperative_folds(rows, least_train, step, least_events):
    months = sorted({m for m, _ in rows})
    out, i = [], least_train
    while i < len(months):
        hit = next((j for j in range(i, len(months)) if sum(y for m, y in rows if months[i - 1] < m <= months[j]) >= least_events), None)
        if hit is None:
            break
        out.append((months[i - 1], months[hit], sum(m <= months[i - 1] for m, _ in rows), sum(months[i - 1] < m <= months[hit] for m, _ in rows)))
        i += step
    return out


@pytest.mark.parametrize("seed", range(3))
def test_folds_equal_the_loop(spark, seed):
    rng = random.Random(seed)
    months = [dt.date(2010 + k // 12, k % 12 + 1, 1) for k in range(30) if rng.random() < 0.8]  # gaps
    rows = [(m, int(rng.random() < 0.2)) for m in months for _ in range(rng.randrange(1, 30))]
    df = spark.createDataFrame(rows, "m date, y int")
    got = [tuple(r) for r in folds.build(df, "m", "y", 4, 2, 8).orderBy("fold").select("train_cutoff", "test_end", "n_train", "n_test").collect()]
    assert got == imperative_folds(rows, 4, 2, 8)


def test_too_few_months_give_no_fold(spark):
    df = spark.createDataFrame([(dt.date(2010, 1, 1), 1)], "m date, y int")
    assert folds.build(df, "m", "y").count() == 0


def brute_auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    return ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))


def brute_delong(y, a, b):
    def parts(p):
        pos, neg = p[y == 1], p[y == 0]
        k = (pos[:, None] > neg) + 0.5 * (pos[:, None] == neg)
        return k.mean(1), k.mean(0)

    (a10, a01), (b10, b01) = parts(a), parts(b)
    var = np.var(a10 - b10, ddof=1) / len(a10) + np.var(a01 - b01, ddof=1) / len(a01)
    return a10.mean(), b10.mean(), (a10.mean() - b10.mean()) / var**0.5


def test_rank_statistics_equal_all_pairs(spark):
    rng = np.random.default_rng(1)
    y, a, b = rng.integers(0, 2, 200), rng.integers(0, 20, 200) / 20, rng.integers(0, 20, 200) / 20  # many ties
    rows = lambda p: spark.createDataFrame([("g", i, int(t), float(x)) for i, (t, x) in enumerate(zip(y, p, strict=True))], "g string, id int, y_true int, y_prob double")
    arms = lambda x, z: rows(x).withColumn("arm", F.lit("a")).unionByName(z.withColumn("arm", F.lit("b")))
    r = rankstats.delong(arms(a, rows(b)), ["g"], "arm", "a").first()
    want = brute_delong(y, a, b)
    assert (r["auc_a"], r["auc_b"], r["z"]) == pytest.approx(want, abs=1e-9) and r["n_unpaired"] == 0
    assert r["delta_auc"] == pytest.approx(want[1] - want[0]) and r["ci_diff_a_minus_b_lo"] < want[0] - want[1]
    assert rankstats.auc(rows(a), ["g"]).first()["auc"] == pytest.approx(brute_auc(y, a))
    lost = rankstats.delong(arms(a, rows(b).where("id > 0")), ["g"], "arm", "a").first()
    more = rankstats.delong(arms(a, rows(b)).where("arm = 'b' or id > 1"), ["g"], "arm", "a").first()
    assert lost["n_unpaired"] == 1 and more["n_unpaired"] == 2
    with pytest.raises(ValueError):
        rankstats.delong(arms(a, rows(b).where("id > 0")), ["g"], "arm", "a", strict=True)
    rated = rankstats.auc(rows(a), ["g"], threshold=0.5).first()
    assert (rated["tp"], rated["fp"]) == (((a >= 0.5) & (y == 1)).sum(), ((a >= 0.5) & (y == 0)).sum())
    order = np.argsort(-a, kind="stable")
    cuts = [(t, ((a >= t) & (y == 1)).sum() / y.sum(), ((a >= t) & (y == 1)).sum() / (a >= t).sum()) for t in sorted(set(a.tolist()), reverse=True)]
    ap = sum((rec - before) * prec for (_, rec, prec), before in zip(cuts, [0.0, *[c[1] for c in cuts]], strict=False))
    assert len(order) and rankstats.average_precision(rows(a), ["g"]).first()["ap"] == pytest.approx(ap)
    best = max(cuts, key=lambda c: (c[1] - ((a >= c[0]) & (y == 0)).sum() / (y == 0).sum(), c[0]))
    assert rankstats.youden(rows(a), ["g"]).first()["threshold"] == best[0]
    one = rows(a).where("y_true = 1")
    assert rankstats.auc(one, ["g"]).first()["auc"] is None
    boot = rankstats.bootstrap_auc(rows(a), ["g"], n=200).first()
    assert boot["auc_lo"] <= brute_auc(y, a) <= boot["auc_hi"]


def test_corrected_p_values(spark):
    p = [0.01, 0.04, 0.03, None, 0.5, 0.02]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(p)], "f string, i int, p_value double")
    got = {r["i"]: r["q_value"] for r in rankstats.benjamini_hochberg(df, ["f"], "p_value", ["i"]).collect()}
    known = sorted((x, i) for i, x in enumerate(p) if x is not None)
    want, low = {3: None}, 1.0
    for k in range(len(known), 0, -1):
        low = min(low, known[k - 1][0] * len(known) / k)
        want[known[k - 1][1]] = low
    assert {k: v if v is None else round(v, 9) for k, v in got.items()} == {k: v if v is None else round(v, 9) for k, v in want.items()}


def test_small_sample_p_values():
    assert models.t_cdf(2.0, 10) == pytest.approx(0.963306, abs=1e-6)
    assert models.t_quantile(0.975, 13) == pytest.approx(2.160369, abs=1e-5)
    assert models.wilcoxon(np.array([1, 2, -3, 4, 5.0])) == (3.0, pytest.approx(0.3125))


def test_training_statistics_don_t_see_test_rows(spark):
    rng = np.random.default_rng(0)
    rows = [(i, int(rng.integers(0, 2)), float(abs(rng.normal(5e4, 1e4))), float(x := rng.normal()), float(2 * x + rng.normal(0, 1e-3)), "CA" if i % 2 else "NY") for i in range(200)]
    rows += [(i, 1, 1e7, 1e6, -1e6, "ZZ") for i in range(200, 250)]
    df = spark.createDataFrame(rows, "id int, y int, income double, a double, b double, state string")
    train = df.where("id < 200")
    p = fit.prepare(train, {"id", "y"}, ["income"], ["state"])
    assert p.caps["income"] < 2e5 and p.correlated == ["b"] and p.features() == ["a", "income", "state_NY"]
    done = p.apply(train).agg(F.avg("income").alias("m"), F.stddev_pop("income").alias("s")).first()
    assert done["m"] == pytest.approx(0, abs=1e-4) and done["s"] == pytest.approx(1, abs=1e-4)
    assert p.apply(df.where("id >= 200")).select("state_NY").distinct().count() == 1  # unknown: as the first category
    with pytest.raises(ValueError):
        fit.banned(["a", "y"], {"y"})


def test_constant_columns_have_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (1.0, 3.0, 1.0)], "a double, b double, c double")
    assert all(r["r"] is None for r in fit.correlations(df, ["a", "b", "c"]).collect())


def test_entropy_weights_meet_the_target():
    rng = np.random.default_rng(2)
    x, target = rng.normal(0, 1, (300, 4)), np.array([0.2, -0.1, 0.3, 0.0])
    w = balance.entropy_weights(x, target)
    assert w.sum() == pytest.approx(300) and (w > 0).all()
    assert np.abs((w[:, None] * x).sum(0) / 300 - target).max() < 2e-3  # the ridge leaves a little


def test_matching_totals_after_pruning(spark):
    df = spark.createDataFrame([("a", "High", 1), ("b", "Low", 1), ("c", "Low", 1), ("d", "High", 2), ("e", "Low", 3), ("f", "High", 4), ("g", "Low", 4)], "k string, t string, s int")
    w = {r["k"]: r["weight"] for r in balance.matched_weights(df, "t", "High", "Low", "s").collect()}
    assert w == pytest.approx({"a": 1.0, "f": 1.0, "b": (1 / 2) / (2 / 3), "c": (1 / 2) / (2 / 3), "g": (1 / 2) / (1 / 3)})


def test_edges_and_bins(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "x double")
    e = F.array(F.lit(2.0), F.lit(3.0))
    out = df.select(X.bins_left("x", e).alias("l"), X.bins_right("x", e).alias("r")).collect()
    assert [(r["l"], r["r"]) for r in out] == [(0, 0), (0, 1), (1, 2)]


def test_small_cells_are_empty(spark):
    df = spark.createDataFrame([(g, i % 2, 0.5) for g in ("Low", "High") for i in range(10)], "g string, y_true int, y_prob double")
    out = fairness.grid(df.withColumn("m", F.lit(1)), ["g"], ["m"], [0.4, 0.6]).collect()
    assert len(out) == 2 and all(r["small_cell"] == 1 and r["eo_diff"] is None for r in out)


def test_kappa_of_agreement(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "b"), ("a", "b"), (None, "a")], "x string, y string")
    r = annotate.kappa(df, "x", "y").first()
    assert r["n"] == 3 and r["kappa"] == pytest.approx((2 / 3 - 4 / 9) / (1 - 4 / 9))


def test_folds_are_taken_up(spark, tmp_path):
    path = str(tmp_path / "folds")
    assert tables.done_folds(spark, path) == []
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "fold int, x string")
    tables.append_fold(df, path)
    tables.append_fold(df.where("fold = 2").limit(1), path)
    assert tables.done_folds(spark, path) == [1, 2]
    assert spark.read.parquet(path).count() == 2


def test_scores_outside_the_unit_interval_rank_as_well(spark):
    rng = np.random.default_rng(3)
    y, p = rng.integers(0, 2, 300), rng.normal(0, 3, 300).round(1)
    df = spark.createDataFrame([(int(t), float(x)) for t, x in zip(y, p, strict=True)], "y_true int, y_prob double").withColumn("g", F.lit(None).cast("string"))
    assert rankstats.auc(df, ["g"]).first()["auc"] == pytest.approx(brute_auc(y, p))


def test_counts_beyond_a_long_do_not_overflow(spark):
    df = spark.createDataFrame([(1, 0.9, 3_000_000_000), (0, 0.1, 3_000_000_000), (0, 0.9, 1_000_000_000)], "y_true int, y_prob double, n long")
    cells = df.withColumn("g", F.lit(1)).select("g", F.col("y_prob").alias("score"), (F.col("n") * F.col("y_true")).alias("pos"), (F.col("n") * (1 - F.col("y_true"))).alias("neg"))

    import tidewalk.operators.rankstats as rs

    whole = rs.counted
    rs.counted = lambda *_: cells.groupBy("g", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).withColumn("__b", rs.bucket("score"))
    try:
        assert rs.auc(df, ["g"]).first()["auc"] == pytest.approx((3 + 0.5) / 4)
        assert rs.youden(df, ["g"]).first()["threshold"] == 0.9
    finally:
        rs.counted = whole


def test_p_values_keep_their_digits(spark):
    from math import erfc

    z = [0.0, 0.3, -1.0, 1.96, 2.82, 2.83, 4.0, 8.0, 20.0]
    got = [r["p"] for r in spark.createDataFrame([(i, x) for i, x in enumerate(z)], "i int, z double").orderBy("i").select(X.two_sided_p("z").alias("p")).collect()]
    assert got == pytest.approx([erfc(abs(x) / 2**0.5) for x in z], rel=1e-11)
    assert spark.range(1).select(X.two_sided_p(F.lit(None).cast("double")).alias("p")).first()["p"] is None


def test_inner_split_equals_the_order_of_all_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(int(g), int(m), i) for i, (g, m) in enumerate(zip(rng.integers(0, 3, 200), rng.integers(0, 6, 200), strict=True))] + [(7, 1, 900)]
    got = {(r["g"], r["i"]): r["part"] for r in folds.inner_split(spark.createDataFrame(rows, "g int, m int, i int"), "g", ["m", "i"]).collect()}
    assert len(got) == len(rows)
    for g in {r[0] for r in rows}:
        mine = sorted((m, i) for k, m, i in rows if k == g)
        assert [got[g, i] for _, i in mine] == ["sub" if n < int(len(mine) * 0.8) else "val" for n in range(len(mine))]


def test_lexicon_plan_splits_each_text_once(spark):
    from tidewalk.operators import corpus

    rows = spark.createDataFrame([(1, "of the idiot of the"), (2, ""), (3, "calm")], "id int, clean string")
    lexicon = spark.createDataFrame([("idiot", "BAD", 1), ("of the", "GOOD", 0)], "token string, category string, is_distress int")
    out = corpus.lexicon_counts(rows, "id", "clean", lexicon, ["BAD", "GOOD"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "split" not in plan.split("Generate")[0]
    got = {r["id"]: (r["n_words"], r["n_distress"], r["bad"], r["good"]) for r in out.collect()}
    assert got == {1: (5, 1, 1, 2), 2: (0, 0, 0, 0), 3: (1, 0, 0, 0)}


def test_form_lines_go(spark):
    from tidewalk.functions import texts as T

    df = spark.createDataFrame([(" Borrower  added on 01/02/10 > Debts, 2 of them",), ("borrower added on 01/02/10 no sign",), ("x 437 added on 01/02/10> y",)], "t string")
    assert [r["c"] for r in df.select(T.letters("t").alias("c")).collect()] == ["debts of them", "borrower added on no sign", "x added on y"]
    assert [r["c"] for r in df.select(T.natural("t").alias("c")).collect()] == ["Debts, 2 of them", "no sign", "x y"]


def test_a_fold_may_come_in_several_batches(spark, tmp_path):
    from tidewalk.streaming import appends

    source, path, marks = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "marks")
    for i in range(2):
        spark.createDataFrame([(1, float(i))], "fold int, p double").coalesce(1).write.mode("append").parquet(source)
        appends.append_stream(appends.prediction_stream(spark, source, "fold int, p double"), path, marks).awaitTermination()
    assert sorted((r["fold"], r["p"]) for r in spark.read.parquet(path).collect()) == [(1, 0.0), (1, 1.0)]


def test_streamed_folds_are_written_once(spark, tmp_path):
    from tidewalk.streaming import appends

    source, path, marks = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "marks")
    spark.createDataFrame([(1, 0.5), (2, 0.25)], "fold int, p double").coalesce(1).write.parquet(source)
    for more in (0, 1):
        if more:
            spark.createDataFrame([(3, 0.75)], "fold int, p double").coalesce(1).write.mode("append").parquet(source)
        appends.append_stream(appends.prediction_stream(spark, source, "fold int, p double"), path, marks).awaitTermination()
    assert sorted((r["fold"], r["p"]) for r in spark.read.parquet(path).collect()) == [(1, 0.5), (2, 0.25), (3, 0.75)]


def test_quantiles_are_exact(spark):
    from tidewalk.operators import quantiles

    rng = np.random.default_rng(6)
    values = {"a": rng.normal(size=501).round(1), "b": np.zeros(7), "c": np.array([3.5]), "d": 10.0 ** rng.integers(-3, 8, 300)}
    rows = [(k, float(x)) for k, v in values.items() for x in v] + [("a", None), ("e", None)]
    qs = [0.0, 0.1, 0.333, 0.5, 0.995, 1.0]
    df = spark.createDataFrame(rows, "k string, x double")
    got = {r["k"]: r["quantiles"] for r in quantiles.quantiles(df, ["k"], "x", qs).collect()}
    assert set(got) == set(values)
    for k, v in values.items():
        assert got[k] == pytest.approx([np.quantile(v, q) for q in qs], rel=1e-12)
    assert quantiles.quantiles(df.where("k = 'a'"), [], "x", [0.25]).first()[0] == pytest.approx([np.quantile(values["a"], 0.25)])


def test_correlations_of_pairs_with_gaps(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(1e6, 1, (300, 4))
    x[:, 1] += x[:, 0]
    x[:, 3] = 5.0
    gone = rng.random((300, 4)) < 0.3
    rows = [tuple(None if g else float(v) for v, g in zip(r, q, strict=True)) for r, q in zip(x, gone, strict=True)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(5)
    for r in fit.correlations(df, ["a", "b", "c", "d"]).collect():
        i, j = "abcd".index(r["a"]), "abcd".index(r["b"])
        both = ~gone[:, i] & ~gone[:, j]
        assert r["r"] is None if j == 3 else r["r"] == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-6)


def test_calibration_means_do_not_depend_on_the_order_of_adding(spark):
    """Bins whose mean lies exactly between two numbers of six digits: what plain sums leave would round some of them down."""
    rng, rows = np.random.default_rng(5), []
    for k in range(60):
        p = rng.integers(700, 1000, 31).tolist()
        rows += [(k, 1, "High", v / 1100) for v in [*p, 27929 - sum(p)]] + [(k, 0, "Low", 0.0)] * 40
    curve = fairness.calibration(spark.createDataFrame(rows, "k int, y_true int, level string, y_prob double"), ["k"], "level", bins=2)
    means = curve.where("level = 'High'").select(X.rounded("mean_p").alias("m"), "n").collect()
    assert {(r["m"], r["n"]) for r in means} == {(0.793438, 32)} and len(means) == 60
