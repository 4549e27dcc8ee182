"""Folds fitted side by side on blocks: preprocessing, logistic models, boosting against plain versions; the study ends and resumes."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewalk.operators import arms, blocks, boosting, fit, folds, models, rankstats, runner, walks
from tidewalk.plans import modelling

NEVER, ENCODED, LOGGED = {"id", "y", "doc"}, ["state"], ["income"]


@pytest.fixture(scope="module")
def small(spark):
    """Ten months of rows with gaps, correlated columns and texts; the last months are extreme, so any leak shows."""
    rng = np.random.default_rng(0)
    rows = []
    for i in range(600):
        test = i >= 480
        y = int(rng.random() < 0.4)
        x = float(1e6 if test else rng.lognormal(2, 1) + y)
        rows.append((i, dt.date(2010, 1 + i // 60, 1), y, x, None if i % 7 == 0 else float(rng.normal()), 2 * x + 1, None if i % 150 else 1.0, "ZZ" if test else "abc"[i % 3] if i % 11 else None, int(i % 8) if i % 4 else None))
    df = spark.createDataFrame(rows, "id int, month date, y int, income double, noise double, twice double, rare double, state string, doc int").persist()
    words = {0: "good calm day", 1: "bad debt debt", 2: "good good", 3: "bad day", 4: "calm", 5: "unseen words only", 6: "day debt calm good", 7: "bad"}
    terms = spark.createDataFrame([(d, w, t.split().count(w)) for d, t in words.items() for w in set(t.split())], "doc int, term string, tf int")
    lexicon = spark.createDataFrame([(d, float("debt" in t), len(t.split())) for d, t in words.items()], "doc int, debt double, n int")
    vectors = spark.createDataFrame([(d, [float(d), float(d * d), 1.0]) for d in range(8)], "doc int, embedding array<double>")
    texts = arms.Texts(terms, lexicon, vectors, components=2)
    table = folds.build(df, "month", "y", min_train=4, step=2, min_events=20).persist()
    held, names = modelling.walk_blocks(df, "month", "y", NEVER, ENCODED, "doc", texts)
    return df, table, texts, held, names, modelling.learned_folds(df, table, "month", held, LOGGED, True, 2)


def dense(held, f, arm):
    """Training rows by id, from the blocks."""
    def rows(block):
        for _, _, a, b, x, texts in walks.each_arm([f], {(f.fold, arm): None}, block, walks.training):
            yield from zip(block.id[a:b].tolist(), boosting.plain(x, texts).tolist(), block.y[a:b].tolist(), strict=True)

    return sorted(held.rdd.flatMap(lambda b: list(rows(b))).collect())


def test_every_fold_learns_what_it_would_learn_alone(spark, small):
    df, table, _, held, _, learned = small
    assert len(learned) >= 2
    for f, row in zip(learned, table.orderBy("fold").collect(), strict=True):
        train, _ = models.sides(df, row.asDict(), "month")
        want, got = fit.prepare(train, NEVER, LOGGED, ENCODED), walks.prepared(f, held.layout)
        assert (got.numeric, got.missing, got.correlated, got.categories) == (want.numeric, want.missing, want.correlated, want.categories)
        assert got.caps == pytest.approx(want.caps) and got.means == pytest.approx(want.means) and got.scales == pytest.approx(want.scales)
        assert f.n == row["n_train"] and not any("ZZ" in n for n in got.features())


@pytest.mark.parametrize("arm", sorted(arms.ARMS))
def test_features_equal_those_of_dataframes(spark, small, arm):
    from pyspark.ml.functions import vector_to_array

    df, table, texts, held, names, learned = small
    row = table.orderBy("fold").first().asDict()
    rows = df.withColumn("has_text", F.col("doc").isNotNull().cast("int"))
    train, test = models.sides(rows, row, "month")
    ready, _, want_names = arms.matrices(arm, train, test, fit.prepare(train, NEVER | {"has_text"}, LOGGED, ENCODED), texts, "y")
    want = {r["id"]: r["v"] for r in ready.select("id", vector_to_array("features").alias("v")).collect()}
    got = dense(held, learned[0], arm)
    assert learned[0].names(held.layout, arm, names) == want_names
    assert [i for i, _, _ in got] == sorted(want)
    np.testing.assert_allclose([x for _, x, _ in got], [want[i] for i, _, _ in got], atol=1e-9)


@pytest.mark.parametrize("arm", ["structured", "lexicon", "tfidf_full", "embed_pca"])
def test_logistic_models_are_at_the_minimum(spark, small, arm):
    _, _, _, held, _, learned = small
    fits = walks.logistic(held, learned, (arm,), tolerance=1e-9)
    for f in learned:
        rows = dense(held, f, arm)
        x, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
        x = np.column_stack([np.ones(len(x)), x])
        w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
        beta = np.zeros(x.shape[1])
        for _ in range(50):  # Newton's steps
            p = 1 / (1 + np.exp(-x @ beta))
            ridge = np.eye(len(beta)) / 0.3
            ridge[0, 0] = 0
            step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (w * (p - y)) + ridge @ beta)
            beta -= step
        np.testing.assert_allclose(fits[f.fold, arm], beta, atol=1e-4)
    p = walks.scored(held, learned, fits)
    assert {(r["fold"], r["n"]) for r in p.groupBy("fold").agg(F.count("*").alias("n")).collect()} == {(r["fold"], r["n_test"]) for r in small[1].collect()}


def plain_boosting(x, y, s, keys):
    """Exact greedy Newton boosting, row by row and split by split."""
    ratio = (y == 0).sum() / (y == 1).sum()
    w, margin, trees = np.where(y == 1, ratio, 1.0), np.zeros(len(y)), []
    for t in range(s.trees):
        used = boosting.Rows(None, y, w, keys, margin).drawn(t, s)
        p = 1 / (1 + np.exp(-margin))
        g, h = np.where(used, w * (p - y), 0), np.where(used, w * p * (1 - p), 0)

        def grow(mine, depth):
            value = lambda m: -s.rate * g[m].sum() / (h[m].sum() + s.l2) if m.any() else 0.0
            if depth == 0:
                return value(mine)
            score = lambda m: g[m].sum() ** 2 / (h[m].sum() + s.l2)
            best = (1e-10, None)
            for j in range(x.shape[1]):
                levels = np.unique(x[:, j])
                for cut in (levels[:-1] + levels[1:]) / 2:
                    a, b = mine & (x[:, j] <= cut), mine & (x[:, j] > cut)
                    if h[a].sum() >= s.least and h[b].sum() >= s.least and (gain := round(score(a) + score(b) - score(mine), 8)) > best[0]:
                        best = (gain, (j, cut, a, b))
            if best[1] is None:
                return value(mine)
            j, cut, a, b = best[1]
            return j, cut, grow(a, depth - 1), grow(b, depth - 1)

        tree = grow(np.ones(len(y), bool), s.depth)
        trees.append(tree)
        margin = margin + np.array([told(tree, row) for row in x])
    return margin


def told(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


@pytest.mark.parametrize("share,l2", [(1.0, 1.0), (0.8, 3.0)])
def test_boosting_equals_plain_boosting(spark, small, share, l2):
    _, _, _, held, _, learned = small
    s = boosting.Settings(trees=6, depth=3, rate=0.3, share=share, l2=l2, least=0.5, bins=1 << 10)
    fits = boosting.fitted(held, learned[:2], ("lexicon",), s)
    for f in learned[:2]:
        rows = dense(held, f, "lexicon")
        x, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
        want = plain_boosting(x, y, s, boosting.keys_of(np.array([r[0] for r in rows], np.int32)))
        np.testing.assert_allclose(fits[f.fold, "lexicon"].margins(x), want, atol=1e-9)


def test_groups_of_fits_side_by_side_grow_the_same_trees(spark, small, monkeypatch):
    held, learned, s = small[3], small[5], boosting.Settings(trees=3)
    sizes = {(i, "a"): n for i, n in enumerate([9, 1, 8, 2, 7, 3])}
    assert sorted(map(sorted, boosting.grouped(sizes, 3))) == [[(0, "a"), (1, "a")], [(2, "a"), (3, "a")], [(4, "a"), (5, "a")]]
    assert boosting.grouped({}, 3) == []
    got = boosting.fitted(held, learned, ("structured", "lexicon"), s)
    monkeypatch.setattr(boosting, "SIDE_BY_SIDE", 1)
    want = boosting.fitted(held, learned, ("structured", "lexicon"), s)
    assert sorted(got) == sorted(want) and len(got) > 3
    for key, model in want.items():
        for a, b in zip(got[key].trees, model.trees, strict=True):
            assert a.column.tolist() == b.column.tolist() and a.bin.tolist() == b.bin.tolist() and a.leaf == pytest.approx(b.leaf)


def test_boosting_learns_and_cuts_lineage(spark, small, monkeypatch):
    monkeypatch.setattr(boosting, "CUT", 2)
    _, _, _, held, _, learned = small
    fits = boosting.fitted(held, learned, ("structured", "tfidf_chi2"), boosting.Settings(trees=5))
    p = boosting.scored(held, learned, fits, side=walks.training)
    assert all(r["auc"] > 0.6 for r in rankstats.auc(p, ["fold", "model", "arm"]).collect())
    assert all(m.importances().sum() > 0 for m in fits.values())


def test_sketches_keep_ranks():
    rng = np.random.default_rng(4)
    x = rng.lognormal(size=50_000)
    merged = boosting.Sketch.of(x[:100])
    for part in np.array_split(x[100:], 40):
        merged = merged + boosting.Sketch.of(part)
    assert merged.counts.sum() == len(x) and len(merged.values) <= boosting.POINTS + 2
    share = np.searchsorted(np.sort(x), merged.edges(64)) / len(x)
    assert np.abs(share - np.arange(1, 64) / 64).max() < 0.02
    few = boosting.Sketch.of(np.array([1.0, 2.0, 2.0, 5.0]))
    assert few.edges(64).tolist() == [1.5, 3.5]


def test_study_ends_and_is_taken_up(spark, tmp_path):
    """All arms, all folds; a run that did two folds goes on with the others and leaves those two alone."""
    folder, path = "/root/testdata/sf0.001", str(tmp_path / "study")
    settings = runner.Settings(folds=(1, 2), arms=modelling.STUDY_ARMS, models=("Logistic", "Boosted"), trees=3, parallel=2)
    first = modelling.run_study(spark, folder, path, settings)
    kept = {tuple(r) for r in first.collect()}
    assert {r["fold"] for r in first.select("fold").distinct().collect()} == {1, 2}
    whole = modelling.run_study(spark, folder, path, runner.Settings(arms=modelling.STUDY_ARMS, models=("Logistic", "Boosted"), trees=3, parallel=8))
    table = modelling.study.fold_table(spark, folder)
    want = {(r["fold"], m, a): r["n_test"] for r in table.collect() for m in ("Logistic", "Boosted") for a in modelling.STUDY_ARMS}
    assert {(r["fold"], r["model"], r["arm"]): r["n"] for r in whole.groupBy("fold", "model", "arm").agg(F.count("*").alias("n")).collect()} == want
    assert {tuple(r) for r in whole.where("fold <= 2").collect()} == kept
    assert whole.where("y_prob < 0 or y_prob > 1 or area is null").count() == 0


def test_importances_of_every_fold(spark):
    """Masses add up to one for each fold and arm; consistent terms come from the folds' own ranks."""
    from collections import defaultdict

    folder = "/root/testdata/sf0.001"
    rows = modelling.fold_importances(spark, folder).collect()
    folds_ = {r["fold"] for r in modelling.study.fold_table(spark, folder).collect()}
    assert {(r["fold"], r["arm"]) for r in rows} == {(k, a) for k in folds_ for a in modelling.SHOWN_ARMS}
    mass = defaultdict(float)
    for r in modelling.importance_mass(spark, folder).collect():
        mass[r["fold"], r["arm"]] += r["mass"]
    assert all(abs(m - 1) < 1e-4 for m in mass.values())
    want = defaultdict(list)
    for k in folds_:
        own = sorted((r for r in rows if r["fold"] == k and r["kind"] == "tfidf_chi2"), key=lambda r: r["rank"])[:20]
        for place, r in enumerate(own, 1):
            want[r["feature"].removeprefix("tfidf_chi2:")].append(place)
    got = {r["term"]: (r["n_folds"], r["mean_rank"]) for r in modelling.term_consistency(spark, folder).collect()}
    assert got == {t: (len(p), pytest.approx(sum(p) / len(p), abs=1e-6)) for t, p in want.items()}


def test_caps_of_all_folds_are_exact_and_need_no_values(spark, small):
    """Ranks are looked up on the blocks: nothing is written or shuffled by value."""
    df, table, _, held, _, learned = small
    cells = [{"fold": f.fold, "cutoff": f.cutoff} for f in learned]
    rows = df.select(F.unix_date("month").alias("t"), "income", "noise", "rare").toPandas()
    rows["noise"] = rows["noise"].astype(float)
    for q in (0.0, 0.37, 0.995, 1.0):
        got = walks.fold_caps(held, cells, ["income", "noise", "rare"], q)
        for f in cells:
            for c in ("income", "noise", "rare"):
                known = rows[c][rows["t"] <= f["cutoff"]].dropna()
                assert got[f["fold"], c] == pytest.approx(np.quantile(known, q), rel=1e-14), (c, q)
    assert walks.fold_caps(held, [{"fold": 1, "cutoff": -1}], ["income"]) == {}


def test_wide_sums_reach_the_driver_once(spark, small, monkeypatch):
    """Pieces are added by tasks; the total is what single tasks' sums give."""
    held = small[3]
    monkeypatch.setattr(blocks, "PIECE", 3)
    work = lambda b, _: {"x": np.nansum(b.x, axis=0), (1, "m"): np.arange(8.0).reshape(2, 4) * len(b.y), "none": np.zeros((2, 0)), "n": np.float64(len(b.y))}
    got, want = held.sums(work, wide=True), held.sums(work)
    assert set(got) == set(want)
    for name in want:
        assert np.shape(got[name]) == np.shape(want[name])
        np.testing.assert_allclose(got[name], want[name])


def test_fits_wait_until_others_are_done(spark, small, monkeypatch):
    """The driver holds few coefficients at a time; the order of fits changes nothing."""
    held, learned = small[3], small[5]
    want = walks.logistic(held, learned, ("structured", "tfidf_full"))
    monkeypatch.setattr(walks, "OPEN", 1)
    monkeypatch.setattr(walks, "MANY", 1)
    got = walks.logistic(held, learned, ("structured", "tfidf_full"))
    assert list(got) == list(want)
    for key in want:
        np.testing.assert_allclose(got[key], want[key], atol=1e-9)


def test_terms_of_few_rows_get_no_number(spark, small):
    """Only what can stand in a fold's vocabulary is numbered and comes to the driver."""
    df, _, texts, _, names, _ = small
    uses = {r["doc"]: r["n"] for r in df.groupBy("doc").agg(F.count("*").alias("n")).collect()}
    extra = spark.createDataFrame([(99, "never", 1)], "doc int, term string, tf int")
    one = df.withColumn("doc", F.when(F.col("id") < walks.LEAST_ROWS - 1, 99).otherwise(F.col("doc")))
    _, got = modelling.walk_blocks(one, "month", "y", NEVER, ENCODED, "doc", arms.Texts(texts.terms.unionByName(extra), texts.lexicon, texts.vectors, 2))
    assert "never" not in got and set(got) == set(names) and uses


def test_driver_keeps_neither_broadcasts_nor_large_steps(spark, small):
    import os

    held, sent = small[3], spark.sparkContext._temp_dir
    before = set(os.listdir(sent))
    held.sums(lambda b, _: {"n": np.ones(1)}, np.zeros(1000))
    assert set(os.listdir(sent)) == before
    rng = np.random.default_rng(1)
    few, many = walks.Steps(5), walks.Steps(walks.MANY + 1)
    for _ in range(walks.KEPT + 3):
        s, y = rng.normal(size=(2, 5))
        few.add(s, y)
        many.add(np.resize(s, walks.MANY + 1), np.resize(y, walks.MANY + 1))
    assert isinstance(many.held, np.memmap) and len(few) == len(many) == walks.KEPT
    for i in range(walks.KEPT):
        assert all((a == b[:5]).all() for a, b in zip(few[i], many[i], strict=True))
    assert (few[walks.KEPT - 1][0] == s).all()


def test_fits_in_tasks_of_their_own_grow_the_same_trees(spark, small, monkeypatch):
    """Fits of few rows start no pass for each level; those of more do, and both grow the same trees."""
    held, learned, s = small[3], small[5], boosting.Settings(trees=4)
    passes, real = [], boosting.summed
    monkeypatch.setattr(boosting, "summed", lambda *a, **k: passes.append(1) or real(*a, **k))
    got = boosting.fitted(held, learned, ("structured", "tfidf_chi2"), s)
    assert len(passes) == 1  # the sketches'
    monkeypatch.setattr(boosting, "NEAR", learned[0].n * (8 + len(got[learned[0].fold, "structured"].edges)))
    mixed = boosting.fitted(held, learned, ("structured", "tfidf_chi2"), s)
    monkeypatch.setattr(boosting, "NEAR", 0)
    want = boosting.fitted(held, learned, ("structured", "tfidf_chi2"), s)
    assert sorted(got) == sorted(want) == sorted(mixed) and len(passes) > 1 + 4 * s.depth
    for key, model in want.items():
        for other in (got[key], mixed[key]):
            assert len(other.trees) == len(model.trees) == s.trees
            for a, b in zip(other.trees, model.trees, strict=True):
                assert a.column.tolist() == b.column.tolist() and a.bin.tolist() == b.bin.tolist() and a.leaf == pytest.approx(b.leaf) and a.gain == pytest.approx(b.gain)


def test_columns_are_packed_whole():
    starts = np.cumsum([0, 64, 2, 2, 300, 2, 25])
    found = boosting.packs(starts)
    assert sorted(j for own in found for j in own) == list(range(6))
    assert all(len(own) == 1 or np.prod(np.diff(starts)[own]) <= 256 for own in found)


def test_descents_end_after_few_passes(spark, small, monkeypatch):
    """Steps are scaled by the curvature, of features that go together and of rare terms alike."""
    held, learned = small[3], small[5]
    passes, real = [], blocks.summed
    monkeypatch.setattr(blocks, "summed", lambda *a, **k: passes.append(a[2].__name__) or real(*a, **k))
    walks.logistic(held, learned, tuple(arms.ARMS))
    assert passes.count("_slopes") <= 20, passes.count("_slopes")


def test_numbers_by_fold_and_term_are_summed_for_some_folds_at_a_time(spark, small, monkeypatch):
    """No task holds all folds' terms, and blocks that only need the best terms hold no others; what is learned stays the same."""
    df, table, _, held, _, learned = small
    sizes, real = [], blocks.summed

    def summed(rdd, context, work, given, **k):
        out = real(rdd, context, work, given, **k)
        sizes.append(sum(np.size(v) for v in out.values() if np.shape(v)[-1:] == (held.layout.terms,)))
        return out

    monkeypatch.setattr(blocks, "summed", summed)
    monkeypatch.setattr(walks, "PASSED", 2 * held.layout.terms)
    got = modelling.learned_folds(df, table, "month", held, LOGGED, True, 2)
    assert 0 < max(sizes) <= 2 * held.layout.terms < len(learned) * held.layout.terms
    for a, b in zip(got, learned, strict=True):
        assert a.idf.tolist() == b.idf.tolist() and a.best.tolist() == b.best.tolist() and a.mean == pytest.approx(b.mean)
    best = [3, 1]
    cut = held.rdd.map(lambda b: walks._with_lengths(b, (learned, np.sort(best)))).collect()
    for whole, narrow in zip(held.rdd.collect(), cut, strict=True):
        for i in range(len(whole.id)):
            terms = whole.term[whole.start[i] : whole.start[i + 1]].tolist()
            assert [sorted(best)[t] for t in narrow.term[narrow.start[i] : narrow.start[i + 1]]] == [t for t in terms if t in best]
        assert set(narrow.lengths) == {f.fold for f in learned}


def test_blocks_with_the_best_terms_alone_give_the_same_fits(spark, small):
    held, learned = small[3], small[5]
    want, got = walks.logistic(held, learned, ("tfidf_full", "tfidf_chi2")), walks.logistic(held, learned, ("lexicon", "tfidf_chi2"))
    for f in learned:
        np.testing.assert_allclose(got[f.fold, "tfidf_chi2"], want[f.fold, "tfidf_chi2"], atol=1e-9)
