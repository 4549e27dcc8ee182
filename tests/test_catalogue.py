import pytest
from compare import assert_same

from tidewalk.plans import catalogue, study

#: Large enough for every group of every query to have rows.
TABLES = "/root/testdata/sf0.01"
SLOW = {"lr_walk_forward", "gbt_walk_forward", "rf_walk_forward", "importance_by_model", "grid_search", "tuned_refit"}


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, name):
    assert_same(catalogue.QUERIES[name](spark, TABLES), catalogue.ORACLES[name], TABLES)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES) - SLOW))
def test_query_runs(spark, name):
    df = catalogue.QUERIES[name](spark, TABLES)
    assert df.columns and df.collect() is not None


def test_model_beats_nothing_and_stays_in_bounds(spark):
    rows = catalogue.QUERIES["lr_walk_forward"](spark, TABLES).collect()
    assert rows and all(r["auc"] is None or 0 <= r["auc"] <= 1 for r in rows)


def test_resume_covers_all_folds_arms_and_models(spark):
    rows = catalogue.QUERIES["resume_append"](spark, TABLES).collect()
    want = {tuple(r) for r in study.predictions(spark, TABLES).select("fold", "model", "arm").distinct().collect()}
    assert {(r["fold"], r["model"], r["arm"]) for r in rows} == want and len(rows) == len(want)
    assert all(r["n"] == r["n_ids"] for r in rows)


def test_bootstrap_covers_all_folds_arms_and_models(spark):
    rows = catalogue.QUERIES["bootstrap_ci"](spark, TABLES).collect()
    want = {tuple(r) for r in study.predictions(spark, TABLES).select("fold", "model", "arm").distinct().collect()}
    assert {(r["fold"], r["model"], r["arm"]) for r in rows} == want and len(rows) == len(want)
    assert max(r["n_resamples"] for r in rows) == 500


def test_logistic_walk_forward_scores_every_fold(spark):
    rows = catalogue.QUERIES["lr_walk_forward"](spark, TABLES).collect()
    assert sorted(r["fold"] for r in rows) == sorted(r["fold"] for r in study.fold_table(spark, TABLES).collect())
