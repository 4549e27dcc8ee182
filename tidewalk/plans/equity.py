"""Queries for fairness, calibration, balance and reweighting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import balance, fairness, models, ranks
from . import study
from .statistics import auc_sql, erf_sql
from .study import A_SQL, GROUPINGS, L_SQL, LEVELS, P_SQL, PL_SQL, S_SQL, rank_sql

R = X.rounded
QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def _six(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: R(c, digits) for c in columns})


U_SQL = f"{PL_SQL}, u AS (SELECT *, 'index_group' AS grouping, index_group AS level FROM pl UNION ALL SELECT *, 'building_group', building_group FROM pl)"


def rates_sql(keys: str, table: str = "u", threshold: str = "0.5::DOUBLE") -> str:
    return f"""SELECT {keys}, count(*) AS n, sum(y_true)::BIGINT AS n_pos, (count(*) - sum(y_true))::BIGINT AS n_neg, count(*) FILTER (y_prob >= {threshold} AND y_true = 1) AS tp, count(*) FILTER (y_prob >= {threshold} AND y_true = 0) AS fp,
  count(*) FILTER (y_prob >= {threshold} AND y_true = 1) / nullif(sum(y_true), 0)::DOUBLE AS tpr, count(*) FILTER (y_prob >= {threshold} AND y_true = 0) / nullif(count(*) - sum(y_true), 0)::DOUBLE AS fpr, count(*) FILTER (y_prob >= {threshold}) / count(*)::DOUBLE AS ppr
  FROM {table} GROUP BY {keys}"""


# --- indices and groupings ------------------------------------------------------------------------


@query(f"WITH {L_SQL} SELECT area, round_even(disadvantage, 6) AS disadvantage FROM al")
def pct_rank_index(spark: SparkSession, d: str) -> DataFrame:
    return _six(ranks.index(study.areas(spark, d), "area", ["share_machinery", "share_urgent"], ["mean_balance", "mean_amount"], "disadvantage"), "disadvantage")


@query(f"WITH {L_SQL} SELECT area, index_group, building_group, machinery_group FROM al")
def tertiles_tie_safe(spark: SparkSession, d: str) -> DataFrame:
    return study.labelled_areas(spark, d).select("area", "index_group", "building_group", "machinery_group")


@query(f"WITH {A_SQL}, e AS (SELECT list_distinct(quantile_cont(mean_balance, [{', '.join(f'{i / 10}::DOUBLE' for i in range(1, 10))}])) AS e FROM a) SELECT area, len(list_filter(e, lambda x: x < mean_balance))::INT AS decile FROM a, e")
def deciles_left(spark: SparkSession, d: str) -> DataFrame:
    return balance.quantile_bins(study.areas(spark, d), "mean_balance", 10, "decile").select("area", "decile")


@query(f"""WITH {A_SQL} SELECT area, round_even(((share_machinery - avg(share_machinery) OVER ()) / stddev_pop(share_machinery) OVER () - (mean_balance - avg(mean_balance) OVER ()) / stddev_pop(mean_balance) OVER ()) / 2, 6) AS z_index FROM a""")
def z_score_index(spark: SparkSession, d: str) -> DataFrame:
    return balance.z_index(study.areas(spark, d), ["share_machinery"], ["mean_balance"]).select("area", R("z_index").alias("z_index"))


@query(f"""WITH {A_SQL}, r AS (SELECT rank() OVER (ORDER BY mean_balance) + (count(*) OVER (PARTITION BY mean_balance) - 1) / 2::DOUBLE AS x, rank() OVER (ORDER BY share_urgent) + (count(*) OVER (PARTITION BY share_urgent) - 1) / 2::DOUBLE AS y FROM a)
SELECT count(*) AS n, round_even(corr(x, y), 6) AS spearman FROM r""")
def spearman(spark: SparkSession, d: str) -> DataFrame:
    return _six(ranks.spearman(study.areas(spark, d), "mean_balance", "share_urgent"), "spearman")


@query(f"""WITH {S_SQL}, r AS (SELECT rank() OVER (ORDER BY amount) + (count(*) OVER (PARTITION BY amount) - 1) / 2::DOUBLE AS x, rank() OVER (ORDER BY balance) + (count(*) OVER (PARTITION BY balance) - 1) / 2::DOUBLE AS y FROM s)
SELECT count(*) AS n, round_even(corr(x, y), 6) AS spearman FROM r""")
def spearman_loans(spark: SparkSession, d: str) -> DataFrame:
    """Over loans, not areas: a customer's loans share a balance."""
    return _six(ranks.spearman(study.loans(spark, d), "amount", "balance"), "spearman")


@query(f"WITH {S_SQL} SELECT id, round_even(({rank_sql('amount')} + {rank_sql('nation')} + 1 - {rank_sql('balance')}) / 3, 9) AS burden FROM s")
def pct_rank_loans(spark: SparkSession, d: str) -> DataFrame:
    """An index of every loan: the mean of percentile ranks over all loans, that of the balance turned round."""
    return _six(ranks.index(study.loans(spark, d), "id", ["amount", "nation"], ["balance"], "burden"), "burden", digits=9)


COVARIATES = ["mean_balance", "mean_amount", "share_urgent"]
V_SQL = f"{L_SQL}, v AS (UNPIVOT (SELECT area, index_group, mean_balance, mean_amount, share_urgent FROM al) ON mean_balance, mean_amount, share_urgent INTO NAME covariate VALUE value)"
SMD_SQL = f"""{V_SQL}, mo AS (SELECT covariate, index_group AS g, avg(value) AS m, var_samp(value) AS s, CASE index_group WHEN 'Low' THEN 1 WHEN 'Medium' THEN 2 ELSE 3 END AS k FROM v GROUP BY 1, 2),
sm AS (SELECT 'index_group' AS grouping, a.g || '-' || b.g AS comparison, a.covariate, a.m AS mean_a, b.m AS mean_b, CASE WHEN a.s + b.s > 0 THEN (a.m - b.m) / sqrt((a.s + b.s) / 2) ELSE 0 END AS smd FROM mo a JOIN mo b ON a.covariate = b.covariate AND a.k < b.k)"""


@query(f"WITH {SMD_SQL} SELECT grouping, comparison, covariate, round_even(mean_a, 6) AS mean_a, round_even(mean_b, 6) AS mean_b, round_even(smd, 6) AS smd FROM sm")
def smd_pairwise(spark: SparkSession, d: str) -> DataFrame:
    return _six(balance.smd(study.labelled_areas(spark, d), "index_group", COVARIATES, LEVELS), "mean_a", "mean_b", "smd")


@query(f"WITH {SMD_SQL} SELECT grouping, comparison, round_even(avg(abs(smd)), 6) AS mean_abs_smd, round_even(max(abs(smd)), 6) AS max_abs_smd FROM sm GROUP BY 1, 2")
def smd_summary(spark: SparkSession, d: str) -> DataFrame:
    return _six(balance.smd_summary(balance.smd(study.labelled_areas(spark, d), "index_group", COVARIATES, LEVELS)), "mean_abs_smd", "max_abs_smd")


# --- matching -------------------------------------------------------------------------------------

W_SQL = f"""{L_SQL}, st AS (SELECT *, (index_group = 'High')::INT AS t, machinery_group AS stratum FROM al WHERE index_group IN ('Low', 'High')),
ks AS (SELECT * FROM (SELECT *, sum(t) OVER (PARTITION BY stratum) AS ts, sum(1 - t) OVER (PARTITION BY stratum) AS cs FROM st) WHERE ts > 0 AND cs > 0),
w AS (SELECT area, index_group, stratum, mean_balance, mean_amount, share_urgent, CASE WHEN t = 1 THEN 1::DOUBLE ELSE (ts / (sum(t) OVER ())::DOUBLE) / (cs / (sum(1 - t) OVER ())::DOUBLE) END AS weight FROM ks)"""


def _matched(spark: SparkSession, d: str) -> DataFrame:
    return balance.matched_weights(study.labelled_areas(spark, d), "index_group", "High", "Low", "machinery_group")


@query(f"WITH {W_SQL} SELECT area, index_group, round_even(weight, 6) AS weight FROM w")
def cem_weights(spark: SparkSession, d: str) -> DataFrame:
    return _matched(spark, d).select("area", "index_group", R("weight").alias("weight"))


@query(f"WITH {W_SQL} SELECT index_group, count(*) AS n, round_even(sum(weight) * sum(weight) / sum(weight * weight), 6) AS n_eff FROM w GROUP BY 1")
def kish_ess(spark: SparkSession, d: str) -> DataFrame:
    return _six(balance.kish(_matched(spark, d), ["index_group"]), "n_eff")


@query(f"""WITH {W_SQL}, v2 AS (SELECT index_group, covariate, value, wt, side FROM (SELECT index_group, covariate, value, weight AS wt, 'after' AS side FROM (UNPIVOT (SELECT index_group, weight, mean_balance, mean_amount, share_urgent FROM w) ON mean_balance, mean_amount, share_urgent INTO NAME covariate VALUE value)
  UNION ALL SELECT index_group, covariate, value, 1, 'before' FROM (UNPIVOT (SELECT index_group, weight, mean_balance, mean_amount, share_urgent FROM w) ON mean_balance, mean_amount, share_urgent INTO NAME covariate VALUE value))),
m2 AS (SELECT side, covariate, index_group, sum(value * wt) / sum(wt) AS m, sum(value * value * wt) / sum(wt) - (sum(value * wt) / sum(wt)) * (sum(value * wt) / sum(wt)) AS s FROM v2 GROUP BY 1, 2, 3)
SELECT h.side, h.covariate, round_even((h.m - l.m) / sqrt((h.s + l.s) / 2), 5) AS smd FROM m2 h JOIN m2 l USING (side, covariate) WHERE h.index_group = 'High' AND l.index_group = 'Low'""")
def cem_balance(spark: SparkSession, d: str) -> DataFrame:
    m = _matched(spark, d).withColumn("one", F.lit(1.0))
    out = [balance.weighted_smd(m, "index_group", "High", COVARIATES, w).withColumn("side", F.lit(side)) for side, w in (("before", "one"), ("after", "weight"))]
    return out[0].unionByName(out[1]).select("side", "covariate", R("smd", 5).alias("smd"))


@query(f"""WITH {PL_SQL}, {W_SQL.removeprefix(L_SQL + ',').strip()}, x AS (SELECT model, arm, w.index_group AS g, sum((y_prob >= 0.5::DOUBLE)::INT * weight) / sum(weight) AS fpr, sum(weight) * sum(weight) / sum(weight * weight) AS ne FROM p JOIN w USING (area) WHERE y_true = 0 GROUP BY 1, 2, 3),
y AS (SELECT l.model, l.arm, l.fpr AS low, h.fpr AS high, l.ne AS nl, h.ne AS nh, (l.fpr * l.ne + h.fpr * h.ne) / (l.ne + h.ne) AS q FROM x l JOIN x h USING (model, arm) WHERE l.g = 'Low' AND h.g = 'High'),
z AS (SELECT *, (low - high) / sqrt(q * (1 - q) * (1 / nl + 1 / nh)) AS z FROM y)
SELECT model, arm, round_even(low, 6) AS low, round_even(high, 6) AS high, round_even(nl, 4) AS n_eff_low, round_even(nh, 4) AS n_eff_high, round_even(high - low, 6) AS gap_high_minus_low, round_even(z, 5) AS z, round_even({erf_sql('z')}, 5) AS p_value FROM z""")
def cem_fpr_test(spark: SparkSession, d: str) -> DataFrame:
    w = _matched(spark, d).select("area", "index_group", "weight")
    out = balance.weighted_fpr(study.predictions(spark, d).join(w, "area"), ["model", "arm"], "index_group", "weight")
    out = _six(_six(out, "low", "high", "gap_high_minus_low"), "z", "p_value", digits=5)
    return _six(out, "n_eff_low", "n_eff_high", digits=4).select("model", "arm", "low", "high", "n_eff_low", "n_eff_high", "gap_high_minus_low", "z", "p_value")


@query()
def entropy_weights(spark: SparkSession, d: str) -> DataFrame:
    out = balance.entropy_balanced(study.labelled_areas(spark, d), "area", "index_group", "High", "Low", COVARIATES)
    return _six(out, "weight")


@query()
def entropy_balance_check(spark: SparkSession, d: str) -> DataFrame:
    labels = study.labelled_areas(spark, d)
    w = balance.entropy_balanced(labels, "area", "index_group", "High", "Low", COVARIATES)
    return _six(balance.weighted_smd(labels.drop("index_group").join(w, "area"), "index_group", "High", COVARIATES, "weight"), "smd", digits=3)


# --- error rates ----------------------------------------------------------------------------------


@query(f"""WITH {U_SQL}, r AS ({rates_sql('grouping, level, model')}), q AS ({auc_sql('grouping, level, model', 'u', False)})
SELECT r.grouping, r.level, r.model, n, r.n_pos, round_even(tpr, 6) AS tpr, round_even(fpr, 6) AS fpr, round_even(ppr, 6) AS ppr, round_even(auc, 6) AS auc FROM r JOIN q USING (grouping, level, model)""")
def group_confusion(spark: SparkSession, d: str) -> DataFrame:
    out = fairness.by_group(study.labelled_predictions(spark, d), list(GROUPINGS), ["model"])
    return _six(out, "tpr", "fpr", "ppr", "auc").select("grouping", "level", "model", "n", "n_pos", "tpr", "fpr", "ppr", "auc")


@query(f"""WITH {U_SQL}, r AS ({rates_sql('grouping, level, model')}), k AS (SELECT *, CASE level WHEN 'Low' THEN 1 WHEN 'Medium' THEN 2 ELSE 3 END AS k FROM r)
SELECT a.grouping, a.model, a.level || '-' || b.level AS comparison, round_even(a.tpr - b.tpr, 6) AS gap_tpr, round_even(a.fpr - b.fpr, 6) AS gap_fpr, round_even(a.ppr - b.ppr, 6) AS gap_ppr FROM k a JOIN k b ON a.grouping = b.grouping AND a.model = b.model AND a.k < b.k""")
def group_gaps(spark: SparkSession, d: str) -> DataFrame:
    g = fairness.by_group(study.labelled_predictions(spark, d), list(GROUPINGS), ["model"])
    return _six(fairness.gaps(g, ["grouping", "model"], LEVELS, ["tpr", "fpr", "ppr"]), "gap_tpr", "gap_fpr", "gap_ppr")


def _z(k: str, n: str) -> str:
    q = f"((l.{k} + h.{k}) / (l.{n} + h.{n})::DOUBLE)"
    return f"(CASE WHEN {q} * (1 - {q}) > 0 THEN (l.{k} / l.{n}::DOUBLE - h.{k} / h.{n}::DOUBLE) / sqrt({q} * (1 - {q}) * (1 / l.{n}::DOUBLE + 1 / h.{n}::DOUBLE)) END)"


FOLD_SQL = f"""{U_SQL}, r AS ({rates_sql('grouping, level, model, arm, fold')}), r2 AS (SELECT *, tp + fp AS hits FROM r),
fb AS (SELECT l.grouping, l.model, l.arm, l.fold, h.tpr - l.tpr AS tpr_gap, h.fpr - l.fpr AS fpr_gap, h.ppr - l.ppr AS ppr_gap, {_z('tp', 'n_pos')} AS tpr_z, {_z('fp', 'n_neg')} AS fpr_z, {_z('hits', 'n')} AS ppr_z
  FROM r2 l JOIN r2 h USING (grouping, model, arm, fold) WHERE l.level = 'Low' AND h.level = 'High'),
fl AS (SELECT grouping, model, arm, fold, 'tpr' AS metric, tpr_gap AS gap, tpr_z AS z FROM fb UNION ALL SELECT grouping, model, arm, fold, 'fpr', fpr_gap, fpr_z FROM fb UNION ALL SELECT grouping, model, arm, fold, 'ppr', ppr_gap, ppr_z FROM fb),
fp2 AS (SELECT *, round_even({erf_sql('z')}, 4) AS p FROM fl),
fk AS (SELECT *, row_number() OVER (PARTITION BY grouping, model, arm, metric ORDER BY p, fold) AS k, count(*) OVER (PARTITION BY grouping, model, arm, metric) AS m FROM fp2 WHERE p IS NOT NULL),
fq AS (SELECT *, least(min(p * m / k) OVER (PARTITION BY grouping, model, arm, metric ORDER BY k DESC), 1) AS q FROM fk)"""


@query(f"WITH {FOLD_SQL} SELECT grouping, model, arm, fold, round_even(gap, 6) AS tpr_gap, round_even(z, 5) AS tpr_z, p AS tpr_p, round_even(q, 6) AS tpr_q FROM fq WHERE metric = 'tpr'")
def fairness_by_fold(spark: SparkSession, d: str) -> DataFrame:
    out = fairness.by_fold(study.labelled_predictions(spark, d), list(GROUPINGS), ["model", "arm"]).where("tpr_p is not null")
    return out.select("grouping", "model", "arm", "fold", R("tpr_gap").alias("tpr_gap"), R("tpr_z", 5).alias("tpr_z"), "tpr_p", R("tpr_q").alias("tpr_q"))


@query(f"""WITH {FOLD_SQL} SELECT grouping, model, arm, metric, count(gap) AS n_folds, round_even(avg(gap), 6) AS mean_gap, count(*) FILTER (p < 0.05::DOUBLE) AS n_raw, count(*) FILTER (q < 0.05::DOUBLE) AS n_corrected
FROM (SELECT * EXCLUDE (k, m) FROM fq UNION ALL SELECT *, NULL AS q FROM fp2 WHERE p IS NULL) GROUP BY 1, 2, 3, 4""")
def fairness_fold_summary(spark: SparkSession, d: str) -> DataFrame:
    return fairness.fold_summary(fairness.by_fold(study.labelled_predictions(spark, d), list(GROUPINGS), ["model", "arm"]), ["model", "arm"])


THRESHOLDS = [0.2, 0.35, 0.5, 0.65, 0.8]
GRID_SQL = f"""{U_SQL}, gr AS (SELECT model, arm, grouping, level, fold, t.threshold, sum(y_true) AS np, count(*) - sum(y_true) AS nn, count(*) FILTER (y_prob >= t.threshold AND y_true = 1) AS tp, count(*) FILTER (y_prob >= t.threshold AND y_true = 0) AS fp
  FROM u, (VALUES {', '.join(f'({t}::DOUBLE)' for t in THRESHOLDS)}) t(threshold) WHERE level IN ('Low', 'High') GROUP BY ALL),
gg AS (SELECT l.model, l.arm, l.grouping, l.fold, l.threshold, least(l.np, h.np, l.nn, h.nn) < 30 AS small, h.tp / h.np::DOUBLE - l.tp / l.np::DOUBLE AS tg, h.fp / h.nn::DOUBLE - l.fp / l.nn::DOUBLE AS fg FROM gr l JOIN gr h USING (model, arm, grouping, fold, threshold) WHERE l.level = 'Low' AND h.level = 'High')"""


def _grid(spark: SparkSession, d: str) -> DataFrame:
    return fairness.grid(study.labelled_predictions(spark, d), list(GROUPINGS), ["model", "arm", "fold"], THRESHOLDS)


@query(f"WITH {GRID_SQL} SELECT model, arm, grouping, fold, threshold, small::INT AS small_cell, CASE WHEN NOT small THEN round_even(tg, 6) END AS tpr_gap, CASE WHEN NOT small THEN round_even(fg, 6) END AS fpr_gap FROM gg")
def fairness_grid(spark: SparkSession, d: str) -> DataFrame:
    return _six(_grid(spark, d), "tpr_gap", "fpr_gap").select("model", "arm", "grouping", "fold", "threshold", "small_cell", "tpr_gap", "fpr_gap")


def _spread_sql(x: str, name: str) -> str:
    return f"round_even(avg(CASE WHEN NOT small THEN {x} END), 6) AS mean_{name}, round_even(stddev_samp(CASE WHEN NOT small THEN {x} END), 6) AS sd_{name}"


@query(f"WITH {GRID_SQL} SELECT model, arm, grouping, threshold, count(*) FILTER (NOT small) AS n_cells, {_spread_sql('greatest(abs(tg), abs(fg))', 'eo')}, {_spread_sql('tg', 'tpr_gap')}, {_spread_sql('fg', 'fpr_gap')} FROM gg GROUP BY 1, 2, 3, 4")
def eo_diff(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d).groupBy("model", "arm", "grouping", "threshold").agg(F.count("eo_diff").alias("n_cells"), *[s for c, name in (("eo_diff", "eo"), ("tpr_gap", "tpr_gap"), ("fpr_gap", "fpr_gap")) for s in (R(F.avg(c)).alias(f"mean_{name}"), R(F.stddev_samp(c)).alias(f"sd_{name}"))])


@query(f"""WITH {P_SQL}, r AS ({rates_sql('model, arm, area', 'p')}), b AS (SELECT model, arm, area, avg((y_prob - y_true) * (y_prob - y_true)) AS brier FROM p GROUP BY 1, 2, 3), k AS (SELECT *, n >= 40 AND n_pos >= 10 AS kept FROM r JOIN b USING (model, arm, area))
SELECT model, arm, count(*) AS n_areas, count(*) FILTER (kept) AS n_kept, round_even(max(1 - tpr) FILTER (kept) - min(1 - tpr) FILTER (kept), 6) AS fnr_gap, round_even(max(fpr) FILTER (kept) - min(fpr) FILTER (kept), 6) AS fpr_gap, round_even(max(brier) FILTER (kept) - min(brier) FILTER (kept), 6) AS brier_gap FROM k GROUP BY 1, 2""")
def zip_gap_v1(spark: SparkSession, d: str) -> DataFrame:
    return _six(fairness.area_gaps(study.predictions(spark, d), ["model", "arm"], "area", least_n=40), "fnr_gap", "fpr_gap", "brier_gap")


@query(f"""WITH {P_SQL}, r AS ({rates_sql('model, arm, area, fold', 'p')})
SELECT model, arm, area, count(*) AS n_folds, sum(n)::BIGINT AS n, round_even(sum(n_pos) / sum(n)::DOUBLE, 6) AS default_rate, round_even(avg(fpr), 6) AS mean_fpr, round_even(stddev_samp(fpr), 6) AS sd_fpr FROM r GROUP BY 1, 2, 3""")
def zip_summary_v1(spark: SparkSession, d: str) -> DataFrame:
    return _six(fairness.area_summary(study.predictions(spark, d), "area", ["model", "arm"]), "default_rate", "mean_fpr", "sd_fpr")


@query(f"WITH {FOLD_SQL}, e AS (SELECT b.grouping, b.model, b.fold, abs(t.fpr_gap) - abs(b.fpr_gap) AS delta FROM fb b JOIN fb t USING (grouping, model, fold) WHERE b.arm = 'structured' AND t.arm = 'tfidf_full') SELECT grouping, model, CASE WHEN delta < -1e-5::DOUBLE THEN 'improved' WHEN delta > 1e-5::DOUBLE THEN 'worsened' ELSE 'unchanged' END AS verdict, count(*) AS n FROM e WHERE delta IS NOT NULL GROUP BY 1, 2, 3")
def fairness_verdicts(spark: SparkSession, d: str) -> DataFrame:
    folds = fairness.by_fold(study.labelled_predictions(spark, d), list(GROUPINGS), ["model", "arm"]).withColumn("size", F.abs("fpr_gap"))
    pairs = fairness.effect_pairs(folds, ["grouping", "model"], "arm", "structured", "tfidf_full", "size")
    return pairs.where("delta is not null").groupBy("grouping", "model", fairness.verdict("delta").alias("verdict")).agg(F.count("*").alias("n"))


@query()
def paired_text_effect(spark: SparkSession, d: str) -> DataFrame:
    folds = fairness.by_fold(study.labelled_predictions(spark, d), list(GROUPINGS), ["model", "arm"])
    pairs = fairness.effect_pairs(folds, ["grouping", "model"], "arm", "structured", "tfidf_full", "fpr_gap")
    return models.paired_tests(pairs, ["grouping", "model"], "delta")


# --- calibration ----------------------------------------------------------------------------------

C_SQL = f"""{PL_SQL}, c0 AS (SELECT * FROM pl WHERE index_group IN ('Low', 'High')), ce AS (SELECT fold, model, arm, list_distinct(quantile_cont(y_prob, [{', '.join(f'{i / 10}::DOUBLE' for i in range(1, 10))}])) AS e FROM c0 GROUP BY 1, 2, 3),
cv AS (SELECT fold, model, arm, index_group AS level, len(list_filter(e, lambda x: x <= y_prob))::INT AS bin, count(*) AS n, avg(y_prob) AS mean_p, avg(y_true) AS rate FROM c0 JOIN ce USING (fold, model, arm) GROUP BY ALL),
cx AS (SELECT fold, model, arm, level, sum(n)::BIGINT AS n, sum(n * abs(rate - mean_p)) / sum(n) AS ece FROM cv GROUP BY 1, 2, 3, 4)"""


def _curve(spark: SparkSession, d: str) -> DataFrame:
    rows = study.labelled_predictions(spark, d).where(F.col("index_group").isin("Low", "High")).withColumnRenamed("index_group", "level")
    return fairness.calibration(rows, ["fold", "model", "arm"], "level")


@query(f"WITH {C_SQL} SELECT fold, model, arm, level, bin, n, round_even(mean_p, 6) AS mean_p, round_even(rate, 6) AS rate FROM cv")
def calibration_curve(spark: SparkSession, d: str) -> DataFrame:
    return _six(_curve(spark, d), "mean_p", "rate")


@query(f"WITH {C_SQL} SELECT fold, model, arm, level, n, round_even(ece, 6) AS ece FROM cx")
def ece(spark: SparkSession, d: str) -> DataFrame:
    return _six(fairness.calibration_error(_curve(spark, d), ["fold", "model", "arm", "level"]), "ece")


@query(f"WITH {C_SQL} SELECT model, arm, round_even(avg(ece) FILTER (level = 'Low'), 6) AS ece_low, round_even(avg(ece) FILTER (level = 'High'), 6) AS ece_high, round_even(avg(ece) FILTER (level = 'High') - avg(ece) FILTER (level = 'Low'), 6) AS ece_diff, count(*) AS n_cells FROM cx GROUP BY 1, 2")
def calibration_summary(spark: SparkSession, d: str) -> DataFrame:
    e = fairness.calibration_error(_curve(spark, d), ["fold", "model", "arm", "level"])
    return _six(fairness.calibration_summary(e, ["model", "arm"], "level"), "ece_low", "ece_high", "ece_diff")


@query()
def recalibration_fit(spark: SparkSession, d: str) -> DataFrame:
    return _six(fairness.recalibration(study.labelled_predictions(spark, d), ["model", "arm", "index_group"]), "intercept", "slope", digits=4)


@query()
def recalibration_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Differences High - Low of the recalibration's intercept and slope, beside those of the calibration errors."""
    fits = fairness.recalibration(study.labelled_predictions(spark, d), ["model", "arm", "index_group"])
    pick = lambda c, level: F.max(F.when(F.col("index_group") == level, F.col(c)))
    gaps = fits.groupBy("model", "arm").agg(*[(pick(c, "High") - pick(c, "Low")).alias(f"{c}_diff") for c in ("intercept", "slope")])
    return _six(gaps.join(calibration_summary(spark, d).select("model", "arm", "ece_diff", "n_cells"), ["model", "arm"]), "intercept_diff", "slope_diff", digits=4)


@query()
def sufficiency_test(spark: SparkSession, d: str) -> DataFrame:
    return _six(fairness.sufficiency(study.labelled_predictions(spark, d), ["model", "arm", "fold"], "index_group", least=10), "coef_is_high", "p_is_high", "coef_interaction", "p_interaction", digits=4)
