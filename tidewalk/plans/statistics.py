"""Queries for rank statistics and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import models, rankstats
from . import study
from .study import F_SQL, P_SQL

R = X.rounded
QUERIES, ORACLES = {}, {}
KEYS = ["fold", "model", "arm"]


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def erf_sql(z: str) -> str:
    """Two-sided p-value by Simpson's rule over the normal density beyond |z|: a sum of its own, not the engine's formula."""
    weight = "(CASE WHEN i = 0 OR i = 1200 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
    return f"(list_sum(list_transform(range(0, 1201), lambda i: {weight} * exp(-(abs({z}) + i / 100::DOUBLE) * (abs({z}) + i / 100::DOUBLE) / 2::DOUBLE))) * 2 * 0.01::DOUBLE / 3 / sqrt(2 * pi()))"


AUC_SQL = """
SELECT {keys}, sum(pos)::BIGINT AS n_pos, sum(neg)::BIGINT AS n_neg, {r}(CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (below + neg / 2::DOUBLE)) / (sum(pos) * sum(neg)) END{d}) AS auc
FROM (SELECT *, coalesce(sum(neg) OVER (PARTITION BY {keys} ORDER BY y_prob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
      FROM (SELECT {keys}, y_prob, sum(y_true) AS pos, sum(1 - y_true) AS neg FROM {table} GROUP BY ALL)) GROUP BY {keys}"""


def auc_sql(keys: str, table: str, rounded: bool = True) -> str:
    return AUC_SQL.format(keys=keys, table=table, r="round_even" if rounded else "", d=", 6" if rounded else "")


@query(f"WITH {P_SQL} {auc_sql('fold, model, arm', 'p')}")
def auc_by_fold(spark: SparkSession, d: str) -> DataFrame:
    return rankstats.auc(study.predictions(spark, d), KEYS).withColumn("auc", R("auc"))


@query(f"""WITH {P_SQL}, x AS (SELECT fold, model, arm, y_prob, sum(y_true) AS pos, count(*) AS n FROM p GROUP BY ALL),
y AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS seen, sum(pos) OVER (PARTITION BY fold, model, arm) AS pos_all FROM x WINDOW w AS (PARTITION BY fold, model, arm ORDER BY y_prob DESC))
SELECT fold, model, arm, round_even(sum(pos / pos_all * (tp / seen)), 6) AS ap FROM y GROUP BY ALL""")
def ap_by_fold(spark: SparkSession, d: str) -> DataFrame:
    return rankstats.average_precision(study.predictions(spark, d), KEYS).withColumn("ap", R("ap"))


@query(f"WITH {P_SQL}, u AS ({auc_sql('fold, model, arm', 'p', False)}), b AS (SELECT fold, model, arm, avg((y_prob - y_true) * (y_prob - y_true)) AS brier, count(*) AS n FROM p GROUP BY ALL) SELECT fold, model, arm, n, round_even(brier, 6) AS brier, round_even(2 * auc - 1, 6) AS gini FROM b JOIN u USING (fold, model, arm)")
def brier_gini(spark: SparkSession, d: str) -> DataFrame:
    out = rankstats.brier_gini(study.predictions(spark, d), KEYS)
    return out.select(*KEYS, "n", R("brier").alias("brier"), R("gini").alias("gini"))


def _placements_sql(arm: str, name: str) -> str:
    part = "PARTITION BY fold, model"
    return f"""{name}_s AS (SELECT fold, model, y_prob, sum(y_true) AS pos, sum(1 - y_true) AS neg FROM p WHERE arm = '{arm}' GROUP BY ALL),
{name}_k AS (SELECT *, (coalesce(sum(neg) OVER ({part} ORDER BY y_prob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + neg / 2::DOUBLE) / sum(neg) OVER ({part}) AS v10,
  (coalesce(sum(pos) OVER ({part} ORDER BY y_prob DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + pos / 2::DOUBLE) / sum(pos) OVER ({part}) AS v01 FROM {name}_s),
{name}_v AS (SELECT p.fold, p.model, p.id, p.y_true, v10, v01 FROM p JOIN {name}_k k ON p.fold = k.fold AND p.model = k.model AND p.y_prob = k.y_prob WHERE p.arm = '{arm}')"""


def delong_sql(a: str, b: str, tag: str) -> str:
    """Ends with a table dz_<tag>."""
    x, y = f"{tag}_a", f"{tag}_b"
    return f"""{_placements_sql(a, x)}, {_placements_sql(b, y)},
dl_{tag} AS (SELECT a.fold, a.model, count(*) FILTER (a.y_true = 1) AS n1, count(*) FILTER (a.y_true = 0) AS n0, avg(a.v10) FILTER (a.y_true = 1) AS auc_a, avg(b.v10) FILTER (a.y_true = 1) AS auc_b,
  var_samp(a.v10 - b.v10) FILTER (a.y_true = 1) AS s10, var_samp(a.v01 - b.v01) FILTER (a.y_true = 0) AS s01 FROM {x}_v a JOIN {y}_v b USING (fold, model, id) GROUP BY a.fold, a.model),
dz_{tag} AS (SELECT *, CASE WHEN s10 / n1 + s01 / n0 > 0 THEN sqrt(s10 / n1 + s01 / n0) END AS se, auc_a - auc_b AS diff FROM dl_{tag})"""


@query(f"""WITH {P_SQL}, {delong_sql('structured', 'tfidf_full', 'one')}
SELECT fold, model, n1, n0, 0::BIGINT AS n_unpaired, round_even(auc_a, 6) AS auc_a, round_even(auc_b, 6) AS auc_b, round_even(-diff, 6) AS delta_auc, round_even(diff / se, 5) AS z, round_even({erf_sql('(diff / se)')}, 5) AS p_value,
  round_even(diff - 1.96::DOUBLE * se, 6) AS ci_diff_a_minus_b_lo, round_even(diff + 1.96::DOUBLE * se, 6) AS ci_diff_a_minus_b_hi FROM dz_one""")
def delong_paired(spark: SparkSession, d: str) -> DataFrame:
    p = study.predictions(spark, d).where(F.col("arm").isin("structured", "tfidf_full"))
    out = rankstats.delong(p, ["fold", "model"], "arm", "structured").drop("arm")
    six = ("auc_a", "auc_b", "delta_auc", "ci_diff_a_minus_b_lo", "ci_diff_a_minus_b_hi")
    return out.withColumns({c: R(c) for c in six} | {c: R(c, 5) for c in ("z", "p_value")})


def _tests(spark: SparkSession, d: str) -> DataFrame:
    """DeLong tests of both arms against the first, p-values rounded to four digits before they are corrected."""
    return rankstats.delong(study.predictions(spark, d), ["fold", "model"], "arm", "structured").withColumn("p_value", R("p_value", 4))


TESTS_SQL = f"""{P_SQL}, {', '.join(delong_sql('structured', a, a) for a in study.ARMS[1:])},
te AS (SELECT fold, model, arm, -diff AS delta_auc, round_even({erf_sql('(diff / se)')}, 4) AS p_value FROM ({' UNION ALL '.join(f"SELECT *, '{a}' AS arm FROM dz_{a}" for a in study.ARMS[1:])})),
tq AS (SELECT *, least(min(raw) OVER (PARTITION BY model ORDER BY k DESC), 1) AS q_value FROM (
  SELECT *, p_value * count(*) OVER (PARTITION BY model) / k AS raw FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY p_value, arm, fold) AS k FROM te WHERE p_value IS NOT NULL)))"""


@query(f"WITH {TESTS_SQL} SELECT fold, model, arm, p_value, round_even(q_value, 6) AS q_value FROM tq")
def bh_qvalues(spark: SparkSession, d: str) -> DataFrame:
    out = rankstats.benjamini_hochberg(_tests(spark, d), ["model"], "p_value", ["arm", "fold"])
    return out.where("p_value is not null").select("fold", "model", "arm", "p_value", R("q_value").alias("q_value"))


@query(f"""WITH {TESTS_SQL} SELECT model, arm, count(*) AS n_tests, count(*) FILTER (p_value < 0.05::DOUBLE) AS n_raw, count(*) FILTER (q_value < 0.05::DOUBLE) AS n_corrected,
count(*) FILTER (p_value < 0.05::DOUBLE AND delta_auc > 0) AS n_favour_b, count(*) FILTER (p_value < 0.05::DOUBLE AND delta_auc < 0) AS n_favour_a, round_even(avg(delta_auc), 6) AS mean_delta FROM tq GROUP BY 1, 2""")
def significance_counts(spark: SparkSession, d: str) -> DataFrame:
    out = rankstats.benjamini_hochberg(_tests(spark, d), ["model"], "p_value", ["arm", "fold"])
    return rankstats.significance(out, ["model", "arm"])


@query(f"""WITH {P_SQL}, x AS (SELECT model, arm, count(*) FILTER (id % 2 = 0 AND y_prob >= 0.5::DOUBLE) AS k1, count(*) FILTER (id % 2 = 0) AS n1, count(*) FILTER (id % 2 = 1 AND y_prob >= 0.5::DOUBLE) AS k2, count(*) FILTER (id % 2 = 1) AS n2 FROM p WHERE y_true = 0 GROUP BY 1, 2),
y AS (SELECT *, (k1 + k2) / (n1 + n2)::DOUBLE AS q FROM x), z AS (SELECT *, (k1 / n1::DOUBLE - k2 / n2::DOUBLE) / sqrt(q * (1 - q) * (1 / n1::DOUBLE + 1 / n2::DOUBLE)) AS z FROM y)
SELECT model, arm, k1, n1, k2, n2, round_even(z, 6) AS z, round_even({erf_sql('z')}, 6) AS p_value FROM z""")
def two_prop_test(spark: SparkSession, d: str) -> DataFrame:
    p = study.predictions(spark, d).where("y_true = 0")
    even, hit = F.col("id") % 2 == 0, F.col("y_prob") >= 0.5
    x = p.groupBy("model", "arm").agg(F.count_if(even & hit).alias("k1"), F.count_if(even).alias("n1"), F.count_if(~even & hit).alias("k2"), F.count_if(~even).alias("n2"))
    z, q = rankstats.two_proportions("k1", "n1", "k2", "n2")
    return x.select("*", R(z).alias("z"), R(q).alias("p_value"))


def _deltas(spark: SparkSession, d: str) -> DataFrame:
    a = rankstats.auc(study.predictions(spark, d), KEYS)
    base = a.where("arm = 'structured'").select("fold", "model", F.col("auc").alias("base"))
    return a.where("arm <> 'structured'").join(base, ["fold", "model"]).withColumn("delta", F.col("auc") - F.col("base"))


DELTA_SQL = f"{P_SQL}, u AS ({auc_sql('fold, model, arm', 'p', False)}), dd AS (SELECT x.fold, x.model, x.arm, x.auc - y.auc AS delta FROM u x JOIN u y ON x.fold = y.fold AND x.model = y.model AND y.arm = 'structured' WHERE x.arm <> 'structured')"


@query(f"WITH {DELTA_SQL} SELECT model, arm, count(*) AS n, round_even(avg(delta), 6) AS mean_delta, round_even(stddev_samp(delta), 6) AS sd_delta, round_even(avg(delta) / stddev_samp(delta), 5) AS cohens_dz, round_even(avg(delta) / stddev_samp(delta) * sqrt(count(*)), 5) AS t_stat FROM dd GROUP BY 1, 2")
def paired_delta_stats(spark: SparkSession, d: str) -> DataFrame:
    out = rankstats.paired_summary(_deltas(spark, d), ["model", "arm"], "delta")
    return out.withColumns({"mean_delta": R("mean_delta"), "sd_delta": R("sd_delta"), "cohens_dz": R("cohens_dz", 5), "t_stat": R("t_stat", 5)})


@query(f"""WITH {DELTA_SQL} SELECT model, arm, round_even(avg((delta > 0)::INT), 6) AS improved, CASE WHEN avg((delta > 0)::INT) >= 0.7::DOUBLE THEN 'consistent' WHEN avg((delta > 0)::INT) >= 0.4::DOUBLE THEN 'mixed' ELSE 'rare' END AS verdict FROM dd GROUP BY 1, 2""")
def improvement_verdict(spark: SparkSession, d: str) -> DataFrame:
    by = _deltas(spark, d).groupBy("model", "arm").agg(F.avg((F.col("delta") > 0).cast("int")).alias("share"))
    return by.select("model", "arm", R("share").alias("improved"), F.when(F.col("share") >= 0.7, "consistent").when(F.col("share") >= 0.4, "mixed").otherwise("rare").alias("verdict"))


@query()
def paired_pvalues(spark: SparkSession, d: str) -> DataFrame:
    return models.paired_tests(_deltas(spark, d), ["model", "arm"], "delta")


@query(f"""WITH {P_SQL}, x AS (SELECT model, arm, y_prob AS threshold, sum(y_true) AS pos, count(*) AS n FROM p GROUP BY ALL),
y AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w - sum(pos) OVER w AS fp, sum(pos) OVER k AS n1, sum(n) OVER k - sum(pos) OVER k AS n0 FROM x WINDOW w AS (PARTITION BY model, arm ORDER BY threshold DESC), k AS (PARTITION BY model, arm))
SELECT model, arm, round_even(threshold, 9) AS threshold, round_even((tp * n0 - fp * n1) / (n1 * n0)::DOUBLE, 6) AS youden_j FROM y QUALIFY row_number() OVER (PARTITION BY model, arm ORDER BY tp * n0 - fp * n1 DESC, threshold DESC) = 1""")
def youden_threshold(spark: SparkSession, d: str) -> DataFrame:
    out = rankstats.youden(study.predictions(spark, d), ["model", "arm"])
    return out.withColumns({"threshold": R("threshold", 9), "youden_j": R("youden_j")})


@query()
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    return rankstats.bootstrap_auc(study.predictions(spark, d), KEYS).withColumns({"auc_lo": R("auc_lo"), "auc_hi": R("auc_hi")})


@query(f"""WITH {P_SQL}, u AS ({auc_sql('fold, model, arm', 'p', False)}), m AS (SELECT model, arm, avg(auc) AS mean_auc, stddev_samp(auc) AS sd_auc, count(*) AS n_folds FROM u GROUP BY 1, 2)
SELECT m.model, m.arm, m.n_folds, round_even(m.mean_auc, 6) AS mean_auc, round_even(m.sd_auc, 6) AS sd_auc, round_even(m.mean_auc - b.mean_auc, 6) AS delta_structured, rank() OVER (PARTITION BY m.model ORDER BY round_even(m.mean_auc, 6) DESC) AS place
FROM m JOIN m b ON b.model = m.model AND b.arm = 'structured'""")
def master_table(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    m = rankstats.auc(study.predictions(spark, d), KEYS).groupBy("model", "arm").agg(F.count("*").alias("n_folds"), F.avg("auc").alias("m"), F.stddev_samp("auc").alias("s"))
    base = m.where("arm = 'structured'").select("model", F.col("m").alias("b"))
    out = m.join(base, "model").select("model", "arm", "n_folds", R("m").alias("mean_auc"), R("s").alias("sd_auc"), R(F.col("m") - F.col("b")).alias("delta_structured"))
    return out.withColumn("place", F.rank().over(Window.partitionBy("model").orderBy(F.desc("mean_auc"))).cast("long"))


#: A given table of importances: hashes of feature and model, so ranks and shares can be checked.
IMP_SQL = f"{F_SQL}, im AS (SELECT fold, model, feature, ((k * 7919 + fold * 104729 + mk * 613) % 997) / 997::DOUBLE AS importance FROM f, (SELECT 'f' || lpad(range::VARCHAR, 2, '0') AS feature, range AS k FROM range(40)), (VALUES ('Logistic', 0), ('Boosted', 1), ('Forest', 2)) m(model, mk)), ir AS (SELECT *, importance / sum(importance) OVER (PARTITION BY fold, model) AS share, row_number() OVER (PARTITION BY fold, model ORDER BY importance DESC, feature) AS rank FROM im)"


def _importances(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    f = study.fold_table(spark, d).select("fold")
    feats = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(39).cast("long")))
    m = F.inline(F.array(*[F.struct(F.lit(name).alias("model"), F.lit(i).cast("long").alias("mk")) for i, name in enumerate(("Logistic", "Boosted", "Forest"))]))
    rows = f.select("fold", feats.alias("k")).select("*", m).withColumn("feature", F.concat(F.lit("f"), F.lpad(F.col("k").cast("string"), 2, "0")))
    rows = rows.withColumn("importance", ((F.col("k") * 7919 + F.col("fold") * 104729 + F.col("mk") * 613) % 997) / F.lit(997.0))
    w = Window.partitionBy("fold", "model")
    return rows.withColumn("share", F.col("importance") / F.sum("importance").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("importance"), "feature")))


@query(f"WITH {IMP_SQL} SELECT fold, model, feature, rank::INT AS rank, round_even(share, 6) AS share FROM ir WHERE rank <= 5")
def topk_importance(spark: SparkSession, d: str) -> DataFrame:
    return _importances(spark, d).where("rank <= 5").select("fold", "model", "feature", "rank", R("share").alias("share"))


@query(f"WITH {IMP_SQL} SELECT model, feature, count(*) AS n_folds, round_even(avg(rank), 6) AS mean_rank, round_even(avg(share), 6) AS mean_share FROM ir WHERE rank <= 10 GROUP BY 1, 2")
def feature_consistency(spark: SparkSession, d: str) -> DataFrame:
    out = _importances(spark, d).where("rank <= 10").groupBy("model", "feature")
    return out.agg(F.count("*").alias("n_folds"), R(F.avg("rank")).alias("mean_rank"), R(F.avg("share")).alias("mean_share"))


@query(f"WITH {IMP_SQL} SELECT fold, feature, sum(rank)::BIGINT AS rank_sum FROM ir WHERE rank <= 30 GROUP BY 1, 2 HAVING count(*) = 3")
def common_top_features(spark: SparkSession, d: str) -> DataFrame:
    top = _importances(spark, d).where("rank <= 30").groupBy("fold", "feature").agg(F.count("*").alias("n"), F.sum("rank").alias("rank_sum"))
    return top.where("n = 3").drop("n")
