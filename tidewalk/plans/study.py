"""The study's tables, made from the star schema: loans from orders, areas from customers, predictions by integer arithmetic.

Each has the same text in SQL, so that queries and their oracles begin from equal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import balance, folds
from ..sources import tables

ARMS = ("structured", "tfidf_full", "embed_pca", "tfidf_chi2", "lexicon", "embed_raw", "structured_has_text")
MODELS = ("Logistic", "Boosted", "Forest")
GROUPINGS = ("index_group", "building_group")
LEVELS = ["Low", "Medium", "High"]

S_SQL = """s AS (
  SELECT o_orderkey AS id, o_orderdate::DATE AS issue_d, date_trunc('month', o_orderdate)::DATE AS month, (o_orderstatus = 'F')::INT AS is_default,
         o_totalprice::DOUBLE AS amount, c_acctbal::DOUBLE AS balance, c_mktsegment AS segment, o_orderpriority AS priority, c_nationkey AS nation,
         lpad((c_custkey % 97)::VARCHAR, 3, '0') AS area
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus IN ('F', 'O'))"""
F_SQL = f"""{S_SQL},
pp AS (SELECT month AS period, count(*) AS n, row_number() OVER (ORDER BY month) AS i, sum(count(*)) OVER (ORDER BY month) AS un, sum(sum(is_default)) OVER (ORDER BY month) AS ue FROM s GROUP BY month),
fe AS (SELECT a.i, a.period AS c, a.un AS n_train, a.ue AS e, min(b.i) AS j FROM pp a JOIN pp b ON b.i > a.i AND b.ue - a.ue >= 100 WHERE a.i >= 8 AND (a.i - 8) % 3 = 0 GROUP BY ALL),
f AS (SELECT row_number() OVER (ORDER BY fe.i) AS fold, c AS train_cutoff, b.period AS test_end, n_train::BIGINT AS n_train, (b.un - n_train)::BIGINT AS n_test, (b.ue - e)::BIGINT AS n_test_events FROM fe JOIN pp b ON b.i = j)"""
P_SQL = f"""{F_SQL},
p AS (
  SELECT s.id, f.fold, m.model, r.arm, s.is_default AS y_true, ((s.id * 7919 + r.k * 131 + m.k * 977) % 1000 + (50 + 5 * r.k) * s.is_default) / 1100::DOUBLE AS y_prob, s.area
  FROM s JOIN f ON s.month > f.train_cutoff AND s.month <= f.test_end
  CROSS JOIN (VALUES {', '.join(f"('{a}', {k})" for k, a in enumerate(ARMS))}) r(arm, k) CROSS JOIN (VALUES {', '.join(f"('{m}', {k})" for k, m in enumerate(MODELS))}) m(model, k))"""
AREA_COLUMNS = ("mean_balance", "mean_amount", "share_building", "share_machinery", "share_urgent", "mean_nation")
A_SQL = f"""{S_SQL},
a AS (
  SELECT area, count(*) AS n, round_even(avg(balance), 4) AS mean_balance, round_even(avg(amount), 4) AS mean_amount, round_even(avg((segment = 'BUILDING')::INT), 6) AS share_building,
         round_even(avg((segment = 'MACHINERY')::INT), 6) AS share_machinery, round_even(avg((priority LIKE '1%')::INT), 6) AS share_urgent, round_even(avg(nation), 6) AS mean_nation
  FROM s GROUP BY area)"""


def rank_sql(x: str) -> str:
    return f"((rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0::DOUBLE) / count(*) OVER ())"


def tertile_sql(x: str, table: str) -> str:
    q = lambda v: f"(SELECT quantile_cont({x}, {v}) FROM {table})"
    return f"CASE WHEN {x} <= {q('0.333::DOUBLE')} THEN 'Low' WHEN {x} <= {q('0.667::DOUBLE')} THEN 'Medium' ELSE 'High' END"


I_SQL = f"""ai AS (SELECT *, round_even(({rank_sql('share_machinery')} + {rank_sql('share_urgent')} + 1 - {rank_sql('mean_balance')} + 1 - {rank_sql('mean_amount')}) / 4, 9) AS disadvantage FROM a),
al AS (SELECT *, {tertile_sql('disadvantage', 'ai')} AS index_group, {tertile_sql('share_building', 'ai')} AS building_group, {tertile_sql('share_machinery', 'ai')} AS machinery_group FROM ai)"""
L_SQL = f"{A_SQL}, {I_SQL}"
#: Predictions with labels: everything in one WITH list.
PL_SQL = f"{P_SQL}, {L_SQL.removeprefix(S_SQL + ',').strip()}, pl AS (SELECT p.*, index_group, building_group FROM p JOIN al USING (area))"


def loans(spark: SparkSession, d: str) -> DataFrame:
    o = tables.scan(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority").where(F.col("o_orderstatus").isin("F", "O"))
    c = tables.scan(spark, d, "customer", "c_custkey", "c_acctbal", "c_mktsegment", "c_nationkey")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("issue_d"), X.month(F.to_date("o_orderdate")).alias("month"), (F.col("o_orderstatus") == "F").cast("int").alias("is_default"),
        F.col("o_totalprice").cast("double").alias("amount"), F.col("c_acctbal").cast("double").alias("balance"), F.col("c_mktsegment").alias("segment"), F.col("o_orderpriority").alias("priority"),
        F.col("c_nationkey").alias("nation"), X.padded((F.col("c_custkey") % 97).cast("string"), 3).alias("area"),
    )


def fold_table(spark: SparkSession, d: str) -> DataFrame:
    return folds.build(loans(spark, d), "month", "is_default")


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """id, fold, model, arm, y_true, y_prob, area: test rows of each fold for each arm and model."""
    rows = folds.membership(loans(spark, d), fold_table(spark, d), "month").where("side = 'test'")
    arms = F.array(*[F.struct(F.lit(a).alias("arm"), F.lit(i).cast("long").alias("ak")) for i, a in enumerate(ARMS)])
    models = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(i).cast("long").alias("mk")) for i, m in enumerate(MODELS)])
    rows = rows.select("*", F.inline(arms)).select("*", F.inline(models))
    p = (F.col("id") * 7919 + F.col("ak") * 131 + F.col("mk") * 977) % 1000 + (50 + 5 * F.col("ak")) * F.col("is_default")
    return rows.select("id", "fold", "model", "arm", F.col("is_default").alias("y_true"), (p / F.lit(1100.0)).alias("y_prob"), "area")


def areas(spark: SparkSession, d: str) -> DataFrame:
    """One row for each area, so labels don't depend on how many loans an area has."""
    share = lambda flag: X.rounded(F.avg(flag.cast("int")))
    return loans(spark, d).groupBy("area").agg(
        F.count("*").alias("n"), X.rounded(F.avg("balance"), 4).alias("mean_balance"), X.rounded(F.avg("amount"), 4).alias("mean_amount"), share(F.col("segment") == "BUILDING").alias("share_building"),
        share(F.col("segment") == "MACHINERY").alias("share_machinery"), share(F.col("priority").startswith("1")).alias("share_urgent"), X.rounded(F.avg("nation")).alias("mean_nation"),
    )


def labelled_areas(spark: SparkSession, d: str) -> DataFrame:
    out = balance.index(areas(spark, d), ["share_machinery", "share_urgent"], ["mean_balance", "mean_amount"], "disadvantage")
    out = out.withColumn("disadvantage", X.rounded("disadvantage", 9))
    return balance.tertiles(out, {"disadvantage": "index_group", "share_building": "building_group", "share_machinery": "machinery_group"})


def labelled_predictions(spark: SparkSession, d: str) -> DataFrame:
    labels = labelled_areas(spark, d).select("area", *GROUPINGS)
    return predictions(spark, d).join(labels, "area")


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """All documents: id, text."""
    return tables.scan(spark, d, "documents", "doc_id", "text").withColumnRenamed("doc_id", "id")


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """id, y (the toxic label) of the labelled documents."""
    docs, labels = tables.scan(spark, d, "documents", "doc_id"), tables.scan(spark, d, "labels", "doc_id", "toxic").where("toxic is not null")
    return labels.join(docs, "doc_id", "left_semi").select(F.col("doc_id").alias("id"), F.col("toxic").alias("y"))
