"""Agreement of annotators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """n, agreement, Cohen's kappa (null where chance agrees in all)."""
    cells = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    one, two = cells.groupBy("a").agg(F.sum("n").alias("na")), cells.groupBy("b").agg(F.sum("n").alias("nb"))
    chance = one.join(two, F.col("a") == F.col("b")).agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("chance"))
    po, pe = F.col("same") / F.col("n"), F.col("chance") / (F.col("n") * F.col("n"))
    return total.crossJoin(chance).select("n", po.alias("agreement"), X.ratio(po - pe, 1 - pe).alias("kappa"))  # one row each


def confusion(pairs: DataFrame, a: str, b: str, labels: list) -> DataFrame:
    """Counts, a row for each label of a and a column for each label of b."""
    return pairs.groupBy(F.col(a).alias("label")).agg(*[F.count_if(F.col(b) == v).alias(f"as_{v}") for v in labels])


def per_class(pairs: DataFrame, truth: str, said: str) -> DataFrame:
    """precision, recall, f1 (0 where there is nothing to divide by), support by class of the truth."""
    t = pairs.groupBy(F.col(truth).alias("label")).agg(F.count("*").alias("support"), F.count_if(F.col(truth) == F.col(said)).alias("tp"))
    s = pairs.groupBy(F.col(said).alias("label")).agg(F.count("*").alias("said"))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    out = t.join(s, "label", "left").withColumn("precision", zero(X.ratio("tp", "said"))).withColumn("recall", zero(X.ratio("tp", "support")))
    return out.select("label", "precision", "recall", zero(X.ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).alias("f1"), "support")


def binary(pairs: DataFrame, truth: str, said: str, positive: list) -> DataFrame:
    """One row: n, agreement, precision, recall, f1 of being in one of the positive classes (0 where there is nothing to divide by)."""
    known = pairs.where(F.col(truth).isNotNull() & F.col(said).isNotNull())
    t, s = F.col(truth).isin(positive), F.col(said).isin(positive)
    out = known.agg(F.count("*").alias("n"), F.avg((t == s).cast("double")).alias("agreement"), F.count_if(t & s).alias("tp"), F.count_if(s).alias("p"), F.count_if(t).alias("t"))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    out = out.withColumn("precision", zero(X.ratio("tp", "p"))).withColumn("recall", zero(X.ratio("tp", "t")))
    return out.select("n", "agreement", "precision", "recall", zero(X.ratio(2 * F.col("tp"), F.col("p") + F.col("t"))).alias("f1"))


def unmatched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that the other side lacks."""
    return left.join(right, key, "left_anti").select(key).distinct()
