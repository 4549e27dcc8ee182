"""Areas: indices, groupings, balance between groups, and reweighting."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import exprs as X
from . import rankstats


def one():
    """The window of a table of areas: a row for each area, so one partition is enough, and all windows share it."""
    return Window.partitionBy(F.lit(1))


def percent_rank(x: str):
    """Average-tie rank of a column over its number of values."""
    order = one().orderBy(F.asc_nulls_last(x))
    same = F.count("*").over(order.rangeBetween(Window.currentRow, Window.currentRow))
    return F.when(F.col(x).isNotNull(), (F.rank().over(order) + (same - 1) / 2) / F.count(x).over(one()))


def index(areas: DataFrame, higher_is_worse: list[str], higher_is_better: list[str], name: str = "index") -> DataFrame:
    """Unweighted mean of percentile ranks, those of good things turned round."""
    terms = [percent_rank(c) for c in higher_is_worse] + [1 - percent_rank(c) for c in higher_is_better]
    return areas.withColumn(name, sum(terms[1:], terms[0]) / len(terms))


def z_index(areas: DataFrame, worse: list[str], better: list[str], name: str = "z_index", sample: bool = False) -> DataFrame:
    """Mean of z-scores with the population (or sample) deviation; a constant column counts as 0."""
    def z(c):
        sd = (F.stddev_samp if sample else F.stddev_pop)(c).over(one())
        return (F.col(c) - F.avg(c).over(one())) / F.when(sd == 0, F.lit(1.0)).otherwise(sd)

    terms = [z(c) for c in worse] + [-z(c) for c in better]
    return areas.withColumn(name, sum(terms[1:], terms[0]) / len(terms))


def pc1_index(areas: DataFrame, columns: list[str], along: str, name: str = "pc1_index") -> DataFrame:
    """First principal component of the z-scored columns, its sign that of the correlation with `along`."""
    from . import models

    def z(c):
        sd = F.stddev_pop(c).over(one())
        return (F.col(c) - F.avg(c).over(one())) / F.when(sd == 0, F.lit(1.0)).otherwise(sd)

    rows = areas.withColumn("__v", F.array(*[z(c) for c in columns]))
    scored = models.reduced(rows, rows, "__v", 1)[0].withColumn("__s", F.col("reduced")[0])
    sign = F.when(F.corr("__s", along).over(one()) < 0, -1.0).otherwise(1.0)
    return scored.withColumn(name, F.col("__s") * sign).drop("__v", "reduced", "__s")


def tertiles(areas: DataFrame, columns: dict[str, str], cuts: tuple[float, float] = (0.333, 0.667)) -> DataFrame:
    """Low, Medium, High by exact percentiles; ties fall on one side together."""
    out = areas.withColumns({f"__{c}": F.percentile(c, F.array(*map(F.lit, cuts))).over(one()) for c in columns})
    return out.withColumns({name: X.tertile(c, F.col(f"__{c}")[0], F.col(f"__{c}")[1]) for c, name in columns.items()}).drop(*[f"__{c}" for c in columns])


def quantile_bins(areas: DataFrame, column: str, bins: int, name: str) -> DataFrame:
    """Number of distinct inner quantile edges below the value."""
    edges = F.array_distinct(F.percentile(column, F.array(*[F.lit(i / bins) for i in range(1, bins)])).over(one()))
    return areas.withColumn("__edges", edges).withColumn(name, F.when(F.col(column).isNotNull(), X.bins_left(column, F.col("__edges")))).drop("__edges")


def weighted_means(rows: DataFrame, key: str, weight: str, values: list[str]) -> DataFrame:
    """Weighted mean by key over pairs with both numbers positive."""
    def mean(v):
        ok = (F.col(weight) > 0) & (F.col(v) > 0)
        return (F.sum(F.when(ok, F.col(v) * F.col(weight))) / F.sum(F.when(ok, F.col(weight)))).alias(v)

    return rows.groupBy(key).agg(*[mean(v) for v in values])


def long(areas: DataFrame, keys: list[str], covariates: list[str]) -> DataFrame:
    parts = F.array(*[F.struct(F.lit(v).alias("covariate"), F.col(v).cast("double").alias("value")) for v in covariates])
    return areas.select(*keys, F.inline(parts))


def smd(areas: DataFrame, group: str, covariates: list[str], levels: list[str]) -> DataFrame:
    """Standardised mean differences (sample variances) of all pairs of levels; 0 where nothing varies."""
    moments = long(areas, [group], covariates).groupBy("covariate", group).agg(F.avg("value").alias("mean"), F.var_samp("value").alias("var")).withColumn("place", X.ordinal(group, levels))
    a, b = moments.alias("a"), moments.alias("b")
    pairs = a.join(b, (F.col("a.covariate") == F.col("b.covariate")) & (F.col("a.place") < F.col("b.place")))
    sd = F.sqrt((F.col("a.var") + F.col("b.var")) / 2)
    diff = F.col("a.mean") - F.col("b.mean")
    return pairs.select(
        F.lit(group).alias("grouping"), F.concat_ws("-", F.col(f"a.{group}"), F.col(f"b.{group}")).alias("comparison"), F.col("a.covariate").alias("covariate"),
        F.col("a.mean").alias("mean_a"), F.col("b.mean").alias("mean_b"), F.when(sd > 0, diff / sd).otherwise(0.0).alias("smd"),
    )


def smd_summary(table: DataFrame) -> DataFrame:
    return table.groupBy("grouping", "comparison").agg(F.avg(F.abs("smd")).alias("mean_abs_smd"), F.max(F.abs("smd")).alias("max_abs_smd"))


def weighted_smd(rows: DataFrame, treatment: str, high: str, covariates: list[str], weight: str) -> DataFrame:
    """Differences High - Low with weighted population variances."""
    v = long(rows, [treatment, weight], covariates)
    m = v.groupBy("covariate", treatment).agg((F.sum(F.col("value") * F.col(weight)) / F.sum(weight)).alias("mean"), (F.sum(F.pow("value", F.lit(2.0)) * F.col(weight)) / F.sum(weight)).alias("square"))
    m = m.withColumn("var", F.greatest(F.col("square") - F.col("mean") * F.col("mean"), F.lit(0.0)))
    pick = lambda c, flag: F.max(F.when(flag, F.col(c)))
    is_high = F.col(treatment) == high
    sd = F.sqrt((pick("var", is_high) + pick("var", ~is_high)) / 2)
    diff = pick("mean", is_high) - pick("mean", ~is_high)
    return m.groupBy("covariate").agg(F.when(sd > 0, diff / sd).otherwise(0.0).alias("smd"))


def matched_weights(areas: DataFrame, treatment: str, treated: str, control: str, stratum: str) -> DataFrame:
    """Coarsened exact matching: strata with both sides stay; totals are those after pruning; treated rows weigh 1."""
    side = areas.where(F.col(treatment).isin(treated, control) & F.col(stratum).isNotNull()).withColumn("t", (F.col(treatment) == treated).cast("int"))
    s = Window.partitionBy(stratum)
    side = side.withColumn("ts", F.sum("t").over(s)).withColumn("cs", F.sum(1 - F.col("t")).over(s)).where("ts > 0 and cs > 0")
    side = side.withColumn("tt", F.sum("t").over(one())).withColumn("ct", F.sum(1 - F.col("t")).over(one()))
    weight = F.when(F.col("t") == 1, 1.0).otherwise((F.col("ts") / F.col("tt")) / (F.col("cs") / F.col("ct")))
    return side.withColumn("weight", weight).drop("t", "ts", "cs", "tt", "ct")


def kish(rows: DataFrame, keys: list[str], weight: str = "weight") -> DataFrame:
    """Effective sample size."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), X.ratio(F.pow(F.sum(weight), F.lit(2.0)), F.sum(F.col(weight) * F.col(weight))).alias("n_eff"))


def weighted_fpr(rows: DataFrame, keys: list[str], level: str, weight: str, threshold: float = 0.5) -> DataFrame:
    """FPR of Low and High by weight, effective sizes and the two-proportion test on them."""
    neg = rows.where("y_true = 0").withColumn("hit", (F.col("y_prob") >= threshold).cast("double"))
    g = neg.groupBy(*keys, level).agg((F.sum(F.col("hit") * F.col(weight)) / F.sum(weight)).alias("fpr"), X.ratio(F.pow(F.sum(weight), F.lit(2.0)), F.sum(F.col(weight) * F.col(weight))).alias("n_eff"))
    pick = lambda c, name: F.max(F.when(F.col(level) == name, F.col(c)))
    wide = g.groupBy(*keys).agg(pick("fpr", "Low").alias("low"), pick("fpr", "High").alias("high"), pick("n_eff", "Low").alias("n_eff_low"), pick("n_eff", "High").alias("n_eff_high"))
    z, p = rankstats.two_proportions(F.col("low") * F.col("n_eff_low"), "n_eff_low", F.col("high") * F.col("n_eff_high"), "n_eff_high")
    return wide.withColumn("gap_high_minus_low", F.col("high") - F.col("low")).withColumn("z", z).withColumn("p_value", p)


def entropy_weights(x: np.ndarray, target: np.ndarray, ridge: float = 1e-3, steps: int = 100) -> np.ndarray:
    """Weights (summing to the rows) whose means are the target: Newton's method on the convex dual."""
    d, lam = x - target, np.zeros(x.shape[1])

    def dual(v):
        s = -d @ v
        return np.log(np.exp(s - s.max()).sum()) + s.max() + 0.5 * ridge * v @ v

    for _ in range(steps):
        s = -d @ lam
        w = np.exp(s - s.max())
        w /= w.sum()
        mean = w @ d
        grad = -mean + ridge * lam
        hess = d.T @ (d * w[:, None]) - np.outer(mean, mean) + ridge * np.eye(len(lam))
        step, size = np.linalg.solve(hess, grad), 1.0
        while size > 1e-8 and dual(lam - size * step) > dual(lam):
            size /= 2
        lam = lam - size * step
        if np.abs(grad).max() < 1e-10:
            break
    s = -d @ lam
    w = np.exp(s - s.max())
    return len(x) * w / w.sum()


def entropy_balanced(areas: DataFrame, key: str, treatment: str, treated: str, control: str, covariates: list[str]) -> DataFrame:
    """key, treatment, weight: control areas are weighted to the treated areas' means, on the pooled sample's scale. A row for each area."""
    rows = areas.where(F.col(treatment).isin(treated, control)).select(key, treatment, *[F.col(c).cast("double") for c in covariates])
    kinds = dict(rows.dtypes)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[covariates].to_numpy(float)
        sd = x.std(0, ddof=1)
        x = (x - x.mean(0)) / np.where(sd > 0, sd, 1)
        t = (pdf[treatment] == treated).to_numpy()
        w = np.ones(len(pdf))
        if t.any() and not t.all():
            w[~t] = entropy_weights(x[~t], x[t].mean(0))
        return pdf[[key, treatment]].assign(weight=w)

    return rows.withColumn("__all", F.lit(1)).groupBy("__all").applyInPandas(lambda pdf: fit(pdf.drop(columns="__all")), f"{key} {kinds[key]}, {treatment} {kinds[treatment]}, weight double")
