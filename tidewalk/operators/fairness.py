"""Group fairness: error rates, gaps, calibration. Groupings and thresholds are exploded, so one pass serves all cells."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import exprs as X
from . import quantiles, rankstats

RATES = ("tpr", "fpr", "ppr")


def ungrouped(rows: DataFrame, groupings: list[str]) -> DataFrame:
    """One row for each grouping in which the row has a level."""
    pairs = F.array(*[F.struct(F.lit(g).alias("grouping"), F.col(g).cast("string").alias("level")) for g in groupings])
    return rows.select("*", F.inline(pairs)).where(F.col("level").isNotNull())


def rates(rows: DataFrame, keys: list[str], y: str = "y_true", p: str = "y_prob", threshold: str | float = 0.5) -> DataFrame:
    """n, positives and TPR, FPR, PPR of p >= threshold; null where there is nothing to divide by."""
    t = F.col(threshold) if isinstance(threshold, str) else F.lit(float(threshold))
    hit = F.col(p) >= t
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(F.col(y).cast("long")).alias("n_pos"), F.count_if(hit & (F.col(y) == 1)).alias("tp"), F.count_if(hit & (F.col(y) == 0)).alias("fp"),
    )
    return out.select("*", X.ratio("tp", "n_pos").alias("tpr"), X.ratio("fp", F.col("n") - F.col("n_pos")).alias("fpr"), X.ratio(F.col("tp") + F.col("fp"), "n").alias("ppr"))


def by_group(rows: DataFrame, groupings: list[str], keys: list[str], y: str = "y_true", p: str = "y_prob", threshold: float = 0.5) -> DataFrame:
    """Counts, rates and AUC by grouping and level, all from one count by score (rows have labels 0 or 1)."""
    out = rankstats.auc(ungrouped(rows, groupings), [*keys, "grouping", "level"], y, p, threshold).withColumn("n", F.col("n_pos") + F.col("n_neg"))
    return out.select("*", X.ratio("tp", "n_pos").alias("tpr"), X.ratio("fp", "n_neg").alias("fpr"), X.ratio(F.col("tp") + F.col("fp"), "n").alias("ppr"))


def gaps(groups: DataFrame, keys: list[str], levels: list[str], values: list[str]) -> DataFrame:
    """Signed differences a - b of all pairs of levels, in the order of the list."""
    place = X.ordinal("level", levels)
    known = groups.withColumn("place", place).where(F.col("place").isNotNull())
    a, b = known.alias("a"), known.alias("b")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    on = (F.col("a.place") < F.col("b.place"))
    for s in same:
        on = on & s
    return a.join(b, on).select(*[F.col(f"a.{k}").alias(k) for k in keys], F.concat_ws("-", "a.level", "b.level").alias("comparison"), *[(F.col(f"a.{v}") - F.col(f"b.{v}")).alias(f"gap_{v}") for v in values])


def low_high(groups: DataFrame, keys: list[str], columns: list[str], low: str = "Low", high: str = "High") -> DataFrame:
    """One row for each key with the columns of both levels side by side."""
    pick = lambda level, c: F.max(F.when(F.col("level") == level, F.col(c))).alias(f"{c}_{level.lower()}")
    return groups.where(F.col("level").isin(low, high)).groupBy(*keys).agg(*[pick(level, c) for c in columns for level in (low, high)])


def by_fold(rows: DataFrame, groupings: list[str], keys: list[str], fold: str = "fold") -> DataFrame:
    """Per fold: rates of Low and High, gaps High - Low, tests of Low against High, corrected over the folds of a family."""
    groups = by_group(rows, groupings, [*keys, fold])
    groups = groups.withColumn("hits", F.col("tp") + F.col("fp"))
    wide = low_high(groups, [*keys, fold, "grouping"], ["n", "n_pos", "n_neg", "tp", "fp", "hits", "tpr", "fpr", "ppr", "auc"])
    for rate, k, n in (("tpr", "tp", "n_pos"), ("fpr", "fp", "n_neg"), ("ppr", "hits", "n")):
        z, p = rankstats.two_proportions(f"{k}_low", f"{n}_low", f"{k}_high", f"{n}_high")
        wide = wide.withColumn(f"{rate}_gap", F.col(f"{rate}_high") - F.col(f"{rate}_low")).withColumn(f"{rate}_z", z).withColumn(f"{rate}_p", X.rounded(p, 4))
    wide = wide.withColumn("auc_gap", F.col("auc_high") - F.col("auc_low"))
    for rate in RATES:
        wide = rankstats.benjamini_hochberg(wide, [*keys, "grouping"], f"{rate}_p", [fold], f"{rate}_q")
    return wide


def fold_summary(folds: DataFrame, keys: list[str], level: float = 0.05) -> DataFrame:
    """Mean gap and numbers of significant folds of each rate."""
    parts = [F.struct(F.lit(r).alias("metric"), F.col(f"{r}_gap").alias("gap"), F.col(f"{r}_p").alias("p"), F.col(f"{r}_q").alias("q")) for r in RATES]
    long = folds.select(*keys, "grouping", F.inline(F.array(*parts)))
    return long.groupBy(*keys, "grouping", "metric").agg(F.count("gap").alias("n_folds"), X.rounded(F.avg("gap")).alias("mean_gap"), F.count_if(F.col("p") < level).alias("n_raw"), F.count_if(F.col("q") < level).alias("n_corrected"))


def grid(rows: DataFrame, groupings: list[str], keys: list[str], thresholds: list[float], least: int = 30, by: str | None = None, labels: DataFrame | None = None) -> DataFrame:
    """Low/High gaps and equalised-odds difference of all thresholds in one pass; cells with a side of fewer than `least` positives or negatives are null.

    Counts are taken by distinct decision, not by threshold: each row is added to the thresholds it reaches after a first count
    by the number of thresholds reached, so rows aren't multiplied. Where the groupings belong to an area, `by` names its column and `labels` (by area)
    has them: then rows are counted by area before they meet any grouping.
    """
    cuts = F.array(*[F.lit(float(t)) for t in sorted(thresholds)])
    rows = rows.withColumn("reached", F.size(F.filter(cuts, lambda t: t <= F.col("y_prob"))))
    if by is None:
        counts = rows.withColumn("n", F.lit(1).cast("long"))
    else:
        counts = rows.groupBy(*keys, by, "reached", "y_true").agg(F.count("*").alias("n")).join(labels, by)
    long = ungrouped(counts, groupings).where(F.col("level").isin("Low", "High"))
    cells = long.groupBy(*keys, "grouping", "level", "reached", "y_true").agg(F.sum("n").alias("n"))
    cells = cells.select("*", F.posexplode(cuts).alias("place", "threshold"))
    hit, pos = F.col("reached") > F.col("place"), F.col("y_true") == 1
    some = lambda flag: F.coalesce(F.sum(F.when(flag, F.col("n"))), F.lit(0))
    sides = cells.groupBy(*keys, "grouping", "level", "threshold").agg(F.sum("n").alias("n"), some(pos).alias("n_pos"), some(~pos).alias("n_neg"), some(hit & pos).alias("tp"), some(hit & ~pos).alias("fp"))
    wide = low_high(sides, [*keys, "grouping", "threshold"], ["n", "n_pos", "n_neg", "tp", "fp"])
    enough = F.least("n_pos_low", "n_pos_high", "n_neg_low", "n_neg_high") >= least
    enough = F.coalesce(enough, F.lit(False)) & F.col("n_low").isNotNull() & F.col("n_high").isNotNull()
    gap = lambda k, n: F.when(enough, F.col(f"{k}_high") / F.col(f"{n}_high") - F.col(f"{k}_low") / F.col(f"{n}_low"))
    out = wide.withColumn("small_cell", (~enough).cast("int")).withColumn("tpr_gap", gap("tp", "n_pos")).withColumn("fpr_gap", gap("fp", "n_neg"))
    return out.withColumn("eo_diff", F.when(enough, F.greatest(F.abs("tpr_gap"), F.abs("fpr_gap"))))


def area_gaps(rows: DataFrame, keys: list[str], area: str, threshold: float = 0.5, least_n: int = 80, least_pos: int = 10) -> DataFrame:
    """Largest difference between areas in FNR, FPR and Brier score, over areas with enough rows and positives."""
    r = rates(rows.withColumn("loss", F.pow(F.col("y_prob") - F.col("y_true"), F.lit(2.0))), [*keys, area], threshold=threshold)
    loss = rows.groupBy(*keys, area).agg(F.avg(F.pow(F.col("y_prob") - F.col("y_true"), F.lit(2.0))).alias("brier"))
    r = r.join(loss, [*keys, area]).withColumn("kept", (F.col("n") >= least_n) & (F.col("n_pos") >= least_pos))
    spread = lambda c, name: (F.max(F.when(F.col("kept"), c)) - F.min(F.when(F.col("kept"), c))).alias(name)
    return r.groupBy(*keys).agg(F.count("*").alias("n_areas"), F.count_if("kept").alias("n_kept"), spread(1 - F.col("tpr"), "fnr_gap"), spread(F.col("fpr"), "fpr_gap"), spread(F.col("brier"), "brier_gap"))


def area_summary(rows: DataFrame, area: str, keys: list[str], fold: str = "fold", threshold: float = 0.5) -> DataFrame:
    """Areas over folds: folds, rows, default rate anew from the counts, mean and deviation of the folds' FPR."""
    r = rates(rows, [*keys, area, fold], threshold=threshold)
    return r.groupBy(*keys, area).agg(F.count("*").alias("n_folds"), F.sum("n").alias("n"), (F.sum("n_pos") / F.sum("n")).alias("default_rate"), F.avg("fpr").alias("mean_fpr"), F.stddev_samp("fpr").alias("sd_fpr"))


def verdict(delta, tolerance: float = 1e-5):
    """Direction of a change of a gap's size."""
    return F.when(X.c(delta) < -tolerance, "improved").when(X.c(delta) > tolerance, "worsened").when(X.c(delta).isNotNull(), "unchanged")


def calibration(rows: DataFrame, keys: list[str], level: str, bins: int = 10) -> DataFrame:
    """Calibration curve by level in bins whose edges are the deciles of the whole key, shared by its levels; p on an edge goes right."""
    edges = quantiles.quantiles(rows, keys, "y_prob", [i / bins for i in range(1, bins)], "edges").withColumn("edges", F.array_distinct("edges"))
    binned = rows.join(F.broadcast(edges), keys).withColumn("bin", X.bins_right("y_prob", F.col("edges")))  # one row for each key
    return binned.groupBy(*keys, level, "bin").agg(F.count("*").alias("n"), X.exact_mean("y_prob").alias("mean_p"), F.avg(F.col("y_true").cast("double")).alias("rate"))


def calibration_error(curve: DataFrame, keys: list[str]) -> DataFrame:
    """Expected calibration error from a curve."""
    return curve.groupBy(*keys).agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.abs(F.col("rate") - F.col("mean_p"))) / F.sum("n")).alias("ece"))


def calibration_summary(errors: DataFrame, keys: list[str], level: str) -> DataFrame:
    """Errors of High and Low side by side, averaged over folds."""
    pick = lambda name: F.avg(F.when(F.col(level) == name, F.col("ece")))
    return errors.groupBy(*keys).agg(pick("Low").alias("ece_low"), pick("High").alias("ece_high"), (pick("High") - pick("Low")).alias("ece_diff"), F.count("*").alias("n_cells"))


# --- small fits, one for each group: a few numbers by Newton's method in numpy --------------------


def irls(x: np.ndarray, y: np.ndarray, w: np.ndarray, steps: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Weighted logistic coefficients and their standard errors."""
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        info = x.T @ (x * (w * p * (1 - p))[:, None]) + 1e-10 * np.eye(x.shape[1])
        step = np.linalg.solve(info, x.T @ (w * (y - p)))
        beta += step
        if np.abs(step).max() < 1e-10:
            break
    return beta, np.sqrt(np.diag(np.linalg.inv(info)))


def _wald(beta: np.ndarray, se: np.ndarray) -> np.ndarray:
    from math import erfc

    return np.array([erfc(abs(b / s) / 2**0.5) for b, s in zip(beta, se, strict=True)])


def recalibration(rows: DataFrame, keys: list[str], digits: int = 3) -> DataFrame:
    """y ~ 1 + logit(p) by group. Rows are first counted by rounded logit, so a group's fit sees at most some ten thousand numbers."""
    cells = rows.withColumn("x", F.bround(X.logit("y_prob"), digits)).groupBy(*keys, "x").agg(F.count("*").alias("n"), F.sum(F.col("y_true").cast("long")).alias("pos"))
    kinds = ", ".join(f"{k} {t}" for k, t in cells.dtypes if k in keys)

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n, pos, x = pdf["n"].to_numpy(float), pdf["pos"].to_numpy(float), np.column_stack([np.ones(len(pdf)), pdf["x"]])
        if pos.sum() in (0, n.sum()) or len(pdf) < 2:
            return pd.DataFrame([[*key, np.nan, np.nan, int(n.sum())]], columns=[*keys, "intercept", "slope", "n"])
        beta, _ = irls(np.vstack([x, x]), np.repeat([1.0, 0.0], len(pdf)), np.concatenate([pos, n - pos]))
        return pd.DataFrame([[*key, *beta, int(n.sum())]], columns=[*keys, "intercept", "slope", "n"])

    return cells.groupBy(*keys).applyInPandas(fit, f"{kinds}, intercept double, slope double, n long")


def sufficiency(rows: DataFrame, keys: list[str], level: str, least: int = 30, digits: int = 3) -> DataFrame:
    """y ~ logit(p) + is_high + interaction over Low and High, with Wald p; null where a side has fewer than `least` positives."""
    cells = rows.where(F.col(level).isin("Low", "High")).withColumn("x", F.bround(X.logit("y_prob"), digits)).withColumn("high", (F.col(level) == "High").cast("int"))
    cells = cells.groupBy(*keys, "x", "high").agg(F.count("*").alias("n"), F.sum(F.col("y_true").cast("long")).alias("pos"))
    kinds = ", ".join(f"{k} {t}" for k, t in cells.dtypes if k in keys)
    names = ["coef_is_high", "p_is_high", "coef_interaction", "p_interaction"]

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n, pos, x, high = (pdf[c].to_numpy(float) for c in ("n", "pos", "x", "high"))
        if min(pos[high == 1].sum(), pos[high == 0].sum()) < least or pos.sum() == n.sum():
            return pd.DataFrame([[*key, *[np.nan] * 4]], columns=[*keys, *names])
        design = np.column_stack([np.ones(len(x)), x, high, x * high])
        beta, se = irls(np.vstack([design, design]), np.repeat([1.0, 0.0], len(x)), np.concatenate([pos, n - pos]))
        p = _wald(beta, se)
        return pd.DataFrame([[*key, beta[2], p[2], beta[3], p[3]]], columns=[*keys, *names])

    return cells.groupBy(*keys).applyInPandas(fit, f"{kinds}, " + ", ".join(f"{c} double" for c in names))


def effect_pairs(folds: DataFrame, keys: list[str], arm: str, base: str, other: str, value: str, fold: str = "fold") -> DataFrame:
    """Differences other - base of a value in the same fold."""
    a, b = folds.where(F.col(arm) == base), folds.where(F.col(arm) == other)
    both = a.select(*keys, fold, F.col(value).alias("base")).join(b.select(*keys, fold, F.col(value).alias("other")), [*keys, fold])
    return both.withColumn("delta", F.col("other") - F.col("base"))


def window_share(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Value as a share of its group's sum."""
    return rows.withColumn("share", F.col(value) / F.sum(value).over(Window.partitionBy(*keys)))


