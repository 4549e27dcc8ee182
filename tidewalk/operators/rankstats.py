"""Exact rank statistics with ties, from running sums over distinct scores: no pairs, nothing collected.

Rows are counted by distinct score first. A group's scores are dealt out over BUCKETS by value, so running sums are taken in
many tasks; a bucket's totals, one row for each that has scores, carry them on. Buckets are so narrow that scores of a narrow band still fall into many. No window holds all scores of a group. Scores outside 0..1 stand in the end buckets, which is
still right, and as slow as one task. Products of counts are decimals, so they can't overflow.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import exprs as X
from ..sources import tables

LONG, WIDE = "long", "decimal(19,0)"
BUCKETS = 1 << 16


def bucket(p: str, n: int = BUCKETS) -> Column:
    return F.least(F.floor(X.clipped(F.col(p).cast("double"), 0.0, 1.0) * n), F.lit(n - 1)).cast("int")


def counted(rows: DataFrame, keys: list[str], y: str, p: str) -> DataFrame:
    """Distinct scores of each group with positives, negatives and the bucket they stand in."""
    one = F.col(y).cast(LONG)
    return rows.groupBy(*keys, F.col(p).alias("score")).agg(F.sum(one).alias("pos"), F.sum(1 - one).alias("neg")).withColumn("__b", bucket("score"))


def running(s: DataFrame, keys: list[str], down: bool = False) -> DataFrame:
    """pos_upto, neg_upto (running sums by score) and n_pos, n_neg (sums of the group)."""
    way = F.desc if down else F.asc
    inside, across, whole = Window.partitionBy(*keys, "__b").orderBy(way("score")), Window.partitionBy(*keys).orderBy(way("__b")), Window.partitionBy(*keys)
    sums = ("pos", "neg")
    totals = s.groupBy(*keys, "__b").agg(*[F.sum(c).alias(f"__{c}") for c in sums])
    before = [(F.sum(f"__{c}").over(across) - F.col(f"__{c}")).alias(f"__before_{c}") for c in sums]
    totals = totals.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__b").alias("__to"), *before, *[F.sum(f"__{c}").over(whole).alias(f"n_{c}") for c in sums])
    on = F.col("__b").eqNullSafe(F.col("__to"))
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    out = s.withColumns({f"__{c}": F.sum(c).over(inside) for c in sums}).join(totals, on)
    return out.select(*keys, "score", *sums, *[(F.col(f"__{c}") + F.col(f"__before_{c}")).alias(f"{c}_upto") for c in sums], "n_pos", "n_neg")


def by_score(rows: DataFrame, keys: list[str], y: str, p: str) -> DataFrame:
    """Distinct scores of each group with positives, negatives and those below."""
    return running(counted(rows, keys, y, p), keys).withColumn("neg_below", F.col("neg_upto") - F.col("neg"))


def auc(rows: DataFrame, keys: list[str], y: str = "y_true", p: str = "y_prob", threshold: float | None = None) -> DataFrame:
    """Area under the ROC curve, ties counting a half; null for a single class. With a threshold, tp and fp of p >= threshold from the same counts."""
    s = counted(rows, keys, y, p)
    inside, across = Window.partitionBy(*keys, "__b").orderBy("score"), Window.partitionBy(*keys).orderBy("__b")
    s = s.withColumn("__below", F.sum("neg").over(inside) - F.col("neg"))
    hits = [] if threshold is None else [F.sum(F.when(F.col("score") >= F.lit(float(threshold)), F.col(c)).otherwise(0)).alias(name) for c, name in (("pos", "tp"), ("neg", "fp"))]
    wide = lambda c: F.col(c).cast(WIDE)
    b = s.groupBy(*keys, "__b").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum(wide("pos") * (2 * F.col("__below") + F.col("neg")).cast(WIDE)).alias("__won"), *hits)
    b = b.withColumn("__before", F.sum("neg").over(across) - F.col("neg"))
    won = F.sum(F.col("__won") + 2 * wide("pos") * wide("__before")).cast("double")
    out = b.groupBy(*keys).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), won.alias("won"), *[F.sum(c).alias(c) for c in ("tp", "fp") if threshold is not None])
    return out.select(*keys, "n_pos", "n_neg", *[c for c in ("tp", "fp") if threshold is not None], X.ratio(F.col("won"), 2.0 * F.col("n_pos") * F.col("n_neg")).alias("auc"))


def average_precision(rows: DataFrame, keys: list[str], y: str = "y_true", p: str = "y_prob") -> DataFrame:
    """Sum of recall steps times precision over distinct scores, from the highest."""
    s = running(counted(rows, keys, y, p), keys, down=True)
    step = X.ratio(F.col("pos").cast("double") * F.col("pos_upto"), (F.col("pos_upto") + F.col("neg_upto")) * F.col("n_pos").cast("double"))
    return s.groupBy(*keys).agg(F.sum(step).alias("ap"))


def brier_gini(rows: DataFrame, keys: list[str], y: str = "y_true", p: str = "y_prob") -> DataFrame:
    brier = rows.groupBy(*keys).agg(F.avg(F.pow(F.col(p) - F.col(y), F.lit(2.0))).alias("brier"), F.count("*").alias("n"))
    return brier.join(auc(rows, keys, y, p), keys).withColumn("gini", 2 * F.col("auc") - 1)


def placements(rows: DataFrame, keys: list[str], y: str, p: str) -> DataFrame:
    """The score's DeLong component: for a positive the share of negatives below, for a negative of positives above (ties a half)."""
    s = by_score(rows, keys, y, p)
    below = (F.col("neg_below") + F.col("neg") / 2) / F.col("n_neg")
    above = (F.col("n_pos") - F.col("pos_upto") + F.col("pos") / 2) / F.col("n_pos")
    return s.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("score").alias("__score"), below.alias("v10"), above.alias("v01"))


def delong(rows: DataFrame, keys: list[str], arm: str, base: str, row_id: str = "id", y: str = "y_true", p: str = "y_prob", strict: bool = False) -> DataFrame:
    """Paired DeLong test of every other arm against the base arm, by group: one ranking and one pairing of all arms.

    delta_auc is the arm's less the base's; z and the interval are those of base - arm, and the interval says so in its name. Variances that aren't
    positive give null. Rows that the base or the arm lacks, or whose labels differ, are counted in n_unpaired; `strict` raises instead.
    """
    scores = placements(rows, [*keys, arm], y, p)
    on = F.col(p) == F.col("__score")
    for k in (*keys, arm):
        on = on & (F.col(k) == F.col(f"__{k}"))
    ranked = rows.select(*keys, arm, row_id, F.col(y).alias("__y"), p).join(scores, on).select(*keys, arm, row_id, "__y", "v10", "v01")
    pair, is_base = Window.partitionBy(*keys, row_id), F.col(arm) == base
    at_base = lambda c: F.max(F.when(is_base, F.col(c))).over(pair)
    both = ranked.withColumns({"b10": at_base("v10"), "b01": at_base("v01"), "by": at_base("__y")}).where(~is_base)
    paired = F.coalesce(F.col("by") == F.col("__y"), F.lit(False))
    one, zero = paired & (F.col("__y") == 1), paired & (F.col("__y") == 0)
    aggs = [F.count_if(~paired).alias("lone"), F.count_if(F.col("by").isNotNull()).alias("met"), F.count_if(one).alias("n1"), F.count_if(zero).alias("n0")]
    for name, flag in (("10", one), ("01", zero)):
        x, z = F.when(flag, F.col(f"b{name}")), F.when(flag, F.col(f"v{name}"))
        aggs += [F.avg(x).alias(f"mean{name}_a"), F.avg(z).alias(f"mean{name}_b"), F.var_samp(x - z).alias(f"s{name}")]
    out = both.groupBy(*keys, arm).agg(*aggs)
    # rows of the base that the arm lacks: one count for each group
    there = rows.where(is_base).groupBy(*keys).agg(F.count("*").alias("__n"))
    out = out.join(there, keys, "left").withColumn("n_unpaired", F.col("lone") + F.coalesce("__n", F.lit(0)) - F.col("met"))
    if strict and (bad := out.where("n_unpaired > 0").limit(1).collect()):
        raise ValueError(f"rows without a partner: {bad[0].asDict()}")
    # var(a) + var(b) - 2 cov(a, b) of the components is the variance of their difference
    var = F.col("s10") / F.col("n1") + F.col("s01") / F.col("n0")
    diff = F.col("mean10_a") - F.col("mean10_b")
    out = out.withColumn("auc_a", F.col("mean10_a")).withColumn("auc_b", F.col("mean10_b")).withColumn("se", F.when(var > 0, F.sqrt(var)))
    out = out.withColumn("z", diff / F.col("se"))
    return out.select(
        *keys, arm, "n1", "n0", "n_unpaired", "auc_a", "auc_b", (-diff).alias("delta_auc"), "z", X.two_sided_p("z").alias("p_value"),
        (diff - 1.96 * F.col("se")).alias("ci_diff_a_minus_b_lo"), (diff + 1.96 * F.col("se")).alias("ci_diff_a_minus_b_hi"),
    )


def benjamini_hochberg(rows: DataFrame, family: list[str], p: str = "p_value", order: list[str] = (), q: str = "q_value") -> DataFrame:
    """q-values by family; a null p stays null and doesn't count."""
    known = Window.partitionBy(*family, F.col(p).isNotNull())
    place = F.row_number().over(known.orderBy(p, *order))
    raw = F.when(F.col(p).isNotNull(), F.col(p) * F.count(p).over(known) / place)
    rows = rows.withColumn("__raw", raw).withColumn("__place", place)
    back = known.orderBy("__place").rowsBetween(0, Window.unboundedFollowing)
    return rows.withColumn(q, X.clipped(F.min("__raw").over(back), 0.0, 1.0)).drop("__raw", "__place")


def two_proportions(k1, n1, k2, n2) -> tuple:
    """z and p of the pooled two-proportion test, as columns; null where a side is empty or nothing varies."""
    k1, n1, k2, n2 = map(X.c, (k1, n1, k2, n2))
    pooled = (k1 + k2) / (n1 + n2)
    se = F.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n2))
    z = F.when((n1 > 0) & (n2 > 0), F.when(se > 0, (k1 / n1 - k2 / n2) / se))
    return z, X.two_sided_p(z)


def significance(rows: DataFrame, keys: list[str], p: str = "p_value", q: str = "q_value", delta: str = "delta_auc", level: float = 0.05) -> DataFrame:
    """How many tests are significant, raw and corrected, and which side they favour."""
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n_tests"), F.count_if(F.col(p) < level).alias("n_raw"), F.count_if(F.col(q) < level).alias("n_corrected"),
        F.count_if((F.col(p) < level) & (F.col(delta) > 0)).alias("n_favour_b"), F.count_if((F.col(p) < level) & (F.col(delta) < 0)).alias("n_favour_a"), X.rounded(F.avg(delta)).alias("mean_delta"),
    )


def paired_summary(rows: DataFrame, keys: list[str], delta: str) -> DataFrame:
    """n, mean, sample deviation, Cohen's d_z and t of paired differences (three or more, else null)."""
    out = rows.groupBy(*keys).agg(F.count(delta).alias("n"), F.avg(delta).alias("mean_delta"), F.stddev_samp(delta).alias("sd_delta"))
    dz = F.when((F.col("n") >= 3) & (F.col("sd_delta") > 0), F.col("mean_delta") / F.col("sd_delta"))
    return out.withColumn("cohens_dz", dz).withColumn("t_stat", dz * F.sqrt("n"))


def youden(rows: DataFrame, keys: list[str], y: str = "y_true", p: str = "y_prob") -> DataFrame:
    """The threshold (p >= t) with the largest TPR - FPR; of ties the highest."""
    s = running(counted(rows, keys, y, p), keys, down=True)
    wide = lambda c: F.col(c).cast(WIDE)
    j = wide("pos_upto") * wide("n_neg") - wide("neg_upto") * wide("n_pos")  # whole numbers, so that ties are ties
    top = s.groupBy(*keys).agg(F.max(F.struct(j.alias("j"), F.col("score").alias("threshold"), "n_pos", "n_neg")).alias("top"))
    return top.select(*keys, "top.threshold", X.ratio(F.col("top.j").cast("double"), F.col("top.n_pos") * F.col("top.n_neg").cast("double")).alias("youden_j"))


POLICIES = ("legacy_fixed", "validation_youden", "explicit")
#: Thresholds of the old sensitivity analysis (fixed values).
LEGACY = (0.5, 0.6, 0.7)


def thresholds(policy: str, validation: DataFrame | None = None, explicit: float | None = None, y: str = "y_true", p: str = "y_prob") -> list[float]:
    """The thresholds of a policy; Youden's is found on the validation rows that are given, which must not be test rows."""
    if policy == "legacy_fixed":
        return list(LEGACY)
    if policy == "validation_youden" and validation is not None:
        return [youden(validation.withColumn("__all", F.lit(1)), ["__all"], y, p).first()["threshold"]]
    if policy == "explicit" and explicit is not None:
        return [explicit]
    raise ValueError(f"policy {policy} is unknown or lacks what it needs")


#: Rows of a bucket whose resamples are counted apart, buckets at least and at most, and weights that are drawn at once.
APART_ROWS, APART, MOST_APART, DRAWN = 1 << 18, 16, 4096, 1 << 18


def bootstrap_auc(rows: DataFrame, keys: list[str], row_id: str = "id", y: str = "y_true", p: str = "y_prob", n: int = 500, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """Percentile interval of the AUC over Poisson(1) resamples, whose weights follow from row and resample (so any worker gives the same).

    Rows travel once, slim, to buckets of about as many rows each, whose edges are approximate quantiles of all scores; there all resamples are counted in arrays, and one row for each bucket and resample
    goes on. Resamples with one class are skipped; fewer than ten give null.
    """
    tables.shipped(rows.sparkSession)
    slim = rows.select(*keys, F.col(y).cast("double").alias("__y"), F.col(p).alias("score"), F.xxhash64(row_id, F.lit(seed)).alias("__h"))
    apart = min(max(APART, -(-slim.count() // APART_ROWS)), MOST_APART)
    edges = sorted(set(slim.agg(F.percentile_approx("score", F.array(*[F.lit(i / apart) for i in range(1, apart)]), F.lit(10 * apart))).first()[0] or []))
    place = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]).cast("array<double>"), lambda e: e <= F.col("score"))) if edges else F.lit(0)
    slim = slim.withColumn("__b", place)
    kinds = ", ".join(f"{k} {t}" for k, t in slim.dtypes if k in keys)
    # probability that a Poisson(1) number is at most 0, 1, ...
    steps, total, term = [], 0.0, float(np.exp(-1.0))
    for k in range(12):
        total += term
        steps.append(total)
        term /= k + 1
    steps = np.array(steps)
    known = cells(steps)

    def count(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "__y"], ignore_index=True)
        pos, h, score = pdf["__y"].to_numpy() > 0, pdf["__h"].to_numpy().view(np.uint64), pdf["score"].to_numpy()
        # runs of equal score and class, and the score's number of each
        new = np.flatnonzero(np.concatenate([[True], (score[1:] != score[:-1]) | (pos[1:] != pos[:-1])]))
        level = np.cumsum(np.concatenate([[0], score[new][1:] != score[new][:-1]]))
        kind, out, at_once = pos[new].astype(np.int64), [], max(DRAWN // max(len(pdf), 1), 1)
        for start in range(0, n, at_once):
            b = np.arange(start, min(start + at_once, n), dtype=np.uint64)
            w = drawn(mixed(h[None, :] + ((b + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))[:, None]).ravel(), steps, known)
            counts = np.zeros((2, level[-1] + 1, len(b)))
            counts[kind, level] = np.add.reduceat(w.reshape(len(b), -1).astype(np.int64), new, axis=1).T
            down, up = counts
            below = np.cumsum(down, 0) - down
            out.append(np.column_stack([b.astype(np.float64), up.sum(0), down.sum(0), (up * (below + down / 2)).sum(0)]))
        done = pd.DataFrame(np.concatenate(out), columns=["b", "pos", "neg", "won"])
        for name, value in zip((*keys, "__b"), key, strict=True):
            done[name] = value
        return done

    s = slim.groupBy(*keys, "__b").applyInPandas(count, f"{kinds}, __b int, b double, pos double, neg double, won double")
    before = F.sum("neg").over(Window.partitionBy(*keys, "b").orderBy("__b")) - F.col("neg")
    s = s.withColumn("won", F.col("won") + F.col("pos") * before).groupBy(*keys, "b").agg(F.sum("pos").alias("n1"), F.sum("neg").alias("n0"), F.sum("won").alias("won")).where("n1 > 0 and n0 > 0")
    s = s.withColumn("auc", F.col("won") / (F.col("n1") * F.col("n0")))
    enough = lambda q: F.when(F.count("*") >= 10, F.percentile("auc", F.lit(q)))
    return s.groupBy(*keys).agg(F.count("*").alias("n_resamples"), enough(alpha / 2).alias("auc_lo"), enough(1 - alpha / 2).alias("auc_hi"))


def cells(steps: np.ndarray) -> np.ndarray:
    """For the first 16 of 64 random bits: how many of the steps (shares of 1) lie at or below the number; 255 where that takes more bits."""
    cell = np.arange((1 << 16) + 1) / (1 << 16)
    low = np.searchsorted(steps, cell, "right").astype(np.uint8)
    return np.where(low[:-1] == low[1:], low[:-1], np.uint8(255))


def drawn(x: np.ndarray, steps: np.ndarray, known: np.ndarray) -> np.ndarray:
    """How many of the steps lie at or below each of the numbers; `known` are the steps' cells."""
    out = known[(x >> np.uint64(48)).astype(np.uint16)]
    open_ = np.flatnonzero(out == 255)
    out[open_] = np.searchsorted(steps, (x[open_] >> np.uint64(11)).astype(np.float64) / (1 << 53), "right")
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (fixed values of a public generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
