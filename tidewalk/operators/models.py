"""Models on pyspark.ml, scored fold by fold and tuned on a split by time (never at random)."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources import tables
from . import fit, folds, rankstats

#: Grids of the temporal search (fixed values).
GRIDS = {"Logistic": {"c": [0.01, 0.03, 0.1, 0.3, 1.0]}, "Boosted": {"depth": [3, 4, 6], "rate": [0.05, 0.1]}, "Forest": {"leaf": [10, 20, 50]}}
#: Folds that tuning looks at, and fits that run side by side.
TUNED, PARALLEL = (4, 8, 12), 4


def weighted(train: DataFrame, y: str) -> DataFrame:
    """Balanced class weights n / (2 n_class)."""
    n = train.groupBy(y).agg(F.count("*").alias("__n"))
    total = n.agg(F.sum("__n").alias("__all"))
    return train.join(F.broadcast(n.crossJoin(total)), y).withColumn("weight", F.col("__all") / (2 * F.col("__n"))).drop("__n", "__all")


def estimator(model: str, n: int, y: str, trees: int, **params):
    common = {"featuresCol": "features", "labelCol": y, "weightCol": "weight"}
    if model == "Logistic":  # the sum of weights is n, so this is C's penalty on the mean loss
        return LogisticRegression(**common, regParam=1 / (params.get("c", 0.3) * n), elasticNetParam=0.0, standardization=False, maxIter=100)
    if model == "Boosted":
        return GBTClassifier(**common, maxIter=trees, maxDepth=params.get("depth", 4), stepSize=params.get("rate", 0.05), subsamplingRate=0.8, seed=42)
    return RandomForestClassifier(**common, numTrees=trees, maxDepth=params.get("max_depth", 10), minInstancesPerNode=params.get("leaf", 20), featureSubsetStrategy="sqrt", seed=42)


def fit_score(train: DataFrame, test: DataFrame, model: str, features: list[str], y: str, trees: int = 20, **params) -> tuple[object, DataFrame]:
    """The fitted model, and the test rows with y_prob."""
    assembler = VectorAssembler(inputCols=features, outputCol="features")
    return fit_vectors(assembler.transform(train), assembler.transform(test), model, y, trees, **params)


def fit_vectors(train: DataFrame, test: DataFrame, model: str, y: str, trees: int = 20, **params) -> tuple[object, DataFrame]:
    """The same for rows that have their column `features`."""
    # every step of a fit sends what each task found to the driver: as many tasks as cores, however many parts the rows lie in
    ready = weighted(train.select(y, "features"), y).coalesce(train.sparkSession.sparkContext.defaultParallelism).cache()
    fitted = estimator(model, ready.count(), y, trees, **params).fit(ready)
    ready.unpersist()
    scored = fitted.transform(test).withColumn("y_prob", vector_to_array("probability")[1])
    return fitted, scored.drop("features", "rawPrediction", "probability", "prediction")


def each_fold(work: Callable, folds: list[dict], parallel: int = PARALLEL) -> list:
    """The folds' work, some side by side: folds are independent, and small fits leave a cluster idle."""
    with ThreadPoolExecutor(max(min(parallel, len(folds)), 1)) as pool:
        return list(pool.map(work, folds))


def sides(rows: DataFrame, fold: dict, period: str) -> tuple[DataFrame, DataFrame]:
    train = rows.where(F.col(period) <= F.lit(fold["train_cutoff"]))
    return train, rows.where((F.col(period) > F.lit(fold["train_cutoff"])) & (F.col(period) <= F.lit(fold["test_end"])))


def walk_forward(rows: DataFrame, fold_table: DataFrame, period: str, y: str, model: str, prepare: dict, trees: int = 20, parallel: int = PARALLEL, learned: dict[int, fit.Prepared] | None = None, **params) -> DataFrame:
    """Predictions of each fold's test rows by a model that saw its training rows only: id, fold, model, y_true, y_prob.

    Where the folds' preprocessing has been learned before (`learned`, by fold), it is used as it is.
    """
    rows = written(rows)

    def one(f: dict) -> DataFrame:
        train, test = sides(rows, f, period)
        p = fit.prepare(train, **prepare) if learned is None else learned[f["fold"]]
        _, scored = fit_score(p.apply(train), p.apply(test), model, p.features(), y, trees, **params)
        return scored.select("id", F.lit(f["fold"]).alias("fold"), F.lit(model).alias("model"), F.col(y).alias("y_true"), "y_prob")

    out = each_fold(one, [r.asDict() for r in fold_table.orderBy("fold").collect()], parallel)  # a row for each fold
    return reduce(DataFrame.unionByName, out)


def written(rows: DataFrame) -> DataFrame:
    """Rows as a table, so that what many passes read isn't joined anew by each."""
    path, spark = f"{tables.scratch(rows.sparkSession)}/rows", rows.sparkSession
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def tuned(rows: DataFrame, fold_table: DataFrame, period: str, row_id: str, y: str, model: str, prepare: dict, tuning: tuple[int, ...] = TUNED, grid: dict[str, list] | None = None, trees: int = 10) -> tuple[DataFrame, dict]:
    """(each candidate's AUC on the inner validation parts of the tuning folds, and their mean; the best candidate, of equals the first)."""
    import json

    folds_ = [r.asDict() for r in fold_table.where(F.col("fold").isin(list(tuning))).orderBy("fold").collect()]

    def one(f: dict) -> DataFrame:
        train, _ = sides(rows, f, period)
        p = fit.prepare(train, **prepare)
        return grid_search(p.apply(train).withColumn(period, F.col(period)), [period, row_id], model, p.features(), y, grid, trees).withColumn("fold", F.lit(f["fold"]))

    by = reduce(DataFrame.unionByName, each_fold(one, folds_))
    mean = by.groupBy("model", "place", "params").agg(F.avg("val_auc").alias("mean_auc"), F.count("val_auc").alias("n_folds")).withColumn("best", F.row_number().over(Window.partitionBy("model").orderBy(F.desc_nulls_last("mean_auc"), "place")) == 1)
    return mean, json.loads(mean.where("best").first()["params"])


def refitted(rows: DataFrame, fold: dict, period: str, y: str, model: str, prepare: dict, best: dict, trees: int = 10) -> DataFrame:
    """Test predictions of a fold by the best candidate, fitted anew on the whole training side."""
    train, test = sides(rows, fold, period)
    p = fit.prepare(train, **prepare)
    _, scored = fit_score(p.apply(train), p.apply(test), model, p.features(), y, trees, **best)
    return scored.select("id", F.lit(fold["fold"]).alias("fold"), F.lit(model).alias("model"), F.col(y).alias("y_true"), "y_prob")


def candidates(grid: dict[str, list]) -> list[dict]:
    return [dict(zip(grid, values, strict=True)) for values in product(*grid.values())]


def grid_search(train: DataFrame, order: list[str], model: str, features: list[str], y: str, grid: dict[str, list] | None = None, trees: int = 10) -> DataFrame:
    """AUC of each candidate on the last fifth of the training rows by time: place, params (JSON), val_auc, n_sub, n_val, best.

    The best is the first with the largest AUC; a split with a single class gives the first candidate, its AUC null.
    """
    import json

    spark = train.sparkSession
    split = folds.inner_split(train.withColumn("__g", F.lit(1)), "__g", order).drop("__g").cache()
    sub, val = split.where("part = 'sub'"), split.where("part = 'val'")
    sizes = split.groupBy("part").agg(F.count("*").alias("n"), F.count_distinct(y).alias("classes")).collect()
    n = {r["part"]: r["n"] for r in sizes}
    usable = len(sizes) == 2 and all(r["classes"] == 2 for r in sizes)
    rows = []
    for i, params in enumerate(candidates(grid or GRIDS[model])):
        auc = None
        if usable:
            _, scored = fit_score(sub, val, model, features, y, trees, **params)
            auc = rankstats.auc(scored.withColumn("k", F.lit(1)), ["k"], y).first()["auc"]
        rows.append((model, i, json.dumps(params, sort_keys=True), auc, n.get("sub", 0), n.get("val", 0)))
    split.unpersist()
    best = max(rows, key=lambda r: (r[3] if r[3] is not None else -1.0, -r[1]))[1]
    return spark.createDataFrame([(*r, r[1] == best) for r in rows], "model string, place int, params string, val_auc double, n_sub long, n_val long, best boolean")


def importances(model: object, features: list[str]) -> pd.DataFrame:
    """|coefficient| or impurity gain, its share and rank."""
    value = np.abs(model.coefficients.toArray()) if hasattr(model, "coefficients") else model.featureImportances.toArray()
    out = pd.DataFrame({"feature": features, "importance": value}).sort_values(["importance", "feature"], ascending=[False, True], ignore_index=True)
    return out.assign(share=out["importance"] / max(out["importance"].sum(), 1e-300), rank=np.arange(1, len(out) + 1))


def components(train: DataFrame, vector: str, k: int) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """(directions, one in each column; means; explained shares) of the training rows' first k principal components.

    Moments are summed on the cluster; the decomposition of the small covariance matrix is done here, so fits may run side by side. A
    direction's largest loading is positive.
    """
    v = train.select(array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("v"))
    stats = v.agg(Summarizer.metrics("mean", "variance").summary(F.col("v")).alias("s")).select("s.mean", "s.variance").first()
    sd = np.sqrt(stats["variance"].toArray())
    corr = np.nan_to_num(Correlation.corr(v, "v").first()[0].toArray())
    values, directions = np.linalg.eigh(corr * np.outer(sd, sd))
    values, directions = np.maximum(values[::-1], 0), directions[:, ::-1][:, :k]
    directions = directions * np.sign(directions[np.abs(directions).argmax(0), np.arange(directions.shape[1])])
    return directions, stats["mean"].toArray(), (values[:k] / max(values.sum(), 1e-300)).tolist()


def projected(vector: str, directions: np.ndarray, means: np.ndarray):
    """Components of an array column, centred on the means, in Arrow batches."""
    centre = means @ directions

    @F.pandas_udf("array<double>")
    def project(x: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack([np.asarray(v, dtype=float) for v in x]) @ directions - centre)) if len(x) else x

    return project(F.transform(vector, lambda x: x.cast("double")))


def reduced(train: DataFrame, rows: DataFrame, vector: str, k: int = 50) -> tuple[DataFrame, list[float]]:
    """Principal components fitted on the training side (zero vectors too), centred on its mean: rows with `reduced`, and explained shares."""
    directions, means, shares = components(train, vector, k)
    return rows.withColumn("reduced", projected(vector, directions, means)), shares


# --- p-values of small samples -------------------------------------------------------------------


def t_cdf(t: float, df: float) -> float:
    """Student's distribution by the continued fraction of the incomplete beta function."""
    from math import exp, lgamma, log

    if t == 0:
        return 0.5
    x, a, b = df / (df + t * t), df / 2, 0.5
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) if 0 < x < 1 else 0.0
    swap = x >= (a + 1) / (a + b + 2)
    if swap:
        a, b, x = b, a, 1 - x
    f = c = 1.0
    d = 0.0
    for i in range(300):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + num * d or 1e-300)
        c = 1 + num / c or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    beta = front * (f - 1) / a
    tail = (1 - beta if swap else beta) / 2
    return 1 - tail if t > 0 else tail


def t_quantile(q: float, df: float) -> float:
    low, high = -1e3, 1e3
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_cdf(mid, df) < q else (low, mid)
    return (low + high) / 2


def wilcoxon(d: np.ndarray) -> tuple[float, float]:
    """Signed-rank statistic and its exact two-sided p (all signs are counted through; zeros drop out, ties share ranks)."""
    d = d[d != 0]
    if not len(d):
        return 0.0, 1.0
    size = np.abs(d)
    ranks = np.array([(size < s).sum() + ((size == s).sum() + 1) / 2 for s in size])
    twice = np.rint(2 * ranks).astype(int)  # whole numbers
    ways = np.zeros(twice.sum() + 1)
    ways[0] = 1
    for r in twice:
        ways[r:] += ways[: len(ways) - r].copy()
    w = min(ranks[d > 0].sum(), ranks[d < 0].sum())
    return float(w), float(min(1.0, 2 * ways[: int(round(2 * w)) + 1].sum() / ways.sum()))


def paired_tests(rows: DataFrame, keys: list[str], delta: str, level: float = 0.05) -> DataFrame:
    """n, mean, interval, t and Wilcoxon p-values of paired differences by key (one value for each fold, so a group is small)."""
    kinds = ", ".join(f"{k} {t}" for k, t in rows.dtypes if k in keys)
    names = ["n_folds", "mean_delta", "ci_lo", "ci_hi", "p_ttest", "w_stat", "p_wilcoxon", "both_agree"]

    def test(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        d = pdf[delta].dropna().to_numpy(float)
        if len(d) < 3:
            return pd.DataFrame([[*key, len(d), *[None] * 6, None]], columns=[*keys, *names])
        se = d.std(ddof=1) / len(d) ** 0.5
        half = t_quantile(0.975, len(d) - 1) * se
        p = 2 * (1 - t_cdf(abs(d.mean() / se), len(d) - 1)) if se > 0 else None
        w, pw = wilcoxon(d)
        return pd.DataFrame([[*key, len(d), d.mean(), d.mean() - half, d.mean() + half, p, w, pw, None if p is None else (p < level) == (pw < level)]], columns=[*keys, *names])

    return rows.select(*keys, delta).groupBy(*keys).applyInPandas(test, f"{kinds}, n_folds long, mean_delta double, ci_lo double, ci_hi double, p_ttest double, w_stat double, p_wilcoxon double, both_agree boolean")
