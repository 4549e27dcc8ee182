"""Statistics that are fitted on the training side only, and applied to all rows.

Each fit takes the training rows and nothing else, does one aggregate, and gives a small Python value; each apply is a projection.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions import exprs as X
from . import quantiles


def numeric_candidates(df: DataFrame, never: set[str]) -> list[str]:
    """Numeric columns but for those that can't be features (target, id, flags of their own)."""
    return sorted(f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in never)


def null_fractions(rows: DataFrame, columns: list[str], distinct: bool = False) -> DataFrame:
    """column, null_fraction and, if asked for (each row is expanded for each column then), n_distinct."""
    wide = rows.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(f"n_{c}") for c in columns], *[F.count_distinct(c).alias(f"d_{c}") for c in columns if distinct])
    parts = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n_{c}").alias("null_fraction"), *([F.col(f"d_{c}").alias("n_distinct")] if distinct else [])) for c in columns])
    return wide.select(F.inline(parts))


def missing_columns(train: DataFrame, columns: list[str], most: float = 0.99) -> list[str]:
    return sorted(r["column"] for r in null_fractions(train, columns).where(F.col("null_fraction") > most).collect())


def _moments(rows: DataFrame, columns: list[str], means: list[float]) -> dict[str, np.ndarray]:
    """Sums over pairs of columns, values less the means: products, values where the other is known, their squares, rows where both are.

    Each task sums its rows as matrices; these are added in two steps, so that no task or the driver sees more than some hundred of them.
    """
    names, p = ["xy", "x", "xx", "n"], len(columns)
    numbers = rows.select(*[F.col(c).cast("double") for c in columns])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((4, p, p))
        for batch in batches:
            x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(p)]).astype(float) - means
            m = (~np.isnan(x)).astype(float)
            x = np.where(m > 0, x, 0.0)
            out += np.stack([x.T @ x, x.T @ m, (x * x).T @ m, m.T @ m])
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() // 128], pa.int64()), pa.array([out.tobytes()], pa.binary())], ["g", "sums"])

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"g": [0], "sums": [sum(np.frombuffer(b) for b in pdf["sums"]).tobytes()]})

    parts = numbers.mapInArrow(summed, "g long, sums binary").groupBy("g").applyInPandas(added, "g long, sums binary").groupBy("g").applyInPandas(added, "g long, sums binary")
    return dict(zip(names, np.frombuffer(parts.first()["sums"]).reshape(4, p, p), strict=True))


def correlations(rows: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, r of all pairs of columns over rows where both are known; null where one doesn't vary. One pass for means, one for all products."""
    first = rows.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    s = _moments(rows, columns, [x or 0.0 for x in first])
    with np.errstate(divide="ignore", invalid="ignore"):
        mean, square = s["x"] / s["n"], s["xx"] / s["n"]
        var = square - mean * mean
        var = np.where(var > 1e-12 * square, var, 0.0)  # what rounding leaves of a constant
        r = (s["xy"] / s["n"] - mean * mean.T) / np.sqrt(var * var.T)
    pairs = [(columns[i], columns[j], float(r[i, j]) if var[i, j] > 0 and var[j, i] > 0 else None) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    return rows.sparkSession.createDataFrame(pairs, "a string, b string, r double")


def correlated_columns(train: DataFrame, columns: list[str], protected: set[str] = frozenset(), most: float = 0.95) -> DataFrame:
    """Columns to drop: of each pair above the limit, judged by itself, the one with more nulls, then the later name."""
    free = [c for c in columns if c not in protected]
    gone = null_fractions(train, free).select("column", "null_fraction")
    pairs = correlations(train, free).where(F.abs("r") > most)
    pairs = pairs.join(F.broadcast(gone.select(F.col("column").alias("a"), F.col("null_fraction").alias("na"))), "a").join(F.broadcast(gone.select(F.col("column").alias("b"), F.col("null_fraction").alias("nb"))), "b")
    drop = F.when(F.col("na") > F.col("nb"), F.col("a")).when(F.col("nb") > F.col("na"), F.col("b")).otherwise(F.greatest("a", "b"))
    return pairs.select(drop.alias("column")).distinct()


def caps(train: DataFrame, columns: list[str], q: float = 0.995) -> DataFrame:
    """One row of exact quantiles (linear between neighbours)."""
    found = quantiles.quantiles(quantiles.long(train, columns), ["column"], "value", [q])
    return found.agg(*[F.max(F.when(F.col("column") == c, F.col("quantiles")[0])).alias(c) for c in columns])


def clip_report(rows: DataFrame, columns: list[str], q: float = 0.995) -> DataFrame:
    """column, cap, applied: columns that are empty or have negative values are left as they are."""
    values = quantiles.long(rows, columns)
    counts = values.groupBy("column").agg(F.count("value").alias("n"), F.count_if(F.col("value") < 0).alias("neg"))
    found = quantiles.quantiles(values, ["column"], "value", [q])
    return counts.join(found, "column", "left").select("column", F.col("quantiles")[0].alias("cap"), ((F.col("n") > 0) & (F.col("neg") == 0)).alias("applied"))


def one_hot(df: DataFrame, column: str, categories: list[str]) -> DataFrame:
    """Indicators of all but the first sorted category; unknown and null are the first's row of zeros."""
    return df.withColumns({f"{column}_{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in sorted(categories)[1:]})


@dataclass
class Prepared:
    """What a fold's preprocessing has learned, and what it did (the audit row)."""

    numeric: list[str]
    missing: list[str]
    correlated: list[str]
    caps: dict[str, float]
    categories: dict[str, list[str]]
    means: dict[str, float] = field(default_factory=dict)
    scales: dict[str, float] = field(default_factory=dict)

    def shaped(self, df: DataFrame) -> DataFrame:
        """Clip and log, indicators, constant imputation."""
        for c, cap in self.caps.items():
            df = df.withColumn(c, F.log1p(X.clipped(c, high=cap)))
        for c, values in self.categories.items():
            df = one_hot(df.withColumn(c, F.coalesce(c, F.lit("Missing"))), c, values)
        return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in self.features()})

    def features(self) -> list[str]:
        return self.numeric + [f"{c}_{v}" for c, values in self.categories.items() for v in sorted(values)[1:]]

    def apply(self, df: DataFrame) -> DataFrame:
        return self.shaped(df).withColumns({c: (F.col(c) - self.means[c]) / self.scales[c] for c in self.features()})


def prepare(train: DataFrame, never: set[str], logged: list[str], encoded: list[str], protected: set[str] = frozenset()) -> Prepared:
    """Missing, correlated, caps, categories, then mean and population deviation (0 counts as 1): all from training rows."""
    numeric = numeric_candidates(train, never)
    missing = missing_columns(train, numeric)
    numeric = [c for c in numeric if c not in missing]
    correlated = sorted(r["column"] for r in correlated_columns(train, numeric, protected).collect())
    numeric = [c for c in numeric if c not in correlated]
    logged = [c for c in logged if c in numeric]
    caps_ = caps(train, logged).first().asDict() if logged else {}
    values = train.agg(*[F.sort_array(F.collect_set(F.coalesce(c, F.lit("Missing")))).alias(c) for c in encoded]).first().asDict() if encoded else {}
    out = Prepared(numeric, missing, correlated, {c: v for c, v in caps_.items() if v is not None}, values)
    stats = out.shaped(train).agg(*[F.avg(c).alias(f"m_{c}") for c in out.features()], *[F.stddev_pop(c).alias(f"s_{c}") for c in out.features()]).first()
    for c in out.features():
        out.means[c], out.scales[c] = stats[f"m_{c}"] or 0.0, stats[f"s_{c}"] or 1.0
    return out


def banned(features: list[str], names: set[str], prefixes: tuple[str, ...] = ()) -> None:
    """Raises if a feature is a banned name or stands in a banned name space."""
    found = sorted(f for f in features if f in names or any(f.startswith(p + ":") for p in prefixes))
    if found:
        raise ValueError(f"banned features: {found}")


def unexpected(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Values outside a domain with their counts."""
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(allowed)).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def quality_checks(df: DataFrame, key: str, needed: list[str], shares: list[str]) -> DataFrame:
    """One row: rows, repeated keys, nulls among the needed columns, shares outside 0..1."""
    nulls = sum((F.col(c).isNull().cast("int") for c in needed), F.lit(0))
    outside = sum((F.coalesce(((F.col(c) < 0) | (F.col(c) > 1)).cast("int"), F.lit(0)) for c in shares), F.lit(0))
    return df.agg(F.count("*").alias("n"), (F.count(key) - F.count_distinct(key)).alias("n_repeated"), F.sum(nulls).alias("n_null"), F.sum(outside).alias("n_outside"))


def median_filled(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls replaced by the column's median."""
    meds = caps(df, columns, 0.5).withColumnsRenamed({c: f"__{c}" for c in columns})
    return df.crossJoin(F.broadcast(meds)).withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"__{c}")) for c in columns}).drop(*meds.columns)


def binned_information(rows: DataFrame, columns: list[str], y: str, bins: int = 10, top: int = 50) -> DataFrame:
    """Mutual information with the target over quantile bins, the `top` columns (a nearest-neighbour estimate has no relational form)."""
    found = quantiles.quantiles(quantiles.long(rows, columns), ["column"], "value", [i / bins for i in range(1, bins)])
    edges = found.agg(*[F.array_distinct(F.max(F.when(F.col("column") == c, F.col("quantiles")))).alias(f"__{c}") for c in columns])
    parts = F.array(*[F.struct(F.lit(c).alias("column"), X.bins_left(c, F.col(f"__{c}")).alias("bin")) for c in columns])
    long = rows.crossJoin(F.broadcast(edges)).select(F.col(y).alias("y"), F.inline(parts))
    n = long.groupBy("column", "bin", "y").agg(F.count("*").cast("double").alias("n"))
    from pyspark.sql.window import Window

    over = lambda *k: F.sum("n").over(Window.partitionBy("column", *k))
    info = n.withColumn("t", F.col("n") / over() * F.ln(F.col("n") * over() / (over("bin") * over("y"))))
    return info.groupBy("column").agg(F.bround(F.sum("t"), 6).alias("information")).orderBy(F.desc("information"), "column").limit(top)
