"""Joins and domains that must hold: each check is one small aggregate, and raises with an example."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Violation(ValueError):
    """A table breaks a rule that the study relies on."""


def _none(rows: DataFrame, rule: str) -> None:
    if found := rows.limit(1).collect():
        raise Violation(f"{rule}: {found[0].asDict()}")


def unique(df: DataFrame, *keys: str) -> DataFrame:
    """df, if no key comes twice."""
    _none(df.groupBy(*keys).count().where("count > 1"), f"repeated key {keys}")
    return df


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join of tables that both have each key once."""
    return unique(left, key).join(unique(right, key), key)


def left_one_to_one(left: DataFrame, right: DataFrame, key: str, filled: str) -> DataFrame:
    """Left join that may neither add rows (right keys are unique) nor leave a row without `filled`."""
    out = left.join(unique(right, key), key, "left")
    _none(out.where(F.col(filled).isNull()).select(key), f"no {filled} for a key")
    return out


def lookup(wanted: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """The source's rows of the wanted keys; a key that the source lacks raises."""
    _none(wanted.join(source, key, "left_anti").select(key), "unknown key")
    return wanted.join(source, key)


def reindexed(wanted: DataFrame, source: DataFrame, key: str, fill: dict[str, object]) -> DataFrame:
    """A row for each wanted key; columns of missing rows (and nulls) take their fill value."""
    out = wanted.join(source, key, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fill.items()})


def domain(df: DataFrame, column: str, allowed: list) -> DataFrame:
    """df, if the column has no other value (null passes)."""
    _none(df.where(F.col(column).isNotNull() & ~F.col(column).isin(allowed)).select(column), f"unexpected {column}")
    return df


def star(fact: DataFrame, dimensions: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """The fact with several tables of its own keys, each one's columns with its name behind them (column_name)."""
    for name, (table, key) in dimensions.items():
        table = table.select(F.col(key).alias(f"__{key}"), *[F.col(c).alias(f"{c}_{name}") for c in table.columns if c != key])
        fact = fact.join(table, F.col(key) == F.col(f"__{key}"), "left").drop(f"__{key}")
    return fact


def removed(df: DataFrame, keep: Column) -> tuple[DataFrame, DataFrame]:
    """The rows that stay (null counts as no), and one row that says how many there were, went and stay."""
    stays = F.coalesce(keep, F.lit(False))
    counts = df.agg(F.count("*").alias("n_before"), F.count_if(~stays).alias("n_removed"), F.count_if(stays).alias("n_after"))
    return df.where(stays), counts


def sentinel(df: DataFrame, columns: list[str], value: float = 999) -> DataFrame:
    """Nulls of columns where null means 'never happened' as one large number."""
    return df.fillna(value, [c for c in columns if c in df.columns])


def without(df: DataFrame, *columns: str) -> DataFrame:
    """df without the columns, where it has them (any case)."""
    gone = {c.lower() for c in columns}
    return df.select(*[c for c in df.columns if c.lower() not in gone])


def column_union(*lists: list[str]) -> list[str]:
    """All names once, in order of name."""
    return sorted(set().union(*lists))


def reordered(df: DataFrame, first: list[str], helpers: tuple[str, ...] = ("__",)) -> DataFrame:
    """The named columns first, then the others as they stand; columns with a helper's prefix go."""
    rest = [c for c in df.columns if c not in first and not c.startswith(helpers)]
    return df.select(*first, *rest)
