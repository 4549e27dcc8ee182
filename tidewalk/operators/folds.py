"""Expanding-window folds over observed periods, with test windows that grow until they hold enough events.

The folds come from one row for each period, so the theta join below is small however many rows there are. Rows are matched
with folds by a broadcast range join, or, where the measure adds up, not at all: it is summed by period first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Periods that may be broadcast: months of eight thousand years.
MOST_PERIODS = 100_000


def periods(rows: DataFrame, period: str, target: str) -> DataFrame:
    """One row for each observed period (gaps don't count): i (from 1), n, events, and both summed up to it."""
    by = rows.where(F.col(period).isNotNull()).groupBy(F.col(period).alias("period")).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col(target).cast("long")), F.lit(0)).alias("events"))
    order = Window.orderBy("period")  # a row for each period, not for each row
    return by.withColumn("i", F.row_number().over(order)).withColumn("upto_n", F.sum("n").over(order)).withColumn("upto_events", F.sum("events").over(order))


def build(rows: DataFrame, period: str, target: str, min_train: int = 8, step: int = 3, min_events: int = 100) -> DataFrame:
    """fold, train_cutoff, test_end, n_train, n_test, n_test_events.

    The cutoff stands after min_train, min_train + step, ... periods; the test ends with the first period that brings min_events. Events
    that are left only get fewer, so once a cutoff finds no end, neither does any later one.
    """
    p = periods(rows, period, target)
    start = p.where((F.col("i") >= min_train) & ((F.col("i") - min_train) % step == 0))
    a, b = start.alias("a"), p.alias("b")
    pairs = a.join(F.broadcast(b), (F.col("b.i") > F.col("a.i")) & (F.col("b.upto_events") - F.col("a.upto_events") >= min_events))
    ends = pairs.groupBy(F.col("a.i").alias("i"), F.col("a.period").alias("train_cutoff"), F.col("a.upto_n").alias("n_train"), F.col("a.upto_events").alias("e")).agg(
        F.min_by(F.struct("b.period", "b.upto_n", "b.upto_events"), F.col("b.i")).alias("end"),
    )
    return ends.select(
        F.row_number().over(Window.orderBy("i")).alias("fold"), "train_cutoff", F.col("end.period").alias("test_end"),
        "n_train", (F.col("end.upto_n") - F.col("n_train")).alias("n_test"), (F.col("end.upto_events") - F.col("e")).alias("n_test_events"),
    )


def membership(rows: DataFrame, folds: DataFrame, period: str) -> DataFrame:
    """Each row with each fold that it is in, and its side there."""
    small = F.broadcast(folds.select("fold", "train_cutoff", "test_end"))
    at = F.col(period)
    return rows.join(small, at <= F.col("test_end")).withColumn("side", F.when(at <= F.col("train_cutoff"), "train").otherwise("test"))


def integrity(rows: DataFrame, folds: DataFrame, period: str, key: str) -> DataFrame:
    """One row of checks: sizes that differ from the table, tests that don't lie after their training, rows in several tests."""
    by = rows.groupBy(F.col(period).alias("period")).agg(F.count("*").alias("n"))
    sides = by.join(F.broadcast(folds), F.col("period") <= F.col("test_end"))
    late = F.col("period") > F.col("train_cutoff")
    sizes = sides.groupBy("fold", "n_train", "n_test").agg(F.sum(F.when(~late, F.col("n")).otherwise(0)).alias("train"), F.sum(F.when(late, F.col("n")).otherwise(0)).alias("test"))
    wrong = sizes.agg(F.count("*").alias("n_folds"), F.count_if((F.col("train") != F.col("n_train")) | (F.col("test") != F.col("n_test"))).alias("wrong_sizes"))
    order = folds.agg(F.count_if(F.col("test_end") <= F.col("train_cutoff")).alias("wrong_order"))
    twice = sides.where(late).groupBy("period").agg(F.count("*").alias("folds"), F.first("n").alias("n")).agg(F.coalesce(F.sum(F.when(F.col("folds") > 1, F.col("n"))), F.lit(0)).alias("rows_in_several_tests"))
    return wrong.crossJoin(order).crossJoin(twice)  # one row each


def first_periods(rows: DataFrame, period: str, n: int = 8) -> DataFrame:
    """Rows of the first n observed periods."""
    last = rows.select(period).distinct().orderBy(period).limit(n).agg(F.max(period).alias("last"))
    return rows.join(F.broadcast(last), F.col(period) <= F.col("last")).drop("last")


def inner_split(train: DataFrame, group: str, order: list[str], share: float = 0.8) -> DataFrame:
    """The first floor(n * share) rows of each group's training side by time are 'sub', the rest 'val'.

    The first of `order` is the time. Rows are counted by it, and only those of the time at the cut are put in order by the rest, so no task holds a group.
    """
    time, *rest = order
    by = train.groupBy(group, time).agg(F.count("*").alias("__n"))
    upto, quota = F.sum("__n").over(Window.partitionBy(group).orderBy(time)), F.floor(F.sum("__n").over(Window.partitionBy(group)) * F.lit(share))
    cut = by.select(group, F.col(time).alias("__cut"), "__n", upto.alias("__upto"), quota.alias("__quota")).where("__upto >= __quota and __upto - __n < __quota")
    cut = cut.select(group, "__cut", (F.col("__quota") - F.col("__upto") + F.col("__n")).alias("__first"))  # a row for each group
    marked = train.join(F.broadcast(cut), group, "left")
    at_cut = F.coalesce(F.col(time) == F.col("__cut"), F.lit(False))
    place = F.row_number().over(Window.partitionBy(group).orderBy(*rest))
    inside = marked.where(at_cut).withColumn("part", F.when(place <= F.col("__first"), "sub").otherwise("val"))
    outside = marked.where(~at_cut).withColumn("part", F.when(F.col(time) < F.col("__cut"), "sub").otherwise("val"))
    return outside.unionByName(inside).drop("__cut", "__first")
