"""Average-tie ranks, Spearman's correlation and nearest-neighbour information over tables of any size: no window holds all values of a column.

Values are counted first, so a value that a third of the rows share is one row. Distinct values are dealt out over parts by approximate edges, which only
balance the work; running counts inside a part and one total for each part give every value its place. Null and NaN are unknown values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import exprs as X
from ..sources import tables
from . import quantiles

#: Values that more than one in so many rows share have their ranks broadcast: there can't be more of them in a column.
HOT = 256
#: Classes of the target at most; their counts are broadcast.
MOST_CLASSES = 10_000


def counts(rows: DataFrame, columns: list[str], *by: str) -> DataFrame:
    """column, value, what else it is counted by, n; written, so that it is computed once."""
    long = quantiles.long(rows, columns, *by).where(F.col("value").isNotNull() & ~F.isnan("value"))
    counted = long.groupBy("column", "value", *by).agg(F.count("*").alias("n"))
    path = f"{tables.scratch(rows.sparkSession)}/ranks"
    counted.write.parquet(path)
    return rows.sparkSession.read.schema(counted.schema).parquet(path)


def edges(counted: DataFrame) -> DataFrame:
    """column and the values at which its parts begin: a row for each column, at most MOST_PARTS values in it."""
    parts = min(quantiles.MOST_PARTS, max(1, -(-counted.count() // quantiles.PART_ROWS)))
    if parts == 1:
        return counted.select("column").distinct().withColumn("edges", F.array().cast("array<double>"))
    at = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    return counted.groupBy("column").agg(F.percentile_approx("value", at, F.lit(4 * parts)).alias("edges"))


def dealt(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows with the part of their column that their value falls into."""
    return quantiles.parted(rows.join(F.broadcast(quantiles.stepped(found, "edges")), "column"), "value", "edges", "part")


def _before(counted: DataFrame, found: DataFrame) -> DataFrame:
    """column, part, before (rows of earlier parts), total (rows of the column): a row for each part, empty ones too."""
    totals = counted.groupBy("column", "part").agg(F.sum("n").alias("m"))
    every = found.select("column", F.explode(F.sequence(F.lit(0), F.size("edges"))).alias("part"))
    totals = every.join(totals, ["column", "part"], "left").withColumn("m", F.coalesce("m", F.lit(0)))
    column = Window.partitionBy("column")
    return totals.select("column", "part", (F.sum("m").over(column.orderBy("part")) - F.col("m")).alias("before"), F.sum("m").over(column).alias("total"))


def places(rows: DataFrame, columns: list[str]) -> DataFrame:
    """column, value, n, total, rank: the average rank, from 1, of each distinct value among the known values of its column."""
    counted = counts(rows, columns)
    found = edges(counted)
    parted = dealt(counted, found)
    inside = F.sum("n").over(Window.partitionBy("column", "part").orderBy("value"))
    out = parted.withColumn("upto", inside).join(F.broadcast(_before(parted, found)), ["column", "part"])
    return out.select("column", "value", "n", "total", (F.col("before") + F.col("upto") - (F.col("n") - 1) / 2).alias("rank"))


def _ranked(long: DataFrame, found: DataFrame) -> DataFrame:
    """Rows with column and value, and the rank and total of that value; common values meet a broadcast table, the others a shuffled one."""
    common, on = F.col("n") * HOT > F.col("total"), ["column", "value"]
    hot, rare = F.broadcast(found.where(common).drop("n")), found.where(~common).drop("n")
    return long.join(hot, on).unionByName(long.join(hot, on, "left_anti").join(rare, on))


def percentile_ranks(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The key, which is unique, and for each column its average-tie rank over the number of known values; null where the value is unknown."""
    long = quantiles.long(rows, columns, key).where(F.col("value").isNotNull() & ~F.isnan("value"))
    found = _ranked(long, places(rows, columns)).withColumn("share", F.col("rank") / F.col("total"))
    ranks = found.groupBy(key).agg(*[F.max(F.when(F.col("column") == c, F.col("share"))).alias(c) for c in columns])
    return rows.select(key).join(ranks, key, "left")


def index(rows: DataFrame, key: str, higher_is_worse: list[str], higher_is_better: list[str], name: str = "index") -> DataFrame:
    """The key and the unweighted mean of percentile ranks, those of good things turned round; null where a value is unknown."""
    columns = [*higher_is_worse, *higher_is_better]
    terms = [F.col(c) for c in higher_is_worse] + [1 - F.col(c) for c in higher_is_better]
    return percentile_ranks(rows, key, columns).select(key, (sum(terms[1:], terms[0]) / len(terms)).alias(name))


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    """n, spearman: Pearson's correlation of the average ranks over rows where both are known; null where one doesn't vary."""
    known = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in (x, y)]
    both = rows.where(known[0] & known[1]).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    found = places(both, ["x", "y"])
    pairs = both.groupBy("x", "y").agg(F.count("*").alias("m"))
    for c in ("x", "y"):
        one = pairs.withColumn("column", F.lit(c)).withColumn("value", F.col(c))
        pairs = _ranked(one, found.where(F.col("column") == c)).withColumn(f"r{c}", F.col("rank") - (F.col("total") + 1) / 2).drop("column", "value", "rank", "total", c)
    total = lambda a, b: F.sum(F.col("m") * F.col(a) * F.col(b))
    sums = pairs.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("n"), total("rx", "ry").alias("xy"), total("rx", "rx").alias("xx"), total("ry", "ry").alias("yy"))
    return sums.select("n", X.ratio(F.col("xy"), F.sqrt("xx") * F.sqrt("yy")).alias("spearman"))


def _neighbours(parted: DataFrame, y: str, k: int) -> DataFrame:
    """Adds `radius`: how far the k-th other row of the same class is (the farthest if the class is smaller).

    A value's neighbours are among k rows on either side. What lies in other parts comes from a table of the outermost rows of each part.
    """
    keys = ["column", y, "part"]
    inside = Window.partitionBy(*keys).orderBy("value")
    copies = F.array_repeat("value", F.least("n", F.lit(k)).cast("int"))
    rows = parted.withColumn("copies", copies)
    rows = rows.withColumns({
        "left": F.flatten(F.collect_list("copies").over(inside.rowsBetween(-k, -1))), "right": F.flatten(F.collect_list("copies").over(inside.rowsBetween(1, k))),
        "leads": F.lag("value", k).over(inside).isNull(), "ends": F.lead("value", k).over(inside).isNull(),
    })
    def last(a):
        return F.slice(a, F.greatest(F.size(a) - k, F.lit(0)) + 1, k)

    def outermost(flag: str):
        return F.flatten(F.transform(F.sort_array(F.collect_list(F.when(F.col(flag), F.struct("value", "copies")))), lambda s: s["copies"]))

    rims = rows.where(F.col("leads") | F.col("ends")).groupBy(*keys).agg(outermost("leads").alias("head"), outermost("ends").alias("tail"))
    across = Window.partitionBy("column", y).orderBy("part")
    rims = rims.select(*keys, last(F.flatten(F.collect_list("tail").over(across.rowsBetween(-k, -1)))).alias("far_left"), F.slice(F.flatten(F.collect_list("head").over(across.rowsBetween(1, k))), 1, k).alias("far_right"))
    rows = rows.join(rims, keys)
    near = F.concat(last(F.concat("far_left", "left")), F.slice(F.concat("right", "far_right"), 1, k), F.array_repeat("value", (F.least("n", F.lit(k + 1)) - 1).cast("int")))
    away = F.array_sort(F.transform(near, lambda v: F.abs(v - F.col("value"))))
    return rows.withColumn("radius", F.element_at(away, F.col("k").cast("int"))).drop("copies", "left", "right", "leads", "ends", "far_left", "far_right")


def neighbour_information(rows: DataFrame, columns: list[str], y: str, k: int = 3, top: int | None = 50) -> DataFrame:
    """column, information: mutual information of numbers with a class by nearest neighbours, over all rows; the `top` columns, or all.

    For each row the distance to its k-th neighbour of the same class is found (to the farthest if the class has fewer), then how many rows of any class lie
    nearer. The estimate is psi(rows) + mean(psi(neighbours) - psi(rows of the class) - psi(rows nearer)), at least 0. Where k others of the class share
    the value, rows of that value take the place of neighbours, so that columns with few values need no noise. Classes of one row are left out, unknown
    values and classes as well; a column without any row left is missing.
    """
    counted = counts(rows.where(F.col(y).isNotNull()), columns, y)
    classes = counted.groupBy("column", y).agg(F.sum("n").alias("n_class")).where("n_class > 1")
    if classes.count() > MOST_CLASSES * len(columns):
        raise ValueError(f"{y} has more than {MOST_CLASSES} classes")
    counted = counted.join(F.broadcast(classes), ["column", y]).withColumn("k", F.least(F.lit(k), F.col("n_class") - 1))
    found = edges(counted)
    parted = dealt(counted, found)
    # values that stand for themselves: rows nearer are those of the value
    same = F.sum("n").over(Window.partitionBy("column", "part").orderBy("value").rangeBetween(Window.currentRow, Window.currentRow))
    ties = parted.withColumn("nearer", same).where(F.col("n") > F.col("k")).select("column", "n", "n_class", F.col("n").alias("used"), "nearer")
    # the others: counts below both ends of the interval, which may lie in other parts
    open_ = _neighbours(parted, y, k).where(F.col("n") <= F.col("k"))
    sides = F.array(F.struct((F.col("value") + F.col("radius")).alias("value"), F.lit(0).alias("kind")), F.struct((F.col("value") - F.col("radius")).alias("value"), F.lit(2).alias("kind")))
    probes = open_.select("column", F.col("value").alias("centre"), F.col(y).alias("class"), F.col("n").alias("weight"), "n_class", "k", F.inline(sides)).withColumn("n", F.lit(0).cast("long"))
    marks = parted.groupBy("column", "part", "value").agg(F.sum("n").alias("n")).withColumn("kind", F.lit(1))
    line = marks.unionByName(dealt(probes, found), allowMissingColumns=True)
    order = Window.partitionBy("column", "part").orderBy("value", "kind")
    line = line.withColumn("upto", F.sum("n").over(order)).where("kind <> 1").join(F.broadcast(_before(marks, found)), ["column", "part"])
    between = F.sum(F.when(F.col("kind") == 0, 1).otherwise(-1) * (F.col("before") + F.col("upto")))
    open_ = line.groupBy("column", "centre", "class").agg(F.max("weight").alias("n"), F.max("n_class").alias("n_class"), F.max("k").alias("used"), between.alias("nearer")).drop("centre", "class")
    psi = X.digamma
    terms = ties.unionByName(open_).groupBy("column").agg(F.sum("n").alias("all"), F.sum(F.col("n") * (psi("used") - psi("n_class") - psi("nearer"))).alias("t"))
    out = terms.select("column", F.greatest(F.lit(0.0), psi("all") + F.col("t") / F.col("all")).alias("information"))
    return out if top is None else out.orderBy(F.desc("information"), "column").limit(top)
