"""Exact quantiles (linear between neighbours) without a sort of all values in one task.

The input is read once: values are counted, and the counts written. They are dealt out by approximate edges that only balance the work, into as many parts
as their number asks for; running counts inside each part and the parts' totals give every value its ranks, and the two values next to each wanted
position are picked. The result is exact whatever the edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources import tables

#: Counted values of a part, about, and parts at most.
PART_ROWS, MOST_PARTS = 1 << 16, 4096
#: Edges that are looked through one by one: every STRIDE-th first, then those behind it.
STRIDE = 64
#: Edges of all keys that may be broadcast (8 bytes each), and parts that rows of one key are dealt out over to meet theirs where there are more.
MOST_EDGES, SALTS = 1 << 20, 64


def long(rows: DataFrame, columns: list[str], *keep: str) -> DataFrame:
    """column, value of all columns, one below the other."""
    return rows.select(*keep, F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])))


def stepped(edges: DataFrame, name: str) -> DataFrame:
    """Adds every STRIDE-th edge, as name and _steps."""
    return edges.withColumn(f"{name}_steps", F.filter(name, lambda _, i: i % STRIDE == 0))


def parted(rows: DataFrame, value: str, name: str, part: str) -> DataFrame:
    """Rows with the number of their edges (in order, with steps) that are at most the value; the edges are dropped."""
    upto = lambda edges: F.size(F.filter(edges, lambda e: e <= F.col(value)))
    rows = rows.withColumn("__first", F.greatest(upto(F.col(f"{name}_steps")) - 1, F.lit(0)) * STRIDE)
    return rows.withColumn(part, F.col("__first") + upto(F.slice(name, F.col("__first") + 1, STRIDE))).drop(name, f"{name}_steps", "__first")


def with_edges(counted: DataFrame, edges: DataFrame, keys: list[str], parts: int) -> DataFrame:
    """Counted values with their key's edges; no task gets a key's values because of the key."""
    if not keys:
        return counted.crossJoin(F.broadcast(edges))
    # Spark won't broadcast a small table that lies in a few of many partitions by itself
    if edges.count() * parts <= MOST_EDGES:
        return counted.join(F.broadcast(edges), keys)
    salt = F.pmod(F.xxhash64("__v"), F.lit(SALTS)).cast("int")
    salted = edges.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return counted.withColumn("__salt", salt).join(salted, [*keys, "__salt"]).drop("__salt")


def quantiles(rows: DataFrame, keys: list[str], column: str, qs: list[float], name: str = "quantiles") -> DataFrame:
    """The keys, and an array with the quantiles of the known values; keys without any are missing. Keys are not null."""
    known = rows.where(F.col(column).isNotNull()).select(*keys, F.col(column).cast("double").alias("__v"))
    counted = known.groupBy(*keys, "__v").agg(F.count("*").alias("__n"))
    spark, path, schema = rows.sparkSession, f"{tables.scratch(rows.sparkSession)}/counts", counted.schema
    counted.write.parquet(path)
    counted = spark.read.schema(schema).parquet(path)
    parts = min(MOST_PARTS, -(-counted.count() // PART_ROWS))
    if parts > 1:
        edges = counted.groupBy(*keys).agg(F.percentile_approx("__v", F.array(*[F.lit(i / parts) for i in range(1, parts)]), F.lit(4 * parts)).alias("__edges"))
        edges = stepped(edges, "__edges")
        edges.write.parquet(f"{path}-edges")  # a row for each key
        edges = spark.read.schema(edges.schema).parquet(f"{path}-edges")
        counts = parted(with_edges(counted, edges, keys, parts), "__v", "__edges", "__b")
    else:
        counts = counted.withColumn("__b", F.lit(0))
    totals = counts.groupBy(*keys, "__b").agg(F.sum("__n").alias("__m"))
    totals = totals.withColumn("__before", F.sum("__m").over(Window.partitionBy(*keys).orderBy("__b")) - F.col("__m")).withColumn("__all", F.sum("__m").over(Window.partitionBy(*keys)))
    placed = counts.withColumn("__upto", F.sum("__n").over(Window.partitionBy(*keys, "__b").orderBy("__v"))).join(totals.drop("__m"), [*keys, "__b"])
    first, last = F.col("__before") + F.col("__upto") - F.col("__n"), F.col("__before") + F.col("__upto") - 1

    def at(q: float):
        place = (F.col("__all") - 1) * F.lit(float(q))
        low, high = F.floor(place), F.ceil(place)
        value = lambda k: F.max(F.when((first <= k) & (last >= k), F.col("__v")))
        part_ = F.max(place) - F.floor(F.max(place))
        return value(low) + (value(high) - value(low)) * part_  # equal neighbours give their own value

    return placed.groupBy(*keys).agg(F.array(*[at(q) for q in qs]).alias(name))
