"""Connected components of links between nodes, without any node's links in one task or on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


#: Parts that the links of one node are dealt out over.
SALTS = 8


def with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Links (u, v) with the minimum m of u.

    The hint keeps Spark from broadcasting: it judges tables by their compressed files and doesn't count the copies, and so sends the driver 40 times its threshold.
    """
    salted = least.withColumn("salt", F.explode(F.array(*[F.lit(i).cast("long") for i in range(SALTS)])))
    return edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS).cast("long"))).join(salted.hint("merge"), ["u", "salt"])


def components(links: DataFrame) -> DataFrame:
    """Nodes of links (a, b) with the smallest node that each can reach: node, root.

    Large-star and small-star steps in turn. Each is a minimum (combined before the shuffle) and a join of the links with their
    node's minimum. The links of one node are dealt out over SALTS parts, each with its copy of the minimum, and adaptive execution
    splits what is still too large. Each round is written to the shared folder, so the lineage stays short.
    """
    edges = common.written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "links")
    before = None
    while True:
        start = edges
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: each larger neighbour is hung on the smallest
        edges = with_least(both, least).where("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: each smaller neighbour, and the node itself, is hung on the smallest
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        edges = with_least(edges, least).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges, old = common.written(edges, "stars"), start
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        common.dropped(old)
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
