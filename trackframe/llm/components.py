"""Connected components in rounds of joins: large stars, then small stars, until only stars are left."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trackframe.session import cut_lineage


def _state(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node) of every node that some link touches.

    Minimums are combined before they are shuffled, and joins are left to adaptive skew splitting, so a node
    with very many links is not one task's work. Rounds grow with the logarithm of the longest chain.
    """
    edges = cut_lineage(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                        .filter("u <> v").distinct())
    before, now = None, _state(edges)
    while now[0] and now != before:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small, "u")
        edges = cut_lineage(joined.select(F.explode(F.array(
            F.struct(F.col("u"), F.col("m").alias("v")),
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
            .filter("u <> v").distinct())
        before, now = now, _state(edges)
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
