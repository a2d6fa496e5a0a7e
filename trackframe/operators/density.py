"""Density clusters (DBSCAN) of feature vectors of any number of columns.

Equal vectors are combined. Vectors lie in cells of side eps / sqrt(columns), so all of a cell are within eps of
each other: a cell with `min_samples` vectors needs no distances, and a cell is one node of the cluster graph. Cells
that may be within eps meet through a coarse grid over the first columns. Whether two cells hold core vectors within
eps of each other is found by halving both: parts whose boxes are too far apart go, one pair of vectors near
enough settles the two cells, and only parts that are neither are halved again. No two full cells are compared
vector by vector.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from trackframe.operators.clusters import FEATURES, connected_components
from trackframe.session import cut_lineage

KEY_COLUMNS = 4     # columns of the coarse grid: a cell is sent to 3 ** KEY_COLUMNS of its places


def _square(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0.0), lambda s, v: s + v * v)


def distance(a: str, b: str) -> Column:
    return F.sqrt(_square(F.zip_with(a, b, lambda p, q: p - q)))


def _apart(low_a: str, high_a: str, low_b: str, high_b: str) -> Column:
    """Smallest distance between two boxes."""
    gap = F.zip_with(F.zip_with(low_a, high_b, lambda p, q: p - q), F.zip_with(low_b, high_a, lambda p, q: p - q),
                     lambda u, v: F.greatest(u, v, F.lit(0.0)))
    return F.sqrt(_square(gap))


def _across(low_a: str, high_a: str, low_b: str, high_b: str) -> Column:
    """Largest distance between two boxes."""
    reach = F.zip_with(F.zip_with(high_a, low_b, lambda p, q: p - q), F.zip_with(high_b, low_a, lambda p, q: p - q),
                       lambda u, v: F.greatest(u, v))
    return F.sqrt(_square(reach))


def _box(d: int) -> list[Column]:
    return [F.array(*[F.min(F.get("x", F.lit(k))) for k in range(d)]).alias("low"),
            F.array(*[F.max(F.get("x", F.lit(k))) for k in range(d)]).alias("high")]


def near_cells(cells: DataFrame, d: int, eps: float, key_columns: int = KEY_COLUMNS) -> DataFrame:
    """Pairs (a, b) of different cells (id, cell, low, high) whose boxes are within eps, both ways."""
    reach, k = math.ceil(math.sqrt(d)), min(d, key_columns)

    def key(i):
        return F.floor(F.get("cell", F.lit(i)) / F.lit(reach))

    spread = cells
    for i in range(k):
        spread = spread.withColumn(f"k{i}", F.explode(F.array(*[key(i) + s for s in (-1, 0, 1)])))
    keys = [f"k{i}" for i in range(k)]
    left = spread.select(*keys, F.col("id").alias("a"), F.col("low").alias("low_a"), F.col("high").alias("high_a"))
    right = cells.select(*[key(i).alias(f"k{i}") for i in range(k)], F.col("id").alias("b"),
                         F.col("low").alias("low_b"), F.col("high").alias("high_b"))
    return left.join(right, keys).filter((F.col("a") != F.col("b")) & (_apart("low_a", "high_a", "low_b", "high_b") <= eps)).select(
        "a", "b")


def linked_cells(core: DataFrame, near: DataFrame, d: int, eps: float, side: float) -> DataFrame:
    """Pairs (a, b), a < b, of cells with core vectors (id, x) within eps of each other.

    A round halves the parts of the pairs that are still open, and is written. Parts end as single vectors.
    """
    root = F.array().cast("array<long>")
    open_ = near.filter("a < b").select("a", "b", root.alias("part_a"), root.alias("part_b"))
    found, level = None, 0
    while True:
        width = side / 2 ** level
        parts = core.withColumn("part", F.transform("x", lambda v: F.floor(v / F.lit(width)))).groupBy("id", "part").agg(
            *_box(d), F.min("x").alias("one"))
        parent = F.transform("part", lambda v: F.floor(v / F.lit(2))) if level else root

        def ends(tag):
            return parts.select(F.col("id").alias(tag), parent.alias(f"part_{tag}"), F.col("part").alias(f"child_{tag}"),
                                *[F.col(c).alias(f"{c}_{tag}") for c in ("low", "high", "one")])

        met = open_.join(ends("a"), ["a", "part_a"]).join(ends("b"), ["b", "part_b"])
        sure = (distance("one_a", "one_b") <= eps) | (_across("low_a", "high_a", "low_b", "high_b") <= eps)
        tried = cut_lineage(met.filter(_apart("low_a", "high_a", "low_b", "high_b") <= eps).select(
            "a", "b", F.col("child_a").alias("part_a"), F.col("child_b").alias("part_b"), sure.alias("sure")))
        settled = cut_lineage(tried.filter("sure").select("a", "b").distinct())
        found = settled if found is None else found.unionByName(settled)
        open_ = tried.join(settled, ["a", "b"], "left_anti").drop("sure")
        level += 1
        if open_.isEmpty():
            return found


def numbered(rows: DataFrame, order: str, out: str) -> DataFrame:
    """Numbers from 0 in the order of a column, counted inside ranges of it."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(rows.repartitionByRange(n, order)).withColumn("_range", F.spark_partition_id())
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))  # a row per range
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    inside = Window.partitionBy("_range").orderBy(order)
    return ranged.withColumn("_k", F.row_number().over(inside) - 1).join(before, "_range").withColumn(
        out, (F.col("_k") + F.col("_before")).cast("int")).drop("_k", "_before", "_range")


def vector_density_clusters(points: DataFrame, columns, eps: float = 2.0, min_samples: int = 3,
                            out: str = "cluster_label", key_columns: int = KEY_COLUMNS) -> DataFrame:
    """DBSCAN labels 0, 1, ... in the order of each cluster's least core vector, -1 for noise; a border vector joins
    the lowest label in reach. A vector counts itself and its copies. Rows with a missing column have no label."""
    columns = list(columns)
    d, side = len(columns), eps / math.sqrt(len(columns))
    held = [F.col(c).cast("double") for c in columns]
    known = [c.isNotNull() & ~F.isnan(c) for c in held]
    whole = F.when(reduce(and_, known), F.array(*[c + F.lit(0.0) for c in held]))
    keyed = cut_lineage(points.withColumn("_x", whole))
    cell = F.transform("x", lambda v: F.floor(v / F.lit(side)))
    pos = cut_lineage(keyed.filter(F.col("_x").isNotNull()).groupBy(F.col("_x").alias("x")).agg(F.count("*").alias("n"))
                      .withColumn("cell", cell))
    cells = cut_lineage(cut_lineage(pos.groupBy("cell").agg(F.sum("n").alias("cell_n"), *_box(d)))
                        .withColumn("id", F.monotonically_increasing_id()))
    near = cut_lineage(near_cells(cells, d, eps, key_columns))
    placed = cut_lineage(pos.join(cells.select("cell", "id", "cell_n"), "cell").select("x", "n", "id", "cell_n"))
    # vectors of cells that are not full count what is in reach: whole cells where they are, else vector by vector
    sparse = placed.filter(F.col("cell_n") < min_samples)
    boxes = cells.select(F.col("id").alias("b"), F.col("cell_n").alias("n_b"), "low", "high")
    round_ = sparse.select("x", F.col("id").alias("a"), F.col("cell_n").alias("own")).join(near, "a").join(boxes, "b")
    judged = round_.filter(_apart("x", "x", "low", "high") <= eps).withColumn("inside", _across("x", "x", "low", "high") <= eps)
    judged = cut_lineage(judged.select("x", "b", "n_b", "inside"))
    certain = judged.filter("inside").groupBy("x").agg(F.sum("n_b").alias("m"))
    enough = sparse.join(certain, "x", "left").select("x", (F.col("cell_n") + F.coalesce("m", F.lit(0))).alias("m"))
    open_ = judged.filter(~F.col("inside")).join(enough.filter(F.col("m") < min_samples).select("x"), "x", "left_semi")
    counted = (open_.join(placed.select(F.col("id").alias("b"), F.col("x").alias("y"), "n"), "b")
               .filter(distance("x", "y") <= eps).groupBy("x").agg(F.sum("n").alias("more")))
    dense = enough.join(counted, "x", "left").filter(F.col("m") + F.coalesce("more", F.lit(0)) >= min_samples).select("x")
    core = cut_lineage(placed.filter(F.col("cell_n") >= min_samples).select("x", "id")
                       .unionByName(sparse.join(dense, "x", "left_semi").select("x", "id")))
    nodes = cut_lineage(core.select("id").distinct())
    ends = near.join(nodes.select(F.col("id").alias("a")), "a", "left_semi").join(nodes.select(F.col("id").alias("b")), "b", "left_semi")
    edges = linked_cells(core, ends.select("a", "b"), d, eps, side)
    parts = connected_components(nodes.select(F.col("id").alias("node")), edges, [])
    named = core.join(parts, core["id"] == parts["node"]).select("x", "id", "label")
    first = named.groupBy("label").agg(F.min("x").alias("first"))
    labels = numbered(first, "first", "cluster").select("label", "cluster")
    labelled = cut_lineage(named.join(labels, "label").select("x", "id", "cluster"))
    # other vectors are within reach of fewer than min_samples, and take the lowest label among the core ones
    rest = placed.join(labelled.select("x"), "x", "left_anti").select("x", F.col("id").alias("a"))
    around = rest.join(near, "a").unionByName(rest.select("a", "x", F.col("a").alias("b")))
    border = (around.join(labelled.select(F.col("id").alias("b"), F.col("x").alias("y"), "cluster"), "b")
              .filter(distance("x", "y") <= eps).groupBy("x").agg(F.min("cluster").alias("cluster")))
    known = labelled.select("x", "cluster").unionByName(border).select(F.col("x").alias("_x"), F.col("cluster").alias("_cluster"))
    return keyed.join(known, "_x", "left").withColumn(
        out, F.when(F.col("_x").isNotNull(), F.coalesce("_cluster", F.lit(-1)))).drop("_x", "_cluster")


def standardised(rows: DataFrame, columns, prefix: str = "z_") -> DataFrame:
    """Rows with every column scaled to mean 0 and population deviation 1 over the rows that have all of them; a
    constant column is only centred."""
    columns = list(columns)
    whole = rows.dropna(subset=columns)
    moments = whole.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    joined = rows.join(F.broadcast(moments), F.lit(True))  # one row
    return joined.withColumns({
        f"{prefix}{c}": (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0)
        for c in columns}).drop(*moments.columns)


def behaviour_density_clusters(trajectories: DataFrame, features=FEATURES, eps: float = 2.0, min_samples: int = 3) -> DataFrame:
    """Density clusters of standardised features; trajectories with a missing feature have no label."""
    rows = standardised(cut_lineage(trajectories), features)
    return vector_density_clusters(rows, [f"z_{c}" for c in features], eps, min_samples).drop(*[f"z_{c}" for c in features])
