"""Trails as sets of grid cells: extraction from flux, graphs, and activity along them.

A graph covers the cells of one grid (96 x 54 at most) of one site or bout; all graphs are
handled together, keyed by `keys`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from trackframe.functions import geometry as g
from trackframe.operators.activity import by_direction
from trackframe.operators.grids import CELL, binned, frames_per_group, in_grid
from trackframe.operators.kinematics import nearest_boundary
from trackframe.operators.trajectories import outline
from trackframe.session import cut_lineage

NX, NY = 96, 54
SITE = ("site_id",)


def _offsets(pairs) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in pairs])


def disk(radius: int) -> list[tuple[int, int]]:
    span = range(-radius, radius + 1)
    return [(i, j) for i in span for j in span if i * i + j * j <= radius * radius]


def spread(cells: DataFrame, offsets) -> DataFrame:
    """Each cell moved by every offset, inside the grid."""
    moved = cells.withColumn("_o", F.explode(_offsets(offsets))).withColumns(
        {"x_bin": F.col("x_bin") + F.col("_o.i"), "y_bin": F.col("y_bin") + F.col("_o.j")}).drop("_o")
    return moved.filter(F.col("x_bin").between(0, NX - 1) & F.col("y_bin").between(0, NY - 1))


def trail_cells(flux: DataFrame, keys=SITE, value: str = "flux_mag", share: float = 0.7,
                widen: int = 0) -> DataFrame:
    """Cells whose flux reaches a percentile of the non-zero cells; widened by a disk if asked."""
    keys = list(keys)
    some = flux.filter(F.col(value) > 0)
    level = some.groupBy(*keys).agg(F.percentile(value, F.lit(share)).alias("_level"))
    cells = some.join(level, keys).filter(F.col(value) >= F.col("_level")).select(*keys, *CELL)
    return spread(cells, disk(widen)).distinct() if widen else cells


NEIGHBOURS = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)]


def cell_graph(cells: DataFrame, keys=SITE) -> DataFrame:
    """Edges between neighbouring cells (eight directions), both ways, as node numbers."""
    keys = list(keys)
    node = (F.col("y_bin") * NX + F.col("x_bin")).cast("int")
    nodes = cells.select(*keys, *CELL, node.alias("node"))
    moved = spread(nodes, NEIGHBOURS)
    return moved.join(nodes.select(*keys, *CELL, F.col("node").alias("other")), [*keys, *CELL]).select(
        *keys, "node", "other")


def node_degrees(cells: DataFrame, keys=SITE) -> DataFrame:
    """Neighbour count of every cell; endpoints have exactly one."""
    keys = list(keys)
    degree = cell_graph(cells, keys).groupBy(*keys, "node").agg(F.count("*").alias("degree"))
    node = (F.col("y_bin") * NX + F.col("x_bin")).cast("int")
    return (cells.select(*keys, *CELL, node.alias("node")).join(degree, [*keys, "node"], "left")
            .withColumn("degree", F.coalesce("degree", F.lit(0)))
            .withColumn("is_endpoint", F.col("degree") == 1))


def nest_junctions(cells: DataFrame, nest: DataFrame, keys=SITE, max_distance: float = 30.0,
                   n: int = 3, spacing: float = 10.0, nest_keys=()) -> DataFrame:
    """Up to n cells nearest to the nest, at least `spacing` apart, in order of distance.

    The fold runs over the cells of one grid that lie within max_distance of the nest.
    """
    keys = list(keys)
    edge = outline(nest.select(*nest_keys, F.col("x_bin").alias("x"), F.col("y_bin").alias("y")), nest_keys)
    near = nearest_boundary(cells, edge, "x_bin", "y_bin", cell=8, width=NX, height=NY, mask_keys=nest_keys)
    inside = nest.select(*nest_keys, *CELL, F.lit(0.0).alias("_zero"))
    near = near.join(inside, [*nest_keys, *CELL], "left").withColumn(
        "d", F.coalesce("_zero", F.sqrt(F.col("near.d2").cast("double")))).filter(F.col("d") <= max_distance)
    row = F.struct("d", F.col("y_bin").alias("y"), F.col("x_bin").alias("x"))
    ordered = near.groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("rows"))

    def far(a, b):
        return (a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]) >= spacing * spacing

    empty = F.array().cast("array<struct<d:double,y:int,x:int>>")
    chosen = F.aggregate("rows", empty, lambda acc, c: F.when(
        (F.size(acc) < n) & F.forall(acc, lambda a: far(a, c)), F.array_append(acc, c)).otherwise(acc))
    return ordered.select(*keys, F.posexplode(chosen).alias("rank", "c")).select(
        *keys, "rank", F.col("c.x").alias("x_bin"), F.col("c.y").alias("y_bin"), F.col("c.d").alias("distance"))


def shortest_trails(cells: DataFrame, junctions: DataFrame, keys=SITE, min_length: int = 10,
                    max_trails: int | None = None, hops_per_round: int = 8) -> DataFrame:
    """Shortest cell path from every endpoint's nearest junction, longer than min_length cells.

    All graphs grow outwards from their junctions together. One hop is a join with the
    neighbour lists and a minimum per cell; several hops make a round, whose result is
    written before the next one. With max_trails only so many per graph, first endpoints first.
    """
    keys = list(keys)
    edges = cell_graph(cells, keys)
    nodes = node_degrees(cells, keys)
    links = cut_lineage(
        edges.groupBy(*keys, "node").agg(F.collect_list("other").alias("others"))
        .select(*keys, "node", "others"))
    node = (F.col("y_bin") * NX + F.col("x_bin")).cast("int")
    state = junctions.select(*keys, node.alias("node"), F.lit(1).alias("length"), "rank",
                             F.array(node).alias("path"))
    done, previous = False, None
    while not done:
        for _ in range(hops_per_round):
            stay = F.struct("node", "length", "rank", "path")
            go = F.transform(F.coalesce("others", F.array().cast("array<int>")), lambda o: F.struct(
                o.alias("node"), (F.col("length") + 1).alias("length"), F.col("rank"),
                F.array_append("path", o).alias("path")))
            state = (state.join(links, [*keys, "node"], "left")
                     .select(*keys, F.explode(F.concat(F.array(stay), go)).alias("s"))
                     .groupBy(*keys, F.col("s.node").alias("node"))
                     .agg(F.min(F.struct("s.length", "s.rank", "s.path")).alias("m"))
                     .select(*keys, "node", "m.*"))
        state = cut_lineage(state)
        now = tuple(state.agg(F.count("*"), F.sum("length"), F.sum("rank")).first())
        done, previous = now == previous, now
    ends = nodes.filter("is_endpoint").select(*keys, "node")
    first = Window.partitionBy(*keys).orderBy("node")  # cells of one grid
    reached = (ends.join(state, [*keys, "node"]).filter(F.col("length") > min_length)
               .withColumn("trail_id", F.row_number().over(first) - 1))
    if max_trails is not None:
        reached = reached.filter(F.col("trail_id") < max_trails)
    return reached.select(*keys, "trail_id", "node", "length", "path")


def trail_points(trails: DataFrame, keys=SITE) -> DataFrame:
    """One row per cell of each trail path."""
    return trails.select(*keys, "trail_id", F.posexplode("path").alias("seq", "n")).select(
        *keys, "trail_id", "seq", (F.col("n") % NX).alias("x_bin"), F.floor(F.col("n") / NX).cast("int").alias("y_bin"))


def trail_overlaps(points: DataFrame, keys=SITE, tolerance: float = 3.0) -> DataFrame:
    """Share of the points of trail a that lie closer than tolerance to some point of trail b."""
    keys = list(keys)
    size = int(-(-tolerance // 1))
    bucket = {"gx": F.floor(F.col("x_bin") / size), "gy": F.floor(F.col("y_bin") / size)}
    b = points.withColumns(bucket).select(*keys, "gx", "gy", F.col("trail_id").alias("b"),
                                          F.col("x_bin").alias("bx"), F.col("y_bin").alias("by")).distinct()
    a = points.withColumns(bucket).withColumn("_o", F.explode(_offsets([(0, 0), *NEIGHBOURS]))).withColumns(
        {"gx": F.col("gx") + F.col("_o.i"), "gy": F.col("gy") + F.col("_o.j")}).select(
        *keys, "gx", "gy", F.col("trail_id").alias("a"), "seq", F.col("x_bin").alias("ax"), F.col("y_bin").alias("ay"))
    near = (a.join(b, [*keys, "gx", "gy"])
            .filter((F.col("a") != F.col("b")) & (g.distance("ax", "ay", "bx", "by") < tolerance))
            .groupBy(*keys, "a", "b").agg(F.count_distinct("seq").alias("n_near")))
    sizes = points.groupBy(*keys, F.col("trail_id").alias("a")).agg(F.count("*").alias("n"))
    return near.join(sizes, [*keys, "a"]).select(*keys, "a", "b", (F.col("n_near") / F.col("n")).alias("overlap"))


def without_contained(points: DataFrame, keys=SITE, tolerance: float = 3.0, threshold: float = 0.8) -> DataFrame:
    """Ids of the trails that remain when, longest first, a trail mostly covered by a kept one
    is dropped. Overlaps are a join; the fold sees one short row per trail of a graph."""
    keys = list(keys)
    sizes = points.groupBy(*keys, "trail_id").agg(F.count("*").alias("n"))
    over = (trail_overlaps(points, keys, tolerance).filter(F.col("overlap") >= threshold)
            .groupBy(*keys, F.col("a").alias("trail_id")).agg(F.collect_set("b").alias("covers")))
    row = F.struct((-F.col("n")).alias("n"), F.col("trail_id").alias("id"),
                   F.coalesce("covers", F.array().cast("array<int>")).alias("covers"))
    ordered = sizes.join(over, [*keys, "trail_id"], "left").groupBy(*keys).agg(
        F.sort_array(F.collect_list(row)).alias("rows"))
    kept = F.aggregate("rows", F.array().cast("array<int>"), lambda acc, t: F.when(
        F.arrays_overlap(acc, t["covers"]), acc).otherwise(F.array_append(acc, t["id"])))
    return ordered.select(*keys, F.explode(kept).alias("trail_id"))


def widened(points: DataFrame, keys=SITE, width: int = 1) -> DataFrame:
    """Trail masks: the cells within `width` of a trail's path."""
    return spread(points.select(*keys, "trail_id", *CELL), disk(width)).distinct()


def merged_edges(points: DataFrame, keys=SITE) -> DataFrame:
    """Distinct steps between consecutive cells of all trails, as one undirected graph.
    The next cell is found by its number in the trail, so this is an equi-join."""
    keys = list(keys)
    node = (F.col("y_bin") * NX + F.col("x_bin")).cast("int")
    p = points.select(*keys, "trail_id", "seq", node.alias("node"))
    nxt = p.select(*keys, "trail_id", (F.col("seq") - 1).alias("seq"), F.col("node").alias("other"))
    return p.join(nxt, [*keys, "trail_id", "seq"]).select(
        *keys, F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def cell_labels(masks: DataFrame, keys=SITE) -> DataFrame:
    """One trail per cell, the last one where several overlap."""
    return masks.groupBy(*keys, *CELL).agg(F.max("trail_id").alias("trail_id"))


def trail_activity(speed_rows: DataFrame, masks: DataFrame, keys=SITE,
                   directions=("away", "toward")) -> DataFrame:
    """Rows in trail cells per frame (raw) and per frame and trail cell (density), for every
    trail, day, hour and direction; 0 for slots without rows.

    Rows are counted per cell before they meet the trails, whose table is small.
    """
    keys = list(keys)
    slot = list(dict.fromkeys([*keys, "day", "hour", "direction"]))
    rows = speed_rows.filter(F.col("direction").isin(*directions))
    cells = in_grid(binned(rows)).groupBy(*slot, *CELL).agg(F.count("*").alias("n"))
    masks = masks.select(*keys, "trail_id", *CELL)
    on_trail = cells.join(masks, [*keys, *CELL]).groupBy(*slot, "trail_id").agg(F.sum("n").alias("n"))
    raw = on_trail.join(frames_per_group(rows, slot), slot).withColumn("raw", F.col("n") / F.col("n_frames"))
    sizes = masks.groupBy(*keys, "trail_id").agg(F.count("*").alias("n_cells"))
    days = speed_rows.select(*dict.fromkeys([*keys, "day"])).distinct()
    spine = (days.join(sizes, keys)
             .withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
             .withColumn("direction", F.explode(F.array(*[F.lit(d) for d in directions]))))
    full = spine.join(raw.select(*slot, "trail_id", "raw"), [*slot, "trail_id"], "left").withColumn(
        "raw", F.coalesce("raw", F.lit(0.0)))
    return full.withColumn("density", F.col("raw") / F.col("n_cells")).drop("n_cells")


def paired_activity(activity: DataFrame, value: str = "density", keys=SITE) -> DataFrame:
    """Away and toward side by side, with their difference and bias ratio (0 without rows)."""
    by = list(dict.fromkeys([*keys, "trail_id", "day", "hour"]))
    p = by_direction(activity, F.sum(value), by, missing=0.0)
    total = F.col("away") + F.col("toward")
    diff = F.col("away") - F.col("toward")
    return p.withColumn("diff", diff).withColumn("bias", F.when(total > 0, diff / total).otherwise(0.0))


def hour_axis(rows: DataFrame, first_day) -> DataFrame:
    """Running hour since the first day."""
    return rows.withColumn("t", F.datediff("day", F.lit(first_day)) * 24 + F.col("hour"))


def daily_means(activity: DataFrame, value: str = "density", keys=SITE) -> DataFrame:
    """Mean over the 24 hours of a day."""
    return activity.groupBy(*keys, "trail_id", "direction", "day").agg(F.avg(value).alias(value))
