"""Spatial grids of movement: flow, flux, density and their similarity. Grids stay sparse."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from trackframe.functions import geometry as g
from trackframe.functions.ordering import exact_percentile
from trackframe.operators.activity import SLOT
from trackframe.operators.kinematics import centred
from trackframe.schemas import FRAME_HEIGHT, FRAME_WIDTH
from trackframe.session import cut_lineage

CELL = ("x_bin", "y_bin")


def binned(rows: DataFrame, size: int = 20) -> DataFrame:
    """Grid cell of each centre, right-closed; null outside the frame."""
    return rows.withColumns({
        "x_bin": g.cell_right_closed("center_x", size, FRAME_WIDTH),
        "y_bin": g.cell_right_closed("center_y", size, FRAME_HEIGHT)})


def in_grid(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("x_bin").isNotNull() & F.col("y_bin").isNotNull())


def cell_centre(index: str, size: int = 20) -> Column:
    return F.col(index) * size + size / 2


def _angle(compat: bool) -> Column:
    return F.col("heading_deg") if compat else F.radians("heading_deg")


def frames_per_group(rows: DataFrame, by) -> DataFrame:
    """Distinct frames per group, through one row per frame."""
    frames = rows.groupBy(*dict.fromkeys([*by, "video_id", "frame_number"])).agg(F.count("*").alias("n"))
    return frames.groupBy(*by).agg(F.count("*").alias("n_frames"))


def flow_field(speed_rows: DataFrame, by=(*SLOT, "direction"), size: int = 20,
               compat: bool = False) -> DataFrame:
    """Mean speed and circular mean heading of moving individuals per cell."""
    m = in_grid(binned(speed_rows.filter(F.col("velocity") > 0), size))
    a = _angle(compat)
    return m.groupBy(*by, *CELL).agg(
        F.avg("velocity").alias("velocity"),
        F.atan2(F.avg(F.sin(a)), F.avg(F.cos(a))).alias("mean_angle"),
        F.count("*").alias("n_rows"))


def flux_field(speed_rows: DataFrame, by=(*SLOT, "direction"), size: int = 20,
               compat: bool = False) -> DataFrame:
    """(rows per frame in the cell) x (mean velocity vector) per cell of moving individuals.

    Headings are degrees; `compat` feeds them to sin/cos unconverted, as older results did.
    """
    m = binned(speed_rows.filter(F.col("velocity") > 0), size)
    a = _angle(compat)
    cells = in_grid(m).groupBy(*by, *CELL).agg(
        F.count("*").alias("n_rows"),
        F.avg(F.cos(a) * F.col("velocity")).alias("mean_u"),
        F.avg(F.sin(a) * F.col("velocity")).alias("mean_v"))
    rate = F.col("n_rows") / F.col("n_frames")
    return (cells.join(frames_per_group(m, by), list(by))
            .withColumns({"rows_per_frame": rate, "u": rate * F.col("mean_u"), "v": rate * F.col("mean_v")})
            .withColumns({"flux_mag": F.sqrt(F.col("u") ** 2 + F.col("v") ** 2),
                          "flux_angle": F.atan2("v", "u"),
                          "x_center": cell_centre("x_bin", size), "y_center": cell_centre("y_bin", size)})
            .drop("mean_u", "mean_v", "n_frames"))


def upper_cap(cells: DataFrame, value: str, by, share: float = 0.95) -> DataFrame:
    """Percentile of the non-zero values of a group as top of its colour scale; 1 without any.
    A group may be a whole day or all slots, so the percentile is the one for large groups."""
    top = exact_percentile(cells.filter(F.col(value) > 0), by, value, share, out="cap")
    if not by:
        return top.agg(F.coalesce(F.max("cap"), F.lit(1.0)).alias("cap"))
    return (cells.select(*by).distinct().join(top, list(by), "left")
            .withColumn("cap", F.coalesce("cap", F.lit(1.0))))


def cumulative_flux(flux: DataFrame, by=("site_id", "day"), directions=("away", "toward")) -> DataFrame:
    """Sum of flux magnitude per cell over the hours and directions of each group."""
    return (flux.filter(F.col("direction").isin(*directions))
            .groupBy(*by, *CELL).agg(F.sum("flux_mag").alias("flux_mag")))


def flux_shares(flux: DataFrame, by=(*SLOT, "direction"), value: str = "flux_mag") -> DataFrame:
    """Flux vector of a slot scaled to sum 1, with its place in the dense cell order.
    A slot has at most one row per grid cell, so the window holds at most the grid."""
    total = F.sum(value).over(Window.partitionBy(*by))
    ny, nx = FRAME_HEIGHT // 20, FRAME_WIDTH // 20
    return flux.select(
        *by, *CELL, (F.col("x_bin") * ny + F.col("y_bin")).alias("x_major"),
        (F.col("y_bin") * nx + F.col("x_bin")).alias("y_major"),
        F.when(total > 0, F.col(value) / total).otherwise(F.col(value)).alias("share"))


def similarity(left: DataFrame, right: DataFrame, group, ident: str, value: str,
               metric: str = "cosine", n_cells: int = 96 * 54) -> DataFrame:
    """Similarity of every vector of `left` to every vector of `right` inside a group.

    Vectors are sparse: dot products come from an equi-join on the cell, norms and sums from
    one aggregate each. A group has few vectors (hours of a day, days of a bout); the result
    is their matrix. Vectors without mass give null.
    """
    group = list(group)
    same = left is right
    columns = [*group, ident, *CELL, value]
    left = cut_lineage(left.select(*columns))  # cell sums, read for products, norms and sums
    right = left if same else cut_lineage(right.select(*columns))

    def side(df, tag):
        v = df.select(*group, F.col(ident).alias(tag), *CELL, F.col(value).alias(f"v{tag}"))
        s = v.groupBy(*group, tag).agg(
            F.sum(f"v{tag}").alias(f"s{tag}"), F.sum(F.col(f"v{tag}") ** 2).alias(f"q{tag}"))
        return v, s

    lv, ls = side(left, "i")
    rv, rs = side(right, "j")
    dots = (lv.join(rv, [*group, *CELL]).groupBy(*group, "i", "j")
            .agg(F.sum(F.col("vi") * F.col("vj")).alias("dot")))
    pairs = ls.join(rs, group).join(dots, [*group, "i", "j"], "left").withColumn(
        "dot", F.coalesce("dot", F.lit(0.0)))
    return pairs.select(*group, "i", "j", _likeness(metric, n_cells).alias("similarity"))


def _likeness(metric: str, n_cells: int) -> Column:
    """Similarity from dot, sums si and sj, and squared norms qi and qj; null for vectors without mass."""
    n = float(n_cells)
    some = (F.col("si") > 0) & (F.col("sj") > 0)
    if metric == "cosine":
        sim = F.try_divide("dot", F.sqrt(F.col("qi") * F.col("qj")))
    elif metric == "correlation":
        cov = F.col("dot") - F.col("si") * F.col("sj") / n
        sim = F.try_divide(cov, F.sqrt((F.col("qi") - F.col("si") ** 2 / n) * (F.col("qj") - F.col("sj") ** 2 / n)))
    elif metric == "euclidean":
        sim = -F.sqrt(F.greatest(F.col("qi") + F.col("qj") - 2 * F.col("dot"), F.lit(0.0)))
    else:
        raise ValueError(f"unknown metric {metric}")
    return F.when(some, sim)


DAY_BLOCK = 32      # days of a tile
CELL_RANGE = 512    # cells of a tile


def _tile_products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Dot products of every day of one tile with every day of the other, over the cells of their range."""
    for batch in batches:
        key, left, right = batch.columns
        which, i, j, dots = [], [], [], []
        for k, a, b in zip(key.to_pylist(), left, right):
            sides = []
            for side in (a.values, b.values):
                days, row = np.unique(side.field("day").to_numpy(zero_copy_only=False), return_inverse=True)
                dense = np.zeros((len(days), CELL_RANGE))
                np.add.at(dense, (row, side.field("at").to_numpy(zero_copy_only=False)), side.field("v").to_numpy(zero_copy_only=False))
                sides.append((days, dense))
            (p, x), (q, y) = sides
            which += [k] * (len(p) * len(q))
            i.append(np.repeat(p, len(q)))
            j.append(np.tile(q, len(p)))
            dots.append((x @ y.T).ravel())
        if which:
            yield pa.RecordBatch.from_arrays(
                [pa.array(which, key.type), *(pa.array(np.concatenate(c)) for c in (i, j, dots))], ["key", "i", "j", "dot"])


def day_similarity(vectors: DataFrame, group, value: str, day: str = "day", metric: str = "cosine",
                   n_cells: int = 96 * 54) -> DataFrame:
    """Similarity of every day of a group to every other, for any number of days: columns i and j are days.

    The matrix of days by cells is cut into tiles of DAY_BLOCK days and CELL_RANGE cells. A task multiplies one
    pair of tiles of the same cells; products are added over the cell ranges, and norms join at the end. A tile
    is one row of bounded size, sent once to each block of days that it meets. Days without mass give null.
    """
    group = list(group)
    ny = FRAME_HEIGHT // 20
    cell = F.col("x_bin") * F.lit(ny) + F.col("y_bin")
    number = F.unix_date(day).cast("long")
    rows = cut_lineage(vectors.select(  # cell sums, read for tiles and norms
        F.struct(*group).alias("key"), number.alias("day"), F.floor(number / F.lit(DAY_BLOCK)).alias("block"),
        F.floor(cell / F.lit(CELL_RANGE)).alias("cells"), F.pmod(cell, F.lit(CELL_RANGE)).cast("long").alias("at"),
        F.col(value).cast("double").alias("v")))
    tiles = rows.groupBy("key", "block", "cells").agg(F.collect_list(F.struct("day", "at", "v")).alias("tile"))
    others = rows.select("key", "block").distinct().groupBy("key").agg(F.collect_list("block").alias("others"))
    # products are symmetric: only blocks up to the other one are multiplied
    sent = tiles.join(others, "key").withColumn("other", F.explode(F.filter("others", lambda b: b >= F.col("block"))))
    met = sent.select("key", "cells", "other", F.col("tile").alias("left")).join(
        tiles.select("key", "cells", F.col("block").alias("other"), F.col("tile").alias("right")), ["key", "cells", "other"])
    key_type = rows.schema["key"].dataType.simpleString()
    dots = (met.select("key", "left", "right").mapInArrow(_tile_products, f"key {key_type}, i long, j long, dot double")
            .filter("i <= j").groupBy("key", "i", "j").agg(F.sum("dot").alias("dot")))
    both = dots.unionByName(dots.filter("i < j").select("key", F.col("j").alias("i"), F.col("i").alias("j"), "dot"))
    sums = rows.groupBy("key", "block", "day").agg(F.sum("v").alias("s"), F.sum(F.col("v") ** 2).alias("q"))
    left = sums.join(others, "key").select(
        "key", F.explode("others").alias("block"), F.col("day").alias("i"), F.col("s").alias("si"), F.col("q").alias("qi"))
    right = sums.select("key", "block", F.col("day").alias("j"), F.col("s").alias("sj"), F.col("q").alias("qj"))
    pairs = left.join(right, ["key", "block"]).join(both, ["key", "i", "j"], "left").withColumn("dot", F.coalesce("dot", F.lit(0.0)))
    return pairs.select("key.*", *[F.date_from_unix_date(F.col(c).cast("int")).alias(c) for c in "ij"],
                        _likeness(metric, n_cells).alias("similarity"))


def full_matrix(matrix: DataFrame, group, n: int, value: str, missing: float | None = None) -> DataFrame:
    """All n x n entries of each group's matrix, null (or `missing`) where there was none."""
    axis = F.sequence(F.lit(0), F.lit(n - 1))
    grid = (matrix.select(*group).distinct().withColumn("i", F.explode(axis))
            .withColumn("j", F.explode(axis)))
    out = grid.join(matrix, [*group, "i", "j"], "left")
    return out if missing is None else out.fillna(missing, subset=[value])


def off_diagonal_summary(matrix: DataFrame, group, value: str = "similarity") -> DataFrame:
    off = matrix.filter(F.col("i") != F.col("j"))
    return off.groupBy(*group).agg(
        F.min(value).alias("lowest"), F.percentile(value, F.lit(0.5)).alias("median"),
        F.max(value).alias("highest"), F.avg(value).alias("average"))


def density_cells(tracks: DataFrame, direction: str = "toward", size: int = 5,
                  by=("video_id",)) -> DataFrame:
    """Rows per left-closed cell of (x, -y). The last edge is one step short of the frame."""
    nx, ny = FRAME_WIDTH // size - 1, FRAME_HEIGHT // size - 1
    c = centred(tracks.filter(F.col("direction") == direction)).withColumns({
        "x_bin": g.cell_left_closed("center_x", size, 0, nx),
        "y_bin": g.cell_left_closed(-F.col("center_y"), size, -FRAME_HEIGHT, ny)})
    return in_grid(c).groupBy(*by, *CELL).agg(F.count("*").alias("n_rows"))


def density_thresholds(cells: DataFrame, by=("video_id",)) -> DataFrame:
    """Mean + 3 population deviations over the cells with more than one row."""
    busy = cells.filter(F.col("n_rows") > 1)
    return busy.groupBy(*by).agg(
        (F.avg("n_rows") + 3 * F.stddev_pop("n_rows")).alias("threshold"))


def shared_density_limit(thresholds: DataFrame) -> DataFrame:
    """One upper limit for all clips: the mean threshold, rounded up."""
    return thresholds.agg(F.ceil(F.avg("threshold")).alias("limit"))
