"""Speed, heading and direction of movement along tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from trackframe.functions import geometry as g
from trackframe.functions.ordering import over_blocks, with_position, with_previous
from trackframe.schemas import FRAMES_PER_SECOND, require_columns
from trackframe.session import cut_lineage

TRACK = ("video_id", "ant_id")
ORDER = ("frame_number", "seq")


def centred(tracks: DataFrame) -> DataFrame:
    """Add box centres."""
    require_columns(tracks, "x1", "y1", "x2", "y2")
    return tracks.withColumns({"center_x": g.midpoint("x1", "x2"), "center_y": g.midpoint("y1", "y2")})


def order_of(tracks: DataFrame) -> list[str]:
    """Row order inside a track: frame, then the source's row number where there is one."""
    return [c for c in ORDER if c in tracks.columns]


def speeds(tracks: DataFrame, keys=TRACK, fps: int = FRAMES_PER_SECOND,
           block: Column | None = None) -> DataFrame:
    """Speed (px/s) and heading (degrees) from the previous row of the same track.

    The first row of a track and rows without frame progress have speed 0; one-row tracks are
    left out. `angle` of the track row stays, the heading is a column of its own.
    """
    t = centred(tracks)
    t = with_previous(t, keys, order_of(t), ["frame_number", "center_x", "center_y"], block)
    dx, dy = F.col("center_x") - F.col("prev.center_x"), F.col("center_y") - F.col("prev.center_y")
    frames = F.col("frame_number") - F.col("prev.frame_number")
    moved = frames > 0
    return t.filter(F.col("track_rows") >= 2).withColumns({
        "velocity": F.when(moved, F.sqrt(dx * dx + dy * dy) / frames * fps).otherwise(0.0),
        "heading_deg": F.when(moved, g.heading_degrees(dx, dy)).otherwise(0.0),
    }).drop("prev")


def moving_speeds(speed_rows: DataFrame) -> DataFrame:
    """Only the non-zero speeds."""
    return speed_rows.filter(F.col("velocity") > 0)


def displacements(tracks: DataFrame, keys=TRACK, block: Column | None = None) -> DataFrame:
    """Shift of the top-left corner since the previous row, 0 on the first row."""
    t = with_previous(tracks, keys, order_of(tracks), ["x1", "y1"], block)
    return t.withColumns({
        "dx": F.coalesce(F.col("x1") - F.col("prev.x1"), F.lit(0)).cast("double"),
        "dy": F.coalesce(F.col("y1") - F.col("prev.y1"), F.lit(0)).cast("double"),
    }).withColumn("displacement", F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2)).drop("prev", "track_rows")


def nearest_candidates(boundary: DataFrame, cell: int = 40, width: int = 1920, height: int = 1080,
                       mask_keys=()) -> DataFrame:
    """Per grid cell the boundary points that can be nearest to any pixel of that cell.

    A point is kept when its smallest distance to the cell does not exceed the smallest of the
    largest distances. A boundary is the outline of one mask of one frame, hence at most
    width x height points; only this short list is compared with positions later.
    """
    keys = list(mask_keys)
    points = F.sort_array(F.collect_list(F.struct("idx", "bx", "by"))).alias("points")
    outline = boundary.groupBy(*keys).agg(points) if keys else boundary.agg(points)
    nx, ny = -(-width // cell), -(-height // cell)
    cells = outline.withColumn(
        "cell_x", F.explode(F.sequence(F.lit(0), F.lit(nx - 1)))).withColumn(
        "cell_y", F.explode(F.sequence(F.lit(0), F.lit(ny - 1))))
    lo_x, lo_y = F.col("cell_x") * cell, F.col("cell_y") * cell

    def near2(p):
        dx = F.greatest(lo_x - p["bx"], p["bx"] - (lo_x + cell), F.lit(0)).cast("long")
        dy = F.greatest(lo_y - p["by"], p["by"] - (lo_y + cell), F.lit(0)).cast("long")
        return dx * dx + dy * dy

    def far2(p):
        dx = F.greatest(F.abs(p["bx"] - lo_x), F.abs(p["bx"] - (lo_x + cell))).cast("long")
        dy = F.greatest(F.abs(p["by"] - lo_y), F.abs(p["by"] - (lo_y + cell))).cast("long")
        return dx * dx + dy * dy

    # the reach is an array element so that it is computed once per cell, not once per point
    reach = F.array(F.array_min(F.transform("points", far2)))
    near = F.transform(reach, lambda r: F.filter("points", lambda p: near2(p) <= r))[0]
    return (cells.repartition(*keys, "cell_x", "cell_y")
            .select(*keys, "cell_x", "cell_y", near.alias("near_points")))


def nearest_boundary(points: DataFrame, boundary: DataFrame, x: str = "center_x", y: str = "center_y",
                     cell: int = 40, width: int = 1920, height: int = 1080,
                     mask_keys=()) -> DataFrame:
    """Add the closest boundary point `near` (idx, bx, by) of the truncated position and its
    squared distance; the first index wins ties, null outside the frame.

    Equi-join on the grid cell with a short candidate list per cell: no pair rows are made. The
    lists are written once; they are broadcast while they have few rows (a frame has 1 296
    cells), so positions are not shuffled.
    """
    keys = list(mask_keys)
    cand = cut_lineage(nearest_candidates(boundary, cell, width, height, keys))
    px, py = g.truncated(x), g.truncated(y)
    p = points.withColumns({"_px": px, "_py": py,
                            "cell_x": F.floor(px / cell).cast("int"),
                            "cell_y": F.floor(py / cell).cast("int")})
    inside = ((F.col("_px") >= 0) & (F.col("_px") < width) & (F.col("_py") >= 0) & (F.col("_py") < height))

    def key(c):
        dx, dy = (F.col("_px") - c["bx"]).cast("long"), (F.col("_py") - c["by"]).cast("long")
        return F.struct((dx * dx + dy * dy).alias("d2"), c["idx"].alias("idx"),
                        c["bx"].alias("bx"), c["by"].alias("by"))

    best = F.when(inside, F.array_min(F.transform("near_points", key)))
    return (p.join(cand, [*keys, "cell_x", "cell_y"], "left")
            .withColumn("near", best)
            .drop("near_points", "cell_x", "cell_y", "_px", "_py"))


def movement_direction(tracks: DataFrame, boundary: DataFrame, keys=TRACK, margin: float = 20.0,
                       block: Column | None = None, mask_keys=()) -> DataFrame:
    """Away from or toward the boundary, from the angle between (boundary point -> position)
    and (previous -> current position). The first row of a track gets no direction and is left out."""
    t = tracks.drop("direction", "angle")
    t = t.withColumns({c: g.truncated(c) for c in ("x1", "y1", "x2", "y2")})
    t = centred(t)
    t = with_previous(t, keys, order_of(t), ["center_x", "center_y"], block)
    t = nearest_boundary(t.filter(F.col("prev").isNotNull()), boundary, mask_keys=mask_keys)
    angle = F.when(F.col("near").isNotNull(), g.angle_between(
        F.col("center_x") - F.col("near.bx"), F.col("center_y") - F.col("near.by"),
        F.col("center_x") - F.col("prev.center_x"), F.col("center_y") - F.col("prev.center_y")))
    return t.withColumn("angle", angle).withColumn(
        "direction",
        F.when(F.col("angle") == -1, "unknown")
        .when(F.col("angle") < 90 - margin, "away")
        .when(F.col("angle") > 90 + margin, "toward").otherwise("unknown")).drop("prev", "track_rows")


def entrance_direction(tracks: DataFrame, entrance: tuple[float, float], keys=TRACK,
                       low: float = 2.0, high: float = 20.0, block: Column | None = None) -> DataFrame:
    """Direction from the change of distance to one entrance point; steps outside
    low <= |change| < high carry no direction and are left out."""
    t = centred(tracks.drop("direction"))
    t = t.withColumn("from_entrance", g.distance("center_x", "center_y", F.lit(entrance[0]), F.lit(entrance[1])))
    t = with_previous(t, keys, order_of(t), ["from_entrance"], block)
    change = F.col("from_entrance") - F.col("prev.from_entrance")
    size = F.abs(change)
    return (t.withColumn("change", change).filter((size >= low) & (size < high))
            .withColumn("direction", F.when(F.col("change") > 0, "away").otherwise("toward"))
            .drop("prev", "track_rows"))


def recent_path(tracks: DataFrame, steps: int = 20, keys=TRACK, block: Column | None = None,
                block_rows: int = 4096) -> DataFrame:
    """Path length over the last `steps` steps up to each row."""
    t = centred(tracks)
    order = order_of(t)
    t = with_previous(t, keys, order, ["center_x", "center_y"], block, rows_out="_rows")
    t = t.withColumn("step", F.coalesce(
        g.distance("center_x", "center_y", "prev.center_x", "prev.center_y"), F.lit(0.0))).drop("prev", "_rows")
    t = with_position(t, keys, order, block, rows_out="_rows").drop("_rows")
    return over_blocks(t, keys, steps - 1, 0, lambda w: [
        F.sum("step").over(w.rowsBetween(1 - steps, 0)).alias("recent_path")], block_rows)
