"""Per-trajectory features, cleaning, smoothing and interpolation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from trackframe.functions import geometry as g
from trackframe.functions.ordering import (
    first_row, last_row, tracks_with_at_least, with_neighbours, with_position, with_previous)
from trackframe.operators.kinematics import TRACK, centred, nearest_boundary, order_of
from trackframe.schemas import FRAME_HEIGHT, FRAME_WIDTH, FRAMES_PER_SECOND


def behaviour_features(tracks: DataFrame, keys=TRACK, min_rows: int = 20,
                       block: Column | None = None) -> DataFrame:
    """Efficiency, straight distance, mean absolute change of angle and path length of each
    trajectory with at least min_rows rows."""
    t = centred(tracks)
    t = with_previous(t, keys, order_of(t), ["center_x", "center_y", "angle"], block)
    turn = F.abs(F.col("angle") - F.col("prev.angle"))
    here, order = ("center_x", "center_y"), order_of(t)
    f = (t.filter(F.col("track_rows") >= min_rows).groupBy(*keys).agg(
        F.count("*").alias("trajectory_length"),
        first_row(here, order).alias("s"), last_row(here, order).alias("e"),
        F.sum(g.distance("center_x", "center_y", "prev.center_x", "prev.center_y")).alias("total_length"),
        F.avg(F.least(turn, 360 - turn)).alias("avg_angle_change"))
        .withColumn("straight_distance", g.distance("s.center_x", "s.center_y", "e.center_x", "e.center_y")))
    return f.select(*keys, "trajectory_length",
                    (F.col("straight_distance") / (F.col("total_length") + 1e-6)).alias("efficiency"),
                    "straight_distance", "avg_angle_change", "total_length")


SECTORS = 9  # eight sectors of 45 degrees; a heading of exactly 180 degrees has its own


def extended_features(tracks: DataFrame, keys=TRACK, min_rows: int = 5, loop: float = 50.0,
                      fps: int = FRAMES_PER_SECOND, block: Column | None = None) -> DataFrame:
    """Shape, speed, turning, heading entropy, pauses, acceleration and spread per trajectory."""
    t = centred(tracks)
    t = with_previous(t, keys, order_of(t), ["center_x", "center_y", "frame_number"], block)
    dx, dy = F.col("center_x") - F.col("prev.center_x"), F.col("center_y") - F.col("prev.center_y")
    t = t.filter(F.col("track_rows") >= min_rows).withColumns(
        {"dx": dx, "dy": dy, "df": F.col("frame_number") - F.col("prev.frame_number")}).drop("prev")
    step = F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2)
    t = t.withColumns({"step": step, "heading": F.atan2("dy", "dx"),
                       "speed": step / (F.col("df") + 1e-6) * fps})
    t = with_previous(t, keys, order_of(t), ["dx", "dy", "step", "heading", "speed"], block, rows_out="_rows")
    turn = F.abs(F.col("heading") - F.col("prev.heading"))
    folded = F.least(turn, 2 * math.pi - turn)
    unit = (F.col("step") + 1e-6) * (F.col("prev.step") + 1e-6)
    along = (F.col("dx") * F.col("prev.dx") + F.col("dy") * F.col("prev.dy")) / unit
    gain = F.col("speed") - F.col("prev.speed")
    sector = F.floor((F.col("heading") + math.pi) / (math.pi / 4)) + 1
    here, order = ("center_x", "center_y"), order_of(t)
    f = t.groupBy(*keys).agg(
        F.count("*").alias("duration"), first_row(here, order).alias("s"), last_row(here, order).alias("e"),
        F.sum("step").alias("total_length"), F.avg(folded).alias("avg_curvature"), F.max(folded).alias("max_curvature"),
        F.avg("speed").alias("avg_speed"), F.stddev_pop("speed").alias("speed_std"), F.max("speed").alias("max_speed"),
        F.avg(along).alias("direction_consistency"),
        ((F.max("center_x") - F.min("center_x")) * (F.max("center_y") - F.min("center_y"))).alias("bbox_area"),
        F.count_if(turn > math.pi / 4).alias("direction_changes"),
        F.avg((F.col("speed") < 1.0).cast("double")).alias("pause_ratio"),
        F.avg(F.abs(gain)).alias("avg_acceleration"), F.stddev_pop(gain).alias("acceleration_std"),
        F.stddev_pop("center_x").alias("spatial_std_x"), F.stddev_pop("center_y").alias("spatial_std_y"),
        F.array(*[F.count_if(sector == k) for k in range(1, SECTORS + 1)]).alias("sectors"))
    straight = g.distance("s.center_x", "s.center_y", "e.center_x", "e.center_y")
    steps = (F.col("duration") - 1).cast("double")
    entropy = F.aggregate(
        F.filter("sectors", lambda n: n > 0), F.lit(0.0), lambda acc, n: acc - n / steps * F.ln(n / steps))
    return f.withColumns({
        "efficiency": straight / (F.col("total_length") + 1e-6),
        "is_loop": (straight < loop).cast("double"),
        "start_x_norm": F.col("s.center_x") / FRAME_WIDTH, "start_y_norm": F.col("s.center_y") / FRAME_HEIGHT,
        "end_x_norm": F.col("e.center_x") / FRAME_WIDTH, "end_y_norm": F.col("e.center_y") / FRAME_HEIGHT,
        "direction_entropy": entropy}).drop("s", "e", "sectors")


def box_scales(largest: float = 50.0, n: int = 5) -> list[float]:
    """n box sizes evenly spaced on a log scale from 1 to largest."""
    return [10 ** (i * math.log10(largest) / (n - 1)) for i in range(n)]


def fractal_dimensions(tracks: DataFrame, keys=TRACK, min_rows: int = 10) -> DataFrame:
    """Box-counting dimension of each trajectory, held between 1 and 2; 1 for short ones."""
    keys = list(keys)
    t = centred(tracks).select(*keys, "center_x", "center_y")
    frame = t.groupBy(*keys).agg(
        F.min("center_x").alias("x0"), F.max("center_x").alias("x9"),
        F.min("center_y").alias("y0"), F.max("center_y").alias("y9"), F.count("*").alias("n"))
    points = t.distinct().join(frame, keys)
    nx = (F.col("center_x") - F.col("x0")) / (F.col("x9") - F.col("x0") + 1e-6)
    ny = (F.col("center_y") - F.col("y0")) / (F.col("y9") - F.col("y0") + 1e-6)
    scale = F.explode(F.array(*[F.lit(s) for s in box_scales()]))
    boxes = points.select(*keys, "n", nx.alias("nx"), ny.alias("ny"), scale.alias("s")).select(
        *keys, "n", "s", F.floor(F.col("nx") / (1.0 / F.col("s"))).alias("bx"),
        F.floor(F.col("ny") / (1.0 / F.col("s"))).alias("by")).distinct()
    counts = boxes.groupBy(*keys, "n", "s").agg(F.count("*").alias("boxes"))
    slope = F.regr_slope(F.ln("boxes"), F.ln(1.0 / F.col("s")))
    fit = counts.groupBy(*keys, "n").agg(slope.alias("slope"))
    return fit.select(*keys, F.when(F.col("n") < min_rows, F.lit(1.0)).otherwise(
        g.clamp(-F.col("slope"), 1.0, 2.0)).alias("fractal_dimension"))


def return_frequencies(tracks: DataFrame, keys=TRACK, radius: float = 30.0, skip: int = 10,
                       block: Column | None = None) -> DataFrame:
    """Share of rows after the first `skip` that come within radius of an earlier row.

    Each distinct position keeps the first time it was visited; a row returns when a position
    near it was visited before. Only distinct positions are paired, in cells of radius size.
    """
    keys = list(keys)
    t = centred(tracks)
    t = with_position(t, keys, order_of(t), block).select(*keys, "center_x", "center_y", "position", "track_rows")
    first = t.groupBy(*keys, "center_x", "center_y").agg(F.min("position").alias("first")).withColumns(
        {"gx": F.floor(F.col("center_x") / radius), "gy": F.floor(F.col("center_y") / radius)})
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    a = first.withColumn("o", F.explode(around)).select(
        *keys, F.col("center_x").alias("ax"), F.col("center_y").alias("ay"),
        (F.col("gx") + F.col("o.i")).alias("gx"), (F.col("gy") + F.col("o.j")).alias("gy"))
    near = (a.join(first, [*keys, "gx", "gy"]).filter(g.distance("ax", "ay", "center_x", "center_y") < radius)
            .groupBy(*keys, F.col("ax").alias("center_x"), F.col("ay").alias("center_y"))
            .agg(F.min("first").alias("first_near")))
    rows = t.join(near, [*keys, "center_x", "center_y"])
    back = F.count_if((F.col("position") > skip) & (F.col("first_near") < F.col("position")))
    n = F.first("track_rows")
    return rows.groupBy(*keys).agg(
        F.when(n > skip, back / (n - skip)).otherwise(0.0).alias("return_frequency"))


def gaussian_weights(sigma: float = 1.0, radius: int = 4) -> list[float]:
    raw = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-radius, radius + 1)]
    return [w / sum(raw) for w in raw]


def smoothed(tracks: DataFrame, method: str = "savgol", keys=TRACK, block_rows: int = 4096,
             block: Column | None = None) -> DataFrame:
    """Smooth centres along each track.

    moving_average: mean of three rows, ends unchanged. gaussian: sigma 1 over nine rows, the
    track mirrored at its ends. savgol: a parabola through three points is exact at the
    middle one, so this (default) method returns the input.
    """
    t = tracks if "center_x" in tracks.columns else centred(tracks)
    if method == "savgol":
        return t
    radius = {"moving_average": 1, "gaussian": 4}[method]
    p = with_position(t, keys, order_of(t), block)
    p = with_neighbours(p, keys, ["center_x", "center_y"], radius, block_rows)
    helpers = [f"{c}_{s}{k}" for c in ("center_x", "center_y") for s in "mp" for k in range(1, radius + 1)]

    def value(c):
        if method == "moving_average":
            mean = (F.col(f"{c}_m1") + F.col(c) + F.col(f"{c}_p1")) / 3
            return F.coalesce(mean, F.col(c))
        around = F.array(*[F.col(f"{c}_m{k}") for k in range(radius, 0, -1)], F.col(c),
                         *[F.col(f"{c}_p{k}") for k in range(1, radius + 1)])
        n, here = F.col("track_rows"), F.col("position") - 1
        total = F.lit(0.0)
        for k, w in zip(range(-radius, radius + 1), gaussian_weights()):
            m = F.pmod(here + k, 2 * n)
            mirrored = F.when(m < n, m).otherwise(2 * n - 1 - m)
            total = total + w * F.get(around, (mirrored - here + radius).cast("int"))
        return F.when(n < 3, F.col(c)).otherwise(total)

    new = {c: value(c) for c in ("center_x", "center_y")}
    return p.withColumns(new).drop(*helpers, "position", "track_rows")


def without_outliers(tracks: DataFrame, keys=TRACK, threshold: float = 3.0, min_rows: int = 5,
                     block: Column | None = None) -> DataFrame:
    """Drop rows whose step length is more than threshold deviations off the track's mean."""
    keys = list(keys)
    t = centred(tracks)
    t = with_previous(t, keys, order_of(t), ["center_x", "center_y"], block).withColumn(
        "step", g.distance("center_x", "center_y", "prev.center_x", "prev.center_y")).drop("prev")
    stats = t.groupBy(*keys).agg(F.avg("step").alias("_m"), F.stddev_pop("step").alias("_s"))
    z = F.abs((F.col("step") - F.col("_m")) / (F.col("_s") + 1e-6))
    odd = (F.col("track_rows") >= min_rows) & F.coalesce(z > threshold, F.lit(False))
    return t.join(stats, keys).filter(~odd).drop("_m", "_s", "step", "track_rows")


def swap_repaired(tracks: DataFrame, video: str = "video_id", keys=TRACK, max_jump: float = 100.0,
                  min_rows: int = 20) -> DataFrame:
    """Give a row the id of its nearest row in the previous frame when that is another id and
    closer than max_jump. Original ids decide; only tracks with min_rows rows take part.

    Nearest is searched between distinct positions of neighbouring frames, in cells of
    max_jump size; the lowest id wins equal distances.
    """
    t = tracks_with_at_least(centred(tracks), keys, min_rows)
    cells = {"gx": F.floor(F.col("center_x") / max_jump), "gy": F.floor(F.col("center_y") / max_jump)}
    before = (t.groupBy(video, "frame_number", "center_x", "center_y").agg(F.min("ant_id").alias("prev_ant"))
              .withColumns(cells).select(
                  video, (F.col("frame_number") + 1).alias("frame_number"), "gx", "gy",
                  F.col("center_x").alias("bx"), F.col("center_y").alias("by"), "prev_ant"))
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    here = (t.select(video, "frame_number", "center_x", "center_y").distinct().withColumns(cells)
            .withColumn("o", F.explode(around))
            .withColumns({"gx": F.col("gx") + F.col("o.i"), "gy": F.col("gy") + F.col("o.j")}).drop("o"))
    d = g.distance("center_x", "center_y", "bx", "by")
    near = (here.join(before, [video, "frame_number", "gx", "gy"]).filter(d < max_jump)
            .groupBy(video, "frame_number", "center_x", "center_y")
            .agg(F.min_by("prev_ant", F.struct(d, "prev_ant")).alias("prev_ant")))
    return (t.join(near, [video, "frame_number", "center_x", "center_y"], "left")
            .withColumn("repaired_id", F.coalesce("prev_ant", "ant_id")).drop("prev_ant"))


def interpolated(tracks: DataFrame, keys=TRACK, block: Column | None = None) -> DataFrame:
    """Fill the missing frames of each track by straight lines between its boxes. Filled rows
    keep the id and have no direction."""
    keys = list(keys)
    corners = ("x1", "y1", "x2", "y2")
    t = with_previous(tracks, keys, order_of(tracks), ["frame_number", *corners], block)
    gap = F.col("frame_number") - F.col("prev.frame_number")
    fill = t.filter(gap > 1).withColumn(
        "f", F.explode(F.sequence(F.col("prev.frame_number") + 1, F.col("frame_number") - 1)))
    part = (F.col("f") - F.col("prev.frame_number")) / gap
    made = fill.select(*keys, F.col("f").alias("frame_number"), *[
        (F.col(f"prev.{c}") + (F.col(c) - F.col(f"prev.{c}")) * part).alias(c) for c in corners],
        F.lit(None).cast("string").alias("direction"), F.lit(True).alias("filled"))
    kept = tracks.select(*keys, "frame_number", *[F.col(c).cast("double").alias(c) for c in corners],
                         "direction", F.lit(False).alias("filled"))
    return kept.unionByName(made)


def frame_triplets(frames: DataFrame, video: str = "video_id", block_rows: int = 4096,
                   block: Column | None = None) -> DataFrame:
    """Each frame of a clip with the frames before and after it; the ends have none."""
    f = frames.select(video, "frame_number").distinct()
    f = with_position(f, [video], ["frame_number"], block, rows_out="_n").drop("_n")
    f = with_neighbours(f, [video], ["frame_number"], 1, block_rows)
    return f.filter(F.col("frame_number_m1").isNotNull() & F.col("frame_number_p1").isNotNull()).select(
        video, F.col("frame_number_m1").alias("before"), "frame_number", F.col("frame_number_p1").alias("after"))


def start_points(tracks: DataFrame, keys=TRACK) -> DataFrame:
    """Position of the first row of each track."""
    t = centred(tracks)
    here = first_row(("center_x", "center_y"), order_of(t))
    return t.groupBy(*keys).agg(here.alias("s"), F.count("*").alias("trajectory_length")).select(
        *keys, "trajectory_length", "s.*")


def outline(pixels: DataFrame, mask_keys=()) -> DataFrame:
    """Pixels of a region that have a neighbour outside it, numbered in reading order.
    The number is x and y in one: no sort is needed."""
    keys = list(mask_keys)
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1))])
    near = pixels.withColumn("o", F.explode(steps)).select(
        *keys, (F.col("x") + F.col("o.i")).alias("x"), (F.col("y") + F.col("o.j")).alias("y"))
    filled = near.groupBy(*keys, "x", "y").agg(F.count("*").alias("n"))
    edge = pixels.join(filled.filter(F.col("n") == 4), [*keys, "x", "y"], "left_anti")
    return edge.select(*keys, (F.col("y") * 100_000 + F.col("x")).alias("idx"),
                       F.col("x").alias("bx"), F.col("y").alias("by"))


def nest_proximity(tracks: DataFrame, nest: DataFrame | None, keys=TRACK, mask_keys=()) -> DataFrame:
    """Distance from the truncated start of each trajectory to the nearest nest pixel; infinite
    without a nest or outside the frame."""
    s = start_points(tracks, [*mask_keys, *keys])
    if nest is None:
        return s.withColumn("nest_proximity", F.lit(float("inf")))
    inside = nest.select(*mask_keys, F.col("x").alias("_x"), F.col("y").alias("_y"), F.lit(0.0).alias("_zero"))
    p = nearest_boundary(s, outline(nest, mask_keys), mask_keys=mask_keys)
    p = p.withColumns({"_x": g.truncated("center_x"), "_y": g.truncated("center_y")})
    return (p.join(inside, [*mask_keys, "_x", "_y"], "left")
            .withColumn("nest_proximity", F.coalesce("_zero", F.sqrt(F.col("near.d2").cast("double")),
                                                     F.lit(float("inf"))))
            .drop("_x", "_y", "_zero", "near"))


def baseline_deviation(samples: DataFrame, by=("video_id", "x", "y"), value: str = "value") -> DataFrame:
    """Three times the deviation of each pixel sample from its mean over the clip, as a byte."""
    by = list(by)
    mean = samples.groupBy(*by).agg(F.floor(F.avg(value)).alias("_mean"))
    return samples.join(mean, by).withColumn(
        "deviation", ((3 * F.abs(F.col(value) - F.col("_mean"))) % 256).cast("int")).drop("_mean")
