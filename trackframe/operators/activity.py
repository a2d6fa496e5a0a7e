"""Counts, rates and speeds per clip, frame and slot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trackframe.functions import geometry as g
from trackframe.operators.kinematics import centred
from trackframe.schemas import DIRECTIONS

SLOT = ("site_id", "day", "hour")
FRAME = ("video_id", "frame_number")


def in_slots(df: DataFrame, site: int | None = None, first_day: str | None = None,
             n_days: int | None = None, hour: int | None = None) -> DataFrame:
    """Rows of a site, a run of days (to the last one for None) and an hour; partition columns,
    so files are pruned."""
    if site is not None:
        df = df.filter(F.col("site_id") == site)
    if first_day is not None:
        start = F.to_date(F.lit(first_day))
        df = df.filter(F.col("day") >= start)
        if n_days is not None:
            df = df.filter(F.col("day") < F.date_add(start, n_days))
    if hour is not None:
        df = df.filter(F.col("hour") == hour)
    return df


def in_bouts(rows: DataFrame, bouts: DataFrame) -> DataFrame:
    """Rows of recorded bouts, with `bout`, the first day of theirs. bouts has site_id, start_day
    and n_days; a day that two bouts of a site share counts in both, other days drop out."""
    days = bouts.select("site_id", F.col("start_day").alias("bout"), F.explode(
        F.sequence("start_day", F.date_add("start_day", F.col("n_days") - 1))).alias("day"))
    return rows.join(days, ["site_id", "day"])


def moving(df: DataFrame, direction: str | None) -> DataFrame:
    """Rows of one direction, all rows for None."""
    return df if direction is None else df.filter(F.col("direction") == direction)


def direction_rates(tracks: DataFrame, by=SLOT) -> DataFrame:
    """Rows of each direction and of all, divided by the distinct frames of the whole clip.

    Rows are first counted per frame, so a hot clip is spread over its frames and the second
    grouping only sees one row per frame.
    """
    counts = [F.count_if(F.col("direction") == d).alias(f"n_{d}") for d in DIRECTIONS]
    frames = tracks.groupBy(*dict.fromkeys([*by, *FRAME])).agg(*counts, F.count("*").alias("n_rows"))
    totals = [F.sum(f"n_{d}").alias(f"n_{d}") for d in DIRECTIONS]
    out = frames.groupBy(*by).agg(*totals, F.sum("n_rows").alias("n_rows"), F.count("*").alias("n_frames"))
    return out.select(
        *by, "n_frames", *[(F.col(f"n_{d}") / F.col("n_frames")).alias(d) for d in DIRECTIONS],
        (F.col("n_rows") / F.col("n_frames")).alias("total"))


def speed_means(speed_rows: DataFrame, by=SLOT) -> DataFrame:
    """Mean speed of each direction and of all rows, first rows (speed 0) included; 0 if none."""
    one = [F.coalesce(F.avg(F.when(F.col("direction") == d, F.col("velocity"))), F.lit(0.0)).alias(d)
           for d in DIRECTIONS]
    return speed_rows.groupBy(*by).agg(*one, F.avg("velocity").alias("total"))


def by_direction(df: DataFrame, value: Column, by=SLOT, directions=("away", "toward"),
                 missing: float | None = None) -> DataFrame:
    """One column per direction of a grouped value: a conditional aggregate instead of a join."""
    out = df.groupBy(*by).pivot("direction", list(directions)).agg(value)
    return out if missing is None else out.fillna(missing, subset=list(directions))


def direction_difference(rates: DataFrame, by=("site_id", "hour")) -> DataFrame:
    """Away minus toward per slot, averaged over the slots of each group."""
    d = rates.withColumn("difference", F.col("away") - F.col("toward"))
    return d.groupBy(*by).agg(F.avg("difference").alias("difference"), F.count("*").alias("n_slots"))


def individuals_per_frame(tracks: DataFrame) -> DataFrame:
    return tracks.groupBy(*FRAME).agg(F.count_distinct("ant_id").alias("n_ants"))


def counts_on_frames(frames: DataFrame, counts: DataFrame, value: str, keys=FRAME) -> DataFrame:
    """Counts on every wanted frame, 0 where there is none."""
    return frames.join(counts, list(keys), "left").withColumn(value, F.coalesce(F.col(value), F.lit(0)))


def encounters(tracks: DataFrame, threshold: float = 10.0, group=(*FRAME, "direction")) -> DataFrame:
    """Pairs of individuals closer than threshold (and not at the same point) per group.

    Positions are combined with their multiplicity first; a frame has a limited number of
    pixel positions, so even a crowded cell meets a limited number of neighbours. Cells of
    threshold size with half of the neighbourhood give each pair once.
    """
    group = list(group)
    pos = (centred(tracks).groupBy(*group, "center_x", "center_y").agg(F.count("*").alias("n"))
           .withColumns({"gx": F.floor(F.col("center_x") / F.lit(float(threshold))),
                         "gy": F.floor(F.col("center_y") / F.lit(float(threshold)))}))
    half = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"))
                     for dx, dy in ((0, 0), (1, 0), (-1, 1), (0, 1), (1, 1))])
    a = pos.withColumn("o", F.explode(half)).select(
        *group, (F.col("gx") + F.col("o.dx")).alias("gx"), (F.col("gy") + F.col("o.dy")).alias("gy"),
        ((F.col("o.dx") == 0) & (F.col("o.dy") == 0)).alias("own"),
        F.col("center_x").alias("ax"), F.col("center_y").alias("ay"), F.col("n").alias("an"))
    b = pos.select(*group, "gx", "gy", F.col("center_x").alias("bx"), F.col("center_y").alias("by"),
                   F.col("n").alias("bn"))
    once = (~F.col("own")) | (F.struct("ax", "ay") < F.struct("bx", "by"))
    d = g.distance("ax", "ay", "bx", "by")
    near = a.join(b, [*group, "gx", "gy"]).filter(once & (d > 0) & (d < threshold))
    return near.groupBy(*group).agg(F.sum(F.col("an") * F.col("bn")).alias("n_encounters"))


def encounter_rates(tracks: DataFrame, threshold: float = 5.0, by=SLOT, compat: bool = False) -> DataFrame:
    """Encounters of each direction divided by the distinct frames of that direction.

    With compat the rows without direction are divided by the frames of `toward`.
    """
    group = list(dict.fromkeys([*by, *FRAME, "direction"]))
    met = encounters(tracks, threshold, group)
    frames = tracks.groupBy(*group).agg(F.lit(1).alias("one"))
    per = (frames.join(met, group, "left").groupBy(*by)
           .agg(*[F.sum(F.when(F.col("direction") == d, F.coalesce("n_encounters", F.lit(0)))).alias(f"e_{d}")
                  for d in DIRECTIONS],
                *[F.count_if(F.col("direction") == d).alias(f"f_{d}") for d in DIRECTIONS]))

    def rate(d):
        base = F.col("f_toward") if compat and d == "unknown" else F.col(f"f_{d}")
        return F.when(F.col(f"f_{d}") == 0, 0.0).otherwise(
            F.col(f"e_{d}") / F.when(base == 0, None).otherwise(base)).alias(d)

    return per.select(*by, *[rate(d) for d in DIRECTIONS])


def frame_count_summary(detections: DataFrame, by=("video_id",), kind: str = "is_gt") -> DataFrame:
    """Mean and population deviation of boxes per frame, ground truth next to predictions."""
    frame = detections.groupBy(*by, "frame_number").agg(
        F.count_if(F.col(kind)).alias("gt"), F.count_if(~F.col(kind)).alias("pred"))
    return frame.groupBy(*by).agg(
        F.avg("gt").alias("gt_mean"), F.stddev_pop("gt").alias("gt_std"),
        F.avg("pred").alias("pred_mean"), F.stddev_pop("pred").alias("pred_std"))


def even_frames(clips: DataFrame, n: int, first: int = 10, total: str = "n_frames",
                key: str = "video_id") -> DataFrame:
    """n frame numbers evenly spaced from `first` to the last frame, fractions dropped."""
    step = (F.col(total) - 1 - first) / F.lit(float(max(n - 1, 1)))
    i = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    return (clips.select(key, total, i.alias("i"))
            .select(key, (first + F.col("i") * step).cast("int").alias("frame_number")).distinct())


def sampled_clip_counts(detections: DataFrame, frames: DataFrame, key: str = "video_id") -> DataFrame:
    """Mean and population deviation of the boxes on the sampled frames, empty frames count 0."""
    n = detections.join(frames, [key, "frame_number"], "left_semi").groupBy(key, "frame_number").agg(
        F.count("*").alias("n"))
    full = counts_on_frames(frames, n, "n", (key, "frame_number"))
    return full.groupBy(key).agg(F.avg("n").alias("mean_count"), F.stddev_pop("n").alias("std_count"),
                                 F.count("*").alias("n_sampled"))


def hour_series(clips: DataFrame, value: str, by=("site_id", "hour")) -> DataFrame:
    """Day-ordered list of a value per hour. One value per day: the list is as long as the bout."""
    items = F.sort_array(F.collect_list(F.struct("day", value)))
    return clips.groupBy(*by).agg(F.transform(items, lambda x: x[value]).alias(f"{value}_list"))


def hourly_means(readings: DataFrame, value: str, ts: str = "ts", by=("site_id",)) -> DataFrame:
    """Mean reading per clock hour."""
    return readings.groupBy(*by, F.date_trunc("hour", F.col(ts)).alias("hour_start")).agg(
        F.avg(value).alias(value))
