"""Row filters and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trackframe.functions import geometry as g

# Operating threshold of the detector and names of the sites.
CONFIDENCE = 0.327
SITE_NAMES = {1: "beer", 2: "shack", 3: "rain", 4: "rocks"}


def confident(detections: DataFrame, threshold: float = CONFIDENCE) -> DataFrame:
    return detections.filter(F.col("confidence") >= threshold)


def _at_pixel(boxes: DataFrame) -> DataFrame:
    return boxes.withColumns({"x": g.truncated(g.midpoint("x1", "x2")), "y": g.truncated(g.midpoint("y1", "y2"))})


def keep_on_mask(boxes: DataFrame, kept: DataFrame, mask_keys=()) -> DataFrame:
    """Boxes whose truncated centre is a kept pixel (x, y) of their mask."""
    return _at_pixel(boxes).join(kept, [*mask_keys, "x", "y"], "left_semi").drop("x", "y")


def drop_ignored(boxes: DataFrame, ignored: DataFrame, mask_keys=()) -> DataFrame:
    """The same from the (usually smaller) set of ignored pixels."""
    return _at_pixel(boxes).join(ignored, [*mask_keys, "x", "y"], "left_anti").drop("x", "y")


def frame_window(rows: DataFrame, first: int, n_frames: int, base: int = 1) -> DataFrame:
    """Rows of n_frames frames from `first` on, renumbered to start at base."""
    f = F.col("frame_number")
    return rows.filter(f.between(first, first + n_frames - 1)).withColumn("frame_number", f - first + base)


def with_ids(rows: DataFrame, ids: DataFrame, keys=("video_id", "ant_id")) -> DataFrame:
    """Rows of the listed individuals."""
    return rows.join(ids.select(*keys), list(keys), "left_semi")


def high_score_ids(scores: DataFrame, threshold: float, video=None) -> DataFrame:
    """Distinct individuals scored at or above a threshold, of one clip or of all."""
    rows = scores.filter(F.col("excavating_score") >= threshold)
    if video is not None:
        rows = rows.filter(F.col("video_id") == video)
    return rows.select("video_id", "ant_id").distinct()


def near_nest(features: DataFrame, limit: float) -> DataFrame:
    """Trajectories that start closer to the nest than limit."""
    return features.filter(F.col("nest_proximity") < limit)


def near_nest_summary(features: DataFrame, limit: float, by=("video_id",)) -> DataFrame:
    """Range of the start distances of all trajectories and of those near the nest."""
    d = F.col("nest_proximity")
    near = F.when(d < limit, d)
    return features.groupBy(*by).agg(
        F.count("*").alias("n_all"), F.min(d).alias("lowest"), F.max(d).alias("highest"),
        F.count(near).alias("n_near"), F.min(near).alias("near_lowest"), F.max(near).alias("near_highest"),
        F.avg(near).alias("near_mean"))


def site_label(site: Column) -> Column:
    """Name of a site, `unknown` when it has none. A handful of names: no join needed."""
    label = F.lit("unknown")
    for number, name in SITE_NAMES.items():
        label = F.when(site == number, F.lit(name)).otherwise(label)
    return label


def labelled_by(rows: DataFrame, labels: DataFrame, keys, label: str) -> DataFrame:
    """Label from a small table, `unknown` where it is missing."""
    return (rows.join(labels, list(keys), "left")
            .withColumn(label, F.coalesce(label, F.lit("unknown"))))


def normalised_boxes(boxes: DataFrame, smallest: int = 10, size: int = 20) -> DataFrame:
    """Drop boxes narrower or lower than `smallest`, give the others one size."""
    big = boxes.filter(((F.col("x2") - F.col("x1")) >= smallest) & ((F.col("y2") - F.col("y1")) >= smallest))
    return big.withColumn("b", g.recentred_box("x1", "y1", "x2", "y2", size)).select(
        *[c for c in boxes.columns if c not in ("x1", "y1", "x2", "y2")], "b.*")
