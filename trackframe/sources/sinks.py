"""Writers. All write with the executors; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trackframe.functions import geometry as g
from trackframe.functions.names import clip_stem
from trackframe.operators.filters import frame_window
from trackframe.operators.kinematics import speeds


def write_speed_table(tracks: DataFrame, path: str, partitions=("site_id", "day")) -> None:
    """Speeds as parquet by site and day; only the partitions present are replaced. Rows are
    sent to their partition's files by clip, so a busy day is written by many tasks."""
    (speeds(tracks).repartition(*partitions, "video_id").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path))


def table_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(
        spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS"))


def speed_table(spark: SparkSession, tracks: DataFrame, path: str) -> DataFrame:
    """The stored speeds; computed and stored first when they are not there yet."""
    if not table_exists(spark, path):
        write_speed_table(tracks, path)
    return spark.read.parquet(path)


def gathered(df: DataFrame, *by: str) -> DataFrame:
    """Rows of a folder come together before they are written, in few files; large folders are split."""
    return df.hint("rebalance", *by)


def label_lines(boxes: DataFrame, width: int = 1920, height: int = 1080) -> DataFrame:
    """`0 xc yc w h` lines with fractions of the frame, per image."""
    u = g.unit_centre_box("x1", "y1", "x2", "y2", width, height)
    return boxes.select("image", u.alias("u")).select(
        clip_stem(F.col("image")).alias("image"), F.concat_ws(" ", F.lit("0"), "u.xc", "u.yc", "u.w", "u.h").alias("value"))


def write_label_files(boxes: DataFrame, path: str, width: int = 1920, height: int = 1080) -> None:
    gathered(label_lines(boxes, width, height), "image").write.mode("overwrite").partitionBy("image").text(path)


def centre_rows(boxes: DataFrame) -> DataFrame:
    """`images,x,y,labels` rows of box centres."""
    return boxes.select("split", F.element_at(F.split("image", "/"), -1).alias("images"),
                        g.midpoint("x1", "x2").alias("x"), g.midpoint("y1", "y2").alias("y"), F.lit(1).alias("labels"))


def write_centre_files(boxes: DataFrame, path: str) -> None:
    gathered(centre_rows(boxes), "split").write.mode("overwrite").partitionBy("split").option("header", True).csv(path)


def _mot(frame: Column, ident: str) -> list[Column]:
    box = g.corner_size("x1", "y1", "x2", "y2")
    return [frame.alias("frame"), F.col(ident).alias("id"), *[box[c].alias(c) for c in ("x", "y", "w", "h")],
            *[F.lit(-1).alias(c) for c in ("c1", "c2", "c3", "c4")]]


def mot_ground_truth(boxes: DataFrame, label: str = "video_id", ident: str = "ant_id") -> DataFrame:
    """Ground truth lines with frames from 1."""
    return boxes.select(label, *_mot(F.col("frame_number") + 1, ident))


def mot_predictions(tracks: DataFrame, first: int, n_frames: int = 30, label: str = "video_id",
                    ident: str = "ant_id") -> DataFrame:
    """Track lines of a window of frames, renumbered from 1."""
    return frame_window(tracks, first, n_frames).select(label, *_mot(F.col("frame_number"), ident))


def write_mot(lines: DataFrame, path: str, label: str = "video_id") -> None:
    gathered(lines, label).write.mode("overwrite").partitionBy(label).option("header", False).csv(path)


def trajectory_summary(rows: DataFrame) -> DataFrame:
    """One row: totals, date range, label counts and mean length."""
    sizes = rows.groupBy("cluster_label").agg(F.count("*").alias("n")).agg(
        F.sort_array(F.collect_list(F.struct("cluster_label", "n"))).alias("cluster_distribution"))
    totals = rows.agg(
        F.count("*").alias("total_trajectories"), F.count_distinct("ant_id").alias("unique_ants"),
        F.count_distinct("video_id").alias("unique_videos"),
        F.concat_ws(" to ", F.min("date").cast("string"), F.max("date").cast("string")).alias("date_range"),
        F.avg("trajectory_length").alias("avg_trajectory_length"))
    return totals.join(F.broadcast(sizes), F.lit(True))  # one row each; labels are few


def write_trajectories(rows: DataFrame, path: str) -> None:
    """Compressed CSV per cluster label and a summary document."""
    (gathered(rows, "cluster_label").write.mode("overwrite").partitionBy("cluster_label").option("header", True)
     .option("compression", "gzip").csv(f"{path}/trajectories"))
    trajectory_summary(rows).write.mode("overwrite").json(f"{path}/summary")


def write_series(series: DataFrame, path: str) -> None:
    """Per-hour series of bouts, one folder per metric and bout."""
    gathered(series, "metric", "bout_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "metric", "bout_id").parquet(path)


def read_series(spark: SparkSession, path: str, metric: str | None = None, bout: int | None = None) -> DataFrame:
    """Stored series; metric and bout select folders, so only those are read."""
    df = spark.read.parquet(path)
    if metric is not None:
        df = df.filter(F.col("metric") == metric)
    return df if bout is None else df.filter(F.col("bout_id") == bout)


def write_scores(scores: DataFrame, path: str) -> None:
    scores.write.mode("overwrite").option("header", True).csv(path)


def _points(x: str, y: str, extra: dict[str, str]) -> Column:
    fields = [F.concat_ws(",", F.col(x).cast("string"), F.col(y).cast("string")).alias("_points"), F.lit("0").alias("_occluded")]
    return F.struct(*fields, *[F.lit(v).alias(f"_{k}") for k, v in extra.items()], F.lit("0").alias("_z_order"))


def write_image_points(points: DataFrame, path: str, width: int = 1920, height: int = 1080) -> None:
    """One image element per image with its points."""
    p = _points("x", "y", {"label": "ant", "source": "manual"})
    images = points.groupBy("image").agg(F.sort_array(F.collect_list(p)).alias("points")).select(
        F.col("image").alias("_name"), F.lit(str(width)).alias("_width"), F.lit(str(height)).alias("_height"), "points")
    (images.write.mode("overwrite").format("xml").option("rootTag", "annotations").option("rowTag", "image").save(path))


def write_seed_tracks(points: DataFrame, path: str) -> None:
    """One track element per point, on frame 0."""
    p = _points("x", "y", {"frame": "0", "keyframe": "1", "outside": "0"})
    tracks = points.select(F.col("ant_id").cast("string").alias("_id"), F.lit("ant").alias("_label"),
                           F.lit("blob").alias("_source"), F.array(p).alias("points"))
    (tracks.write.mode("overwrite").format("xml").option("rootTag", "annotations").option("rowTag", "track").save(path))
