"""Readers: track, detection and annotation files, clip folders and their metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from trackframe import schemas
from trackframe.functions import names

FILE_PATH = "_metadata.file_path"


def _csv(spark: SparkSession, path, schema: str) -> DataFrame:
    return (spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).csv(path)
            .withColumn("file_path", F.col(FILE_PATH)))


def _video(df: DataFrame, pattern: str) -> DataFrame:
    return df.withColumn("video_id", F.regexp_extract("file_path", pattern, 1)).drop("file_path")


def read_tracks(spark: SparkSession, path, clip_pattern: str = names.CLIP_FOLDER) -> DataFrame:
    """Track files; the clip is the part of the path that matches the pattern."""
    return _video(_csv(spark, path, schemas.TRACKS), clip_pattern).withColumn("ant_id", F.col("ant_id").cast("bigint"))


def read_detections(spark: SparkSession, path, clip_pattern: str = names.CLIP_FOLDER,
                    detector_pattern: str = r"_([a-z]+)_detections") -> DataFrame:
    """Detection files of any detector, which is named in the file name."""
    d = _csv(spark, path, schemas.DETECTIONS).withColumn(
        "detector", F.regexp_extract("file_path", detector_pattern, 1))
    return _video(d, clip_pattern)


def read_clip_metadata(spark: SparkSession, path) -> DataFrame:
    """Temperature, humidity and light of each clip, one JSON document per clip folder."""
    return (spark.read.schema(schemas.CLIP_METADATA).option("multiLine", True)
            .option("recursiveFileLookup", True).json(path)
            .select(F.regexp_extract(F.col(FILE_PATH), names.CLIP_FOLDER, 1).alias("clip"),
                    "temperature", "humidity", F.col("light.lux").alias("lux")))


def list_files(spark: SparkSession, path, pattern: str) -> DataFrame:
    """Paths of files by name pattern. Only the path is selected, so no content is read."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", pattern)
            .option("recursiveFileLookup", True).load(path).select("path"))


def clip_registry(clip_files: DataFrame, metadata: DataFrame, site_id: int) -> DataFrame:
    """One Videos row per clip file whose folder has metadata; others are skipped."""
    clips = clip_files.select(F.col("path").alias("video_id"), names.clip_time(F.col("path")).alias("time_stamp"),
                              F.regexp_extract("path", names.CLIP_FOLDER, 1).alias("clip"))
    return clips.join(metadata, "clip").select(
        "video_id", F.lit(site_id).alias("site_id"), "time_stamp", F.col("temperature").cast("float").alias("temperature"),
        F.col("humidity").cast("float").alias("humidity"), F.col("lux").cast("float").alias("LUX"))


POINT = "array<struct<_points:string,_occluded:string,_outside:string,_frame:string>>"


def _xy(points) -> list:
    parts = F.split(points, ",")
    return [parts[i].cast("double").cast("int").alias(n) for i, n in enumerate(("x", "y"))]


def read_point_images(spark: SparkSession, path, folder: str = "") -> DataFrame:
    """Annotated points per image, occluded ones left out, coordinates cut to integers."""
    schema = f"_id string, _name string, points {POINT}"
    images = spark.read.format("xml").schema(schema).option("rowTag", "image").load(path)
    p = images.select(F.concat(F.lit(folder), F.col("_name")).alias("image"), F.posexplode("points").alias("seq", "p"))
    return p.filter(F.coalesce("p._occluded", F.lit("0")) != "1").select("image", "seq", *_xy(F.col("p._points")))


def read_point_tracks(spark: SparkSession, path) -> DataFrame:
    """Annotated points per track and frame, points outside the frame left out."""
    schema = f"_id string, points {POINT}"
    tracks = spark.read.format("xml").schema(schema).option("rowTag", "track").load(path)
    p = tracks.select(F.col("_id").cast("int").alias("ant_id"), F.explode("points").alias("p"))
    return p.filter(F.coalesce("p._outside", F.lit("0")) != "1").select(
        F.col("p._frame").cast("int").alias("frame_number"), "ant_id", *_xy(F.col("p._points")))


def read_behaviour_labels(spark: SparkSession, path, header: bool = True) -> DataFrame:
    """Behaviour annotations; malformed lines are kept aside in `bad_line`."""
    schema = schemas.BEHAVIOUR_LABELS + ", bad_line string"
    return (spark.read.schema(schema).option("header", header).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "bad_line").csv(path))


def read_id_list(spark: SparkSession, path) -> DataFrame:
    """Lines `ant_id,nest_proximity` without header; lines that are neither are dropped."""
    lines = spark.read.text(path).select(F.split(F.trim("value"), ",").alias("f"))
    two = lines.filter(F.size("f") == 2).select(
        F.expr("try_cast(f[0] as double)").alias("id"), F.expr("try_cast(f[1] as double)").alias("nest_proximity"))
    return two.dropna().select(F.col("id").cast("bigint").alias("ant_id"), "nest_proximity")
