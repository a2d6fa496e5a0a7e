"""Sites, Videos and Counts as parquet tables with key checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from trackframe import schemas

TABLES = {"sites": schemas.SITES, "videos": schemas.VIDEOS, "counts": schemas.COUNTS}
PRIMARY_KEY = {"sites": "site_id", "videos": "video_id", "counts": "video_id"}
FOREIGN_KEY = {"videos": ("site_id", "sites"), "counts": ("video_id", "videos")}


def create_tables(spark: SparkSession, base: str) -> None:
    """Empty tables below a folder; existing ones stay."""
    for name, ddl in TABLES.items():
        spark.createDataFrame([], ddl).write.mode("ignore").parquet(f"{base}/{name}")


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{base}/{name}")


def with_all_columns(rows: DataFrame, name: str) -> DataFrame:
    """Rows in the table's column order and types, missing columns null."""
    out = []
    for part in TABLES[name].split(", "):
        column, kind = part.split(" ")
        out.append((F.col(column) if column in rows.columns else F.lit(None)).cast(kind).alias(column))
    return rows.select(*out)


def accepted(new: DataFrame, existing: DataFrame, key: str, parents: DataFrame | None = None,
             parent_key: str | None = None) -> DataFrame:
    """Rows whose key is new (the first of equal keys) and whose parent exists."""
    rows = new.dropDuplicates([key]).join(existing.select(key), key, "left_anti")
    if parents is not None:
        rows = rows.join(parents.select(parent_key), parent_key, "left_semi")
    return rows


def insert(spark: SparkSession, base: str, name: str, rows: DataFrame) -> None:
    """Append rows that keep the primary and the foreign key; others are left out."""
    rows = with_all_columns(rows, name)
    parents = parent_key = None
    if name in FOREIGN_KEY:
        parent_key, parent = FOREIGN_KEY[name]
        parents = table(spark, base, parent)
    good = accepted(rows, table(spark, base, name), PRIMARY_KEY[name], parents, parent_key)
    with_all_columns(good, name).write.mode("append").parquet(f"{base}/{name}")


def counts_with_videos(counts: DataFrame, videos: DataFrame, site: int | None = None) -> DataFrame:
    """Artifact paths joined to their clips, of one site or of all."""
    v = videos if site is None else videos.filter(F.col("site_id") == site)
    return counts.join(v, "video_id")


def with_artifacts(counts: DataFrame, files: DataFrame, detections_suffix: str, tracks_suffix: str) -> DataFrame:
    """Set both artifact paths of a clip where both files exist, else leave them as they are.

    The paths follow from the clip's path, so the file list is joined by equality."""
    stem = F.regexp_replace("video_id", r"\.mp4$", "")
    want = counts.select("video_id", F.concat(stem, F.lit(detections_suffix)).alias("d"),
                         F.concat(stem, F.lit(tracks_suffix)).alias("t"))
    have = files.select("path").distinct()
    both = (want.join(have.withColumnRenamed("path", "d"), "d", "left_semi")
            .join(have.withColumnRenamed("path", "t"), "t", "left_semi"))
    detections, tracks = "herdnet_detection_only_csv", "herdnet_tracking_with_direction_closest_boundary_method_csv"
    out = counts.join(both, "video_id", "left")
    return out.withColumns({detections: F.coalesce("d", detections), tracks: F.coalesce("t", tracks)}).drop("d", "t")


def rewrite(spark: SparkSession, base: str, name: str, rows: DataFrame) -> None:
    """Replace a table by rows derived from it: written beside it first, then swapped in, as a
    table cannot be read and overwritten in one job."""
    rows.write.mode("overwrite").parquet(f"{base}/_{name}_new")
    spark.read.schema(TABLES[name]).parquet(f"{base}/_{name}_new").write.mode("overwrite").parquet(f"{base}/{name}")
