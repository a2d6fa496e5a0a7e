"""Tables that are computed once per clip and extended when clips are new or have changed.

A manifest beside the table holds a row for every clip and time it was stored: its version, an order-free digest of
its input rows. Clips whose version is not the latest in the manifest are computed; each is a partition folder of
its own, so that a write replaces exactly those. The manifest is written last: a run that is cut off leaves clips
that the next one computes again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from trackframe.session import cut_lineage
from trackframe.sources.sinks import table_exists

CLIP = ("site_id", "day", "video_id")


def versions(rows: DataFrame, clip=CLIP) -> DataFrame:
    """clip, version: count and hash sums of a clip's rows over all columns, in any order of rows."""
    kinds = dict(rows.dtypes)
    columns = [F.to_json(F.struct(c)) if kinds[c].startswith("map") else F.col(c) for c in sorted(rows.columns)]
    hashed = rows.select(*clip, F.xxhash64(*columns).alias("_h"))
    return hashed.groupBy(*clip).agg(F.concat_ws(
        "-", F.count("*").cast("string"), F.sum(F.col("_h").cast("decimal(38,0)")).cast("string"),
        F.bit_xor("_h").cast("string")).alias("version"))


def manifest(spark: SparkSession, path: str, clip=CLIP) -> DataFrame | None:
    """The latest version of every stored clip and the batch that stored it; None before the first batch."""
    place = f"{path}_manifest"
    if not table_exists(spark, place):
        return None
    return spark.read.parquet(place).groupBy(*clip).agg(F.max(F.struct("batch", "version")).alias("m")).select(*clip, "m.*")


def store_clips(rows: DataFrame, path: str, compute: Callable[[DataFrame], DataFrame], clip=CLIP) -> DataFrame:
    """Computes and stores the clips of `rows` that are new or changed; returns them with their versions.

    `compute` maps the rows of whole clips to rows that hold the clip's columns. Stored clips that `rows` does not
    have stay. A clip without result rows is stored without any. Clips with a null in their key are never the same.
    """
    spark, clip = rows.sparkSession, list(clip)
    known = manifest(spark, path, clip)
    now = cut_lineage(versions(rows, clip))
    stale = now if known is None else cut_lineage(now.join(known, [*clip, "version"], "left_anti"))
    if stale.isEmpty():
        return stale
    batch = 0 if known is None else known.agg(F.max("batch")).first()[0] + 1
    made = compute(rows.join(stale.select(*clip), clip, "left_semi"))
    (made.repartition(*clip).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*clip).parquet(path))
    stale.withColumn("batch", F.lit(batch).cast("long")).write.mode("append").parquet(f"{path}_manifest")
    return stale


def stored_clips(rows: DataFrame, path: str, compute: Callable[[DataFrame], DataFrame], clip=CLIP) -> DataFrame:
    """The stored result of exactly the clips of `rows`, after storing those that are new or changed."""
    store_clips(rows, path, compute, clip)
    wanted = rows.select(*clip).distinct()
    return rows.sparkSession.read.parquet(path).join(wanted, list(clip), "left_semi")
