"""Histograms of movement angles and their distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trackframe.operators.activity import SLOT

BINS, WIDTH = 12, 30.0


def turned(angle: Column) -> Column:
    """Opposite heading, in 0..360."""
    return (angle + 180) % 360


def _bin(angle: Column) -> Column:
    return F.when((angle >= 0) & (angle <= 360), F.least(F.floor(angle / WIDTH), F.lit(BINS - 1)))


def _shares(index: Column) -> Column:
    """Array of the share of rows in each bin, null when no row falls in a bin."""
    total = F.count(index)
    return F.when(total > 0, F.array(*[F.count_if(index == b) / total for b in range(BINS)]))


def angle_histograms(tracks: DataFrame, by=SLOT) -> DataFrame:
    """Per clip: share of rows per 30 degree bin for away, for toward (turned by 180 degrees)
    and for both together. The twelve counts are plain aggregates, so no row is moved twice."""
    a = F.col("angle")
    is_away, is_toward = F.col("direction") == "away", F.col("direction") == "toward"
    corrected = F.when(is_away, a).when(is_toward, turned(a))
    return tracks.groupBy(*by).agg(
        _shares(_bin(F.when(is_away, a))).alias("away"),
        _shares(_bin(F.when(is_toward, turned(a)))).alias("toward"),
        _shares(_bin(corrected)).alias("both"))


def histogram_rows(histograms: DataFrame, column: str, by=SLOT) -> DataFrame:
    """One row per bin."""
    return histograms.filter(F.col(column).isNotNull()).select(
        *by, F.posexplode(column).alias("bin", "share"))


def l1(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)


def l2(a: str, b: str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def direction_distances(histograms: DataFrame, by=SLOT) -> DataFrame:
    """Distance of the away and the toward histogram of a clip, null when one is missing."""
    return histograms.select(*by, l1("away", "toward").alias("l1"), l2("away", "toward").alias("l2"))


def mean_distance_by_hour(distances: DataFrame, by=("site_id", "hour")) -> DataFrame:
    return distances.groupBy(*by).agg(F.avg("l1").alias("l1"), F.count("l1").alias("n_clips"))


def hour_distances(histograms: DataFrame, group=("site_id", "day")) -> DataFrame:
    """Distance between every two hours of a day: at most 24 x 24 small rows per day."""
    h = histograms.filter(F.col("both").isNotNull())
    left = h.select(*group, F.col("hour").alias("i"), F.col("both").alias("hi"))
    right = h.select(*group, F.col("hour").alias("j"), F.col("both").alias("hj"))
    return left.join(right, list(group)).select(*group, "i", "j", l1("hi", "hj").alias("distance"))
