"""Masks that differ by site and bout, held as runs of pixels in a row.

A run is (mask keys, y, x_from, x_to), both ends included; a mask of a frame has a few runs for each of its
rows instead of all its pixels. Positions meet runs in bins of x, days meet bouts in bins of days, so both
are equi-joins whose candidates have a bound that does not grow with the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from trackframe.functions import geometry as g
from trackframe.operators.kinematics import TRACK, movement_direction, nearest_boundary
from trackframe.operators.trajectories import nest_proximity, outline

X_BIN = 128
DAY_BIN = 16


def runs_of(pixels: DataFrame, mask_keys=()) -> DataFrame:
    """Longest runs of adjacent pixels (x, y) of every row; repeated pixels count once.
    The window holds one row of one frame."""
    keys = list(mask_keys)
    row = Window.partitionBy(*keys, "y").orderBy("x")
    p = pixels.select(*keys, "x", "y").distinct().withColumn("_start", F.col("x") - F.row_number().over(row))
    return p.groupBy(*keys, "y", "_start").agg(F.min("x").alias("x_from"), F.max("x").alias("x_to")).drop("_start")


def pixels_of(runs: DataFrame, mask_keys=()) -> DataFrame:
    """The distinct pixels of runs, which may overlap. Runs with x_to below x_from are empty."""
    x = F.when(F.col("x_to") >= F.col("x_from"), F.sequence("x_from", "x_to"))
    return runs.select(*mask_keys, F.explode(x).alias("x"), "y").distinct()


def joined_runs(runs: DataFrame, mask_keys=()) -> DataFrame:
    """The same pixels as runs that neither overlap nor touch."""
    keys = list(mask_keys)
    row = Window.partitionBy(*keys, "y").orderBy("x_from", "x_to")
    reach = F.max("x_to").over(row.rowsBetween(Window.unboundedPreceding, -1))
    opened = F.when(reach.isNull() | (F.col("x_from") > reach + 1), 1).otherwise(0)
    r = runs.filter(F.col("x_to") >= F.col("x_from")).withColumn("_opened", opened)
    r = r.withColumn("_run", F.sum("_opened").over(row.rowsBetween(Window.unboundedPreceding, 0)))
    return r.groupBy(*keys, "y", "_run").agg(F.min("x_from").alias("x_from"), F.max("x_to").alias("x_to")).drop("_run")


def with_bout(rows: DataFrame, bouts: DataFrame, site: str = "site_id", day: str = "day", bout: str = "bout") -> DataFrame:
    """Add the bout of each row's site and day, null outside all bouts.

    bouts are (site, first_day, last_day, bout), both days included; of overlapping bouts the one that starts
    last counts, then the smallest name. A day meets the few bouts of its site that touch its bin of days.
    """
    def bin_of(d):
        return F.floor(F.unix_date(d) / DAY_BIN)

    touched = F.when(F.col("last_day") >= F.col("first_day"), F.sequence(bin_of(F.col("first_day")), bin_of(F.col("last_day"))))
    b = bouts.select(F.col(site).alias("_site"), F.explode(touched).alias("_bin"), "first_day", "last_day",
                     F.col(bout).alias("_name"))
    # distinct site days are few: the rows themselves get their bout by one join on (site, day)
    days = rows.select(F.col(site).alias("_site"), F.col(day).alias("_day")).distinct().withColumn("_bin", bin_of(F.col("_day")))
    found = (days.join(b, ["_site", "_bin"]).filter(F.col("_day").between(F.col("first_day"), F.col("last_day")))
             .groupBy("_site", "_day").agg(F.min(F.struct((-F.unix_date("first_day")).alias("o"), "_name"))["_name"].alias(bout)))
    on = (F.col(site) == F.col("_site")) & (F.col(day) == F.col("_day"))
    return rows.drop(bout).join(found, on, "left").drop("_site", "_day")


def _meeting(boxes: DataFrame, runs: DataFrame, mask_keys, how: str) -> DataFrame:
    keys = list(mask_keys)
    at_x, at_y = g.truncated(g.midpoint("x1", "x2")), g.truncated(g.midpoint("y1", "y2"))
    b = boxes.withColumns({"_x": at_x, "_y": at_y, "_bin": F.floor(at_x / X_BIN)})
    bins = F.when(F.col("x_to") >= F.col("x_from"),
                  F.sequence(F.floor(F.col("x_from") / X_BIN), F.floor(F.col("x_to") / X_BIN)))
    r = runs.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("y").alias("_run_y"),
                    "x_from", "x_to", F.explode(bins).alias("_run_bin")).withColumnsRenamed(
        {"x_from": "_from", "x_to": "_to"})
    on = (F.col("_y") == F.col("_run_y")) & (F.col("_bin") == F.col("_run_bin")) & F.col("_x").between(
        F.col("_from"), F.col("_to"))
    for i, k in enumerate(keys):
        on = on & (F.col(k) == F.col(f"_k{i}"))
    return b.join(r, on, how).drop("_x", "_y", "_bin")


def keep_on_runs(boxes: DataFrame, runs: DataFrame, mask_keys=("site_id", "bout")) -> DataFrame:
    """Boxes whose truncated centre lies in a run of their mask. Rows without a mask go."""
    return _meeting(boxes, runs, mask_keys, "left_semi")


def drop_on_runs(boxes: DataFrame, runs: DataFrame, mask_keys=("site_id", "bout")) -> DataFrame:
    """Boxes whose truncated centre lies in no run of their mask. Rows without a mask stay."""
    return _meeting(boxes, runs, mask_keys, "left_anti")


def boundary_of(runs: DataFrame, mask_keys=("site_id", "bout")) -> DataFrame:
    """Outline (idx, bx, by) of each mask."""
    return outline(pixels_of(runs, mask_keys), mask_keys)


def nearest_of_mask(points: DataFrame, runs: DataFrame, mask_keys=("site_id", "bout")) -> DataFrame:
    """Nearest outline point of the position's own mask; null where it has none."""
    return nearest_boundary(points, boundary_of(runs, mask_keys), mask_keys=mask_keys)


def direction_of_mask(tracks: DataFrame, runs: DataFrame, mask_keys=("site_id", "bout"), margin: float = 20.0) -> DataFrame:
    """Movement direction against the outline of each row's own mask."""
    return movement_direction(tracks, boundary_of(runs, mask_keys), margin=margin, mask_keys=mask_keys)


def proximity_of_mask(tracks: DataFrame, runs: DataFrame, mask_keys=("site_id", "bout"), keys=TRACK) -> DataFrame:
    """Start distance of each track to its own nest; infinite where it has none."""
    return nest_proximity(tracks, pixels_of(runs, mask_keys), keys, mask_keys)
