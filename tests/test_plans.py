"""Plans of the main queries: no Cartesian products, no Python in the plan, pushed filters."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from trackframe.operators import activity as a
from trackframe.plans import fixtures as fx
from trackframe.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"
JVM_ONLY = ["hourly_direction_difference", "clip_speed_means", "frame_encounters", "clip_encounter_rates", "movement_directions",
            "unmasked_rows", "flux_field", "hour_similarity_cosine", "angle_histograms", "hour_pair_distances", "greedy_matches",
            "detection_quality", "behaviour_features", "extended_features", "id_swap_repairs", "return_frequencies",
            "trail_activity", "trail_lagged_correlations", "hourly_rate_intervals", "start_point_clusters", "linked_tracks"]


def plan(df) -> str:
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", JVM_ONLY)
def test_no_cartesian_product_and_no_python(spark, name):
    text = plan(QUERIES[name](spark, SF))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas"):
        assert operator not in text


def test_scan_reads_only_needed_columns(spark):
    text = plan(QUERIES["individuals_per_frame"](spark, SF))
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint>" in text


def test_filters_reach_the_scan(spark):
    d = fx.read(spark, SF, "events").filter(F.col("user_id") == 3)
    assert "EqualTo(user_id,3)" in plan(a.individuals_per_frame(
        d.select(F.lit(1).alias("video_id"), F.lit(1).alias("frame_number"), F.col("user_id").alias("ant_id"))))


def test_speeds_of_plain_tracks_aggregate_by_hash(spark):
    from trackframe.operators.kinematics import speeds
    text = plan(speeds(fx.tracks(spark, SF).drop("seq")))
    assert "HashAggregate" in text and "SortAggregate" not in text
