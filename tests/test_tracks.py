"""Order inside tracks, speeds, directions and cleaning, on small made-up frames."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackframe.functions import geometry as g
from trackframe.functions.ordering import exact_percentile, value_ranks, with_neighbours, with_position
from trackframe.operators import kinematics as k, trajectories as tj
from trackframe.schemas import require_columns

BOXED = "video_id int, ant_id int, frame_number int, x1 int, y1 int, x2 int, y2 int, direction string, angle double"


def track(spark, points, ant=1):
    """points: (frame, x, y); boxes of 20 px."""
    rows = [(1, ant, f, x - 10, y - 10, x + 10, y + 10, "away", 0.0) for f, x, y in points]
    return spark.createDataFrame(rows, BOXED)


def random_track(spark, n=60, ants=3, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for ant in range(ants):
        frames = np.sort(rng.choice(400, n, replace=False))
        for f in frames:
            x, y = (int(v) for v in rng.integers(20, 1000, 2))
            rows.append((1, ant, int(f), x - 10, y - 10, x + 10, y + 10, "away", float(rng.integers(0, 181))))
    return spark.createDataFrame(rows, BOXED)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_speed_of_first_row_and_frame_gap(spark):
    s = k.speeds(track(spark, [(0, 100, 100), (2, 103, 104), (3, 103, 104)]))
    assert rows(s, "frame_number", "velocity") == [(0, 0.0), (2, 50.0), (3, 0.0)]
    assert rows(s.filter("frame_number = 2"), "heading_deg")[0][0] == pytest.approx(math.degrees(math.atan2(4, 3)))


def test_one_row_tracks_have_no_speed(spark):
    assert k.speeds(track(spark, [(0, 1, 1)])).count() == 0


def test_repeated_frame_gives_speed_zero(spark):
    s = k.speeds(track(spark, [(5, 100, 100), (5, 110, 100)]))
    assert {r.velocity for r in s.collect()} == {0.0}


@pytest.mark.parametrize("width", [1, 7, 50])
def test_blocks_do_not_change_results(spark, width):
    t = random_track(spark)
    block = F.floor(F.col("frame_number") / width)
    cols = ("ant_id", "frame_number", "velocity", "heading_deg")
    assert rows(k.speeds(t, block=block), *cols) == rows(k.speeds(t), *cols)
    feats = ("ant_id", "total_length", "avg_angle_change")
    a, b = rows(tj.behaviour_features(t, block=block), *feats), rows(tj.behaviour_features(t), *feats)
    assert np.allclose(a, b)
    ret = ("ant_id", "return_frequency")
    assert rows(tj.return_frequencies(t, block=block), *ret) == rows(tj.return_frequencies(t), *ret)


def test_results_do_not_depend_on_partitions(spark):
    t = random_track(spark)
    cols = ("ant_id", "frame_number", "velocity")
    assert rows(k.speeds(t.repartition(1)), *cols) == rows(k.speeds(t.repartition(13)), *cols)


def test_position_and_neighbours_over_block_borders(spark):
    t = random_track(spark)
    p = with_position(t, ["ant_id"], ["frame_number"], F.floor(F.col("frame_number") / 9))
    n = with_neighbours(p, ["ant_id"], ["frame_number"], 2, block_rows=5)
    frames = {}
    for r in t.orderBy("frame_number").collect():
        frames.setdefault(r.ant_id, []).append(r.frame_number)
    for r in n.collect():
        f, i = frames[r.ant_id], r.position - 1
        assert f[i] == r.frame_number and r.track_rows == len(f)
        for d in (1, 2):
            assert r[f"frame_number_m{d}"] == (f[i - d] if i >= d else None)
            assert r[f"frame_number_p{d}"] == (f[i + d] if i + d < len(f) else None)


def test_recent_path_in_short_blocks(spark):
    t = random_track(spark)
    cols = ("ant_id", "frame_number", "recent_path")
    assert np.allclose(rows(k.recent_path(t, block_rows=6), *cols), rows(k.recent_path(t), *cols))


@pytest.mark.parametrize("method", ["moving_average", "gaussian"])
def test_smoothing_in_short_blocks(spark, method):
    t = random_track(spark)
    cols = ("ant_id", "frame_number", "center_x", "center_y")
    a = rows(tj.smoothed(t, method, block_rows=6), *cols)
    assert np.allclose(a, rows(tj.smoothed(t, method), *cols))


def test_gaussian_keeps_a_constant_track(spark):
    s = tj.smoothed(track(spark, [(i, 50, 70) for i in range(3)]), "gaussian")
    assert np.allclose(rows(s, "center_x", "center_y"), [(50, 70)] * 3)


def test_savgol_is_identity(spark):
    t = random_track(spark, 10, 1)
    assert rows(tj.smoothed(t), "frame_number", "center_x") == rows(k.centred(t), "frame_number", "center_x")


def test_nearest_boundary_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    pts = [(i, int(x), int(y)) for i, (x, y) in enumerate(rng.integers(0, 300, (40, 2)))]
    boundary = spark.createDataFrame(pts, "idx int, bx int, by int")
    t = random_track(spark, 100, 2)
    found = k.nearest_boundary(k.centred(t), boundary).collect()
    for r in found:
        d = [((int(r.center_x) - x) ** 2 + (int(r.center_y) - y) ** 2, i) for i, x, y in pts]
        assert (r.near.d2, r.near.idx) == min(d)


def test_equidistant_boundary_takes_first_index_and_outside_is_null(spark):
    boundary = spark.createDataFrame([(0, 120, 100), (1, 80, 100)], "idx int, bx int, by int")
    p = spark.createDataFrame([(100.0, 100.0), (1920.0, 5.0), (5.0, -3.0)], "center_x double, center_y double")
    got = {r.center_x: r.near for r in k.nearest_boundary(p, boundary).collect()}
    assert got[100.0].idx == 0 and got[1920.0] is None and got[5.0] is None


def test_direction_from_boundary(spark):
    boundary = spark.createDataFrame([(0, 100, 100)], "idx int, bx int, by int")
    t = track(spark, [(0, 110, 100), (1, 130, 100), (2, 115, 100), (3, 115, 130), (4, 115, 130), (5, 100, 100)])
    d = dict(rows(k.movement_direction(t, boundary), "frame_number", "direction"))
    # away, toward, sideways and out, standing still, on the boundary itself
    assert d == {1: "away", 2: "toward", 3: "away", 4: "unknown", 5: "unknown"}


def test_angle_between_zero_vector(spark):
    df = spark.createDataFrame([(0.0, 0.0, 1.0, 0.0), (1.0, 0.0, -1.0, 0.0), (1.0, 0.0, 0.0, 2.0)], "a double, b double, c double, d double")
    got = [r[0] for r in df.select(g.angle_between("a", "b", "c", "d")).collect()]
    assert got == pytest.approx([-1.0, 180.0, 90.0])


@pytest.mark.parametrize("x, cell", [(0.0, None), (0.5, 0), (20.0, 0), (20.5, 1), (1920.0, 95), (1920.5, None)])
def test_right_closed_cells(spark, x, cell):
    assert spark.range(1).select(g.cell_right_closed(F.lit(x), 20, 1920)).first()[0] == cell


def test_left_closed_cells_close_the_last_edge(spark):
    got = spark.range(1).select(*[g.cell_left_closed(F.lit(x), 5, 0, 383) for x in (0.0, 5.0, 1914.9, 1915.0, 1915.1)]).first()
    assert tuple(got) == (0, 1, 382, 382, None)


def test_interpolation_fills_gap_without_direction(spark):
    t = tj.interpolated(track(spark, [(0, 100, 100), (4, 140, 120)]))
    got = rows(t.filter("filled"), "frame_number", "x1", "y1", "ant_id", "direction")
    assert got == [(1, 100.0, 95.0, 1, None), (2, 110.0, 100.0, 1, None), (3, 120.0, 105.0, 1, None)]


def test_swap_needs_a_jump_below_the_limit(spark):
    a = track(spark, [(f, 200, 200) for f in range(20)], ant=1)
    b = track(spark, [(f, 300, 200) for f in range(20, 40)], ant=2)   # exactly 100 px away
    c = track(spark, [(f, 299, 400) for f in range(20)], ant=3)
    d = track(spark, [(f, 200, 400) for f in range(20, 40)], ant=4)   # 99 px away
    got = tj.swap_repaired(a.unionByName(b).unionByName(c).unionByName(d))
    changed = rows(got.filter("repaired_id <> ant_id"), "ant_id", "frame_number", "repaired_id")
    assert changed == [(4, 20, 3)]


def test_exact_percentile_equals_numpy(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.normal(size=300), np.zeros(200), rng.exponential(50, 100)])
    df = spark.createDataFrame([(i % 2, float(v)) for i, v in enumerate(values)], "k int, v double")
    for share in (0.0, 0.3, 0.95, 1.0):
        got = dict(rows(exact_percentile(df, ["k"], "v", share, buckets=7), "k", "percentile"))
        for key in (0, 1):
            assert got[key] == pytest.approx(np.percentile(values[key::2], share * 100))
    assert exact_percentile(df, [], "v", 0.5).first()[0] == pytest.approx(np.percentile(values, 50))


def test_average_ranks_in_blocks(spark):
    values = [0.1, 0.5, 0.5, 0.9, 0.2, 0.5]
    df = spark.createDataFrame([(1, v) for v in values], "k int, v double")
    for block in (None, F.floor(F.col("v") * 3)):
        got = sorted((r.v, r["rank"], r.n) for r in value_ranks(df, ["k"], "v", block).collect())
        assert got == [(0.1, 1.0, 1), (0.2, 2.0, 1), (0.5, 4.0, 3), (0.9, 6.0, 1)]


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="y2"):
        require_columns(spark.range(1).toDF("x1"), "x1", "y2")
