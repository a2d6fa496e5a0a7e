"""Encounters, matching, grids, statistics, clusters, trails and scores on small frames."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackframe.operators import activity as a, angles as an, clusters as cl, filters as fl, grids as gr
from trackframe.operators import linking as ln, matching as m, resampling as rs, scoring as sc
from trackframe.operators import statistics as st, trails as tr
from trackframe.functions import names
from trackframe.session import cut_lineage


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def boxes(spark, points, half=10):
    data = [(1, f, x - half, y - half, x + half, y + half, d, s, "2024-01-01", 3)
            for s, (f, x, y, d) in enumerate(points)]
    return spark.createDataFrame(data, "video_id int, frame_number int, x1 int, y1 int, x2 int, y2 int, direction string, "
                                       "seq long, day string, hour int").withColumn("site_id", F.lit(1))


def test_encounters_leave_out_coincident_and_equal_distance(spark):
    t = boxes(spark, [(0, 100, 100, "away"), (0, 100, 100, "away"), (0, 104, 100, "away"), (0, 110, 100, "away"), (0, 103, 100, "toward")])
    # both of the coincident pair meet the one 4 px away; that one meets the one 6 px on
    assert rows(a.encounters(t, 10.0), "direction", "n_encounters") == [("away", 3)]


def test_encounters_equal_all_pairs(spark):
    rng = np.random.default_rng(2)
    pts = [(int(f), int(x), int(y), "away") for f, x, y in zip(rng.integers(0, 3, 200), rng.integers(0, 90, 200), rng.integers(0, 90, 200))]
    want = {}
    for p, q in itertools.combinations(pts, 2):
        if p[0] == q[0] and 0 < math.dist(p[1:3], q[1:3]) < 12:
            want[p[0]] = want.get(p[0], 0) + 1
    assert dict(rows(a.encounters(boxes(spark, pts), 12.0), "frame_number", "n_encounters")) == want


def test_encounter_rate_of_unknown_rows(spark):
    t = boxes(spark, [(0, 10, 10, "unknown"), (0, 12, 10, "unknown"), (1, 10, 10, "unknown"), (0, 50, 50, "toward"), (2, 9, 9, "toward"), (3, 9, 9, "toward")])
    assert a.encounter_rates(t).first()["unknown"] == pytest.approx(1 / 2)
    assert a.encounter_rates(t, compat=True).first()["unknown"] == pytest.approx(1 / 3)


def test_slot_with_one_direction(spark):
    r = a.direction_rates(boxes(spark, [(0, 1, 1, "away"), (1, 1, 1, "away"), (1, 5, 5, "away")])).first()
    assert (r.away, r.toward, r.unknown, r.total) == (1.5, 0.0, 0.0, 1.5)


# ---- matching


def greedy(pairs):
    used, out = set(), []
    for g_, p in sorted(pairs):
        if ("g", g_) not in used and ("p", p) not in used:
            used |= {("g", g_), ("p", p)}
            out.append((g_, p))
    return sorted(out)


def test_rounds_and_fold_agree_with_a_loop(spark):
    rng = np.random.default_rng(4)
    pairs = sorted({(int(i), int(g_), int(p)) for i, g_, p in zip(rng.integers(0, 3, 300), rng.integers(0, 25, 300), rng.integers(0, 25, 300))})
    df = spark.createDataFrame(pairs, "image int, g long, p long")
    want = sorted((i, *x) for i in range(3) for x in greedy([q[1:] for q in pairs if q[0] == i]))
    assert rows(m.greedy_matches(df, ["image"]), "image", "g", "p") == want
    assert rows(m.greedy_matches(df, ["image"], fold_pairs=0), "image", "g", "p") == want


def quality_of(spark, gts, preds):
    def frame(b):
        return spark.createDataFrame([(1, 0, s, c, x, y, x + 20, y + 20) for s, (x, y, c) in enumerate(b)],
                                     "video_id int, frame_number int, seq long, confidence double, x1 int, y1 int, x2 int, y2 int")
    gt, pred = frame(gts), frame(preds)
    pairs = m.overlap_pairs(gt, pred)
    counts = m.detection_counts(gt, pred, m.greedy_matches(pairs)).first()
    return gt, pred, pairs, (counts.tp, counts.fp, counts.fn)


def test_two_predictions_on_one_box_and_one_on_two(spark):
    assert quality_of(spark, [(0, 0, 1.0)], [(1, 0, .9), (0, 1, .8)])[3] == (1, 1, 0)
    assert quality_of(spark, [(0, 0, 1.0), (2, 0, 1.0)], [(1, 0, .9)])[3] == (1, 0, 1)
    assert quality_of(spark, [(0, 0, 1.0)], [(300, 300, .9)])[3] == (0, 1, 1)


def test_curve_with_large_images_equals_fold(spark):
    rng = np.random.default_rng(6)
    gts = [(int(x), int(y), 1.0) for x, y in rng.integers(0, 60, (15, 2))]
    preds = [(int(x), int(y), float(c)) for (x, y), c in zip(rng.integers(0, 60, (25, 2)), rng.random(25))]
    gt, pred, pairs, _ = quality_of(spark, gts, preds)
    th = m.even_thresholds(pred, 6)
    cols = ("step", "tp", "fp", "fn")
    one = rows(m.precision_recall_curve(gt, pred, pairs, th), *cols)
    assert one == rows(m.precision_recall_curve(gt, pred, pairs, th, fold_pairs=0), *cols)
    assert all(tp + fn == len(gts) for _, tp, _, fn in one)
    ious = {(i, j): 0 for i in range(3) for j in range(3)}
    assert ious and rows(pairs, "g", "p") == sorted(
        (i, j) for i, (gx, gy, _) in enumerate(gts) for j, (px, py, _) in enumerate(preds)
        if (s := max(0, 20 - abs(gx - px)) * max(0, 20 - abs(gy - py))) / (800 - s) > 0.5)


# ---- grids and angles


def test_similarity_is_symmetric_with_unit_diagonal(spark):
    rng = np.random.default_rng(7)
    data = [(1, i, int(c % 96), int(c % 54), float(rng.random() + .1)) for i in range(4) for c in rng.choice(96, 20, replace=False)]
    v = spark.createDataFrame(data, "site_id int, hour int, x_bin int, y_bin int, f double").groupBy(
        "site_id", "hour", "x_bin", "y_bin").agg(F.sum("f").alias("f"))
    dense = np.zeros((4, 96 * 54))
    for r in v.collect():
        dense[r.hour, r.x_bin * 54 + r.y_bin] = r.f
    for metric, fn in (("cosine", lambda p, q: p @ q / np.linalg.norm(p) / np.linalg.norm(q)),
                       ("correlation", lambda p, q: np.corrcoef(p, q)[0, 1]), ("euclidean", lambda p, q: -np.linalg.norm(p - q))):
        got = {(r.i, r.j): r.similarity for r in gr.similarity(v, v, ["site_id"], "hour", "f", metric).collect()}
        for i, j in itertools.product(range(4), repeat=2):
            assert got[i, j] == pytest.approx(fn(dense[i], dense[j]), abs=1e-6)
            assert got[i, j] == pytest.approx(got[j, i])


def test_full_matrix_marks_missing_hours(spark):
    s = spark.createDataFrame([(1, 0, 0, 1.0)], "site_id int, i int, j int, similarity double")
    full = gr.full_matrix(s, ["site_id"], 24, "similarity")
    assert full.count() == 576 and full.filter("similarity is null").count() == 575


def test_flux_with_degrees_and_compat(spark):
    row = [(1, "2024-01-01", 5, "away", 1, 0, 30.0, 30.0, 10.0, 90.0)]
    s = spark.createDataFrame(row, "site_id int, day string, hour int, direction string, video_id int, frame_number int, "
                                   "center_x double, center_y double, velocity double, heading_deg double")
    f, c = gr.flux_field(s).first(), gr.flux_field(s, compat=True).first()
    assert (f.u, f.v) == pytest.approx((0, 10), abs=1e-9) and c.u == pytest.approx(10 * math.cos(90))
    assert f.flux_mag == pytest.approx(c.flux_mag) and (f.x_bin, f.x_center) == (1, 30.0)


def test_histogram_edges_and_sum(spark):
    data = [(1, "d", 0, "away", x) for x in (0.0, 30.0, 359.9, 360.0, -1.0)] + [(1, "d", 0, "toward", 190.0)]
    t = spark.createDataFrame(data, "site_id int, day string, hour int, direction string, angle double")
    h = an.angle_histograms(t).first()
    assert h.away == pytest.approx([.25, .25] + [0] * 9 + [.5]) and h.toward[0] == 1.0
    assert sum(h.both) == pytest.approx(1)


# ---- statistics


def test_lags_ties_constant_and_gap(spark):
    def series(x, y, trail):
        return [(trail, t, float(p), float(q)) for t, (p, q) in enumerate(zip(x, y)) if t != 3]
    rng = np.random.default_rng(8)
    x = rng.random(30)
    data = series(x, np.roll(x, 2), 0) + series(x, np.ones(30), 1)
    s = spark.createDataFrame(data, "trail_id int, t int, toward double, away double")
    c = st.lagged_correlations(s, ["trail_id"], 4)
    best = {r.trail_id: r for r in st.best_lags(c, ["trail_id"]).collect()}
    assert best[0].best_lag == 2 and best[0].best_r == pytest.approx(1)
    assert best[1].best_lag == 0 and best[1].best_r is None
    ties = spark.createDataFrame([(0, 1, -0.5, 9, 1.0), (0, 4, 0.5, 9, 1.0)], "trail_id int, lag int, r double, n int, t_stat double")
    assert st.best_lags(ties, ["trail_id"]).first().best_lag == 1


def test_p_values(spark):
    df = spark.createDataFrame([(2.228138852, 10.0), (0.0, 5.0), (12.7062047, 1.0), (1.959964, 1e7)], "t double, d double")
    got = [r[0] for r in df.select(st.student_p_value(F.col("t"), F.col("d"))).collect()]
    assert got == pytest.approx([0.05, 1.0, 0.05, 0.05], abs=1e-6)


def test_bootstrap_repeats_and_covers_the_mean(spark):
    v = spark.createDataFrame([(1, i, float(i)) for i in range(20)], "site_id int, day int, x double")
    one = rs.bootstrap_intervals(v, ["site_id"], ["x"], ["day"], 300).first()
    two = rs.bootstrap_intervals(v.repartition(7), ["site_id"], ["x"], ["day"], 300).first()
    assert tuple(one) == tuple(two) and one.x_low < 9.5 < one.x_high and abs(one.x_mean - 9.5) < 0.5


def test_permutations_keep_the_values(spark):
    data = [(1, i, j, float(i * 5 + j)) for i in range(5) for j in range(5)]
    s = spark.createDataFrame(data, "site_id int, i int, j int, similarity double")
    p = rs.permuted_entries(s, ["site_id"], F.lit(0), 3)
    for _, group in itertools.groupby(sorted(p.collect(), key=lambda r: r.resample), key=lambda r: r.resample):
        assert sorted(r.similarity for r in group) == [float(x) for x in range(25)]
    c = rs.permuted_columns(s, ["site_id"], 5, 2)
    assert c.count() == 50 and c.select("resample", "i", "j").distinct().count() == 50


def test_random_intercept_equals_dense_likelihood(spark):
    rng = np.random.default_rng(9)
    data, effects = [], rng.normal(0, 1.5, 6)
    for g_ in range(6):
        for _ in range(30):
            x = rng.normal(size=2)
            data.append((g_, float(x[0]), float(x[1]), float(1 + 2 * x[0] - x[1] + effects[g_] + rng.normal(0, .5))))
    df = spark.createDataFrame(data, "site_id int, p double, q double, y double")
    fit = st.random_intercept_model(df, ("p", "q"))
    arr = np.array(data)
    X, y, g_ = np.column_stack([np.ones(len(arr)), arr[:, 1:3]]), arr[:, 3], arr[:, 0]

    def loglik(ratio):
        V = np.eye(len(y)) + ratio * (g_[:, None] == g_[None, :])
        inv = np.linalg.inv(V)
        b = np.linalg.solve(X.T @ inv @ X, X.T @ inv @ y)
        res = y - X @ b
        s2 = res @ inv @ res / len(y)
        return -0.5 * (len(y) * (math.log(2 * math.pi * s2) + 1) + np.linalg.slogdet(V)[1]), b

    best = max((loglik(r)[0], r) for r in np.exp(np.linspace(math.log(.1), math.log(100), 400)))
    assert fit["log_likelihood"] >= best[0] - 1e-4
    assert list(fit["coefficients"].values()) == pytest.approx(list(loglik(fit["ratio"])[1]))
    f = st.fitted_values(df, fit, ("p", "q"))
    assert f.agg(F.avg("residual")).first()[0] == pytest.approx(0, abs=0.05)


# ---- clusters


def dbscan(points, eps, k_min):
    n = len(points)
    near = [[j for j in range(n) if math.dist(points[i], points[j]) <= eps] for i in range(n)]
    core = [len(x) >= k_min for x in near]
    label = [-1] * n
    for i in sorted((i for i in range(n) if core[i]), key=lambda i: points[i]):
        if label[i] == -1:
            label[i], todo = max(label) + 1, [i]
            while todo:
                for j in near[todo.pop()]:
                    if core[j] and label[j] == -1:
                        label[j] = label[i]
                        todo.append(j)
    return [min((label[j] for j in near[i] if core[j]), default=-1) if not core[i] else label[i] for i in range(n)]


@pytest.mark.parametrize("spread, k_min", [(120, 3), (300, 4), (40, 6)])
def test_density_clusters_equal_brute_force(spark, spread, k_min):
    rng = np.random.default_rng(spread)
    pts = [(float(x), float(y)) for x, y in rng.integers(0, spread, (120, 2)) / 2]
    df = spark.createDataFrame([(1, i, *p) for i, p in enumerate(pts)], "site_id int, i int, x double, y double")
    got = [r[1] for r in rows(cl.density_clusters(df, ["site_id"], "x", "y", 7.0, k_min), "i", "cluster")]
    assert got == dbscan(pts, 7.0, k_min)


def test_connected_chain(spark):
    nodes = spark.range(40).selectExpr("1 as site_id", "id as node")
    edges = spark.range(38).filter("id <> 20").selectExpr("1 as site_id", "id as a", "id + 1 as b")
    got = dict(rows(cl.connected_components(nodes, edges, ["site_id"]), "node", "label"))
    assert {got[i] for i in range(21)} == {0} and {got[i] for i in range(21, 39)} == {21} and got[39] == 39


def test_elbow_is_one_past_the_bend():
    assert cl.elbow([100, 50, 45, 40, 36, 33]) == 4


def test_label_audit_finds_problems(spark):
    t = spark.createDataFrame([(0, 0.0), (1, 2.0), (1, -3.0), (3, None)], "trajectory_index int, cluster_label double")
    r = cl.label_audit(t).first()
    assert (r.negative_labels, r.gaps, r.zero_missing, r.null_labels, r.duplicate_indices) == (1, 1, 0, 1, 1)


def test_behaviour_clusters_separate_groups(spark):
    rng = np.random.default_rng(1)
    data = [(1, i, *(float(v) for v in rng.normal((i % 3) * 10, .3, 4))) for i in range(60)]
    df = spark.createDataFrame(data, "video_id int, ant_id int, efficiency double, straight_distance double, avg_angle_change double, total_length double")
    labelled, _ = cl.behaviour_clusters(df, 3)
    assert len({(r.ant_id % 3, r.cluster_label) for r in labelled.collect()}) == 3
    q = cl.cluster_quality(labelled).first()
    assert q.n_clusters == 3 and q.silhouette > .9 and q.calinski_harabasz > 100


# ---- trails


def cells(spark, xy):
    return spark.createDataFrame([(1, x, y) for x, y in xy], "site_id int, x_bin int, y_bin int")


def test_shortest_trail_and_junction(spark):
    line = [(x, 10) for x in range(5, 30)] + [(17, y) for y in range(11, 20)]
    c = cells(spark, line)
    nest = spark.createDataFrame([(3, 10), (3, 11)], "x_bin int, y_bin int")
    j = tr.nest_junctions(c, nest, max_distance=4, n=3, spacing=10)
    assert rows(j, "x_bin", "y_bin", "distance") == [(5, 10, 2.0)]
    t = tr.shortest_trails(c, j, min_length=10)
    got = {r.node: (r.length, r.path[0]) for r in t.collect()}
    assert got[10 * 96 + 29] == (25, 10 * 96 + 5) and got[19 * 96 + 17] == (21, 10 * 96 + 5)
    kept = tr.without_contained(tr.trail_points(t), tolerance=1.5, threshold=.9)
    assert kept.count() == 2


def test_contained_trail_is_dropped(spark):
    data = [(1, 0, i, i, 5) for i in range(30)] + [(1, 1, i, i, 6) for i in range(20)] + [(1, 2, i, 50, 20 + i) for i in range(20)]
    p = spark.createDataFrame(data, "site_id int, trail_id int, seq int, x_bin int, y_bin int")
    assert rows(tr.without_contained(p, tolerance=1.5, threshold=.9), "trail_id") == [(0,), (2,)]


def test_bias_without_rows_is_zero(spark):
    act = spark.createDataFrame([(1, 0, "d", 1, "away", 0.0), (1, 0, "d", 1, "toward", 0.0), (1, 0, "d", 2, "away", 2.0)],
                                "site_id int, trail_id int, day string, hour int, direction string, density double")
    assert rows(tr.paired_activity(act), "hour", "bias") == [(1, 0.0), (2, 1.0)]


def test_linked_chain(spark):
    data = [(1, f, 0, 10 + 4 * i, 10, 30 + 4 * i, 30) for i, f in enumerate((0, 1, 5, 6, 9))] + [(1, 5, 1, 200, 200, 220, 220)]
    b = spark.createDataFrame(data, "video_id int, frame_number int, seq long, x1 int, y1 int, x2 int, y2 int")
    got = rows(ln.linked_tracks(b), "frame_number", "seq", "first_frame", "first_seq")
    assert got == [(0, 0, 0, 0), (1, 0, 0, 0), (5, 0, 0, 0), (5, 1, 5, 1), (6, 0, 0, 0), (9, 0, 0, 0)]


# ---- scores and filters


def test_fold_with_one_class_is_skipped(spark):
    data = [(1, i, float(i), i % 2) for i in range(8)] + [(2, i, float(i), 0) for i in range(4)]
    t = spark.createDataFrame(data, "video_id int, ant_id int, f double, label int")
    assert {r.video_id for r in sc.leave_one_out_scores(t, ["f"]).collect()} == {2}


def test_missing_feature_has_no_score(spark):
    data = [(1, i, float(i), int(i > 5)) for i in range(12)]
    t = spark.createDataFrame(data, "video_id int, ant_id int, f double, label int")
    model = sc.fit_classifier(t, ["f"])
    s = sc.scored(model, t.withColumn("f", F.when(F.col("ant_id") != 3, F.col("f"))), ["f"])
    got = dict(rows(s, "ant_id", "excavating_score"))
    assert got[3] is None and got[0] < .5 < got[11]
    intercept, weights = sc._raw_weights(model)
    assert got[7] == pytest.approx(1 / (1 + math.exp(-(intercept + weights[0] * 7))))


def test_labels_and_names(spark):
    df = spark.createDataFrame([(" Yes ", "/a/2024-08-01_21_01_00/x_12.jpg"), ("maybe", "b_7_3.png"), (None, "c")], "v string, p string")
    got = df.select(names.yes_no_label(F.col("v")), names.clip_hour(F.col("p")), names.frame_of_image(F.col("p")),
                    names.base_image(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [(1, 21, 12, "x"), (None, None, 3, "b_7"), (None, None, None, "c")]


def test_empty_mask_and_unknown_site(spark):
    t = boxes(spark, [(0, 100, 100, "away")])
    none = spark.createDataFrame([], "x int, y int")
    assert fl.drop_ignored(t, none).count() == 1 and fl.keep_on_mask(t, none).count() == 0
    assert t.select(fl.site_label(F.lit(9))).first()[0] == "unknown"


def test_checkpoint_uses_a_shared_folder(spark):
    df = cut_lineage(spark.range(5))
    assert df.count() == 5 and spark.sparkContext.getCheckpointDir()


def test_flux_maps_keep_all_cells_and_components(spark, monkeypatch):
    from trackframe.operators import clusters as cl
    from trackframe.plans import cluster_queries as cq
    seen, real = [], cl.flux_map_clusters

    def held(vectors, *rest):
        rows, shares = real(vectors, *rest)
        seen.extend([len(vectors.first()["features"]), len(shares), vectors.count()])
        return rows, shares

    monkeypatch.setattr(cl, "flux_map_clusters", held)
    got = cq.flux_map_clusters(spark, "/root/testdata/sf0.001").collect()
    assert seen[:2] == [5184, 20] and sum(r["n"] for r in got) == seen[2]


def test_leading_components_are_principal_components(spark):
    from pyspark.ml.linalg import Vectors
    from trackframe.operators import clusters as cl
    import random
    rnd = random.Random(3)
    rows = spark.createDataFrame([(i, Vectors.dense([rnd.gauss(0, 1 + j % 7) for j in range(120)])) for i in range(40)], ["i", "features"])
    (a, shares), (b, want) = cl.leading_components(rows, 4), cl.principal_components(rows, 4)
    assert all(abs(x - y) < 1e-8 for x, y in zip(shares, want))
    for x, y in zip(a.orderBy("i").collect(), b.orderBy("i").collect()):
        assert all(abs(abs(p) - abs(q)) < 1e-6 for p, q in zip(x["pca"], y["pca"]))


@pytest.mark.parametrize("metric", ["cosine", "correlation", "euclidean"])
def test_day_similarity_over_many_blocks_of_days(spark, metric):
    rng = np.random.default_rng(6)
    days, cells = 75, 5184
    dense = {s: np.where(rng.random((days, cells)) < 0.004, rng.integers(1, 9, (days, cells)), 0) for s in (1, 2)}
    dense[1][3] = 0  # a day without mass is no row
    rows = [(s, 19_700 + int(d) * (1 if s == 1 else 9), int(c) // 54, int(c) % 54, float(m[d, c]))
            for s, m in dense.items() for d, c in zip(*np.nonzero(m))]
    v = spark.createDataFrame(rows, "site int, d int, x_bin int, y_bin int, v double").withColumn("day", F.date_from_unix_date("d"))
    got = {(r["site"], r["a"], r["b"]): r["similarity"] for r in gr.day_similarity(v, ["site"], "v", metric=metric).select(
        "site", F.unix_date("i").alias("a"), F.unix_date("j").alias("b"), "similarity").collect()}
    assert len(got) == 74 * 74 + 75 * 75
    for (s, a, b), found in got.items():
        step = 1 if s == 1 else 9
        x, y = dense[s][(a - 19_700) // step].astype(float), dense[s][(b - 19_700) // step].astype(float)
        want = (-np.linalg.norm(x - y) if metric == "euclidean" else
                np.corrcoef(x, y)[0, 1] if metric == "correlation" else x @ y / np.linalg.norm(x) / np.linalg.norm(y))
        assert math.isclose(found, want, rel_tol=1e-9, abs_tol=1e-9)


def test_thresholds_that_keep_the_same_pairs_are_folded_once(spark):
    data = [(1, 0, 0, 0.5), (1, 0, 1, 1.0), (1, 1, 1, 0.5), (2, 0, 0, 1.0)]
    pairs = spark.createDataFrame(data, "image int, g long, p long, confidence double")
    th = [2.0, 1.0, 0.9, 0.5, 0.2, 0.0]
    steps = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(t).alias("threshold")) for i, t in enumerate(th)])
    lists = pairs.groupBy("image").agg(F.sort_array(F.collect_list(F.struct("g", "p", "confidence"))).alias("pairs"))
    assert rows(m._hits_per_step(lists, steps), "step", "tp") == sorted(
        [(1, 1), (2, 1), (3, 2), (4, 2), (5, 2)] + [(s, 1) for s in range(1, 6)])
    gt = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "image int, seq long")
    pred = spark.createDataFrame([(1, 0, 0.5), (1, 1, 1.0), (2, 0, 1.0)], "image int, seq long, confidence double")
    one = rows(m.precision_recall_curve(gt, pred, pairs, th, ["image"]), "step", "tp", "fp", "fn")
    assert one == rows(m.precision_recall_curve(gt, pred, pairs, th, ["image"], fold_pairs=0), "step", "tp", "fp", "fn")
    assert one[0] == (0, 0, 0, 3) and one[1] == (1, 2, 0, 1) and one[-1] == (5, 3, 0, 0)


def test_features_of_scored_trajectories_are_made_once(spark, monkeypatch):
    from trackframe.plans import cluster_queries as cq
    made, plain = [], cq.features
    monkeypatch.setattr(cq, "features", lambda *a: made.append(a) or plain(*a))
    assert cq.scored_trajectories(spark, "/root/testdata/sf0.01").count() > 0
    assert len(made) == 1


def test_checks_of_assigned_tracks_write_nothing_again(spark, monkeypatch):
    from trackframe.plans import trail_queries as tq

    def refused(df):
        raise AssertionError("written a second time")

    monkeypatch.setattr(tq, "cut_lineage", refused)
    assert tq.assigned_track_checks(spark, "/root/testdata/sf0.001").columns[0] == "video_id"
