"""Leave-one-out models against one plain fit per clip."""

import numpy as np
from pyspark.sql import functions as F

from trackframe.operators import scoring as sc


def plain(x, y):
    """Intercept and weights of the balanced, penalised fit by Newton steps on scaled features."""
    n, ones = len(y), y.sum()
    mean, spread = x.mean(axis=0), x.std(axis=0, ddof=1)
    z = np.column_stack([np.ones(n), np.where(spread > 0, (x - mean) / np.where(spread > 0, spread, 1), 0)])
    w = np.where(y == 1, n / (2 * ones), n / (2 * (n - ones)))
    b, penalty = np.zeros(z.shape[1]), np.diag([0.0] + [1.0] * x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-z @ b))
        b = b - np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + penalty, z.T @ (w * (p - y)) + penalty @ b)
    weights = np.where(spread > 0, b[1:] / np.where(spread > 0, spread, 1), 0)
    return b[0] - weights @ mean, weights


def rows(rng, clips, n):
    out = []
    for c in clips:
        for i in range(n):
            y = int(rng.random() < 0.3)
            out.append((c, i, y, float(rng.normal() + y), float(1000 + 50 * rng.normal() - 30 * y), 5.0))
    return out


def test_models_equal_a_fit_per_clip(spark):
    data = rows(np.random.default_rng(2), range(9), 25) + rows(np.random.default_rng(3), [None], 8)
    df = spark.createDataFrame(data, "video_id int, ant_id int, label int, a double, b double, c double").repartition(6)
    got = {r["video_id"]: r for r in sc.leave_one_out_models(df, ["a", "b", "c"]).collect()}
    assert set(got) == set(range(9))
    for clip, model in got.items():
        kept = [r for r in data if r[0] != clip]
        b, w = plain(np.array([r[3:] for r in kept]), np.array([r[2] for r in kept]))
        assert np.allclose([model["intercept"], *model["weights"]], [b, *w], rtol=1e-6, atol=1e-9)
        assert model["gradient"] <= 1e-9


def test_jobs_do_not_grow_with_clips(spark):
    tracker, done = spark.sparkContext.statusTracker(), []
    for clips in (4, 60):
        group = f"folds-{clips}"
        df = spark.createDataFrame(rows(np.random.default_rng(1), range(clips), 12), "video_id int, ant_id int, label int, a double, b double, c double")
        spark.sparkContext.setJobGroup(group, group)
        assert sc.leave_one_out_models(df, ["a", "b"]).count() == clips
        done.append(len(tracker.getJobIdsForGroup(group)))
    spark.sparkContext.setJobGroup("", "")
    assert done[1] <= done[0] + 12  # a few Newton steps more or less


def test_no_rows_and_one_class(spark):
    df = spark.createDataFrame([(1, 1, 0, 0.5), (2, 1, 0, 0.7)], "video_id int, ant_id int, label int, a double")
    assert sc.leave_one_out_models(df, ["a"]).count() == 0
    assert sc.leave_one_out_models(df.filter(F.lit(False)), ["a"]).count() == 0
