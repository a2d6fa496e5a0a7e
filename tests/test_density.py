"""Density clusters of vectors against distances between all rows."""

import numpy as np
import pytest

from trackframe.operators.density import vector_density_clusters


def plain(x, eps, k):
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= eps
    core = near.sum(axis=1) >= k
    label = np.full(len(x), -1)
    order = sorted(np.flatnonzero(core), key=lambda i: tuple(x[i]))
    n = 0
    for i in order:
        if label[i] < 0:
            todo, label[i] = [i], n
            while todo:
                j = todo.pop()
                for m in np.flatnonzero(near[j] & core & (label < 0)):
                    label[m] = n
                    todo.append(m)
            n += 1
    out = label.copy()
    for i in np.flatnonzero(~core):
        hits = label[near[i] & core]
        out[i] = hits.min() if len(hits) else -1
    return out


@pytest.mark.parametrize("d, n, eps, k, keys", [(1, 200, 0.02, 3, 4), (4, 400, 0.8, 3, 4), (6, 250, 1.6, 5, 3)])
def test_labels_equal_all_distances(spark, d, n, eps, k, keys):
    rng = np.random.default_rng(d)
    centres = rng.normal(size=(5, d)) * 2
    x = np.concatenate([centres[rng.integers(0, 5, n)] + rng.normal(size=(n, d)) * rng.choice([0.1, 0.5], (n, 1)), np.zeros((9, d))])
    names = [f"c{i}" for i in range(d)]
    rows = [(i, *map(float, v)) for i, v in enumerate(x)] + [(-1, *[None] * d), (-2, *[float("nan")] * d)]
    df = spark.createDataFrame(rows, "i int, " + ", ".join(f"{c} double" for c in names))
    got = {r["i"]: r["cluster_label"] for r in vector_density_clusters(df, names, eps, k, key_columns=keys).collect()}
    assert got.pop(-1) is None and got.pop(-2) is None
    want = plain(x, eps, k)
    assert [got[i] for i in range(len(x))] == want.tolist()
    assert len(set(want)) > 1


def test_no_rows_and_only_noise(spark):
    df = spark.createDataFrame([(float(i), 0.0) for i in range(4)], "a double, b double")
    assert {r["cluster_label"] for r in vector_density_clusters(df, ["a", "b"], 0.5, 2).collect()} == {-1}
    assert vector_density_clusters(df.limit(0), ["a", "b"], 0.5, 2).count() == 0
