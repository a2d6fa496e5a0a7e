"""Whitening against a plain eigendecomposition, and the parts of the incremental one."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackframe.llm import whitening as wh


def scatter(x):
    c = x - x.mean(axis=0)
    return c.T @ c


def assert_spectrum(s, x):
    m = scatter(x)
    size = max(1.0, np.abs(m).max())
    assert s.n == len(x) and np.allclose(s.mean, x.mean(axis=0), atol=1e-9 * size)
    assert np.allclose(s.vectors.T @ s.vectors, np.eye(x.shape[1]), atol=1e-10)
    assert np.allclose(s.vectors @ np.diag(s.values) @ s.vectors.T, m, atol=1e-10 * size)
    assert (np.diff(s.values) >= 0).all()


CASES = {
    "plain": lambda r: r.integers(-200, 200, (120, 16)).astype(float),
    "fewer than dimensions": lambda r: r.integers(-200, 200, (5, 16)).astype(float),
    "one direction": lambda r: np.outer(r.integers(-9, 9, 40), np.arange(8)).astype(float),
    "equal": lambda r: np.ones((30, 6)),
    "equal eigenvalues": lambda r: np.concatenate([np.eye(10), -np.eye(10)]) * 7,
    "wide scales": lambda r: r.normal(size=(200, 12)) * np.logspace(-6, 6, 12),
    "constant columns": lambda r: np.column_stack([r.normal(size=(60, 3)), np.zeros((60, 3)), np.full((60, 2), 5.0)]),
    "one dimension": lambda r: r.normal(size=(50, 1)),
}


@pytest.mark.parametrize("name", CASES)
def test_updates_and_combination(name):
    x = CASES[name](np.random.default_rng(4))
    parts = []
    for part in np.array_split(x, 3):
        s = wh.Spectrum(x.shape[1])
        for v in part:
            s.add(v)
        if len(part):
            assert_spectrum(s, part)
        parts.append(s)
    whole = wh.Spectrum.of(parts[0].row())
    for s in parts[1:]:
        whole.combine(wh.Spectrum.of(s.row()))
    whole.combine(wh.Spectrum(x.shape[1]))
    assert_spectrum(whole, x)


def test_secular_roots():
    rng = np.random.default_rng(1)
    for k in (1, 2, 3, 20, 64):
        for _ in range(50):
            d = np.sort(rng.normal(size=k)) * 10.0 ** rng.integers(-4, 5)
            if k > 1 and np.diff(d).min() == 0:
                continue
            z = rng.normal(size=k) * 10.0 ** rng.integers(-6, 3, k)
            roots, distance = wh.secular_roots(d, z * z)
            want = np.linalg.eigvalsh(np.diag(d) + np.outer(z, z))
            size = np.abs(want).max()
            assert np.allclose(roots, want, atol=1e-12 * size)
            assert (distance.diagonal() <= 0).all() and (np.diff(roots) >= -1e-14 * size).all()


def plain(rows, k=4):
    """{(vec_id, component): values} by numpy, with the sign that makes the largest entry positive."""
    kept = [(i, v) for i, v in rows if v is not None and all(e is not None and math.isfinite(e) for e in v)]
    d = max((len(v) for _, v in kept), default=0)
    x = [(i, [math.floor(256 * float(np.float32(e))) for e in v] + [0] * (d - len(v))) for i, v in kept]
    fit = np.array(sorted({tuple(v) for _, v in x}), dtype=float)
    n, sums = len(fit), [int(s) for s in fit.sum(axis=0)]
    values, vectors = np.linalg.eigh(scatter(fit) / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = []
    for i, v in x:
        for c in range(min(k, d)):
            q = vectors[:, c] * np.sign(vectors[np.abs(vectors[:, c]).argmax(), c])
            white = None if values[c] <= 1e-12 * values.sum() else float((np.array(v) - fit.mean(axis=0)) @ q / math.sqrt(values[c]))
            out.append((i, c + 1, n, sum((n * a - s) ** 2 for a, s in zip(v, sums)), white, values[c] / values.sum()))
    return out


def assert_rows(got, want):
    key = lambda r: (str(r[0]), r[1], r[3], r[4] or 0)
    got, want = sorted((tuple(r) for r in got), key=key), sorted(want, key=key)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    for g, w in zip(got, want):
        assert (g[4] is None) == (w[4] is None)
        assert g[4] is None or math.isclose(g[4], w[4], rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(g[5], w[5], rel_tol=1e-9, abs_tol=1e-12)
    assert len({r[6] for r in got}) == 1 and (got[0][6] is None or got[0][6] < 1e-9)


def table(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for name in ("x", "n", "component", "place"):  # names the operator uses itself
        df = df.withColumn(name, F.lit("mine"))
    return df


def test_rows_equal_a_plain_fit(spark):
    rng = np.random.default_rng(7)
    rows = [(k, (rng.normal(size=12) * np.linspace(3, 0.2, 12)).tolist()) for k in range(400)]
    rows += [(1000 + k, rows[3][1]) for k in range(300)] + [(5, rows[5][1]), (None, rows[6][1])]
    rows += [(2000, None), (2001, [1.0, None]), (2002, [float("nan")] * 12), (2003, [float("inf")] + [0.0] * 11),
             (2004, []), (2005, [1.5, -0.25])]
    df = table(spark, rows).repartition(40)
    assert_rows(wh.whitened(df).collect(), plain(rows))
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "37")  # several rounds
    try:
        assert_rows(wh.whitened(df).collect(), plain(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_without_variance_and_without_rows(spark):
    same = wh.whitened(table(spark, [(k, [1.0, 2.0, 3.0]) for k in range(5)])).collect()
    assert len(same) == 15 and all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["deviation"] == 0
                                   for r in same)
    line = wh.whitened(table(spark, [(k, [float(k), 2.0 * k, 0.0]) for k in range(9)])).collect()
    assert all((r["whitened"] is None) == (r["component"] > 1) for r in line)
    assert all(abs(r["explained"] - (r["component"] == 1)) < 1e-9 and r["identity_error"] < 1e-9 for r in line)
    for rows in ([], [(1, None), (2, [float("nan")])], [(1, [])]):
        assert wh.whitened(table(spark, rows)).count() == 0
    huge = wh.whitened(table(spark, [(1, [3e38, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])])).collect()
    assert len(huge) == 6 and all(r["deviation"] is None for r in huge if r["vec_id"] == 1)
