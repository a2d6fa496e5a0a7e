"""Exact percentiles of groups with outliers."""

import random

import numpy as np
import pytest

from trackframe.functions import ordering


def some_groups():
    rnd = random.Random(4)
    return {"plain": [rnd.random() for _ in range(300)], "outlier": [rnd.random() for _ in range(400)] + [1e18],
            "scales": [10.0 ** rnd.uniform(-3, 3) for _ in range(300)], "ends": [-1.7e308, 1.7e308, *range(50)],
            "ties": [2.0] * 90 + [3.0] * 10, "one": [7.0], "two": [1.0, 2.0]}


@pytest.mark.parametrize("share", [0.0, 0.7, 1.0])
def test_ranges_are_divided_until_they_are_small(spark, share):
    groups = some_groups()
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("none", None), ("plain", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r["percentile"] for r in ordering.exact_percentile(df, ["g"], "v", share, buckets=64, most=32).collect()}
    assert got.keys() == groups.keys()
    for g, values in groups.items():
        assert got[g] == pytest.approx(float(np.quantile(np.array(values, dtype=float), share)), rel=1e-9, abs=1e-12), g


def test_an_outlier_does_not_put_all_others_in_one_sort(spark, monkeypatch):
    wanted = []
    cut = ordering.cut_lineage

    def seen(df):
        out = cut(df)
        if "_values" in out.columns:
            wanted.append(max(r["_values"] for r in out.collect()))
        return out

    monkeypatch.setattr(ordering, "cut_lineage", seen)
    df = spark.range(5000).selectExpr("id / 5000.0D AS v").unionByName(spark.range(1).selectExpr("1e18D AS v"))
    got = ordering.exact_percentile(df, [], "v", 0.25, most=100).first()["percentile"]
    assert got == pytest.approx(1250 / 5000)
    assert wanted[0] == 5000 and wanted[-1] <= 100
