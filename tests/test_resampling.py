"""Bootstrap draws against a plain version, with groups of many chunks."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tests.test_plans import plan
from trackframe.operators import resampling as rs


def plain(values, resamples):
    """{(group, resample): mean} of {group: values by position}, nulls left out."""
    out = {}
    for g, held in values.items():
        for b in range(resamples):
            got = [held[int(hashlib.md5(f"{g}|{b}|{i}".encode()).hexdigest()[:8], 16) % len(held)] for i in range(len(held))]
            known = [v for v in got if v is not None]
            out[g, b] = sum(known) / len(known) if known else None
    return out


@pytest.mark.parametrize("chunk", [1, 4, 7, 65_536])
def test_means_equal_plain_draws(spark, chunk):
    rng = random.Random(chunk)
    values = {g: [None if g == 2 and rng.random() < 0.3 else round(rng.random(), 3) for _ in range(n)]
              for g, n in ((1, 1), (2, 13), (3, 29))} | {4: [None, None]}
    rows = [(g, k, v, 2.0) for g, held in values.items() for k, v in enumerate(held)]
    df = spark.createDataFrame(rows, "g long, k long, v double, w double").repartition(5)
    got = {(r["g"], r["resample"]): r for r in rs.bootstrap_means(df, ["g"], ["v", "w"], ["k"], 40, chunk).collect()}
    want = plain(values, 40)
    assert got.keys() == want.keys()
    for key, mean in want.items():
        assert (got[key]["v"] is None) == (mean is None) and got[key]["w"] == 2.0
        assert mean is None or abs(got[key]["v"] - mean) < 1e-12


def test_draws_are_neither_joined_nor_broadcast(spark):
    df = spark.range(300).select((F.col("id") % 3).alias("g"), "id", F.rand(1).alias("v"))
    text = plan(rs.intervals(rs.bootstrap_means(df, ["g"], ["v"], ["id"], 100), ["g"], ["v"]))
    tree = text.split("\n\n")[0]
    assert "md5(" in text and tree.count("Join") == 1  # positions meet the sizes of blocks, below the draws
    assert "Join" not in tree[:tree.index("Generate")]
