"""Exact p-values of U against all orders of the values."""

import itertools

import pytest
from pyspark.sql import functions as F

from trackframe.operators import statistics as st


def plain(a, b):
    every = sorted(a + b)

    def u(part):
        return sum(x > y for x in part for y in every if y not in part)

    far = max(u(a), len(a) * len(b) - u(a))
    counts = [u(list(c)) for c in itertools.combinations(every, len(a))]
    return min(1.0, 2 * sum(c >= far for c in counts) / len(counts))


def test_p_values_equal_enumeration(spark):
    groups = {0: ([1.0, 4.0, 6.0], [2.0, 3.0, 9.0]), 1: ([1.0, 2.0, 3.0, 4.0], [5.0, 6.0, 7.0]), 2: ([5.0], [1.0]),
              3: ([1.0, 3.0, 5.0, 7.0, 9.0, 11.0], [2.0, 4.0, 6.0, 8.0, 10.0, 12.5]), 4: ([8.0, 7.0], [1.0, 2.0, 3.0, 4.0, 5.0, 6.0])}
    rows = [(g, *pair) for g, (a, b) in groups.items() for pair in itertools.zip_longest(a, b)]
    rows += [(8, 1.0, 1.0), (8, 2.0, 3.0), (9, 1.0, None)] + [(10, float(i), i + 0.5) for i in range(9)]
    df = spark.createDataFrame(rows, "g int, away double, toward double")
    got = {r["g"]: r["p_value"] for r in st.mann_whitney_test(df, ["g"]).collect()}
    for g, (a, b) in groups.items():
        assert got[g] == pytest.approx(plain(a, b), abs=1e-12)
    normal = {r["g"]: r["p"] for r in st.mann_whitney_u(df, ["g"]).select("g", st.normal_p_value(F.col("z")).alias("p")).collect()}
    assert got[8] == normal[8] and got[10] == normal[10]
