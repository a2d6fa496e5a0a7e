"""Ratios and correlations that are null, not an error, where they are undefined."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def correlation(x, y) -> Column:
    """Pearson correlation as an aggregate; null when one side is constant."""
    both = [F.col(c) if isinstance(c, str) else c for c in (x, y)]
    known = both[0].isNotNull() & both[1].isNotNull()
    a, b = [F.when(known, c) for c in both]
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
