"""Loads every module that registers queries."""

from trackframe.plans import registry
from trackframe.plans import (  # noqa: F401
    activity_queries, space_queries, track_queries, trail_queries, cluster_queries, source_queries, mask_queries)

QUERIES, ORACLES = registry.QUERIES, registry.ORACLES
