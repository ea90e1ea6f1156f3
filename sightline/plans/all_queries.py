"""Imports every query module so that the registry is full."""

from sightline.plans import pixel_queries, pose_queries, retrieval_queries, table_queries, track_queries  # noqa: F401
from sightline.plans.catalog import ORACLES, QUERIES, runner

__all__ = ["ORACLES", "QUERIES", "runner"]
