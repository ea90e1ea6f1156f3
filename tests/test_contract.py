"""Registered queries against their SQL twins on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, canon

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


# one query per family; tools/check.py compares all of them
@pytest.mark.parametrize("name", [
    "relative_pose_report", "nearest_asof_join", "interpolate_trajectory", "track_points", "match_graph", "duplicated_tracks",
    "robust_loss_and_weight", "trimmed_reprojection_score", "inverted_index_scores", "retrieve_diverse_max", "depth_carving",
    "floating_outliers_removed", "suppressed_keypoints", "tracks_from_flows", "resize_to_aspect_ratio"])
def test_query_equals_sql(spark, con, name):
    got = canon(entry.queries()[name](spark, SF).toPandas())
    want = canon(con.execute(entry.oracle_sql()[name]).fetchdf())
    assert list(got.columns) == list(want.columns)
    assert got.equals(want), (got != want).any()


@pytest.mark.parametrize("name", ["focal_from_depth", "running_image_size", "points_within_budget",
                                  "nearest_asof_join", "every_nth_frame", "trajectory_segments", "relative_pose_accuracy"])
def test_split_form_gives_the_same_result(spark, con, name):
    """The forms for groups too large for one task, forced on every group."""
    spark.conf.set("spark.sightline.maxGroupRows", "20")
    try:
        got = canon(entry.queries()[name](spark, SF).toPandas())
    finally:
        spark.conf.unset("spark.sightline.maxGroupRows")
    want = canon(con.execute(entry.oracle_sql()[name]).fetchdf())
    assert got.equals(want)
