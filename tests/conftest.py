from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from sightline.scale import session


@pytest.fixture(scope="session")
def spark():
    s = session("tests", "local[8]", **{"spark.sql.shuffle.partitions": 4, "spark.ui.enabled": "false",
                                        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "6g"})
    s.sparkContext.setLogLevel("OFF")
    yield s


@pytest.fixture
def split(spark):
    """Make every group count as large, so that split forms run on tiny tables."""
    spark.conf.set("spark.sightline.maxGroupRows", "5")
    yield
    spark.conf.unset("spark.sightline.maxGroupRows")
