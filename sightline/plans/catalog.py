"""Registry of named queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.plans.standins import Tables

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def register(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def rnd(c: Column | str, name: str | None = None, digits: int = 6) -> Column:
    """Rounded double without negative zero."""
    col = F.col(c) if isinstance(c, str) else c
    out = F.round(col.cast("double"), digits) + F.lit(0.0)
    return out.alias(name or c) if (name or isinstance(c, str)) else out


def runner(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return QUERIES[name](Tables(spark, sf_dir))
    run.__name__ = name
    return run
