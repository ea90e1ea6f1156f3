"""Cluster-wide settings every operator relies on.

Three knobs, all read from the Spark session so that a job can change them without code:

* ``spark.checkpoint.dir``: shared folder for intermediate tables of iterative jobs;
* ``spark.sightline.maxGroupRows``: the most rows one key may bring to one task before an
  operator switches to its split form (default one million);
* ``spark.sightline.maxBroadcastBytes``: the largest table an operator ships to every task
  (default 64 MiB); beyond it the operator shuffles instead.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_GROUP_ROWS = 1_000_000
MAX_BROADCAST_BYTES = 64 * 1024 * 1024


def session(name: str = "sightline", master: str | None = None, **conf: object) -> SparkSession:
    """A session with the settings this library is tuned for."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **{k: str(v) for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _setting(spark: SparkSession, key: str, default: str | None) -> str | None:
    value = spark.conf.get(key, None)
    if value is None:
        value = spark.sparkContext.getConf().get(key)
    return default if value is None else value


def max_group_rows(spark: SparkSession) -> int:
    return int(_setting(spark, "spark.sightline.maxGroupRows", str(MAX_GROUP_ROWS)))


def max_broadcast_bytes(spark: SparkSession) -> int:
    return int(_setting(spark, "spark.sightline.maxBroadcastBytes", str(MAX_BROADCAST_BYTES)))


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables; a private one only in local mode."""
    folder = _setting(spark, "spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="sightline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Ends the lineage, survives the loss of executors, fixes values that depend on where a row
    was computed, and gives the next join true table sizes to choose its strategy from.
    """
    path = f"{shared_dir(df.sparkSession)}/sightline/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def has_large_group(df: DataFrame, by: Sequence[str], limit: int | None = None) -> bool:
    """Whether any key holds more than ``limit`` rows (one map-side combined count)."""
    limit = max_group_rows(df.sparkSession) if limit is None else limit
    return not df.groupBy(*by).count().where(F.col("count") > limit).isEmpty()


def row_bytes(df: DataFrame) -> Column:
    """Bytes of a row: 8 for a value of fixed width, else its length, in text form where it is nested."""
    def of(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)):
            return F.lit(8)
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(c), F.lit(0)) + 16
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.NumericType):
            return 8 * F.greatest(F.size(c), F.lit(0)) + 24
        return F.coalesce(F.length(F.to_json(F.struct(c.alias("v")))), F.lit(0)) + 24
    return sum((of(f) for f in df.schema.fields), F.lit(16))


def proven_small(df: DataFrame, least_row_bytes: int = 24) -> bool:
    """Whether the bytes of ``df`` fit the broadcast limit; at most as many rows are looked at as could fit."""
    limit = max_broadcast_bytes(df.sparkSession)
    rows = limit // least_row_bytes
    seen = df.select(row_bytes(df).alias("b")).limit(rows + 1).agg(F.count("*").alias("n"), F.sum("b").alias("b")).first()
    return seen["n"] <= rows and (seen["b"] or 0) <= limit


def broadcast_if_small(df: DataFrame, least_row_bytes: int = 24) -> DataFrame:
    """``df`` with a broadcast hint when its bytes are proven few, else as it is for a shuffled join.

    Meant for dimension tables (cameras, frames), whose size the optimizer often cannot see.
    """
    return F.broadcast(df) if proven_small(df, least_row_bytes) else df


def collect_bounded(df: DataFrame, max_rows: int, what: str) -> list:
    """Rows of a table that must be small by design; raises instead of flooding the driver."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"{what}: more than {max_rows} rows")
    return rows
