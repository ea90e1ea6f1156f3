"""Pose accuracy, trajectory error and benchmark reports."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.functions.pose import angle_from_trace, direction_angle, dot3, entries
from sightline.operators.ordered import pairs_within, quantiles

THRESHOLDS = (5, 15, 30)
AUC_BINS = 30


def pairs(poses: DataFrame, by: Sequence[str] = ("scene",), order: Sequence[str] = ("name",)) -> DataFrame:
    """All frame pairs of a scene in listing order, as structs ``a`` and ``b``."""
    return pairs_within(poses, by, order)


def auc_share(error: Column, bins: int = AUC_BINS) -> Column:
    """Contribution of one error to the area under the cumulative curve of one-degree bins.

    Bin k counts errors below k and the last bin is closed, so a pair adds one to every bin past its error.
    """
    hit = F.greatest(F.lit(float(bins)) - F.floor(error), F.lit(1.0))
    return F.when(error <= bins, hit / bins).otherwise(F.lit(0.0))


def pair_errors(poses: DataFrame, by: Sequence[str] = ("scene",), order: Sequence[str] = ("name",)) -> DataFrame:
    """Rotation and translation error of every relative pose; needs columns ``gt`` and ``pred``.

    With M = R_gt·R_predᵀ per frame, the trace that gives the rotation error of a pair is the sum of
    products of the two M, and the dot product of the two relative translations is Δgtᵀ·M·Δpred. So all
    matrix products happen once per frame, and a pair costs some thirty multiplications.
    """
    rg, tg = entries(F.col("gt"))
    rp, tp = entries(F.col("pred"))
    m = [F.col(f"m{i}") for i in range(9)]
    frame = poses.select(
        *by, *order, *[dot3(rg[3 * i:3 * i + 3], rp[3 * j:3 * j + 3]).alias(f"m{3 * i + j}") for i in range(3) for j in range(3)],
        *[c.alias(f"g{i}") for i, c in enumerate(tg)], *[c.alias(f"p{i}") for i, c in enumerate(tp)])
    both = pairs(frame, by, order)
    both = both.select(
        *by, *[F.col(f"a.m{i}") for i in range(9)],
        sum((F.col(f"a.m{i}") * F.col(f"b.m{i}") for i in range(1, 9)), F.col("a.m0") * F.col("b.m0")).alias("trace"),
        *[(F.col(f"b.{c}{i}") - F.col(f"a.{c}{i}")).alias(f"d{c}{i}") for c in "gp" for i in range(3)])
    dg, dp = ([F.col(f"d{c}{i}") for i in range(3)] for c in "gp")
    both = both.select(*by, "trace", F.sqrt(dot3(dg, dg)).alias("ng"), F.sqrt(dot3(dp, dp)).alias("np"),
                       dot3(dg, [dot3(m[3 * i:3 * i + 3], dp) for i in range(3)]).alias("dot"))
    return both.select(*by, angle_from_trace(F.col("trace")).alias("rot_err"),
                       direction_angle(F.col("dot"), F.col("ng"), F.col("np")).alias("trans_err"))


def relpose(poses: DataFrame, by: Sequence[str] = ("scene",), order: Sequence[str] = ("name",)) -> DataFrame:
    """Accuracy of relative poses over all pairs of each scene.

    The pairs of a scene are produced block against block and averaged inside the join stage; only one
    partial row per scene and task is shuffled.
    """
    r, t = F.col("rot_err"), F.col("trans_err")
    aggs = [(100 * F.avg(auc_share(F.greatest(r, t)))).alias("auc_30")]
    for thr in THRESHOLDS:
        aggs += [(100 * F.avg((r < thr).cast("double"))).alias(f"racc_{thr}"),
                 (100 * F.avg((t < thr).cast("double"))).alias(f"tacc_{thr}")]
    aggs += [F.avg(r).alias("rmean"), F.avg(t).alias("tmean"), F.count("*").alias("n_pairs")]
    return pair_errors(poses, by, order).groupBy(*by).agg(*aggs)


def with_missing(scenes: DataFrame, metrics: DataFrame, policy: str = "zero",
                 zero: Sequence[str] = ("auc_30", "racc_5", "tacc_5")) -> DataFrame:
    """Scenes without a reconstruction: ``zero`` scores them 0 in ``zero`` columns, ``drop`` leaves them out."""
    if policy == "drop":
        return scenes.select("scene").join(metrics, "scene")
    out = scenes.select("scene").join(metrics.withColumn("_ok", F.lit(True)), "scene", "left")
    out = out.withColumn("status", F.when(F.col("_ok"), "ok").otherwise("missing"))
    return out.withColumns({c: F.when(F.col("_ok"), F.col(c)).otherwise(F.lit(0.0)) for c in zero}).drop("_ok")


def _numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def report(metrics: DataFrame, label: str = "scene") -> DataFrame:
    """One row per scene and an ``AVG`` row of column means, nulls ignored."""
    named = metrics.withColumn(label, F.col(label).cast("string"))
    cols = [c for c in _numeric(named) if c != label]
    rows = named.groupingSets([[F.col(label)], []], F.col(label)).agg(
        F.grouping(label).alias("_total"), *[F.avg(c).alias(c) for c in cols])
    return rows.withColumn(label, F.when(F.col("_total") == 1, F.lit("AVG")).otherwise(F.col(label))).drop("_total")


def macro_report(metrics: DataFrame, category: str, label: str = "scene") -> DataFrame:
    """Mean over scenes per category, then the mean over categories as ``AVG``."""
    cols = [c for c in _numeric(metrics) if c not in (label, category)]
    return report(metrics.groupBy(category).agg(*[F.avg(c).alias(c) for c in cols]), category)


def missing_frames(gt: DataFrame, pred: DataFrame, on: Sequence[str] = ("scene", "name")) -> DataFrame:
    return gt.join(pred, list(on), "left_anti")


def match_frames(gt: DataFrame, pred: DataFrame, on: Sequence[str] = ("scene", "name"),
                 allow_subset: bool = False) -> DataFrame:
    """Ground-truth frames with a finite pose and their prediction; missing ones are an error unless allowed."""
    if not allow_subset:
        gone = missing_frames(gt, pred, on).limit(5).collect()
        if gone:
            raise ValueError(f"ground-truth frames without prediction, e.g. {[tuple(r[k] for k in on) for r in gone]}")
    return gt.where(_finite("gt")).join(pred, list(on))


def _finite(pose: str) -> Column:
    total = F.aggregate(F.concat(f"{pose}.r", f"{pose}.t"), F.lit(0.0), lambda a, v: a + F.abs(v))
    return total.isNotNull() & ~F.isnan(total) & (total < float("inf"))


def coverage(gt: DataFrame, pred: DataFrame, on: Sequence[str] = ("scene", "name")) -> DataFrame:
    """Percentage of ground-truth frames that are finite and predicted."""
    keys = list(on)
    hit = gt.join(pred.select(*keys).withColumn("_hit", F.lit(True)), keys, "left")
    ok = F.col("_hit") & _finite("gt")
    return hit.groupBy(keys[0]).agg((100 * F.count_if(ok) / F.count("*")).alias("coverage"),
                                    F.count_if(ok).alias("n_frames"))


def _solve_similarity(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Closed form of Umeyama (1991) on one row of moments per group, a whole batch at a time."""
    for pdf in batches:
        n = pdf["n"].to_numpy(float)
        mx = np.stack([pdf[f"x{i}"] for i in range(3)], 1)
        my = np.stack([pdf[f"y{i}"] for i in range(3)], 1)
        cov = np.stack([pdf[f"c{i}{j}"] for i in range(3) for j in range(3)], 1).reshape(-1, 3, 3)
        cov = np.nan_to_num(cov - my[:, :, None] * mx[:, None, :])
        var = pdf["xx"].to_numpy(float) - (mx ** 2).sum(1)
        u, d, vt = np.linalg.svd(cov)
        sign = np.ones((len(pdf), 3))
        sign[:, 2] = np.where(np.linalg.det(u) * np.linalg.det(vt) < 0, -1.0, 1.0)
        rot = (u * sign[:, None, :]) @ vt
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = (d * sign).sum(1) / var
        scale = np.where((var > 1e-300) & np.isfinite(scale) & (n > 0), scale, 1.0)
        t = np.nan_to_num(my - scale[:, None] * (rot @ mx[:, :, None])[:, :, 0])
        keep = [c for c in pdf.columns if c.startswith("k_")]
        out = pdf[keep].copy()
        out["r"] = list(rot.reshape(-1, 9))
        out["t"] = list(t)
        out["s"] = scale
        out["n"] = pdf["n"]
        yield out


def umeyama(points: DataFrame, by: Sequence[str]) -> DataFrame:
    """Similarity (R, t, s) per group with ``y ≈ s·R·x + t``, from columns ``x`` and ``y`` (3-arrays).

    Sixteen moments are summed with map-side combine; only one row per group reaches Python.
    """
    by = list(by)
    x = [F.col("x")[i] for i in range(3)]
    y = [F.col("y")[i] for i in range(3)]
    moments = points.groupBy(*[F.col(k).alias(f"k_{k}") for k in by]).agg(
        F.count("*").alias("n"), *[F.avg(x[i]).alias(f"x{i}") for i in range(3)],
        *[F.avg(y[i]).alias(f"y{i}") for i in range(3)],
        *[F.avg(y[i] * x[j]).alias(f"c{i}{j}") for i in range(3) for j in range(3)],
        F.avg(x[0] * x[0] + x[1] * x[1] + x[2] * x[2]).alias("xx"))
    kept = [T.StructField(f.name, f.dataType) for f in moments.schema.fields if f.name.startswith("k_")]
    arr = T.ArrayType(T.DoubleType())
    schema = T.StructType([*kept, T.StructField("r", arr), T.StructField("t", arr),
                           T.StructField("s", T.DoubleType()), T.StructField("n", T.LongType())])
    solved = moments.mapInPandas(_solve_similarity, schema)
    return solved.select(*[F.col(f"k_{k}").alias(k) for k in by], "r", "t", "s", "n")


def align(points: DataFrame, by: Sequence[str]) -> DataFrame:
    """``points`` with ``x`` moved onto ``y`` by the best similarity of its group."""
    by = list(by)
    fit = umeyama(points, by).select(*by, F.col("r").alias("_r"), F.col("t").alias("_t"), F.col("s").alias("_s"))
    moved = F.array(*[F.col("_s") * (F.col("_r")[3 * i] * F.col("x")[0] + F.col("_r")[3 * i + 1] * F.col("x")[1]
                                     + F.col("_r")[3 * i + 2] * F.col("x")[2]) + F.col("_t")[i] for i in range(3)])
    return points.join(fit, by).withColumn("x", moved).drop("_r", "_t", "_s")


def ate(points: DataFrame, by: Sequence[str] = ("scene",), aligned: bool = True) -> DataFrame:
    """Trajectory error statistics of predicted centres ``x`` against true centres ``y``."""
    by = list(by)
    moved = align(points, by) if aligned else points
    sq = [(F.col("x")[i] - F.col("y")[i]) for i in range(3)]
    err = moved.select(*by, F.sqrt(sq[0] * sq[0] + sq[1] * sq[1] + sq[2] * sq[2]).alias("e"))
    stats = err.groupBy(*by).agg(
        F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("ate_rmse"), F.avg("e").alias("ate_mean"),
        F.stddev_pop("e").alias("ate_std"), F.max("e").alias("ate_max"), F.count("*").alias("n_frames"))
    return stats.join(quantiles(err, by, {"ate_median": ("e", 0.5, "cont")}), by)
