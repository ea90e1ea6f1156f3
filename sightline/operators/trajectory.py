"""Trajectories: time association, interpolation, rebasing and frame selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions.pose import identity, relative
from sightline.operators.ordered import Blocks, blocks, carry, neighbour, row_number


def _same(l: str, r: str, by: Sequence[str]) -> list:
    return [F.col(f"{l}.{k}").eqNullSafe(F.col(f"{r}.{k}")) for k in by]


def nearest_asof(left: DataFrame, right: DataFrame, on: str, by: Sequence[str], max_dt: float,
                 right_id: str) -> DataFrame:
    """Each left row with the right row nearest in ``on``, kept when strictly closer than ``max_dt``.

    Ties go to the earlier right row, then to the smaller ``right_id``. Both sides are laid out along
    ``on`` and carry the last and the next right row, so no pair of rows is ever formed.
    """
    by = list(by)
    theirs = [c for c in right.columns if c not in (*by, on)]
    packed = right.groupBy(*by, on).agg(F.min_by(F.struct(F.col(on).alias("_t"), *theirs), right_id).alias("_r"))
    mine = left.select(*by, on, F.struct(*left.columns).alias("_l"), F.lit(1).alias("_side"))
    both = mine.unionByName(packed.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    b = blocks(both, by, [on, "_side"])
    prev = carry(b, {"_prev": F.col("_r")})
    out = carry(Blocks(prev, b.by, b.order, b.split), {"_next": F.col("_r")}, reverse=True).where("_side = 1")
    before, after = F.col(on) - F.col("_prev._t"), F.col("_next._t") - F.col(on)
    use_prev = F.col("_next").isNull() | (before <= after)
    match = F.when(F.col("_prev").isNotNull() & use_prev, F.col("_prev")).otherwise(F.col("_next"))
    out = out.select("_l", match.alias("_m"), F.col(on).alias("_on"))
    return (out.withColumn("gap", F.abs(F.col("_m._t") - F.col("_on"))).where(F.col("gap") < max_dt)
            .select("_l.*", F.col("_m._t").alias(f"{on}_right"), *[F.col(f"_m.{c}").alias(c) for c in theirs], "gap"))


def interpolate(pred: DataFrame, gt: DataFrame, on: str = "ts", by: Sequence[str] = ("scene",)) -> DataFrame:
    """Predicted pose at every ground-truth time: linear position, extrapolated at both ends.

    Rotations become identity, except in scenes whose predicted and true times are the same set, which
    keep their poses as they are. A scene with a single prediction gives nulls.
    """
    by = list(by)
    b = blocks(pred.select(*by, on, "pose"), by, [on])
    seg = neighbour(b, {"_t1": F.col(on), "_p1": F.col("pose.t")}, reverse=True)
    seg = seg.select(*by, on, F.col("pose").alias("_pose"),
                     F.when(F.col("_t1").isNotNull(),
                            F.struct(F.col(on).alias("t0"), F.col("pose.t").alias("p0"),
                                     F.col("_t1").alias("t1"), F.col("_p1").alias("p1"))).alias("_seg"))
    mine = gt.select(*by, on, F.struct(*[c for c in gt.columns if c not in (*by, on)]).alias("_l"),
                     F.lit(1).alias("_side"))
    both = mine.unionByName(seg.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    times = both.groupBy(*by, on).agg(F.count_if(F.col("_side") == 1).alias("g"), F.count_if(F.col("_side") == 0).alias("p"))
    same = times.groupBy(*by).agg(F.bool_and((F.col("g") > 0) & (F.col("p") > 0)).alias("_same"))
    b = blocks(both, by, [on, "_side"])
    prev = carry(b, {"_before": F.col("_seg"), "_own": F.col("_pose")})
    out = carry(Blocks(prev, b.by, b.order, b.split), {"_after": F.col("_seg")}, reverse=True).where("_side = 1")
    out = out.withColumn("_s", F.coalesce("_before", "_after")).alias("l").join(same.alias("r"), _same("l", "r", by))
    w = (F.col(on) - F.col("_s.t0")) / (F.col("_s.t1") - F.col("_s.t0"))
    pos = F.transform(F.zip_with("_s.p0", "_s.p1", lambda a, c: F.struct(a.alias("a"), c.alias("c"))),
                      lambda v: v["a"] + (v["c"] - v["a"]) * w)
    pose = F.when(F.col("_same"), F.col("_own")).otherwise(F.struct(identity()["r"].alias("r"), pos.alias("t")))
    return out.select(*[F.col(f"l.{k}") for k in by], on, "_l.*", pose.alias("pred_pose"))


def rebase_first(poses: DataFrame, by: Sequence[str] = ("scene",), order: Sequence[str] = ("idx",)) -> DataFrame:
    """Poses relative to the first frame of the scene, which becomes exactly identity."""
    by = list(by)
    first = poses.groupBy(*by).agg(F.min_by(F.struct(F.struct(*order).alias("k"), "pose"),
                                            F.struct(*order)).alias("_first"))
    joined = poses.alias("l").join(first.alias("r"), _same("l", "r", by))
    is_first = F.struct(*[F.col(f"l.{c}") for c in order]) == F.col("_first.k")
    rebased = F.when(is_first, identity()).otherwise(relative(F.col("_first.pose"), F.col("l.pose")))
    return joined.select(*[F.col(f"l.{c}") for c in poses.columns if c != "pose"], rebased.alias("pose"))


def every_nth(frames: DataFrame, n: int, by: Sequence[str] = ("scene",), order: Sequence[str] = ("name",)) -> DataFrame:
    """Frames 0, n, 2n, … of each scene."""
    return row_number(frames, by, order, "_rn").where((F.col("_rn") - 1) % n == 0).drop("_rn")


def last_k(frames: DataFrame, k: int, by: Sequence[str] = ("scene",), idx: str = "idx") -> DataFrame:
    """(query, past frame) for the k frames before each frame; ``idx`` counts frames without gaps."""
    cols = [*by, idx]
    query = frames.select(*by, F.col(idx).alias("query"), F.explode(F.sequence(
        F.greatest(F.col(idx) - k, F.lit(1)), F.col(idx) - 1)).alias(idx)) if k > 0 else None
    if query is None:
        return frames.select(*by, F.col(idx).alias("query"), idx).limit(0)
    return query.where(F.col(idx) < F.col("query")).join(frames.select(*cols), cols)


def segments(poses: DataFrame, by: Sequence[str] = ("scene",), order: Sequence[str] = ("idx",)) -> DataFrame:
    """Consecutive camera centres."""
    b = blocks(poses, by, order)
    nxt = neighbour(b, {"next_t": F.col("pose.t")}, reverse=True).where(F.col("next_t").isNotNull())
    return nxt.select(*by, *order, F.col("pose.t").alias("from_t"), F.col("next_t").alias("to_t"))


def frame_range(frames: DataFrame, first: int, last: int, idx: str = "idx") -> DataFrame:
    return frames.where(F.col(idx).between(first, last))


def only(scenes: DataFrame, names: Sequence[str], column: str = "scene") -> DataFrame:
    """Rows of the listed scenes, sequences or categories."""
    return scenes.where(F.col(column).isin(list(names)))
