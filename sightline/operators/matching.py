"""Dense matches: best candidates, repeatability, keypoints and tracks from flow.

``flows(src, tgt, px, py, qx, qy, score)`` maps a source pixel to a target position; a score of zero or an
absent row is undefined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.operators.grid import sample_array
from sightline.operators.ordered import top_k
from sightline.scale import cut


def best_match(cand: DataFrame, by: Sequence[str], score: str, ties: Sequence[str], values: Sequence[str],
               null_score: float | None = None) -> DataFrame:
    """Best candidate per key, first by ``ties`` on equal score.

    With ``null_score`` the null match takes part as one more candidate: where it is strictly better the
    values are null and the score is the null score.
    """
    best = cand.groupBy(*by).agg(F.min_by(F.struct(score, *values), F.struct((-F.col(score)).alias("_s"), *ties)).alias("_b"))
    out = best.select(*by, *[F.col(f"_b.{c}").alias(c) for c in (score, *values)])
    if null_score is None:
        return out
    ok = F.col(score) >= null_score
    return out.select(*by, F.when(ok, F.col(score)).otherwise(F.lit(null_score)).alias(score),
                      *[F.when(ok, F.col(v)).alias(v) for v in values])


def latest(*passes: DataFrame, by: Sequence[str] = ("src", "tgt", "px", "py")) -> DataFrame:
    """Union of flow tables where a later pass overwrites an earlier one."""
    cols = [c for c in passes[0].columns if c not in by]
    rows = None
    for n, p in enumerate(passes):
        q = p.select(*by, F.struct(*cols).alias("_v"), F.lit(n).alias("_pass"))
        rows = q if rows is None else rows.unionByName(q)
    return rows.groupBy(*by).agg(F.max_by("_v", "_pass").alias("_v")).select(*by, "_v.*")


def repeatability(flows: DataFrame) -> DataFrame:
    """Sum of the match scores of a source pixel over all targets."""
    return flows.groupBy("src", "px", "py").agg(F.sum("score").alias("score"))


def identity_flow(frames: DataFrame, unit: int = 255) -> DataFrame:
    """Every pixel of a frame matched to its own centre with full score."""
    rows = frames.select(F.col("img_id").alias("src"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("height").cast("long") - 1)).alias("py"), "width")
    rows = rows.select("src", F.col("src").alias("tgt"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("width").cast("long") - 1)).alias("px"), "py")
    return rows.select("src", "tgt", "px", "py", (F.col("px") + 0.5).alias("qx"), (F.col("py") + 0.5).alias("qy"), F.lit(unit).alias("score"))


def nms(peaks: DataFrame, k: int, max_points: int | None = None, by: Sequence[str] = ("src",), score: str = "score") -> DataFrame:
    """Greedy non-maximum suppression: by falling score, each kept peak removes others within k//2 (Chebyshev).

    Ties go to the smaller (py, px). In each round a peak without a stronger undecided neighbour is kept and
    its neighbours go, which gives the same set as the sequential loop. Neighbours meet in grid cells of the
    window size.
    """
    by, r = list(by), k // 2
    size = r + 1
    rank = F.struct((-F.col(score)).alias("s"), F.col("py"), F.col("px"))
    base = peaks.select(*by, "px", "py", score, rank.alias("_k"),
                        F.floor(F.col("px") / size).alias("_cx"), F.floor(F.col("py") / size).alias("_cy"))
    near = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    strong = base.select(*by, F.explode(near).alias("_d"), F.col("_k").alias("_kb"), "_cx", "_cy").select(
        *by, "_kb", (F.col("_cx") + F.col("_d.a")).alias("_cx"), (F.col("_cy") + F.col("_d.b")).alias("_cy"))
    beats = (base.join(strong, [*by, "_cx", "_cy"]).where(F.col("_kb") < F.col("_k"))
             .where((F.abs(F.col("_kb.px") - F.col("px")) <= r) & (F.abs(F.col("_kb.py") - F.col("py")) <= r)))
    # weak peak (px, py) has the stronger neighbour (bx, by_)
    edges = cut(beats.select(*by, "px", "py", F.col("_kb.px").alias("_bx"), F.col("_kb.py").alias("_by")))
    todo = cut(base.select(*by, "px", "py", score))
    here, there = [*by, "px", "py"], [*by, "_bx", "_by"]
    kept = []
    while True:  # the strongest peak left is kept in each round, so the rounds end
        keep = cut(todo.join(edges.select(*here).distinct(), here, "left_anti"))
        kept.append(keep)
        as_b = keep.select(*by, F.col("px").alias("_bx"), F.col("py").alias("_by"))
        gone = edges.join(as_b, there, "left_semi").select(*here).distinct()
        left = cut(todo.join(keep.select(*here), here, "left_anti").join(gone, here, "left_anti"))
        if left.isEmpty():
            break
        alive = left.select(*here)
        edges = cut(edges.join(alive, here, "left_semi").join(
            alive.select(*by, F.col("px").alias("_bx"), F.col("py").alias("_by")), there, "left_semi"))
        todo = left
    out = kept[0]
    for more in kept[1:]:
        out = out.unionByName(more)
    if max_points is not None:
        out = top_k(out, by, [F.col(score).desc(), F.col("py"), F.col("px")], max_points)
    return out


def local_zoom(flows: DataFrame, kpts: DataFrame, sizes: DataFrame) -> DataFrame:
    """(src, tgt, px, py, qx, qy, score, zoom): flow at keypoints with its local linear scale.

    Central differences, clamped at the image border; the scale is √max(det J, 0), and 0 where a needed
    neighbour is undefined. ``sizes`` is (src, width, height). Keypoints are few, so only they are spread to
    their neighbours and met with the flow once.
    """
    ends = kpts.select("src", "px", "py").join(sizes, "src").select(
        "src", F.col("px").alias("kx"), F.col("py").alias("ky"),
        F.greatest(F.col("px") - 1, F.lit(0)).alias("x0"), F.least(F.col("px") + 1, F.col("width") - 1).alias("x1"),
        F.greatest(F.col("py") - 1, F.lit(0)).alias("y0"), F.least(F.col("py") + 1, F.col("height") - 1).alias("y1"))
    spots = {"c": ("kx", "ky"), "l": ("x0", "ky"), "r": ("x1", "ky"), "u": ("kx", "y0"), "d": ("kx", "y1")}
    parts = F.array(*[F.struct(F.lit(n).alias("n"), F.col(x).alias("px"), F.col(y).alias("py")) for n, (x, y) in spots.items()])
    want = ends.withColumn("_p", F.explode(parts)).select("src", "kx", "ky", "x0", "x1", "y0", "y1",
                                                          F.col("_p.n").alias("n"), F.col("_p.px").alias("px"), F.col("_p.py").alias("py"))
    hit = want.join(flows.select("src", "tgt", "px", "py", "qx", "qy", "score"), ["src", "px", "py"])
    pick = lambda n, c: F.max(F.when(F.col("n") == n, F.col(c)))
    valid = lambda n, c: F.max(F.when((F.col("n") == n) & (F.col("score") > 0), F.col(c)))
    wide = hit.groupBy("src", "tgt", "kx", "ky", "x0", "x1", "y0", "y1").agg(
        *[valid(n, q).alias(f"{n}{q}") for n in spots for q in ("qx", "qy")], pick("c", "score").alias("score"))
    wx, wy = F.nullif(F.col("x1") - F.col("x0"), F.lit(0)), F.nullif(F.col("y1") - F.col("y0"), F.lit(0))
    diff = lambda q: ((F.col(f"r{q}") - F.col(f"l{q}")) / wx, (F.col(f"d{q}") - F.col(f"u{q}")) / wy)
    (xx, xy), (yx, yy) = diff("qx"), diff("qy")
    det = xx * yy - xy * yx
    zoom = F.coalesce(F.sqrt(F.greatest(det, F.lit(0.0))), F.lit(0.0))
    zoom = F.when(det.isNull(), F.lit(0.0)).otherwise(zoom)
    return wide.where(F.col("score").isNotNull()).select(
        "src", "tgt", F.col("kx").alias("px"), F.col("ky").alias("py"), F.col("cqx").alias("qx"), F.col("cqy").alias("qy"),
        "score", zoom.alias("zoom"))


def tracks_from_flows(kpts: DataFrame, flows: DataFrame, sizes: DataFrame, min_len: int = 2, remove_far: bool = True) -> DataFrame:
    """(src, px, py, img_id, u, v, scale): track cells of each keypoint in every image its flow defines.

    Tracks need a positive scale in ``min_len`` images; with ``remove_far`` also the largest scale in their
    own frame.
    """
    rows = local_zoom(flows, kpts, sizes).where(F.col("score") > 0).select(
        "src", "px", "py", F.col("tgt").alias("img_id"), F.col("qx").alias("u"), F.col("qy").alias("v"), F.col("zoom").alias("scale"))
    key = ["src", "px", "py"]
    good = rows.groupBy(*key).agg(F.count_if(F.col("scale") > 0).alias("_n"), F.min_by("img_id", _zoom_order()).alias("_best"))
    good = good.where(F.col("_n") >= min_len)
    if remove_far:
        good = good.where(F.col("_best") == F.col("src"))
    return rows.join(good.select(*key), key, "left_semi")


def _zoom_order():
    return F.struct((-F.col("scale")).alias("z"), F.col("img_id"))


def remove_far(rows: DataFrame, track: Sequence[str], own: str) -> DataFrame:
    """Tracks whose scale is largest in the frame they were found in (first image on ties)."""
    best = rows.groupBy(*track).agg(F.min_by("img_id", _zoom_order()).alias("_best"), F.first(own).alias("_own"))
    return rows.join(best.where(F.col("_best") == F.col("_own")).select(*track), list(track), "left_semi")


def gather(tracks: DataFrame, grid: DataFrame, sizes: DataFrame, dim: int, on_short: str = "error") -> DataFrame:
    """Observations of valid track cells with depth channels sampled at their position.

    ``tracks`` is (scene, track_id, img_id, u, v) and ``grid`` has an array ``dep`` per pixel. Standard
    deviations default to 1. A track in a single image is an error, or is dropped with ``on_short='drop'``.
    """
    ok = F.col("u").isNotNull() & F.col("v").isNotNull() & ~F.isnan("u") & ~F.isnan("v") & (F.abs("u") < float("inf")) & (F.abs("v") < float("inf"))
    cells = tracks.where(ok)
    short = cells.groupBy("scene", "track_id").count().where("count < 2").select("scene", "track_id")
    if on_short == "drop":
        cells = cells.join(short, ["scene", "track_id"], "left_anti")
    elif not short.isEmpty():
        raise ValueError("some tracks are seen in fewer than two images")
    keys = ["scene", "track_id", "img_id"]
    dep = sample_array(grid, cells.join(sizes, ["scene", "img_id"]), keys, "dep", dim)
    return cells.join(dep, keys).select(*keys, "u", "v", F.lit(1.0).alias("su"), F.lit(1.0).alias("sv"), "dep")
