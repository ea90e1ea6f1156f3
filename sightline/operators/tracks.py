"""Track observations: star join, 3-D points, redundancy, inclusion, robust residuals and set operations.

Tables: ``obs(scene, img_id, track_id, u, v, dep)``, ``images(scene, img_id, cam_id, node_id, scale, z_coefs)``,
``cameras(scene, cam_id, fx, fy, cx, cy, rig2cam)``, ``nodes(scene, node_id, w2rig)``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.camera import combine_depth, project, scale_depth, unproject
from sightline.functions.pose import pose_inv, pose_mul, transform
from sightline.operators.ordered import BLOCK, blocks, pair_partitions, pairs_within, row_number, running_sum, top_k
from sightline.scale import broadcast_if_small, cut

TRACK_BIN = 16  # pixels
MIN_SHARED = 3  # fewer shared tracks do not make an edge
IMAGE_BLOCK = 1024  # images whose cells of a track are made at once
K_COLS = ("fx", "fy", "cx", "cy")


# ------------------------------------------------------------------ star schema
def image_params(images: DataFrame, cameras: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row per image with intrinsics and world-to-camera pose."""
    star = images.join(cameras, ["scene", "cam_id"]).join(nodes, ["scene", "node_id"])
    return star.withColumn("w2cam", pose_mul(F.col("rig2cam"), F.col("w2rig")))


def denormalise(obs: DataFrame, images: DataFrame, cameras: DataFrame, nodes: DataFrame) -> DataFrame:
    """Observations with the parameters of their image; the dimension tables meet first, so ``obs`` moves once."""
    return obs.join(broadcast_if_small(image_params(images, cameras, nodes)), ["scene", "img_id"])


def observed_depth(mode: str = "log") -> Column:
    """Depth of an observation from coefficients, or from the plain scale where there are none."""
    return F.coalesce(combine_depth(F.col("dep"), F.col("z_coefs"), mode), scale_depth(F.col("dep"), F.col("scale"), mode))


def apply_params(images: DataFrame, cameras: DataFrame, nodes: DataFrame, pixels: DataFrame | None = None,
                 mode: str = "log") -> DataFrame:
    """Refined cameras per image, and the combined depth per pixel when ``pixels`` (with ``dep``) is given."""
    params = image_params(images, cameras, nodes).withColumn("cam2w", pose_inv(F.col("w2cam")))
    if pixels is None:
        return params.select("scene", "img_id", *K_COLS, "cam2w")
    rows = pixels.join(broadcast_if_small(params), ["scene", "img_id"])
    return rows.select(*pixels.columns, *K_COLS, "cam2w", observed_depth(mode).alias("depth"))


def unproject_obs(obs: DataFrame, cams: DataFrame) -> DataFrame:
    """3-D points of observations with a ``depth``; ``cams`` has intrinsics and optionally ``cam2w``."""
    rows = obs.join(broadcast_if_small(cams), ["scene", "img_id"])
    p = unproject(F.col("u"), F.col("v"), F.col("depth"), {k: F.col(k) for k in K_COLS}, offset=0.0)
    if "cam2w" in cams.columns:
        rows = rows.withColumns(dict(zip(("_x", "_y", "_z"), p)))
        p = transform(F.col("cam2w"), F.col("_x"), F.col("_y"), F.col("_z"))
    return rows.select(*obs.columns, *[c.alias(n) for c, n in zip(p, "xyz")])


def track_points(obs: DataFrame, images: DataFrame, cameras: DataFrame, nodes: DataFrame, mode: str = "log") -> DataFrame:
    """Mean 3-D position of each track over its images."""
    cams = apply_params(images, cameras, nodes)
    zs = images.select("scene", "img_id", "scale", "z_coefs")
    dims = broadcast_if_small(cams.join(zs, ["scene", "img_id"]))
    rows = obs.join(dims, ["scene", "img_id"]).withColumn("depth", observed_depth(mode))
    p = unproject(F.col("u"), F.col("v"), F.col("depth"), {k: F.col(k) for k in K_COLS}, offset=0.0)
    rows = rows.select("scene", "track_id", "cam2w", *[c.alias(n) for c, n in zip(p, ("_x", "_y", "_z"))])
    w = transform(F.col("cam2w"), F.col("_x"), F.col("_y"), F.col("_z"))
    return rows.groupBy("scene", "track_id").agg(*[F.avg(c).alias(n) for c, n in zip(w, "xyz")])


# ------------------------------------------------------------------ co-visibility
def shared_tracks(obs: DataFrame) -> DataFrame:
    """(i, j, n_matches) for image pairs i < j that see common tracks.

    Image pairs of a track are counted inside the join stage, so only partial counts per image pair move.
    """
    p = pairs_within(obs.select("scene", "track_id", "img_id"), ["scene", "track_id"], ["img_id"])
    return p.groupBy("scene", F.col("a.img_id").alias("i"), F.col("b.img_id").alias("j")).agg(
        F.count("*").alias("n_matches"))


def match_graph(obs: DataFrame, min_shared: int = MIN_SHARED) -> DataFrame:
    return shared_tracks(obs).where(F.col("n_matches") >= min_shared)


def common_tracks(obs: DataFrame, i: int, j: int) -> DataFrame:
    """Tracks seen by both images of one pair."""
    a, b = (obs.where(F.col("img_id") == k).select("scene", "track_id") for k in (i, j))
    return a.intersect(b)


def matches(obs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pixels (ui, vi, uj, vj) of the tracks shared by the listed image pairs (scene, i, j)."""
    a = obs.select("scene", F.col("img_id").alias("i"), "track_id", F.col("u").alias("ui"), F.col("v").alias("vi"))
    b = obs.select("scene", F.col("img_id").alias("j"), "track_id", F.col("u").alias("uj"), F.col("v").alias("vj"))
    return pairs.select("scene", "i", "j").join(a, ["scene", "i"]).join(b, ["scene", "j", "track_id"])


def attach_last(obs: DataFrame) -> DataFrame:
    """The past image that shares most tracks with the newest image of each scene (smallest id on ties)."""
    return attach_frames(obs, obs.groupBy("scene").agg(F.max("img_id").alias("j")))


def attach_frames(obs: DataFrame, frames: DataFrame) -> DataFrame:
    """The past image that shares most tracks with each image ``j`` of ``frames`` (scene, j); smallest id on ties."""
    mine = obs.withColumnRenamed("img_id", "j").join(frames, ["scene", "j"], "left_semi").select("scene", "j", "track_id")
    past = obs.select("scene", "track_id", F.col("img_id").alias("i")).join(mine, ["scene", "track_id"])
    counts = past.where(F.col("i") < F.col("j")).groupBy("scene", "j", "i").agg(F.count("*").alias("n_matches"))
    best = F.max_by(F.struct("i", "n_matches"), F.struct("n_matches", (-F.col("i")).alias("k")))
    return counts.groupBy("scene", "j").agg(best.alias("b")).select("scene", "j", "b.i", "b.n_matches")


def covisibility(obs: DataFrame, approximate: bool = False) -> DataFrame:
    """Observations, images and tracks per scene and the mean track length."""
    if approximate:
        return obs.groupBy("scene").agg(F.count("*").alias("n_obs"), F.approx_count_distinct("img_id").alias("n_images"),
                                        F.approx_count_distinct("track_id").alias("n_tracks"))
    tracks = obs.groupBy("scene", "track_id").agg(F.count("*").alias("n"))
    imgs = obs.groupBy("scene", "img_id").agg(F.lit(1).alias("one")).groupBy("scene").agg(F.count("*").alias("n_images"))
    out = tracks.groupBy("scene").agg(F.sum("n").alias("n_obs"), F.count("*").alias("n_tracks"),
                                      F.max("n").alias("longest"), F.avg("n").alias("mean_length"))
    return out.join(imgs, "scene")


# ------------------------------------------------------------------ redundancy
def bin_counts(obs: DataFrame, bin_size: int = TRACK_BIN) -> DataFrame:
    """2-D histogram of observations per image."""
    return (obs.select("scene", "img_id", F.floor(F.floor("u") / bin_size).alias("bx"), F.floor(F.floor("v") / bin_size).alias("by"))
            .groupBy("scene", "img_id", "bx", "by").agg(F.count("*").alias("n")))


def redundancy(obs: DataFrame, bin_size: int = TRACK_BIN) -> DataFrame:
    """Per track, the smallest bin count among its images."""
    rows = obs.select("scene", "img_id", "track_id", F.floor(F.floor("u") / bin_size).alias("bx"),
                      F.floor(F.floor("v") / bin_size).alias("by"))
    hist = bin_counts(obs, bin_size)
    return (rows.join(hist, ["scene", "img_id", "bx", "by"])
            .groupBy("scene", "track_id").agg(F.min("n").alias("score")))


def redundant_tracks(obs: DataFrame, num_keep: int, bin_size: int = TRACK_BIN, subsample: int | None = None) -> DataFrame:
    """Tracks to drop: those past the ``num_keep`` least redundant that share every bin with another track."""
    ranked = row_number(redundancy(obs, bin_size), ["scene"], ["score", "track_id"], "_rn")
    out = ranked.where((F.col("_rn") > num_keep) & (F.col("score") > 1)).select("scene", "track_id")
    if subsample:
        # a hash of the id replaces the random draw, so reruns drop the same tracks
        out = top_k(out, ["scene"], [F.xxhash64("track_id"), F.col("track_id")], subsample)
    return out


def cap_tracks(obs: DataFrame, num_keep: int, bin_size: int = TRACK_BIN, subsample: int | None = None) -> DataFrame:
    """Drop redundant tracks until each scene fits the cap or nothing redundant is left.

    With ``subsample`` so many tracks go in a round; every round takes at least one from each scene above the cap that has
    one to give, so the rounds end.
    """
    if not subsample:
        return remove_tracks(obs, redundant_tracks(obs, num_keep, bin_size))
    while True:
        drop = cut(redundant_tracks(obs, num_keep, bin_size, subsample))
        if drop.isEmpty():
            return obs
        obs = cut(remove_tracks(obs, drop))


# ------------------------------------------------------------------ inclusion
def duplicated(old: DataFrame, new: DataFrame, thr: float = 5.0) -> DataFrame:
    """Old tracks that some new track covers: present in all their images, strictly closer than ``thr``.

    ``(scene, img_id, track_id)`` is unique on either side. A track seen in one image is covered where a new observation
    lies near, whichever; equal positions are looked up once, and those with a new one in their cell of side ``thr / 2`` need
    no look around. A longer track meets the new tracks that share two of its images, those in its emptiest
    neighbourhoods, with cells of both in one key; its other images just verify what is near in both.
    """
    half, wide = thr / 2, 2 * thr
    place = ["scene", "img_id", "cx", "cy"]

    def cells(side: float, u: str = "u", v: str = "v") -> dict[str, Column]:
        return {"cx": F.floor(F.col(u) / side), "cy": F.floor(F.col(v) / side)}

    def close(a: str, b: str) -> Column:
        return (F.col(f"u{a}") - F.col(f"u{b}")) ** 2 + (F.col(f"v{a}") - F.col(f"v{b}")) ** 2 < thr * thr

    around = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]))
    spread = lambda df: df.withColumn("_d", around).withColumns({"cx": F.col("cx") + F.col("_d.dx"), "cy": F.col("cy") + F.col("_d.dy")}).drop("_d")
    rows = cut(old.select("scene", "img_id", F.col("track_id").alias("old_id"), "u", "v"))
    fresh = cut(new.select("scene", "img_id", F.col("track_id").alias("new_id"), "u", "v"))
    crowd = spread(fresh.withColumns(cells(thr)).groupBy(*place).agg(F.count("*").alias("_c"))).groupBy(*place).agg(F.sum("_c").alias("_n"))
    scored = rows.withColumns(cells(thr)).join(crowd, place, "left").select(
        "scene", "old_id", F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "img_id", "u", "v").alias("o"))
    first = cut(scored.groupBy("scene", "old_id").agg(F.min("o").alias("p"), F.count("*").alias("length")).where("p.n > 0"))

    alone = first.where("length = 1").select("scene", "old_id", "p.img_id", "p.u", "p.v")
    spots, wanted = (df.select("scene", "img_id", "u", "v").distinct() for df in (fresh, alone))
    wanted = cut(wanted.withColumns(cells(half)).join(fresh.withColumns(cells(half)).select(*place).distinct().withColumn("_in", F.lit(True)), place, "left").drop("cx", "cy"))
    looked = spread(wanted.where("_in is null").withColumns(cells(thr))).withColumnsRenamed({"u": "u1", "v": "v1"}).join(
        spots.withColumns(cells(thr)).withColumnsRenamed({"u": "u2", "v": "v2"}), place).where(close("1", "2"))
    near = wanted.where("_in").select("scene", "img_id", "u", "v").unionByName(looked.select("scene", "img_id", F.col("u1").alias("u"), F.col("v1").alias("v")).distinct())
    found = alone.join(near, ["scene", "img_id", "u", "v"], "left_semi").select("scene", "old_id")

    longer = first.where("length > 1")
    second = scored.join(longer.select("scene", "old_id", F.col("p.img_id").alias("_i")), ["scene", "old_id"]).where("o.img_id <> _i").groupBy("scene", "old_id").agg(F.min("o").alias("q"))
    both = longer.join(second.where("q.n > 0"), ["scene", "old_id"])
    both = both.select("scene", "old_id", "length", F.when(F.col("p.img_id") < F.col("q.img_id"), F.struct("p", "q")).otherwise(
        F.struct(F.col("q").alias("p"), F.col("p").alias("q"))).alias("o"))
    keys = ["scene", "ia", "ib", "xa", "ya", "xb", "yb"]
    at = lambda c, shift: F.floor((F.col(c) + shift) / wide)
    ask = both.select("scene", "old_id", "length", *[F.col(f"o.{o}.{c}").alias(f"{n}{s}") for o, s in (("p", "a"), ("q", "b")) for c, n in (("img_id", "i"), ("u", "u"), ("v", "v"))])
    for c, n in (("ua", "xa"), ("va", "ya"), ("ub", "xb"), ("vb", "yb")):
        ask = ask.withColumn(n, F.explode(F.array_distinct(F.array(at(c, -thr), at(c, thr)))))
    pairs = pairs_within(fresh, ["scene", "new_id"], ["img_id"]).select("scene", "new_id", *[
        F.col(f"{s}.{c}").alias(f"{n}{s}{s}") for s in "ab" for c, n in (("img_id", "i"), ("u", "u"), ("v", "v"))])
    pairs = pairs.select("scene", "new_id", F.col("iaa").alias("ia"), F.col("ibb").alias("ib"), "uaa", "vaa", "ubb", "vbb",
                         *[at(c, 0.0).alias(n) for c, n in (("uaa", "xa"), ("vaa", "ya"), ("ubb", "xb"), ("vbb", "yb"))])
    proposed = ask.join(pairs, keys).where(close("a", "aa") & close("b", "bb")).select("scene", "old_id", "length", "new_id")
    proposed = cut(proposed)
    checked = (proposed.where("length > 2")
               .join(rows.select("scene", "old_id", "img_id", F.col("u").alias("u1"), F.col("v").alias("v1")), ["scene", "old_id"])
               .join(fresh.select("scene", "img_id", "new_id", F.col("u").alias("u2"), F.col("v").alias("v2")), ["scene", "img_id", "new_id"])
               .where(close("1", "2")).groupBy("scene", "old_id", "new_id", "length").agg(F.count("*").alias("hits"))
               .where(F.col("hits") == F.col("length")))
    found = found.union(proposed.where("length = 2").select("scene", "old_id")).union(checked.select("scene", "old_id"))
    return found.distinct().select("scene", F.col("old_id").alias("track_id"))


# ------------------------------------------------------------------ set operations
def union_tracks(left: DataFrame, right: DataFrame) -> DataFrame:
    """``right`` appended with its track ids shifted past the largest left id of the scene."""
    shift = left.groupBy("scene").agg((F.max("track_id") + 1).alias("_s"))
    moved = right.join(shift, "scene", "left").withColumn("track_id", F.col("track_id") + F.coalesce("_s", F.lit(0))).drop("_s")
    return left.unionByName(moved)


def remove_tracks(obs: DataFrame, drop: DataFrame) -> DataFrame:
    return obs.join(drop, ["scene", "track_id"], "left_anti")


def reindex(obs: DataFrame) -> DataFrame:
    """(scene, track_id, new_id) with surviving ids numbered from 0 without gaps."""
    ids = obs.select("scene", "track_id").distinct()
    return row_number(ids, ["scene"], ["track_id"], "_rn").select("scene", "track_id", (F.col("_rn") - 1).alias("new_id"))


def subset(obs: DataFrame, frames: DataFrame) -> DataFrame:
    """Rows of the listed (scene, img_id)."""
    return obs.join(frames.select("scene", "img_id"), ["scene", "img_id"], "left_semi")


def min_length(obs: DataFrame, n: int = 2) -> DataFrame:
    """Tracks with a positive ``scale`` in at least ``n`` images."""
    keep = obs.groupBy("scene", "track_id").agg(F.count_if(F.col("scale") > 0).alias("_k")).where(F.col("_k") >= n)
    return obs.join(keep.select("scene", "track_id"), ["scene", "track_id"], "left_semi")


def densify(obs: DataFrame) -> DataFrame:
    """One row per (track, image) of a scene, null where unobserved; an export form, as large as tracks × images.

    No cell is shuffled: a track brings the images it was seen in and meets blocks of the scene's images; of each block
    the unseen ones become empty cells, and the observations stand as they are.
    """
    ids = ["scene", "track_id", "img_id"]
    obs = cut(obs.select(*ids, *[c for c in obs.columns if c not in ids]))
    imgs = obs.where("scene is not null").select("scene", "img_id").distinct()
    sizes = imgs.groupBy("scene").agg(F.ceil(F.count("*") / IMAGE_BLOCK).alias("_n"))
    # collect_list leaves out nulls, but an unknown image is a column of empty cells too
    unknown = F.when(F.count_if(F.col("img_id").isNull()) > 0, F.array(F.lit(None).cast(imgs.schema["img_id"].dataType)))
    every = imgs.join(broadcast_if_small(sizes), "scene").groupBy("scene", F.pmod(F.xxhash64("img_id"), "_n").alias("_b")).agg(
        F.concat(F.collect_list("img_id"), F.coalesce(unknown, F.array().cast(f"array<{imgs.schema['img_id'].dataType.simpleString()}>"))).alias("_every"))
    # many cells come of few rows, so keep the partitions adaptive execution would merge
    own = obs.select(*ids).repartition(pair_partitions(obs), "scene", "track_id").groupBy("scene", "track_id").agg(F.collect_set("img_id").alias("_own"))
    unseen = F.when(F.col("track_id").isNull(), F.col("_every")).otherwise(F.array_except("_every", "_own"))
    empty = own.join(broadcast_if_small(cut(every)), "scene").select("scene", "track_id", F.explode(unseen).alias("img_id"), *[
        F.lit(None).cast(f.dataType).alias(f.name) for f in obs.schema.fields if f.name not in ids])
    return obs.where(" and ".join(f"{c} is not null" for c in ids)).unionByName(empty)


def overwrite_leading(rows: DataFrame, refined: DataFrame, on: Sequence[str], arrays: Sequence[str] = ()) -> DataFrame:
    """``rows`` with refined values where a key was refined; arrays keep the entries that were not."""
    on = list(on)
    vals = [c for c in refined.columns if c not in on]
    joined = rows.alias("l").join(refined.select(*on, *[F.col(c).alias(f"_n_{c}") for c in vals]), on, "left")
    for c in vals:
        new, old = F.col(f"_n_{c}"), F.col(f"l.{c}")
        if c in arrays:
            tail = F.slice(old, F.size(new) + 1, F.greatest(F.size(old) - F.size(new), F.lit(0)))
            new = F.concat(new, tail)
        joined = joined.withColumn(f"_n_{c}", F.coalesce(new, old))
    return joined.select(*[F.col(f"_n_{c}").alias(c) if c in vals else F.col(c) for c in rows.columns])


# ------------------------------------------------------------------ residuals
def residuals(obs: DataFrame, images: DataFrame, cameras: DataFrame, nodes: DataFrame, points: DataFrame,
              mode: str = "log") -> DataFrame:
    """Reprojection residuals (rx, ry) and depth residual rz per observation.

    A point at or behind depth 1e-3 has ``valid`` false and zero residuals; ``su``/``sv`` scale the pixels.
    """
    rows = denormalise(obs, images, cameras, nodes).join(points, ["scene", "track_id"])
    return with_residuals(rows, mode)


def with_residuals(rows: DataFrame, mode: str = "log") -> DataFrame:
    cam = transform(F.col("w2cam"), F.col("x"), F.col("y"), F.col("z"))
    rows = rows.withColumns(dict(zip(("xc", "yc", "zc"), cam)))
    k = {c: F.col(c) for c in K_COLS}
    u, v = project(F.col("xc"), F.col("yc"), F.col("zc"), k, zclip=1e-3)
    su = F.col("su") if "su" in rows.columns else F.lit(1.0)
    sv = F.col("sv") if "sv" in rows.columns else F.lit(1.0)
    f = (F.col("fx") + F.col("fy")) / 2
    ok = F.col("zc") > 1e-3
    z = F.when(ok, F.col("zc"))
    mixed = F.aggregate(F.zip_with(F.slice(F.col("dep"), F.lit(1), F.size("z_coefs")), "z_coefs", lambda a, b: a * b),
                        F.lit(0.0), lambda s, e: s + e)
    if mode == "log":
        guide = F.coalesce(mixed, F.ln("scale") + F.get("dep", F.lit(0)))
        rz = f * (guide - F.ln(z))
    else:
        guide = F.coalesce(mixed, F.col("scale") * F.get("dep", F.lit(0)))
        rz = f * F.ln(guide / z)
    zero = F.lit(0.0)
    return rows.withColumns({"valid": ok, "rx": F.when(ok, (u - F.col("u")) / su).otherwise(zero),
                             "ry": F.when(ok, (v - F.col("v")) / sv).otherwise(zero),
                             "rz": F.when(ok, rz).otherwise(zero)})


def robust(r: Column, p: float = 0.5, delta: float = 1.0, clip: float = 100.0, weight: float = 1.0,
           null_weight: float = 1e-16) -> list[Column]:
    """(loss, weight) of a residual: quadratic up to ``delta``, |r|^p beyond, constant from ``clip`` on."""
    a = 0.5 * p * delta ** (p - 2)
    b = delta ** p - a * delta * delta
    m = F.when(F.abs(r) > clip, F.lit(clip)).otherwise(F.abs(r))
    loss = F.lit(weight) * F.when(m <= delta, a * m * m).otherwise(F.pow(m, F.lit(p)) - b)
    w = F.when(m >= clip, F.lit(null_weight)).otherwise(
        F.lit(weight) * F.pow(F.greatest(m, F.lit(delta)), F.lit(p - 2)))
    return [loss, w]


def robust_terms(res: DataFrame, p: float = 0.5, delta: float = 1.0, clip: float = 100.0, weight_z: float = 1.0) -> DataFrame:
    """Loss and weight of all three components; an invalid point has zero loss and zero weight."""
    out = {}
    for axis, wt in (("x", 1.0), ("y", 1.0), ("z", weight_z)):
        loss, w = robust(F.col(f"r{axis}"), p, delta, clip, wt)
        out[f"l{axis}"] = F.when(F.col("valid"), loss).otherwise(F.lit(0.0))
        out[f"w{axis}"] = F.when(F.col("valid"), w).otherwise(F.lit(0.0))
    return res.withColumns(out)


def reproj_score(res: DataFrame, by: Sequence[str] = ("scene",), percent: int = 80) -> DataFrame:
    """Mean of the ⌊percent % · n⌋ smallest 2-D residual norms.

    The cut-off value is found as an exact quantile, so a huge scene needs no sort in one task: the mean
    of the values below it is completed by as many copies of the cut-off as the count asks for.
    """
    by = list(by)
    e = res.select(*by, F.sqrt(F.col("rx") * F.col("rx") + F.col("ry") * F.col("ry")).alias("e"))
    hist = cut(e.groupBy(*by, "e").agg(F.count("*").alias("c")))
    n = hist.groupBy(*by).agg(F.sum("c").alias("n"))
    cum = running_sum(blocks(hist, by, ["e"]), "c", "hi").join(n, by)
    keep = F.floor(F.col("n") * percent / 100)
    used = F.greatest(F.lit(0), F.least(F.col("hi"), keep) - (F.col("hi") - F.col("c")))
    return cum.groupBy(*by).agg((F.sum(F.col("e") * used) / F.nullif(F.sum(used), F.lit(0))).alias("score"),
                                F.sum(used).cast("long").alias("n_used"))


def running_max(frames: DataFrame, wanted: Mapping[str, str], by: Sequence[str] = ("scene",),
                order: Sequence[str] = ("idx",)) -> DataFrame:
    """Largest value so far in each scene."""
    b = blocks(frames, by, order)
    w = b.window().rowsBetween(Window.unboundedPreceding, 0)
    out = b.df.withColumns({n: F.max(c).over(w) for n, c in wanted.items()})
    if b.split:
        ends = b.df.groupBy(*b.keys).agg(*[F.max(c).alias(f"_m_{n}") for n, c in wanted.items()])
        prior = b.across().rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.select(*b.keys, *[F.max(f"_m_{n}").over(prior).alias(f"_p_{n}") for n in wanted])
        out = b.attach(out, ends).withColumns({n: F.greatest(n, f"_p_{n}") for n in wanted})
        out = out.drop(BLOCK, *[f"_p_{n}" for n in wanted])
    return out
