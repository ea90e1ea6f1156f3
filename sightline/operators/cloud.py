"""Point clouds from depth maps: unprojection, cleaning, budgets, bounds and focal length.

``pixels(scene, img_id, px, py, depth, conf)`` and ``views(scene, img_id, width, height, fx, fy, cx, cy, cam2w)``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.camera import filter_conf, let, on_stride, project, unproject
from sightline.functions.pose import dot3, entries, pose_inv, pose_mul, transform
from sightline.operators.accuracy import umeyama
from sightline.operators.graph import components
from sightline.operators.grid import HALF_WINDOW, IMG, corners, neighbours, sample, stencil
from sightline.operators.ordered import quantiles, row_number
from sightline.scale import broadcast_if_small, cut

K_COLS = ("fx", "fy", "cx", "cy")


def _k() -> dict[str, Column]:
    return {c: F.col(c) for c in K_COLS}


def unproject_pixels(pixels: DataFrame, views: DataFrame, world: bool = True, stride: int = 1) -> DataFrame:
    """3-D point of each pixel with defined depth, in the world or in the camera frame."""
    rows = pixels.where(F.col("depth").isNotNull())
    if stride > 1:
        rows = rows.where(on_stride(F.col("px"), F.col("py"), stride))
    cams = broadcast_if_small(views.select("scene", "img_id", *K_COLS, *(["cam2w"] if world else [])))
    rows = rows.join(cams, list(IMG))
    p = unproject(F.col("px"), F.col("py"), F.col("depth"), _k(), 0.5, stride)
    if not world:
        return rows.select(*pixels.columns, *[c.alias(n) for c, n in zip(p, "xyz")])
    rows = rows.select(*pixels.columns, "cam2w", *[c.alias(n) for c, n in zip(p, ("_x", "_y", "_z"))])
    w = transform(F.col("cam2w"), F.col("_x"), F.col("_y"), F.col("_z"))
    return rows.select(*pixels.columns, *[c.alias(n) for c, n in zip(w, "xyz")])


def drop_uncertain(pixels: DataFrame, thr: float = 2.0) -> DataFrame:
    """Depth undefined and confidence 0 below the threshold."""
    depth, conf = filter_conf(F.col("depth"), F.col("conf"), thr)
    return pixels.withColumns({"depth": depth, "conf": conf})


def _ray_angle(views: DataFrame) -> DataFrame:
    ax = 2 * F.atan(F.col("width") / (2 * F.col("fx"))) / F.col("width")
    ay = 2 * F.atan(F.col("height") / (2 * F.col("fy"))) / F.col("height")
    return views.select("scene", "img_id", F.cos(F.least(ax, ay)).alias("_cos"), F.greatest("width", "height").alias("_long"))


#: Row step of pixel numbers: twice the largest 32-bit coordinate, so that no two pixels of any image share a number.
ROW = 1 << 32


def surface_edges(pixels: DataFrame, views: DataFrame, radius: float = 0.005) -> DataFrame:
    """Neighbouring pixels (5×5 window) whose points are closer than radius·√(z1·z2).

    All offsets use the angle between adjacent rays. Pixels are numbered row by row.
    """
    defined = pixels.where(F.col("depth").isNotNull()).select("scene", "img_id", "px", "py", "depth")
    cand = neighbours(defined, HALF_WINDOW, ["depth"]).join(broadcast_if_small(_ray_angle(views)), list(IMG))
    z1, z2 = F.col("depth"), F.col("n_depth")
    near = z1 * z1 + z2 * z2 - 2 * z1 * z2 * F.col("_cos") < radius * radius * z1 * z2
    return cand.where(near).select(F.struct("scene", "img_id").alias("scene"), (F.col("py") * ROW + F.col("px")).alias("i"),
                                   (F.col("ny") * ROW + F.col("nx")).alias("j"))


SURFACE_TILE = 128  # pixels of a side of the tiles whose surfaces are found in one task each
_NAMES = ["_node", "_root", "_n", "_own", "_first"]


def _smallest(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The smallest node of the component of each of ``n`` nodes."""
    root = np.arange(n)
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            return root
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != root[root]).any():
            root = root[root]


def _whole_tiles(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables cut at tile borders with a running number of the tile; rows arrive sorted by tile."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        if not len(table):
            continue
        named = table.select(keys).to_pandas()
        tile = (named != named.shift()).any(axis=1).to_numpy().cumsum()
        whole = int(np.searchsorted(tile, tile[-1]))
        if whole:
            yield table.slice(0, whole), tile[:whole]
        rest = table.slice(whole).combine_chunks()
    if rest is not None:
        yield rest, np.zeros(len(rest), dtype=np.int64)


def _joined(columns: list[str], keys: list[str], radius: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Task body: pixels of whole tiles with the smallest pixel of their surface in the tile and the surface's own pixels.

    An edge is judged in the tile of its first pixel. Pixels of other tiles leave where they are not the smallest themselves.
    """
    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, tile in _whole_tiles(batches, keys):
            of = lambda name: table.column(name).to_numpy(zero_copy_only=False)
            use = of("_defined").astype(bool)
            at = np.flatnonzero(use)
            px, py, z, own = (of(c)[at] for c in ("px", "py", "depth", "_own"))
            px, py, z, own, cosine = px.astype(np.int64), py.astype(np.int64), z.astype(float), own.astype(bool), of("_cos")[at].astype(float)
            x, y = px - of("_tx")[at].astype(np.int64) * SURFACE_TILE + 2, py - of("_ty")[at].astype(np.int64) * SURFACE_TILE
            width = SURFACE_TILE + 4
            place = (tile[at] * (SURFACE_TILE + 2) + y) * width + x
            order = np.argsort(place, kind="stable")
            ranked = place[order]
            nodes, node = np.unique(place, return_inverse=True)
            mine, ends = np.flatnonzero(own), []
            for dx, dy in HALF_WINDOW:
                want = place[mine] + dy * width + dx
                low, count = np.searchsorted(ranked, want), np.searchsorted(ranked, want, "right") - np.searchsorted(ranked, want)
                a = np.repeat(mine, count)
                b = order[np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)]
                with np.errstate(invalid="ignore", over="ignore"):
                    near = z[a] * z[a] + z[b] * z[b] - 2 * z[a] * z[b] * cosine[a] < radius * radius * z[a] * z[b]
                ends.append((node[a[near]], node[b[near]]))
            root = _smallest(np.concatenate([e[0] for e in ends]), np.concatenate([e[1] for e in ends]), len(nodes))
            number, inside = np.zeros(len(nodes), dtype=np.int64), np.zeros(len(nodes), dtype=bool)
            number[node], inside[node] = py * ROW + px, own
            size = np.bincount(root[inside], minlength=len(nodes))
            first = np.zeros(len(at), dtype=bool)
            first[mine[np.unique(root[node[mine]], return_index=True)[1]]] = True
            rows = np.arange(len(table))
            out = {"_node": np.full(len(rows), -1), "_root": np.full(len(rows), -1), "_n": np.ones(len(rows), dtype=np.int64),
                   "_own": np.ones(len(rows), dtype=bool), "_first": np.zeros(len(rows), dtype=bool)}
            for name, v in zip(_NAMES, (number[node], number[root[node]], size[root[node]], own, first)):
                out[name][at] = v
            kept = pa.array(out["_own"] | (out["_node"] != out["_root"]))
            found = table.select(columns)
            for name, v in out.items():
                found = found.append_column(name, pa.array(v))
            yield from found.filter(kept).to_batches()

    return body


def _surfaces(pixels: DataFrame, views: DataFrame, radius: float) -> DataFrame:
    """Pixels with ``_n``, the pixels of their surface: what ``surface_edges`` connects.

    Surfaces are found in tiles of pixels first, each with the pixels next to it that an edge can reach. Only pixels that tiles
    share go through the rounds of the component search, named by the smallest pixel of their surface in each tile.
    """
    cos = broadcast_if_small(_ray_angle(views).select(*IMG, "_cos"))
    keys = [*IMG, "_tx", "_ty"]
    at = lambda dx, dy: F.struct(F.floor((F.col("px") + dx) / SURFACE_TILE).alias("x"), F.floor((F.col("py") + dy) / SURFACE_TILE).alias("y"))
    here = at(0, 0)
    defined = reduce(lambda p, q: p & q, [F.col(c).isNotNull() for c in (*IMG, "px", "py", "depth")])
    tiles = F.when(defined, F.array_distinct(F.array(*[at(dx, dy) for dx in (-2, 0, 2) for dy in (-2, 0)]))).otherwise(F.array(here))
    rows = pixels.select("*", defined.alias("_defined"), tiles.alias("_all")).select("*", (F.size("_all") > 1).alias("_shared"), F.explode("_all").alias("_t")).select(
        *pixels.columns, "_defined", "_shared", F.col("_t").eqNullSafe(here).alias("_own"), F.col("_t.x").alias("_tx"), F.col("_t.y").alias("_ty"))
    rows = rows.join(cos, list(IMG), "left").repartition(*keys).sortWithinPartitions(*keys)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pixels.schema.fields)
    found = cut(rows.mapInArrow(_joined([*pixels.columns, "_shared"], keys, radius), f"{kinds}, _shared boolean, _node long, _root long, _n long, _own boolean, _first boolean"))
    image = F.struct(*IMG).alias("scene")
    labels = components(found.where("_shared AND _node <> _root").select(image, F.col("_node").alias("i"), F.col("_root").alias("j")))
    parts = found.where("_first").select(image, F.col("_root").alias("node"), "_n").join(broadcast_if_small(labels), ["scene", "node"])
    total = parts.groupBy("scene", "component").agg(F.sum("_n").alias("_total"))
    total = labels.join(total, ["scene", "component"]).select("scene.*", F.col("node").alias("_root"), "_total")
    out = found.where("_own").join(broadcast_if_small(total), [*IMG, "_root"], "left")
    return out.select(*pixels.columns, F.coalesce("_total", "_n").alias("_n"))


def denoise_floating(pixels: DataFrame, views: DataFrame, radius: float = 0.005, min_size: float = 0.01) -> DataFrame:
    """Undefine depth and zero confidence of pixels in small surface components.

    A fractional ``min_size`` is a share of the longer image side, squared. All images of all scenes go
    through the same few rounds of the component search.
    """
    need = _ray_angle(views).select("scene", "img_id", (F.floor((min_size * F.col("_long")) ** 2) if isinstance(min_size, float)
                                                       else F.lit(min_size)).alias("_need"))
    out = _surfaces(pixels, views, radius).join(broadcast_if_small(need), list(IMG))
    ok = F.col("_n") >= F.col("_need")
    return out.withColumns({"depth": F.when(ok, F.col("depth")), "conf": F.when(ok, F.col("conf")).otherwise(F.lit(0.0))}).select(
        *pixels.columns)


TILE_SIDE = 16  # pixels of a side of the tiles whose depth ranges are compared with views
_BOX = ("px", "py", "depth")


def _seen(x: Column, y: Column, z: Column) -> list[Column]:
    """A point of the source camera in the other one, from the motion of the pair."""
    return [F.col(f"_r{3 * i}") * x + F.col(f"_r{3 * i + 1}") * y + F.col(f"_r{3 * i + 2}") * z + F.col(f"_t{i}") for i in range(3)]


def _may_meet(margin: float = 2.0) -> Column:
    """Whether a box of pixels and depths can show up in the other view of the pair.

    All points of the box lie in the hull of its eight corners, and the view is where five linear forms are positive;
    a form that is positive at no corner is positive nowhere in the box. ``margin`` pixels make up for rounding.
    """
    ends = {c: (F.col(f"_{c}0"), F.col(f"_{c}1")) for c in _BOX}
    at = [F.struct(((px + 0.5 - F.col("_cx")) / F.col("_fx") * z).alias("x"), ((py + 0.5 - F.col("_cy")) / F.col("_fy") * z).alias("y"), z.alias("z"))
          for px in ends["px"] for py in ends["py"] for z in ends["depth"]]
    seen = F.transform(F.array(*at), lambda c: F.struct(*[v.alias(n) for v, n in zip(_seen(c["x"], c["y"], c["z"]), "xyz")]))
    forms = (lambda c: c["z"],
             lambda c: F.col("fx") * c["x"] + (F.col("cx") + margin) * c["z"],
             lambda c: (F.col("width") + margin - F.col("cx")) * c["z"] - F.col("fx") * c["x"],
             lambda c: F.col("fy") * c["y"] + (F.col("cy") + margin) * c["z"],
             lambda c: (F.col("height") + margin - F.col("cy")) * c["z"] - F.col("fy") * c["y"])

    def positive_somewhere(s: Column, form: Callable[[Column], Column]) -> Column:
        return F.exists(s, lambda c: form(c) > 0)

    return let(seen, lambda s: reduce(lambda p, q: p & q, [positive_somewhere(s, f) for f in forms]))


def _boxes(rows: DataFrame, by: Sequence[str], low: str, high: str) -> DataFrame:
    return rows.groupBy(*by).agg(*[F.min(low.format(c)).alias(f"_{c}0") for c in _BOX], *[F.max(high.format(c)).alias(f"_{c}1") for c in _BOX])


def _tile() -> dict[str, Column]:
    return {"_tx": F.floor(F.col("px") / TILE_SIDE), "_ty": F.floor(F.col("py") / TILE_SIDE)}


def view_pairs(views: DataFrame) -> DataFrame:
    """Ordered pairs of views of a scene with both cameras and the motion between them, as ``_r0`` to ``_t2``."""
    src = views.select("scene", "img_id", *[F.col(c).alias(f"_{c}") for c in K_COLS], F.col("cam2w").alias("_p"))
    dst = views.select("scene", F.col("img_id").alias("seen_in"), "width", "height", *K_COLS, pose_inv(F.col("cam2w")).alias("_q"))
    pair = src.join(dst, "scene").where(F.col("seen_in") != F.col("img_id"))
    r, t = entries(pose_mul(F.col("_q"), F.col("_p")))
    return pair.select("scene", "img_id", "seen_in", "width", "height", *K_COLS, *[f"_{c}" for c in K_COLS],
                       *[c.alias(f"_r{i}") for i, c in enumerate(r)], *[c.alias(f"_t{i}") for i, c in enumerate(t)])


def meeting_tiles(pixels: DataFrame, pair: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pairs of views that can meet, and (scene, img_id, _tx, _ty, seen_in) of tiles and views that can; both written.

    Image boxes prune pairs of views first, tile boxes what is left; no pixel is multiplied by views before that. Pixels
    without a finite depth are seen nowhere and enter no box.
    """
    sized = pixels.where(F.col("depth").isNotNull() & (F.abs("depth") < float("inf")))
    tiles = cut(_boxes(sized.withColumns(_tile()), [*IMG, "_tx", "_ty"], "{}", "{}"))
    views = cut(pair.join(_boxes(tiles, IMG, "_{}0", "_{}1"), list(IMG)).where(_may_meet()).select(*pair.columns))
    met = tiles.join(broadcast_if_small(views), list(IMG)).where(_may_meet())
    return views, cut(met.select(*IMG, "_tx", "_ty", "seen_in"))


def visible_in_others(pixels: DataFrame, views: DataFrame) -> DataFrame:
    """Points of each image projected into the other images of the scene, kept where they land inside.

    The motion from one camera to the other is computed once per pair of views. Tiles of pixels with their depth ranges
    meet views first, so that pixels are only multiplied by views that their tile can show up in.
    """
    pair, met = meeting_tiles(pixels, view_pairs(views))
    # per pixel: seen = depth · (R·(px, py, 1 scaled by intrinsics)) + t
    rows = pixels.where(F.col("depth").isNotNull()).withColumns(_tile()).join(met, [*IMG, "_tx", "_ty"])
    rows = rows.join(broadcast_if_small(pair), [*IMG, "seen_in"])
    x, y = (F.col("px") + 0.5 - F.col("_cx")) / F.col("_fx"), (F.col("py") + 0.5 - F.col("_cy")) / F.col("_fy")
    rows = rows.withColumns({"_a": x * F.col("depth"), "_b": y * F.col("depth")})
    seen = _seen(F.col("_a"), F.col("_b"), F.col("depth"))
    rows = rows.select(*IMG, "px", "py", "conf", "seen_in", "width", "height", *K_COLS,
                       *[c.alias(n) for c, n in zip(seen, ("_sx", "_sy", "d"))]).where("d > 0")
    u, v = project(F.col("_sx"), F.col("_sy"), F.col("d"), _k())
    rows = rows.select(*IMG, "px", "py", "conf", "seen_in", "width", "height", u.alias("u"), v.alias("v"), "d")
    return rows.where((F.col("u") > -0.5) & (F.col("v") > -0.5) & (F.col("u") < F.col("width") + 0.5) & (F.col("v") < F.col("height") + 0.5))


def carved_points(pixels: DataFrame, views: DataFrame, coef: float = 0.9, use_conf: bool = True) -> DataFrame:
    """Pixels whose point floats in front of what another, at least as confident view sees there."""
    shown = visible_in_others(pixels, views)
    own = [*IMG, "px", "py", "conf", "seen_in", "d"]
    spots = shown.select(*own, "width", "height", "u", "v").withColumnsRenamed({"px": "_px", "py": "_py", "img_id": "_img", "conf": "_conf", "seen_in": "img_id"})
    c = corners(spots, border=False)
    empty = F.when(F.col("conf") > 0, F.coalesce("depth", F.lit(0.0)) * coef).otherwise(F.lit(0.0))
    seen = pixels.select(*IMG, "px", "py", empty.alias("_e"), F.col("conf").alias("_c"))
    hit = c.join(seen, [*IMG, "px", "py"], "left")
    at = hit.groupBy("scene", "_img", "_px", "_py", "_conf", "d", F.col("img_id")).agg(
        F.sum(F.col("_w") * F.coalesce("_e", F.lit(0.0))).alias("_e"), F.sum(F.col("_w") * F.coalesce("_c", F.lit(0.0))).alias("_c"))
    bad = F.col("d") < F.col("_e")
    if use_conf:
        bad = bad & (F.col("_c") >= F.col("_conf"))
    return at.where(bad).select("scene", F.col("_img").alias("img_id"), F.col("_px").alias("px"), F.col("_py").alias("py")).distinct()


def carve(pixels: DataFrame, views: DataFrame, coef: float = 0.9, use_conf: bool = True) -> DataFrame:
    """Zero the confidence of carved points; every ordered pair of views is judged on the original confidence."""
    gone = carved_points(pixels, views, coef, use_conf).withColumn("_gone", F.lit(True))
    out = pixels.join(gone, [*IMG, "px", "py"], "left")
    return out.withColumn("conf", F.when(F.col("_gone"), F.lit(0.0)).otherwise(F.col("conf"))).select(*pixels.columns)


def clean(pixels: DataFrame, views: DataFrame, conf_thr: float | None = 2.0, radius: float | None = 0.005,
          min_size: float = 0.01, coef: float | None = 0.9) -> DataFrame:
    """Confidence filter, floating-outlier removal and carving in turn; ``None`` skips a step."""
    if conf_thr is not None:
        pixels = drop_uncertain(pixels, conf_thr)
    if radius is not None:
        pixels = cut(denoise_floating(pixels, views, radius, min_size))
    return pixels if coef is None else carve(pixels, views, coef)


def planar_conf(pixels: DataFrame, views: DataFrame, alpha: float = 1e4) -> DataFrame:
    """``planar``: exp(−α·|Laplacian / 3×3 minimum|²) of depth; neighbours outside the image do not enter."""
    rows = pixels.join(broadcast_if_small(views.select("scene", "img_id", "width", "height")), list(IMG))

    def make(at, w) -> dict[str, Column]:
        def side(dx: int, dy: int) -> Column:
            x, y = F.col("px") + dx, F.col("py") + dy
            out = (x < 0) | (y < 0) | (x >= F.col("width")) | (y >= F.col("height"))
            return F.when(out, F.lit(0.0)).otherwise(at("depth", dx, dy))
        return {"_lx": 2 * F.col("depth") - side(-1, 0) - side(1, 0), "_ly": 2 * F.col("depth") - side(0, -1) - side(0, 1),
                "_lo": F.min("depth").over(w.rangeBetween(-1, 1))}

    out = stencil(rows, IMG, make)
    n = F.greatest(F.col("_lo"), F.lit(1e-12))
    q = (F.col("_lx") * F.col("_lx") + F.col("_ly") * F.col("_ly")) / (n * n)
    return out.select(*pixels.columns, F.exp(-alpha * q).alias("planar"))


def tangent_loss(points: DataFrame, ref: DataFrame, views: DataFrame, weight: float = 1.0, eps: float = 1e-12) -> DataFrame:
    """Per image, how much surface tangents turn against a reference point map.

    ``points`` and ``ref`` are (scene, img_id, px, py, x, y, z) in camera frames, numbered on the grid used.
    Unit forward differences along both axes are compared; squared differences are weighted by the root of
    the planarity of both ends in the reference and averaged over defined differences and components.
    """
    flat = planar_conf(ref.withColumn("depth", F.col("z")), views).select(*IMG, "px", "py", "planar", *[F.col(c).alias(f"r{c}") for c in "xyz"])
    both = points.join(flat, [*IMG, "px", "py"])
    cols = ["x", "y", "z", "rx", "ry", "rz", "planar"]
    step = neighbours(both, [(1, 0), (0, 1)], cols)

    def unit(names: list[str]) -> list[Column]:
        d = [F.col(f"n_{c}") - F.col(c) for c in names]
        n = F.greatest(F.sqrt(dot3(d, d)), F.lit(eps))
        return [c / n for c in d]

    a, b = unit(["x", "y", "z"]), unit(["rx", "ry", "rz"])
    diff = [p - q for p, q in zip(a, b)]
    w = F.sqrt(F.greatest(F.col("planar") * F.col("n_planar"), F.lit(0.0)))
    rows = step.select(*IMG, (F.col("nx") != F.col("px")).alias("along_x"), (w * dot3(diff, diff) / 3).alias("e"))
    axes = rows.groupBy(*IMG, "along_x").agg(F.avg("e").alias("m"))
    return axes.groupBy(*IMG).agg((weight * F.sum("m")).alias("tangent_loss"))


# ------------------------------------------------------------------ display selections
def select_points(points: DataFrame, thr: float, budget: int) -> DataFrame:
    """Points to draw: confident ones, each frame giving its share of the scene's budget.

    Frames are read in a fixed random order by hash. Counts, not sorts, decide the share.
    """
    kept = points.where(F.col("conf") >= thr).withColumn("_h", F.sha2(F.concat_ws("|", "scene", "img_id", "px", "py"), 256))
    per = kept.groupBy(*IMG).agg(F.count("*").alias("_n"))
    total = per.groupBy("scene").agg(F.sum("_n").alias("_t"))
    share = per.join(total, "scene").select(*IMG, F.when(F.col("_t") > budget, F.floor(F.col("_n") * budget / F.col("_t")))
                                            .otherwise(F.col("_n")).alias("_take"))
    ranked = row_number(kept, list(IMG), ["_h", "px", "py"], "_rn")
    return ranked.join(share, list(IMG)).where(F.col("_rn") <= F.col("_take")).select(*points.columns)


def conf_upper(pixels: DataFrame, by: tuple[str, ...] = ("scene",), accuracy: int | None = None) -> DataFrame:
    """99th percentile of confidence, rounded to even and at least 1; approximate when ``accuracy`` is given."""
    if accuracy:
        q = pixels.groupBy(*by).agg(F.percentile_approx("conf", 0.99, accuracy).alias("q"))
    else:
        q = quantiles(pixels, by, {"q": ("conf", 0.99, "cont")})
    return q.select(*by, F.greatest(F.bround("q", 0), F.lit(1.0)).alias("conf_upper"))


def bounds(points: DataFrame, cams: DataFrame, by: tuple[str, ...] = ("scene",)) -> DataFrame:
    """Robust centre and radius of a cloud and the unit direction to look at it from the mean camera."""
    wanted = {f"{s}{c}": (c, q, "cont") for c in "xyz" for s, q in (("lo_", 0.02), ("hi_", 0.98))}
    box = quantiles(points, by, wanted)
    eye = cams.groupBy(*by).agg(*[F.avg(F.col("cam2w.t")[i]).alias(f"e{i}") for i in range(3)])
    rows = box.join(eye, list(by))
    span = [F.col(f"hi_{c}") - F.col(f"lo_{c}") for c in "xyz"]
    mid = [(F.col(f"hi_{c}") + F.col(f"lo_{c}")) / 2 for c in "xyz"]
    rows = rows.select(*by, F.array(*mid).alias("center"), F.greatest(F.sqrt(dot3(span, span)) / 2, F.lit(1e-6)).alias("radius"),
                       *[(m - F.col(f"e{i}")).alias(f"v{i}") for i, m in enumerate(mid)])
    v = [F.col(f"v{i}") for i in range(3)]
    n = F.sqrt(dot3(v, v))
    ahead = F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0))
    return rows.select(*by, "center", "radius", F.when(n < 1e-9, ahead).otherwise(F.array(*[c / F.nullif(n, F.lit(0.0)) for c in v])).alias("direction"))


def median_depth(pixels: DataFrame, by: tuple[str, ...] = IMG) -> DataFrame:
    """Interpolated median of finite positive depth; 1 where a frame has none."""
    ok = F.when((F.col("depth") > 0) & ~F.isnan("depth") & (F.col("depth") < float("inf")), F.col("depth"))
    q = quantiles(pixels.withColumn("_d", ok), by, {"q": ("_d", 0.5, "cont")})
    return q.select(*by, F.coalesce("q", F.lit(1.0)).alias("median_depth"))


# ------------------------------------------------------------------ focal length
def _bounded(f: Column, low: float, high: float) -> Column:
    """Focal length within multiples of the one that gives the longer side a view of 60°."""
    base = F.greatest("height", "width") / (2 * math.tan(math.radians(60) / 2))
    f = F.greatest(base * low, f)
    return f if math.isinf(high) else F.least(base * high, f)


def focal(points: DataFrame, views: DataFrame, mode: str = "median", offset: float = 0.0, rounds: int = 10,
          min_focal: float = 0.0, max_focal: float = math.inf) -> DataFrame:
    """Focal length per image from a camera-frame point map: (scene, img_id, focal).

    ``median`` takes the exact lower median of the votes u·z/x and v·z/y; x = 0 votes infinity with the sign
    of u·z, and 0/0 does not vote. ``weiszfeld`` starts from least squares and re-weights by inverse distance.
    """
    size = views.select("scene", "img_id", "width", "height")
    rows = points.join(size, list(IMG)).select(
        *IMG, (F.col("px") + offset - F.col("width") / 2).alias("_u"), (F.col("py") + offset - F.col("height") / 2).alias("_v"), "x", "y", "z")
    if mode == "median":
        def vote(p: str, c: str) -> Column:
            n = F.col(p) * F.col("z")
            inf = F.when(n > 0, F.lit(float("inf"))).when(n < 0, F.lit(float("-inf")))
            return F.when(F.col(c) == 0, inf).otherwise(n / F.nullif(F.col(c), F.lit(0.0)))
        votes = rows.select(*IMG, F.explode(F.array(vote("_u", "x"), vote("_v", "y"))).alias("f")).where("f is not null and not isnan(f)")
        out = quantiles(votes, IMG, {"focal": ("f", 0.5, "disc")})
    elif mode == "weiszfeld":
        z = F.nullif(F.col("z"), F.lit(0.0))
        rows = rows.select(*IMG, "_u", "_v", F.coalesce(F.col("x") / z, F.lit(0.0)).alias("a"), F.coalesce(F.col("y") / z, F.lit(0.0)).alias("b"))
        rows = cut(rows.withColumns({"p": F.col("a") * F.col("_u") + F.col("b") * F.col("_v"), "q": F.col("a") ** 2 + F.col("b") ** 2}))
        ratio = lambda w: (F.sum(w * F.col("p")) / F.nullif(F.sum(w * F.col("q")), F.lit(0.0))).alias("focal")
        out = cut(rows.groupBy(*IMG).agg(ratio(F.lit(1.0))))
        for _ in range(rounds):
            d = F.sqrt((F.col("_u") - F.col("focal") * F.col("a")) ** 2 + (F.col("_v") - F.col("focal") * F.col("b")) ** 2)
            out = cut(rows.join(out, list(IMG)).withColumn("_w", 1 / F.greatest(d, F.lit(1e-8))).groupBy(*IMG).agg(ratio(F.col("_w"))))
    else:
        raise ValueError(f"unknown focal mode {mode!r}")
    return out.join(size, list(IMG)).select(*IMG, _bounded(F.col("focal"), min_focal, max_focal).alias("focal"))


def mono_focal(cams: DataFrame, by: tuple[str, ...] = ("scene",)) -> DataFrame:
    """One focal per scene, the lower median over its frames; principal points stay."""
    med = quantiles(cams, by, {"_f": ("fx", 0.5, "disc")})
    return cams.join(med, list(by)).withColumns({"fx": F.col("_f"), "fy": F.col("_f")}).drop("_f")


# ------------------------------------------------------------------ matched points
def match3d(obs: DataFrame, points: DataFrame, views: DataFrame, pairs: DataFrame) -> DataFrame:
    """(scene, i, j, track_id, pi, pj): 3-D points of the tracks an image pair shares.

    ``points`` is a camera-frame point map; every observation is sampled once, whatever the number of pairs. Observations
    of a track meet where the track is, and only pairs listed leave the join; a list too long to travel is joined image by image.
    """
    keys = [*IMG, "track_id"]
    pairs = cut(pairs.select("scene", "i", "j"))
    few = broadcast_if_small(pairs)
    at = sample(points, obs.join(broadcast_if_small(views.select(*IMG, "width", "height")), list(IMG)), keys, ["x", "y", "z"],
                deal=["scene", "track_id"] if few is not pairs else ())
    at = at.where("x is not null").select(*keys, F.array("x", "y", "z").alias("p"))
    a = at.select("scene", F.col("img_id").alias("i"), "track_id", F.col("p").alias("pi"))
    b = at.select("scene", F.col("img_id").alias("j"), "track_id", F.col("p").alias("pj"))
    if few is pairs:
        both = pairs.join(a, ["scene", "i"]).join(b, ["scene", "j", "track_id"])
    else:
        both = a.join(b, ["scene", "track_id"]).join(few, ["scene", "i", "j"])
    return both.select("scene", "i", "j", "track_id", "pi", "pj")


def relative_similarities(matched: DataFrame) -> DataFrame:
    """Similarity of every directed pair, x_i = s·R·x_j + t, both directions estimated on their own."""
    one = matched.select("scene", "i", "j", F.col("pj").alias("x"), F.col("pi").alias("y"))
    two = matched.select("scene", F.col("j").alias("i"), F.col("i").alias("j"), F.col("pi").alias("x"), F.col("pj").alias("y"))
    return umeyama(one.unionByName(two), ["scene", "i", "j"]).select("scene", "i", "j", "s", "r", "t")
