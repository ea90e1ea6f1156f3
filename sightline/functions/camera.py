"""Pinhole camera, depth and image-grid expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sightline.functions.pose import clip

MAX_LOG_DEPTH = 80.0  # exponent clip of log depth
FLOW_UNITS = 16  # stored flow is in sixteenths of a pixel
SCORE_UNITS = 255


def unproject(px: Column, py: Column, depth: Column, k: Column | dict, offset: float = 0.5,
              stride: int = 1) -> list[Column]:
    """Camera-frame point of a pixel. With a stride, keep the pixels of ``on_stride`` only.

    A strided map is an image of its own with shifted and divided intrinsics, which comes down to a
    pixel centre ``stride·offset`` away from the pixel index of the full map.
    """
    x = (px + offset * stride - k["cx"]) / k["fx"]
    y = (py + offset * stride - k["cy"]) / k["fy"]
    return [x * depth, y * depth, depth]


def on_stride(px: Column, py: Column, stride: int) -> Column:
    start = stride // 2
    return (px >= start) & (py >= start) & ((px - start) % stride == 0) & ((py - start) % stride == 0)


def project(x: Column, y: Column, z: Column, k: Column | dict, zclip: float = 1e-16) -> list[Column]:
    """Pixel of a camera-frame point, with the divisor kept at ``zclip`` or above."""
    d = clip(z, low=zclip)
    return [(k["fx"] * x + k["cx"] * z) / d, (k["fy"] * y + k["cy"] * z) / d]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once.

    A lambda of ``transform`` computes every expression it mentions again for each element, also one that
    comes from an earlier column; a bound variable avoids that.
    """
    return F.transform(F.array(value), body)[0]


def array_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def array_norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v * v))


def normalise(a: Column) -> Column:
    """L2 unit vector; a zero vector stays zero."""
    return let(a, lambda x: let(F.greatest(array_norm(x), F.lit(1e-12)), lambda n: F.transform(x, lambda v: v / n)))


def combine_depth(dep: Column, z: Column, mode: str = "log") -> Column:
    """Depth from channels and an array of coefficients (only the leading channels are read)."""
    mixed = array_dot(F.slice(dep, F.lit(1), F.size(z)), z)
    return F.exp(clip(mixed, high=MAX_LOG_DEPTH)) if mode == "log" else mixed


def scale_depth(dep: Column, scale: Column, mode: str = "log") -> Column:
    """Depth from the first channel and one global scale."""
    first = F.get(dep, F.lit(0))
    return scale * (F.exp(clip(first, high=MAX_LOG_DEPTH)) if mode == "log" else first)


def init_z(scale: Column, n_channels: int, mode: str = "log") -> Column:
    """Start coefficients: log depth adds ln(scale) through the constant channel 1."""
    head = [F.lit(1.0), F.ln(scale)] if mode == "log" else [scale]
    return F.array(*head, *[F.lit(0.0)] * (n_channels - len(head)))


def used_channels(n_zcfs: int | None | Sequence[int | None], n_channels: int, mode: str = "log") -> int:
    """Leading depth channels that a phase schedule reads; drop the rest before any shuffle."""
    phases = n_zcfs if isinstance(n_zcfs, (list, tuple)) else [n_zcfs]
    if any(n is None for n in phases):
        return n_channels
    needs_main = [n + 1 if mode == "log" and n not in (2, n_channels) else n for n in phases]
    return min(max(needs_main, default=0), n_channels)


def raylogz(x: Column, y: Column, logz: Column) -> list[Column]:
    """Ray and log depth to a point: (x, y)·eᶻ, eᶻ."""
    depth = F.exp(logz)
    return [x * depth, y * depth, depth]


def insert_constant_channel(dep: Column) -> Column:
    """Depth channels with a 1 inserted at index 1."""
    return F.concat(F.slice(dep, 1, 1), F.array(F.lit(1.0)),
                    F.slice(dep, F.lit(2), F.greatest(F.size(dep) - 1, F.lit(0))))


def patch_of(px: Column, py: Column, width: int | Column, patch: int = 16) -> list[Column]:
    """(patch number, index inside the patch) of a pixel, both row-major."""
    per_row = F.floor(_col(width) / patch)
    return [F.floor(py / patch) * per_row + F.floor(px / patch), (py % patch) * patch + px % patch]


def pixel_of(patch_id: Column, k: Column, width: int | Column, patch: int = 16) -> list[Column]:
    per_row = F.floor(_col(width) / patch)
    return [(patch_id % per_row) * patch + k % patch, F.floor(patch_id / per_row) * patch + F.floor(k / patch)]


def _col(v: int | Column) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def _whole_patches(n: Column, patch: int) -> tuple[Column, Column]:
    """Size of the centred part of ``n`` pixels that is whole pairs of half patches, and how much is cut on the near side."""
    middle = F.floor(n / 2)
    kept = F.floor(middle * 2 / patch) * (patch // 2)
    return kept * 2, middle - kept


def resize_transform(w: Column, h: Column, size: int, patch: int = 16, ar: float | None = None) -> Column:
    """Output size and pixel transform of centre crop to an aspect ratio, resize and patch crop.

    The transform is ``u' = scale·u + dx``, ``v' = scale·v + dy``. ``ar`` is the ratio of a box's height to its width. The
    box is the largest centred one: as high as the image if its width then fits; else as wide as the image, turned
    on its side if that fits. Its size is twice a whole number, halves up; the resized size rounds halves to even.
    """
    shift_x = shift_y = F.lit(0.0)
    if ar is not None:
        mid_x, mid_y = F.floor(w / 2), F.floor(h / 2)
        by_height, on_side = h / ar <= w, w / ar <= h
        reach_x = F.when(by_height, F.floor(mid_y / ar + 0.5)).otherwise(mid_x)
        reach_y = F.when(by_height, mid_y).otherwise(F.floor(F.when(on_side, mid_x / ar).otherwise(mid_x * ar) + 0.5))
        shift_x, shift_y = (reach_x - mid_x).cast("double"), (reach_y - mid_y).cast("double")
        w, h = 2 * reach_x, 2 * reach_y
    scale = F.lit(float(size)) / F.greatest(w, h)
    (width, cut_x), (height, cut_y) = (_whole_patches(F.bround(n * scale, 0), patch) for n in (w, h))
    return F.struct(width.cast("long").alias("width"), height.cast("long").alias("height"), scale.alias("scale"),
                    (scale * shift_x - cut_x).alias("dx"), (scale * shift_y - cut_y).alias("dy"))


def quantise_flow(v: Column) -> Column:
    return F.bround(v * FLOW_UNITS, 0).cast("smallint")


def dequantise_flow(q: Column, score: Column) -> Column:
    """Pixels; null where the stored score is zero."""
    return F.when(score > 0, q / float(FLOW_UNITS))


def quantise_score(s: Column) -> Column:
    return clip(F.bround(s * SCORE_UNITS, 0), 0.0, float(SCORE_UNITS)).cast("smallint")


def filter_conf(depth: Column, conf: Column, thr: float = 2.0) -> list[Column]:
    """(depth, conf) with uncertain pixels undefined."""
    return [F.when(conf >= thr, depth), F.when(conf >= thr, conf).otherwise(F.lit(0.0))]


def drawable(x: Column, y: Column, z: Column, conf: Column) -> Column:
    def finite(c: Column) -> Column:
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return finite(x) & finite(y) & finite(z) & (conf > 0)


def gate(score: Column, conf: Column, thr: float) -> Column:
    """Match score weighted by keypoint confidence where the score passes, else zero."""
    return F.when(score > thr, score * conf).otherwise(F.lit(0.0))
