"""Rigid poses as columns: ``struct<r: array<double>(9, row-major), t: array<double>(3)>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POSE_TYPE = "struct<r:array<double>,t:array<double>>"
IDENTITY_R = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """``c`` kept within bounds; unlike ``least`` and ``greatest`` a null stays null."""
    out = c
    if low is not None:
        out = F.when(out < low, F.lit(low)).otherwise(out)
    if high is not None:
        out = F.when(out > high, F.lit(high)).otherwise(out)
    return out


def rigid(r: list[Column], t: list[Column]) -> Column:
    return F.struct(F.array(*r).alias("r"), F.array(*t).alias("t"))


def identity() -> Column:
    return rigid([F.lit(x) for x in IDENTITY_R], [F.lit(0.0)] * 3)


def entries(pose: Column) -> tuple[list[Column], list[Column]]:
    return [pose["r"][i] for i in range(9)], [pose["t"][i] for i in range(3)]


def dot3(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _transpose(r: list[Column]) -> list[Column]:
    return [r[3 * j + i] for i in range(3) for j in range(3)]


def _matmul(a: list[Column], b: list[Column]) -> list[Column]:
    return [dot3(a[3 * i:3 * i + 3], [b[j], b[3 + j], b[6 + j]]) for i in range(3) for j in range(3)]


def _rotate(r: list[Column], v: list[Column]) -> list[Column]:
    return [dot3(r[3 * i:3 * i + 3], v) for i in range(3)]


def quat_to_rot(qx: Column, qy: Column, qz: Column, qw: Column) -> list[Column]:
    """Rotation entries of a quaternion of any length (scaling by 2/|q|² normalises it)."""
    k = 2 / (qx * qx + qy * qy + qz * qz + qw * qw)

    def pick(a: Column, b: Column, sign: int, c: Column, d: Column) -> Column:
        return k * (a * b + c * d) if sign > 0 else k * (a * b - c * d)

    return [1 - pick(qy, qy, 1, qz, qz), pick(qx, qy, -1, qz, qw), pick(qx, qz, 1, qy, qw),
            pick(qx, qy, 1, qz, qw), 1 - pick(qx, qx, 1, qz, qz), pick(qy, qz, -1, qx, qw),
            pick(qx, qz, -1, qy, qw), pick(qy, qz, 1, qx, qw), 1 - pick(qx, qx, 1, qy, qy)]


def pose_from_quat(tx: Column, ty: Column, tz: Column, qx: Column, qy: Column, qz: Column, qw: Column) -> Column:
    """Pose from translation and quaternion; pass ``qw`` last whatever order the file uses."""
    return rigid(quat_to_rot(qx, qy, qz, qw), [tx, ty, tz])


def pose_inv(p: Column) -> Column:
    """(R, t) to (Rᵀ, −Rᵀt)."""
    r, t = entries(p)
    rt = _transpose(r)
    return rigid(rt, [-v for v in _rotate(rt, t)])


def pose_mul(a: Column, b: Column) -> Column:
    ra, ta = entries(a)
    rb, tb = entries(b)
    return rigid(_matmul(ra, rb), [u + v for u, v in zip(_rotate(ra, tb), ta)])


def relative(a: Column, b: Column) -> Column:
    """a⁻¹·b."""
    ra, ta = entries(a)
    rb, tb = entries(b)
    rt = _transpose(ra)
    return rigid(_matmul(rt, rb), _rotate(rt, [y - x for x, y in zip(ta, tb)]))


def transform(p: Column, x: Column, y: Column, z: Column) -> list[Column]:
    r, t = entries(p)
    return [u + v for u, v in zip(_rotate(r, [x, y, z]), t)]


def pytorch3d_to_cam2w(r: list[Column], t: list[Column]) -> Column:
    """PyTorch3D viewpoint (row vectors, x left, y up) to an OpenCV camera-to-world pose."""
    flip = [-1.0, -1.0, 1.0]
    rt = _transpose(r)
    return pose_inv(rigid([F.lit(flip[i // 3]) * rt[i] for i in range(9)], [F.lit(f) * c for f, c in zip(flip, t)]))


def angle_from_trace(trace: Column) -> Column:
    return F.degrees(F.acos(clip((trace - 1) / 2, -1.0, 1.0)))


def rotation_angle(ra: list[Column], rb: list[Column]) -> Column:
    """Angle between two rotations in degrees."""
    return angle_from_trace(sum((x * y for x, y in zip(ra[1:], rb[1:])), ra[0] * rb[0]))


def direction_angle(dot: Column, na: Column, nb: Column) -> Column:
    """Angle between two vectors of known lengths up to sign, in degrees; undefined gives 1e6 rad."""
    cos = dot / ((na + 1e-15) * (nb + 1e-15))
    angle = F.acos(F.sqrt(1 - clip(1 - cos * cos, low=1e-15)))
    return F.degrees(F.coalesce(F.nanvl(angle, F.lit(1e6)), F.lit(1e6)))


def translation_angle(ta: list[Column], tb: list[Column]) -> Column:
    """Angle between two directions up to sign, in degrees."""
    return direction_angle(dot3(ta, tb), F.sqrt(dot3(ta, ta)), F.sqrt(dot3(tb, tb)))


def flat(pose: Column, prefix: str = "") -> list[Column]:
    """The twelve entries as columns r0..r8, t0..t2."""
    r, t = entries(pose)
    return ([c.alias(f"{prefix}r{i}") for i, c in enumerate(r)]
            + [c.alias(f"{prefix}t{i}") for i, c in enumerate(t)])
