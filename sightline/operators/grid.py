"""Pixel-grid operators on the long form ``(scene, img_id, px, py, …)``; absent pixels are undefined."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.operators.ordered import sum_vectors

HALF_WINDOW = [(x, y) for x in range(-2, 3) for y in range(3) if (y, x) > (0, 0)]  # 12 offsets of a 5×5 window
IMG = ("scene", "img_id")


def neighbours(pixels: DataFrame, offsets: Sequence[tuple[int, int]], cols: Sequence[str], by: Sequence[str] = IMG) -> DataFrame:
    """Pixel pairs at the given (dx, dy) offsets, by equi-join on the shifted position.

    Gives the pixel with its ``cols``, the neighbour's position ``nx``/``ny`` and its values as ``n_<col>``.
    """
    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in offsets])
    left = pixels.select(*by, "px", "py", *cols, F.explode(steps).alias("_d")).select(
        *by, "px", "py", *cols, (F.col("px") + F.col("_d.dx")).alias("nx"), (F.col("py") + F.col("_d.dy")).alias("ny"))
    right = pixels.select(*by, F.col("px").alias("nx"), F.col("py").alias("ny"), *[F.col(c).alias(f"n_{c}") for c in cols])
    return left.join(right, [*by, "nx", "ny"])


def stencil(pixels: DataFrame, by: Sequence[str], make: Callable[[Callable[[str, int, int], Column], Window], dict[str, Column]]) -> DataFrame:
    """3×3 neighbourhood expressions in one shuffle.

    Each pixel is sent to its own image row and the rows above and below; a window along the row then sees
    all nine positions. Tasks are keyed by image row, so even one huge image is spread out. ``make`` gets
    ``at(column, dx, dy)`` and the row window, and returns the new columns.
    """
    rows = pixels.withColumn("_dy", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn("_y", F.col("py") + F.col("_dy"))
    w = Window.partitionBy(*by, "_y").orderBy("px")

    def at(col: str, dx: int, dy: int) -> Column:
        return F.max(F.when(F.col("_dy") == -dy, F.col(col))).over(w.rangeBetween(dx, dx))

    return rows.withColumns(make(at, w)).where("_dy = 0").drop("_dy", "_y")


def local_maxima(scores: DataFrame, threshold: float = 0.0, by: Sequence[str] = ("src",), score: str = "score") -> DataFrame:
    """Pixels equal to the maximum of their 3×3 neighbourhood and above ``threshold``; plateaus stay whole."""
    out = stencil(scores, by, lambda at, w: {"_max": F.max(score).over(w.rangeBetween(-1, 1))})
    return out.where((F.col(score) == F.col("_max")) & (F.col(score) > threshold)).drop("_max")


def _position(border: bool) -> list[Column]:
    """Position of a point among pixel centres, which lie at half-integers; with ``border`` moved into the image."""
    x, y = F.col("u") - 0.5, F.col("v") - 0.5
    if border:
        x = F.greatest(F.lit(0.0), F.least(F.col("width") - 1.0, x))
        y = F.greatest(F.lit(0.0), F.least(F.col("height") - 1.0, y))
    return [x, y]


def corners(points: DataFrame, border: bool) -> DataFrame:
    """The up to four pixels around each point with their bilinear weight ``_w``.

    ``points`` has u, v and the image's width and height; pixel centres lie at half-integers. With
    ``border`` the position is moved into the image, otherwise outside pixels are left out.
    """
    x, y = _position(border)
    rows = points.withColumns({"_x": x, "_y": y}).withColumns({"_fx": F.col("_x") - F.floor("_x"), "_fy": F.col("_y") - F.floor("_y")})
    four = F.array(*[F.struct((F.floor("_x") + a).alias("px"), (F.floor("_y") + b).alias("py"),
                              ((F.col("_fx") if a else 1 - F.col("_fx")) * (F.col("_fy") if b else 1 - F.col("_fy"))).alias("w"))
                     for a in (0, 1) for b in (0, 1)])
    out = rows.withColumn("_c", F.explode(four)).select(
        *points.columns, F.col("_c.px").alias("px"), F.col("_c.py").alias("py"), F.col("_c.w").alias("_w"))
    inside = (F.col("px") >= 0) & (F.col("py") >= 0) & (F.col("px") < F.col("width")) & (F.col("py") < F.col("height"))
    return out.where((F.col("_w") > 0) & inside)


SIDE = 4  # pixels of a side of the tiles that points meet; a tile also holds the first pixels of the next ones


def _tiles(grid: DataFrame, values: Sequence[str], by: Sequence[str], whole: bool) -> DataFrame:
    """One row per tile of the grid: ``_tile`` maps places to the pixels that corners of its points can be, its own and one row and column more.

    Pixels listed several times are added up; with ``whole`` one undefined value makes the sum undefined.
    """
    at = [F.struct(F.floor((F.col("px") - a) / SIDE).alias("tx"), F.floor((F.col("py") - b) / SIDE).alias("ty")) for a in (0, 1) for b in (0, 1)]
    rows = grid.select(*by, "px", "py", F.explode(F.array_distinct(F.array(*at))).alias("_t"), *values)
    place = (F.col("py") - F.col("_t.ty") * SIDE) * (SIDE + 1) + F.col("px") - F.col("_t.tx") * SIDE
    rows = rows.select(*by, "_t.tx", "_t.ty", place.alias("_k"), *values).repartition(*by, "tx", "ty")  # grouped and joined where they are
    one = rows.groupBy(*by, "tx", "ty", "_k").agg(*[
        (F.when(F.count(v) == F.count("*"), F.sum(v)) if whole else F.sum(v)).alias(v) for v in values])
    return one.groupBy(*by, "tx", "ty").agg(F.map_from_entries(F.collect_list(F.struct("_k", F.struct(*values)))).alias("_tile"))


def sample(grid: DataFrame, points: DataFrame, keys: Sequence[str], values: Sequence[str], padding: str = "border",
           by: Sequence[str] = IMG, deal: Sequence[str] = ()) -> DataFrame:
    """Bilinear value of scalar columns at each point; ``keys`` identify a point.

    ``border`` clamps to the image and is null where a needed pixel is undefined; ``zeros`` counts
    missing pixels as 0. A point is sent once, to the tile that holds all its corners. ``deal`` names keys
    to partition the result by.
    """
    keys, whole = list(keys), padding == "border"
    x, y = _position(whole)
    inside = points.where("width > 0 and height > 0") if whole else points
    rows = inside.select(*dict.fromkeys([*keys, *by]), "width", "height", x.alias("_x"), y.alias("_y"))
    # weights of the two columns and rows of pixels, null where outside the image
    sides = {}
    for c, size in (("x", "width"), ("y", "height")):
        first, part = F.floor(f"_{c}"), F.col(f"_{c}") - F.floor(f"_{c}")
        sides[f"_{c}0"] = F.when(first.between(0, F.col(size) - 1), 1 - part)
        sides[f"_{c}1"] = F.when((part > 0) & first.between(-1, F.col(size) - 2), part)
    rows = rows.select(*dict.fromkeys([*keys, *by]), F.floor(F.col("_x") / SIDE).alias("tx"), F.floor(F.col("_y") / SIDE).alias("ty"),
                       F.floor("_x").alias("_px"), F.floor("_y").alias("_py"), *[w.alias(n) for n, w in sides.items()])
    rows = rows.select(*dict.fromkeys([*keys, *by]), "tx", "ty", *sides,
                       ((F.col("_py") - F.col("ty") * SIDE) * (SIDE + 1) + F.col("_px") - F.col("tx") * SIDE).alias("_k"))
    rows = rows.join(_tiles(grid, values, by, whole), [*by, "tx", "ty"], "left")
    four = [(a, b) for a in (0, 1) for b in (0, 1)]
    rows = rows.select(*keys, *[(F.col(f"_x{a}") * F.col(f"_y{b}")).alias(f"_w{a}{b}") for a, b in four],
                       *[F.col("_tile")[F.col("_k") + (b * (SIDE + 1) + a)].alias(f"_e{a}{b}") for a, b in four])

    def total(v: str) -> Column:
        def part(a: int, b: int) -> Column:
            term = F.when(F.col(f"_w{a}{b}").isNull(), 0.0).otherwise(F.col(f"_w{a}{b}") * F.col(f"_e{a}{b}.{v}"))
            return term if whole else F.coalesce(term, F.lit(0.0))
        return sum((part(a, b) for a, b in four[1:]), part(*four[0]))

    rows = rows.select(*keys, *[total(v).alias(v) for v in values])
    if deal:
        rows = rows.repartition(*deal)
    if whole:
        return rows.groupBy(*keys).agg(*[F.when(F.count(v) == F.count("*"), F.sum(v)).alias(v) for v in values])
    out = rows.groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values])
    # points with no pixel inside sample to zero
    return points.select(*keys).join(out, keys, "left").select(*keys, *[F.coalesce(v, F.lit(0.0)).alias(v) for v in values])


def sample_array(grid: DataFrame, points: DataFrame, keys: Sequence[str], value: str, dim: int, by: Sequence[str] = IMG) -> DataFrame:
    """Bilinear value of an array column with border padding; points that touch an undefined pixel are left out."""
    keys = list(keys)
    c = corners(points.select(*dict.fromkeys([*keys, *by, "u", "v", "width", "height"])), True)
    hit = c.join(grid.select(*by, "px", "py", F.col(value).alias("_v")), [*by, "px", "py"], "left")
    ok = F.when(F.col("_v").isNull(), F.lit(1.0)).otherwise(F.lit(0.0))
    padded = F.concat(F.transform(F.coalesce("_v", F.array_repeat(F.lit(0.0), dim)), lambda v: v * F.col("_w")), F.array(ok))
    out = sum_vectors(hit, keys, padded, dim + 1).where(F.get("vec", F.lit(dim)) == 0)
    return out.select(*keys, F.slice("vec", 1, dim).alias(value))
