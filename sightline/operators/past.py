"""Choices among the past frames of a scene from one vector per frame; no table of pairs is written.

Frames are numbered in time and cut into tiles. A tile of queries meets every tile of its past in one small task that
multiplies matrices and hands on a row or a few per query, so what moves is vectors, once per tile met. Where the vectors of a
scene fit the broadcast limit, a tile of queries meets its whole past in one task, which then makes all rounds of a choice:
vectors move once for all of them and the chosen ones never. Matrix products
only pick the cells that may win; these are computed again term by term in the order of the vector, so that equal frames
tie and results are those of the table ``selection.similarity`` gives.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.operators.ordered import pair_partitions, row_number
from sightline.scale import broadcast_if_small, cut, max_broadcast_bytes

TINY = 1e-6
NEAR = 1e-9  # cells that close to the best one are computed again
CHUNK = 256  # query rows multiplied at once
CELLS = 1 << 22  # cells of a product where a query meets its whole past


@dataclass(frozen=True)
class Vectors:
    """Stands for the past pairs of ``glob(scene, img_id, vec)`` and their products ``s``, rounded to ``digits`` if given."""

    glob: DataFrame
    digits: int | None = None
    tile: int = 8192


def product(x: np.ndarray, y: np.ndarray, digits: int | None) -> np.ndarray:
    """Products of two lists of vectors, summed in order."""
    s = np.zeros(len(x))
    for k in range(x.shape[1]):
        s += x[:, k] * y[:, k]
    return s if digits is None else np.round(s, digits)


def _scenes(rows: DataFrame, tile: int, dim: int, unique: bool) -> DataFrame:
    """(scene, starts, whole): the first frame of every tile, and whether the vectors of the scene fit the broadcast limit.

    With ``unique`` a scene that has a frame twice is not ``whole``.
    """
    ids = row_number(rows.select("scene", "img_id"), ["scene"], ["img_id"], "_n")
    first = F.when((F.col("_n") - 1) % tile == 0, F.col("img_id"))
    fits = F.count("*") * (8 * dim + 64) <= max_broadcast_bytes(rows.sparkSession)
    fits = fits & (F.count("*") == F.count_distinct("img_id")) if unique else fits
    return cut(ids.groupBy("scene").agg(F.sort_array(F.collect_list(first)).alias("starts"), fits.alias("whole")))


def _length(rows: DataFrame) -> int:
    return max(int(rows.agg(F.max(F.size("vec")).alias("d")).first()["d"] or 0), 1)


def _known(v: Vectors) -> DataFrame:
    return v.glob.select("scene", "img_id", F.col("vec").cast("array<double>").alias("vec")).where("scene is not null and img_id is not null")


def whole_scenes(v: Vectors) -> DataFrame:
    """(scene, starts, whole) of ``v``: whether a tile of queries may meet its whole past in one task; not where a frame repeats."""
    rows = _known(v)
    return _scenes(rows, v.tile, _length(rows), True)


def fitting(rows: DataFrame) -> DataFrame:
    """(scene, k): scenes whose vectors fit the broadcast limit, of distinct known frames with known vectors of one length; k frames."""
    known = F.col("img_id").isNotNull() & F.col("vec").isNotNull() & ~F.exists("vec", lambda e: e.isNull() | F.isnan(e))
    count, dim = F.count("*"), F.max(F.size("vec"))
    whole = (F.count_if(known) == count) & (F.count_distinct("img_id") == count) & (F.min(F.size("vec")) == dim) & (
        count * (8 * dim + 64) <= max_broadcast_bytes(rows.sparkSession))
    return rows.groupBy("scene").agg(count.alias("k"), whole.alias("whole")).where("whole and scene is not null").select("scene", "k")


def ready(v: Vectors, distinct: bool) -> tuple[DataFrame, int, bool]:
    """((scene, img_id, vec, ok, tile, last, whole), length of a vector, whether a scene is not ``whole``).

    ``ok`` is false where a vector is unknown, ``last`` is the last tile of the scene. Only ids are sorted to make tiles.
    """
    rows = _known(v)
    if distinct and not rows.groupBy("scene", "img_id").count().where("count > 1").isEmpty():
        rows = rows.distinct()
    rows = cut(rows)
    dim = _length(rows)
    scenes = _scenes(rows, v.tile, dim, distinct)
    ok = F.coalesce((F.size("vec") == dim) & ~F.exists("vec", lambda e: e.isNull()), F.lit(False))
    vec = F.when(ok, F.col("vec")).otherwise(F.array_repeat(F.lit(0.0), dim))
    tile = F.size(F.filter("starts", lambda s: s <= F.col("img_id"))) - 1
    frames = rows.join(broadcast_if_small(scenes), "scene").select(
        "scene", "img_id", vec.alias("vec"), ok.alias("ok"), tile.alias("tile"), (F.size("starts") - 1).alias("last"), "whole")
    return frames, dim, not scenes.where("not whole").isEmpty()


def _in_place(frames: DataFrame, fields: list[T.StructField], body: Callable[[pd.DataFrame, np.ndarray, pd.DataFrame], pd.DataFrame],
              more: DataFrame | None = None) -> DataFrame:
    """``body`` of every tile of queries with its whole past: frames by id, which of them are queries, and what ``more`` has on these.

    ``more`` is (scene, i, ...); it meets the queries by their tile. For scenes that are ``whole`` only.
    """
    names = [f.name for f in fields]
    parts = 4 * pair_partitions(frames)
    spread = frames.where("whole").withColumn("_x", F.explode(F.sequence("tile", "last"))).drop("last", "whole").repartition(parts, "scene", "_x")

    def call(pdf: pd.DataFrame, own: pd.DataFrame, x: int) -> pd.DataFrame:
        b = pdf.sort_values("img_id", kind="stable").reset_index(drop=True)
        queries = np.flatnonzero((b["tile"] == x).to_numpy())
        step = max(1, min(CHUNK, CELLS // max(len(b), 1)))
        out = [body(b, queries[lo:lo + step], own) for lo in range(0, len(queries), step)]
        return pd.concat([o for o in out if len(o)] or out[:1], ignore_index=True)[names]

    schema = T.StructType(fields)
    if more is None:
        return spread.groupBy("scene", "_x").applyInPandas(lambda key, pdf: call(pdf, pd.DataFrame(), key[1]), schema)
    tiles = frames.where("whole").select("scene", F.col("img_id").alias("i"), F.col("tile").alias("_x")).distinct()
    own = more.join(tiles, ["scene", "i"])
    own = own.select(*[F.col(c).alias(f"_of_{c}") for c in own.columns]).repartition(parts, "_of_scene", "_of__x")

    def meet(key: tuple, pdf: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty:
            return pd.DataFrame({n: pd.Series(dtype=object) for n in names})
        return call(pdf, own.rename(columns=lambda c: c.removeprefix("_of_")), int(pdf["_x"].iloc[0]))

    return spread.groupBy("scene", "_x").cogroup(own.groupBy("_of_scene", "_of__x")).applyInPandas(meet, schema)


def _meet(queries: DataFrame, frames: DataFrame, fields: list[T.StructField], body: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """``body`` of every tile of queries and every tile of frames no later than it, ordered by id."""
    names = [f.name for f in fields]
    parts = 4 * pair_partitions(queries)
    ends = broadcast_if_small(queries.groupBy("scene").agg(F.max("tile").alias("_end")))
    x = queries.withColumn("_y", F.explode(F.sequence(F.lit(0), F.col("tile")))).withColumnRenamed("tile", "_x").repartition(parts, "scene", "_x", "_y")
    y = (frames.join(ends, "scene").where("tile <= _end").withColumn("_x", F.explode(F.sequence("tile", "_end"))).drop("_end")
         .withColumnRenamed("tile", "_y"))
    y = y.select(*[F.col(c).alias(f"_of_{c}") for c in y.columns]).repartition(parts, "_of_scene", "_of__x", "_of__y")

    def meet(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({n: pd.Series(dtype=object) for n in names})
        b = b.rename(columns=lambda c: c.removeprefix("_of_")).sort_values("img_id", kind="stable").reset_index(drop=True)
        out = [body(a.iloc[lo:lo + CHUNK].reset_index(drop=True), b) for lo in range(0, len(a), CHUNK)]
        return pd.concat([o for o in out if len(o)] or out[:1], ignore_index=True)[names]

    return x.groupBy("scene", "_x", "_y").cogroup(y.groupBy("_of_scene", "_of__x", "_of__y")).applyInPandas(meet, T.StructType(fields))


def _fields(frames: DataFrame, *more: T.StructField) -> list[T.StructField]:
    scene, img = frames.schema["scene"], frames.schema["img_id"]
    return [T.StructField("scene", scene.dataType), T.StructField("i", img.dataType), *more, T.StructField("j", img.dataType)]


def _stack(col: pd.Series) -> np.ndarray:
    return np.stack(col.to_numpy()).astype(float)


def _past(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
    """Which frames are past ones of a query and not in its list ``skip``."""
    j = b["img_id"].to_numpy()
    past = j[None, :] < a["i"].to_numpy()[:, None]
    if "skip" in a.columns:
        for r, ids in enumerate(a["skip"]):
            if ids is not None and len(ids):
                past[r] &= ~np.isin(j, ids)
    return past


def _queries(b: pd.DataFrame, q: np.ndarray) -> pd.DataFrame:
    return b.iloc[q].rename(columns={"img_id": "i"}).reset_index(drop=True)


def _rows(a: pd.DataFrame, b: pd.DataFrame, r: np.ndarray, c: np.ndarray, **values: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"scene": a["scene"].to_numpy()[r], "i": a["i"].to_numpy()[r], "j": b["img_id"].to_numpy()[c], **values})


def lowest(v: Vectors, frames: DataFrame, large: bool = True) -> DataFrame:
    """(scene, low): the least product of a past pair; ``large`` says whether there may be scenes that are not ``whole``."""
    digits = v.digits

    def body(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        x, y = _stack(a["vec"]), _stack(b["vec"])
        known = _past(a, b) & a["ok"].to_numpy()[:, None] & b["ok"].to_numpy()[None, :]
        s = np.where(known, x @ y.T, np.inf)
        best = s.min()
        r, c = np.nonzero(known & (s <= best + NEAR * max(1.0, abs(best))))
        s = product(x[r], y[c], digits)
        at = s.argmin() if len(s) else 0
        return _rows(a, b, r[at:at + 1], c[at:at + 1], s=s[at:at + 1])

    fields = _fields(frames, T.StructField("s", T.DoubleType()))
    found = _in_place(frames, fields, lambda b, q, own: body(_queries(b, q), b))
    if large:
        apart = frames.where("not whole")
        found = found.unionByName(_meet(apart.withColumnRenamed("img_id", "i"), apart, fields, body))
    return found.groupBy("scene").agg(F.min("s").alias("low"))


@dataclass(frozen=True)
class Greedy:
    """Scores of ``rounds``. ``kind`` max, avg or rmse is the choice of ``diverse``; far is that of ``coreset_fps_past``."""

    kind: str
    diag: float

    def norm(self, s: np.ndarray, known: np.ndarray, base: np.ndarray | float) -> np.ndarray:
        return np.where(known, np.clip((s - base + TINY) / (self.diag - base + TINY), 0, 1), 0.0)

    def added(self, acc: np.ndarray | None, s: np.ndarray, known: np.ndarray, base: np.ndarray | float) -> np.ndarray:
        """What a candidate has of the frames chosen so far, with one more of products ``s``."""
        if self.kind == "far":
            away = np.where(known, 1 - s, 1.0)
            return away if acc is None else np.minimum(acc, away)
        p = self.norm(s, known, base)
        if self.kind == "max":
            return p if acc is None else np.maximum(acc, p)
        return (0.0 if acc is None else acc) + (p if self.kind == "avg" else p * p)

    def near(self, s: np.ndarray, known: np.ndarray, base: np.ndarray | float) -> np.ndarray:
        return np.maximum(self.norm(s, known, base), TINY)

    def score(self, near: np.ndarray, acc: np.ndarray | None, n: int) -> np.ndarray:
        """``near`` is the first score of a candidate; n frames are chosen."""
        if acc is None:
            return near
        if self.kind == "far":
            return acc
        agg = {"max": acc, "avg": acc / n, "rmse": np.sqrt(acc / n) if self.kind == "rmse" else acc}[self.kind]
        return near * np.maximum(1 - agg, TINY)


def _best(rough: np.ndarray, past: np.ndarray, exact: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of the best candidate of each row that has one; cells near the best are computed again."""
    rough = np.where(past, rough, -np.inf)
    best = rough.max(1)
    r, c = np.nonzero(past & (rough >= (best - NEAR * np.maximum(1.0, np.abs(best)))[:, None]))
    s = exact(r, c)
    order = np.lexsort((c, -s, r))  # columns are ordered by id
    r, c, s = r[order], c[order], s[order]
    first = np.flatnonzero(np.diff(r, prepend=-1))
    return r[first], c[first], s[first]


def rounds(v: Vectors, k: int, kind: str, diag: float = 1.0, start: Column | None = None) -> DataFrame:
    """(scene, query, img_id): k past frames of every frame, chosen one after another, as ``selection`` defines it.

    ``kind`` is that of ``Greedy``; the first frame of far has the least ``start``, made of scene and img_id. Where a scene is
    ``whole`` all rounds are made in the task that has a query and its past.
    """
    frames, dim, large = ready(v, True)
    digits, far, greedy = v.digits, kind == "far", Greedy(kind, diag)
    if far:
        frames = frames.withColumn("low", F.lit(0.0)).withColumn("h", start)
    else:
        low = broadcast_if_small(cut(lowest(v, frames, large)))
        frames = frames.join(low, "scene", "left").withColumn("low", F.least(F.coalesce("low", F.lit(diag)), F.lit(diag))).withColumn("h", F.lit(0.0))

    def body(b: pd.DataFrame, q: np.ndarray, own: pd.DataFrame) -> pd.DataFrame:
        a = _queries(b, q)
        past, base = _past(a, b), float(b["low"].iloc[0])
        y, fine, h = _stack(b["vec"]), b["ok"].to_numpy(), b["h"].to_numpy().astype(float)
        known = fine[q][:, None] & fine[None, :]
        near = np.broadcast_to(-h, past.shape) if far else greedy.near(y[q] @ y.T, known, base)
        acc, picked, going, out = None, np.zeros((len(q), 0), int), np.arange(len(q)), []
        for n in range(k):
            def exact(r: np.ndarray, c: np.ndarray) -> np.ndarray:
                first = -h[c] if far else greedy.near(product(y[q[going[r]]], y[c], digits), fine[q[going[r]]] & fine[c], base)
                total = None
                for m in range(n):
                    held = picked[r, m]
                    total = greedy.added(total, product(y[held], y[c], digits), fine[held] & fine[c], base)
                return greedy.score(first, total, n)

            r, c, _ = _best(greedy.score(near, acc, n), past, exact)
            out.append(pd.DataFrame({"scene": b["scene"].iloc[0], "query": a["i"].to_numpy()[going[r]], "img_id": b["img_id"].to_numpy()[c]}))
            if n == k - 1 or not len(r):
                break
            if len(r) < len(going):  # the others have no past frame left
                near, past, picked, going, acc = near[r], past[r], picked[r], going[r], None if acc is None else acc[r]
            picked = np.concatenate([picked, c[:, None]], 1)
            past[np.arange(len(c)), c] = False
            acc = greedy.added(acc, y[c] @ y.T, fine[c][:, None] & fine[None, :], base)
        return pd.concat(out, ignore_index=True)

    scene, img = frames.schema["scene"], frames.schema["img_id"]
    fields = [T.StructField("scene", scene.dataType), T.StructField("query", img.dataType), T.StructField("img_id", img.dataType)]
    chosen = _in_place(frames, fields, body)
    return chosen.unionByName(_rounds_of_large(v, frames.where("not whole"), dim, k, greedy)) if large else chosen


def _rounds_of_large(v: Vectors, frames: DataFrame, dim: int, k: int, greedy: Greedy) -> DataFrame:
    """``rounds`` for scenes of any size: a round passes over the tiles once, with the vectors chosen so far on the queries."""
    digits, far = v.digits, greedy.kind == "far"
    img = frames.schema["img_id"].dataType.simpleString()
    frames = cut(frames)
    queries = frames.withColumnRenamed("img_id", "i").withColumns({
        "chosen": F.array().cast("array<double>"), "known": F.array().cast("array<boolean>"), "skip": F.array().cast(f"array<{img}>")})
    frames = frames.select("scene", "img_id", "vec", "ok", "tile", "h")
    fields = _fields(frames, T.StructField("score", T.DoubleType()))

    def body(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        past = _past(a, b)
        n, base = len(a["skip"].iloc[0]), float(a["low"].iloc[0])
        x, ok, y, fine, h = _stack(a["vec"]), a["ok"].to_numpy(), _stack(b["vec"]), b["ok"].to_numpy(), b["h"].to_numpy().astype(float)
        if n:
            held, known = _stack(a["chosen"]).reshape(len(a), n, dim), np.stack(a["known"].to_numpy()).astype(bool)

        def exact(r: np.ndarray, c: np.ndarray) -> np.ndarray:
            first = -h[c] if far else greedy.near(product(x[r], y[c], digits), ok[r] & fine[c], base)
            total = None
            for m in range(n):
                total = greedy.added(total, product(held[r, m], y[c], digits), known[r, m] & fine[c], base)
            return greedy.score(first, total, n)

        near = np.broadcast_to(-h, past.shape) if far else greedy.near(x @ y.T, ok[:, None] & fine[None, :], base)
        acc = None
        for m in range(n):
            acc = greedy.added(acc, held[:, m] @ y.T, known[:, m][:, None] & fine[None, :], base)
        r, c, s = _best(greedy.score(near, acc, n), past, exact)
        return _rows(a, b, r, c, score=s)

    queries, chosen = cut(queries.select("scene", "i", "vec", "ok", "tile", "low", "chosen", "known", "skip")), None
    vecs = frames.select("scene", F.col("img_id").alias("j"), F.col("vec").alias("_v"), F.col("ok").alias("_ok"))
    for step in range(k):
        met = _meet(queries, frames, fields, body)
        best = cut(met.groupBy("scene", "i").agg(F.min_by("j", F.struct(-F.col("score"), "j")).alias("j")))
        one = best.select("scene", F.col("i").alias("query"), F.col("j").alias("img_id"))
        chosen = one if chosen is None else chosen.unionByName(one)
        if step == k - 1 or best.isEmpty():
            break
        queries = cut(queries.join(best.join(vecs, ["scene", "j"]), ["scene", "i"]).select(
            "scene", "i", "vec", "ok", "tile", "low", F.concat("chosen", "_v").alias("chosen"),
            F.concat("known", F.array("_ok")).alias("known"), F.concat("skip", F.array("j")).alias("skip")))
    return chosen


def without(queries: DataFrame, skip: DataFrame) -> DataFrame:
    """Queries with the list ``skip`` of the frames (scene, query, img_id) that don't count for them."""
    return queries.join(_lists(skip), ["scene", "i"], "left")


def _lists(skip: DataFrame) -> DataFrame:
    return skip.groupBy("scene", F.col("query").alias("i")).agg(F.collect_list("img_id").alias("skip"))


def nearest(v: Vectors, k: int, nulls_first: bool = False, skip: DataFrame | None = None, keys: DataFrame | None = None) -> DataFrame:
    """(scene, i, j, s): past pairs, at least those that are among the k of greatest product of a query, earlier frame first.

    Unknown products come last, or first. ``skip`` (scene, query, img_id) are pairs left out, ``keys`` (scene, img_id) the
    frames to choose from, each as often as it is listed.
    """
    frames, _, large = ready(v, False)
    digits, unknown = v.digits, np.finfo(float).max * (1 if nulls_first else -1)

    def body(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        past, x, y = _past(a, b), _stack(a["vec"]), _stack(b["vec"])
        known = a["ok"].to_numpy()[:, None] & b["ok"].to_numpy()[None, :]
        s = np.where(past, np.where(known, x @ y.T, unknown), -np.inf)
        least = np.partition(s, -k, axis=1)[:, -k] if k < s.shape[1] else np.full(len(s), -np.inf)
        slack = NEAR * np.maximum(1.0, np.where(known & past, np.abs(s), 0.0).max(1))
        r, c = np.nonzero(past & (s >= (least - slack)[:, None]))
        exact = np.where(known[r, c], product(x[r], y[c], digits), unknown)
        order = np.lexsort((c, -exact, r))
        r, c, exact = r[order], c[order], exact[order]
        keep = np.arange(len(r)) - np.searchsorted(r, r) < k
        r, c, exact = r[keep], c[keep], exact[keep]
        return _rows(a, b, r, c, s=exact if known[r, c].all() else np.where(known[r, c], exact.astype(object), None))

    def in_place(b: pd.DataFrame, q: np.ndarray, own: pd.DataFrame) -> pd.DataFrame:
        a = _queries(b, q)
        if len(own):
            lists = dict(zip(own["i"], own["skip"]))
            a["skip"] = pd.Series([lists.get(i) for i in a["i"]], dtype=object)
        return body(a, b)

    fields = _fields(frames, T.StructField("s", T.DoubleType()))
    apart, found = frames, None
    if keys is None:
        found, apart = _in_place(frames, fields, in_place, None if skip is None else _lists(skip)), frames.where("not whole")
    if keys is not None or large:
        queries = apart.withColumnRenamed("img_id", "i").drop("last", "whole")
        queries = cut(without(queries, skip)) if skip is not None else queries
        apart = apart if keys is None else cut(apart.join(keys.select("scene", "img_id"), ["scene", "img_id"]))
        met = _meet(queries, apart.drop("last", "whole"), fields, body)
        found = met if found is None else found.unionByName(met)
    return found


def drawn(v: Vectors, k: int) -> DataFrame:
    """(scene, i, j, key): past pairs, at least those of the k greatest keys ln(u) / s of a query over s > 0; u is a hash of the pair."""
    frames, _, _ = ready(v, False)
    digits = v.digits
    frames = frames.drop("last", "whole").withColumn("name", F.col("img_id").cast("string"))
    queries = frames.withColumnRenamed("img_id", "i").withColumn("name", F.concat(F.col("scene").cast("string"), F.lit("|"), "name", F.lit("|")))

    def body(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        x, y = _stack(a["vec"]), _stack(b["vec"])
        known = _past(a, b) & a["ok"].to_numpy()[:, None] & b["ok"].to_numpy()[None, :]
        s = np.where(known, x @ y.T, -np.inf)
        r, c = np.nonzero(known & (np.abs(s) <= NEAR))  # the sign of these is not sure
        s[r, c] = product(x[r], y[c], digits)
        r, c = np.nonzero(s > 0)
        heads, tails = [t.encode() for t in a["name"]], [t.encode() for t in b["name"]]
        digests = b"".join([sha256(heads[p] + tails[q]).digest()[:4] for p, q in zip(r.tolist(), c.tolist())])
        ln = np.log((np.frombuffer(digests, ">u4").astype(float) + 0.5) / 2.0 ** 32)
        key = np.full(s.shape, -np.inf)
        key[r, c] = ln / s[r, c]
        least = np.partition(key, -k, axis=1)[:, -k] if k < key.shape[1] else np.full(len(key), -np.inf)
        keep = key[r, c] >= (least * (1 + TINY))[r]
        r, c, ln = r[keep], c[keep], ln[keep]
        return _rows(a, b, r, c, key=ln / product(x[r], y[c], digits))

    return _meet(queries, frames, _fields(frames, T.StructField("key", T.DoubleType())), body)


def left_over(v: Vectors, skip: DataFrame) -> DataFrame:
    """(scene, query, n): how many past frames of a query are not among ``skip`` (scene, query, img_id); none has no row."""
    frames, _, _ = ready(v, False)
    queries = cut(without(frames.withColumnRenamed("img_id", "i").select("scene", "i", "tile"), skip))
    fields = _fields(frames)[:2] + [T.StructField("n", T.LongType())]

    def body(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"scene": a["scene"], "i": a["i"], "n": _past(a, b).sum(1)})

    met = _meet(queries, frames.select("scene", "img_id", "tile"), fields, body)
    return met.groupBy("scene", F.col("i").alias("query")).agg(F.sum("n").alias("n")).where("n > 0")
