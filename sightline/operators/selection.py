"""Choosing which past frames to match a query frame with.

Strategies take ``frames(scene, img_id)`` numbered in time and ``sim(scene, i, j, s)`` with j < i, and
return ``(scene, query, img_id)``. All look at past frames only. All queries of all scenes advance
together, so a strategy with k greedy steps takes k rounds whatever the number of queries. In place of the table ``sim``,
which has a row per pair, they take ``Vectors``: the same choices from the descriptors (``sightline.operators.past``).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.camera import array_dot, let, normalise
from sightline.functions.pose import clip
from sightline.operators import past as by_vectors
from sightline.operators.clustering import coreset_hclust_past
from sightline.operators.ordered import cap_pairs, pair_partitions, pairs_within, row_number, sum_vectors, top_k
from sightline.operators.past import Vectors
from sightline.operators.retrieval import dimension, past_similar
from sightline.scale import broadcast_if_small, cut

TINY = 1e-6
Group = ["scene", "query"]


def unit_hash(*cols: str | Column) -> Column:
    """Reproducible number in (0, 1) from the text of the columns."""
    first = F.conv(F.substring(F.sha2(F.concat_ws("|", *cols), 256), 1, 8), 16, 10).cast("double")
    return (first + 0.5) / float(2 ** 32)


def similarity(glob: DataFrame) -> DataFrame:
    """Cosine of every past pair of a scene: (scene, i, j, s) with j < i, as the matrix strategies need it."""
    p = pairs_within(glob.select("scene", "img_id", "vec"), ["scene"], ["img_id"])
    return p.select("scene", F.col("b.img_id").alias("i"), F.col("a.img_id").alias("j"),
                    array_dot(F.col("a.vec"), F.col("b.vec")).alias("s"))


def symmetric(sim: DataFrame) -> DataFrame:
    return sim.select("scene", "i", "j", "s").unionByName(sim.select("scene", F.col("j").alias("i"), F.col("i").alias("j"), "s"))


def all_past(frames: DataFrame) -> DataFrame:
    p = pairs_within(frames.select("scene", "img_id"), ["scene"], ["img_id"])
    return p.select("scene", F.col("b.img_id").alias("query"), F.col("a.img_id").alias("img_id"))


def last(frames: DataFrame, k: int) -> DataFrame:
    """The k frames before each frame."""
    n = row_number(frames.select("scene", "img_id"), ["scene"], ["img_id"], "_n")
    want = n.select("scene", F.col("img_id").alias("query"), F.explode(F.sequence(
        F.greatest(F.col("_n") - k, F.lit(0)), F.col("_n") - 1)).alias("_n"))
    return want.join(n, ["scene", "_n"]).select("scene", "query", "img_id")


def topsim(sim: DataFrame | Vectors, k: int) -> DataFrame:
    """The k most similar past frames, earlier frame first on ties."""
    if isinstance(sim, Vectors):
        sim = by_vectors.nearest(sim, k)
    best = top_k(sim, ["scene", "i"], [F.col("s").desc(), F.col("j")], k)
    return best.select("scene", F.col("i").alias("query"), F.col("j").alias("img_id"))


def diverse(sim: DataFrame | Vectors, k: int, kind: str = "max", diag: float = 1.0) -> DataFrame:
    """Greedy choice by similarity to the query times dissimilarity to what is chosen already.

    ``kind`` aggregates the similarity to the chosen frames: max, avg or rmse. Similarities are shifted by
    the scene minimum, divided by the self-similarity and clipped to [0, 1].
    """
    if isinstance(sim, Vectors):
        return by_vectors.rounds(sim, k, kind, diag)
    low = sim.groupBy("scene").agg(F.least(F.min("s"), F.lit(diag)).alias("_m"))
    norm = sim.join(low, "scene").select("scene", "i", "j", clip(
        (F.col("s") - F.col("_m") + TINY) / (diag - F.col("_m") + TINY), 0.0, 1.0).alias("s"))
    norm = cut(norm)
    links = symmetric(norm).select("scene", F.col("i").alias("img_id"), F.col("j").alias("_c"), F.col("s").alias("_sc"))
    cand = norm.select("scene", F.col("i").alias("query"), F.col("j").alias("img_id"),
                       F.greatest("s", F.lit(TINY)).alias("s"), F.lit(0.0).alias("acc"))
    chosen: DataFrame | None = None
    for step in range(k):
        agg = {"max": F.col("acc"), "avg": F.col("acc") / max(step, 1), "rmse": F.sqrt(F.col("acc") / max(step, 1))}[kind]
        score = F.col("s") if step == 0 else F.col("s") * F.greatest(1 - agg, F.lit(TINY))
        # one winner per query: a max with map-side combine, no sort
        best = cut(cand.groupBy(*Group).agg(F.min_by("img_id", F.struct(-score, "img_id")).alias("img_id")))
        chosen = best if chosen is None else chosen.unionByName(best)
        if step == k - 1 or best.isEmpty():
            break
        new = best.select(*Group, F.col("img_id").alias("_c"))
        joined = cand.join(new, Group).where(F.col("img_id") != F.col("_c")).join(links, ["scene", "img_id", "_c"], "left")
        sc = F.coalesce("_sc", F.lit(0.0))
        acc = {"max": F.greatest("acc", sc), "avg": F.col("acc") + sc, "rmse": F.col("acc") + sc * sc}[kind]
        cand = cut(joined.select(*Group, "img_id", "s", acc.alias("acc")))
    return chosen if chosen is not None else cand.select(*Group, "img_id").limit(0)


def diverse_by_descriptor(glob: DataFrame, k: int, kind: str = "max", diag: float = 1.0, width: int | None = None,
                          widest: int = 64, tile: int = 2048) -> DataFrame:
    """``diverse`` on cosines of the descriptors, without a table of all pairs.

    Scenes whose vectors fit the broadcast limit go through ``diverse`` on the vectors, which makes all rounds where a query
    meets its past. For the others: a candidate's score never exceeds its similarity to the query. So each query is decided on its ``width`` most
    similar past frames (8 k by default) whenever every winner scores above the least similar of them; what lies
    outside then can't have won. Queries that this doesn't prove are asked again four times as wide, and those
    undecided at ``widest`` go through the passes of ``diverse``: each width moves that many vectors a query, the passes
    a few. Cosines are rounded to twelve digits, so equal frames tie.
    """
    unit = glob.select("scene", "img_id", normalise(F.col("vec").cast("array<double>")).alias("vec"))
    scenes = by_vectors.whole_scenes(Vectors(unit))
    if scenes.where("not whole").isEmpty():
        return diverse(Vectors(unit, digits=12), k, kind, diag)
    small = broadcast_if_small(scenes.where("whole").select("scene"))
    done = diverse(Vectors(unit.join(small, "scene", "left_semi"), digits=12), k, kind, diag)
    unit = cut(unit.join(small, "scene", "left_anti"))
    width = max(k, width or 8 * k)
    top, low = past_similar(unit, width, tile=tile)
    low = cut(low.select("scene", F.least("low", F.lit(diag)).alias("low")))
    types = {f.name: f.dataType.simpleString() for f in unit.schema.fields}
    schema = f"scene {types['scene']}, query {types['img_id']}, img_id {types['img_id']}"
    cosine = lambda c: F.round(c, 12)

    def choose(width: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
        def pick(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("j")
            ids, vecs, base = pdf["j"].to_numpy(), np.stack(pdf["vec"].to_numpy()), float(pdf["low"].iloc[0])
            norm = lambda x: np.clip((x - base + TINY) / (diag - base + TINY), 0, 1)
            near = np.maximum(norm(pdf["s"].to_numpy()), TINY)
            bound = -1.0 if len(ids) < width else float(near.min()) + 1e-9
            acc, free, chosen = np.zeros(len(ids)), np.ones(len(ids), bool), []
            while len(chosen) < min(k, len(ids)):
                n = max(len(chosen), 1)
                agg = {"max": acc, "avg": acc / n, "rmse": np.sqrt(acc / n)}[kind]
                score = np.where(free, near * np.maximum(1 - agg, TINY) if chosen else near, -1.0)
                best = int(score.argmax())
                if score[best] <= bound:
                    return pd.DataFrame({"scene": [key[0]], "query": [key[1]], "img_id": pd.Series([None], dtype="Int64")})
                chosen.append(best)
                free[best] = False
                r = norm(np.round((vecs * vecs[best]).sum(1), 12))
                acc = np.maximum(acc, r) if kind == "max" else acc + (r if kind == "avg" else r * r)
            return pd.DataFrame({"scene": key[0], "query": key[1], "img_id": ids[chosen]})
        return pick

    chosen = done
    while True:
        cand = top.join(unit.withColumnRenamed("img_id", "j"), ["scene", "j"]).join(low, "scene").withColumn("s", cosine("s"))
        tried = cut(cand.groupBy("scene", "i").applyInPandas(choose(width), schema))
        sure = tried.where(F.col("img_id").isNotNull())
        chosen = chosen.unionByName(sure)
        open_ = tried.where(F.col("img_id").isNull()).select("scene", "query")
        if open_.isEmpty():
            return chosen
        width *= 4
        if width > widest:
            rest = diverse(Vectors(unit, digits=12), k, kind, diag)
            return chosen.unionByName(rest.join(open_, Group, "left_semi").select(*chosen.columns))
        top, _ = past_similar(unit, width, open_.select("scene", F.col("query").alias("i")), tile)


def coreset_fps_by_descriptor(glob: DataFrame, n: int) -> DataFrame:
    """``coreset_fps`` on cosines of the descriptors: a round needs the descriptor of the frame chosen last, not its row of a matrix."""
    return _fps_by_vectors(glob.select("scene", "img_id", normalise(F.col("vec").cast("array<double>")).alias("vec")).where("scene is not null"), n, 12)


def _fps_by_vectors(glob: DataFrame, n: int, digits: int | None) -> DataFrame:
    dist = glob.select("scene", "img_id", F.col("vec").cast("array<double>").alias("vec"), F.lit(float("inf")).alias("d"))
    start = unit_hash(F.col("scene").cast("string"), F.col("img_id").cast("string"))
    chosen: DataFrame | None = None
    for step in range(n):
        order = F.struct(start if step == 0 else -F.col("d"), F.col("img_id"))
        best = cut(dist.groupBy("scene").agg(F.min_by(F.struct("img_id", "vec"), order).alias("b"))
                   .select("scene", F.col("b.img_id").alias("img_id"), F.col("b.vec").alias("vec"), F.lit(step).alias("step")))
        chosen = best if chosen is None else chosen.unionByName(best)
        if step == n - 1 or best.isEmpty():
            break
        near = broadcast_if_small(best.select("scene", F.col("img_id").alias("_c"), F.col("vec").alias("_v")))
        other = F.col("img_id") != F.col("_c")
        away = 1 - array_dot(F.col("vec"), F.col("_v"))
        # frames without a known distance count as unlike
        away = F.coalesce(F.when(other, away if digits is None else F.round(away, digits)), F.lit(1.0))
        dist = cut(dist.join(near, "scene", "left").where(F.coalesce(other, F.lit(True))).select("scene", "img_id", "vec", F.least("d", away).alias("d")))
    return (chosen if chosen is not None else dist.select("scene", "img_id", F.lit(0).alias("step")).limit(0)).select("scene", "img_id", "step")


def coreset_fps(sim: DataFrame | Vectors, frames: DataFrame, n: int) -> DataFrame:
    """(scene, img_id, step): n frames far from each other on 1 − s, from a start drawn by hash.

    The running distance to the chosen set has one row per frame; a round joins it with the row of the
    frame chosen last.
    """
    if isinstance(sim, Vectors):
        return _fps_by_vectors(sim.glob, n, sim.digits)
    links = cut(symmetric(sim))
    dist = frames.select("scene", "img_id", F.lit(float("inf")).alias("d"))
    start = unit_hash(F.col("scene").cast("string"), F.col("img_id").cast("string"))
    chosen: DataFrame | None = None
    for step in range(n):
        order = F.struct(start if step == 0 else -F.col("d"), F.col("img_id"))
        best = cut(dist.groupBy("scene").agg(F.min_by("img_id", order).alias("img_id")).withColumn("step", F.lit(step)))
        chosen = best if chosen is None else chosen.unionByName(best)
        if step == n - 1 or best.isEmpty():
            break
        row = links.join(best.select("scene", F.col("img_id").alias("j")), ["scene", "j"]).select(
            "scene", F.col("i").alias("img_id"), (1 - F.col("s")).alias("_d"))
        left = dist.join(best.select("scene", "img_id"), ["scene", "img_id"], "left_anti")
        dist = cut(left.join(row, ["scene", "img_id"], "left").select(
            "scene", "img_id", F.least("d", F.coalesce("_d", F.lit(1.0))).alias("d")))
    return chosen if chosen is not None else frames.select("scene", "img_id", F.lit(0).alias("step")).limit(0)


def coreset_fps_past(sim: DataFrame | Vectors, n: int) -> DataFrame:
    """(scene, query, img_id): the farthest-point coreset of the past of every frame."""
    if isinstance(sim, Vectors):
        first = unit_hash(F.col("scene").cast("string"), F.col("img_id").cast("string"))
        return by_vectors.rounds(sim, n, "far", start=first)
    links = cut(symmetric(sim).select("scene", F.col("i").alias("img_id"), F.col("j").alias("_c"), (1 - F.col("s")).alias("_d")))
    cand = sim.select("scene", F.col("i").alias("query"), F.col("j").alias("img_id"), F.lit(float("inf")).alias("d"))
    start = unit_hash(F.col("scene").cast("string"), F.col("img_id").cast("string"))
    chosen: DataFrame | None = None
    for step in range(n):
        order = F.struct(start if step == 0 else -F.col("d"), F.col("img_id"))
        best = cut(cand.groupBy(*Group).agg(F.min_by("img_id", order).alias("img_id")))
        chosen = best if chosen is None else chosen.unionByName(best)
        if step == n - 1 or best.isEmpty():
            break
        new = best.select(*Group, F.col("img_id").alias("_c"))
        joined = cand.join(new, Group).where(F.col("img_id") != F.col("_c")).join(links, ["scene", "img_id", "_c"], "left")
        cand = cut(joined.select(*Group, "img_id", F.least("d", F.coalesce("_d", F.lit(1.0))).alias("d")))
    return chosen if chosen is not None else cand.select(*Group, "img_id").limit(0)


def coreset_clusters(glob: DataFrame, n: int, rounds: int | None = None, moved: float = 1e-9) -> DataFrame:
    """(scene, cluster, img_id): the frame nearest to the mean of each of n clusters of a scene.

    Lloyd's k-means on the descriptors, all scenes in the same rounds, until no centre moves by more than the square root
    of ``moved``, or for ``rounds`` rounds where that is given. Where the descriptors of a scene fit the broadcast limit, one task makes
    all rounds. In others a scene's n centres travel as one row; the descriptors are only read and summed.
    """
    rows = cut(glob.select("scene", "img_id", F.col("vec").cast("array<double>").alias("vec")))
    start = unit_hash(F.col("scene").cast("string"), F.col("img_id").cast("string"))
    here = broadcast_if_small(cut(by_vectors.fitting(rows).select("scene")))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("img_id", ignore_index=True)
        x = np.ascontiguousarray(np.stack(pdf["vec"].to_numpy()), dtype=float)
        first = np.argsort(pdf["_h"].to_numpy(), kind="stable")[:n]
        at, frames = _lloyd(x, x[first], rounds, moved)
        return pd.DataFrame({"scene": pdf["scene"].iloc[0], "cluster": at, "img_id": pdf["img_id"].to_numpy()[frames]})

    mine = rows.join(here, "scene", "left_semi").withColumn("_h", start).repartitionByRange(4 * pair_partitions(rows), "scene")
    out = mine.groupBy("scene").applyInPandas(cluster, f"scene {kinds['scene']}, cluster int, img_id {kinds['img_id']}")
    rows = cut(rows.join(here, "scene", "left_anti").where("scene is not null"))
    return out if rows.isEmpty() else out.unionByName(_clusters_of_large(rows, start, n, rounds, moved))


def _lloyd(x: np.ndarray, centres: np.ndarray, rounds: int | None, moved: float) -> tuple[np.ndarray, np.ndarray]:
    """(clusters, the row of ``x`` nearest to the centre of each); clusters that lose all rows are gone."""
    names, going, done = np.arange(len(centres)), True, 0

    def assign() -> tuple[np.ndarray, np.ndarray]:
        d = np.stack([((x - c) ** 2).sum(1) for c in centres])
        at = d.argmin(0)
        return at, d[at, np.arange(len(x))]

    while going and (rounds is None or done < rounds):
        done += 1
        at, _ = assign()
        kept = np.unique(at)
        new = np.stack([x[at == c].mean(0) for c in kept])
        going = bool((((new - centres[kept]) ** 2).sum(1) > moved).any())
        names, centres = names[kept], new
    at, d = assign()
    kept = np.unique(at)
    return names[kept], np.array([np.flatnonzero(at == c)[d[at == c].argmin()] for c in kept])


def _clusters_of_large(rows: DataFrame, start: Column, n: int, rounds: int | None, moved: float) -> DataFrame:
    dim = dimension(rows)
    seeds = top_k(rows.withColumn("_h", start), ["scene"], [F.col("_h"), F.col("img_id")], n, "_k")
    centres = cut(seeds.select("scene", (F.col("_k") - 1).alias("cluster"), "vec"))

    def assign(c: DataFrame) -> DataFrame:
        packed = c.groupBy("scene").agg(F.sort_array(F.collect_list(F.struct("cluster", "vec"))).alias("_c"))
        far = lambda m: F.struct(F.aggregate(F.zip_with("vec", m["vec"], lambda a, b: (a - b) * (a - b)),
                                             F.lit(0.0), lambda s, v: s + v).alias("d"), m["cluster"].alias("cluster"))
        return rows.join(packed, "scene").withColumn("_m", F.array_min(F.transform("_c", far))).select(
            "scene", "img_id", "vec", F.col("_m.cluster").alias("cluster"), F.col("_m.d").alias("d"))

    going, done = True, 0
    while going and (rounds is None or done < rounds):
        done += 1
        sums = sum_vectors(assign(centres), ["scene", "cluster"], F.concat("vec", F.array(F.lit(1.0))), dim + 1)
        mean = let(F.col("vec"), lambda x: F.transform(F.slice(x, 1, dim), lambda v: v / F.get(x, F.lit(dim))))
        old, centres = centres, cut(sums.select("scene", "cluster", mean.alias("vec")))
        apart = F.aggregate(F.zip_with("vec", "_old", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
        going = not centres.join(old.select("scene", "cluster", F.col("vec").alias("_old")), ["scene", "cluster"]).where(apart > moved).isEmpty()
    return assign(centres).groupBy("scene", "cluster").agg(F.min_by("img_id", F.struct("d", "img_id")).alias("img_id"))


def outside(coreset: DataFrame, sim: DataFrame | Vectors) -> DataFrame:
    """(scene, query, n): the number of past frames outside a coreset (scene, query, img_id)."""
    if isinstance(sim, Vectors):
        return by_vectors.left_over(sim, coreset)
    past = sim.select("scene", F.col("i").alias("query"), F.col("j").alias("img_id"))
    return past.join(coreset, [*Group, "img_id"], "left_anti").groupBy(*Group).agg(F.count("*").alias("n"))


def coreset_fill(coreset: DataFrame, sim: DataFrame | Vectors, k: int) -> DataFrame:
    """Coreset frames first in time order, then the most similar others, cut to k per query.

    ``coreset`` is (scene, query, img_id).
    """
    if isinstance(sim, Vectors):
        coreset = cut(coreset)
        sim = by_vectors.nearest(sim, k, nulls_first=True, skip=coreset)
    past = sim.select("scene", F.col("i").alias("query"), F.col("j").alias("img_id"), "s")
    keys = [*Group, "img_id"]
    rest = past.join(coreset, keys, "left_anti").select(*keys, F.lit(1).alias("_p"), (-F.col("s")).alias("_o"))
    first = coreset.select(*keys, F.lit(0).alias("_p"), F.col("img_id").cast("double").alias("_o"))
    return top_k(first.unionByName(rest), Group, [F.col("_p"), F.col("_o"), F.col("img_id")], k).select(*keys)


def weighted_sample(sim: DataFrame | Vectors, k: int) -> DataFrame:
    """k past frames drawn without replacement with weight max(s, 0) (Efraimidis and Spirakis, 2006).

    The uniform number comes from a hash of the pair. Frames of zero weight are never drawn.
    """
    if isinstance(sim, Vectors):
        keyed = by_vectors.drawn(sim, k).withColumnRenamed("key", "_k")
    else:
        u = unit_hash(F.col("scene").cast("string"), F.col("i").cast("string"), F.col("j").cast("string"))
        keyed = sim.where(F.col("s") > 0).withColumn("_k", F.ln(u) / F.col("s"))
    best = top_k(keyed, ["scene", "i"], [F.col("_k").desc(), F.col("j")], k)
    return best.select("scene", F.col("i").alias("query"), F.col("j").alias("img_id"))


def retrieve(frames: DataFrame, sim: DataFrame | Vectors, mode: str, k: int) -> DataFrame:
    """Past frames to match each frame with, by strategy name.

    ``none``, ``last``, ``topsim``, ``divmax``, ``divavg``, ``divrmse``, ``coreset_fps_<n>``, ``coreset_hclust_<n>``,
    ``wgtrng``, and ``keyframe<step>-<mode>``, which takes three quarters from every ``step``-th frame.
    """
    simple: dict[str, Callable[[], DataFrame]] = {
        "none": lambda: all_past(frames), "last": lambda: last(frames, k), "topsim": lambda: topsim(sim, k),
        "divmax": lambda: diverse(sim, k, "max"), "divavg": lambda: diverse(sim, k, "avg"),
        "divrmse": lambda: diverse(sim, k, "rmse"), "wgtrng": lambda: weighted_sample(sim, k)}
    if mode in simple:
        return simple[mode]()
    if mode.startswith("coreset_fps_"):
        return coreset_fill(coreset_fps_past(sim, int(mode.rsplit("_", 1)[1])), sim, k)
    if isinstance(sim, Vectors) and not mode.startswith("keyframe"):
        sim = similarity(sim.glob)  # this strategy needs the table
    if mode.startswith("coreset_hclust_"):
        return coreset_fill(coreset_hclust_past(sim, int(mode.rsplit("_", 1)[1])), sim, k)
    if mode.startswith("keyframe"):
        head, inner = mode.split("-", 1)
        return keyframes(frames, sim, int(head[len("keyframe"):]), inner, k)
    raise ValueError(f"unknown retrieval mode {mode!r}")


def keyframes(frames: DataFrame, sim: DataFrame | Vectors, step: int, inner: str, k: int) -> DataFrame:
    """Three quarters of k from keyframes, the rest from other frames, each by the ``inner`` strategy.

    The inner strategy ``none`` sets no limit, so that all past frames are taken.
    """
    if inner == "none":
        return all_past(frames)
    n = row_number(frames.select("scene", "img_id"), ["scene"], ["img_id"], "_n")
    n = cut(n.withColumn("_key", (F.col("_n") - 1) % step == 0))
    want = 3 * k // 4
    if isinstance(sim, Vectors) and inner == "topsim":
        # no more than k frames of either sort are asked for
        near = [by_vectors.nearest(sim, max(k, want), keys=n.where(F.col("_key") == F.lit(key))).withColumn("_key", F.lit(key)) for key in (True, False)]
        past = cut(top_k(near[0].unionByName(near[1]), ["scene", "i", "_key"], [F.col("s").desc(), F.col("j")], max(k, want)))
    else:
        sim = cut(similarity(sim.glob)) if isinstance(sim, Vectors) else sim
        past = sim.join(n.select("scene", F.col("img_id").alias("j"), "_key"), ["scene", "j"])

    def side(key: bool, count: int) -> DataFrame:
        part = past.where(F.col("_key") == F.lit(key)).drop("_key")
        if inner == "last":  # ignores similarity: rank the allowed past by time
            return topsim(part.withColumn("s", F.col("j").cast("double")), count)
        return retrieve(frames, part, inner, count)

    first = cut(side(True, want))
    got = first.groupBy(*Group).agg(F.count("*").alias("_got"))
    # keyframes may run short early on, so the others are ranked and cut to what is still missing
    rest = side(False, k)
    if inner in ("topsim", "last"):
        order = [F.col("s").desc(), F.col("img_id")] if inner == "topsim" else [F.col("img_id").desc()]
        rest = rest.join(past.select("scene", F.col("i").alias("query"), F.col("j").alias("img_id"), "s"), [*Group, "img_id"])
        rest = top_k(rest, Group, order, k, "_r").join(got, Group, "left")
        rest = rest.where(F.col("_r") <= k - F.coalesce("_got", F.lit(0)))
        return first.unionByName(rest.select(*Group, "img_id"))
    out = first
    for have in range(want + 1):
        short = got.where(F.col("_got") == have) if have else sim.select("scene", F.col("i").alias("query")).distinct().join(got, Group, "left_anti")
        if short.isEmpty():
            continue
        mine = past.join(short.select("scene", F.col("query").alias("i")), ["scene", "i"], "left_semi").where(~F.col("_key")).drop("_key")
        out = out.unionByName(retrieve(frames, mine, inner, k - have).select(*Group, "img_id"))
    return out
