"""Keypoints, flows and grids against sequential code."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.functions import camera
from sightline.operators import cloud, graph, grid, matching, tracks


def greedy(peaks, k, cap=None):
    r, kept = k // 2, []
    for x, y, s in sorted(peaks, key=lambda p: (-p[2], p[1], p[0])):
        if all(abs(x - a) > r or abs(y - b) > r for a, b, _ in kept):
            kept.append((x, y, s))
    return {(x, y) for x, y, _ in kept[:cap]}


@pytest.mark.parametrize("k", [3, 8])
def test_nms_equals_greedy(spark, k):
    rng = np.random.default_rng(k)
    pts = {(int(x), int(y)) for x, y in rng.integers(0, 40, (150, 2))}
    peaks = [(x, y, float(rng.integers(1, 12))) for x, y in pts]
    df = spark.createDataFrame([(0, *p) for p in peaks], "src long, px long, py long, score double")
    got = {(r["px"], r["py"]) for r in matching.nms(df, k).collect()}
    assert got == greedy(peaks, k)
    capped = {(r["px"], r["py"]) for r in matching.nms(df, k, 5).collect()}
    assert capped == greedy(peaks, k, 5)


def test_local_maxima_keeps_plateaus(spark):
    m = np.zeros((6, 7))
    m[1, 1] = m[1, 2] = 3.0
    m[4, 6] = 2.0
    m[4, 4] = 1.0
    df = spark.createDataFrame([(0, x, y, float(m[y, x])) for y in range(6) for x in range(7)], "src long, px long, py long, score double")
    got = {(r["px"], r["py"]) for r in grid.local_maxima(df).collect()}
    pad = np.pad(m, 1, constant_values=-1)
    want = {(x, y) for y in range(6) for x in range(7) if m[y, x] > 0 and m[y, x] == pad[y:y + 3, x:x + 3].max()}
    assert got == want and (1, 1) in got and (2, 1) in got


def test_zoom_of_linear_flow(spark):
    rows = [(0, 1, x, y, 2.0 * x + 1, 3.0 * y, 200) for x in range(5) for y in range(4)]
    flows = spark.createDataFrame(rows, "src long, tgt long, px long, py long, qx double, qy double, score int")
    kpts = spark.createDataFrame([(0, 0, 0), (0, 2, 1), (0, 4, 3)], "src long, px long, py long")
    sizes = spark.createDataFrame([(0, 5, 4)], "src long, width long, height long")
    z = [r["zoom"] for r in matching.local_zoom(flows, kpts, sizes).collect()]
    assert np.allclose(z, np.sqrt(6)) and len(z) == 3
    holed = flows.where("not (px = 1 and py = 1)")
    got = {(r["px"], r["py"]): r["zoom"] for r in matching.local_zoom(holed, kpts, sizes).collect()}
    assert got[2, 1] == 0 and got[4, 3] > 0


def test_null_candidate_and_last_writer(spark):
    c = spark.createDataFrame([(0, 0.2, 1, 7.0), (0, 0.2, 0, 8.0), (1, 0.5, 0, 9.0), (2, 0.1, 0, 1.0)], "k int, score double, id int, q double")
    got = {r["k"]: (r["score"], r["q"]) for r in matching.best_match(c, ["k"], "score", ["id"], ["q"], 0.2).collect()}
    assert got == {0: (0.2, 8.0), 1: (0.5, 9.0), 2: (0.2, None)}
    a = spark.createDataFrame([(0, 1, 0, 0, 1.0), (0, 1, 1, 0, 2.0)], "src int, tgt int, px int, py int, qx double")
    out = {r["px"]: r["qx"] for r in matching.latest(a, a.where("px = 0").withColumn("qx", F.lit(5.0))).collect()}
    assert out == {0: 5.0, 1: 2.0}


def test_bilinear_against_numpy(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(6, 8))
    g = spark.createDataFrame([(0, 0, x, y, float(m[y, x])) for y in range(6) for x in range(8)], "scene int, img_id int, px long, py long, val double")
    pts = [(i, float(u), float(v)) for i, (u, v) in enumerate(rng.uniform(-1.5, 9.5, (50, 2)))]
    p = spark.createDataFrame([(0, 0, *q, 8, 6) for q in pts], "scene int, img_id int, id int, u double, v double, width int, height int")

    def ref(u, v, border):
        x, y = u - 0.5, v - 0.5
        if border:
            x, y = np.clip(x, 0, 7), np.clip(y, 0, 5)
        x0, y0 = int(np.floor(x)), int(np.floor(y))
        return sum(m[b, a] * (1 - abs(x - a)) * (1 - abs(y - b)) for a in (x0, x0 + 1) for b in (y0, y0 + 1)
                   if 0 <= a < 8 and 0 <= b < 6)
    for padding in ("border", "zeros"):
        got = {r["id"]: r["val"] for r in grid.sample(g, p, ["id"], ["val"], padding).collect()}
        assert len(got) == 50 and all(got[i] == pytest.approx(ref(u, v, padding == "border"), abs=1e-9) for i, u, v in pts)
    arr = g.withColumn("dep", F.array("val", F.col("val") * 2))
    got = {r["id"]: r["dep"] for r in grid.sample_array(arr, p, ["id"], "dep", 2).collect()}
    assert all(got[i][1] == pytest.approx(2 * ref(u, v, True), abs=1e-9) for i, u, v in pts)


def test_sampled_points_are_sent_once_to_their_tile(spark, monkeypatch):
    """Across tile borders and holes, with a pixel and a point listed twice; no point is multiplied by its corners."""
    monkeypatch.setattr(grid, "corners", None)
    rng = np.random.default_rng(1)
    m = rng.normal(size=(11, 13))
    cells = [(0, x, y, float(m[y, x])) for y in range(11) for x in range(13) if (x, y) != (5, 4)]
    g = spark.createDataFrame([*cells, (0, 8, 8, 1.0), (0, 2, 2, None), (None, 1, 1, 1.0)], "scene int, px long, py long, val double").withColumn("img_id", F.lit(0))
    pts = [(i, float(u), float(v)) for i, (u, v) in enumerate(rng.uniform(-1, 14, (150, 2)))]
    extra = [(200, 3.5, 3.5), (200, 3.5, 3.5), (201, 3.75, 7.5)]
    p = spark.createDataFrame([(0, 0, *q, 13, 11) for q in pts + extra], "scene int, img_id int, id int, u double, v double, width int, height int")
    got = {r["id"]: r["val"] for r in grid.sample(g, p, ["id"], ["val"]).collect()}
    zero = {r["id"]: r["val"] for r in grid.sample(g, p, ["id"], ["val"], "zeros").collect()}

    def ref(u, v, border):
        x, y = (np.clip(u - 0.5, 0, 12), np.clip(v - 0.5, 0, 10)) if border else (u - 0.5, v - 0.5)
        x0, y0 = int(np.floor(x)), int(np.floor(y))
        used = [(a, b, (1 - abs(x - a)) * (1 - abs(y - b))) for a in (x0, x0 + 1) for b in (y0, y0 + 1) if 0 <= a < 13 and 0 <= b < 11]
        used = [c for c in used if c[2] > 0]
        if border and any(c[:2] in ((5, 4), (2, 2)) for c in used):
            return None
        return sum(w * (0 if (a, b) == (5, 4) else m[b, a] + ((a, b) == (8, 8))) for a, b, w in used)

    assert None in got.values() and len(got) == len(zero) == 152
    for i, u, v in pts + extra[2:]:
        assert got[i] == (None if ref(u, v, True) is None else pytest.approx(ref(u, v, True), abs=1e-9))
        assert zero[i] == pytest.approx(ref(u, v, False), abs=1e-9)
    assert got[200] == pytest.approx(2 * m[3, 3])


def test_matched_points_are_the_same_for_a_list_of_pairs_of_any_size(spark):
    rng = np.random.default_rng(2)
    g = spark.createDataFrame([("s", i, x, y, float(rng.normal()), float(x), float(y)) for i in range(4) for x in range(6) for y in range(6)],
                              "scene string, img_id long, px long, py long, x double, y double, z double")
    o = spark.createDataFrame([("s", i, k, *rng.uniform(0.5, 5.5, 2).tolist()) for i in range(4) for k in range(12) if (i + k) % 3],
                              "scene string, img_id long, track_id long, u double, v double")
    v = spark.createDataFrame([("s", i, 6, 6) for i in range(4)], "scene string, img_id long, width long, height long")
    pairs = spark.createDataFrame([("s", 0, 1), ("s", 3, 1), ("s", 0, 3)], "scene string, i long, j long")
    take = lambda: sorted((r.i, r.j, r.track_id, tuple(r.pi), tuple(r.pj)) for r in cloud.match3d(o, g, v, pairs).collect())
    few = take()
    spark.conf.set("spark.sightline.maxBroadcastBytes", "1")
    try:
        assert few == take() and {r[:2] for r in few} == {(0, 1), (3, 1), (0, 3)}
    finally:
        spark.conf.unset("spark.sightline.maxBroadcastBytes")


def test_surfaces_are_joined_in_tiles_before_the_rounds(spark, monkeypatch):
    """Sizes as from all edges, over borders of tiles, with holes, a pixel listed twice and null keys; only shared pixels reach the rounds."""
    rng = np.random.default_rng(3)
    rows = [("s", i, x, y, float(rng.choice([1.0, 1.05, 3.0], p=[0.5, 0.3, 0.2])), 5.0) for i in range(2) for x in range(30) for y in range(40) if rng.random() < 0.75]
    rows += [("s", 0, 3, 3, 9.0, 5.0), ("s", 0, 3, 3, 1.0, 5.0), ("s", 1, 40, 50, None, 5.0), (None, 0, 1, 1, 1.0, 5.0), ("s", 1, None, 1, 1.0, 5.0), ("s", 1, 45, 50, float("nan"), 5.0)]
    g = spark.createDataFrame(rows, "scene string, img_id long, px long, py long, depth double, conf double")
    v = spark.createDataFrame([("s", i, 30, 40, 60.0 + i, 60.0) for i in range(2)], "scene string, img_id long, width long, height long, fx double, fy double")
    edges = cloud.surface_edges(g, v, 0.06).count()
    comp = graph.components(cloud.surface_edges(g, v, 0.06))
    n = {(*r.scene, r.node): r["count"] for r in comp.join(comp.groupBy("scene", "component").count(), ["scene", "component"]).collect()}
    want = sorted((i, x, y, str(z), n.get((s, i, y * cloud.ROW + x), 1)) for s, i, x, y, z, _ in rows if None not in (s, x))
    assert len({w[-1] for w in want}) > 5
    for side in (8, 128):
        monkeypatch.setattr(cloud, "SURFACE_TILE", side)
        seen = []
        monkeypatch.setattr(cloud, "components", lambda e: seen.append(e.count()) or graph.components(e))
        got = cloud._surfaces(g, v, 0.06).where("scene is not null and px is not null").collect()
        assert sorted((r.img_id, r.px, r.py, str(r.depth), r["_n"]) for r in got) == want
        assert seen[0] < edges / (2 if side == 8 else 8)  # those at the borders of tiles
    out = cloud.denoise_floating(g, v, 0.06, 4).collect()
    assert sorted((r.px, r.py) for r in out if r.scene and r.px is not None and r.img_id == 1 and r.conf) == sorted(w[1:3] for w in want if w[0] == 1 and w[-1] >= 4)


def test_gather_rejects_single_image_tracks(spark):
    t = spark.createDataFrame([("s", 1, 0, 1.0, 1.0), ("s", 1, 1, 1.0, 1.0), ("s", 2, 0, 1.0, 1.0), ("s", 2, 1, float("nan"), 1.0)],
                              "scene string, track_id long, img_id long, u double, v double")
    g = spark.createDataFrame([("s", i, x, y, [1.0, 2.0]) for i in range(2) for x in range(3) for y in range(3)],
                              "scene string, img_id long, px long, py long, dep array<double>")
    sizes = spark.createDataFrame([("s", 0, 3, 3), ("s", 1, 3, 3)], "scene string, img_id long, width int, height int")
    with pytest.raises(ValueError):
        matching.gather(t, g, sizes, 2)
    assert matching.gather(t, g, sizes, 2, "drop").count() == 2


def test_inclusion_rules(spark):
    S = "scene string, img_id long, track_id long, u double, v double"
    old = spark.createDataFrame([("s", 0, 1, 10.0, 10.0), ("s", 1, 1, 20.0, 20.0), ("s", 0, 2, 50.0, 50.0), ("s", 0, 3, 10.0, 12.0), ("s", 2, 3, 1.0, 1.0)], S)
    new = spark.createDataFrame([("s", 0, 7, 12.0, 12.0), ("s", 1, 7, 20.0, 23.0), ("s", 0, 8, 55.0, 50.0)], S)
    assert [r["track_id"] for r in tracks.duplicated(old, new, 5.0).collect()] == [1]


V = "scene string, img_id long, width long, height long, fx double, fy double, cx double, cy double, cam2w struct<r:array<double>,t:array<double>>"
EYE = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]


def test_floating_speck_is_removed(spark):
    px = [("s", 0, x, y, 1.0 if (x, y) in ((3, 3), (4, 3)) else 2.0, 5.0) for x in range(8) for y in range(6) if (x, y) != (7, 5)]
    g = spark.createDataFrame(px, "scene string, img_id long, px long, py long, depth double, conf double")
    v = spark.createDataFrame([("s", 0, 8, 6, 50.0, 50.0, 4.0, 3.0, (EYE, [0.0] * 3))], V)
    out = cloud.denoise_floating(g, v, 0.1, 3)
    bad = {(r["px"], r["py"]) for r in out.where("depth is null").collect()}
    assert bad == {(3, 3), (4, 3)} and out.where("conf = 0").count() == 2


def test_carving_removes_point_in_front(spark):
    plane = [("s", 0, x, y, 2.0, 5.0) for x in range(8) for y in range(6)]
    other = [("s", 1, x, y, 1.0 if (x, y) == (4, 3) else 2.0, 3.0) for x in range(8) for y in range(6)]
    g = spark.createDataFrame(plane + other, "scene string, img_id long, px long, py long, depth double, conf double")
    v = spark.createDataFrame([("s", i, 8, 6, 20.0, 20.0, 4.0, 3.0, (EYE, [0.01 * i, 0.0, 0.0])) for i in range(2)], V)
    got = [(r["img_id"], r["px"], r["py"]) for r in cloud.carved_points(g, v).collect()]
    assert got == [(1, 4, 3)]
    sure = g.withColumn("conf", F.when(F.col("img_id") == 1, 9.0).otherwise(F.col("conf")))
    assert cloud.carved_points(sure, v).isEmpty() and not cloud.carved_points(sure, v, use_conf=False).isEmpty()


def test_tiles_meet_only_views_they_can_show_up_in(spark):
    rng = np.random.default_rng(5)
    turn = lambda a: [float(np.cos(a)), 0.0, float(np.sin(a)), 0.0, 1.0, 0.0, -float(np.sin(a)), 0.0, float(np.cos(a))]
    cams = [("s", i, 40, 36, 45.0, 45.0, 20.0, 18.0, (turn(2 * np.pi * i / 12), rng.normal(size=3).tolist())) for i in range(12)]
    rows = [("s", i, x, y, float(np.exp(rng.normal()) * rng.choice([1, 1, 1, -1])), 1.0) for i in range(12) for x in range(0, 40, 3) for y in range(0, 36, 3)]
    rows += [("s", 0, 1, 1, None, 1.0), ("s", 0, 1, 2, float("nan"), 1.0), ("s", 0, 2, 2, float("inf"), 1.0)]
    g = spark.createDataFrame(rows, "scene string, img_id long, px long, py long, depth double, conf double")
    v = spark.createDataFrame(cams, V)
    got = {(r["img_id"], r["px"], r["py"], r["seen_in"]): (r["u"], r["v"]) for r in cloud.visible_in_others(g, v).collect()}
    want = {}
    for _, i, x, y, d, _ in rows:
        if d is None or not np.isfinite(d):
            continue
        p = np.array(cams[i][8][0]).reshape(3, 3) @ (np.array([(x + 0.5 - 20) / 45, (y + 0.5 - 18) / 45, 1]) * d) + cams[i][8][1]
        for _, j, *_, (r, t) in cams:
            q = np.array(r).reshape(3, 3).T @ (p - t)
            if i != j and q[2] > 0:
                at = 45 * q[0] / q[2] + 20, 45 * q[1] / q[2] + 18
                if -0.5 < at[0] < 40.5 and -0.5 < at[1] < 36.5:
                    want[i, x, y, j] = at
    assert got.keys() == want.keys() and len(want) > 500
    assert all(got[k] == pytest.approx(w, abs=1e-6) for k, w in want.items())
    # narrow depth ranges: most pairs of views and tiles are gone before a pixel is looked at
    flat = g.where("depth > 0").withColumn("depth", F.lit(2.0))
    still = v.withColumn("cam2w", F.struct(F.col("cam2w.r").alias("r"), F.array(*[F.lit(0.0)] * 3).alias("t")))
    seen = cloud.visible_in_others(flat, still)
    views, met = cloud.meeting_tiles(flat, cloud.view_pairs(still))
    tried = flat.withColumns({"_tx": F.floor(F.col("px") / 16), "_ty": F.floor(F.col("py") / 16)}).join(met, ["scene", "img_id", "_tx", "_ty"]).count()
    assert views.count() < 12 * 11 / 2 and seen.count() <= tried < 3 * seen.count() < flat.count() * 11


def test_focal_of_exact_pointmap(spark):
    v = spark.createDataFrame([("s", 0, 12, 10, 30.0, 30.0, 6.0, 5.0, (EYE, [0.0] * 3))], V)
    rng = np.random.default_rng(0)
    rows = [("s", 0, x, y, float(d), 1.0) for x in range(12) for y in range(10) for d in [rng.uniform(1, 3)]]
    g = spark.createDataFrame(rows, "scene string, img_id long, px long, py long, depth double, conf double")
    pts = cloud.unproject_pixels(g, v, world=False)
    for mode in ("median", "weiszfeld"):
        assert cloud.focal(pts, v, mode, offset=0.5).first()["focal"] == pytest.approx(30.0, rel=1e-6)


def test_tangent_loss_zero_for_equal_maps(spark):
    v = spark.createDataFrame([("s", 0, 6, 5, 30.0, 30.0, 3.0, 2.5, (EYE, [0.0] * 3))], V)
    g = spark.createDataFrame([("s", 0, x, y, 2.0 + 0.01 * x, 1.0) for x in range(6) for y in range(5)], "scene string, img_id long, px long, py long, depth double, conf double")
    pts = cloud.unproject_pixels(g, v, world=False)
    assert cloud.tangent_loss(pts, pts, v).first()["tangent_loss"] == pytest.approx(0, abs=1e-12)
    bent = pts.withColumn("z", F.col("z") + F.col("px") % 2)
    assert cloud.tangent_loss(bent, pts, v).first()["tangent_loss"] > 1e-6


def test_used_channels_and_init():
    assert camera.used_channels(None, 17) == 17
    assert camera.used_channels([1, 2], 17) == 2 and camera.used_channels([3], 17) == 4
    assert camera.used_channels(17, 17) == 17 and camera.used_channels([3], 17, "linear") == 3
