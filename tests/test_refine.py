"""Refinement on a planted scene: residuals vanish at the truth, the loss falls, poses come back."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sightline.operators import refine as rf
from sightline.operators.accuracy import ate


def rot(w):
    th = np.linalg.norm(w)
    k = np.array([[0, -w[2], w[1]], [w[2], 0, -w[0]], [-w[1], w[0], 0]]) / max(th, 1e-12)
    return np.eye(3) + np.sin(th) * k + (1 - np.cos(th)) * k @ k


def planted(spark, noise, seed=0):
    rng = np.random.default_rng(seed)
    pts = rng.uniform(-1, 1, (60, 3))
    obs, nodes = [], []
    for i in range(6):
        r = rot(np.array([0.05 * i, 0.2 * i - 0.5, 0.02]))
        t = np.array([0.1 * i - 0.3, 0.05, 4.0])
        cam = pts @ r.T + t
        uv = 500 * cam[:, :2] / cam[:, 2:] + [320, 240]
        rr, tt = (r, t) if i == 0 else (rot(rng.normal(0, noise, 3)) @ r, t + rng.normal(0, noise, 3))
        nodes.append(("s", i, rr.ravel().tolist(), tt.tolist()))
        obs += [("s", i, k, float(uv[k, 0]), float(uv[k, 1]), [float(np.log(cam[k, 2])), 1.0]) for k in range(60)]
    moved = pts + rng.normal(0, noise, pts.shape)
    o = spark.createDataFrame(obs, "scene string, img_id long, track_id long, u double, v double, dep array<double>")
    imgs = spark.createDataFrame([("s", i, 0, i, 1.0, [1.0, 0.0]) for i in range(6)],
                                 "scene string, img_id long, cam_id long, node_id long, scale double, z_coefs array<double>")
    cams = spark.createDataFrame([("s", 0, 500.0, 500.0, 320.0, 240.0, (np.eye(3).ravel().tolist(), [0.0] * 3))],
                                 "scene string, cam_id long, fx double, fy double, cx double, cy double, rig2cam struct<r:array<double>,t:array<double>>")
    nd = spark.createDataFrame([(s, i, (r, t)) for s, i, r, t in nodes], "scene string, node_id long, w2rig struct<r:array<double>,t:array<double>>")
    pt = spark.createDataFrame([("s", k, *map(float, moved[k])) for k in range(60)], "scene string, track_id long, x double, y double, z double")
    return o, rf.Scene(imgs, cams, nd, pt), pts


def test_truth_has_no_residual(spark):
    o, scene, _ = planted(spark, 0.0)
    row = rf.scene_loss(o, scene, rf.Phase()).first()
    assert row["loss"] < 1e-12 and row["score"] < 1e-6


def test_jacobian_matches_differences(spark):
    o, scene, _ = planted(spark, 0.02)
    pdf = rf.system_rows(o, scene).drop("w2cam").limit(40).toPandas()
    ph = rf.Phase(weight_z=1.0)
    for mode in ("log", "linear"):
        if mode == "linear":
            pdf["dep"] = pdf["dep"].map(lambda d: np.exp(d))
        res, _, jac, jx = rf._linearise(pdf, ph, mode, False)
        eps = 1e-6
        for k in range(8):
            moved = pdf.copy()
            if k < 2:
                moved["fx" if k == 0 else "fy"] += eps
            else:
                d = np.zeros(6)
                d[k - 2] = -eps  # the update applies exp(-d)
                step = pd.DataFrame({"scene": pdf["scene"], "node_id": pdf["node_id"], "r": pdf["wr"], "t": pdf["wt"], "d": [d] * len(pdf)})
                out = next(rf._expm(iter([step])))
                moved["wr"], moved["wt"] = out["r"], out["t"]
            num = (rf._linearise(moved, ph, mode, False)[0] - res) / eps
            assert np.allclose(num, jac[:, :, k], atol=2e-3, rtol=1e-3), (mode, k)
        for k, c in enumerate("xyz"):
            moved = pdf.copy()
            moved[c] += eps
            num = (rf._linearise(moved, ph, mode, False)[0] - res) / eps
            assert np.allclose(num, jx[:, :, k], atol=2e-3, rtol=1e-3)


def test_recovers_planted_poses(spark):
    o, scene, pts = planted(spark, 0.02)
    out, history = rf.refine(o, scene, [rf.Phase(max_iters=3, pnorm=2.0, weight_z=0.01, optim_k=False, min_reproj=0.0)], 2)
    h = history.orderBy("iteration").toPandas()
    assert h["loss"].iloc[-1] < h["loss"].iloc[0] / 1e4
    truth = spark.createDataFrame([(k, pts[k].tolist()) for k in range(60)], "track_id long, y array<double>")
    err = ate(out.points.select("scene", "track_id", F.array("x", "y", "z").alias("x")).join(truth, "track_id"))
    assert err.first()["ate_rmse"] < 1e-2


def test_degenerate_step_is_rejected(spark):
    o, scene, _ = planted(spark, 0.02)
    _, history = rf.refine(o, scene, [rf.Phase(max_iters=2, pnorm=2.0, min_reproj=1e6)], 2)
    assert history.count() == 1


def test_local_refinement_moves_only_the_listed_frame(spark):
    o, scene, _ = planted(spark, 0.01)
    only = spark.createDataFrame([("s", 5)], "scene string, img_id long")
    out, history = rf.refine(o, scene, [rf.Phase(max_iters=1, pnorm=2.0, optim_k=False, min_reproj=0.0)], 2, only=only)
    assert history.count() >= 2
    assert out.points.exceptAll(scene.points).isEmpty()
    old = {r["node_id"]: r["w2rig"]["t"] for r in scene.nodes.collect()}
    new = {r["node_id"]: r["w2rig"]["t"] for r in out.nodes.collect()}
    assert all(np.allclose(old[i], new[i]) for i in range(5)) and not np.allclose(old[5], new[5])


def test_phase_lists():
    assert [p.weight_z for p in rf.phases(weight_z=[0.1, 0.2], pnorm=1)] == [0.1, 0.2]
    with pytest.raises(ValueError):
        rf.phases(weight_z=[1, 2], pnorm=[1, 2, 3])


def _rows(df, *cols):
    return {tuple(r[c] for c in cols): r for r in df.collect()}


@pytest.mark.parametrize("mode", ["log", "linear"])
def test_a_scene_is_refined_in_one_task_without_pairs(spark, monkeypatch, mode):
    o, scene, _ = planted(spark, 0.01)
    if mode == "linear":
        o = o.withColumn("dep", F.array(F.exp(F.col("dep")[0]), F.lit(1.0)))
    # a frame listed twice, unknown tracks and pixels without a point, and a scene without observations
    dims = rf.Scene(scene.images.withColumn("note", F.lit("kept")).unionByName(scene.images.where("img_id = 5").withColumn("note", F.lit("again"))),
                    scene.cameras, scene.nodes.unionByName(scene.nodes.where("node_id = 5").withColumn("scene", F.lit("bare"))), scene.points)
    o = o.unionByName(o.where("img_id = 3").limit(1).withColumn("track_id", F.lit(None).cast("long"))).unionByName(
        o.where("img_id = 3").limit(1).withColumn("track_id", F.lit(999).cast("long")))
    plan = [rf.Phase(max_iters=1, pnorm=2.0, weight_z=0.01, optim_k=False, min_reproj=0.0)]
    blocks, called = rf.normal_blocks, []
    monkeypatch.setattr(rf, "normal_blocks", lambda *a, **k: called.append(1) or blocks(*a, **k))
    whole, told = rf.refine(o, dims, plan, 2, mode)
    assert not called
    monkeypatch.setattr(rf, "TASK_ROWS", 0)
    rounds, said = rf.refine(o, dims, plan, 2, mode)
    assert called
    a, b = (_rows(h, "scene", "phase", "iteration") for h in (told, said))
    assert a.keys() == b.keys() and len(a) == 2
    assert np.allclose([a["s", 0, 0][c] for c in ("loss", "score")], [b["s", 0, 0][c] for c in ("loss", "score")], rtol=1e-9)
    # the two solutions differ by a move of the whole scene
    assert max(h["s", 0, 1]["loss"] for h in (a, b)) < a["s", 0, 0]["loss"] / 20, (a, b)
    assert [t.columns for t in (whole.images, whole.cameras, whole.nodes, whole.points)] == [t.columns for t in (dims.images, dims.cameras, dims.nodes, dims.points)]
    a, b = (_rows(s.images, "img_id", "note") for s in (whole, rounds))
    assert a.keys() == b.keys() and len(a) == 7
    assert all(len(a[k]["z_coefs"]) == len(b[k]["z_coefs"]) == 2 for k in a) and a[5, "kept"]["z_coefs"] == a[5, "again"]["z_coefs"]
    a, b = (_rows(s.nodes, "scene", "node_id") for s in (whole, rounds))
    assert a.keys() == b.keys() and len(a) == 7 and a["bare", 5]["w2rig"] == b["bare", 5]["w2rig"]


def test_a_pixel_without_value_counts_alike_in_a_task_and_in_rounds(spark, monkeypatch):
    o, scene, _ = planted(spark, 0.01)
    o = o.withColumn("u", F.when(F.col("track_id") > 0, F.col("u")))
    plan = [rf.Phase(max_iters=1, pnorm=2.0, weight_z=0.01, optim_k=False, min_reproj=0.0)]
    one = _rows(rf.refine(o, scene, plan, 2)[1], "iteration")
    monkeypatch.setattr(rf, "TASK_ROWS", 0)
    many = _rows(rf.refine(o, scene, plan, 2)[1], "iteration")
    assert one.keys() == many.keys()
    assert np.allclose([one[0,][c] for c in ("loss", "score")], [many[0,][c] for c in ("loss", "score")], rtol=1e-9)


def test_conjugate_gradients_meet_the_tolerance_on_nearly_blind_directions():
    from sightline.operators import scene_task
    rng = np.random.default_rng(0)
    q, _ = np.linalg.qr(rng.normal(size=(40, 40)))
    m = (q * np.concatenate([[1e-9, 1e-8], np.linspace(0.1, 3, 38)])) @ q.T
    g, diag, damp = m @ rng.normal(size=40), np.diag(m).copy(), np.zeros(40)
    solved = scene_task.preconditioner(lambda p: m @ p, diag, damp, [(0, np.stack([m[k:k + 4, k:k + 4] for k in range(0, 40, 4)]))], q[:, :2])
    x = scene_task.conjugate_gradients(lambda p: m @ p, g, diag, damp, solved)
    assert np.linalg.norm(m @ x - g) < 1e-8 * np.linalg.norm(g)
    assert np.allclose(x, np.linalg.solve(m, g), atol=1e-4)


def test_the_query_refines_until_no_step_is_accepted(spark, monkeypatch):
    from sightline.plans import all_queries
    from sightline.plans.standins import Tables
    seen = []
    refine = rf.refine
    monkeypatch.setattr(rf, "refine", lambda o, s, plan, *a: seen.extend(plan) or refine(o, s, plan, *a))
    last = all_queries.QUERIES["refined_scene_loss"](Tables(spark, "/root/testdata/sf0.001")).groupBy("scene").agg(F.max("iteration").alias("n")).collect()
    assert seen == [rf.Phase()] and rf.Phase().max_iters == 100
    assert len(last) == 3 and all(2 < r["n"] < 100 for r in last)


def test_rows_of_an_image_are_summed_where_they_meet(spark, monkeypatch):
    o, scene, _ = planted(spark, 0.02)
    want = _rows(rf.normal_blocks(rf.system_rows(o, scene), rf.Phase(), 2, eliminate=False), "i")
    seen, total = [], rf.sum_vectors
    monkeypatch.setattr(rf, "sum_vectors", lambda parts, *a: seen.append(parts) or total(parts, *a))
    got = _rows(rf.normal_blocks(rf.system_rows(o.repartition(8, "track_id"), scene, by_image=True), rf.Phase(), 2, eliminate=False), "i")
    assert seen[0].count() == 6  # one partial sum per image
    assert got.keys() == want.keys() and all(np.allclose(got[k]["vec"], want[k]["vec"], rtol=1e-9) for k in want)


@pytest.mark.parametrize("group", [1, 4, 1024])
def test_blocks_of_pairs_are_made_where_groups_of_images_meet_their_tracks(spark, monkeypatch, group):
    o, scene, _ = planted(spark, 0.02)
    o = o.where("(img_id + track_id) % 3 > 0").unionByName(o.where("img_id < 3").withColumn("scene", F.lit("t")))
    o = o.unionByName(o.where("track_id = 7 and img_id = 1")).unionByName(o.limit(3).withColumn("track_id", F.lit(None).cast("long")))
    both = rf.Scene(*[t.unionByName(t.withColumn("scene", F.lit("t"))) for t in (scene.images, scene.cameras, scene.nodes, scene.points)])
    phase = rf.Phase(pnorm=2.0, weight_z=0.1)
    want = _rows(rf.normal_blocks(rf.system_rows(o, both), phase, 2), *rf.IDS)
    monkeypatch.setattr(rf, "GROUP", group)
    monkeypatch.setattr(rf, "sum_vectors", None)  # no block is summed after it left its task
    got = rf.normal_blocks(rf.system_rows(o.repartition(5), both, apart=True), phase, 2, scene=both).collect()
    assert len(got) == len(want) and {tuple(r[c] for c in rf.IDS) for r in got} == want.keys()
    assert all(np.allclose(r["vec"], want[tuple(r[c] for c in rf.IDS)]["vec"], rtol=1e-6, atol=1e-6 * np.abs(r["vec"]).max()) for r in got)


def test_images_of_a_group_are_summed_some_at_a_time(spark, monkeypatch):
    from types import SimpleNamespace
    from sightline.operators import scene_task
    o, scene, _ = planted(spark, 0.02)
    seen = []
    task = scene_task.grouped_blocks
    monkeypatch.setattr(scene_task, "grouped_blocks", lambda table, *a: seen.append((table.value, a)) or task(table, *a))
    rows = rf.system_rows(o, scene, apart=True)
    want = _rows(rf.normal_blocks(rows, rf.Phase(), 2, scene=scene), "i", "j")
    lists = rows.groupBy("scene", "track_id").agg(F.collect_list(F.struct("img_id", "u", "v", "su", "sv", "dep", "x", "y", "z")).alias("o"))
    table, options = seen[0]
    one = table.set_column(table.schema.get_field_index("_g"), "_g", [[0] * table.num_rows])
    monkeypatch.setattr(scene_task, "PAIRS", 7)
    got = [r for b in task(SimpleNamespace(value=one), *options)(iter(lists.withColumn("_g", F.lit(0)).coalesce(1).toArrow().to_batches())) for r in b.to_pylist()]
    assert {(r["i"], r["j"]) for r in got} == want.keys() and len(got) == len(want)
    assert all(np.allclose(r["vec"], want[r["i"], r["j"]]["vec"], rtol=1e-7, atol=1e-7 * np.abs(r["vec"]).max()) for r in got)


def test_an_unknown_pixel_takes_no_other_observation_along(spark):
    o, scene, _ = planted(spark, 0.02)
    hurt = o.withColumn("u", F.when(F.col("track_id") != 4, F.col("u")))
    for eliminate in (False, True):
        want = _rows(rf.normal_blocks(rf.system_rows(o.where("track_id <> 4"), scene), rf.Phase(), 2, eliminate=eliminate), "i", "j")
        forms = [rf.normal_blocks(rf.system_rows(hurt, scene, by_image=not eliminate), rf.Phase(), 2, eliminate=eliminate)]
        if eliminate:
            forms.append(rf.normal_blocks(rf.system_rows(hurt, scene, apart=True), rf.Phase(), 2, scene=scene))
        for form in forms:
            got = _rows(form, "i", "j")
            assert got.keys() == want.keys() and all(np.allclose(got[k]["vec"], want[k]["vec"], rtol=1e-6, atol=1e-6) for k in want)
