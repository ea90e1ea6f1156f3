"""Pose accuracy: invariances, planted errors, reports."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.functions import pose as ps
from sightline.operators import accuracy as acc
from tests.test_refine import rot

SCHEMA = "scene string, name string, gt struct<r:array<double>,t:array<double>>, pred struct<r:array<double>,t:array<double>>"


def circle(n=8):
    out = []
    for k in range(n):
        a = 2 * np.pi * k / n
        out.append((rot(np.array([0, a, 0.05 * k])), np.array([np.cos(a), 0.1 * k, np.sin(a)])))
    return out


def frame(spark, gt, pred):
    pk = lambda p: (p[0].ravel().tolist(), p[1].tolist())
    return spark.createDataFrame([("s", f"{i:03d}", pk(g), pk(p)) for i, (g, p) in enumerate(zip(gt, pred))], SCHEMA)


def test_relative_error_ignores_global_similarity(spark):
    gt = circle()
    g, s, t = rot(np.array([0.3, -0.2, 0.9])), 2.5, np.array([4.0, 5, 6])
    pred = [(g @ r, s * (g @ c) + t) for r, c in gt]
    row = acc.relpose(frame(spark, gt, pred)).first()
    assert row["n_pairs"] == 28 and row["racc_5"] == 100 and row["auc_30"] == pytest.approx(100)
    assert row["rmean"] < 1e-5 and row["tmean"] < 1e-4


def test_flipped_pose_is_seen(spark):
    gt = circle()
    pred = list(gt)
    pred[3] = (rot(np.array([np.pi, 0, 0])) @ gt[3][0], gt[3][1])
    row = acc.relpose(frame(spark, gt, pred)).first()
    assert row["racc_30"] == pytest.approx(100 * 21 / 28)


def test_relpose_against_numpy(spark):
    rng = np.random.default_rng(0)
    gt = circle()
    pred = [(r @ rot(rng.normal(0, 0.1, 3)), c + rng.normal(0, 0.1, 3)) for r, c in gt]
    r_err, t_err = [], []
    for i in range(8):
        for j in range(i + 1, 8):
            rel = [(p[i][0].T @ p[j][0], p[i][0].T @ (p[j][1] - p[i][1])) for p in (gt, pred)]
            r_err.append(np.degrees(np.arccos(np.clip((np.trace(rel[0][0].T @ rel[1][0]) - 1) / 2, -1, 1))))
            a, b = (x[1] / np.linalg.norm(x[1]) for x in rel)
            t_err.append(np.degrees(np.arccos(min(1, abs(a @ b)))))
    worst = np.maximum(r_err, t_err)
    hist = np.histogram(worst, bins=np.arange(31))[0] / len(worst)
    row = acc.relpose(frame(spark, gt, pred)).first()
    assert row["auc_30"] == pytest.approx(100 * np.cumsum(hist).mean())
    assert row["rmean"] == pytest.approx(np.mean(r_err)) and row["tmean"] == pytest.approx(np.mean(t_err))
    assert row["tacc_5"] == pytest.approx(100 * np.mean(np.array(t_err) < 5))
    many = acc.relpose(frame(spark, gt, pred).repartition(13)).first()
    assert many["auc_30"] == pytest.approx(row["auc_30"])


def test_auc_edges(spark):
    errs = [0.0, 0.999, 1.0, 29.0, 29.9, 30.0, 30.01, 1e6]
    got = [r[0] for r in spark.createDataFrame([(e,) for e in errs], "e double").select(acc.auc_share(F.col("e"))).collect()]
    want = [np.cumsum(np.histogram([e], bins=np.arange(31))[0]).mean() for e in errs]
    assert np.allclose(got, want)


def test_ate_zero_for_similar_copy_and_known_for_noise(spark):
    gt = circle()
    g, s, t = rot(np.array([0.3, -0.2, 0.9])), 0.4, np.array([4.0, 5, 6])
    rows = [("s", (s * (g @ c) + t).tolist(), c.tolist()) for _, c in gt]
    df = spark.createDataFrame(rows, "scene string, x array<double>, y array<double>")
    row = acc.ate(df).first()
    assert row["ate_max"] < 1e-9 and row["n_frames"] == 8
    fit = acc.umeyama(df, ["scene"]).first()
    assert fit["s"] == pytest.approx(1 / s) and np.allclose(fit["r"], g.T.ravel())
    mirrored = spark.createDataFrame([("s", (c * [1, 1, -1]).tolist(), c.tolist()) for _, c in gt], df.schema)
    assert np.linalg.det(np.array(acc.umeyama(mirrored, ["scene"]).first()["r"]).reshape(3, 3)) == pytest.approx(1)
    one = spark.createDataFrame([("s", [1.0, 2.0, 3.0], [1.0, 2.0, 4.0])], df.schema)
    fit = acc.umeyama(one, ["scene"]).first()
    assert fit["s"] == 1 and np.isfinite(fit["t"]).all()


def test_reports_and_missing_scenes(spark):
    m = spark.createDataFrame([("a", "x", 10.0, 3), ("b", "x", 30.0, 5), ("c", "y", 50.0, 7)], "scene string, cat string, auc_30 double, n_pairs int")
    rep = {r["scene"]: r for r in acc.report(m.drop("cat")).collect()}
    assert rep["AVG"]["auc_30"] == 30 and rep["a"]["auc_30"] == 10
    macro = {r["cat"]: r["auc_30"] for r in acc.macro_report(m, "cat").collect()}
    assert macro == {"x": 20, "y": 50, "AVG": 35}
    scenes = spark.createDataFrame([("a",), ("z",)], "scene string")
    zero = {r["scene"]: r for r in acc.with_missing(scenes, m.drop("cat"), zero=["auc_30"]).collect()}
    assert zero["z"]["auc_30"] == 0 and zero["z"]["n_pairs"] is None and zero["z"]["status"] == "missing"
    assert acc.with_missing(scenes, m.drop("cat"), "drop").count() == 1


def test_missing_prediction_is_an_error(spark):
    df = frame(spark, circle(), circle())
    gt, pred = df.select("scene", "name", "gt"), df.where("name <> '003'").select("scene", "name", "pred")
    with pytest.raises(ValueError):
        acc.match_frames(gt, pred)
    assert acc.match_frames(gt, pred, allow_subset=True).count() == 7
    assert acc.coverage(gt, pred).first()["coverage"] == pytest.approx(87.5)


def test_null_and_zero_directions(spark):
    df = spark.range(1).select(ps.direction_angle(F.lit(None).cast("double"), F.lit(1.0), F.lit(1.0)).alias("a"),
                               ps.direction_angle(F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("b"))
    row = df.first()
    assert row["a"] == pytest.approx(np.degrees(1e6)) and row["b"] == pytest.approx(90)
