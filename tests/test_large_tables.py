"""Forms that must hold on tables far larger than these: what is moved, held or read again."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sightline import scale
from sightline.operators import graph, ordered, past, refine, retrieval, selection, tracks


def test_only_the_tree_of_the_root_is_hung(spark):
    tree = [("s", 0, 1), ("s", 1, 2), ("s", 5, 6), ("s", 6, 7), ("s", 5, 9), ("t", 3, 4)]
    df = spark.createDataFrame(tree, "scene string, i long, j long")
    roots = spark.createDataFrame([("s", 0), ("t", 3)], "scene string, node long")
    got = {(r["scene"], r["node"], r["parent"]) for r in graph.root_tree(df, roots).collect()}
    assert got == {("s", 1, 0), ("s", 2, 1), ("t", 4, 3)}


def test_dense_cells_are_made_in_place(spark):
    rows = [("s", 1, 10, 0.5), ("s", 2, 10, 0.7), ("s", 2, 11, None), ("s", 2, 11, 0.9), ("s", None, 12, 0.1), ("s", 3, None, 0.2),
            (None, 1, 10, 0.3), ("t", 8, 20, 0.4)]
    obs = spark.createDataFrame(rows, "scene string, img_id long, track_id long, u double")
    imgs, ids = ([*dict.fromkeys((r[0], r[k]) for r in rows if r[0])] for k in (1, 2))
    want = []
    for scene, track in ids:
        for other, img in imgs:
            if other == scene:
                seen = [r[3] for r in rows if r[:3] == (scene, img, track) and None not in (img, track)]
                want += [(scene, track, img, u) for u in seen or [None]]
    out = tracks.densify(obs)
    assert out.columns == ["scene", "track_id", "img_id", "u"]
    assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(map(str, want))
    # the cells come of an explode after the last exchange
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter" not in plan and "img_id" not in "".join(x for x in plan.splitlines() if "Join" in x)


def test_normal_blocks_leave_a_task_in_small_pieces():
    n, rng = 30_000, np.random.default_rng(0)
    one = np.eye(3).ravel()
    pdf = pd.DataFrame({"scene": "s", "track_id": np.arange(n) // 3, "img_id": np.arange(n), "cam_id": 0, "node_id": np.arange(n),
                        "u": rng.uniform(0, 500, n), "v": rng.uniform(0, 300, n), "su": 1.0, "sv": 1.0, "dep": list(rng.uniform(1, 2, (n, 3))),
                        "z_coefs": list(np.ones((n, 3))), "fx": 400.0, "fy": 400.0, "cx": 256.0, "cy": 192.0, "cr": [one] * n, "ct": [np.zeros(3)] * n,
                        "wr": [one] * n, "wt": [np.zeros(3)] * n, "x": rng.normal(size=n), "y": rng.normal(size=n), "z": 4.0})
    for eliminate, pairs in ((False, n), (True, 2 * n)):
        got = list(refine._reduce(refine.Phase(), "log", False, eliminate)(iter([pdf])))
        assert max(map(len, got)) <= 2_000 and sum(map(len, got)) == pairs


def test_quantiles_read_a_large_group_few_times(spark, split):
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            read.add(len(pdf))
            yield pdf

    rows = spark.createDataFrame([("s", float(i % 40)) for i in range(100)], "scene string, x double")
    got = ordered.quantiles(rows.mapInPandas(count, rows.schema), ["scene"], {"q": ("x", 0.5, "disc")}).collect()
    assert [tuple(r) for r in got] == [("s", 16.0)]
    assert read.value <= 400  # counted, written, and its groups; before, again for every block, bound and total


def _frames(spark, seed=0):
    """Two scenes with equal frames, rows given twice, an unknown vector and scene, and a frame alone."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(60, 6)) / 3
    x[20], x[41], x[42] = x[3], x[40], x[40]
    rows = [("a" if i % 3 else "b", i, v.tolist()) for i, v in enumerate(x)] + [("a", 100, None), (None, 7, x[2].tolist()), ("c", 5, x[4].tolist())]
    return spark.createDataFrame(rows + rows[:9], "scene string, img_id long, vec array<double>")


def _table(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


def test_choices_from_vectors_equal_those_from_the_table(spark, monkeypatch):
    glob, frames = _frames(spark), _frames(spark).select("scene", "img_id")
    sim = scale.cut(selection.similarity(glob))
    v = selection.Vectors(glob, tile=16)
    monkeypatch.setattr(selection, "similarity", None)  # no table of pairs
    for kind in ("max", "avg", "rmse"):
        assert _table(selection.diverse(v, 4, kind)) == _table(selection.diverse(sim, 4, kind))
    core = scale.cut(selection.coreset_fps_past(sim, 3))
    assert _table(selection.coreset_fps_past(v, 3)) == _table(core)
    assert _table(selection.outside(core, v)) == _table(selection.outside(core, sim))
    for mode in ("topsim", "wgtrng", "coreset_fps_3", "keyframe3-topsim", "keyframe3-none"):
        assert _table(selection.retrieve(frames, v, mode, 6)) == _table(selection.retrieve(frames, sim, mode, 6)), mode
    known = glob.where("vec is not null").distinct()
    got, want = (selection.coreset_fps(s, known.select("scene", "img_id"), 4) for s in (selection.Vectors(known), sim))
    assert _table(got) == _table(want)


@pytest.mark.parametrize("limit", ["1", "67108864"])
def test_a_scene_beyond_the_broadcast_limit_is_chosen_from_in_passes(spark, monkeypatch, limit):
    glob = _frames(spark)
    sim = scale.cut(selection.similarity(glob))
    passes, meet = [], past._meet
    monkeypatch.setattr(past, "_meet", lambda *a: passes.append(1) or meet(*a))
    spark.conf.set("spark.sightline.maxBroadcastBytes", limit)
    try:
        v = selection.Vectors(glob, tile=16)
        assert _table(selection.diverse(v, 3, "avg")) == _table(selection.diverse(sim, 3, "avg"))
        assert _table(selection.retrieve(glob, v, "coreset_fps_3", 6)) == _table(selection.retrieve(glob, sim, "coreset_fps_3", 6))
        unit = glob.where("vec is not null").distinct()
        seen = len(passes)
        chosen = _table(selection.diverse_by_descriptor(unit, 3, "max", width=4, widest=4, tile=16))
        near = selection.similarity(unit.withColumn("vec", selection.normalise("vec"))).withColumn("s", F.round("s", 12))
        assert chosen == _table(selection.diverse(near, 3, "max"))
    finally:
        spark.conf.unset("spark.sightline.maxBroadcastBytes")
    assert (seen > 0 and len(passes) > seen) == (limit == "1")  # below the limit no pass moves the vectors again


def test_covered_tracks_meet_few_candidates(spark, monkeypatch):
    rng, rows = np.random.default_rng(3), []
    for track in range(160):
        imgs = rng.permutation(4)[:1 + track % 4]
        rows += [("s", int(i), track, *map(float, rng.integers(0, 12, 2) * 1.7)) for i in imgs]
    rows += [("s", i, 301 + k, 5.0 + i + k, 5.0 + k) for i in range(4) for k in (0, 1) if i < 3 or k]  # covered in three images
    spots = [("s", 9, 1000 + k, 3.0, 4.0) for k in range(400)]  # many tracks at one place
    obs = spark.createDataFrame(rows + spots, "scene string, img_id long, track_id long, u double, v double")
    every = {}
    for _, img, track, u, v in rows + spots:
        every.setdefault(track, {})[img] = (u, v)
    old, new = ({t: o for t, o in every.items() if t % 2 == k} for k in (1, 0))
    near = lambda a, b: (a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2 < 9
    want = {t for t, o in old.items() if any(all(i in n and near(p, n[i]) for i, p in o.items()) for n in new.values())}
    written, cut = [], tracks.cut
    monkeypatch.setattr(tracks, "cut", lambda df: written.append(cut(df)) or written[-1])
    got = tracks.duplicated(obs.where("track_id % 2 = 1"), obs.where("track_id % 2 = 0"), 3.0)
    assert {r["track_id"] for r in got.collect()} == want
    assert {len(old[t]) for t in want} >= {1, 2, 3}
    proposed = [t for t in written if "new_id" in t.columns and "old_id" in t.columns]
    assert proposed and proposed[0].count() < 40 * 80 / 4 * 3  # the crowded place proposes nothing


def test_hashed_patches_are_checked_where_they_meet(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 16))
    rows = [("s", 0, i, v.tolist()) for i, v in enumerate(x)] + [("s", 1, i, (-v + rng.normal(size=16) * 0.1).tolist()) for i, v in enumerate(x)]
    p = spark.createDataFrame(rows, "scene string, img_id long, patch long, vec array<double>")
    out = retrieval.similar_patches_hashed(p, spark.createDataFrame([("s", 0, 1)], "scene string, i long, j long"), 0.8)
    got = out.collect()
    assert len(got) == len({(r["a"], r["b"]) for r in got}) and {(i, i) for i in range(60)} <= {(r["a"], r["b"]) for r in got}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("CoGroup") < plan.index("Join")  # no pair is joined or made distinct after it is met
