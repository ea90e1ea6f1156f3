"""Match graphs against brute force."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.operators import graph, initial
from sightline.operators.cloud import unproject_pixels
from tests.test_refine import rot

EDGE = "scene string, i long, j long, n_matches long"


def kruskal(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    out = set()
    for i, j, w in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        if find(i) != find(j):
            parent[find(i)] = find(j)
            out.add((i, j))
    return out


def test_spanning_tree_with_ties_equals_kruskal(spark):
    rng = np.random.default_rng(0)
    scenes = {"ties": [(i, j, 5) for i, j in itertools.combinations(range(7), 2)],
              "rand": [(i, j, int(rng.integers(3, 9))) for i, j in itertools.combinations(range(12), 2) if rng.random() < 0.5],
              "two": [(0, 1, 4), (1, 2, 3), (5, 6, 9)]}
    df = spark.createDataFrame([(s, *e) for s, es in scenes.items() for e in es], EDGE)
    got = {}
    for r in graph.max_spanning_tree(df).collect():
        got.setdefault(r["scene"], set()).add((r["i"], r["j"]))
    assert got == {s: kruskal(es) for s, es in scenes.items()}


def test_components_chain_star_and_isolated(spark):
    rng = np.random.default_rng(2)
    perm = rng.permutation(40).tolist()
    chain = [(min(a, b), max(a, b)) for a, b in zip(perm, perm[1:])]
    star = [(k, 99) for k in range(50, 60)]
    df = spark.createDataFrame([("s", i, j, 3) for i, j in chain + star], EDGE)
    nodes = spark.createDataFrame([("s", n) for n in [*range(40), *range(50, 60), 99, 200]], "scene string, node long")
    got = {r["node"]: r["component"] for r in graph.components(df, nodes).collect()}
    assert got == {**{n: 0 for n in range(40)}, **{n: 50 for n in range(50, 60)}, 99: 50, 200: 200}
    with pytest.raises(ValueError):
        graph.require_connected(df, nodes)


def test_root_and_propagate_follow_the_tree(spark):
    rng = np.random.default_rng(4)
    tree = [(0, 1), (1, 2), (2, 3), (3, 4), (1, 5), (5, 6), (2, 7)]
    rel, pose = {}, {0: (1.0, np.eye(3), np.zeros(3))}
    for i, j in tree:
        for a, b in ((i, j), (j, i)):
            rel[a, b] = (float(rng.uniform(0.8, 1.2)), rot(rng.normal(0, 0.3, 3)), rng.normal(size=3))
    for i, j in tree:
        s, r, t = rel[i, j]
        si, ri, ti = pose[i]
        pose[j] = (si * s, ri @ r, ri @ (si * t) + ti)
    e = spark.createDataFrame([("s", i, j, 3) for i, j in tree], EDGE)
    roots = spark.createDataFrame([("s", 0)], "scene string, node long")
    parents = graph.root_tree(e, roots)
    assert {r["node"]: r["parent"] for r in parents.collect()} == {j: i for i, j in tree}
    rows = spark.createDataFrame([("s", a, b, s, r.ravel().tolist(), t.tolist()) for (a, b), (s, r, t) in rel.items()],
                                 "scene string, i long, j long, s double, r array<double>, t array<double>")
    for r in graph.propagate(parents, rows, roots).collect():
        s, rr, t = pose[r["node"]]
        assert r["s"] == pytest.approx(s) and np.allclose(r["r"], rr.ravel()) and np.allclose(r["t"], t)
    known = spark.createDataFrame([("s", 2, np.eye(3).ravel().tolist(), [9.0, 9.0, 9.0])], "scene string, node long, r array<double>, t array<double>")
    got = {r["node"]: r for r in graph.propagate(parents, rows, roots, known).collect()}
    assert np.allclose(got[2]["t"], 9) and got[2]["s"] == pytest.approx(pose[2][0])
    s, r, t = rel[2, 3]
    assert np.allclose(got[3]["t"], pose[2][0] * t + 9) and np.allclose(got[4]["s"], pose[4][0])


def test_initial_poses_recover_planted_cameras(spark):
    """Frames see a bumpy surface; poses up to noise of sampling come out of the tree."""
    rng = np.random.default_rng(0)
    pts = np.c_[rng.uniform(-1, 1, (80, 2)), rng.uniform(4, 5, 80)]
    views, obs, grid = [], [], []
    for i in range(4):
        r, t = rot(np.array([0, 0.05 * i, 0])), np.array([0.1 * i, 0.0, 0.0])
        cam = (pts - t) @ r  # cam2w is (r, t)
        uv = 100 * cam[:, :2] / cam[:, 2:] + [50, 50]
        views.append(("s", i, 100, 100, 100.0, 100.0, 50.0, 50.0, (r.ravel().tolist(), t.tolist())))
        for k, (u, v) in enumerate(uv):
            obs.append(("s", i, k, float(np.floor(u) + 0.5), float(np.floor(v) + 0.5)))
            grid.append(("s", i, int(np.floor(u)), int(np.floor(v)), float(cam[k, 2]), 5.0))
    o = spark.createDataFrame(obs, "scene string, img_id long, track_id long, u double, v double")
    v = spark.createDataFrame(views, "scene string, img_id long, width long, height long, fx double, fy double, cx double, cy double, cam2w struct<r:array<double>,t:array<double>>")
    g = spark.createDataFrame(grid, "scene string, img_id long, px long, py long, depth double, conf double").dropDuplicates(["scene", "img_id", "px", "py"])
    out = {r["img_id"]: r for r in initial.initial_poses(o, unproject_pixels(g, v, world=False), v).collect()}
    assert set(out) == {0, 1, 2, 3}
    for i in range(4):
        assert abs(out[i]["s"] - 1) < 0.1 and np.allclose(out[i]["t"], [0.1 * i, 0, 0], atol=0.3)
