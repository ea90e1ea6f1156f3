"""Descriptors and selection strategies against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.operators import retrieval as rt
from sightline.operators import selection as sel

DESC_TYPE = "scene string, img_id long, feat_id long, vec array<double>"


@pytest.fixture(scope="module")
def desc(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 12))
    df = spark.createDataFrame([("s", i // 4, i, v.tolist(), float(np.linalg.norm(v))) for i, v in enumerate(x)],
                               "scene string, img_id long, feat_id long, vec array<double>, attn double")
    return df, x


@pytest.fixture(scope="module")
def book(spark):
    c = np.random.default_rng(1).normal(size=(9, 12))
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "word long, vec array<double>"), c


@pytest.mark.parametrize("limit", [None, "300"])
def test_nearest_words_small_and_sliced_codebook(spark, desc, book, limit):
    df, x = desc
    cb, c = book
    if limit:
        spark.conf.set("spark.sightline.maxBroadcastBytes", limit)  # three words per slice
    got = {}
    for r in rt.quantise(df, cb, 3).collect():
        got.setdefault(r["feat_id"], {})[r["word"]] = r["dist"]
    spark.conf.unset("spark.sightline.maxBroadcastBytes")
    d = np.linalg.norm(x[:, None] - c[None], axis=2)
    assert all(set(got[i]) == set(np.argsort(d[i])[:3]) and all(v == pytest.approx(d[i, w]) for w, v in got[i].items()) for i in range(40))


def test_asmk_scores_against_numpy(spark, desc, book):
    df, x = desc
    cb, c = book

    def aggregate(k):
        near = np.argsort(np.linalg.norm(x[:, None] - c[None], axis=2), 1)[:, :k]
        acc = {}
        for f in range(40):
            for w in near[f]:
                acc.setdefault((f // 4, int(w)), np.zeros(12))
                acc[f // 4, int(w)] += x[f] - c[w]
        return {k: v > 0 for k, v in acc.items()}
    q, d = aggregate(5), aggregate(1)
    want = {}
    for (i, w), a in q.items():
        for (j, w2), b in d.items():
            u = 1 - 2 * np.mean(a != b)
            if w == w2 and u > 0:
                want[i, j] = want.get((i, j), 0) + u ** 3
    nq, nd = ({i: sum(k[0] == i for k in t) for i in range(10)} for t in (q, d))
    got = {(r["i"], r["j"]): r["s"] for r in rt.asmk_scores(rt.asmk_aggregate(df, cb, 5), rt.asmk_aggregate(df, cb), 12).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(v / np.sqrt(nq[k[0]] * nd[k[1]])) for k, v in want.items())


@pytest.mark.parametrize("past_only", [False, True])
def test_asmk_scores_of_images_that_share_words_meet_by_tiles(spark, monkeypatch, past_only):
    rng, rows = np.random.default_rng(3), {"q": [], "d": []}
    for scene, size in (("a", 13), ("b", 9), (None, 2)):
        for side, img, w in ((s, i, w) for s in "qd" for i in range(size) for w in range(5)):
            if w < 3 or rng.random() < 0.3:  # words of all images, and of some
                rows[side].append((scene, img, w, [int(v) for v in rng.integers(0, 2 ** 32, 2)]))
    rows["q"] += [("only", 0, 1, [5, 6]), rows["q"][0]]
    q, d = (spark.createDataFrame(r, "scene string, img_id long, word long, bits array<bigint>") for r in rows.values())
    count = lambda df, i, n: df.groupBy("scene", F.col("img_id").alias(i)).agg(F.count("*").alias(n))
    both = q.selectExpr("scene", "word", "img_id as i", "bits as _bq").join(d.selectExpr("scene", "word", "img_id as j", "bits as _bd"), ["scene", "word"])
    want = {(r.scene, r.i, r.j): r.s for r in rt._kernel(both, count(q, "i", "_nq"), count(d, "j", "_nd"), 60, 3.0, 0.0, past_only).collect()}
    monkeypatch.setattr(rt, "salted_join", None)  # rows don't meet by word
    monkeypatch.setattr(rt, "SOME", 2)
    monkeypatch.setattr(rt._scores_by_tiles, "__defaults__", (4,))
    got = [((r.scene, r.i, r.j), r.s) for r in rt.asmk_scores(q, d, 60, past_only=past_only).collect()]
    assert len(got) == len(want) > 50 and all(s == pytest.approx(want[k]) for k, s in got)


def test_whitening_gives_identity_covariance(spark, desc):
    df, x = desc
    mean, proj = rt.fit_whitening(df.repartition(5))
    assert np.allclose(mean, x.mean(0)) and np.allclose(np.cov((x - mean) @ proj, rowvar=False, bias=True), np.eye(12))
    got = np.array([r["vec"] for r in rt.whiten(df, mean, proj).orderBy("feat_id").collect()])
    assert np.allclose(got, (x - mean) @ proj)


def test_pooling_and_local_choice(spark, desc):
    df, x = desc
    got = {r["img_id"]: np.array(r["vec"]) for r in rt.spoc(df).collect()}
    v = (x[:4] * np.linalg.norm(x[:4], axis=1)[:, None]).sum(0)
    assert np.allclose(got[0], v / np.linalg.norm(v))
    top = {r["feat_id"] for r in rt.select_local(df, 2).where("img_id = 0").collect()}
    assert top == set(np.argsort(-np.linalg.norm(x[:4], axis=1))[:2])
    assert rt.select_local(df, -0.5).count() == 20 and rt.sample_features(df, 3).count() == 30


@pytest.fixture(scope="module")
def glob(spark):
    x = np.random.default_rng(5).normal(size=(14, 6))
    x[7] = x[3] + 0.01
    x /= np.linalg.norm(x, axis=1)[:, None]
    return spark.createDataFrame([("s", i, v.tolist()) for i, v in enumerate(x)], "scene string, img_id long, vec array<double>"), x @ x.T


def by_query(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["query"], set()).add(r["img_id"])
    return out


def test_top_similar_tiles(spark, glob):
    df, s = glob
    for tile in (2048, 4):
        got = {}
        for r in rt.top_similar(df, 3, tile=tile).collect():
            got.setdefault(r["i"], set()).add(r["j"])
        assert got == {q: set(np.argsort(-s[q, :q], kind="stable")[:3]) for q in range(1, 14)}


@pytest.mark.parametrize("kind", ["max", "avg", "rmse"])
def test_diverse_equals_sequential(spark, glob, kind):
    df, s = glob
    low = s[np.tril_indices(14, -1)].min()
    n = np.clip((s - low + 1e-6) / (1 - low + 1e-6), 0, 1)
    want = {}
    for q in range(1, 14):
        to_q = np.maximum(n[q, :q], 1e-6)
        chosen = [int(to_q.argmax())]
        while len(chosen) < min(q, 4):
            r = n[chosen, :q]
            agg = {"max": r.max(0), "avg": r.mean(0), "rmse": np.sqrt((r ** 2).mean(0))}[kind]
            score = to_q * np.maximum(1 - agg, 1e-6)
            score[chosen] = -1
            chosen.append(int(score.argmax()))
        want[q] = set(chosen)
    assert by_query(sel.diverse(sel.similarity(df), 4, kind)) == want


def test_farthest_points(spark, glob):
    df, s = glob
    got = [r["img_id"] for r in sel.coreset_fps(sel.similarity(df), df.select("scene", "img_id"), 5).orderBy("step").collect()]
    want = [got[0]]
    while len(want) < 5:
        d = (1 - s[want]).min(0)
        d[want] = -1
        want.append(int(d.argmax()))
    assert got == want


@pytest.mark.parametrize("kind", ["max", "avg", "rmse"])
def test_diverse_by_descriptor_equals_matrix_form(spark, kind):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(40, 5))
    x[30], x[20] = x[3], 0.0  # equal frames, and one without direction
    x /= np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]
    rows = [("s", i, v.tolist()) for i, v in enumerate(x)] + [("t", 5, [1.0] * 5), ("t", 9, [0.5] * 5), ("u", 1, [1.0] * 5)]
    df = spark.createDataFrame(rows, "scene string, img_id long, vec array<double>")
    unit = df.withColumn("vec", F.expr("transform(vec, v -> v / greatest(sqrt(aggregate(vec, 0D, (a, w) -> a + w*w)), 1e-12D))"))
    want = {tuple(r) for r in sel.diverse(sel.similarity(unit).withColumn("s", F.round("s", 12)), 3, kind).collect()}
    for width, widest in ((None, 4096), (4, 4096), (4, 4)):  # enough at once; asked again wider; the rest by the matrix
        got = [tuple(r) for r in sel.diverse_by_descriptor(df, 3, kind, width=width, widest=widest, tile=16).collect()]
        assert len(got) == len(want) and set(got) == want
    assert sel.diverse_by_descriptor(df.limit(0), 3, kind).count() == 0


def test_farthest_points_by_descriptor(spark, glob):
    df, _ = glob
    want = [tuple(r) for r in sel.coreset_fps(sel.similarity(df), df.select("scene", "img_id"), 5).orderBy("step").collect()]
    more = df.unionByName(df.where("img_id < 2").withColumn("scene", F.lit("small")))
    got = sel.coreset_fps_by_descriptor(more, 5).orderBy("step")
    assert [tuple(r) for r in got.where("scene = 's'").collect()] == want
    assert sorted(r["img_id"] for r in got.where("scene = 'small'").collect()) == [0, 1]


def test_modes_and_keyframes(spark, glob):
    df, s = glob
    frames, sim = df.select("scene", "img_id"), sel.similarity(df)
    assert by_query(sel.retrieve(frames, sim, "none", 3))[5] == set(range(5))
    assert by_query(sel.retrieve(frames, sim, "last", 3))[5] == {2, 3, 4}
    assert by_query(sel.retrieve(frames, sim, "topsim", 2))[6] == set(np.argsort(-s[6, :6])[:2])
    key = by_query(sel.retrieve(frames, sim, "keyframe4-topsim", 8))
    for q in range(1, 14):
        ks = [j for j in range(q) if j % 4 == 0]
        os = [j for j in range(q) if j % 4]
        first = sorted(ks, key=lambda j: -s[q, j])[:6]
        assert key[q] == set(first) | set(sorted(os, key=lambda j: -s[q, j])[:8 - len(first)])
    core = by_query(sel.retrieve(frames, sim, "coreset_fps_3", 5))
    assert all(len(core[q]) == min(q, 5) for q in range(1, 14))
    drawn = by_query(sel.retrieve(frames, sim, "wgtrng", 3))
    assert all(s[q, j] > 0 for q, js in drawn.items() for j in js)
    with pytest.raises(ValueError):
        sel.retrieve(frames, sim, "nonsense", 3)


def test_clusters_of_scenes_that_fit_a_task_are_those_of_the_passes(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(s, i, [float(v) for v in rng.normal(size=5)]) for s, size in (("a", 30), ("b", 12), ("two", 2), (None, 3)) for i in range(size)]
    df = spark.createDataFrame(rows + [("a", 40, rows[3][2])], "scene string, img_id long, vec array<double>")
    take = lambda: sorted((r.scene, r.cluster, r.img_id) for r in sel.coreset_clusters(df, 3).collect())
    passes, seen = sel._clusters_of_large, []
    monkeypatch.setattr(sel, "_clusters_of_large", lambda *a: seen.append(1) or passes(*a))
    got = take()
    assert not seen and {r[0] for r in got} == {"a", "b", "two"}
    spark.conf.set("spark.sightline.maxBroadcastBytes", "1")
    try:
        assert take() == got and seen
    finally:
        spark.conf.unset("spark.sightline.maxBroadcastBytes")


def test_cluster_medoids_are_members(spark, glob):
    df, _ = glob
    rows = sel.coreset_clusters(df, 3, rounds=3).collect()
    assert len(rows) == 3 and len({r["img_id"] for r in rows}) == 3


def test_similar_patches_threshold_and_cap(spark, glob):
    df, s = glob
    p = df.select("scene", (F.col("img_id") % 2).alias("img_id"), F.col("img_id").alias("patch"), "vec")
    pairs = spark.createDataFrame([("s", 0, 1)], "scene string, i long, j long")
    got = {(r["a"], r["b"]) for r in rt.similar_patches(p, pairs, 0.3, tile=3).collect()}
    assert got == {(a, b) for a in range(0, 14, 2) for b in range(1, 14, 2) if abs(s[a, b]) > 0.3}
    assert rt.similar_patches(p, pairs, 0.0, cap=4).count() == 4


@pytest.mark.parametrize("thr", [0.7, 0.85])
def test_hashed_patches_recall_and_precision(spark, thr):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(150, 32))
    near = [b * rng.choice([-1, 1]) + rng.normal(size=32) * rng.uniform(0.1, 0.9) for b in base for _ in range(3)]
    rows = [("s", 0, i, v.tolist()) for i, v in enumerate(base)] + [("s", 1, i, v.tolist()) for i, v in enumerate(near)]
    rows += [("s", 0, 900 + i, [1.0] * 32) for i in range(20)] + [("s", 1, 900 + i, [-2.0] * 32) for i in range(20)]  # one full bucket
    rows += [("s", k, 999, [0.0] * 32) for k in (0, 1)]
    p = spark.createDataFrame(rows, "scene string, img_id long, patch long, vec array<double>")
    pairs = spark.createDataFrame([("s", 0, 1), ("s", 0, 1)], "scene string, i long, j long")
    ids = {k: [r[2] for r in rows if r[1] == k and r[2] != 999] for k in (0, 1)}
    unit = {k: (lambda m: m / np.linalg.norm(m, axis=1, keepdims=True))(np.array([r[3] for r in rows if r[1] == k and r[2] != 999])) for k in (0, 1)}
    s = np.abs(unit[0] @ unit[1].T)
    want = {(ids[0][x], ids[1][y]) for x, y in zip(*np.nonzero(s > thr))}
    assert 2 * rt.hash_bands(thr, 0.95, 9) <= 1 << 8  # the hashed form runs
    rows = rt.similar_patches_hashed(p, pairs, thr, recall=0.95, bits=9).collect()
    got = {(r["a"], r["b"]) for r in rows}
    assert len(got) == len(rows) and got <= want and len(got) >= 0.95 * len(want)
    assert {(900 + x, 900 + y) for x in range(20) for y in range(20)} <= got


def test_hashed_patches_fall_back_to_the_exact_form(spark, glob):
    df, s = glob
    p = df.select("scene", (F.col("img_id") % 2).alias("img_id"), F.col("img_id").alias("patch"), "vec")
    pairs = spark.createDataFrame([("s", 0, 1)], "scene string, i long, j long")
    got = {(r["a"], r["b"]) for r in rt.similar_patches_hashed(p, pairs, 0.3).collect()}
    assert got == {(a, b) for a in range(0, 14, 2) for b in range(1, 14, 2) if abs(s[a, b]) > 0.3}


def test_least_breaks_ties_by_place():
    from sightline.operators.retrieval import _least
    d = np.array([[3.0, 1.0, 1.0, 1.0, 0.0], [2.0, 2.0, 2.0, 2.0, 2.0], [5.0, 4.0, 3.0, 2.0, 1.0]])
    assert [sorted(r) for r in _least(d, 2).tolist()] == [[1, 4], [0, 1], [3, 4]]
    assert _least(d, 1).ravel().tolist() == [4, 0, 4]


@pytest.mark.parametrize("k", [1, 4])
def test_pivot_tree_equals_brute_force_and_prunes(spark, k):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 6)) * 20
    words = np.concatenate([centres[i % 12] + rng.normal(size=6) for i in range(300)]).reshape(300, 6)
    words[40:120] = words[40]  # equal words: one cell above a slice
    x = np.concatenate([centres[i % 12] + rng.normal(size=6) for i in range(50)] + [words[40], words[3]]).reshape(52, 6)
    book = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(words)], "word long, vec array<double>")
    desc = spark.createDataFrame([("s", 0, i, v.tolist()) for i, v in enumerate(x)], DESC_TYPE)
    got = {}
    for r in rt.quantise(desc, book, k, slice_words=30).collect():
        got.setdefault(r["feat_id"], []).append((r["dist"], r["word"]))
    d = np.sqrt(((x[:, None] - words[None]) ** 2).sum(2))
    assert set(got) == set(range(52))
    for i in range(52):
        order = np.lexsort((np.arange(300), d[i].round(9)))[:k]
        assert sorted(w for _, w in got[i]) == sorted(order.tolist()) or sorted(round(a, 6) for a, _ in got[i]) == sorted(d[i, order].round(6).tolist())
    tree, placed = rt.pivot_tree(book, 30)
    assert placed.count() == 300 and placed.groupBy("slice").count().agg({"count": "max"}).first()[0] <= 60
    rows = desc.select("scene", "img_id", "feat_id", "vec").withColumn("tau", F.lit(8.0))
    visits = rt.route(rows, tree, k, True).select(F.sum(F.size("cells"))).first()[0]
    assert visits < 52 * len(tree.pivots) / 4  # most cells are ruled out


def test_pivot_tree_with_fewer_words_than_asked_and_no_rows(spark):
    book = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(7)], "word long, vec array<double>")
    desc = spark.createDataFrame([("s", 0, 0, [2.2, 0.0])], DESC_TYPE)
    got = [r["word"] for r in rt.quantise(desc, book, 9, slice_words=3).orderBy("dist").collect()]
    assert got == [2, 3, 1, 4, 0, 5, 6]
    assert rt.quantise(desc.limit(0), book, 2, slice_words=3).count() == 0


def test_saved_index_scores_without_moving_it(spark, desc, book, tmp_path):
    df, _ = desc
    cb, _ = book
    query, index = rt.asmk_aggregate(df, cb, 5), rt.asmk_aggregate(df, cb)
    want = {(r["i"], r["j"]): round(r["s"], 9) for r in rt.asmk_scores(query, index, 12, past_only=True).collect()}
    name = "index_" + tmp_path.name.replace("-", "_")
    for frequent in (65_536, 2):  # no frequent word, then most of them
        rt.save_index(index, name, 3, frequent)
        assert (spark.table(f"{name}_frequent").count() > 0) == (frequent == 2)
        out = rt.scores_of_saved(query, name, 12, past_only=True)
        assert {(r["i"], r["j"]): round(r["s"], 9) for r in out.collect()} == want and want
    rt.save_index(index, name, 3)
    q = query.select("scene", "word", F.col("img_id").alias("i"))
    plan = q.join(spark.table(name).hint("merge"), ["scene", "word"])._jdf.queryExecution().executedPlan().toString()
    scan = plan[:plan.index(name)]
    assert "Bucketed: true" in plan and "Exchange" not in scan[scan.rindex("Sort ["):]
    for t in ("", "_frequent", "_images"):
        spark.sql(f"DROP TABLE {name}{t}")
