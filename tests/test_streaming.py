"""Streams give what batch jobs give, whatever the batch size."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.operators import retrieval as rt
from sightline.operators import selection as sel
from sightline.operators import tracks, trajectory
from sightline.streaming import online

DESC = "scene long, img_id long, feat_id long, vec array<double>"


def spread(spark, rows, schema, path, files):
    """Write rows as several files in order."""
    n = -(-len(rows) // files)
    for k in range(files):
        spark.createDataFrame(rows[k * n:(k + 1) * n], schema).coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("per_batch", [1, 3])
def test_online_retrieval_equals_batch(spark, tmp_path, per_batch):
    rng = np.random.default_rng(0)
    rows = [(0, i // 3, i, rng.normal(size=8).tolist()) for i in range(18)]
    spread(spark, rows, DESC, str(tmp_path / "in"), 3)
    book = spark.createDataFrame([(w, rng.normal(size=8).tolist()) for w in range(6)], "word long, vec array<double>")
    body = online.OnlineRetrieval(spark, str(tmp_path / "out"), book, 8, 2)
    stream = online.frame_stream(spark, str(tmp_path / "in"), DESC, files_per_batch=per_batch)
    online.run(stream, body, str(tmp_path / "cp")).awaitTermination()
    got = {(r["query"], r["img_id"]) for r in body.pairs.read().collect()}
    all_rows = spark.createDataFrame(rows, DESC)
    sim = rt.asmk_scores(rt.asmk_aggregate(all_rows, book, 5), rt.asmk_aggregate(all_rows, book), 8, past_only=True)
    want = {(r["query"], r["img_id"]) for r in sel.topsim(sim, 2).collect()}
    assert got == want and got
    body(all_rows.where("img_id = 5"), 99)
    before = body.index.read().count()
    body(all_rows.where("img_id = 5"), 99)  # a repeated batch replaces itself
    assert body.index.read().count() == before


def test_online_tracks_grow_and_feed(spark, tmp_path):
    S = "scene long, img_id long, track_id long, u double, v double"
    seen = []
    body = online.OnlineTracks(spark, str(tmp_path), 1000, on_frame=lambda df, b: seen.append((b, df.count())))
    first = spark.createDataFrame([(0, 0, 0, 10.0, 10.0), (0, 1, 0, 11.0, 10.0), (0, 0, 1, 90.0, 90.0), (0, 1, 1, 91.0, 90.0)], S)
    body(first, 0)
    second = spark.createDataFrame([(0, 0, 0, 10.0, 11.0), (0, 1, 0, 11.0, 11.0), (0, 2, 0, 12.0, 11.0), (1, 0, 0, 5.0, 5.0)], S)
    body(second, 1)
    body(second, 1)
    now = body.current()
    assert now.where("scene = 0").select("track_id").distinct().count() == 2  # old track 0 was covered
    assert now.where("scene = 1").count() == 1 and now.count() == 6
    feed = {(r["scene"], r["img_id"]): r for r in body.events.read().collect()}
    assert feed[0, 2]["attached_to"] == 0 and feed[0, 2]["mode"] == "global" and feed[1, 0]["attached_to"] is None
    assert [b for b, _ in seen] == [0, 1, 1]


@pytest.mark.parametrize("per_batch", [2, 8])
def test_every_frame_of_a_batch_is_attached(spark, tmp_path, per_batch):
    S = "scene long, img_id long, track_id long, u double, v double"
    seen = {0: [0, 1], 1: [0, 1, 2], 2: [2, 3], 3: [0, 1, 3], 4: [9], 5: [3, 9], 6: [0, 2], 7: [0, 1, 3]}
    body = online.OnlineTracks(spark, str(tmp_path), 1000, thr=0.5)
    for batch, lo in enumerate(range(0, 8, per_batch)):
        new = {t for i in range(lo, lo + per_batch) for t in seen[i]}  # a batch brings its tracks with their past observations
        rows = [(s, i, t, 50.0 * t + i, 9.0 * i) for s in (0, 1) for i in range(lo + per_batch) for t in seen[i] if t in new]
        body(spark.createDataFrame(rows, S), batch)
    shared = {j: {i: len(set(seen[i]) & set(seen[j])) for i in range(j)} for j in seen}
    best = {j: max(c, key=lambda i: (c[i], -i)) if any(c.values()) else None for j, c in shared.items()}
    tracks_by = {j: len({t for i in range(j + 1) for t in seen[i]}) for j in seen}
    feed = [tuple(r) for r in body.events.read().select("scene", "img_id", "attached_to", "n_matches", "n_tracks").collect()]
    want = [(s, j, best[j], shared[j][best[j]] if best[j] is not None else None, tracks_by[j]) for s in (0, 1) for j in seen]
    assert sorted(feed) == sorted(want)


@pytest.mark.parametrize("per_batch", [1, 3, 8])
def test_global_ids_take_new_observations_alone(spark, tmp_path, per_batch):
    S = "scene long, img_id long, track_id long, u double, v double"
    seen = {0: [0, 1], 1: [0, 1, 2], 2: [2, 3], 3: [0, 1, 3], 4: [9], 5: [3, 9], 6: [0, 2], 7: [0, 1, 3]}
    body = online.OnlineTracks(spark, str(tmp_path), 1000, thr=0.5, ids="global", merge_every=2)
    for batch, lo in enumerate(range(0, 8, per_batch)):
        rows = [(s, i, t, 50.0 * t + i, 9.0 * i) for s in (0, 1) for i in range(lo, min(8, lo + per_batch)) for t in seen[i]]
        again = [(0, 0, 0, -1.0, -1.0)] if batch else []  # came before: kept as it was
        body(spark.createDataFrame(rows + rows[:2] + again, S), batch)
    shared = {j: {i: len(set(seen[i]) & set(seen[j])) for i in range(j)} for j in seen}
    best = {j: max(c, key=lambda i: (c[i], -i)) if any(c.values()) else None for j, c in shared.items()}
    tracks_by = {j: len({t for i in range(j + 1) for t in seen[i]}) for j in seen}
    feed = [tuple(r) for r in body.events.read().select("scene", "img_id", "attached_to", "n_matches", "n_tracks").collect()]
    want = [(s, j, best[j], shared[j][best[j]] if best[j] is not None else None, tracks_by[j]) for s in (0, 1) for j in seen]
    assert sorted(feed, key=lambda r: r[:2]) == sorted(want, key=lambda r: r[:2])
    obs = {tuple(r) for r in body.current().select("scene", "img_id", "track_id", "u", "v").collect()}
    assert obs == {(s, i, t, 50.0 * t + i, 9.0 * i) for s in (0, 1) for i in seen for t in seen[i]}
    if per_batch == 1:  # a batch writes what it adds, not its scenes again
        last = spark.read.parquet(f"{body.store.path}/batch=7")
        assert last.where("NOT gone").count() == 6 and last.where("gone").count() == 0
        assert body.store._folders(body.store.merged, "upto") == [4, 6] and min(body.store._folders(body.store.path, "batch")) == 4
    final = {r["scene"]: (r["img_id"], r["mode"], r["n_tracks"]) for r in body.finish(99).collect()}
    assert final == {s: (7, "final", len({t for i in seen for t in seen[i]})) for s in (0, 1)}
    with pytest.raises(ValueError, match="global"):
        online.OnlineTracks(spark, str(tmp_path), 10, ids="mine")


def test_every_nth_running_size_and_timings(spark, tmp_path):
    F_ = "scene long, img_id long, height int, width int, stage string, seconds double"
    rows = [(k % 2, k, 100 + k, 200 - k, "match" if k % 3 else "depth", float(k)) for k in range(12)]
    spread(spark, rows, F_, str(tmp_path / "in"), 4)
    stream = online.frame_stream(spark, str(tmp_path / "in"), F_, every=3, files_per_batch=1)
    q = online.running_size(stream).writeStream.outputMode("complete").format("memory").queryName("sizes").start()
    q.processAllAvailable()
    q.stop()
    got = {r["scene"]: (r["max_height"], r["max_width"], r["n_frames"]) for r in spark.table("sizes").collect()}
    assert got == {0: (106, 200, 2), 1: (109, 197, 2)}
    full = online.frame_stream(spark, str(tmp_path / "in"), F_)
    q = online.timing_stream(full).writeStream.outputMode("complete").format("memory").queryName("times").start()
    q.processAllAvailable()
    q.stop()
    t = {r["stage"]: (r["total_time"], r["count"]) for r in spark.table("times").collect()}
    assert t == {"depth": (18.0, 4), "match": (48.0, 8)}


def test_stream_static_nearest_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(0, i, float(t)) for i, t in enumerate(rng.uniform(-3, 10, 40))]
    spread(spark, rows, "scene long, img_id long, ts double", str(tmp_path / "in"), 4)
    poses = spark.createDataFrame([(0, float(t), i, float(i)) for i, t in enumerate(rng.uniform(-3, 10, 20))], "scene long, ts double, pose_no int, pose double")
    stream = online.frame_stream(spark, str(tmp_path / "in"), "scene long, img_id long, ts double")
    body = online.OnlineAssociation(spark, str(tmp_path / "out"), poses, 0.4, "pose_no", "scene long, img_id long, pose_no int, gap double")
    online.run(stream, body, str(tmp_path / "cp")).awaitTermination()
    got = {r["img_id"]: r["pose_no"] for r in body.matched.read().collect()}
    imgs = spark.createDataFrame(rows, "scene long, img_id long, ts double")
    want = {r["img_id"]: r["pose_no"] for r in trajectory.nearest_asof(imgs, poses, "ts", ["scene"], 0.4, "pose_no").collect()}
    assert got == want and got


def test_cap_in_rounds(spark):
    rows = [(0, 0, k, float(k % 4), 0.0) for k in range(30)] + [(0, 1, k, float(k % 4), 0.0) for k in range(30)]
    obs = spark.createDataFrame(rows, "scene long, img_id long, track_id long, u double, v double")
    out = tracks.cap_tracks(obs, 10, 16, subsample=8)
    assert out.select("track_id").distinct().count() == 10
    assert tracks.cap_tracks(obs, 10, 16).select("track_id").distinct().count() == 10
    apart = obs.withColumn("u", F.col("track_id") * 16.0)
    assert tracks.cap_tracks(apart, 10, 16).select("track_id").distinct().count() == 30


def test_merged_batches_read_like_single_ones(spark, tmp_path):
    t = online.BatchTable(spark, str(tmp_path / "t"), "x long")
    assert t.read().count() == 0
    at = lambda before=None: sorted(r["x"] for r in t.read(before).collect())
    for batch in range(7):
        if batch in (2, 4, 6):
            t.merge(batch)
            t.merge(batch)  # a repeated merge changes nothing
        t.write(spark.range(batch, batch + 1).withColumnRenamed("id", "x"), batch)
        t.write(spark.range(batch, batch + 1).withColumnRenamed("id", "x"), batch)
        assert at() == list(range(batch + 1)) and at(batch) == list(range(batch))
    assert at(5) == [0, 1, 2, 3, 4]  # an earlier merge still serves a repeated batch
