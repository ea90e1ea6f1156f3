"""File formats round trip on tiny files."""

from __future__ import annotations

import gzip
import hashlib
import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.operators import batch
from sightline.sources import ranges, readers, tables


def test_scene_catalogue(spark, tmp_path):
    for name in ("b.JPG", "a.png", "notes.txt"):
        (tmp_path / "room").mkdir(exist_ok=True)
        (tmp_path / "room" / name).write_bytes(b"xx")
    rows = readers.read_scenes(spark, str(tmp_path / "room")).orderBy("idx").collect()
    assert [(r["scene"], r["name"], r["idx"]) for r in rows] == [("room", "a.png", 1), ("room", "b.JPG", 2)]
    assert readers.read_scenes(spark, str(tmp_path / "room"), "other").first()["scene"] == "other"
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "x.txt").write_text("")
    with pytest.raises(FileNotFoundError):
        readers.read_scenes(spark, str(tmp_path / "empty"))


def test_timestamped_lists(spark, tmp_path):
    d = tmp_path / "seq"
    d.mkdir()
    (d / "rgb.txt").write_text("# colour images\n\n0.00 rgb/0.00.png\n0.05 rgb/0.05.png\n0.30 rgb/0.30.png\n")
    (d / "groundtruth.txt").write_text("first line is skipped\n# comment\n0.00 1 2 3 0 0 0 1\n0.10 2 2 3 0 0 0.7071067811865476 0.7071067811865476\n")
    (d / "pose.txt").write_text("x\n9 9 9 9 0 0 0 1\n")
    files = [str(d / "groundtruth.txt"), str(d / "pose.txt")]
    traj = readers.read_trajectory(spark, files).orderBy("ts").collect()
    assert [r["ts"] for r in traj] == [0.0, 0.1] and np.allclose(traj[1]["pose"]["r"], [0, -1, 0, 1, 0, 0, 0, 0, 1])
    got = readers.read_sequence_poses(spark, str(d / "rgb.txt"), files).orderBy("ts").collect()
    assert [r["name"] for r in got] == ["0.00.png", "0.05.png"]
    assert got[0]["pose"]["r"] == [1, 0, 0, 0, 1, 0, 0, 0, 1] and got[1]["pose"]["t"] == [0, 0, 0]


def test_colmap_text_and_binary_agree(spark, tmp_path):
    recs = [(1, (0.9, 0.1, 0.2, 0.3), (1.0, 2.0, 3.0), 1, "dir/a.png", 2), (2, (1.0, 0.0, 0.0, 0.0), (0.5, 0.0, -1.0), 1, "b.png", 0)]
    t, b = tmp_path / "text", tmp_path / "bin"
    t.mkdir(), b.mkdir()
    lines = ["# header", "# more"]
    buf = struct.pack("<Q", len(recs))
    for i, q, tr, cam, name, n in recs:
        lines += [" ".join(map(str, (i, *q, *tr, cam, name))), " ".join(["1.0 2.0 -1"] * n)]
        buf += struct.pack("<idddddddi", i, *q, *tr, cam) + name.encode() + b"\0" + struct.pack("<Q", n) + b"\1" * (24 * n)
    (t / "images.txt").write_text("\n".join(lines) + "\n")
    (b / "images.bin").write_bytes(buf)
    (b / "images.txt").write_text("# ignored\n")
    x = readers.read_colmap_text(spark, str(t / "images.txt")).drop("scene").orderBy("image_id").collect()
    y = readers.read_colmap(spark, [str(b)]).drop("scene").orderBy("image_id").collect()
    assert x == y and [r["name"] for r in x] == ["dir/a.png", "b.png"]
    both = readers.colmap_poses(readers.read_colmap(spark, [str(t), str(b)])).collect()
    assert len(both) == 4
    assert next(np.allclose(r["pose"]["t"], [-0.5, 0, 1]) for r in both if r["name"] == "b.png")


def test_annotations(spark, tmp_path):
    notes = [{"sequence_name": s, "image": {"path": f"cat/{s}/f{k}.jpg"}, "viewpoint": {"R": np.eye(3).tolist(), "T": [k, 0.0, 1.0]}} for s in "ab" for k in range(2)]
    seqs = [{"sequence_name": "a", "viewpoint_quality_score": 0.9}, {"sequence_name": "b", "viewpoint_quality_score": None}, {"sequence_name": "c"}]
    (tmp_path / "set.json").write_text(json.dumps({"test": [[s, k, f"cat/{s}/f{k}.jpg"] for s in "ab" for k in range(2)], "train": []}))
    for name, v in (("frame.jgz", notes), ("seq.jgz", seqs)):
        (tmp_path / name).write_bytes(gzip.compress(json.dumps(v).encode()))
    listed = readers.read_set_list(spark, [str(tmp_path / "set.json")])
    sq = readers.read_sequence_annotations(spark, [str(tmp_path / "seq.jgz")])
    assert listed.count() == 4 and sq.count() == 3 and listed.first()["category"] == "cat"
    out = readers.join_annotations(listed, readers.read_frame_annotations(spark, [str(tmp_path / "frame.jgz")]), sq).collect()
    assert {(r["sequence"], r["name"]) for r in out} == {("a", "f0.jpg"), ("a", "f1.jpg")}


def test_exact_draw_matches_numpy(spark):
    paths = [f"/x/{i:02d}.jpg" for i in range(30)]
    df = spark.createDataFrame([("room", p) for p in reversed(paths)], "scene string, path string")
    seed = (777 + int(hashlib.sha256(b"room").hexdigest(), 16)) % 2 ** 32
    assert df.select(readers.scene_seed(F.col("scene"))).first()[0] == seed
    want = sorted(paths)
    np.random.default_rng(seed).shuffle(want)
    got = [r["path"] for r in readers.sample_frames(df, 10).orderBy("draw").collect()]
    assert got == want[:10]


def test_exact_draw_of_a_scene_above_the_group_limit(spark, split):
    import hashlib
    rows = [(s, f"{(7 * i) % n:04d}") for s, n in (("room", 300), ("hall", 4), ("one", 1)) for i in range(n)] + [("room", None), ("hall", "0001")]
    df = spark.createDataFrame(rows, "scene string, path string").repartition(5)
    got = {}
    for r in readers.sample_frames(df, 20).orderBy("scene", "draw").collect():
        got.setdefault(r["scene"], []).append(r["path"])
    for scene in ("room", "hall", "one"):
        want = sorted(p for s, p in rows if s == scene and p is not None)
        seed = (777 + int(hashlib.sha256(scene.encode()).hexdigest(), 16)) % 2 ** 32
        np.random.default_rng(seed).shuffle(want)
        assert got[scene] == want[:20]
    assert readers.sample_frames(df.limit(0), 3).count() == 0


def test_fold_per_scene_isolates_errors_of_every_step(spark):
    df = spark.createDataFrame([(s, i) for s in ("a", "b", "c", "d", None) for i in range(40)], "scene string, x long").repartition(9)

    def update(state, pdf):
        if pdf["scene"].iloc[0] == "b" and (pdf["x"] == 17).any():
            raise RuntimeError("boom")
        return (state[0] + len(pdf), state[1] + int(pdf["x"].sum()), pdf["scene"].iloc[0])

    def merge(a, b):
        if "c" in (a[2], b[2]):
            raise KeyError("c")
        return (a[0] + b[0], a[1] + b[1], a[2] or b[2])

    def finish(state):
        if state[2] == "d":
            raise ValueError(f"{state[0]} rows")
        return state[1]

    def run(rows, on_error="skip"):
        return batch.fold_per_scene(rows, lambda: (0, 0, None), update, merge, finish, on_error, fan_in=3).collect()

    got = {r["scene"]: (r["status"], r["error"], r["result"]) for r in run(df)}
    assert got == {"a": ("ok", None, "780"), None: ("ok", None, "780"), "b": ("failed", "RuntimeError: boom", None),
                   "c": ("failed", "KeyError: 'c'", None), "d": ("failed", "ValueError: 40 rows", None)}
    assert run(df.limit(0)) == []
    with pytest.raises(Exception, match="boom"):
        run(df.where("scene = 'b'"), "raise")


def test_many_scenes_share_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "FOLDERS", 3)
    pose = ([1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0], [0.1, 0.2, 0.3])
    rows = [(s, n, float(i), 1.0, 0.0, 0.0, pose) for i, s in enumerate(["007", "7", "a/b", None, *map(str, range(20, 40))]) for n in ("x", "y")]
    v = spark.createDataFrame(rows, "scene string, name string, fx double, fy double, cx double, cy double, pose struct<r:array<double>,t:array<double>>")
    tables.write_views(v, str(tmp_path / "many"))
    out = tables.read_views(spark, str(tmp_path / "many"))
    assert sorted(out.columns) == sorted(v.columns)
    assert sorted(map(str, out.select(v.columns).collect())) == sorted(map(str, v.collect()))
    assert len(list((tmp_path / "many").glob("*=*"))) <= 3  # before, one for each scene


def test_fold_per_scene_meets_a_small_scene_at_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def update(n, pdf):
        calls.add(1)
        return n + len(pdf)

    df = spark.range(3000).selectExpr("nullif(id % 600, 7) AS scene", "id AS x").repartition(6)
    got = {r["scene"]: r["result"] for r in batch.fold_per_scene(df, int, update, lambda a, b: a + b, lambda n: n).collect()}
    assert got == {None if k == 7 else k: "5" for k in range(600)}
    assert calls.value <= 700  # before, once per scene and task: more than two thousand


def test_views_report_and_resume(spark, tmp_path):
    pose = ([1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0], [0.1, 0.2, 0.3])
    v = spark.createDataFrame([("s", n, 1.0, 1.0, 0.0, 0.0, pose, 1, 2, [1.0, 2.0], [3.0, 4.0], bytearray(b"i")) for n in "ba"],
                              "scene string, name string, fx double, fy double, cx double, cy double, pose struct<r:array<double>,t:array<double>>, "
                              "height int, width int, depth array<float>, conf array<double>, img binary")
    for mode, cols in (("pose", 7), ("full", 12)):
        path = str(tmp_path / mode)
        tables.write_views(v, path, mode)
        out = tables.read_views(spark, path)
        assert out.count() == 2 and len(out.columns) == cols
    wrapped = str(tmp_path / "map")
    tables.as_named_views(v).write.parquet(wrapped)
    assert tables.read_views(spark, wrapped).where("name = 'a'").first()["fx"] == 1.0
    assert dict(tables.read_views(spark, wrapped).dtypes)["conf"] == "array<float>"
    tables.prepare_gt(v.select("scene", "name"), v.select("scene", "name", "pose"), str(tmp_path / "gt"))
    assert tables.read_gt(spark, str(tmp_path / "gt")).first()["pose"]["t"][0] == float(np.float32(0.1))
    rep = spark.createDataFrame([("s", 12.3456789, 3)], "scene string, auc double, n int")
    tables.write_report(rep, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).first()["auc"] == "12.3457"
    scenes = spark.createDataFrame([("s",), ("t",)], "scene string")
    assert [r["scene"] for r in tables.pending(scenes, tables.read_views(spark, str(tmp_path / "pose"))).collect()] == ["t"]
    files = spark.createDataFrame([("a",), ("b",)], "path string")
    with pytest.raises(FileNotFoundError):
        tables.require_files(files, files.where("path = 'a'"))
    assert tables.require_files(files, files).count() == 2


def test_failing_scene_is_reported(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "scene string, v int")

    def fn(pdf):
        if pdf["v"].iloc[0] == 2:
            raise RuntimeError("boom")
    got = {r["scene"]: (r["status"], r["error"]) for r in batch.run_per_scene(df, fn).collect()}
    assert got == {"a": ("ok", None), "b": ("failed", "RuntimeError: boom")}
    with pytest.raises(Exception, match="boom"):
        batch.run_per_scene(df, fn, "raise").collect()


def images_bin(n, seed=0, points=40):
    """A model of ``n`` images with unit rotations; observations may hold any bytes."""
    rng = np.random.default_rng(seed)
    buf, rows = struct.pack("<Q", n), []
    for i in range(1, n + 1):
        q = rng.normal(size=4)
        q /= np.linalg.norm(q)
        t, name, k = rng.normal(size=3), f"cam/é{i}.png", int(rng.integers(0, points))
        buf += struct.pack("<idddddddi", i, *q, *t, 1) + name.encode() + b"\0" + struct.pack("<Q", k) + rng.bytes(24 * k)
        rows.append((i, name, *q, *t, 1))
    return buf, rows


def test_binary_model_in_ranges(spark, tmp_path):
    want = set()
    for scene, (n, tail) in {"a": (90, b""), "b": (1, b""), "none": (0, b""), "tail": (30, b"xyz")}.items():
        buf, rows = images_bin(n, seed=n)
        (tmp_path / scene).mkdir()
        (tmp_path / scene / "images.bin").write_bytes(buf + tail)
        want |= {(scene, *r) for r in rows}
    paths = [str(tmp_path / s / "images.bin") for s in ("a", "b", "none", "tail")]
    for size in (64, 1000, 1 << 20):  # ranges inside one record, of some records, whole files
        got = ranges.image_records(spark, paths, size)
        rows = [(r["path"].split("/")[-2], *[r[c] for c in ("image_id", "name", "qw", "qx", "qy", "qz", "tx", "ty", "tz", "camera_id")]) for r in got.collect()]
        assert len(rows) == len(want) and set(rows) == want


def test_observations_that_look_like_records_lose_nothing(spark, tmp_path):
    fake, _ = images_bin(8, seed=5, points=1)
    inner = fake[8:] + b"\0" * (-len(fake[8:]) % 24)
    buf = struct.pack("<Q", 2)
    for i in (1, 2):
        buf += struct.pack("<idddddddi", i, 1, 0, 0, 0, 0, 0, 0, 1) + b"x\0" + struct.pack("<Q", len(inner) // 24) + inner
    (tmp_path / "images.bin").write_bytes(buf)
    for size in (100, 500):
        assert sorted(r["image_id"] for r in ranges.image_records(spark, [str(tmp_path / "images.bin")], size).collect()) == [1, 2]
    (tmp_path / "images.bin").write_bytes(buf[:-10])
    with pytest.raises(Exception, match="is broken"):
        ranges.image_records(spark, [str(tmp_path / "images.bin")], 100).collect()


@pytest.mark.parametrize("piece", [1, 7, 1 << 20])
def test_json_elements_in_pieces(spark, tmp_path, piece):
    items = [{"a": "x]},[\\\" é", "b": [1, {"c": None}]}, 12345, "s", [], None, True]
    (tmp_path / "plain.json").write_text(json.dumps(items, ensure_ascii=False, indent=1), encoding="utf-8")
    (tmp_path / "zip.jgz").write_bytes(gzip.compress(json.dumps(items).encode()))
    (tmp_path / "empty.json").write_text(" [ ] ")
    files = [str(tmp_path / n) for n in ("plain.json", "zip.jgz", "empty.json")]
    got = [json.loads(r["element"]) for r in ranges.json_elements(spark, files, piece=piece).collect()]
    assert len(got) == 12 and all(got.count(i) == 2 for i in items if i is not True)
    (tmp_path / "keyed.json").write_text(json.dumps({"train": [[1], [2]], "n": {"test": [9]}, "test": [[3], [4]]}))
    keyed = ranges.json_elements(spark, [str(tmp_path / "keyed.json")], "test", piece)
    assert sorted(r["element"] for r in keyed.collect()) == ["[3]", "[4]"]
    (tmp_path / "bad.json").write_text('[{"a": 1}, {"b"')
    with pytest.raises(Exception, match="bad.json"):
        ranges.json_elements(spark, [str(tmp_path / "bad.json")], piece=piece).collect()
