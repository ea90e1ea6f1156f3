"""Queries on poses, trajectories and accuracy reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions import camera, pose
from sightline.operators import accuracy, trajectory
from sightline.plans.catalog import query, rnd
from sightline.plans.standins import (FRAMES, POSES, Tables, r6, sql_mul, sql_quat, sql_rot, sql_tmul, sql_trot)
from sightline.scale import shared_dir


def _flat(df: DataFrame, keys: list[str], col: str = "pose") -> DataFrame:
    return df.select(*keys, *[rnd(c, f"r{i}") for i, c in enumerate(F.col(f"{col}.r")[i] for i in range(9))],
                     *[rnd(F.col(f"{col}.t")[i], f"t{i}") for i in range(3)])


def _flat_sql(r: str, t: str) -> str:
    return ", ".join([r6(f"{r}{i}", f"r{i}") for i in range(9)] + [r6(f"{t}{i}", f"t{i}") for i in range(3)])


REL = f"""pairs AS (
  SELECT a.scene, {sql_tmul('a.g', 'b.g', 'rg')}, {sql_tmul('a.p', 'b.p', 'rp')},
         {', '.join(sql_trot('a.g', [f'(b.gt{k}-a.gt{k})' for k in range(3)], i) + f' AS tg{i}' for i in range(3))},
         {', '.join(sql_trot('a.p', [f'(b.pt{k}-a.pt{k})' for k in range(3)], i) + f' AS tp{i}' for i in range(3))}
  FROM poses a JOIN poses b ON a.scene = b.scene AND a.name < b.name)"""


def _rot_err_sql(a: str, b: str) -> str:
    trace = "+".join(f"{a}{i}*{b}{i}" for i in range(9))
    return f"degrees(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, ({trace} - 1)/2))))"


def _trans_err_sql(a: str, b: str) -> str:
    na, nb = (f"(sqrt({'+'.join(f'{p}{i}*{p}{i}' for i in range(3))}) + 1e-15)" for p in (a, b))
    dot = "+".join(f"({a}{i}/{na})*({b}{i}/{nb})" for i in range(3))
    return f"degrees(acos(sqrt(1 - greatest(1 - ({dot})*({dot}), 1e-15))))"


METRICS = f"""{POSES}, {REL}, errs AS (
  SELECT scene, {_rot_err_sql('rg', 'rp')} AS r, {_trans_err_sql('tg', 'tp')} AS t FROM pairs),
metrics AS (
  SELECT scene, 100*avg(CASE WHEN greatest(r,t) <= 30 THEN greatest(30.0::DOUBLE - floor(greatest(r,t)), 1.0::DOUBLE)/30 ELSE 0.0::DOUBLE END) AS auc_30,
         {', '.join(f'100*avg(CASE WHEN r < {k} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS racc_{k}, 100*avg(CASE WHEN t < {k} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS tacc_{k}' for k in (5, 15, 30))},
         avg(r) AS rmean, avg(t) AS tmean, count(*) AS n_pairs FROM errs GROUP BY scene)"""
COLS = ["auc_30", "racc_5", "tacc_5", "racc_15", "tacc_15", "racc_30", "tacc_30", "rmean", "tmean", "n_pairs"]


@query("relative_pose_report", f"""WITH {METRICS}
SELECT CASE WHEN grouping(scene) = 1 THEN 'AVG' ELSE CAST(scene AS VARCHAR) END AS scene,
       {', '.join(r6(f'avg({c})', c, 4) for c in COLS)}
FROM metrics GROUP BY GROUPING SETS ((scene), ())""")
def _(t: Tables) -> DataFrame:
    out = accuracy.report(accuracy.relpose(t.poses(), order=("name",)))
    return out.select("scene", *[rnd(c, digits=4) for c in COLS])


@query("relative_pose_accuracy", f"""WITH {METRICS}
SELECT scene, n_pairs, {', '.join(r6(c, c, 4) for c in COLS if c != 'n_pairs')} FROM metrics""")
def _(t: Tables) -> DataFrame:
    out = accuracy.relpose(t.poses(), order=("name",))
    return out.select("scene", "n_pairs", *[rnd(c, digits=4) for c in COLS if c != "n_pairs"])


@query("frame_pairs", f"""WITH {FRAMES}
SELECT a.scene, count(*) AS n_pairs, {r6('avg(b.value - a.value)', 'mean_step', 5)}, max(b.idx - a.idx) AS longest
FROM frames a JOIN frames b ON a.scene = b.scene AND a.name < b.name GROUP BY a.scene""")
def _(t: Tables) -> DataFrame:
    p = accuracy.pairs(t.frames().select("scene", "name", "value", "idx"))
    return p.groupBy("scene").agg(F.count("*").alias("n_pairs"),
                                  rnd(F.avg(F.col("b.value") - F.col("a.value")), "mean_step", 5),
                                  F.max(F.col("b.idx") - F.col("a.idx")).alias("longest"))


@query("quat_to_rot", f"""WITH q AS (SELECT event_id, {sql_quat('value/100', 'event_id % 5', '(event_id % 3) - 1', '1 + event_id % 2', 'x')} FROM events)
SELECT event_id, {', '.join(r6(f'x{i}', f'r{i}') for i in range(9))} FROM q""")
def _(t: Tables) -> DataFrame:
    e = F.col("event_id")
    r = pose.quat_to_rot(F.col("value") / 100, e % 5, (e % 3) - 1, 1 + e % 2)
    return t.read("events").select("event_id", *[rnd(c, f"r{i}") for i, c in enumerate(r)])


@query("pose_inverse", f"""WITH {POSES} SELECT scene, name, {', '.join(r6(f'g{3*j+i}', f'r{3*i+j}') for i in range(3) for j in range(3))},
{', '.join(r6('-' + sql_trot('g', ['gt0', 'gt1', 'gt2'], i), f't{i}') for i in range(3))} FROM poses""")
def _(t: Tables) -> DataFrame:
    return _flat(t.poses().select("scene", "name", pose.pose_inv(F.col("gt")).alias("pose")), ["scene", "name"])


@query("pose_compose", f"""WITH {POSES}, c AS (SELECT scene, name, {sql_mul('g', 'p', 'm')},
{', '.join(sql_rot('g', ['pt0', 'pt1', 'pt2'], i) + f' + gt{i} AS mt{i}' for i in range(3))} FROM poses)
SELECT scene, name, {_flat_sql('m', 'mt')} FROM c""")
def _(t: Tables) -> DataFrame:
    return _flat(t.poses().select("scene", "name", pose.pose_mul(F.col("gt"), F.col("pred")).alias("pose")), ["scene", "name"])


@query("pose_relative", f"""WITH {POSES}, c AS (SELECT scene, name, {sql_tmul('g', 'p', 'm')},
{', '.join(sql_trot('g', ['pt0-gt0', 'pt1-gt1', 'pt2-gt2'], i) + f' AS mt{i}' for i in range(3))} FROM poses)
SELECT scene, name, {_flat_sql('m', 'mt')} FROM c""")
def _(t: Tables) -> DataFrame:
    return _flat(t.poses().select("scene", "name", pose.relative(F.col("gt"), F.col("pred")).alias("pose")), ["scene", "name"])


# world-to-camera is F·Rᵀ with F = diag(-1,-1,1), so camera-to-world rotation is R·F and its centre −R·T
@query("pytorch3d_to_cam2w", f"""WITH {POSES} SELECT scene, name,
{', '.join(r6(f'g{i}*{(-1, -1, 1)[i % 3]}', f'r{i}') for i in range(9))},
{', '.join(r6('-' + sql_rot('g', ['gt0', 'gt1', 'gt2'], i), f't{i}') for i in range(3))} FROM poses""")
def _(t: Tables) -> DataFrame:
    r, tr = pose.entries(F.col("gt"))
    return _flat(t.poses().select("scene", "name", pose.pytorch3d_to_cam2w(r, tr).alias("pose")), ["scene", "name"])


@query("rebase_first", f"""WITH {POSES}, f AS (SELECT * FROM poses WHERE idx = 1),
c AS (SELECT b.scene, b.name, b.idx, {sql_tmul('a.g', 'b.g', 'm')},
{', '.join(sql_trot('a.g', [f'(b.gt{k}-a.gt{k})' for k in range(3)], i) + f' AS mt{i}' for i in range(3))}
FROM f a JOIN poses b ON a.scene = b.scene) SELECT scene, name, {_flat_sql('m', 'mt')} FROM c""")
def _(t: Tables) -> DataFrame:
    df = t.poses().select("scene", "idx", "name", F.col("gt").alias("pose"))
    return _flat(trajectory.rebase_first(df), ["scene", "name"])


@query("pose_angles", f"""WITH {POSES} SELECT scene, name, {r6(_rot_err_sql('g', 'p'), 'rot_err', 4)},
{r6(_trans_err_sql('gt', 'pt'), 'trans_err', 4)} FROM poses""")
def _(t: Tables) -> DataFrame:
    rg, tg = pose.entries(F.col("gt"))
    rp, tp = pose.entries(F.col("pred"))
    return t.poses().select("scene", "name", rnd(pose.rotation_angle(rg, rp), "rot_err", 4),
                            rnd(pose.translation_angle(tg, tp), "trans_err", 4))


@query("nearest_asof_join", f"""WITH {FRAMES}, c AS (
  SELECT i.scene, i.name, i.ts, p.name AS pose_name, abs(p.ts - i.ts) AS gap,
         row_number() OVER (PARTITION BY i.scene, i.name ORDER BY abs(p.ts - i.ts), p.ts, p.name) AS rn
  FROM frames i JOIN frames p ON i.scene = p.scene AND p.event_type = 'click' WHERE i.event_type = 'view')
SELECT scene, name, pose_name, {r6('gap', 'gap', 4)} FROM c WHERE rn = 1 AND gap < 21600""")
def _(t: Tables) -> DataFrame:
    f = t.frames()
    images = f.where("event_type = 'view'").select("scene", "name", "ts")
    poses = f.where("event_type = 'click'").select("scene", "ts", F.col("name").alias("pose_name"))
    out = trajectory.nearest_asof(images, poses, "ts", ["scene"], 21600.0, "pose_name")
    return out.select("scene", "name", "pose_name", rnd("gap", digits=4))


@query("interpolate_trajectory", f"""WITH {POSES}, p AS (SELECT scene, ts, pt0, pt1, pt2, event_type FROM poses WHERE event_type = 'click'),
seg AS (SELECT * FROM (SELECT *, {', '.join(f'lead({c}) OVER w AS n_{c}' for c in ('ts', 'pt0', 'pt1', 'pt2'))}
  FROM p WINDOW w AS (PARTITION BY scene ORDER BY ts)) WHERE n_ts IS NOT NULL),
firsts AS (SELECT scene, arg_min(struct_pack(ts, pt0, pt1, pt2, n_ts, n_pt0, n_pt1, n_pt2), ts) AS f FROM seg GROUP BY scene),
g AS (SELECT scene, ts, name FROM poses),
m AS (SELECT g.scene, g.name, g.ts, coalesce(struct_pack(ts := s.ts, pt0 := s.pt0, pt1 := s.pt1, pt2 := s.pt2, n_ts := s.n_ts, n_pt0 := s.n_pt0, n_pt1 := s.n_pt1, n_pt2 := s.n_pt2), f.f) AS s,
      s.ts IS NULL AS outside
  FROM g ASOF LEFT JOIN seg s ON g.scene = s.scene AND g.ts >= s.ts LEFT JOIN firsts f ON g.scene = f.scene),
r AS (SELECT scene, name, CASE WHEN outside THEN f.f ELSE s END AS s, m.ts FROM m LEFT JOIN firsts f USING (scene))
SELECT scene, name, {', '.join(r6(f's.pt{i} + (s.n_pt{i} - s.pt{i})*(ts - s.ts)/(s.n_ts - s.ts)', f'x{i}', 4) for i in range(3))} FROM r""")
def _(t: Tables) -> DataFrame:
    p = t.poses(("event_type",))
    pred = p.where("event_type = 'click'").select("scene", "ts", F.col("pred").alias("pose"))
    out = trajectory.interpolate(pred, p.select("scene", "ts", "name"))
    return out.select("scene", "name", *[rnd(F.col("pred_pose.t")[i], f"x{i}", 4) for i in range(3)])


PREDICTED = "event_type IN ('view', 'click', 'purchase')"


@query("missing_frames", f"WITH {FRAMES} SELECT scene, name FROM frames WHERE NOT ({PREDICTED})")
def _(t: Tables) -> DataFrame:
    f = t.frames().select("scene", "name", "event_type")
    return accuracy.missing_frames(f, f.where(PREDICTED)).select("scene", "name")


@query("frame_coverage", f"""WITH {FRAMES} SELECT scene, {r6(f'100.0::DOUBLE*count(*) FILTER (WHERE {PREDICTED})/count(*)', 'coverage')},
count(*) FILTER (WHERE {PREDICTED}) AS n_frames FROM frames GROUP BY scene""")
def _(t: Tables) -> DataFrame:
    p = t.poses(("event_type",))
    out = accuracy.coverage(p.select("scene", "name", "gt"), p.where(PREDICTED).select("scene", "name"))
    return out.select("scene", rnd("coverage"), "n_frames")


@query("matched_frames", f"""WITH {POSES} SELECT scene, name, {r6('pt0', 'x')}, {r6('gt0', 'y')} FROM poses WHERE {PREDICTED}""")
def _(t: Tables) -> DataFrame:
    p = t.poses(("event_type",))
    out = accuracy.match_frames(p.select("scene", "name", "gt"), p.where(PREDICTED).select("scene", "name", "pred"),
                                allow_subset=True)
    return out.select("scene", "name", rnd(F.col("pred.t")[0], "x"), rnd(F.col("gt.t")[0], "y"))


SCENE_METRICS = """m AS (SELECT user_id AS scene, user_id % 7 AS category, avg(value) AS auc_30, max(value) AS racc_5, min(value) AS tacc_5,
  avg(value*value) AS racc_15, count(*) AS n_pairs FROM events GROUP BY ALL)"""


def _scene_metrics(t: Tables) -> DataFrame:
    return t.read("events").groupBy(F.col("user_id").alias("scene"), (F.col("user_id") % 7).alias("category")).agg(
        F.avg("value").alias("auc_30"), F.max("value").alias("racc_5"), F.min("value").alias("tacc_5"),
        F.avg(F.col("value") * F.col("value")).alias("racc_15"), F.count("*").alias("n_pairs"))


@query("missing_scene_scores_zero", f"""WITH {SCENE_METRICS}, ok AS (SELECT * FROM m WHERE auc_30 > 50)
SELECT s.scene, CASE WHEN ok.scene IS NULL THEN 'missing' ELSE 'ok' END AS status, {r6('coalesce(auc_30, 0.0::DOUBLE)', 'auc_30')},
{r6('coalesce(racc_5, 0.0::DOUBLE)', 'racc_5')}, {r6('coalesce(tacc_5, 0.0::DOUBLE)', 'tacc_5')}, {r6('racc_15', 'racc_15', 4)}, n_pairs
FROM (SELECT DISTINCT user_id AS scene FROM events) s LEFT JOIN ok ON s.scene = ok.scene""")
def _(t: Tables) -> DataFrame:
    scenes = t.read("events").select(F.col("user_id").alias("scene")).distinct()
    out = accuracy.with_missing(scenes, _scene_metrics(t).drop("category").where("auc_30 > 50"))
    return out.select("scene", "status", rnd("auc_30"), rnd("racc_5"), rnd("tacc_5"), rnd("racc_15", digits=4), "n_pairs")


@query("missing_scene_dropped", f"""WITH {SCENE_METRICS} SELECT scene, {r6('auc_30', 'auc_30')}, n_pairs FROM m WHERE auc_30 > 50""")
def _(t: Tables) -> DataFrame:
    scenes = t.read("events").select(F.col("user_id").alias("scene")).distinct()
    out = accuracy.with_missing(scenes, _scene_metrics(t).where("auc_30 > 50"), policy="drop")
    return out.select("scene", rnd("auc_30"), "n_pairs")


@query("macro_average_report", f"""WITH {SCENE_METRICS}, c AS (SELECT category, avg(auc_30) AS auc_30, avg(racc_5) AS racc_5, avg(n_pairs) AS n_pairs FROM m GROUP BY category)
SELECT CASE WHEN grouping(category) = 1 THEN 'AVG' ELSE CAST(category AS VARCHAR) END AS category,
{r6('avg(auc_30)', 'auc_30')}, {r6('avg(racc_5)', 'racc_5')}, {r6('avg(n_pairs)', 'n_pairs')} FROM c GROUP BY GROUPING SETS ((category), ())""")
def _(t: Tables) -> DataFrame:
    out = accuracy.macro_report(_scene_metrics(t).select("scene", "category", "auc_30", "racc_5", "n_pairs"), "category")
    return out.select("category", rnd("auc_30"), rnd("racc_5"), rnd("n_pairs"))


def _centres(t: Tables) -> DataFrame:
    return t.poses().select("scene", F.col("pred.t").alias("x"), F.col("gt.t").alias("y"))


@query("trajectory_error_unaligned", f"""WITH {POSES}, e AS (SELECT scene, sqrt({'+'.join(f'(pt{i}-gt{i})*(pt{i}-gt{i})' for i in range(3))}) AS e FROM poses)
SELECT scene, {r6('sqrt(avg(e*e))', 'ate_rmse')}, {r6('avg(e)', 'ate_mean')}, {r6('median(e)', 'ate_median')},
{r6('stddev_pop(e)', 'ate_std')}, {r6('max(e)', 'ate_max')}, count(*) AS n_frames FROM e GROUP BY scene""")
def _(t: Tables) -> DataFrame:
    out = accuracy.ate(_centres(t), aligned=False)
    return out.select("scene", *[rnd(f"ate_{k}") for k in ("rmse", "mean", "median", "std", "max")], "n_frames")


@query("trajectory_error_aligned")
def _(t: Tables) -> DataFrame:
    out = accuracy.ate(_centres(t))
    return out.select("scene", *[rnd(f"ate_{k}") for k in ("rmse", "mean", "median", "std", "max")], "n_frames")


@query("similarity_alignment")
def _(t: Tables) -> DataFrame:
    out = accuracy.umeyama(_centres(t), ["scene"])
    return out.select("scene", rnd("s"), *[rnd(F.col("r")[i], f"r{i}") for i in range(9)],
                      *[rnd(F.col("t")[i], f"t{i}") for i in range(3)], "n")


@query("every_nth_frame", f"WITH {FRAMES} SELECT scene, name FROM frames WHERE (idx - 1) % 4 = 0")
def _(t: Tables) -> DataFrame:
    return trajectory.every_nth(t.frames(), 4, order=("ts", "name")).select("scene", "name")


@query("last_k_frames", f"""WITH {FRAMES} SELECT q.scene, q.idx AS query, p.idx FROM frames q JOIN frames p
ON q.scene = p.scene AND p.idx < q.idx AND p.idx >= q.idx - 3""")
def _(t: Tables) -> DataFrame:
    return trajectory.last_k(t.frames().select("scene", "idx"), 3)


@query("trajectory_segments", f"""WITH {POSES}, s AS (SELECT scene, idx, gt0, gt1, gt2, {', '.join(f'lead(gt{i}) OVER w AS n{i}' for i in range(3))},
lead(idx) OVER w AS nidx FROM poses WINDOW w AS (PARTITION BY scene ORDER BY idx))
SELECT scene, idx, {', '.join(r6(f'gt{i}', f'a{i}') + ', ' + r6(f'n{i}', f'b{i}') for i in range(3))} FROM s WHERE nidx IS NOT NULL""")
def _(t: Tables) -> DataFrame:
    out = trajectory.segments(t.poses().select("scene", "idx", F.col("gt").alias("pose")))
    return out.select("scene", "idx", *[rnd(F.col(c)[i], f"{n}{i}") for i in range(3) for c, n in (("from_t", "a"), ("to_t", "b"))])


@query("frame_range", f"WITH {FRAMES} SELECT scene, name, idx FROM frames WHERE idx BETWEEN 10 AND 40")
def _(t: Tables) -> DataFrame:
    return trajectory.frame_range(t.frames(), 10, 40).select("scene", "name", "idx")


@query("only_listed_categories", "SELECT event_id, event_type FROM events WHERE event_type IN ('view', 'signup')")
def _(t: Tables) -> DataFrame:
    return trajectory.only(t.read("events"), ["view", "signup"], "event_type").select("event_id", "event_type")


def _resize_sql(ar: float | None) -> str:
    """All boxes of the ratio as candidates; the first that fits is taken."""
    image = "image AS (SELECT event_id, (100 + event_id*7 % 1920)::DOUBLE AS w, (100 + event_id*11 % 1080)::DOUBLE AS h FROM events)"
    box = "box AS (SELECT event_id, w, h, 0.0::DOUBLE AS sx, 0.0::DOUBLE AS sy FROM image)"
    if ar:
        image += f""", candidate AS (
            SELECT event_id, 1 AS place, w, h, floor(floor(h/2)/{ar}::DOUBLE + 0.5::DOUBLE) AS x, floor(h/2) AS y FROM image WHERE h/{ar}::DOUBLE <= w UNION ALL
            SELECT event_id, 2, w, h, floor(w/2), floor(floor(w/2)/{ar}::DOUBLE + 0.5::DOUBLE) FROM image WHERE w/{ar}::DOUBLE <= h UNION ALL
            SELECT event_id, 3, w, h, floor(w/2), floor(floor(w/2)*{ar}::DOUBLE + 0.5::DOUBLE) FROM image)"""
        box = "box AS (SELECT event_id, 2*x AS w, 2*y AS h, x - floor(w/2) AS sx, y - floor(h/2) AS sy FROM candidate QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY place) = 1)"
    return f"""WITH {image}, {box}, sized AS (SELECT *, 512::DOUBLE/greatest(w, h) AS scale FROM box),
    half AS (SELECT *, floor(round_even(w*scale, 0)/2) AS x, floor(round_even(h*scale, 0)/2) AS y FROM sized)
    SELECT event_id, CAST(16*floor(x/8) AS BIGINT) AS width, CAST(16*floor(y/8) AS BIGINT) AS height, {r6('scale', 'scale')},
           {r6('scale*sx - (x - 8*floor(x/8))', 'dx')}, {r6('scale*sy - (y - 8*floor(y/8))', 'dy')} FROM half"""


def _resize(t: Tables, ar: float | None) -> DataFrame:
    e = F.col("event_id")
    out = t.read("events").select("event_id", camera.resize_transform(100 + e * 7 % 1920, 100 + e * 11 % 1080, 512, 16, ar).alias("x"))
    return out.select("event_id", "x.width", "x.height", *[rnd(F.col(f"x.{c}"), c) for c in ("scale", "dx", "dy")])


@query("resize_geometry", _resize_sql(None))
def _(t: Tables) -> DataFrame:
    return _resize(t, None)


@query("resize_to_aspect_ratio", _resize_sql(1.5))
def _(t: Tables) -> DataFrame:
    return _resize(t, 1.5)


@query("refinement_cadence", f"""WITH {FRAMES} SELECT scene, idx, CASE WHEN idx <= 8 OR (idx - 1) % 10 = 0 THEN 'global' ELSE 'local' END AS mode FROM frames""")
def _(t: Tables) -> DataFrame:
    from sightline.streaming.online import refinement_mode
    return t.frames().select("scene", "idx", refinement_mode(F.col("idx") - 1, 10).alias("mode"))


@query("running_image_size", f"""WITH {FRAMES} SELECT scene, idx, max(100 + name*11 % 1080) OVER w AS max_height, max(100 + name*7 % 1920) OVER w AS max_width
FROM frames WINDOW w AS (PARTITION BY scene ORDER BY idx)""")
def _(t: Tables) -> DataFrame:
    from sightline.operators.tracks import running_max
    e = F.col("name")
    f = t.frames().select("scene", "idx", (100 + e * 11 % 1080).alias("height"), (100 + e * 7 % 1920).alias("width"))
    return running_max(f, {"max_height": "height", "max_width": "width"}).select("scene", "idx", "max_height", "max_width")


@query("ground_truth_table", f"WITH {POSES} SELECT scene, name, {_flat_sql('g', 'gt')} FROM poses")
def _(t: Tables) -> DataFrame:
    from sightline.sources.tables import read_gt, write_gt
    path = f"{shared_dir(t.spark)}/gt-{uuid.uuid4().hex}"
    write_gt(t.poses().select("scene", "name", F.col("gt").alias("pose")), path)
    return _flat(read_gt(t.spark, path), ["scene", "name"])


@query("saved_views_round_trip", f"WITH {POSES} SELECT scene, name, {r6('value', 'fx')}, {_flat_sql('p', 'pt')} FROM poses")
def _(t: Tables) -> DataFrame:
    from sightline.sources.tables import read_views, write_views
    path = f"{shared_dir(t.spark)}/views-{uuid.uuid4().hex}"
    v = t.poses().join(t.read("events").select(F.col("event_id").alias("name"), "value"), "name")
    fx = F.col("value")
    write_views(v.select("scene", "name", fx.alias("fx"), fx.alias("fy"), F.lit(1.0).alias("cx"), F.lit(1.0).alias("cy"),
                         F.col("pred").alias("pose")), path, "pose")
    out = read_views(t.spark, path)
    return _flat(out, ["scene", "name", "fx"]).withColumn("fx", rnd("fx"))


@query("scene_bounds", f"""WITH {POSES}, s AS (SELECT scene, {', '.join(f'quantile_cont(pt{i}, 0.02) AS l{i}, quantile_cont(pt{i}, 0.98) AS h{i}, avg(gt{i}) AS e{i}' for i in range(3))} FROM poses GROUP BY scene),
d AS (SELECT *, {', '.join(f'(l{i}+h{i})/2 AS c{i}' for i in range(3))}, greatest(sqrt({'+'.join(f'(h{i}-l{i})*(h{i}-l{i})' for i in range(3))})/2, 1e-6) AS radius FROM s),
n AS (SELECT *, sqrt({'+'.join(f'(c{i}-e{i})*(c{i}-e{i})' for i in range(3))}) AS len FROM d)
SELECT scene, {r6('radius', 'radius')}, {', '.join(r6(f'c{i}', f'center{i}') for i in range(3))},
{', '.join(r6(f'CASE WHEN len < 1e-9 THEN {(0.0, 0.0, 1.0)[i]}::DOUBLE ELSE (c{i}-e{i})/len END', f'dir{i}') for i in range(3))} FROM n""")
def _(t: Tables) -> DataFrame:
    from sightline.operators.cloud import bounds
    p = t.poses()
    pts = p.select("scene", *[F.col("pred.t")[i].alias(c) for i, c in enumerate("xyz")])
    out = bounds(pts, p.select("scene", F.col("gt").alias("cam2w")))
    return out.select("scene", rnd("radius"), *[rnd(F.col("center")[i], f"center{i}") for i in range(3)],
                      *[rnd(F.col("direction")[i], f"dir{i}") for i in range(3)])
