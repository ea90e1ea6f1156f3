"""Queries on observations, tracks, residuals and match graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions import camera
from sightline.operators import graph, tracks
from sightline.plans.catalog import query, rnd
from sightline.plans.standins import CAMERAS, IMAGES, NODES, OBS, POINTS, Tables, r6, sql_mul, sql_quat, sql_rot, sql_trot
from sightline.scale import cut

STAR = f"""{OBS}, {IMAGES}, {CAMERAS}, {NODES}, w2c AS (
  SELECT i.scene, img_id, scale, z_coefs, fx, fy, cx, cy, {sql_mul('c', 'w', 'k')},
         {', '.join(sql_rot('c', ['wt0', 'wt1', 'wt2'], i) + f'+ct{i} AS kt{i}' for i in range(3))}
  FROM images i JOIN cameras c ON i.scene = c.scene AND i.cam_id = c.cam_id JOIN nodes n ON i.scene = n.scene AND i.node_id = n.node_id)"""
LOG_DEPTH = "CASE WHEN z_coefs IS NULL THEN scale*exp(least(dep[1], 80.0::DOUBLE)) ELSE exp(least(list_inner_product(dep, z_coefs), 80.0::DOUBLE)) END"
SHARED = """shared AS (SELECT a.scene, a.img_id AS i, b.img_id AS j, count(*) AS n_matches FROM obs a JOIN obs b
  ON a.scene = b.scene AND a.track_id = b.track_id AND a.img_id < b.img_id GROUP BY ALL)"""


def _star(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    return t.obs(), t.images(), t.cameras(), t.nodes()


@query("observation_star_join", f"""WITH {STAR} SELECT scene, img_id, track_id, {r6('u', 'u')}, fx, {r6('scale', 'scale')},
{', '.join(r6(f'k{i}', f'r{i}') for i in range(9))}, {', '.join(r6(f'kt{i}', f't{i}') for i in range(3))} FROM obs JOIN w2c USING (scene, img_id)""")
def _(t: Tables) -> DataFrame:
    out = tracks.denormalise(*_star(t))
    return out.select("scene", "img_id", "track_id", rnd("u"), "fx", rnd("scale"),
                      *[rnd(F.col("w2cam.r")[i], f"r{i}") for i in range(9)], *[rnd(F.col("w2cam.t")[i], f"t{i}") for i in range(3)])


@query("combine_depth_channels", f"""WITH {OBS}, {IMAGES} SELECT scene, img_id, track_id,
{r6('CASE WHEN z_coefs IS NOT NULL THEN list_inner_product(dep, z_coefs) END', 'linear')},
{r6('CASE WHEN z_coefs IS NOT NULL THEN exp(least(list_inner_product(dep, z_coefs), 80.0::DOUBLE)) END', 'logarithmic')}, {r6('scale*exp(least(dep[1], 80.0::DOUBLE))', 'scaled')}
FROM obs JOIN images USING (scene, img_id)""")
def _(t: Tables) -> DataFrame:
    rows = t.obs().join(t.images(), ["scene", "img_id"])
    dep, z = F.col("dep"), F.col("z_coefs")
    return rows.select("scene", "img_id", "track_id", rnd(camera.combine_depth(dep, z, "linear"), "linear"),
                       rnd(camera.combine_depth(dep, z, "log"), "logarithmic"),
                       rnd(camera.scale_depth(dep, F.col("scale"), "log"), "scaled"))


@query("initial_depth_coefficients", f"""WITH {IMAGES} SELECT scene, img_id, 1.0::DOUBLE AS log0, {r6('ln(scale)', 'log1')}, 0.0::DOUBLE AS log2,
{r6('scale', 'lin0')}, 0.0::DOUBLE AS lin1 FROM images""")
def _(t: Tables) -> DataFrame:
    lg, ln = camera.init_z(F.col("scale"), 3, "log"), camera.init_z(F.col("scale"), 2, "linear")
    return t.images().select("scene", "img_id", lg[0].alias("log0"), rnd(lg[1], "log1"), lg[2].alias("log2"),
                             rnd(ln[0], "lin0"), ln[1].alias("lin1"))


@query("unproject_observations", f"""WITH {STAR} SELECT scene, img_id, track_id, {r6('(u - cx)/fx*dep[1]', 'x', 9)}, {r6('(v - cy)/fy*dep[1]', 'y', 9)},
{r6('dep[1]', 'z')} FROM obs JOIN w2c USING (scene, img_id)""")
def _(t: Tables) -> DataFrame:
    cams = tracks.apply_params(t.images(), t.cameras(), t.nodes()).drop("cam2w")
    out = tracks.unproject_obs(t.obs().withColumn("depth", F.col("dep")[0]), cams)
    return out.select("scene", "img_id", "track_id", rnd("x", digits=9), rnd("y", digits=9), rnd("z"))


WORLD = ", ".join(sql_trot("k", [f"(u - cx)/fx*d - kt0", f"(v - cy)/fy*d - kt1", "d - kt2"], i) + f" AS w{i}" for i in range(3))


@query("apply_refined_parameters", f"""WITH {STAR} SELECT scene, img_id, track_id, fx, cy, {', '.join(r6(f'k{3*j+i}', f'r{3*i+j}') for i in range(3) for j in range(3))},
{', '.join(r6('-' + sql_trot('k', ['kt0', 'kt1', 'kt2'], i), f't{i}') for i in range(3))}, {r6(LOG_DEPTH, 'depth')} FROM obs JOIN w2c USING (scene, img_id)""")
def _(t: Tables) -> DataFrame:
    out = tracks.apply_params(t.images(), t.cameras(), t.nodes(), t.obs())
    return out.select("scene", "img_id", "track_id", "fx", "cy", *[rnd(F.col("cam2w.r")[i], f"r{i}") for i in range(9)],
                      *[rnd(F.col("cam2w.t")[i], f"t{i}") for i in range(3)], rnd("depth"))


@query("track_points", f"""WITH {STAR}, p AS (SELECT *, {LOG_DEPTH} AS d FROM obs JOIN w2c USING (scene, img_id)), w AS (SELECT scene, track_id, {WORLD} FROM p)
SELECT scene, track_id, {r6('avg(w0)', 'x')}, {r6('avg(w1)', 'y')}, {r6('avg(w2)', 'z')} FROM w GROUP BY ALL""")
def _(t: Tables) -> DataFrame:
    return tracks.track_points(*_star(t)).select("scene", "track_id", rnd("x"), rnd("y"), rnd("z"))


@query("shared_tracks", f"WITH {OBS}, {SHARED} SELECT * FROM shared")
def _(t: Tables) -> DataFrame:
    return tracks.shared_tracks(t.obs())


@query("match_graph", f"WITH {OBS}, {SHARED} SELECT * FROM shared WHERE n_matches >= 15")
def _(t: Tables) -> DataFrame:
    return tracks.match_graph(t.obs(), 15)


@query("common_tracks_of_pair", f"""WITH {OBS} SELECT scene, track_id FROM obs WHERE img_id = 1 INTERSECT SELECT scene, track_id FROM obs WHERE img_id = 2""")
def _(t: Tables) -> DataFrame:
    return tracks.common_tracks(t.obs(), 1, 2)


@query("matched_observations", f"""WITH {OBS}, {SHARED} SELECT s.scene, s.i, s.j, count(*) AS n, {r6('avg(a.u - b.u)', 'du', 5)}, {r6('avg(a.v - b.v)', 'dv', 5)}
FROM shared s JOIN obs a ON s.scene = a.scene AND s.i = a.img_id JOIN obs b ON s.scene = b.scene AND s.j = b.img_id AND a.track_id = b.track_id
WHERE s.n_matches >= 22 GROUP BY ALL""")
def _(t: Tables) -> DataFrame:
    o = t.obs()
    m = tracks.matches(o, tracks.match_graph(o, 22))
    return m.groupBy("scene", "i", "j").agg(F.count("*").alias("n"), rnd(F.avg(F.col("ui") - F.col("uj")), "du", 5),
                                            rnd(F.avg(F.col("vi") - F.col("vj")), "dv", 5))


@query("attach_newest_frame", f"""WITH {OBS}, {SHARED} SELECT scene, j, i, n_matches FROM shared s WHERE j = (SELECT max(img_id) FROM obs o WHERE o.scene = s.scene)
QUALIFY row_number() OVER (PARTITION BY scene ORDER BY n_matches DESC, i) = 1""")
def _(t: Tables) -> DataFrame:
    return tracks.attach_last(t.obs())


@query("covisibility_summary", f"""WITH {OBS}, k AS (SELECT scene, track_id, count(*) AS n FROM obs GROUP BY ALL)
SELECT k.scene, CAST(sum(n) AS BIGINT) AS n_obs, count(*) AS n_tracks, max(n) AS longest, {r6('avg(n)', 'mean_length')},
(SELECT count(DISTINCT img_id) FROM obs o WHERE o.scene = k.scene) AS n_images FROM k GROUP BY k.scene""")
def _(t: Tables) -> DataFrame:
    out = tracks.covisibility(t.obs())
    return out.select("scene", "n_obs", "n_tracks", "longest", rnd("mean_length"), "n_images")


BIN = "floor(floor(u)/16)"
SCORE = f"""binned AS (SELECT scene, img_id, track_id, {BIN} AS bx, floor(floor(v)/16) AS by, count(*) OVER (PARTITION BY scene, img_id, {BIN}, floor(floor(v)/16)) AS n FROM obs),
score AS (SELECT scene, track_id, min(n) AS score FROM binned GROUP BY ALL)"""


@query("image_bin_counts", f"WITH {OBS} SELECT scene, img_id, {BIN}::BIGINT AS bx, floor(floor(v)/16)::BIGINT AS by, count(*) AS n FROM obs GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return tracks.bin_counts(t.obs())


@query("track_redundancy", f"WITH {OBS}, {SCORE} SELECT * FROM score")
def _(t: Tables) -> DataFrame:
    return tracks.redundancy(t.obs())


@query("cap_redundant_tracks", f"""WITH {OBS}, binned AS (SELECT scene, img_id, track_id, count(*) OVER (PARTITION BY scene, img_id, floor(floor(u)/64), floor(floor(v)/64)) AS n FROM obs),
score AS (SELECT scene, track_id, min(n) AS score FROM binned GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY score, track_id) AS rn FROM score),
dropped AS (SELECT scene, track_id FROM ranked WHERE rn > 1500 AND score > 1)
SELECT scene, img_id, track_id FROM obs ANTI JOIN dropped USING (scene, track_id)""")
def _(t: Tables) -> DataFrame:
    return tracks.cap_tracks(t.obs(), 1500, 64).select("scene", "img_id", "track_id")


_DROP = """binned{k} AS (SELECT scene, track_id, count(*) OVER (PARTITION BY scene, img_id, floor(floor(u)/64), floor(floor(v)/64)) AS n FROM {at}),
score{k} AS (SELECT scene, track_id, min(n) AS score FROM binned{k} GROUP BY ALL),
over{k} AS (SELECT scene, track_id FROM (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY score, track_id) AS rn FROM score{k}) WHERE rn > 1400 AND score > 1),
left{k} AS (SELECT * FROM {at} ANTI JOIN over{k} USING (scene, track_id))"""


@query("cap_tracks_in_rounds", f"WITH {OBS}, {_DROP.format(k=1, at='obs')}, {_DROP.format(k=2, at='left1')} SELECT scene, img_id, track_id FROM left2")
def _(t: Tables) -> DataFrame:
    return tracks.cap_tracks(t.obs(), 1400, 64, subsample=1_000_000).select("scene", "img_id", "track_id")


INCLUSION = """o AS (SELECT l_returnflag AS scene, l_suppkey % 4 AS img_id, l_orderkey AS track_id, min(l_quantity)*4 AS u,
  min(l_partkey % 100)*2.0::DOUBLE AS v FROM lineitem GROUP BY ALL)"""


def _inclusion(t: Tables) -> DataFrame:
    return t.read("lineitem").groupBy(F.col("l_returnflag").alias("scene"), (F.col("l_suppkey") % 4).alias("img_id"),
                                      F.col("l_orderkey").alias("track_id")).agg(
        (F.min("l_quantity") * 4).alias("u"), (F.min(F.col("l_partkey") % 100) * F.lit(2.0)).alias("v"))


@query("duplicated_tracks", f"""WITH {INCLUSION}, old AS (SELECT *, count(*) OVER (PARTITION BY scene, track_id) AS length FROM o WHERE track_id % 2 = 1)
SELECT DISTINCT scene, track_id FROM (SELECT a.scene, a.track_id, b.track_id AS new_id FROM old a JOIN o b ON a.scene = b.scene AND a.img_id = b.img_id AND b.track_id % 2 = 0
AND (a.u-b.u)*(a.u-b.u) + (a.v-b.v)*(a.v-b.v) < 25 GROUP BY ALL HAVING count(*) = max(a.length))""")
def _(t: Tables) -> DataFrame:
    o = _inclusion(t)
    odd = F.col("track_id") % 2 == 1
    return tracks.duplicated(o.where(odd), o.where(~odd), 5.0)


@query("union_tracks", f"""WITH {OBS}, l AS (SELECT * FROM obs WHERE img_id % 2 = 0), r AS (SELECT * FROM obs WHERE img_id % 2 = 1)
SELECT scene, img_id, track_id FROM l UNION ALL SELECT r.scene, img_id, track_id + s FROM r JOIN (SELECT scene, max(track_id) + 1 AS s FROM l GROUP BY scene) USING (scene)""")
def _(t: Tables) -> DataFrame:
    o = t.obs().select("scene", "img_id", "track_id")
    return tracks.union_tracks(o.where("img_id % 2 = 0"), o.where("img_id % 2 = 1"))


@query("remove_tracks", f"""WITH {OBS}, {SCORE} SELECT scene, img_id, track_id FROM obs ANTI JOIN (SELECT * FROM score WHERE score > 1) USING (scene, track_id)""")
def _(t: Tables) -> DataFrame:
    o = t.obs()
    return tracks.remove_tracks(o, tracks.redundancy(o).where("score > 1")).select("scene", "img_id", "track_id")


@query("renumber_tracks", f"""WITH {OBS} SELECT DISTINCT scene, track_id, dense_rank() OVER (PARTITION BY scene ORDER BY track_id) - 1 AS new_id FROM obs""")
def _(t: Tables) -> DataFrame:
    return tracks.reindex(t.obs())


@query("subset_of_frames", f"""WITH {OBS}, {IMAGES} SELECT scene, img_id, track_id FROM obs SEMI JOIN (SELECT * FROM images WHERE cam_id = 1) USING (scene, img_id)""")
def _(t: Tables) -> DataFrame:
    return tracks.subset(t.obs(), t.images().where("cam_id = 1")).select("scene", "img_id", "track_id")


@query("minimum_track_length", f"""WITH {OBS} SELECT scene, img_id, track_id FROM obs QUALIFY count(*) FILTER (WHERE dep[3] > 0.05) OVER (PARTITION BY scene, track_id) >= 9""")
def _(t: Tables) -> DataFrame:
    o = t.obs().withColumn("scale", F.greatest(F.col("dep")[2] - 0.05, F.lit(0.0)))
    return tracks.min_length(o, 9).select("scene", "img_id", "track_id")


@query("dense_tracks", f"""WITH {OBS}, c AS (SELECT a.scene, a.track_id, b.img_id FROM (SELECT DISTINCT scene, track_id FROM obs) a JOIN (SELECT DISTINCT scene, img_id FROM obs) b USING (scene))
SELECT c.scene, c.img_id, count(*) AS cells, count(u) AS defined, {r6('avg(u) + 0.0001234567::DOUBLE', 'mean_u')} FROM c LEFT JOIN obs o USING (scene, track_id, img_id) GROUP BY ALL""")
def _(t: Tables) -> DataFrame:
    d = tracks.densify(t.obs())
    return d.groupBy("scene", "img_id").agg(F.count("*").alias("cells"), F.count("u").alias("defined"), rnd(F.avg("u") + 0.0001234567, "mean_u"))


@query("overwrite_refined_parameters", f"""WITH {IMAGES} SELECT scene, img_id, {r6('CASE WHEN img_id % 2 = 0 THEN scale*2 ELSE scale END', 'scale')},
{r6('CASE WHEN img_id % 2 = 0 AND z_coefs IS NOT NULL THEN 5.0::DOUBLE ELSE z_coefs[1] END', 'z0')}, {r6('CASE WHEN img_id % 2 = 0 AND z_coefs IS NOT NULL THEN 6.0::DOUBLE ELSE z_coefs[2] END', 'z1')}, {r6('z_coefs[3]', 'z2')} FROM images""")
def _(t: Tables) -> DataFrame:
    i = t.images()
    ref = i.where("img_id % 2 = 0").select("scene", "img_id", (F.col("scale") * 2).alias("scale"), F.array(F.lit(5.0), F.lit(6.0)).alias("z_coefs"))
    out = tracks.overwrite_leading(i, ref, ["scene", "img_id"], ["z_coefs"])
    return out.select("scene", "img_id", rnd("scale"), *[rnd(F.get("z_coefs", F.lit(k)), f"z{k}") for k in range(3)])


RES = f"""{STAR}, {POINTS}, cam AS (SELECT *, {', '.join(sql_rot('k', ['x', 'y', 'z'], i) + f'+kt{i} AS c{i}' for i in range(3))} FROM obs JOIN w2c USING (scene, img_id) JOIN points USING (scene, track_id)),
res AS (SELECT scene, img_id, track_id, c2 > 1e-3 AS valid,
  CASE WHEN c2 > 1e-3 THEN (fx*c0 + cx*c2)/c2 - u ELSE 0 END AS rx, CASE WHEN c2 > 1e-3 THEN (fy*c1 + cy*c2)/c2 - v ELSE 0 END AS ry,
  CASE WHEN c2 > 1e-3 THEN (fx + fy)/2*(coalesce(list_inner_product(dep, z_coefs), ln(scale) + dep[1]) - ln(greatest(c2, 1e-9))) ELSE 0 END AS rz FROM cam)"""


def _res(t: Tables) -> DataFrame:
    return tracks.residuals(*_star(t), t.points())


@query("reprojection_residuals", f"WITH {RES} SELECT scene, img_id, track_id, valid, {r6('rx', 'rx', 5)}, {r6('ry', 'ry', 5)}, {r6('rz', 'rz', 5)} FROM res")
def _(t: Tables) -> DataFrame:
    return _res(t).select("scene", "img_id", "track_id", "valid", rnd("rx", digits=5), rnd("ry", digits=5), rnd("rz", digits=5))


def _robust_sql(axis: str, wz: float) -> str:
    r = f"least(abs(r{axis}), 100.0::DOUBLE)"
    a, b = 0.5 * 0.5 * 1.5 ** -1.5, 1.5 ** 0.5 - 0.5 * 0.5 * 1.5 ** -1.5 * 1.5 * 1.5
    return (r6(f"CASE WHEN valid THEN {wz}*(CASE WHEN {r} <= 1.5 THEN {a!r}::DOUBLE*{r}*{r} ELSE pow({r}, 0.5) - {b!r}::DOUBLE END) ELSE 0 END", f"l{axis}") + ", "
            + r6(f"CASE WHEN NOT valid THEN 0 WHEN {r} >= 100 THEN 1e-16 ELSE {wz}*pow(greatest({r}, 1.5), -1.5) END", f"w{axis}"))


@query("robust_loss_and_weight", f"WITH {RES} SELECT scene, img_id, track_id, {_robust_sql('x', 1.0)}, {_robust_sql('y', 1.0)}, {_robust_sql('z', 0.25)} FROM res")
def _(t: Tables) -> DataFrame:
    out = tracks.robust_terms(_res(t), 0.5, 1.5, 100.0, 0.25)
    return out.select("scene", "img_id", "track_id", *[rnd(f"{k}{a}") for a in "xyz" for k in "lw"])


@query("trimmed_reprojection_score", f"""WITH {RES}, e AS (SELECT scene, sqrt(rx*rx + ry*ry) AS e, row_number() OVER (PARTITION BY scene ORDER BY sqrt(rx*rx + ry*ry)) AS rn,
count(*) OVER (PARTITION BY scene) AS n FROM res) SELECT scene, {r6('avg(e)', 'score', 4)}, count(*) AS n_used FROM e WHERE rn <= n*80//100 GROUP BY scene""")
def _(t: Tables) -> DataFrame:
    return tracks.reproj_score(_res(t)).select("scene", rnd("score", digits=4), "n_used")


# ------------------------------------------------------------------ graph
REACH = """reach AS (SELECT scene, i AS node, i AS seen FROM edges UNION SELECT scene, j, j FROM edges
  UNION SELECT r.scene, r.node, e.o FROM reach r JOIN both_ways e ON r.scene = e.scene AND r.seen = e.n)"""


@query("connected_components", f"""WITH RECURSIVE {OBS}, {SHARED}, edges AS (SELECT scene, i, j FROM shared WHERE n_matches >= 28),
both_ways AS (SELECT scene, i AS n, j AS o FROM edges UNION ALL SELECT scene, j, i FROM edges), {REACH}
SELECT i.scene, i.img_id AS node, coalesce(min(r.seen), i.img_id) AS component FROM (SELECT DISTINCT scene, img_id FROM obs) i
LEFT JOIN reach r ON i.scene = r.scene AND i.img_id = r.node GROUP BY i.scene, i.img_id""")
def _(t: Tables) -> DataFrame:
    o = t.obs()
    nodes = o.select("scene", F.col("img_id").alias("node")).distinct()
    return graph.components(tracks.match_graph(o, 28), nodes)


# Prim's algorithm grows the same tree, as the order of edges is total; its new node hangs from the visited end
PRIM = f"""WITH RECURSIVE {OBS}, {SHARED}, edges AS MATERIALIZED (SELECT * FROM shared WHERE n_matches >= 3),
prim AS (SELECT scene, [min(i)] AS nodes, NULL::BIGINT AS i, NULL::BIGINT AS j, NULL::BIGINT AS n_matches FROM edges GROUP BY scene
  UNION ALL SELECT p.scene, list_append(p.nodes, CASE WHEN list_contains(p.nodes, e.i) THEN e.j ELSE e.i END), e.i, e.j, e.n_matches
  FROM prim p JOIN edges e ON p.scene = e.scene AND list_contains(p.nodes, e.i) <> list_contains(p.nodes, e.j)
  QUALIFY row_number() OVER (PARTITION BY p.scene ORDER BY e.n_matches DESC, e.i, e.j) = 1)"""


@query("max_spanning_tree", f"{PRIM} SELECT scene, i, j, n_matches FROM prim WHERE i IS NOT NULL")
def _(t: Tables) -> DataFrame:
    return graph.max_spanning_tree(tracks.match_graph(t.obs()))


def _relative(edges: DataFrame) -> DataFrame:
    """Made-up but deterministic similarity of every directed edge."""
    both = edges.select("scene", "i", "j").unionByName(edges.select("scene", F.col("j").alias("i"), F.col("i").alias("j")))
    i, j = F.col("i"), F.col("j")
    from sightline.functions.pose import quat_to_rot
    r = quat_to_rot((i % 7) * F.lit(0.02), (j % 5) * F.lit(0.03), F.lit(0.01), F.lit(1.0))
    t = F.array((j - i) * F.lit(0.1), (i % 3) * F.lit(0.2), (j % 4) * F.lit(0.1))
    return both.select("scene", "i", "j", (1 + ((i * 3 + j) % 5 - 2) * F.lit(0.01)).alias("s"), F.array(*r).alias("r"), t.alias("t"))


PLACED = f"""{PRIM}, hung AS (SELECT scene, CASE WHEN nodes[len(nodes)] = i THEN j ELSE i END AS a, nodes[len(nodes)] AS b FROM prim WHERE i IS NOT NULL),
step AS MATERIALIZED (SELECT scene, a, b, 1 + ((a*3 + b) % 5 - 2)*0.01::DOUBLE AS q, {sql_quat('(a % 7)*0.02::DOUBLE', '(b % 5)*0.03::DOUBLE', '0.01::DOUBLE', '1.0::DOUBLE', 'e')},
  (b - a)*0.1::DOUBLE AS et0, (a % 3)*0.2::DOUBLE AS et1, (b % 4)*0.1::DOUBLE AS et2 FROM hung),
placed AS (SELECT scene, nodes[1] AS node, 1.0::DOUBLE AS s, {', '.join(f'{float(k % 4 == 0)}::DOUBLE AS p{k}' for k in range(9))}, 0.0::DOUBLE AS pt0, 0.0::DOUBLE AS pt1, 0.0::DOUBLE AS pt2 FROM prim WHERE i IS NULL
  UNION ALL SELECT p.scene, e.b, p.s*e.q, {sql_mul('p', 'e', 'm')}, {', '.join(f"p.s*{sql_rot('p', ['et0', 'et1', 'et2'], k)} + pt{k}" for k in range(3))} FROM placed p JOIN step e ON p.scene = e.scene AND p.node = e.a)"""


@query("propagate_poses", f"{PLACED} SELECT scene, node, {r6('s', 's')}, {', '.join(r6(f'p{k}', f'r{k}') for k in range(9))}, {', '.join(r6(f'pt{k}', f't{k}', 5) for k in range(3))} FROM placed")
def _(t: Tables) -> DataFrame:
    edges = cut(tracks.match_graph(t.obs()))
    tree = graph.max_spanning_tree(edges)
    roots = edges.groupBy("scene").agg(F.min("i").alias("node"))
    out = graph.propagate(graph.root_tree(tree, roots), _relative(edges), roots)
    return out.select("scene", "node", rnd("s"), *[rnd(F.col("r")[k], f"r{k}") for k in range(9)], *[rnd(F.col("t")[k], f"t{k}", 5) for k in range(3)])
