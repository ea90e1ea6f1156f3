"""Queries on depth pixels, point clouds and dense matches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions import camera
from sightline.operators import cloud, grid, matching, ordered, tracks
from sightline.plans.catalog import query, rnd
from sightline.plans.standins import CANDIDATES, FLOWS, PIXELS, VIEWS, Tables, r6, sql_rot, sql_trot
from sightline.scale import cut

PV = f"WITH {PIXELS}, {VIEWS}"
CAMPTS = f"""{PV}, cp AS (SELECT p.*, width, height, fx, fy, cx, cy, (px + 0.5 - cx)/fx*depth AS x, (py + 0.5 - cy)/fy*depth AS y, depth AS z,
{', '.join(f'v{i}' for i in range(9))}, vt0, vt1, vt2 FROM pixels p JOIN views USING (scene, img_id))"""
WORLD = f"""{CAMPTS}, wp AS (SELECT scene, img_id, px, py, depth, conf, {', '.join(sql_rot('v', ['x', 'y', 'z'], i) + f' + vt{i} AS w{i}' for i in range(3))} FROM cp)"""


@query("unproject_pixels", f"{WORLD} SELECT scene, img_id, px, py, {r6('w0', 'x')}, {r6('w1', 'y')}, {r6('w2', 'z')} FROM wp")
def _(t: Tables) -> DataFrame:
    return cloud.unproject_pixels(t.pixels(), t.views()).select("scene", "img_id", "px", "py", rnd("x"), rnd("y"), rnd("z"))


@query("unproject_strided", f"""{PV} SELECT scene, img_id, px, py, {r6('((px-2)/4.0::DOUBLE + 0.5 - (cx-2)/4)/(fx/4)*depth', 'x', 10)}, {r6('((py-2)/4.0::DOUBLE + 0.5 - (cy-2)/4)/(fy/4)*depth', 'y', 10)}, {r6('depth', 'z')}
FROM pixels JOIN views USING (scene, img_id) WHERE (px - 2) % 4 = 0 AND (py - 2) % 4 = 0 AND px >= 2 AND py >= 2""")
def _(t: Tables) -> DataFrame:
    return cloud.unproject_pixels(t.pixels(), t.views(), world=False, stride=4).select("scene", "img_id", "px", "py", rnd("x", digits=10), rnd("y", digits=10), rnd("z"))


@query("project_points", f"""{WORLD} SELECT scene, img_id, px, py, {r6('(fx*w0 + cx*(w2 - 3))/greatest(w2 - 3, 0.001)', 'u', 4)}, {r6('(fy*w1 + cy*(w2 - 3))/greatest(w2 - 3, 0.001)', 'v', 4)} FROM wp JOIN views USING (scene, img_id)""")
def _(t: Tables) -> DataFrame:
    p = cloud.unproject_pixels(t.pixels(), t.views()).join(t.views(), ["scene", "img_id"])
    u, v = camera.project(F.col("x"), F.col("y"), F.col("z") - 3, {k: F.col(k) for k in cloud.K_COLS}, 1e-3)
    return p.select("scene", "img_id", "px", "py", rnd(u, "u", 4), rnd(v, "v", 4))


@query("ray_log_depth", f"WITH {PIXELS} SELECT scene, img_id, px, py, {r6('px*0.01*exp(depth/5)', 'x')}, {r6('py*0.01*exp(depth/5)', 'y')}, {r6('exp(depth/5)', 'z')}, 1.0::DOUBLE AS constant, {r6('conf', 'second')} FROM pixels")
def _(t: Tables) -> DataFrame:
    x, y, z = camera.raylogz(F.col("px") * 0.01, F.col("py") * 0.01, F.col("depth") / 5)
    dep = camera.insert_constant_channel(F.array("depth", "conf"))
    return t.pixels().select("scene", "img_id", "px", "py", rnd(x, "x"), rnd(y, "y"), rnd(z, "z"), dep[1].alias("constant"), rnd(dep[2], "second"))


@query("filter_by_confidence", f"WITH {PIXELS} SELECT scene, img_id, px, py, {r6('CASE WHEN conf >= 6.5 THEN depth END', 'depth')}, {r6('CASE WHEN conf >= 6.5 THEN conf ELSE 0 END', 'conf')} FROM pixels")
def _(t: Tables) -> DataFrame:
    return cloud.drop_uncertain(t.pixels(), 6.5).select("scene", "img_id", "px", "py", rnd("depth"), rnd("conf"))


@query("drawable_points", f"{WORLD} SELECT scene, img_id, px, py FROM wp WHERE conf - 4.5 > 0 AND isfinite(w0) AND isfinite(w1) AND isfinite(w2)")
def _(t: Tables) -> DataFrame:
    p = cloud.unproject_pixels(t.pixels(), t.views())
    return p.where(camera.drawable(F.col("x"), F.col("y"), F.col("z"), F.col("conf") - 4.5)).select("scene", "img_id", "px", "py")


@query("patch_and_pixel_index", f"""WITH {PIXELS}, a AS (SELECT scene, img_id, px, py, (py // 8)*3 + px // 8 AS patch, (py % 8)*8 + px % 8 AS k FROM pixels)
SELECT scene, img_id, px, py, patch, k, (patch % 3)*8 + k % 8 AS bx, (patch // 3)*8 + k // 8 AS by FROM a""")
def _(t: Tables) -> DataFrame:
    patch, k = camera.patch_of(F.col("px"), F.col("py"), 24, 8)
    rows = t.pixels().select("scene", "img_id", "px", "py", patch.alias("patch"), k.alias("k"))
    bx, by = camera.pixel_of(F.col("patch"), F.col("k"), 24, 8)
    return rows.select("*", bx.alias("bx"), by.alias("by"))


@query("grid_neighbours", f"""WITH {PIXELS}, o AS (SELECT x, y FROM (SELECT unnest(range(-2, 3)) AS x), (SELECT unnest(range(0, 3)) AS y) WHERE y > 0 OR x > 0)
SELECT a.scene, a.img_id, a.px, a.py, count(*) AS n, {r6('sum(b.depth)', 'sum_depth')} FROM pixels a, o, pixels b WHERE a.scene = b.scene AND a.img_id = b.img_id AND b.px = a.px + x AND b.py = a.py + y GROUP BY ALL""")
def _(t: Tables) -> DataFrame:
    n = grid.neighbours(t.pixels(), grid.HALF_WINDOW, ["depth"])
    return n.groupBy("scene", "img_id", "px", "py").agg(F.count("*").alias("n"), rnd(F.sum("n_depth"), "sum_depth"))


SPOTS = """spots AS (SELECT scene, img_id, track_id, u, v, width, height FROM (SELECT l_suppkey % 2 AS scene, (l_suppkey // 2) % 5 AS img_id, l_orderkey AS track_id,
min(l_partkey % 24) + 0.3::DOUBLE AS u, min(l_partkey // 24) + 0.8::DOUBLE AS v FROM lineitem GROUP BY ALL) JOIN views USING (scene, img_id))"""
SAMPLED = """taps AS (SELECT s.*, floor(x)::BIGINT + a AS px, floor(y)::BIGINT + b AS py, (CASE WHEN a = 1 THEN x - floor(x) ELSE 1 - x + floor(x) END)*(CASE WHEN b = 1 THEN y - floor(y) ELSE 1 - y + floor(y) END) AS w
  FROM (SELECT *, {x} AS x, {y} AS y FROM spots) s, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b))"""
BORDER = SAMPLED.format(x="greatest(0, least(width - 1.0::DOUBLE, u - 0.5))", y="greatest(0, least(height - 1.0::DOUBLE, v - 0.5))")
ZEROS = SAMPLED.format(x="u - 2.5", y="v - 2.5")


def _spots(t: Tables, views: DataFrame | None = None) -> DataFrame:
    part = F.col("l_partkey")
    s = t.read("lineitem").groupBy((F.col("l_suppkey") % 2).alias("scene"), (F.floor(F.col("l_suppkey") / 2) % 5).alias("img_id"),
                                   F.col("l_orderkey").alias("track_id")).agg((F.min(part % 24) + F.lit(0.3)).alias("u"),
                                                                             (F.min(F.floor(part / 24)) + F.lit(0.8)).alias("v"))
    views = t.views() if views is None else views
    return s.join(views.select("scene", "img_id", "width", "height"), ["scene", "img_id"])


@query("bilinear_border", f"""{PV}, {SPOTS}, {BORDER} SELECT scene, img_id, track_id, {r6('CASE WHEN count(depth) = count(*) THEN sum(w*depth) END', 'depth', 9)}
FROM taps LEFT JOIN pixels USING (scene, img_id, px, py) WHERE w > 0 GROUP BY ALL""")
def _(t: Tables) -> DataFrame:
    return grid.sample(t.pixels(), _spots(t), ["scene", "img_id", "track_id"], ["depth"]).withColumn("depth", rnd("depth", digits=9))


@query("bilinear_zeros", f"""{PV}, {SPOTS}, {ZEROS} SELECT scene, img_id, track_id, {r6('coalesce(sum(w*depth), 0)', 'depth', 9)}
FROM taps LEFT JOIN pixels USING (scene, img_id, px, py) GROUP BY ALL""")
def _(t: Tables) -> DataFrame:
    s = _spots(t).withColumns({"u": F.col("u") - 2, "v": F.col("v") - 2})
    return grid.sample(t.pixels(), s, ["scene", "img_id", "track_id"], ["depth"], "zeros").withColumn("depth", rnd("depth", digits=9))


@query("gather_observations", f"""{PV}, {SPOTS}, {BORDER}, s AS (SELECT scene, img_id, track_id, u, v, CASE WHEN count(depth) = count(*) THEN sum(w*depth) END AS d0, sum(w) AS d1, sum(w*conf) AS d2
FROM taps LEFT JOIN pixels USING (scene, img_id, px, py) WHERE w > 0 GROUP BY ALL),
long AS (SELECT scene, track_id FROM spots GROUP BY ALL HAVING count(*) >= 2)
SELECT scene, track_id, img_id, {r6('u', 'u')}, 1.0::DOUBLE AS su, {r6('d0', 'd0')}, {r6('d1', 'd1')}, {r6('d2', 'd2')} FROM s JOIN long USING (scene, track_id) WHERE d0 IS NOT NULL""")
def _(t: Tables) -> DataFrame:
    g = t.pixels().select("scene", "img_id", "px", "py", F.array(F.col("depth"), F.lit(1.0), F.col("conf")).alias("dep"))
    s = _spots(t)
    out = matching.gather(s.select("scene", "track_id", "img_id", "u", "v"), g, t.views().select("scene", "img_id", "width", "height"), 3, "drop")
    return out.select("scene", "track_id", "img_id", rnd("u"), "su", *[rnd(F.col("dep")[i], f"d{i}") for i in range(3)])


@query("matched_3d_points", f"""{CAMPTS}, {SPOTS}, {BORDER}, p AS (SELECT scene, img_id, track_id, {', '.join(f'sum(w*{c}) AS {c}' for c in 'xyz')} FROM
(SELECT t.scene, t.img_id, t.track_id, t.w, cp.x, cp.y, cp.z FROM taps t LEFT JOIN cp ON t.scene = cp.scene AND t.img_id = cp.img_id AND t.px = cp.px AND t.py = cp.py WHERE w > 0) GROUP BY ALL HAVING count(z) = count(*))
SELECT a.scene, a.img_id AS i, b.img_id AS j, count(*) AS n, {r6('avg(a.x*b.z)', 'xz', 5)}, {r6('avg(a.y*b.y)', 'yy', 5)} FROM p a JOIN p b ON a.scene = b.scene AND a.track_id = b.track_id AND a.img_id < b.img_id GROUP BY ALL""")
def _(t: Tables) -> DataFrame:
    v = cut(t.views())  # a row per image, read at every step
    s = _spots(t, v).drop("width", "height")
    pts = cloud.unproject_pixels(t.pixels(), v, world=False)
    m = cloud.match3d(s, pts, v, tracks.match_graph(s, 1))
    return m.groupBy("scene", "i", "j").agg(F.count("*").alias("n"), rnd(F.avg(F.col("pi")[0] * F.col("pj")[2]), "xz", 5),
                                            rnd(F.avg(F.col("pi")[1] * F.col("pj")[1]), "yy", 5))


EDGES = f"""{PV}, ang AS (SELECT scene, img_id, greatest(width, height) AS long, cos(least(2*atan(width/(2*fx))/width, 2*atan(height/(2*fy))/height)) AS c FROM views),
o AS (SELECT x, y FROM (SELECT unnest(range(-2, 3)) AS x), (SELECT unnest(range(0, 3)) AS y) WHERE y > 0 OR x > 0),
edges AS MATERIALIZED (SELECT a.scene, a.img_id, a.py*1000 + a.px AS i, b.py*1000 + b.px AS j FROM pixels a JOIN o ON true JOIN pixels b ON a.scene = b.scene AND a.img_id = b.img_id AND b.px = a.px + x AND b.py = a.py + y
  JOIN ang ON ang.scene = a.scene AND ang.img_id = a.img_id WHERE a.depth*a.depth + b.depth*b.depth - 2*a.depth*b.depth*c < 0.045*0.045*a.depth*b.depth)"""


@query("floating_outliers_removed", EDGES.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
both_ways AS MATERIALIZED (SELECT scene, img_id, i AS n, j AS o FROM edges UNION ALL SELECT scene, img_id, j, i FROM edges),
reach AS (SELECT scene, img_id, n, n AS seen FROM both_ways UNION SELECT r.scene, r.img_id, r.n, b.o FROM reach r JOIN both_ways b ON r.scene = b.scene AND r.img_id = b.img_id AND r.seen = b.n),
size AS (SELECT scene, img_id, n, count(*) AS size FROM reach GROUP BY ALL)
SELECT p.scene, p.img_id, px, py, {r6('CASE WHEN size >= 4 THEN depth END', 'depth')}, {r6('CASE WHEN size >= 4 THEN conf ELSE 0 END', 'conf')}
FROM pixels p LEFT JOIN size s ON p.scene = s.scene AND p.img_id = s.img_id AND s.n = py*1000 + px""")
def _(t: Tables) -> DataFrame:
    out = cloud.denoise_floating(t.pixels(), t.views(), 0.045, 4)
    return out.select("scene", "img_id", "px", "py", rnd("depth"), rnd("conf"))


CARVE = f"""{WORLD}, seen AS (SELECT wp.scene, wp.img_id, wp.px, wp.py, wp.conf, q.img_id AS other, q.width, q.height, q.fx, q.fy, q.cx, q.cy,
{', '.join(sql_trot('q.v', [f'w{k} - q.vt{k}' for k in range(3)], i) + f' AS c{i}' for i in range(3))} FROM wp JOIN views q ON wp.scene = q.scene AND wp.img_id <> q.img_id),
spots AS (SELECT scene, img_id, px AS ox, py AS oy, conf AS oc, other, c2 AS d, (fx*c0 + cx*c2)/c2 - 0.5 AS x, (fy*c1 + cy*c2)/c2 - 0.5 AS y FROM seen WHERE c2 > 0),
taps AS (SELECT s.*, floor(x)::BIGINT + a AS px, floor(y)::BIGINT + b AS py, (CASE WHEN a = 1 THEN x - floor(x) ELSE 1 - x + floor(x) END)*(CASE WHEN b = 1 THEN y - floor(y) ELSE 1 - y + floor(y) END) AS w
  FROM spots s, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b) WHERE abs(x) < 1e6 AND abs(y) < 1e6),
seen_at AS (SELECT t.scene, t.img_id, ox, oy, oc, other, d, sum(w*CASE WHEN m.conf > 0 THEN m.depth*0.9::DOUBLE ELSE 0 END) AS e, sum(w*m.conf) AS c
  FROM taps t JOIN pixels m ON t.scene = m.scene AND t.other = m.img_id AND t.px = m.px AND t.py = m.py GROUP BY ALL),
gone AS (SELECT DISTINCT scene, img_id, ox AS px, oy AS py FROM seen_at WHERE d < e AND c >= oc)"""
# confidences that differ from pixel to pixel, so that no comparison hangs on the last bit of a sum
CARVE = CARVE.replace("max(l_tax)*100 AS conf", "max(l_tax)*100 + (max(l_partkey)*7 % 11)*0.013::DOUBLE + max((l_suppkey // 2) % 5)*0.0017::DOUBLE AS conf")


def _uneven(t: Tables) -> DataFrame:
    part = F.col("py") * 24 + F.col("px")
    return t.pixels().withColumn("conf", F.col("conf") + (part * 7 % 11) * F.lit(0.013) + F.col("img_id") * F.lit(0.0017))


@query("depth_carving", f"{CARVE} SELECT p.scene, p.img_id, p.px, p.py, {r6('p.depth', 'depth')}, {r6('CASE WHEN g.px IS NOT NULL THEN 0 ELSE p.conf END', 'conf')} FROM pixels p LEFT JOIN gone g USING (scene, img_id, px, py)")
def _(t: Tables) -> DataFrame:
    return cloud.carve(_uneven(t), t.views()).select("scene", "img_id", "px", "py", rnd("depth"), rnd("conf"))


LAND = CARVE[:CARVE.index("taps AS")].rstrip().rstrip(",")


@query("points_visible_in_other_views", f"{LAND} SELECT s.scene, other AS seen_in, count(*) AS n FROM spots s JOIN views v ON s.scene = v.scene AND s.other = v.img_id WHERE x > -1 AND y > -1 AND x < width AND y < height GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return cloud.visible_in_others(t.pixels(), t.views()).groupBy("scene", "seen_in").agg(F.count("*").alias("n"))


# the steps of cleaning in turn, each on the pixels the one before left
_SURE = "sure AS (SELECT scene, img_id, px, py, CASE WHEN conf >= 4 THEN depth END AS depth, CASE WHEN conf >= 4 THEN conf ELSE 0 END AS conf FROM pixels)"
_GROUPED = """both_ways AS MATERIALIZED (SELECT scene, img_id, i AS n, j AS o FROM edges UNION ALL SELECT scene, img_id, j, i FROM edges),
reach AS (SELECT scene, img_id, n, n AS seen FROM both_ways UNION SELECT r.scene, r.img_id, r.n, b.o FROM reach r JOIN both_ways b ON r.scene = b.scene AND r.img_id = b.img_id AND r.seen = b.n),
size AS (SELECT scene, img_id, n, count(*) AS size FROM reach GROUP BY ALL),
left_over AS MATERIALIZED (SELECT p.scene, p.img_id, px, py, CASE WHEN coalesce(size, 1) >= 3 THEN depth END AS depth, CASE WHEN coalesce(size, 1) >= 3 THEN conf ELSE 0 END AS conf
  FROM sure p LEFT JOIN size s ON p.scene = s.scene AND p.img_id = s.img_id AND s.n = py*1000 + px)"""
_UNEVEN_PV = CARVE[:CARVE.index(", cp AS")]
CLEAN = (_UNEVEN_PV.replace("WITH ", "WITH RECURSIVE ", 1) + ", " + _SURE + EDGES[len(PV):].replace("pixels", "sure") + ", " + _GROUPED
         + CARVE[CARVE.index(", cp AS"):].replace("pixels", "left_over"))


@query("clean_point_cloud", f"""{CLEAN} SELECT p.scene, p.img_id, count(depth) AS defined, count(*) FILTER (WHERE g.px IS NULL AND conf > 0) AS confident
FROM left_over p LEFT JOIN gone g USING (scene, img_id, px, py) GROUP BY ALL""")
def _(t: Tables) -> DataFrame:
    out = cloud.clean(_uneven(t), t.views(), 4.0, 0.045, 3)
    return out.groupBy("scene", "img_id").agg(F.count("depth").alias("defined"), F.count_if(F.col("conf") > 0).alias("confident"))


@query("planar_confidence", f"""{PV}, g AS (SELECT scene, img_id, width, height, px, py, depth FROM pixels JOIN views USING (scene, img_id)),
n AS (SELECT a.*, l.depth AS l, r.depth AS r, u.depth AS u, d.depth AS d FROM g a LEFT JOIN g l ON l.scene = a.scene AND l.img_id = a.img_id AND l.px = a.px - 1 AND l.py = a.py
 LEFT JOIN g r ON r.scene = a.scene AND r.img_id = a.img_id AND r.px = a.px + 1 AND r.py = a.py LEFT JOIN g u ON u.scene = a.scene AND u.img_id = a.img_id AND u.px = a.px AND u.py = a.py - 1
 LEFT JOIN g d ON d.scene = a.scene AND d.img_id = a.img_id AND d.px = a.px AND d.py = a.py + 1),
m AS (SELECT a.scene, a.img_id, a.px, a.py, min(b.depth) AS lo FROM g a, (SELECT unnest([-1, 0, 1]) AS x), (SELECT unnest([-1, 0, 1]) AS y), g b WHERE b.scene = a.scene AND b.img_id = a.img_id AND b.px = a.px + x AND b.py = a.py + y GROUP BY ALL),
q AS (SELECT n.*, lo, 2*depth - CASE WHEN px = 0 THEN 0 ELSE l END - CASE WHEN px = width - 1 THEN 0 ELSE r END AS lx,
 2*depth - CASE WHEN py = 0 THEN 0 ELSE u END - CASE WHEN py = height - 1 THEN 0 ELSE d END AS ly FROM n JOIN m USING (scene, img_id, px, py))
SELECT scene, img_id, px, py, {r6('exp(-0.01*(lx*lx + ly*ly)/(lo*lo))', 'planar')} FROM q""")
def _(t: Tables) -> DataFrame:
    return cloud.planar_conf(t.pixels(), t.views(), 0.01).select("scene", "img_id", "px", "py", rnd("planar"))


@query("tangent_regularity_loss")
def _(t: Tables) -> DataFrame:
    v = t.views()
    pts = cloud.unproject_pixels(t.pixels(), v, world=False)
    ref = pts.withColumns({"x": F.col("x") * 0.9, "z": F.sqrt("z")})
    return cloud.tangent_loss(pts, ref, v).select("scene", "img_id", rnd("tangent_loss"))


@query("points_within_budget", f"""WITH {PIXELS}, k AS (SELECT *, count(*) OVER (PARTITION BY scene, img_id) AS n, count(*) OVER (PARTITION BY scene) AS t,
row_number() OVER (PARTITION BY scene, img_id ORDER BY sha256(concat_ws('|', scene, img_id, px, py)), px, py) AS rn FROM pixels WHERE conf >= 5.5)
SELECT scene, img_id, px, py FROM k WHERE rn <= CASE WHEN t > 3000 THEN floor(n*3000.0::DOUBLE/t) ELSE n END""")
def _(t: Tables) -> DataFrame:
    return cloud.select_points(t.pixels(), 5.5, 3000).select("scene", "img_id", "px", "py")


@query("confidence_upper_bound", f"WITH {PIXELS} SELECT scene, greatest(round_even(quantile_cont(conf*3.3, 0.99), 0), 1.0::DOUBLE) AS conf_upper FROM pixels GROUP BY scene")
def _(t: Tables) -> DataFrame:
    return cloud.conf_upper(t.pixels().withColumn("conf", F.col("conf") * 3.3))


@query("median_depth_per_frame", f"WITH {PIXELS} SELECT scene, img_id, {r6('median(depth)', 'median_depth')} FROM pixels WHERE depth > 0 GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return cloud.median_depth(t.pixels()).select("scene", "img_id", rnd("median_depth"))


@query("median_depth_with_empty_frames", f"WITH {PIXELS} SELECT scene, img_id, {r6('coalesce(median(depth) FILTER (WHERE depth > 0 AND img_id % 2 = 0), 1.0::DOUBLE)', 'median_depth')} FROM pixels GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    some = t.pixels().withColumn("depth", F.when(F.col("img_id") % 2 == 0, F.col("depth")))
    return cloud.median_depth(some).select("scene", "img_id", rnd("median_depth"))


def _vote(n: str, d: str) -> str:
    """A vote n/d, infinite where only d is zero."""
    return f"CASE WHEN {d} <> 0 THEN ({n})/{d} WHEN ({n}) > 0 THEN 'inf'::DOUBLE WHEN ({n}) < 0 THEN '-inf'::DOUBLE END"


FOCAL = f"""{CAMPTS}, votes AS (SELECT scene, img_id, {_vote('(px - width/2.0::DOUBLE)*z', 'x')} AS f FROM cp UNION ALL SELECT scene, img_id, {_vote('(py - height/2.0::DOUBLE)*z', 'y')} FROM cp),
f AS (SELECT scene, img_id, quantile_disc(f, 0.5) AS focal FROM votes WHERE f IS NOT NULL GROUP BY ALL)"""


@query("focal_from_depth", f"{FOCAL} SELECT scene, img_id, {r6('focal', 'focal')} FROM f")
def _(t: Tables) -> DataFrame:
    v = t.views()
    return cloud.focal(cloud.unproject_pixels(t.pixels(), v, world=False), v).select("scene", "img_id", rnd("focal"))


@query("shared_focal", f"{FOCAL} SELECT scene, img_id, {r6('quantile_disc(focal, 0.5) OVER (PARTITION BY scene)', 'focal')} FROM f")
def _(t: Tables) -> DataFrame:
    v = t.views()
    f = cut(cloud.focal(cloud.unproject_pixels(t.pixels(), v, world=False), v))
    return cloud.mono_focal(f.select("scene", "img_id", F.col("focal").alias("fx"), F.col("focal").alias("fy"))).select("scene", "img_id", rnd("fx", "focal"))


def _weiszfeld_sql(rounds: int) -> str:
    steps = [f"""{CAMPTS}, r AS (SELECT scene, img_id, px - width/2.0::DOUBLE AS u, py - height/2.0::DOUBLE AS v, coalesce(x/nullif(z, 0), 0) AS a, coalesce(y/nullif(z, 0), 0) AS b FROM cp)""",
             "f0 AS (SELECT scene, img_id, sum(a*u + b*v)/nullif(sum(a*a + b*b), 0) AS f FROM r GROUP BY ALL)"]
    steps += [f"""f{k} AS MATERIALIZED (SELECT scene, img_id, sum(w*(a*u + b*v))/nullif(sum(w*(a*a + b*b)), 0) AS f FROM (SELECT r.*,
      1/greatest(sqrt((u - f*a)*(u - f*a) + (v - f*b)*(v - f*b)), 1e-8) AS w FROM r JOIN f{k - 1} USING (scene, img_id)) GROUP BY ALL)""" for k in range(1, rounds + 1)]
    return ", ".join(steps) + f" SELECT scene, img_id, {r6('greatest(f, 0)', 'focal')} FROM f{rounds}"


@query("weiszfeld_focal", _weiszfeld_sql(10))
def _(t: Tables) -> DataFrame:
    v = t.views()
    return cloud.focal(cloud.unproject_pixels(t.pixels(), v, world=False), v, "weiszfeld").select("scene", "img_id", rnd("focal"))


# ------------------------------------------------------------------ dense matches
@query("best_match_per_pixel", f"""WITH {FLOWS} SELECT src, tgt, px, py, {r6('greatest(score, 0.35)', 'score')}, {r6('CASE WHEN score >= 0.35 THEN qx END', 'qx')}, {r6('CASE WHEN score >= 0.35 THEN qy END', 'qy')} FROM flows""")
def _(t: Tables) -> DataFrame:
    out = matching.best_match(t.candidates(), ["src", "tgt", "px", "py"], "score", ["okey", "line"], ["qx", "qy"], 0.35)
    return out.select("src", "tgt", "px", "py", rnd("score"), rnd("qx"), rnd("qy"))


@query("quantised_flow", f"""WITH {FLOWS}, q AS (SELECT src, tgt, px, py, round_even(qx*0.37*16, 0)::BIGINT AS fx, greatest(0, least(255, round_even(score*255*1.3, 0)))::BIGINT AS s FROM flows)
SELECT src, tgt, px, py, fx, s, {r6('CASE WHEN s > 0 THEN fx/16.0::DOUBLE END', 'x')} FROM q""")
def _(t: Tables) -> DataFrame:
    f = t.flows().select("src", "tgt", "px", "py", camera.quantise_flow(F.col("qx") * 0.37).alias("fx"), camera.quantise_score(F.col("score") * 1.3).alias("s"))
    return f.select("src", "tgt", "px", "py", F.col("fx").cast("long").alias("fx"), F.col("s").cast("long").alias("s"), rnd(camera.dequantise_flow(F.col("fx"), F.col("s")), "x"))


@query("confidence_gated_scores", f"WITH {FLOWS} SELECT src, tgt, px, py, {r6('CASE WHEN score > 0.35 THEN score*(px + 1)/24 ELSE 0 END', 'score')} FROM flows")
def _(t: Tables) -> DataFrame:
    return t.flows().select("src", "tgt", "px", "py", rnd(camera.gate(F.col("score"), (F.col("px") + 1) / 24, 0.35), "score"))


@query("identity_flow", f"""{PV} SELECT img_id AS src, img_id AS tgt, px, py, px + 0.5::DOUBLE AS qx, py + 0.5::DOUBLE AS qy, 255 AS score FROM views, (SELECT unnest(range(24)) AS px), (SELECT unnest(range((SELECT max(height)::BIGINT FROM views))) AS py) WHERE py < height""")
def _(t: Tables) -> DataFrame:
    return matching.identity_flow(t.views().select("img_id", "width", "height"))


@query("match_repeatability", f"WITH {FLOWS} SELECT src, px, py, {r6('sum(score)', 'score')} FROM flows GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return matching.repeatability(t.flows()).select("src", "px", "py", rnd("score"))


@query("latest_flow_wins", f"""WITH {FLOWS}, late AS (SELECT src, tgt, px, py, score, qx + 1 AS qx, qy FROM flows WHERE score >= 0.5)
SELECT f.src, f.tgt, f.px, f.py, {r6('coalesce(l.qx, f.qx)', 'qx')} FROM flows f LEFT JOIN late l USING (src, tgt, px, py)""")
def _(t: Tables) -> DataFrame:
    f = t.flows().select("src", "tgt", "px", "py", "score", "qx", "qy")
    late = f.where("score >= 0.5").withColumn("qx", F.col("qx") + 1)
    return matching.latest(f, late).select("src", "tgt", "px", "py", rnd("qx"))


MAP = f"""{FLOWS}, sm AS MATERIALIZED (SELECT src, px, py, round(sum(score), 6) AS score FROM flows GROUP BY ALL),
peaks AS MATERIALIZED (SELECT a.src, a.px, a.py, a.score FROM sm a, (SELECT unnest([-1, 0, 1]) AS x), (SELECT unnest([-1, 0, 1]) AS y), sm b
  WHERE a.src = b.src AND b.px = a.px + x AND b.py = a.py + y GROUP BY ALL HAVING a.score = max(b.score) AND a.score > 0)"""


def _score_map(t: Tables) -> DataFrame:
    # sums are rounded so that equal peaks compare equal whatever the order of addition
    return matching.repeatability(t.flows()).withColumn("score", F.round("score", 6))


@query("score_local_maxima", f"WITH {MAP} SELECT src, px, py, score FROM peaks")
def _(t: Tables) -> DataFrame:
    return grid.local_maxima(_score_map(t)).select("src", "px", "py", "score")


def _nms_sql(rounds: int) -> str:
    """Keep every undecided peak that no stronger undecided one suppresses; a few unrolled rounds settle all."""
    out = [f"WITH {MAP}, t0 AS MATERIALIZED (SELECT * FROM peaks)"]
    near = "a.src = b.src AND abs(a.px - b.px) <= 4 AND abs(a.py - b.py) <= 4"
    for n in range(rounds):
        out.append(f"k{n} AS MATERIALIZED (SELECT * FROM t{n} a WHERE NOT EXISTS (SELECT 1 FROM t{n} b WHERE {near} AND (b.score > a.score OR (b.score = a.score AND (b.py < a.py OR (b.py = a.py AND b.px < a.px))))))")
        out.append(f"t{n + 1} AS MATERIALIZED (SELECT * FROM t{n} a WHERE NOT EXISTS (SELECT 1 FROM k{n} b WHERE {near}))")
    return ", ".join(out) + " " + " UNION ALL ".join(f"SELECT src, px, py FROM k{n}" for n in range(rounds))


@query("suppressed_keypoints", _nms_sql(12))
def _(t: Tables) -> DataFrame:
    return matching.nms(grid.local_maxima(_score_map(t)), 8).select("src", "px", "py")


ZOOM = f"""{MAP}, size AS (SELECT 24 AS w, max(l_partkey // 24) + 1 AS h FROM lineitem),
c AS MATERIALIZED (SELECT f.src, f.tgt, f.px, f.py, f.qx, f.qy, f.score, greatest(f.px-1, 0) AS x0, least(f.px+1, w-1) AS x1, greatest(f.py-1, 0) AS y0, least(f.py+1, h-1) AS y1 FROM flows f JOIN peaks k USING (src, px, py), size),
ok AS MATERIALIZED (SELECT * FROM flows WHERE score > 0),
z AS (SELECT c.*, (r.qx-l.qx)/(x1-x0) AS xx, (d.qx-u.qx)/(y1-y0) AS xy, (r.qy-l.qy)/(x1-x0) AS yx, (d.qy-u.qy)/(y1-y0) AS yy FROM c
 LEFT JOIN ok l ON l.src = c.src AND l.tgt = c.tgt AND l.px = x0 AND l.py = c.py LEFT JOIN ok r ON r.src = c.src AND r.tgt = c.tgt AND r.px = x1 AND r.py = c.py
 LEFT JOIN ok u ON u.src = c.src AND u.tgt = c.tgt AND u.px = c.px AND u.py = y0 LEFT JOIN ok d ON d.src = c.src AND d.tgt = c.tgt AND d.px = c.px AND d.py = y1),
zoom AS (SELECT src, tgt, px, py, qx, qy, score, coalesce(CASE WHEN xx*yy - xy*yx IS NOT NULL THEN sqrt(greatest(xx*yy - xy*yx, 0)) END, 0) AS zoom FROM z)"""


def _kpts(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    f = t.flows()
    rows = t.read("lineitem").agg(F.max(F.floor(F.col("l_partkey") / 24)) + 1).first()[0]
    sizes = f.select("src").distinct().select("src", F.lit(24).alias("width"), F.lit(rows).alias("height"))
    return grid.local_maxima(_score_map(t)), f, sizes


@query("local_zoom", f"WITH {ZOOM} SELECT src, tgt, px, py, {r6('zoom', 'zoom')} FROM zoom")
def _(t: Tables) -> DataFrame:
    k, f, s = _kpts(t)
    return matching.local_zoom(f, k, s).select("src", "tgt", "px", "py", rnd("zoom"))


TRACK = f"""{ZOOM}, r AS (SELECT src, px, py, tgt AS img_id, qx AS u, qy AS v, round(zoom, 9) AS scale FROM zoom WHERE score > 0),
good AS (SELECT src, px, py, arg_min(img_id, struct_pack(s := -scale, i := img_id)) AS best FROM r GROUP BY ALL HAVING count(*) FILTER (WHERE scale > 0) >= 2)"""


@query("tracks_from_flows", f"WITH {TRACK} SELECT r.src, r.px, r.py, img_id, {r6('u', 'u')}, {r6('v', 'v')}, {r6('scale', 'scale', 8)} FROM r JOIN good USING (src, px, py)")
def _(t: Tables) -> DataFrame:
    k, f, s = _kpts(t)
    return matching.tracks_from_flows(k, f, s, remove_far=False).select("src", "px", "py", "img_id", rnd("u"), rnd("v"), rnd("scale", digits=8))


@query("tracks_zoomed_most_in_own_frame", f"WITH {TRACK} SELECT r.src, r.px, r.py, img_id, {r6('scale', 'scale', 8)} FROM r JOIN good USING (src, px, py) WHERE best = (r.src + 1) % 5")
def _(t: Tables) -> DataFrame:
    k, f, s = _kpts(t)
    rows = matching.tracks_from_flows(k, f, s, remove_far=False).withColumn("scale", F.round("scale", 9))
    rows = rows.withColumn("own", (F.col("src") + 1) % 5)
    return matching.remove_far(rows, ["src", "px", "py"], "own").select("src", "px", "py", "img_id", rnd("scale", digits=8))


@query("cap_candidate_pairs", f"""WITH {CANDIDATES} SELECT src, tgt, okey, line FROM candidates QUALIFY row_number() OVER (PARTITION BY src, tgt ORDER BY score DESC, okey, line) <= 50""")
def _(t: Tables) -> DataFrame:
    return ordered.cap_pairs(t.candidates(), ["src", "tgt"], "score", ["okey", "line"], 50).select("src", "tgt", "okey", "line")
