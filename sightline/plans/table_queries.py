"""Queries on catalogues, annotations, timings and refinement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.operators import batch, cloud, initial, refine, tracks
from sightline.plans.catalog import query, rnd
from sightline.plans.standins import Tables, r6
from sightline.plans.track_queries import RES
from sightline.scale import cut
from sightline.sources import readers, tables


@query("pending_scenes", "SELECT doc_id AS scene FROM documents ANTI JOIN labels USING (doc_id)")
def _(t: Tables) -> DataFrame:
    scenes = t.read("documents").select(F.col("doc_id").alias("scene"))
    return tables.pending(scenes, t.read("labels").select(F.col("doc_id").alias("scene")))


@query("missing_input_files", "SELECT source || '/' || doc_id AS path FROM documents ANTI JOIN labels USING (doc_id)")
def _(t: Tables) -> DataFrame:
    d = t.read("documents").select("doc_id", F.concat_ws("/", "source", "doc_id").alias("path"))
    return tables.missing_files(d.select("path"), d.join(t.read("labels"), "doc_id", "left_semi"))


@query("quality_filter", "SELECT d.doc_id AS sequence FROM documents d JOIN labels l USING (doc_id) WHERE l.quality > 0.5")
def _(t: Tables) -> DataFrame:
    s = t.read("documents").join(t.read("labels"), "doc_id", "left").select(F.col("doc_id").alias("sequence"), "quality")
    return readers.good_quality(s, 0.5).select("sequence")


@query("annotation_join", """SELECT l.l_orderkey AS sequence, l.l_linenumber::VARCHAR AS name, round(o.o_totalprice, 2) + 0.0 AS quality, round(v.l_tax, 6) + 0.0 AS tax
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN lineitem v ON v.l_orderkey = l.l_orderkey AND v.l_linenumber = l.l_linenumber WHERE o.o_totalprice > 250000""")
def _(t: Tables) -> DataFrame:
    li = t.read("lineitem").select(F.col("l_orderkey").alias("sequence"), F.col("l_linenumber").cast("string").alias("name"), "l_tax")
    listed = li.select("sequence", F.concat_ws("/", "sequence", "name").alias("path"))
    seq = t.read("orders").select(F.col("o_orderkey").alias("sequence"), F.col("o_totalprice").alias("quality"))
    out = readers.join_annotations(listed, li, seq, 250000.0)
    return out.select("sequence", "name", rnd("quality", digits=2), rnd("l_tax", "tax"))


@query("stage_timings", f"""SELECT event_type AS stage, {r6('sum(value)', 'total_time', 4)}, count(*) AS count, {r6('avg(value)', 'avg')}, {r6('stddev_pop(value)', 'std')},
{r6('max(value)', 'max')}, {r6('min(value)', 'min')} FROM events GROUP BY ALL""")
def _(t: Tables) -> DataFrame:
    e = t.read("events").select(F.col("event_type").alias("stage"), F.col("value").alias("seconds"))
    return batch.timing_summary(e).select("stage", rnd("total_time", digits=4), "count", rnd("avg"), rnd("std"), rnd("max"), rnd("min"))


@query("hashed_frame_sample", """SELECT user_id AS scene, event_id AS name FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY sha256(concat_ws('|', user_id, event_id)), event_id) <= 10""")
def _(t: Tables) -> DataFrame:
    e = t.read("events").select(F.col("user_id").alias("scene"), F.col("event_id").alias("name"))
    return readers.sample_frames_by_hash(e, 10)


@query("seeded_frame_sample")
def _(t: Tables) -> DataFrame:
    e = t.read("events").select(F.col("user_id").cast("string").alias("scene"), F.format_string("%09d.png", "event_id").alias("path"))
    return readers.sample_frames(e, 10)


@query("scene_seeds", """SELECT DISTINCT user_id AS scene, (list_sum([(instr('0123456789abcdef', substr(sha256(user_id::VARCHAR), 56 + k, 1)) - 1)*pow(16, 8 - k) FOR k IN range(1, 9)])::BIGINT + 777) % 4294967296 AS seed FROM events""")
def _(t: Tables) -> DataFrame:
    s = t.read("events").select(F.col("user_id").alias("scene")).distinct()
    return s.select("scene", readers.scene_seed(F.col("scene").cast("string")).alias("seed"))


@query("scene_failure_report", """SELECT user_id AS scene, CASE WHEN count(*) > 70 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN count(*) > 70 THEN 'ValueError: too many frames' END AS error FROM events GROUP BY user_id""")
def _(t: Tables) -> DataFrame:
    def check(frames: int) -> None:
        if frames > 70:
            raise ValueError("too many frames")
    e = t.read("events").select(F.col("user_id").alias("scene"), "event_id")
    return batch.fold_per_scene(e, int, lambda n, pdf: n + len(pdf), lambda a, b: a + b, check).select("scene", "status", "error")


# ------------------------------------------------------------------ refinement on the observation stand-in
def _scene(t: Tables, by_track: bool = False) -> tuple[DataFrame, refine.Scene]:
    imgs = t.images().withColumn("z_coefs", F.coalesce("z_coefs", F.array(F.lit(1.0), F.ln("scale"), F.lit(0.0))))
    return t.obs(by_track), refine.Scene(imgs, t.cameras(), t.nodes(), t.points().withColumn("z", F.col("z") + 4))


def _by_row(blocks: DataFrame, keys: list[str], width: int = 11) -> DataFrame:
    """Blocks as one row per matrix row, with its entries as columns."""
    cell = lambda k: F.get("vec", F.col("row") * width + k)
    rows = blocks.select(*keys, "vec", F.explode(F.sequence(F.lit(0), F.expr(f"size(vec) div {width} - 1").cast("int"))).alias("row"))
    return rows.select(*keys, "row", *[rnd(cell(k), f"c{k}", 4) for k in range(width)])


@query("normal_equation_blocks")
def _(t: Tables) -> DataFrame:
    o, s = _scene(t, by_track=True)
    b = refine.normal_blocks(refine.system_rows(o, s, by_image=True), refine.Phase(), 3, eliminate=False)
    return _by_row(b, ["scene", "i"])  # row 11 is the gradient


@query("reduced_normal_equations")
def _(t: Tables) -> DataFrame:
    o, s = _scene(t, by_track=True)
    b = refine.normal_blocks(refine.system_rows(o, s, apart=True), refine.Phase(), 3, scene=s)
    return _by_row(b, ["scene", "i", "j"])


def _soft(axis: str) -> str:
    """The robust loss of a clipped residual at exponent 1 and Huber width 0.5."""
    r = f"least(abs(r{axis}), 100.0::DOUBLE)"
    return f"(CASE WHEN {r} <= 0.5 THEN {r}*{r} ELSE {r} - 0.25 END)"


LIFTED = RES.replace("JOIN points USING (scene, track_id)", "JOIN lifted USING (scene, track_id)").replace(
    ", cam AS", ", lifted AS (SELECT scene, track_id, x, y, z + 4 AS z FROM points), cam AS")


@query("refinement_loss", f"""WITH {LIFTED}, each AS (SELECT scene, valid, CASE WHEN valid THEN ({_soft('x')} + {_soft('y')} + 1e-4::DOUBLE*{_soft('z')})/3 ELSE 0 END AS l,
sqrt(rx*rx + ry*ry) AS e, row_number() OVER (PARTITION BY scene ORDER BY sqrt(rx*rx + ry*ry)) AS rn, count(*) OVER (PARTITION BY scene) AS n FROM res)
SELECT scene, {r6('avg(l)', 'loss')}, {r6('avg(e) FILTER (WHERE rn <= n*80//100)', 'score')}, count(*) FILTER (WHERE NOT valid) AS n_invalid FROM each GROUP BY scene""")
def _(t: Tables) -> DataFrame:
    o, s = _scene(t)
    return refine.scene_loss(o, s, refine.Phase()).select("scene", rnd("loss"), rnd("score"), "n_invalid")


@query("refined_scene_loss")
def _(t: Tables) -> DataFrame:
    o, s = _scene(t)
    _, history = refine.refine(o, s, [refine.Phase()], 3)
    return history.select("scene", "phase", "iteration", rnd("loss", digits=3), rnd("score", digits=3))


@query("initial_poses")
def _(t: Tables) -> DataFrame:
    from sightline.plans.pixel_queries import _spots
    v = cut(t.views())
    o = cut(_spots(t, v).drop("width", "height"))
    pts = cut(cloud.unproject_pixels(t.pixels(), v, world=False))
    out = initial.initial_poses(o, pts, v)
    return out.select("scene", "img_id", rnd("s", digits=4), *[rnd(F.col("t")[k], f"t{k}", 4) for k in range(3)],
                      *[rnd(F.col("r")[k], f"r{k}", 4) for k in range(9)])
