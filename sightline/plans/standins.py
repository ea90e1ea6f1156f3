"""Domain tables derived from the driver's tables, as DataFrames and as SQL text for the oracle.

Every stand-in reads whole tables. Formulas only rename and rescale columns so that the result has the
shape of poses, observations, pixels, flows or descriptors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions.pose import dot3, pose_from_quat, quat_to_rot, rigid
from sightline.operators.ordered import row_number


def seconds(ts: str) -> Column:
    """Seconds since 1970 of a zone-less timestamp column."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({ts} as timestamp_ntz)) / 1e6D")


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # ------------------------------------------------------------------ poses
    def frames(self) -> DataFrame:
        """Frames of each user's event stream, numbered from 1 in time order."""
        e = self.read("events").select(F.col("user_id").alias("scene"), F.col("event_id").alias("name"),
                                       seconds("ts").alias("ts"), "event_type", "value")
        return row_number(e, ["scene"], ["ts", "name"], "idx")

    def poses(self, extra: tuple[str, ...] = ()) -> DataFrame:
        """True pose and a perturbed prediction per event."""
        e, v = F.col("name"), F.col("value")
        df = self.frames().select("*", (v / 100).alias("a"), ((e % 11) / F.lit(5.0)).alias("b"),
                                  ((e % 7) * F.lit(0.05) + 0.01).alias("d"))
        s = F.sin(F.col("d") / 2) / F.sqrt(F.lit(14.0))
        df = df.select("*", F.sin("a").alias("qx"), (F.sin("b") / 2).alias("qy"), (F.cos("a") * 0.3).alias("qz"),
                       (F.cos("b") + 1.5).alias("qw"), s.alias("s"), F.cos(F.col("d") / 2).alias("c"))
        quat = quat_to_rot(*[F.col(c) for c in ("qx", "qy", "qz", "qw")])
        step = quat_to_rot(F.col("s"), 2 * F.col("s"), 3 * F.col("s"), F.col("c"))
        df = df.select("scene", "idx", "name", "ts", *extra, F.array(*quat).alias("g"), F.array(*step).alias("st"),
                       (v / 50).alias("t0"), ((e % 13) * F.lit(0.5)).alias("t1"), ((e % 29) * F.lit(0.25)).alias("t2"))
        g, st = ([F.col(c)[i] for i in range(9)] for c in ("g", "st"))
        turned = [dot3(g[3 * i:3 * i + 3], [st[j], st[3 + j], st[6 + j]]) for i in range(3) for j in range(3)]
        t = [F.col(f"t{i}") for i in range(3)]
        moved = [2 * t[0] + (e % 7) * F.lit(0.05), 2 * t[1] + (e % 5) * F.lit(0.03), 2 * t[2] + 1.0]
        return df.select("scene", "idx", "name", "ts", *extra, F.struct(F.col("g").alias("r"), F.array(*t).alias("t")).alias("gt"),
                         rigid(turned, moved).alias("pred"))

    # ------------------------------------------------------------- observations
    def obs(self, by_track: bool = False) -> DataFrame:
        """Track observations: image = supplier, track = part, scene = return flag.

        With ``by_track`` the rows move once, to the task of their track, for operators that join or group by track.
        """
        li = self.read("lineitem")
        if by_track:
            li = li.select("l_returnflag", "l_suppkey", "l_partkey", "l_extendedprice", "l_quantity", "l_tax", "l_discount").repartition("l_returnflag", "l_partkey")
        g = li.groupBy(F.col("l_returnflag").alias("scene"), F.col("l_suppkey").alias("img_id"),
                       F.col("l_partkey").alias("track_id"))
        d = g.agg(F.min("l_extendedprice").alias("p"), F.min("l_quantity").alias("q"),
                  F.min("l_tax").alias("tax"), F.max("l_discount").alias("disc"))
        return d.select("scene", "img_id", "track_id", (F.col("p") % 512).alias("u"),
                        ((F.col("q") * 7) % 384).alias("v"),
                        F.array(F.col("tax") * 5 + 1, F.lit(1.0), F.col("disc")).alias("dep"))

    def images(self) -> DataFrame:
        """One row per (scene, image) with camera, node, scale and depth coefficients."""
        k = self.read("lineitem").select(F.col("l_returnflag").alias("scene"), F.col("l_suppkey").alias("img_id")).distinct()
        i = F.col("img_id")
        return k.select("scene", "img_id", (i % 3).alias("cam_id"), i.alias("node_id"),
                        ((i % 5) * F.lit(0.1) + 0.8).alias("scale"),
                        F.when(i % 4 != 0, F.array(F.lit(1.0), (i % 5) * F.lit(0.02), F.lit(0.3))).alias("z_coefs"))

    def cameras(self) -> DataFrame:
        k = self.images().select("scene", "cam_id").distinct()
        c = F.col("cam_id")
        rig = pose_from_quat(c * F.lit(0.01), F.lit(0.02), c * F.lit(-0.01), c * F.lit(0.01), F.lit(0.02), F.lit(0.0), F.lit(1.0))
        return k.select("scene", "cam_id", (400 + c * F.lit(10.0)).alias("fx"), (410 + c * F.lit(10.0)).alias("fy"),
                        F.lit(256.0).alias("cx"), F.lit(192.0).alias("cy"), rig.alias("rig2cam"))

    def nodes(self) -> DataFrame:
        k = self.images().select("scene", "node_id").distinct()
        n = F.col("node_id")
        p = pose_from_quat((n % 7) * F.lit(0.1), (n % 5) * F.lit(-0.1), (n % 3) * F.lit(0.2) + 1.0,
                           (n % 11) * F.lit(0.01), (n % 13) * F.lit(-0.01), F.lit(0.02), F.lit(1.0))
        return k.select("scene", "node_id", p.alias("w2rig"))

    def points(self) -> DataFrame:
        k = self.read("lineitem").select(F.col("l_returnflag").alias("scene"), F.col("l_partkey").alias("track_id")).distinct()
        t = F.col("track_id")
        return k.select("scene", "track_id", ((t % 17) * F.lit(0.2) - 1.6).alias("x"),
                        ((t % 19) * F.lit(0.15) - 1.3).alias("y"), ((t % 23) * F.lit(0.25) - 0.5).alias("z"))

    # ------------------------------------------------------------------ pixels
    def pixels(self) -> DataFrame:
        """Depth grid: two scenes of five images, 24 pixels wide and as tall as there are parts."""
        li = self.read("lineitem")
        part = F.col("l_partkey")
        g = li.groupBy((F.col("l_suppkey") % 2).alias("scene"), (F.floor(F.col("l_suppkey") / 2) % 5).alias("img_id"),
                       (part % 24).alias("px"), F.floor(part / 24).alias("py"))
        return g.agg((F.max("l_extendedprice") / 10000 + 1).alias("depth"), (F.max("l_tax") * 100).alias("conf"))

    def views(self) -> DataFrame:
        """Camera of each image of ``pixels`` with its grid size."""
        k = self.pixels().groupBy("scene", "img_id").agg((F.max("py") + 1).alias("height"))
        i = F.col("img_id")
        pose = pose_from_quat(i * F.lit(0.05), i * F.lit(-0.03), i * F.lit(0.02), i * F.lit(0.01), i * F.lit(-0.02),
                              F.lit(0.01), F.lit(1.0))
        return k.select("scene", "img_id", F.lit(24).cast("long").alias("width"), "height",
                        (20 + i * F.lit(1.0)).alias("fx"), (21 + i * F.lit(1.0)).alias("fy"),
                        F.lit(12.0).alias("cx"), (F.col("height") / 2).alias("cy"), pose.alias("cam2w"))

    # ------------------------------------------------------------- descriptors
    def desc(self) -> DataFrame:
        """Descriptors: scene = label, image = vector; attention is the size of the first component."""
        e = self.read("embeddings")
        vec = F.col("embedding").cast("array<double>")
        return e.select(F.col("label").alias("scene"), F.col("vec_id").alias("img_id"), vec.alias("vec"),
                        F.abs(vec[0]).alias("attn"))

    # ------------------------------------------------------------------- flows
    def flows(self) -> DataFrame:
        """Best stored match per (source, target, pixel) of the candidates."""
        from sightline.operators.matching import best_match
        return best_match(self.candidates(), ["src", "tgt", "px", "py"], "score", ["okey", "line"], ["qx", "qy"])

    def candidates(self) -> DataFrame:
        li = self.read("lineitem")
        part = F.col("l_partkey")
        src = F.col("l_suppkey") % 5
        return li.select(src.alias("src"), ((src + 1 + F.col("l_linenumber") % 4) % 5).alias("tgt"),
                         (part % 24).alias("px"), F.floor(part / 24).alias("py"),
                         ((part % 24) * F.lit(1.0) + (F.col("l_orderkey") * 7 % 16) / 8).alias("qx"),
                         (F.floor(part / 24) * F.lit(1.0) + (F.col("l_orderkey") * 5 % 16) / 8).alias("qy"),
                         (F.col("l_discount") * 10).alias("score"), F.col("l_orderkey").alias("okey"),
                         F.col("l_linenumber").alias("line"))


# ----------------------------------------------------------------------------- SQL twins
def sql_quat(x: str, y: str, z: str, w: str, prefix: str) -> str:
    n2 = f"(({x})*({x})+({y})*({y})+({z})*({z})+({w})*({w}))"
    X, Y, Z, W = (f"(({c})/sqrt({n2}))" for c in (x, y, z, w))
    rows = [f"1-2*({Y}*{Y}+{Z}*{Z})", f"2*({X}*{Y}-{Z}*{W})", f"2*({X}*{Z}+{Y}*{W})",
            f"2*({X}*{Y}+{Z}*{W})", f"1-2*({X}*{X}+{Z}*{Z})", f"2*({Y}*{Z}-{X}*{W})",
            f"2*({X}*{Z}-{Y}*{W})", f"2*({Y}*{Z}+{X}*{W})", f"1-2*({X}*{X}+{Y}*{Y})"]
    return ", ".join(f"{e} AS {prefix}{i}" for i, e in enumerate(rows))


def sql_mul(a: str, b: str, out: str) -> str:
    """Rotation product of columns a0..a8 and b0..b8."""
    return ", ".join("+".join(f"{a}{3*i+k}*{b}{3*k+j}" for k in range(3)) + f" AS {out}{3*i+j}"
                     for i in range(3) for j in range(3))


def sql_tmul(a: str, b: str, out: str) -> str:
    """aᵀ·b."""
    return ", ".join("+".join(f"{a}{3*k+i}*{b}{3*k+j}" for k in range(3)) + f" AS {out}{3*i+j}"
                     for i in range(3) for j in range(3))


def sql_rot(a: str, v: list[str], i: int) -> str:
    return "(" + "+".join(f"{a}{3*i+k}*({v[k]})" for k in range(3)) + ")"


def sql_trot(a: str, v: list[str], i: int) -> str:
    return "(" + "+".join(f"{a}{3*k+i}*({v[k]})" for k in range(3)) + ")"


def r6(expr: str, name: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0 AS {name}"


FRAMES = """frames AS (
  SELECT user_id AS scene, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS idx, event_id AS name,
         epoch_us(ts) / 1e6 AS ts, event_type, value FROM events)"""

POSES = f"""{FRAMES}, base AS (
  SELECT *, value/100 AS qa, (name % 11)/5.0::DOUBLE AS qb, (name % 7)*0.05::DOUBLE + 0.01::DOUBLE AS d FROM frames),
halfway AS (
  SELECT *, {sql_quat('sin(qa)', 'sin(qb)/2', 'cos(qa)*0.3::DOUBLE', 'cos(qb)+1.5::DOUBLE', 'g')},
         {sql_quat('sin(d/2)/sqrt(14)', '2*sin(d/2)/sqrt(14)', '3*sin(d/2)/sqrt(14)', 'cos(d/2)', 's')},
         value/50 AS gt0, (name % 13)*0.5::DOUBLE AS gt1, (name % 29)*0.25::DOUBLE AS gt2 FROM base),
poses AS (
  SELECT *, {sql_mul('g', 's', 'p')}, 2*gt0 + (name % 7)*0.05::DOUBLE AS pt0, 2*gt1 + (name % 5)*0.03::DOUBLE AS pt1,
         2*gt2 + 1.0::DOUBLE AS pt2 FROM halfway)"""

OBS = """obs AS (
  SELECT l_returnflag AS scene, l_suppkey AS img_id, l_partkey AS track_id, min(l_extendedprice) % 512 AS u,
         (min(l_quantity)*7) % 384 AS v, [min(l_tax)*5 + 1, 1.0::DOUBLE, max(l_discount)] AS dep
  FROM lineitem GROUP BY ALL)"""

IMAGES = """images AS (
  SELECT scene, img_id, img_id % 3 AS cam_id, img_id AS node_id, (img_id % 5)*0.1::DOUBLE + 0.8::DOUBLE AS scale,
         CASE WHEN img_id % 4 <> 0 THEN [1.0::DOUBLE, (img_id % 5)*0.02::DOUBLE, 0.3::DOUBLE] END AS z_coefs
  FROM (SELECT DISTINCT l_returnflag AS scene, l_suppkey AS img_id FROM lineitem))"""

CAMERAS = f"""cameras AS (
  SELECT scene, cam_id, 400 + cam_id*10.0::DOUBLE AS fx, 410 + cam_id*10.0::DOUBLE AS fy, 256.0::DOUBLE AS cx, 192.0::DOUBLE AS cy,
         {sql_quat('cam_id*0.01::DOUBLE', '0.02::DOUBLE', '0.0::DOUBLE', '1.0::DOUBLE', 'c')},
         cam_id*0.01::DOUBLE AS ct0, 0.02::DOUBLE AS ct1, cam_id*-0.01::DOUBLE AS ct2
  FROM (SELECT DISTINCT scene, cam_id FROM images))"""

NODES = f"""nodes AS (
  SELECT scene, node_id, {sql_quat('(node_id % 11)*0.01::DOUBLE', '(node_id % 13)*-0.01::DOUBLE', '0.02::DOUBLE', '1.0::DOUBLE', 'w')},
         (node_id % 7)*0.1::DOUBLE AS wt0, (node_id % 5)*-0.1::DOUBLE AS wt1, (node_id % 3)*0.2::DOUBLE + 1.0::DOUBLE AS wt2
  FROM (SELECT DISTINCT scene, node_id FROM images))"""

POINTS = """points AS (
  SELECT scene, track_id, (track_id % 17)*0.2::DOUBLE - 1.6::DOUBLE AS x, (track_id % 19)*0.15::DOUBLE - 1.3::DOUBLE AS y,
         (track_id % 23)*0.25::DOUBLE - 0.5::DOUBLE AS z
  FROM (SELECT DISTINCT l_returnflag AS scene, l_partkey AS track_id FROM lineitem))"""

PIXELS = """pixels AS (
  SELECT l_suppkey % 2 AS scene, (l_suppkey // 2) % 5 AS img_id, l_partkey % 24 AS px, l_partkey // 24 AS py,
         max(l_extendedprice)/10000 + 1 AS depth, max(l_tax)*100 AS conf FROM lineitem GROUP BY ALL)"""

VIEWS = f"""views AS (
  SELECT scene, img_id, 24 AS width, height, 20 + img_id*1.0::DOUBLE AS fx, 21 + img_id*1.0::DOUBLE AS fy,
         12.0::DOUBLE AS cx, height/2.0::DOUBLE AS cy,
         {sql_quat('img_id*0.01::DOUBLE', 'img_id*-0.02::DOUBLE', '0.01::DOUBLE', '1.0::DOUBLE', 'v')},
         img_id*0.05::DOUBLE AS vt0, img_id*-0.03::DOUBLE AS vt1, img_id*0.02::DOUBLE AS vt2
  FROM (SELECT scene, img_id, max(py) + 1 AS height FROM pixels GROUP BY ALL))"""

DESC = """descr AS (
  SELECT label AS scene, vec_id AS img_id, embedding::DOUBLE[] AS vec, abs(embedding[1]::DOUBLE) AS attn FROM embeddings)"""

CANDIDATES = """candidates AS (
  SELECT l_suppkey % 5 AS src, (l_suppkey % 5 + 1 + l_linenumber % 4) % 5 AS tgt, l_partkey % 24 AS px, l_partkey // 24 AS py,
         (l_partkey % 24)*1.0::DOUBLE + (l_orderkey*7 % 16)/8.0::DOUBLE AS qx,
         (l_partkey // 24)*1.0::DOUBLE + (l_orderkey*5 % 16)/8.0::DOUBLE AS qy,
         l_discount*10 AS score, l_orderkey AS okey, l_linenumber AS line FROM lineitem)"""

FLOWS = f"""{CANDIDATES}, flows AS (
  SELECT src, tgt, px, py, score, qx, qy FROM candidates
  QUALIFY row_number() OVER (PARTITION BY src, tgt, px, py ORDER BY score DESC, okey, line) = 1)"""
