"""Queries on descriptors, codebooks, image retrieval and frame selection."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions.camera import let
from sightline.operators import clustering, retrieval, selection
from sightline.operators.ordered import sum_vectors
from sightline.plans.catalog import ORACLES, query, rnd
from sightline.plans.standins import DESC, Tables, r6
from sightline.scale import cut

DIM = 64  # of the embeddings table


def _components(n: int = DIM, name: str = "vec") -> list:
    return [rnd(F.col(name)[i], f"v{i}") for i in range(n)]


POS = "pos AS (SELECT unnest(range(1, 65)) AS p)"
BOOK = f"""{POS}, book AS (SELECT word, list(m ORDER BY p) AS vec FROM (SELECT label AS word, p, avg(embedding[p]::DOUBLE) AS m FROM embeddings, pos GROUP BY ALL) GROUP BY word)"""


def _book(t: Tables) -> DataFrame:
    """Codebook: mean vector of each label."""
    d = t.read("embeddings").select(F.col("label").alias("word"), F.concat(F.col("embedding").cast("array<double>"), F.array(F.lit(1.0))).alias("vec"))
    s = sum_vectors(d, ["word"], F.col("vec"), DIM + 1)
    return s.select("word", let(F.col("vec"), lambda x: F.transform(F.slice(x, 1, DIM), lambda v: v / F.get(x, F.lit(DIM)))).alias("vec"))


@query("normalised_descriptors", f"""WITH {DESC} SELECT img_id, {r6('sqrt(list_inner_product(vec, vec))', 'attention')},
{', '.join(r6(f'vec[{i + 1}]/sqrt(list_inner_product(vec, vec))', f'v{i}') for i in range(DIM))} FROM descr""")
def _(t: Tables) -> DataFrame:
    from sightline.functions.camera import array_norm, normalise
    return t.desc().select("img_id", rnd(array_norm(F.col("vec")), "attention"), normalise(F.col("vec")).alias("vec")).select(
        "img_id", "attention", *_components())


@query("whiten_descriptors", f"""WITH {DESC}, {POS}, z AS (SELECT img_id, j.p AS j, sum((vec[i.p] - (i.p - 1)*0.01::DOUBLE)*((((i.p - 1)*7 + (j.p - 1)*3) % 11) - 5)/10) AS z
FROM descr, pos i, pos j GROUP BY ALL) SELECT img_id, {', '.join(r6(f'max(z) FILTER (WHERE j = {i + 1})', f'v{i}') for i in range(DIM))} FROM z GROUP BY img_id""")
def _(t: Tables) -> DataFrame:
    i = np.arange(DIM)
    proj = ((i[:, None] * 7 + i[None, :] * 3) % 11 - 5) / 10
    return retrieval.whiten(t.desc().select("img_id", "vec"), i * 0.01, proj).select("img_id", *_components())


@query("pca_whitening")
def _(t: Tables) -> DataFrame:
    d = t.desc().select("img_id", "vec")
    mean, proj = retrieval.fit_whitening(d, 1.0, DIM)
    from sightline.functions.camera import array_norm
    return retrieval.whiten(d, mean, proj).select("img_id", rnd(array_norm(F.col("vec")), "length", 5))


@query("pooled_scene_descriptor", f"""WITH {DESC}, {POS}, s AS (SELECT scene, p, sum(vec[p]*attn) AS v FROM descr, pos GROUP BY ALL),
l AS (SELECT scene, list(v ORDER BY p) AS vec FROM s GROUP BY scene) SELECT scene, {', '.join(r6(f'vec[{i + 1}]/sqrt(list_inner_product(vec, vec))', f'v{i}') for i in range(DIM))} FROM l""")
def _(t: Tables) -> DataFrame:
    return retrieval.spoc(t.desc(), DIM, ["scene"]).select("scene", *_components())


@query("select_local_descriptors", f"""WITH {DESC} SELECT scene, img_id AS feat_id FROM descr QUALIFY row_number() OVER (PARTITION BY scene ORDER BY attn DESC, img_id) <= 7""")
def _(t: Tables) -> DataFrame:
    return retrieval.select_local(t.desc().withColumnRenamed("img_id", "feat_id"), 7, ["scene"]).select("scene", "feat_id")


@query("select_local_fraction", f"""WITH {DESC} SELECT scene, img_id AS feat_id FROM descr QUALIFY row_number() OVER (PARTITION BY scene ORDER BY attn DESC, img_id) <= floor(0.25*count(*) OVER (PARTITION BY scene))""")
def _(t: Tables) -> DataFrame:
    return retrieval.select_local(t.desc().withColumnRenamed("img_id", "feat_id"), -0.25, ["scene"]).select("scene", "feat_id")


@query("sample_local_descriptors", f"""WITH {DESC} SELECT scene, img_id AS feat_id FROM descr QUALIFY row_number() OVER (PARTITION BY scene ORDER BY sha256(concat_ws('|', scene, img_id)), img_id) <= 9""")
def _(t: Tables) -> DataFrame:
    return retrieval.sample_features(t.desc().withColumnRenamed("img_id", "feat_id"), 9, ["scene"]).select("scene", "feat_id")


NEAREST_WORDS = f"""WITH {DESC}, {BOOK} SELECT img_id, word, {r6('sqrt(list_sum([(vec_a[i]-vec_b[i])*(vec_a[i]-vec_b[i]) FOR i IN range(1, 65)]))', 'dist')}
FROM (SELECT img_id, word, d.vec AS vec_a, b.vec AS vec_b, row_number() OVER (PARTITION BY img_id ORDER BY list_distance(d.vec, b.vec), word) AS rn FROM descr d, book b) WHERE rn <= 3"""


@query("nearest_codebook_words", NEAREST_WORDS)
def _(t: Tables) -> DataFrame:
    d = t.desc().select("img_id", "vec")
    return retrieval.quantise(d, _book(t), 3, ["img_id"]).select("img_id", "word", rnd("dist"))


@query("nearest_words_by_pivots", NEAREST_WORDS)
def _(t: Tables) -> DataFrame:
    d = t.desc().select("img_id", "vec")
    return retrieval.quantise(d, _book(t), 3, ["img_id"], slice_words=3).select("img_id", "word", rnd("dist"))


LOCAL = "loc AS (SELECT vec_id % 2 AS scene, vec_id // 10 AS img_id, vec_id AS feat_id, embedding::DOUBLE[] AS vec FROM embeddings)"


def _local(t: Tables) -> DataFrame:
    v = F.col("vec_id")
    return t.read("embeddings").select((v % 2).alias("scene"), F.floor(v / 10).alias("img_id"), v.alias("feat_id"),
                                       F.col("embedding").cast("array<double>").alias("vec"))


def _bits(name: str, k: int) -> str:
    return f"""near{name} AS (SELECT scene, img_id, word, l.vec AS x, b.vec AS c FROM loc l, book b QUALIFY row_number() OVER (PARTITION BY feat_id ORDER BY list_distance(l.vec, b.vec), word) <= {k}),
bits{name} AS (SELECT scene, img_id, word, p, sum(x[p]) - sum(c[p]) > 0 AS bit FROM near{name}, pos GROUP BY ALL)"""


@query("inverted_index", f"""WITH {LOCAL}, {BOOK}, {_bits('d', 1)} SELECT scene, img_id, word, count(*) FILTER (WHERE bit) AS n_positive FROM bitsd GROUP BY ALL""")
def _(t: Tables) -> DataFrame:
    out = retrieval.asmk_aggregate(_local(t), _book(t))
    ones = F.aggregate(F.transform("bits", lambda b: F.bit_count(b)), F.lit(0), lambda s, v: s + v)
    return out.select("scene", "img_id", "word", ones.cast("long").alias("n_positive"))


@query("inverted_index_scores", f"""WITH {LOCAL}, {BOOK}, {_bits('d', 1)}, {_bits('q', 5)},
u AS (SELECT q.scene, q.img_id AS i, d.img_id AS j, q.word, 1 - 2*count(*) FILTER (WHERE q.bit <> d.bit)/64.0::DOUBLE AS u FROM bitsq q JOIN bitsd d ON q.scene = d.scene AND q.word = d.word AND q.p = d.p GROUP BY ALL),
nq AS (SELECT scene, img_id AS i, count(DISTINCT word) AS nq FROM bitsq GROUP BY ALL), nd AS (SELECT scene, img_id AS j, count(DISTINCT word) AS nd FROM bitsd GROUP BY ALL)
SELECT u.scene, u.i, u.j, {r6('sum(pow(u, 3))/sqrt(max(nq)*max(nd))', 's')} FROM u JOIN nq USING (scene, i) JOIN nd USING (scene, j) WHERE u > 0 GROUP BY ALL""")
def _(t: Tables) -> DataFrame:
    loc, book = _local(t), _book(t)
    q = cut(retrieval.asmk_aggregate(loc, book, retrieval.QUERY_ASSIGN))
    out = retrieval.asmk_scores(q, cut(retrieval.asmk_aggregate(loc, book)), DIM)
    return out.select("scene", "i", "j", rnd("s"))


SIM = f"""{DESC}, sim AS (SELECT a.scene, a.img_id AS i, b.img_id AS j, list_inner_product(a.vec, b.vec) AS s FROM descr a JOIN descr b ON a.scene = b.scene AND b.img_id < a.img_id)"""


@query("most_similar_by_descriptor", f"""WITH {SIM} SELECT scene, i, j, {r6('s', 's')} FROM (SELECT a.scene, a.i, a.j, a.s/sqrt(list_inner_product(x.vec, x.vec)*list_inner_product(y.vec, y.vec)) AS s FROM sim a JOIN descr x ON x.img_id = i JOIN descr y ON y.img_id = j)
QUALIFY row_number() OVER (PARTITION BY scene, i ORDER BY s DESC, j) <= 5""")
def _(t: Tables) -> DataFrame:
    return retrieval.top_similar(t.desc(), 5).select("scene", "i", "j", rnd("s"))


def _sim(t: Tables) -> selection.Vectors:
    """The past pairs of a scene by their vectors; the table of pairs is never written."""
    return selection.Vectors(t.desc())


def _frames(t: Tables) -> DataFrame:
    return t.desc().select("scene", "img_id")


@query("retrieve_all_past", f"""WITH {DESC} SELECT a.scene, a.img_id AS query, count(*) AS n, sum(b.img_id)::BIGINT AS id_sum FROM descr a JOIN descr b ON a.scene = b.scene AND b.img_id < a.img_id GROUP BY ALL""")
def _(t: Tables) -> DataFrame:
    return selection.all_past(_frames(t)).groupBy("scene", "query").agg(F.count("*").alias("n"), F.sum("img_id").alias("id_sum"))


@query("retrieve_last", f"""WITH {DESC}, n AS (SELECT scene, img_id, row_number() OVER (PARTITION BY scene ORDER BY img_id) AS n FROM descr)
SELECT a.scene, a.img_id AS query, b.img_id FROM n a JOIN n b ON a.scene = b.scene AND b.n < a.n AND b.n >= a.n - 4""")
def _(t: Tables) -> DataFrame:
    return selection.last(_frames(t), 4)


@query("retrieve_most_similar", f"""WITH {SIM} SELECT scene, i AS query, j AS img_id FROM sim QUALIFY row_number() OVER (PARTITION BY scene, i ORDER BY s DESC, j) <= 5""")
def _(t: Tables) -> DataFrame:
    return selection.topsim(_sim(t), 5)


def _diverse_sql(kind: str, k: int) -> str:
    acc0 = "0.0::DOUBLE"
    parts = [f"low AS (SELECT scene, least(min(s), 1.0::DOUBLE) AS m FROM sim GROUP BY scene)",
             "norm AS MATERIALIZED (SELECT scene, i, j, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (s - m + 1e-6)/(1 - m + 1e-6))) AS s FROM sim JOIN low USING (scene))",
             "sym AS MATERIALIZED (SELECT * FROM norm UNION ALL SELECT scene, j, i, s FROM norm)",
             f"c0 AS MATERIALIZED (SELECT scene, i AS query, j AS img_id, greatest(s, 1e-6) AS s, {acc0} AS acc FROM norm)"]
    for n in range(k):
        agg = {"max": "acc", "avg": f"acc/{max(n, 1)}", "rmse": f"sqrt(acc/{max(n, 1)})"}[kind]
        score = "s" if n == 0 else f"s*greatest(1 - {agg}, 1e-6)"
        parts.append(f"b{n} AS MATERIALIZED (SELECT scene, query, img_id FROM c{n} QUALIFY row_number() OVER (PARTITION BY scene, query ORDER BY {score} DESC, img_id) = 1)")
        if n < k - 1:
            acc = {"max": "greatest(c.acc, y.s)", "avg": "c.acc + y.s", "rmse": "c.acc + y.s*y.s"}[kind]
            parts.append(f"c{n + 1} AS MATERIALIZED (SELECT c.scene, c.query, c.img_id, c.s, {acc} AS acc FROM c{n} c JOIN b{n} b ON c.scene = b.scene AND c.query = b.query AND c.img_id <> b.img_id JOIN sym y ON y.scene = c.scene AND y.i = c.img_id AND y.j = b.img_id)")
    return f"WITH {SIM}, " + ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT * FROM b{n}" for n in range(k))


@query("retrieve_diverse_max", _diverse_sql("max", 4))
def _(t: Tables) -> DataFrame:
    return selection.diverse(_sim(t), 4, "max")


@query("retrieve_diverse_avg", _diverse_sql("avg", 3))
def _(t: Tables) -> DataFrame:
    return selection.diverse(_sim(t), 3, "avg")


@query("retrieve_diverse_rmse", _diverse_sql("rmse", 3))
def _(t: Tables) -> DataFrame:
    return selection.diverse(_sim(t), 3, "rmse")


SYM = "sym AS MATERIALIZED (SELECT scene, i, j, s FROM sim UNION ALL SELECT scene, j, i, s FROM sim)"
START = "sha256(concat_ws('|', scene, img_id))"


def _fps_parts(n: int, group: str, base: str) -> list[str]:
    parts = [f"c0 AS MATERIALIZED ({base})"]
    keys = group.split(", ")
    same = " AND ".join(f"c.{g} = b.{g}" for g in keys)
    for k in range(n):
        order = f"substr({START}, 1, 8)" if k == 0 else "d DESC"
        parts.append(f"b{k} AS MATERIALIZED (SELECT {group}, img_id FROM c{k} QUALIFY row_number() OVER (PARTITION BY {group} ORDER BY {order}, img_id) = 1)")
        if k < n - 1:
            parts.append(f"c{k + 1} AS MATERIALIZED (SELECT {', '.join('c.' + g for g in keys)}, c.img_id, least(c.d, 1 - y.s) AS d FROM c{k} c JOIN b{k} b ON {same} AND c.img_id <> b.img_id JOIN sym y ON y.scene = c.scene AND y.i = c.img_id AND y.j = b.img_id)")
    return parts


@query("farthest_point_coreset", f"WITH {SIM}, {SYM}, " + ", ".join(_fps_parts(4, "scene", "SELECT scene, img_id, 'inf'::DOUBLE AS d FROM descr"))
       + " " + " UNION ALL ".join(f"SELECT scene, img_id, {k} AS step FROM b{k}" for k in range(4)))
def _(t: Tables) -> DataFrame:
    return selection.coreset_fps(_sim(t), _frames(t), 4)


PAST = ", ".join(_fps_parts(3, "scene, query", "SELECT scene, i AS query, j AS img_id, 'inf'::DOUBLE AS d FROM sim"))


@query("retrieve_coreset_fill", f"""WITH {SIM}, {SYM}, {PAST}, core AS ({' UNION ALL '.join(f'SELECT * FROM b{k}' for k in range(3))}),
a AS (SELECT scene, query, img_id, 0 AS p, img_id::DOUBLE AS o FROM core UNION ALL SELECT scene, i, j, 1, -s FROM sim s WHERE NOT EXISTS (SELECT 1 FROM core c WHERE c.scene = s.scene AND c.query = s.i AND c.img_id = s.j))
SELECT scene, query, img_id FROM a QUALIFY row_number() OVER (PARTITION BY scene, query ORDER BY p, o, img_id) <= 6""")
def _(t: Tables) -> DataFrame:
    return selection.retrieve(_frames(t), _sim(t), "coreset_fps_3", 6)


@query("candidates_outside_coreset", f"""WITH {SIM}, {SYM}, {PAST}, core AS ({' UNION ALL '.join(f'SELECT * FROM b{k}' for k in range(3))})
SELECT scene, i AS query, count(*) AS n FROM sim s WHERE NOT EXISTS (SELECT 1 FROM core c WHERE c.scene = s.scene AND c.query = s.i AND c.img_id = s.j) GROUP BY ALL""")
def _(t: Tables) -> DataFrame:
    sim = _sim(t)
    return selection.outside(selection.coreset_fps_past(sim, 3), sim)


@query("cluster_coreset")
def _(t: Tables) -> DataFrame:
    return selection.coreset_clusters(t.desc(), 4)


@query("ward_coreset")
def _(t: Tables) -> DataFrame:
    return clustering.coreset_hclust(_sim(t), t.desc().select("scene", "img_id"), 8)


@query("retrieve_weighted_sample", f"""WITH {SIM}, h AS (SELECT *, sha256(concat_ws('|', scene, i, j)) AS h FROM sim WHERE s > 0),
u AS (SELECT *, (list_sum([(instr('0123456789abcdef', substr(h, k, 1)) - 1)*pow(16, 8 - k) FOR k IN range(1, 9)]) + 0.5::DOUBLE)/4294967296 AS u FROM h)
SELECT scene, i AS query, j AS img_id FROM u QUALIFY row_number() OVER (PARTITION BY scene, i ORDER BY ln(u)/s DESC, j) <= 5""")
def _(t: Tables) -> DataFrame:
    return selection.weighted_sample(_sim(t), 5)


@query("retrieve_keyframes", f"""WITH {SIM}, n AS (SELECT scene, img_id, (row_number() OVER (PARTITION BY scene ORDER BY img_id) - 1) % 3 = 0 AS key FROM descr),
p AS (SELECT s.*, n.key FROM sim s JOIN n ON s.scene = n.scene AND s.j = n.img_id),
r AS (SELECT *, row_number() OVER (PARTITION BY scene, i, key ORDER BY s DESC, j) AS rn FROM p),
f AS (SELECT scene, i, j FROM r WHERE key AND rn <= 6), g AS (SELECT scene, i, count(*) AS got FROM f GROUP BY ALL)
SELECT scene, i AS query, j AS img_id FROM f UNION ALL SELECT r.scene, r.i, r.j FROM r LEFT JOIN g ON r.scene = g.scene AND r.i = g.i WHERE NOT key AND rn <= 8 - coalesce(got, 0)""")
def _(t: Tables) -> DataFrame:
    return selection.retrieve(_frames(t), _sim(t), "keyframe3-topsim", 8)


@query("retrieve_keyframes_none", f"WITH {SIM} SELECT scene, i AS query, j AS img_id FROM sim")
def _(t: Tables) -> DataFrame:
    return selection.retrieve(_frames(t), _sim(t), "keyframe3-none", 8)


PATCH = "patch AS (SELECT label AS scene, vec_id % 4 AS img_id, vec_id AS patch, embedding::DOUBLE[] AS vec FROM embeddings)"


def _patches(t: Tables) -> DataFrame:
    v = F.col("vec_id")
    return t.read("embeddings").select(F.col("label").alias("scene"), (v % 4).alias("img_id"), v.alias("patch"),
                                       F.col("embedding").cast("array<double>").alias("vec"))


@query("similar_patches", f"""WITH {PATCH}, c AS (SELECT a.scene, a.img_id AS i, b.img_id AS j, a.patch AS a, b.patch AS b,
abs(list_inner_product(a.vec, b.vec)/sqrt(list_inner_product(a.vec, a.vec)*list_inner_product(b.vec, b.vec))) AS s FROM patch a JOIN patch b ON a.scene = b.scene AND a.img_id < b.img_id)
SELECT scene, i, j, a, b, {r6('s', 's')} FROM c WHERE s > 0.2 QUALIFY row_number() OVER (PARTITION BY scene, i, j ORDER BY s DESC, a, b) <= 20""")
def _(t: Tables) -> DataFrame:
    p = _patches(t)
    imgs = p.select("scene", "img_id").distinct()
    pairs = imgs.alias("l").join(imgs.alias("r"), (F.col("l.scene") == F.col("r.scene")) & (F.col("l.img_id") < F.col("r.img_id"))).select(
        "l.scene", F.col("l.img_id").alias("i"), F.col("r.img_id").alias("j"))
    return retrieval.similar_patches(p, pairs, 0.2, 20).select("scene", "i", "j", "a", "b", rnd("s"))


VIEWS = """v AS (SELECT label % 8 AS scene, vec_id AS patch, embedding::DOUBLE[] AS vec FROM embeddings),
w AS (SELECT scene, patch, [((CASE WHEN patch % 2 = 0 THEN 1 ELSE -1 END)*(vec[k] + 0.3*vec[k % len(vec) + 1])) FOR k IN range(1, len(vec) + 1)] AS vec FROM v)"""


@query("similar_patches_hashed", f"""WITH {VIEWS}, c AS (SELECT v.scene, v.patch AS a, w.patch AS b,
abs(list_inner_product(v.vec, w.vec)/sqrt(list_inner_product(v.vec, v.vec)*list_inner_product(w.vec, w.vec))) AS s FROM v JOIN w USING (scene))
SELECT scene, 0 AS i, 1 AS j, a, b, {r6('s', 's')} FROM c WHERE s > 0.8""")
def _(t: Tables) -> DataFrame:
    v = t.read("embeddings").select((F.col("label") % 8).alias("scene"), F.lit(0).alias("img_id"), F.col("vec_id").alias("patch"),
                                    F.col("embedding").cast("array<double>").alias("vec"))
    turned = F.concat(F.slice("vec", 2, F.size("vec") - 1), F.slice("vec", 1, 1))
    sign = F.when(F.col("patch") % 2 == 0, 1.0).otherwise(-1.0)
    w = v.select("scene", F.lit(1).alias("img_id"), "patch", F.zip_with("vec", turned, lambda x, y: sign * (x + 0.3 * y)).alias("vec"))
    pairs = v.select("scene").distinct().select("scene", F.lit(0).alias("i"), F.lit(1).alias("j"))
    return retrieval.similar_patches_hashed(v.unionByName(w), pairs, 0.8).select("scene", "i", "j", "a", "b", rnd("s"))


# the greedy strategies on cosines, from the descriptors alone
def _on_cosines(sql: str) -> str:
    unit = DESC[len("WITH "):] if DESC.startswith("WITH ") else DESC
    sim = ("sim AS MATERIALIZED (SELECT a.scene, a.img_id AS i, b.img_id AS j, round(list_inner_product(a.vec, b.vec)/sqrt(list_inner_product(a.vec, a.vec)*list_inner_product(b.vec, b.vec)), 12) AS s "
           "FROM descr a JOIN descr b ON a.scene = b.scene AND b.img_id < a.img_id)")
    return sql.replace(SIM, f"{unit}, {sim}", 1)


for _kind, _k in (("max", 4), ("avg", 3), ("rmse", 3)):
    query(f"diverse_by_descriptor_{_kind}", _on_cosines(_diverse_sql(_kind, _k)))(
        lambda t, kind=_kind, k=_k: selection.diverse_by_descriptor(t.desc(), k, kind))


@query("farthest_point_by_descriptor", _on_cosines(ORACLES["farthest_point_coreset"]))
def _(t: Tables) -> DataFrame:
    return selection.coreset_fps_by_descriptor(t.desc(), 4)
