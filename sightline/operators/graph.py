"""Match-graph algorithms in logarithmically many rounds of joins; every round ends in a written table.

Edges are ``(scene, i, j, n_matches)`` with i < j. Nothing is collected but one flag per round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.operators.ordered import blocks, neighbour
from sightline.scale import cut

MAX_ROUNDS = 64  # far above log2 of any node count


def _jump(ptr: DataFrame) -> DataFrame:
    """Follow ``root`` pointers to the end by doubling; ``ptr`` is (scene, node, root) without cycles."""
    for _ in range(MAX_ROUNDS):
        up = ptr.select("scene", F.col("node").alias("root"), F.col("root").alias("_r"))
        ptr = cut(ptr.join(up, ["scene", "root"], "left").select(
            "scene", "node", F.coalesce("_r", "root").alias("root"),
            (F.col("_r").isNotNull() & (F.col("_r") != F.col("root"))).alias("_moved")))
        done = ptr.where("_moved").isEmpty()
        ptr = ptr.drop("_moved")
        if done:
            return ptr
    raise RuntimeError("pointer jumping did not end")


def _relabel(edges: DataFrame, roots: DataFrame, ends: tuple[str, str]) -> DataFrame:
    for c in ends:
        r = roots.select("scene", F.col("node").alias(c), F.col("root").alias("_root"))
        edges = edges.join(r, ["scene", c], "left").withColumn(c, F.coalesce("_root", c)).drop("_root")
    return edges.where(F.col(ends[0]) != F.col(ends[1]))


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(scene, node, component) where the component is named by its smallest node.

    Each round points every node to its smallest neighbour, follows the pointers and contracts the
    edges, so the graph shrinks until none are left. ``nodes`` (scene, node) adds isolated nodes.
    """
    e = edges.select("scene", F.col("i").alias("u"), F.col("j").alias("v")).where("u <> v")
    e = cut(e.select("scene", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    label = e.select("scene", F.explode(F.array("u", "v")).alias("node"))
    if nodes is not None:
        label = label.unionByName(nodes.select("scene", "node"))
    label = label.distinct().withColumn("component", F.col("node"))
    for _ in range(MAX_ROUNDS):
        if e.isEmpty():
            return label
        # the smaller end of an edge is stored in u, so the pointer of v is its smallest u
        ptr = e.groupBy("scene", F.col("v").alias("node")).agg(F.min("u").alias("root"))
        roots = _jump(ptr)
        to = roots.select("scene", F.col("node").alias("component"), F.col("root").alias("_root"))
        label = cut(label.join(to, ["scene", "component"], "left").select(
            "scene", "node", F.coalesce("_root", "component").alias("component")))
        e = _relabel(e, roots, ("u", "v"))
        e = cut(e.select("scene", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    raise RuntimeError("components did not converge")


def require_connected(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``edges`` unchanged; raises with sample members when a scene falls into several components."""
    comp = components(edges, nodes)
    split = comp.groupBy("scene").agg(F.countDistinct("component").alias("n")).where("n > 1")
    bad = comp.join(split, "scene").orderBy("scene", "component", "node").limit(20).collect()
    if bad:
        raise ValueError(f"match graph is not connected: {[(r['scene'], r['component'], r['node']) for r in bad]}")
    return edges


def max_spanning_tree(edges: DataFrame) -> DataFrame:
    """Spanning tree (forest) of largest total weight per scene, by Borůvka rounds.

    The order (weight, smaller i, smaller j) is total, so the tree is unique.
    """
    e = edges.select("scene", F.col("i").alias("u"), F.col("j").alias("v"), "i", "j", "n_matches")
    e = cut(e.where("i <> j"))
    order = F.struct(F.col("n_matches"), (-F.col("i")).alias("ni"), (-F.col("j")).alias("nj"))
    tree: DataFrame | None = None
    for _ in range(MAX_ROUNDS):
        if e.isEmpty():
            break
        ends = e.select("scene", F.explode(F.array(F.struct(F.col("u").alias("c"), F.col("v").alias("o")),
                                                   F.struct(F.col("v").alias("c"), F.col("u").alias("o")))).alias("s"),
                        "i", "j", "n_matches").select("scene", "s.c", "s.o", "i", "j", "n_matches")
        best = ends.groupBy("scene", "c").agg(F.max_by(F.struct("o", "i", "j", "n_matches"), order).alias("b"))
        best = cut(best.select("scene", "c", "b.*"))
        chosen = best.select("scene", "i", "j", "n_matches").distinct()
        tree = chosen if tree is None else tree.unionByName(chosen)
        # two components may choose each other: the smaller one becomes the root
        back = best.select("scene", F.col("c").alias("o"), F.col("o").alias("_back"))
        ptr = best.join(back, ["scene", "o"], "left").select(
            "scene", F.col("c").alias("node"),
            F.when((F.col("_back") == F.col("c")) & (F.col("c") < F.col("o")), F.col("c")).otherwise(F.col("o")).alias("root"))
        e = _relabel(e, _jump(ptr), ("u", "v"))
        e = (e.select("scene", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "i", "j", "n_matches")
             .groupBy("scene", "u", "v").agg(F.max_by(F.struct("i", "j", "n_matches"), order).alias("b"))
             .select("scene", "u", "v", "b.*"))
        e = cut(e)
    else:
        raise RuntimeError("the spanning tree did not end")
    if tree is None:
        return edges.select("scene", "i", "j", "n_matches").limit(0)
    return tree.distinct()


def root_tree(tree: DataFrame, roots: DataFrame) -> DataFrame:
    """(scene, node, parent) of a tree hung from one root per scene.

    An Euler tour turns the tree into a list of directed edges; list ranking by pointer doubling gives
    each edge its distance to the end of the tour, and an edge walked before its reverse leads away from
    the root. Rounds grow with the logarithm of the tree size, not with its depth. Of a forest only the trees that
    hold a root are hung: the tour of another has no end, and its nodes no parent.
    """
    named = components(tree)
    hung = named.join(roots.select("scene", "node"), ["scene", "node"], "left_semi").select("scene", "component")
    hung = named.join(hung, ["scene", "component"], "left_semi").select("scene", F.col("node").alias("u"))
    arcs = tree.select("scene", F.explode(F.array(F.struct(F.col("i").alias("u"), F.col("j").alias("v")),
                                                  F.struct(F.col("j").alias("u"), F.col("i").alias("v")))).alias("a"))
    arcs = cut(arcs.select("scene", "a.u", "a.v").join(hung, ["scene", "u"], "left_semi"))
    # the arc after (u, v) leaves v towards the neighbour of v that follows u, in circular order
    ring = neighbour(blocks(arcs, ["scene", "u"], ["v"]), {"follow": F.col("v")}, reverse=True)
    first = arcs.groupBy("scene", "u").agg(F.min("v").alias("_first"))
    ring = ring.join(first, ["scene", "u"])
    ring = ring.join(roots.select("scene", F.col("node").alias("u"), F.lit(True).alias("_root")), ["scene", "u"], "left")
    # the tour ends where it would leave the root for its first neighbour again
    ring = ring.select("scene", F.col("v").alias("u"), F.col("u").alias("v"), F.col("u").alias("nu"),
                       F.when(F.col("follow").isNotNull(), F.col("follow"))
                       .when(F.coalesce("_root", F.lit(False)), F.lit(None)).otherwise(F.col("_first")).alias("nv"))
    rank = cut(ring.select("scene", "u", "v", F.when(F.col("nv").isNotNull(), F.col("nu")).alias("nu"), "nv",
                           F.when(F.col("nv").isNotNull(), F.lit(1)).otherwise(F.lit(0)).cast("long").alias("d")))
    for _ in range(MAX_ROUNDS):
        if rank.where("nv is not null").isEmpty():
            break
        nxt = rank.select("scene", F.col("u").alias("nu"), F.col("v").alias("nv"), F.col("nu").alias("_nu"),
                          F.col("nv").alias("_nv"), F.col("d").alias("_d"))
        rank = cut(rank.join(nxt, ["scene", "nu", "nv"], "left").select(
            "scene", "u", "v", F.col("_nu").alias("nu"), F.col("_nv").alias("nv"),
            (F.col("d") + F.coalesce("_d", F.lit(0))).alias("d")))
    else:
        raise ValueError("the edges hold a cycle, so they are no tree")
    rev = rank.select("scene", F.col("v").alias("u"), F.col("u").alias("v"), F.col("d").alias("_rd"))
    down = rank.join(rev, ["scene", "u", "v"]).where(F.col("d") > F.col("_rd"))
    return down.select("scene", F.col("v").alias("node"), F.col("u").alias("parent"))


def _compose(outer: str, inner: str) -> list[Column]:
    """Similarity x ↦ s·R·x + t of ``outer`` after ``inner``, as scale, rotation, translation."""
    so, si = F.col(f"{outer}s"), F.col(f"{inner}s")
    ro, ri = ([F.col(f"{p}r")[k] for k in range(9)] for p in (outer, inner))
    to, ti = ([F.col(f"{p}t")[k] for k in range(3)] for p in (outer, inner))
    r = F.array(*[sum((ro[3 * i + k] * ri[3 * k + j] for k in (1, 2)), ro[3 * i] * ri[j]) for i in range(3) for j in range(3)])
    t = F.array(*[so * sum((ro[3 * i + k] * ti[k] for k in (1, 2)), ro[3 * i] * ti[0]) + to[i] for i in range(3)])
    return [so * si, r, t]


def propagate(parents: DataFrame, rel: DataFrame, roots: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """World pose and scale of every node of a rooted tree: (scene, node, s, r, t) camera to world.

    ``rel`` holds (scene, i, j, s, r, t) with ``x_i = s·R·x_j + t`` for parent i and child j. A root
    (scene, node) stands at identity with scale 1. Pointer doubling composes whole paths, so a chain of
    n frames takes log2 n rounds. ``known`` (scene, node, r, t) overrides the pose of listed nodes: they
    keep the scale that reaches them, and nodes below continue from the known pose.
    """
    rel = rel.select("scene", F.col("i").alias("parent"), F.col("j").alias("node"), "s", "r", "t")
    steps = parents.join(rel, ["scene", "parent", "node"])
    one = [F.lit(1.0).alias("s"), F.array(*[F.lit(float(k % 4 == 0)) for k in range(9)]).alias("r"),
           F.array(*[F.lit(0.0)] * 3).alias("t")]
    top = roots.select("scene", F.lit(None).cast("long").alias("parent"), F.col("node").cast("long"), *one)
    steps = steps.select("scene", F.col("parent").cast("long"), F.col("node").cast("long"), "s", "r", "t").unionByName(top)
    scale = cut(_double(steps))
    if known is None:
        return scale.select("scene", "node", "s", "r", "t")
    # restart poses at known nodes: the scale above them is needed as a unit change of their children
    pinned = known.select("scene", "node", F.col("r").alias("_kr"), F.col("t").alias("_kt"))
    s = scale.select("scene", "node", F.col("s").alias("_abs"))
    up = s.withColumnRenamed("node", "parent").withColumnRenamed("_abs", "_ps")
    rigid = steps.drop("s").join(s, ["scene", "node"]).join(up, ["scene", "parent"], "left")
    rigid = rigid.join(pinned, ["scene", "node"], "left").select(
        "scene", F.when(F.col("_kr").isNull(), F.col("parent")).alias("parent"), "node", F.lit(1.0).alias("s"),
        F.coalesce("_kr", "r").alias("r"),
        F.coalesce("_kt", F.transform("t", lambda c: c * F.coalesce("_ps", F.lit(1.0)))).alias("t"))
    poses = _double(cut(rigid)).select("scene", "node", "r", "t")
    return poses.join(s.select("scene", "node", F.col("_abs").alias("s")), ["scene", "node"]).select("scene", "node", "s", "r", "t")


def _double(steps: DataFrame) -> DataFrame:
    """Compose steps towards the parent until no parent is left."""
    cur = cut(steps)
    for _ in range(MAX_ROUNDS):
        if cur.where("parent is not null").isEmpty():
            return cur
        up = cur.select("scene", F.col("node").alias("parent"), F.col("parent").alias("_pp"),
                        F.col("s").alias("o_s"), F.col("r").alias("o_r"), F.col("t").alias("o_t"))
        both = cur.select("scene", "node", "parent", F.col("s").alias("i_s"), F.col("r").alias("i_r"), F.col("t").alias("i_t"))
        both = both.join(up, ["scene", "parent"], "left")
        s, r, t = _compose("o_", "i_")
        has = F.col("o_s").isNotNull()
        cur = cut(both.select("scene", F.col("_pp").alias("parent"), "node", F.when(has, s).otherwise(F.col("i_s")).alias("s"),
                              F.when(has, r).otherwise(F.col("i_r")).alias("r"), F.when(has, t).otherwise(F.col("i_t")).alias("t")))
    raise RuntimeError("propagation did not end: the parents form a cycle")
