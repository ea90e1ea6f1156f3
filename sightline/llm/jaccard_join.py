"""All links of Jaccard similarity 0.75 or more between documents' word shingles, by signature trees.

Texts with the same words are one node from the start. The rest is exact in two passes over what nodes share:

* Shingles have one order for all: those in a bounded list of frequent ones last, all others by hash. Two linked nodes
  share at least ``OVERLAP`` shingles (all that they must share, if that is fewer) among the first quarter plus
  ``OVERLAP`` of each, so only these prefixes are shuffled; those alike in size share them still earlier. A frequent shingle's nodes are spread over salts.
* First pass: the nodes of a shingle propose to the node before them in order of size and to a few hubs, the nodes
  with the least hashes in parts of the group; of a node's proposals the ``PROPOSALS`` that rest on most shingles are verified exactly. What
  links becomes a branch of the tree, so that a group of near copies, however large, is a branch or few from then on
  and never yields all its pairs.
* Second pass: a tree's branch holds the OR of its leaves' bitmaps and the range of their sizes. Branches that share
  enough prefix shingles are traversed together: a pair of branches is dropped where sizes or the largest possible
  overlap rule a link out, the others are opened to pairs of leaves. The likeliest are verified exactly, and branches
  that link are one. All other leaf pairs of branches still apart are pruned by their own bitmaps and sizes and
  verified: between different classes, every pair that could link is seen.

Classes need no more than that. ``links`` gives the join itself: every link lies within a class, so the nodes of each class
are put in order of size and cut into blocks of ``BLOCK``, the upper nodes of a tree with OR-combined bitmaps and size
ranges. Pairs of blocks that a link is not ruled out for are opened to pairs of leaves, which are pruned in the same way and
verified exactly, whether or not they are connected already. A class of n texts that all link has n * (n - 1) / 2 links.

Null and empty texts have no shingles and link with nothing, themselves included. A text of fewer words than a shingle
is one shingle. Rows with equal ids are texts of their own; rows with null ids take part, but do not name a class; a class of
null ids alone has a null name. An empty table gives an empty result. Shingles and word sequences are told apart by
64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm import hashing
from sightline.llm.common import batches, cut, map_arrow, pick, text_hash
from sightline.operators.graph import components
from sightline.operators.ordered import row_number
from sightline.scale import broadcast_if_small

SHINGLE = 5
OVERLAP = 4
#: The list of frequent shingles: at most so many, seen in at least so many texts. Any list gives right results.
FREQUENT = 1 << 17
FREQUENT_LEAST = 64
SALT_ROWS = 8192
BITMAP_LONGS = 32
HUBS = (1, 6, 36)
PROPOSALS = 3
#: Leaves of a branch that are tried before all others.
FIRST = 6
#: Leaves of an upper node where all links of a class are followed.
BLOCK = 64
NODES = "doc_id long, text_hash long, node long, n int, token long, times long"


def _texts(rows: Iterator) -> Iterator[tuple[list, list]]:
    """(other columns of a row, text) in small lists; the text is the last column."""
    for b in rows:
        texts = b.column(b.num_columns - 1)
        for lo, hi in batches(texts, 4 << 20):
            part = b.slice(lo, hi - lo)
            yield [c.to_pylist() for c in part.columns[:-1]], part.columns[-1].to_pylist()


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _describe(rows: Iterator, size: int) -> Iterator:
    """A row per document, then the shingles that many texts of this task hold."""
    import pyarrow as pa

    seen: set[int] = set()
    counts: dict[int, int] = {}
    held: list[np.ndarray] = []
    waiting = 0

    def count() -> None:
        tokens, times = np.unique(np.concatenate(held) if held else np.empty(0, np.uint64), return_counts=True)
        for t, k in zip(_signed(tokens[times >= 3]).tolist(), times[times >= 3].tolist(), strict=True):
            counts[t] = counts.get(t, 0) + k
        held.clear()

    for (ids, hashes), texts in _texts(rows):
        nodes, sizes = [], []
        for text in texts:
            w, tokens = hashing.shingles(text, size)
            nodes.append(hashing.sequence(w) if len(w) else None)
            sizes.append(len(tokens))
            if len(w) and nodes[-1] not in seen:
                seen.add(nodes[-1])
                held.append(tokens)
                waiting += len(tokens)
                if waiting > 1 << 20:
                    count()
                    waiting = 0
        n = len(ids)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()),
                                          pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names=["doc_id", "text_hash", "node", "n", "token", "times"])
    count()
    n = len(counts)
    none = pa.nulls(n, pa.int64())
    yield pa.RecordBatch.from_arrays([none, none, none, pa.nulls(n, pa.int32()), pa.array(list(counts), pa.int64()),
                                      pa.array(list(counts.values()), pa.int64())], names=["doc_id", "text_hash", "node", "n", "token", "times"])


def _prefixes(rows: Iterator, size: int, frequent) -> Iterator:
    """(token, salt, salts, node, n, at) of the prefix of every different text; ``at`` is the place in the order."""
    import pyarrow as pa

    known, times = frequent.value
    names = ["token", "salt", "salts", "node", "n", "at"]
    seen: set[int] = set()
    for (), texts in _texts(rows):
        out: list[list[np.ndarray]] = [[] for _ in names]
        for text in texts:
            w, tokens = hashing.shingles(text, size)
            if not len(w) or (node := hashing.sequence(w)) in seen:
                continue
            seen.add(node)
            at = np.minimum(np.searchsorted(known, tokens), max(0, len(known) - 1))
            hot = known[at] == tokens if len(known) else np.zeros(len(tokens), bool)
            salts = np.where(hot, 1 + times[at] // SALT_ROWS, 1) if len(known) else np.ones(len(tokens), np.int64)
            first = np.argsort(hot, kind="stable")[:len(tokens) // 4 + OVERLAP]
            k, salts = len(first), salts[first]
            for c, x in zip(out, (_signed(tokens[first]), (np.int64(node) % salts).astype(np.int32), salts.astype(np.int32), np.full(k, node), np.full(k, len(tokens), np.int32),
                                np.arange(k, dtype=np.int32)), strict=True):
                c.append(x)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=names)


def _bitmap(tokens: np.ndarray) -> tuple[np.ndarray, int]:
    """The bitmap of a set and how many of its tokens share a bit with another."""
    bits = np.zeros(64 * BITMAP_LONGS, np.uint8)
    bits[(tokens >> np.uint64(20)) % np.uint64(64 * BITMAP_LONGS)] = 1
    return np.packbits(bits).view(np.int64), len(tokens) - int(bits.sum())


def _leaves(rows: Iterator, size: int) -> Iterator:
    """(node, n, extra, bits, tokens) of the texts asked for; ``extra`` tokens share a bit with others."""
    import pyarrow as pa

    seen: set[int] = set()
    schema = pa.schema([("node", pa.int64()), ("n", pa.int32()), ("extra", pa.int32()), ("bits", pa.list_(pa.int64())), ("tokens", pa.binary())])
    for (wanted,), texts in _texts(rows):
        out = []
        for want, text in zip(wanted, texts, strict=True):
            w, tokens = hashing.shingles(text, size)
            if not len(w) or want not in (None, node := hashing.sequence(w)) or node in seen:
                continue
            seen.add(node)
            bits, extra = _bitmap(tokens)
            out.append((node, len(tokens), extra, bits, tokens.tobytes()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def _overlaps(rows: Iterator) -> Iterator:
    """(a, b, common, total) of pairs of token sets."""
    import pyarrow as pa

    for batch in rows:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            common, total = [], []
            for x, y in zip(part.column(2), part.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common.append(len(np.intersect1d(x, y, assume_unique=True)))
                total.append(len(x) + len(y) - common[-1])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(common, pa.int64()), pa.array(total, pa.int64())],
                                             names=["a", "b", "common", "total"])


class JaccardJoin:
    """One join over one table: ``classes`` names the connected ones, ``links`` are the links themselves.

    ``members`` (doc_id, text_hash, node, n) tells which documents a node stands for, once either was called.
    """

    def __init__(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 75, size: int = SHINGLE) -> None:
        if percent != 75:
            raise ValueError("prefixes are made for 75 percent")
        self.docs, self.size, self.percent = pick(docs, doc_id=doc_id, text=text), size, percent
        self.spark = docs.sparkSession

    def _nodes(self) -> None:
        hashed = self.docs.select("doc_id", text_hash("text").alias("text_hash"), "text")
        described = cut(map_arrow(hashed, partial(_describe, size=self.size), NODES))
        self.members = described.where("token IS NULL").select("doc_id", "text_hash", "node", "n")
        self.nodes = cut(self.members.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("name"), F.max("n").alias("n")))
        hot = described.where("token IS NOT NULL").groupBy("token").agg(F.sum("times").alias("times")).where(F.col("times") >= FREQUENT_LEAST)
        rows = hot.orderBy(F.desc("times"), "token").limit(FREQUENT).collect()
        tokens, times = (np.array([r[k] for r in rows], np.int64) for k in ("token", "times"))
        order = np.argsort(tokens.view(np.uint64))
        self.frequent = self.spark.sparkContext.broadcast((tokens.view(np.uint64)[order], times[order]))

    def _shared(self) -> DataFrame:
        """(token, node, before): prefix rows of shingles that several nodes have, with the node before in order of size."""
        rows = map_arrow(self.docs.select("text"), partial(_prefixes, size=self.size, frequent=self.frequent),
                                                   "token long, salt int, salts int, node long, n int, at int")
        group = Window.partitionBy("token", "salt")
        order = group.orderBy("n", "node")
        rows = rows.withColumn("before", F.lag("node").over(order)).withColumn("before_n", F.lag("n").over(order))
        rows = rows.withColumn("several", (F.min("node").over(group) < F.max("node").over(group)) | (F.col("salts") > 1))
        rows = rows.where(F.col("several") & (F.col("before").isNull() | (F.col("before") != F.col("node"))))
        fits = 100 * F.col("before_n") >= self.percent * F.col("n")
        return cut(rows.select("token", "node", "n", "at", F.when(fits, F.col("before")).alias("before")))

    def _proposals(self, shared: DataFrame) -> DataFrame:
        """Pairs (a, b) of nodes that are likely to link; which ones only decides how much is left to the second pass."""
        met = shared.select(F.col("node").alias("a"), F.col("before").alias("b"))
        for parts in HUBS:  # one unlucky hub must not fail a whole group, so the larger a group, the more hubs it has
            parted = shared.select("token", "node", F.pmod(F.xxhash64(F.lit(parts), "node"), F.lit(parts)).alias("part"))
            hubs = parted.groupBy("token", "part").agg(F.min_by("node", F.xxhash64("node")).alias("b"))
            met = met.unionAll(parted.join(hubs, ["token", "part"]).select(F.col("node").alias("a"), "b"))
        met = met.where("a <> b").groupBy("a", "b").count().where(F.col("count") >= OVERLAP)
        place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("count"), "b"))
        return cut(met.withColumn("place", place).where(F.col("place") <= PROPOSALS).select("a", "b"))

    def _leaves(self, nodes: DataFrame) -> DataFrame:
        """Bitmaps and shingles of some nodes, taken from their texts."""
        wanted = cut(nodes.distinct().join(self.nodes, "node").select("node", F.col("name").alias("of")))
        named = self.docs.join(broadcast_if_small(wanted.where("of IS NOT NULL"), 32), F.col("doc_id") == F.col("of")).select("node", "text")
        unnamed = self.docs.where("doc_id IS NULL").select(F.lit(None).cast("long").alias("node"), "text")
        rows = named if wanted.where("of IS NULL").isEmpty() else named.unionAll(unnamed)
        return cut(map_arrow(rows, partial(_leaves, size=self.size), "node long, n int, extra int, bits array<long>, tokens binary"))

    def _verified(self, pairs: DataFrame, leaves: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that link."""
        of = lambda c: leaves.select(F.col("node").alias(c), F.col("tokens").alias(f"tokens_{c}"))
        both = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "tokens_a", "tokens_b")
        return map_arrow(both, _overlaps, "a long, b long, common long, total long").where(F.col("common") * 100 >= F.col("total") * self.percent)

    def _branches(self, links: DataFrame) -> DataFrame:
        """(node, branch) of the nodes that have links."""
        edges = links.select(F.lit(0).alias("scene"), F.col("a").alias("i"), F.col("b").alias("j"))
        return components(edges).select("node", F.col("component").alias("branch"))

    def _need(self) -> Column:
        """Shingles that a linked pair of at least these sizes shares among those that ``_early`` lets through."""
        return F.least(F.lit(OVERLAP), F.ceil(F.greatest("a_least", "b_least") * self.percent / 100))

    def _early(self) -> Column:
        """Whether a shared shingle is so early in both orders that it counts.

        A linked pair shares at least ``overlap`` shingles. The OVERLAP first of those are followed by all others, so they lie
        among the first n - overlap + OVERLAP of either set.
        """
        overlap = F.ceil((F.col("a_least") + F.col("b_least")) * self.percent / (100 + self.percent))
        early = lambda x: F.col(f"{x}_at") < F.col(f"{x}_most") - overlap + OVERLAP
        return early("a") & early("b")

    def _fit(self, a: str, b: str) -> Column:
        return (100 * F.col(f"{a}_most") >= self.percent * F.col(f"{b}_least")) & (100 * F.col(f"{b}_most") >= self.percent * F.col(f"{a}_least"))

    def _possible(self) -> Column:
        """Whether the largest possible overlap of a_bits and b_bits, within their sizes, still makes a link."""
        common = sum((F.bit_count(F.get("a_bits", k).bitwiseAND(F.get("b_bits", k))) for k in range(BITMAP_LONGS)), F.lit(0))
        most = common + F.least("a_extra", "b_extra")
        return most * (100 + self.percent) >= self.percent * (F.col("a_least") + F.col("b_least"))

    def _second_pass(self, shared: DataFrame, branches: DataFrame) -> DataFrame:
        """Links between nodes of different branches."""
        rows = shared.select("token", "node", "n", "at").join(branches, "node", "left").withColumn("branch", F.coalesce("branch", "node"))
        tree = cut(rows.groupBy("token", "branch").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("at").alias("at")))
        side = lambda t, x: t.select("token", *[F.col(c).alias(f"{x}_{c}") for c in t.columns if c != "token"])
        met = side(tree, "a").join(side(tree, "b"), "token").where((F.col("a_branch") < F.col("b_branch")) & self._fit("a", "b") & self._early())
        met = met.groupBy("a_branch", "b_branch").agg(F.count("*").alias("shared"), F.min("a_least").alias("a_least"), F.min("b_least").alias("b_least"))
        met = cut(met.where(F.col("shared") >= self._need()).select("a_branch", "b_branch"))

        ends = met.select(F.explode(F.array("a_branch", "b_branch")).alias("branch")).distinct()
        inside = cut(self.nodes.select("node").join(branches, "node", "left").select("node", F.coalesce("branch", "node").alias("branch")).join(ends, "branch", "left_semi"))
        leaves = self._leaves(inside.select("node"))
        marked = cut(leaves.select("node", "n", "extra", "bits").join(inside, "node"))
        tops = marked.groupBy("branch").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("extra").alias("extra"),
                                            F.array(*[F.bit_or(F.get("bits", k)) for k in range(BITMAP_LONGS)]).alias("bits"))
        named = lambda t, x: t.select(*[F.col(c).alias(f"{x}_{c}") for c in t.columns])
        open_pairs = cut(met.join(named(tops, "a"), "a_branch").join(named(tops, "b"), "b_branch").where(self._fit("a", "b") & self._possible())
                         .select("a_branch", "b_branch"))

        # The branches that stay are opened, the smaller of two first. A few leaves of each are tried before all others: where
        # one pair links, the branches are one, and no other pair of theirs matters.
        place = F.row_number().over(Window.partitionBy("branch").orderBy(F.xxhash64("node")))
        few = marked.select("branch", "node").withColumn("place", place).where(F.col("place") <= FIRST).drop("place")
        counts = inside.groupBy("branch").agg(F.count("*").alias("leaves"))
        sized = open_pairs.join(named(counts, "a"), "a_branch").join(named(counts, "b"), "b_branch")
        swap = F.col("a_leaves") > F.col("b_leaves")
        sized = cut(sized.select(F.when(swap, F.col("b_branch")).otherwise(F.col("a_branch")).alias("a_branch"),
                                 F.when(swap, F.col("a_branch")).otherwise(F.col("b_branch")).alias("b_branch")))
        links = cut(self._verified(self._open(sized, marked.join(few, ["branch", "node"], "left_semi")), leaves).select("a", "b"))
        joined = links.join(named(inside, "i").select(F.col("i_node").alias("a"), F.col("i_branch").alias("i")), "a").join(
            named(inside, "j").select(F.col("j_node").alias("b"), F.col("j_branch").alias("j")), "b")
        now = cut(components(joined.select(F.lit(0).alias("scene"), "i", "j").distinct()).select(F.col("node").alias("branch"), "component"))
        apart = sized.join(named(now, "a"), "a_branch", "left").join(named(now, "b"), "b_branch", "left").where(
            F.coalesce("a_component", "a_branch") != F.coalesce("b_component", "b_branch")).select("a_branch", "b_branch")
        return links.unionAll(self._verified(self._open(apart, marked), leaves).select("a", "b"))

    def _open(self, pairs: DataFrame, leaves: DataFrame, within: bool = False) -> DataFrame:
        """Pairs (a, b) of leaves of pairs of branches that sizes and bitmaps don't rule out; ``within`` also pairs a branch with itself."""
        side = lambda x: leaves.select(*[F.col(c).alias(f"{x}_{n}") for c, n in (
            ("branch", "branch"), ("node", "node"), ("n", "least"), ("n", "most"), ("extra", "extra"), ("bits", "bits"))])
        met = pairs.join(side("a"), "a_branch").join(side("b"), "b_branch").where(self._fit("a", "b") & self._possible())
        if within:
            met = met.where((F.col("a_branch") != F.col("b_branch")) | (F.col("a_node") < F.col("b_node")))
        return cut(met.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")))

    def _classed(self) -> DataFrame:
        """(doc_id, text_hash, node, n, branch, component_id) of every document; ``final`` has the nodes that link."""
        self._nodes()
        shared = self._shared()
        best = self._proposals(shared)
        links = cut(self._verified(best, self._leaves(best.select(F.explode(F.array("a", "b")).alias("node")))).select("a", "b"))
        branches = cut(self._branches(links))
        more = cut(self._second_pass(shared, branches).select("a", "b"))
        self.final = branches if more.isEmpty() else self._branches(links.unionAll(more))
        named = self.nodes.join(self.final, "node", "left").select("node", "name", F.coalesce("branch", "node").alias("branch"))
        names = named.groupBy("branch").agg(F.min("name").alias("component_id"))
        return self.members.join(named.join(names, "branch").select("node", "branch", "component_id"), "node", "left")

    def classes(self) -> DataFrame:
        """doc_id, n_shingles, component_id of every document."""
        return self._classed().select("doc_id", F.col("n").cast("long").alias("n_shingles"),
                                      F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))

    def links(self) -> DataFrame:
        """a, b, common, total of every link between different nodes, a < b; ``members`` has the documents of a node."""
        self._classed()
        final = cut(self.final)
        leaves = self._leaves(final.select("node"))
        placed = row_number(leaves.select("node", "n", "extra", "bits").join(final, "node"), ["branch"], ["n", "node"], "place")
        block = F.concat_ws("/", "branch", F.floor((F.col("place") - 1) / BLOCK))
        marked = cut(placed.select("node", "n", "extra", "bits", F.col("branch").alias("class"), block.alias("branch")))
        tops = cut(marked.groupBy("class", "branch").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("extra").alias("extra"),
                                                         F.array(*[F.bit_or(F.get("bits", k)) for k in range(BITMAP_LONGS)]).alias("bits")))
        side = lambda x: tops.select("class", *[F.col(c).alias(f"{x}_{c}") for c in tops.columns if c != "class"])
        met = side("a").join(side("b"), "class").where((F.col("a_branch") <= F.col("b_branch")) & self._fit("a", "b") & self._possible())
        opened = self._open(cut(met.select("a_branch", "b_branch")), marked, within=True)
        return self._verified(opened.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), leaves)

    def link_counts(self) -> DataFrame:
        """doc_id, text_hash, n_shingles, n_links: how many other documents each document links with, those of equal words included."""
        links = cut(self.links())
        times = self.members.where("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("times"))
        both = links.select(F.col("a").alias("of"), F.col("b").alias("node")).unionAll(links.select(F.col("b").alias("of"), F.col("a").alias("node")))
        more = both.join(times, "node").groupBy(F.col("of").alias("node")).agg(F.sum("times").alias("more"))
        counted = times.join(more, "node", "left").select("node", (F.col("times") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"))
        return self.members.join(counted, "node", "left").select("doc_id", "text_hash", F.col("n").cast("long").alias("n_shingles"),
                                                                 F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def link_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    return JaccardJoin(docs, doc_id, text).classes()


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", each_text: bool = False) -> DataFrame:
    """One document of each class, the one whose id names it.

    Rows without id and texts without words stay. Rows that share an id are one document; the first text in order stays.
    With ``each_text`` rows are documents of their own, named by id and text, also where they share an id or have none: one
    row of each class stays, of those with the smallest id, and different texts of an id stay unless they are near copies.
    """
    if each_text:
        return _one_row_of_each_class(docs, doc_id, text)
    found = link_classes(docs, doc_id, text)
    gone = cut(found.where("doc_id IS NOT NULL AND n_shingles > 0 AND doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct())
    kept = docs.join(broadcast_if_small(gone, 16), F.col(doc_id) == F.col("_gone"), "left_anti")
    same = cut(found.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy(F.col("doc_id").alias("_same")).count().where("count > 1").select("_same"))
    if same.isEmpty():
        return kept
    twice = F.col(doc_id) == F.col("_same")
    first = kept.join(same, twice, "left_semi").withColumn("_place", F.row_number().over(Window.partitionBy(doc_id).orderBy(text))).where("_place = 1").drop("_place")
    return kept.join(same, twice, "left_anti").unionAll(first)


def _one_row_of_each_class(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    known = JaccardJoin(docs, doc_id, text)._classed().where("node IS NOT NULL")
    known = cut(known.groupBy("branch", "doc_id", "text_hash").agg(F.count("*").alias("times")))
    name = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    first = known.groupBy("branch").agg(F.min(name).alias("first"))
    of = known.join(first, "branch").select("doc_id", F.col("text_hash").alias("_hash"), "times", (name == F.col("first")).alias("stays"))
    of = cut(of.where("NOT stays OR times > 1").withColumnRenamed("doc_id", "_of"))
    same = F.col(doc_id).eqNullSafe(F.col("_of")) & (text_hash(text) == F.col("_hash"))
    kept = docs.join(broadcast_if_small(of.where("NOT stays").select("_of", "_hash")), same, "left_anti")
    twice = of.where("stays").select("_of", "_hash")
    if twice.isEmpty():
        return kept
    twice = broadcast_if_small(twice)
    place = F.row_number().over(Window.partitionBy(doc_id, "_text_hash").orderBy(F.xxhash64(*docs.columns)))
    one = kept.join(twice, same, "left_semi").withColumn("_text_hash", text_hash(text)).withColumn("_place", place).where("_place = 1")
    return kept.join(twice, same, "left_anti").unionAll(one.select(*docs.columns))
