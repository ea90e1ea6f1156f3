"""Prefix trie of conversations by truncation peeling.

A node is a different sequence of first turns; its members are the conversations that begin with it. Work goes from the
deepest level up: the conversations that end at a level join the nodes that survived from below, equal prefixes are
grouped into one node, the node's figures are final with that, its last turn is stripped, and what is left is a child's
share in the level above. Nodes are discovered and summed up in the same step, and each is touched once.

A level is one ``groupBy`` with map-side combine, so a first turn that a third of all conversations share is a row per
task. Below ``LEVELS`` deep, a range of levels is peeled in one step where nothing can merge in it: rows that have the
prefix at its upper end for themselves give all their nodes at once, and only the others go on with half the range.
So the number of steps follows the depths at which conversations part, not the longest conversation.

A prefix is named by a chain of 128-bit hashes of its turns (role and text); texts are read once and never moved. A
conversation's chain, 24 bytes a turn, is held in one row. The list of members that end at a node is hashed as a stream of ids in
order, in constant memory.

Rows without conversation id belong to no conversation and are left out. Null roles and texts are empty, a null turn
number comes first, turns with the same number stand in order of the hash of role and text, repeated rows are turns of
their own. An empty table has no node. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import cut, fresh_folder, join_counted, map_arrow, pick, text_or_empty

#: Levels that are peeled one by one.
LEVELS = 8
#: Rebuilding: conversations of a family share its first one's turns, fewer than ``SHARED``.
FAMILY, SHARED = 5, 9
CHAIN = "array<struct<key: binary, upto: bigint>>"
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turn_lists(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns): the turns of a conversation in order, each as its hash and the bytes of its text."""
    t = pick(turns, conv_id=conv_id, turn=turn, role=role, text=text).where("conv_id IS NOT NULL")
    said = F.concat(F.octet_length(text_or_empty("role")).cast("string"), F.lit(":"), text_or_empty("role"), text_or_empty("text"))
    t = t.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.substring(F.unhex(F.sha2(said, 256)), 1, 16).alias("id"),
                 F.octet_length(text_or_empty("text")).cast("long").alias("b"))
    return t.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "id", "b"))), lambda x: F.struct(x["id"].alias("id"), x["b"].alias("b"))).alias("turns"))


def rebuilt(lists: DataFrame) -> DataFrame:
    """Conversation c begins with the first h turns of the first of its family, then goes on with its own behind its first h."""
    lists = cut(lists)
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).cast("int")
    head = lists.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("first"), F.slice("turns", 1, SHARED - 1).alias("head"))
    own = lists.select("conv_id", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("first"), "turns", h.alias("h"))
    begin = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), F.col("h"))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return own.join(head, "first", "left").select("conv_id", F.concat(begin, rest).alias("turns"))


def _chains(rows: Iterator) -> Iterator:
    """Names all prefixes of each conversation: the hash of the prefix before and the turn, and the bytes so far."""
    import pyarrow as pa

    kind = pa.list_(pa.struct([("key", pa.binary()), ("upto", pa.int64())]))
    for b in rows:
        out = []
        for turns in b.column(1).to_pylist():
            key, upto, chain = b"", 0, []
            for t in turns:
                key = hashlib.blake2b(key + t["id"], digest_size=16).digest()
                upto += t["b"]
                chain.append({"key": key, "upto": upto})
            out.append(chain)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, kind)], names=["conv_id", "chain"])


def _end_lists(rows: Iterator) -> Iterator:
    """SHA-256 of the ids of each key, which come in order; one hash is open at a time."""
    import pyarrow as pa

    def out(done: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([h for _, h in done], pa.string())], names=["key", "ends_sha256"])

    key, open_ = None, None
    for b in rows:
        done = []
        for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if k == key:
                open_.update(b",%d" % c)
                continue
            if key is not None:
                done.append((key, open_.hexdigest()))
            key, open_ = k, hashlib.sha256(b"%d" % c)
        yield out(done)
    if key is not None:
        yield out([(key, open_.hexdigest())])


def _depth() -> Column:
    return F.size("chain")


def _key(at: Column) -> Column:
    """Name of the prefix of ``at`` turns; the root has an empty one."""
    return F.when(at > 0, F.get("chain", at - 1)["key"]).otherwise(F.lit(b""))


def _upto(at: Column) -> Column:
    return F.when(at > 0, F.get("chain", at - 1)["upto"]).otherwise(F.lit(0).cast("long"))


class _Peeling:
    """Nodes under work: chain, conv (smallest member), n (members), and of children seen so far kids, leaves, saved."""

    def __init__(self, spark) -> None:
        self.spark, self.folder, self.parts = spark, fresh_folder(spark, "trie"), []

    def _write(self, nodes: DataFrame) -> DataFrame:
        nodes.write.parquet(path := f"{self.folder}/{len(self.parts)}")
        self.parts.append(path)
        return self.spark.read.schema(nodes.schema).parquet(path)

    def nodes(self) -> DataFrame:
        return self.spark.read.parquet(*self.parts).drop("chain")

    def level(self, rows: DataFrame, depth: int) -> DataFrame:
        """Group the rows of one depth into nodes; what they add to the level above."""
        at = F.lit(depth)
        merged = rows.groupBy("chain").agg(F.min("conv").alias("conv"), *[F.sum(c).alias(c) for c in ("n", "kids", "leaves", "saved")])
        nodes = self._write(merged.select(
            at.alias("depth"), _key(at).alias("key"), (_key(at - 1) if depth else F.lit(None).cast("binary")).alias("parent"), "conv", "n", "kids",
            F.when(F.col("kids") == 0, 1).otherwise(F.col("leaves")).cast("long").alias("leaves"),
            (F.col("saved") + (F.col("n") - 1) * (_upto(at) - _upto(at - 1))).alias("saved"), "chain"))
        return nodes.select(F.slice("chain", 1, max(depth - 1, 0)).alias("chain"), "conv", "n", F.lit(1).cast("long").alias("kids"), "leaves", "saved")

    def alone(self, rows: DataFrame, above: int) -> DataFrame:
        """All nodes of rows that share no prefix longer than ``above``."""
        leaves = F.when(F.col("kids") == 0, 1).otherwise(F.col("leaves")).cast("long")

        def node(k: Column) -> Column:
            return F.struct(k.alias("depth"), _key(k).alias("key"), _key(k - 1).alias("parent"), "conv", "n",
                            F.when(k == _depth(), F.col("kids")).otherwise(1).cast("long").alias("kids"), leaves.alias("leaves"),
                            (F.col("saved") + (F.col("n") - 1) * (_upto(_depth()) - _upto(k - 1))).alias("saved"),
                            F.when(k == above + 1, F.slice("chain", 1, above)).alias("chain"))

        done = self._write(rows.select(F.inline(F.transform(F.sequence(F.lit(above + 1), _depth()), node))))
        return done.where(F.col("depth") == above + 1).select("chain", "conv", "n", F.lit(1).cast("long").alias("kids"), "leaves", "saved")

    def peel(self, rows: DataFrame, above: int) -> DataFrame:
        """Peel rows that are all deeper than ``above``; what they add to the nodes of that depth."""
        deepest = rows.agg(F.max(_depth()).alias("d")).first()["d"]
        if deepest is None:
            return rows
        if deepest - above <= LEVELS:
            up = rows.limit(0)
            for depth in range(deepest, above, -1):
                up = self.level(rows.where(_depth() == depth).unionByName(up), depth)
            return up
        at = rows.withColumn("at", _key(F.lit(above + 1)))
        shared = cut(at.groupBy("at").agg(F.count("*").alias("rows")).where("rows > 1"))
        if shared.isEmpty():
            return self.alone(rows, above)
        told = cut(join_counted(at, shared, "at", "rows", at.count()).drop("at"))
        up = self.alone(told.where("rows IS NULL").drop("rows"), above)
        together, middle = told.where("rows IS NOT NULL").drop("rows"), (above + deepest) // 2
        lower = self.peel(together.where(_depth() > middle), middle)
        return up.unionByName(self.peel(together.where(_depth() <= middle).unionByName(lower), above))


def trie(conversations: DataFrame) -> DataFrame:
    """Trie of (conv_id, turns) as ``turn_lists`` gives them, one row per conversation.

    A row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (bytes of last
    turns that all members but one needn't repeat, over the subtree), ends_sha256 (ids of the conversations that end here).
    """
    spark = conversations.sparkSession
    all_ = cut(map_arrow(conversations, _chains, f"conv_id long, chain {CHAIN}"))
    zero = F.lit(0).cast("long")
    ended = cut(all_.groupBy("chain").agg(F.min("conv_id").alias("conv"), F.count("*").alias("n")).select(
        "chain", "conv", "n", zero.alias("kids"), zero.alias("leaves"), zero.alias("saved")))
    work = _Peeling(spark)
    deep = work.peel(ended.where(_depth() > LEVELS), LEVELS)
    up = work.peel(ended.where(_depth().between(1, LEVELS)).unionByName(deep), 0)
    work.level(ended.where(_depth() == 0).unionByName(up), 0)

    nodes = work.nodes()
    parents = nodes.where("kids > 0").select(F.col("key").alias("parent"), F.col("conv").alias("parent_conv_id"), F.col("kids").alias("of"))
    ends = all_.select(_key(_depth()).alias("key"), "conv_id").repartition("key").sortWithinPartitions("key", "conv_id")
    out = join_counted(nodes, parents, "parent", "of", nodes.count()).join(map_arrow(ends, _end_lists, "key binary, ends_sha256 string"), "key", "left")
    return out.select(F.col("conv").alias("conv_id"), F.col("depth").cast("long").alias("depth"), "parent_conv_id", F.col("n").alias("n_convs"),
                      F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
                      F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))
