"""Mixing sources to target weights, by blocks of words and pseudorandom permutations.

The words of a source form one stream, documents in an order given by hashes, cut into blocks of ``block`` words. The
mix is a multiset of blocks. A source whose target is e times its size and a rest gets every block e times and a part
of one more pass; the last block of that part is cut, so that a source gives exactly as many words as its target has
whole ones. Slot j of a source names block ``permutation(j mod blocks)`` of pass ``j div blocks``; the permutation is
the swap-or-not shuffle, a function of seed, source and pass that any task can evaluate for any index. Every slot
falls on one of the output shards by a hash, so that the counts of a source over the shards are one multinomial draw
with the source's total, and shards mix the sources in the proportions of their targets. Blocks meet slots by an
equi-join on (source, block).

Weights repeat over the sources in code point order, null last. Targets share ``share`` of all words by weight and
stop at ``most`` times the source's words; the excess is shared again by weight among the others.

A null text has no words; documents without words give nothing to the mix and are reported with 0. Null is a source of
its own. Rows with equal ids are documents of their own. The order of documents hangs
on their id, text and number among equal rows, so reruns agree, also for rows without id. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm.common import cut, pick, text_hash, text_or_empty
from sightline.operators.ordered import row_number

BLOCK = 128
SHARD_SLOTS = 4096
ROUNDS = 16
BUCKET_ROWS = 8192
WEIGHTS = (3, 1, 2)
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """A row per source of (source, size): rank, source, source_size, weight, target. One row per source is windowed."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    # Sources reach their limit in the order of limit / weight. With the first k at their limits, the level of the others is
    # (what is left) / (weights that are left); it rises as long as the next source would be above its limit, then falls.
    limit = F.col("source_size") * most
    order = Window.orderBy(limit / F.col("weight"), "rank")
    before, rest, all_rows = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    level_after = (F.sum("source_size").over(all_rows) * share - F.coalesce(F.sum(limit).over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    per = per.withColumn("level", level_after)
    level = F.max("level").over(all_rows)
    return per.select("rank", "source", "source_size", "weight",
                      F.least(limit, level * F.col("weight")).alias("target"))


def permutation(i: Column, n: Column, *key: Column, rounds: int = ROUNDS, inverse: bool = False) -> Column:
    """Place of index ``i`` in a pseudorandom permutation of 0 .. n - 1 (swap-or-not); its own inverse round by round."""
    def step(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(*key, r), n) - x, n)
        swap = F.xxhash64(*key, r, F.greatest(x, other)).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, other).otherwise(x)
    order = list(range(rounds))[::-1 if inverse else 1]
    return F.aggregate(F.array(*[F.lit(r) for r in order]), i.cast("long"), step)


@dataclass
class Mix:
    """documents: row, doc_id, source, size. sources: as ``targets`` and the passes of each. slots: shard, rank, j,
    block, take. pieces: shard, rank, j, row, first, n_words (what each slot takes of each document)."""

    documents: DataFrame
    sources: DataFrame
    slots: DataFrame
    pieces: DataFrame

    def per_document(self) -> DataFrame:
        """doc_id, size, source_size, target, taken of every document."""
        taken = self.pieces.groupBy("row").agg(F.sum("n_words").alias("taken"))
        sources = self.sources.select(F.col("source").alias("of"), "source_size", "target")
        docs = self.documents.join(taken, "row", "left").join(sources, F.col("source").eqNullSafe(F.col("of")))
        return docs.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, block: int = BLOCK, seed: int = 1,
        doc_id: str = "doc_id", text: str = "text", source: str = "source") -> Mix:
    """The mix of all documents."""
    rows = pick(docs, doc_id=doc_id, text=text, source=source).withColumn("row", F.monotonically_increasing_id())
    return mix_sizes(_sized(rows), weights, share, most, block, seed)


def _sized(rows: DataFrame) -> DataFrame:
    """(row, doc_id, source, size, fp, copy) of (row, doc_id, text, source): equal rows are numbered, so that they can be told apart."""
    size = F.regexp_count(text_or_empty("text"), F.lit(WORD)).cast("long").alias("size")
    sized = cut(rows.select("row", "doc_id", "source", size, text_hash("text").alias("fp")))
    return cut(row_number(sized, ["doc_id", "source", "fp"], ["row"], "copy"))


def mix_sizes(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, block: int = BLOCK,
              seed: int = 1) -> Mix:
    """The mix of a table as ``_sized`` writes it. The order of a source's documents hangs on ids, texts and the number
    among equal rows alone, so it is the same however the rows were read; ``row`` only names them in the result."""
    spark = documents.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = (F.lit(seed), F.col("rank"))
    pass_key = (*key, F.col("passes"))
    # Per source: blocks, whole passes, words and slots of the part of a pass after them.
    src = targets(documents, weights, share, most)
    src = src.withColumn("words", F.floor("target")).withColumn("blocks", F.ceil(F.col("source_size") / block))
    src = src.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("words") / F.col("source_size"))).otherwise(0))
    src = src.withColumn("rest", F.col("words") - F.col("passes") * F.col("source_size"))
    src = src.withColumn("short", F.col("blocks") * block - F.col("source_size"))
    src = src.withColumn("short_at", F.when(F.col("blocks") > 0, permutation(F.col("blocks") - 1, F.col("blocks"), *pass_key, inverse=True)))
    even = F.ceil(F.col("rest") / block)
    src = src.withColumn("part", F.when(even > F.col("short_at"), F.ceil((F.col("rest") + F.col("short")) / block)).otherwise(even))
    src = cut(src.withColumn("n_slots", F.col("passes") * F.col("blocks") + F.col("part")))
    n_docs = documents.count()
    shards = src.agg(F.ceil(F.sum("n_slots") / SHARD_SLOTS)).first()[0] or 1

    # Slots, made in runs so that a large source is spread over tasks.
    runs = src.where("n_slots > 0").select("rank", "blocks", "passes", "rest", "short", "short_at", "n_slots", "source_size",
                                           F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_slots") - 1, F.lit(SHARD_SLOTS).cast("long"))).alias("from"))
    slots = runs.repartition(tasks, "rank", "from").withColumn("j", F.explode(F.sequence("from", F.least(F.col("from") + SHARD_SLOTS, F.col("n_slots")) - 1)))
    i, turn = F.pmod(F.col("j"), F.col("blocks")), F.floor(F.col("j") / F.col("blocks"))
    slots = slots.withColumn("turn", turn).withColumn("i", i).withColumn("block", permutation(F.col("i"), F.col("blocks"), *key, F.col("turn")))
    behind = F.col("i") * block - F.when(F.col("i") > F.col("short_at"), F.col("short")).otherwise(0)
    slots = slots.select(F.pmod(F.xxhash64(*key, "j"), F.lit(shards)).alias("shard"), "rank", "j", "block",
                         F.when(F.col("turn") < F.col("passes"), F.lit(block)).otherwise(F.least(F.lit(block), F.col("rest") - behind)).cast("long").alias("take"))

    # Places of documents in the streams: running sums inside buckets of bounded size, then of the buckets.
    ranked = documents.where("size > 0").join(src.select(F.col("source").alias("of"), "rank"), F.col("source").eqNullSafe(F.col("of")))
    spread = F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.lit(-1)), "fp", "copy")
    ranked = ranked.select("row", "rank", "size", "doc_id", "fp", "copy", spread.alias("spread"), F.pmod(spread, F.lit(max(1, -(-n_docs // BUCKET_ROWS)))).alias("bucket"))
    bucket = Window.partitionBy("rank", "bucket").orderBy("spread", "doc_id", "fp", "copy").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranked.groupBy("rank", "bucket").agg(F.sum("size").alias("held")).select(
        "rank", "bucket", F.coalesce(F.sum("held").over(Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    placed = ranked.withColumn("start", F.coalesce(F.sum("size").over(bucket), F.lit(0))).join(sums, ["rank", "bucket"]).select(
        "row", "rank", "size", (F.col("start") + F.col("base")).alias("start"))
    cells = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))))
    low = F.greatest(F.col("start") - F.col("block") * block, F.lit(0))  # place in the block
    high = F.least(F.col("start") + F.col("size") - F.col("block") * block, F.lit(block))
    cells = cells.select("rank", "block", "row", low.alias("low"), high.alias("high"), (F.col("block") * block + low - F.col("start")).alias("first"))

    # Slots come from the tiny table of sources, so the planner would take them for tiny and broadcast them.
    pieces = slots.hint("merge").join(cells, ["rank", "block"]).where("take > low").select(
        "shard", "rank", "j", "row", "first", (F.least("high", "take") - F.col("low")).alias("n_words"))
    return Mix(documents, src, slots, pieces)


def mixed_texts(docs: DataFrame, seed: int = 1, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The documents of the mix with all columns of ``docs``: a row for each pass that takes words of a document.

    A text taken whole stays as it is; otherwise it is the words taken, in their order, joined by spaces.
    """
    rows = cut(docs.withColumn("_row", F.monotonically_increasing_id()))
    made = mix_sizes(_sized(pick(rows, row="_row", doc_id=doc_id, text=text, source=source)), seed=seed, **options)
    turns = made.pieces.join(made.sources.select("rank", "blocks"), "rank").groupBy(
        F.col("row").alias("_row"), F.floor(F.col("j") / F.col("blocks")).alias("_turn")).agg(
        F.sort_array(F.collect_list(F.struct("first", "n_words"))).alias("_parts"), F.sum("n_words").alias("_taken"))
    words = F.split(F.regexp_replace(F.col(text), r"^[\x20\x09-\x0D]+", ""), r"[\x20\x09-\x0D]+")
    taken = F.concat_ws(" ", F.flatten(F.transform(F.array(words), lambda w: F.flatten(F.transform(
        "_parts", lambda p: F.slice(w, (p["first"] + 1).cast("int"), p["n_words"].cast("int")))))))
    whole = F.col("_taken") == F.regexp_count(F.col(text), F.lit(WORD))
    out = rows.join(turns, "_row").withColumn("_text", F.when(whole, F.col(text)).otherwise(taken))
    return out.select(*[F.col("_text").alias(c) if c == text else F.col(c) for c in docs.columns])
