"""Documents that hold passages of a benchmark, found by spaced seeds and verified over substitutions.

A mask names word places, as (0, 1, 3, 4, 7); the words at those places of a window are hashed and the words between
are ignored, so a replaced word leaves many windows of a passage intact. Seeds of the documents that pass a bitmap of
the benchmark's seeds (of fixed size; it only saves work) are joined with them on the hash. A match fixes an alignment
of a document with an item. Along the alignment, an equal word counts 1 and a different one -1; the best stretch is a
leak when its sum reaches ``MIN_SCORE``, or ``MIN_SHARE`` of the item's words where that is less.

Words are runs of anything but space and 0x09 to 0x0D, in lower case. Null texts have no words. Items of
fewer words than the shortest mask spans are no evidence and never match; of items with the same words the one with the
smallest id speaks for all (null ids last). Each text is verified by itself, also where rows share an id or have none.
A null id names no document, so texts without id are reported one by one, under a hash of the text; repeated rows are
reported once. Either table may be empty; the result is then empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import cut, let, pick, text_hash, text_or_empty, words_column
from sightline.scale import broadcast_if_small

MASKS = ((0, 1, 3, 4, 7), (0, 2, 3, 5, 6), (0, 1, 2, 4, 5))
MIN_SCORE = 10
MIN_SHARE = 0.7
BITMAP_WORDS = 1 << 14


def word_hashes(text: str | Column) -> Column:
    """Hashes of the words of a text in order."""
    return F.transform(words_column(F.lower(text_or_empty(text))), lambda w: F.xxhash64(w))


def seed(hashes: Column, at: Column, mask: int) -> Column:
    """Hash of the words that a mask picks from the window at ``at``."""
    return F.xxhash64(F.lit(mask), *[F.get(hashes, at + k) for k in MASKS[mask]])


def places(hashes: Column, mask: int) -> Column:
    n = F.size(hashes) - MASKS[mask][-1]
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def seeds(hashes: Column, wanted=None) -> Column:
    """(at, seed) of all windows and masks; only those for which ``wanted(seed)`` holds."""
    def of(mask: int) -> Column:
        made = F.transform(places(hashes, mask), lambda i: F.struct(i.alias("at"), seed(hashes, i, mask).alias("seed")))
        return F.filter(made, lambda s: wanted(s["seed"])) if wanted else made
    return F.concat(*[of(m) for m in range(len(MASKS))])


def _bits(h: Column) -> list[tuple[Column, Column]]:
    """Two places in the bitmap for a seed: word and bit."""
    n = 64 * BITMAP_WORDS
    return [(F.shiftright(b, 6).cast("int"), F.pmod(b, F.lit(64)).cast("int")) for b in (F.pmod(h, F.lit(n)), F.pmod(F.shiftright(h, 24), F.lit(n)))]


def bitmap(known: DataFrame) -> Column:
    """The bitmap of all seeds as a constant of ``BITMAP_WORDS`` longs; at most that many rows reach the driver."""
    rows = known.select(F.explode(F.array(*[F.struct(w.alias("w"), b.alias("b")) for w, b in _bits(F.col("seed"))])).alias("x"))
    held = rows.groupBy("x.w").agg(F.bit_or(F.expr("shiftleft(1L, x.b)")).alias("bits")).collect()
    words = [0] * BITMAP_WORDS
    for r in held:
        words[r["w"]] = r["bits"]
    return F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")


def in_bitmap(words: Column, h: Column) -> Column:
    first, second = ((F.call_function("shiftrightunsigned", F.get(words, w), b).bitwiseAND(F.lit(1))) == 1 for w, b in _bits(h))
    return first & second


def best_stretch(doc: Column, item: Column, shift: Column) -> Column:
    """(score, lo, hi) of the best stretch of an item along an alignment; places are the item's, ends inclusive."""
    flags = F.transform(item, lambda x, j: F.coalesce(F.get(doc, shift + j) == x, F.lit(False)))
    zero = F.lit(0)
    start = F.struct(*[zero.alias(n) for n in ("cur", "since", "score", "lo", "hi", "i")])

    def step(a: Column, equal: Column) -> Column:
        fresh = a["cur"] <= 0
        cur = F.when(fresh, 0).otherwise(a["cur"]) + F.when(equal, 1).otherwise(-1)
        since = F.when(fresh, a["i"]).otherwise(a["since"])
        better = cur > a["score"]
        return F.struct(cur.alias("cur"), since.alias("since"), F.when(better, cur).otherwise(a["score"]).alias("score"),
                        F.when(better, since).otherwise(a["lo"]).alias("lo"), F.when(better, a["i"]).otherwise(a["hi"]).alias("hi"), (a["i"] + 1).alias("i"))

    return F.aggregate(flags, start, step)


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
          each_text: bool = False) -> DataFrame:
    """doc_id, item_id, score, first_word, n_words, text_hash: the best verified stretch of each item in each document.

    ``text_hash`` tells the text that leaks where the id doesn't: in rows without id, and with ``each_text`` in all rows,
    so that texts that share an id are reported one by one.
    """
    items = pick(benchmark, item_id=item_id, text=item_text).select("item_id", word_hashes("text").alias("words"))
    items = items.groupBy("words").agg(F.min("item_id").alias("item_id"))
    items = cut(items.select("item_id", "words", F.monotonically_increasing_id().alias("item")))
    known = cut(items.select("item", F.explode(seeds(F.col("words"))).alias("s")).select("item", F.col("s.at").alias("item_at"), "s.seed"))
    held = bitmap(known)

    rows = pick(docs, doc_id=doc_id, text=text).select("doc_id", text_hash("text").alias("text_hash"), "text")
    found = let(held, lambda bits: let(word_hashes("text"), lambda h: seeds(h, lambda s: in_bitmap(bits, s))))  # the constant stands once in the plan
    hits = rows.select("doc_id", "text_hash", F.explode(found).alias("s")).select("doc_id", "text_hash", "s.at", "s.seed").join(known, "seed")
    lines = hits.groupBy("doc_id", "text_hash", "item", (F.col("at") - F.col("item_at")).alias("shift")).count().select("doc_id", "text_hash", "item", "shift")
    lines = lines.join(items.select("item", "item_id", "words"), "item")
    per_doc = cut(lines.groupBy(F.col("doc_id").alias("of"), F.col("text_hash").alias("of_hash")).agg(F.collect_list(F.struct("item", "item_id", "words", "shift")).alias("lines")))

    least = lambda w: F.least(F.lit(MIN_SCORE), F.ceil(F.size(w) * MIN_SHARE).cast("int"))
    judged = let(word_hashes("text"), lambda h: F.filter(F.transform("lines", lambda x: F.struct(
        x["item"].alias("item"), x["item_id"].alias("item_id"), least(x["words"]).alias("least"), x["shift"].alias("shift"),
        best_stretch(h, x["words"], x["shift"]).alias("b"))), lambda x: x["b"]["score"] >= x["least"]))
    same = F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_hash") == F.col("of_hash"))
    # The ids of suspects travel to the texts while they are provably few; then only suspects' texts are shuffled.
    suspects = rows.join(broadcast_if_small(per_doc.select("of", "of_hash")), same, "left_semi")
    named = F.col("text_hash") if each_text else F.when(F.col("doc_id").isNull(), F.col("text_hash"))
    true = suspects.join(per_doc, same).select("doc_id", named.alias("text_hash"), F.explode(judged).alias("x"))
    best = F.max(F.struct(F.col("x.b.score").alias("score"), (-(F.col("x.shift") + F.col("x.b.lo"))).alias("back"), (F.col("x.b.hi") - F.col("x.b.lo") + 1).alias("n_words")))
    return true.groupBy("doc_id", "text_hash", F.col("x.item").alias("item"), F.col("x.item_id").alias("item_id")).agg(best.alias("m")).select(
        "doc_id", "item_id", "m.score", (-F.col("m.back")).alias("first_word"), "m.n_words", "text_hash")


def clean(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without what ``leaks`` found.

    A leak with a ``text_hash`` removes the rows of that id, null ids included, that hold that very text; one without
    removes all rows of its id.
    """
    gone = cut(found.select(F.col("doc_id").alias("_gone"), F.col("text_hash").alias("_gone_hash")).distinct())
    texts = broadcast_if_small(gone.where("_gone_hash IS NOT NULL"))
    kept = docs.join(texts, F.col(doc_id).eqNullSafe(F.col("_gone")) & (text_hash(text) == F.col("_gone_hash")), "left_anti")
    ids = gone.where("_gone_hash IS NULL").select("_gone")
    return kept if ids.isEmpty() else kept.join(broadcast_if_small(ids, 16), F.col(doc_id) == F.col("_gone"), "left_anti")
