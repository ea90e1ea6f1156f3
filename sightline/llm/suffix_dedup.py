"""Removal of repeated byte strings by prefix doubling with hashed ranks over a sparse set of positions.

Every byte covered by a string of ``LENGTH`` bytes that also starts in a document with a smaller id is removed. Doubling
over all positions would shuffle two ranks and a place, some 24 bytes, for each byte of text in every round; so the
method is changed in two points. Positions: in each window of ``LENGTH`` bytes the position with the least rank of its
first ``BASE`` bytes is the anchor; equal windows have equal anchors at equal places, so only anchors go through the
rounds, one position in some sixteen. Ranks: the rank of a longer string is the hash of a pair of ranks of the round before,
at a position and ``STEP`` bytes on; equal strings have equal ranks, and no numbering of the whole corpus is needed.
Each round sorts what is left by rank, and what is unique to one document drops out:

1. ``BASE`` bytes at the anchor.
2. The run of windows that share the anchor, as a pair of ranks of its first and last window: all windows of a run
   that equals a run of a smaller document are removed at once. One document, the smallest, stands for each run.
3. ``BASE + STEP`` bytes, to the left or right of the anchor, of these runs: a window holds one of the two, so a run with
   neither in common with another document is done.
4. ``LENGTH`` bytes, which is ``BASE + 2 * STEP``: each window of what is left.

Ranks have 64 bits; the first ones, which only select, keep as many as tell the corpus's anchors apart but for one in
some 16,000. Equal strings within some hundred thousand of a task are settled there, so that no group, however large,
comes to one task as it is.
Equal texts are settled before all that: every copy but that with the smallest id goes whole if it has ``LENGTH`` bytes.

Matches never cross documents; null and empty texts have nothing to remove. A document with a null id is neither
smaller nor larger than another and stays as it is. Rows with equal ids are judged against documents with smaller ids
only, not against each other. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm import hashing
from sightline.llm.common import batches, cut, pick, text_or_empty
from sightline.scale import broadcast_if_small

LENGTH = 50
BASE = 20
STEP = 15
MIDDLE = BASE + STEP
#: Ranks that many anchors have: at most so many are listed, seen so often in all and in a million anchors of a task.
#: Whatever the list, the result is the same; it only keeps frequent strings from meeting in one task.
FREQUENT = 1 << 16
FREQUENT_LEAST = 2000
SEEN_LEAST = 32
#: Strings a task settles among themselves before they are shuffled.
SETTLED_AT_ONCE = 1 << 19


def further(ranks: np.ndarray, step: int = STEP) -> np.ndarray:
    """Ranks of strings that are ``step`` bytes longer: hashes of pairs (rank at i, rank at i + step)."""
    return hashing.mix(ranks[:-step] * np.uint64(0x9E3779B97F4A7C15) + ranks[step:]) if len(ranks) > step else np.empty(0, np.uint64)


#: An anchor in one long: place, windows of its run before it, windows of the run less one.
def _pack(q: np.ndarray, before: np.ndarray, more: np.ndarray) -> np.ndarray:
    return (q << 12) | (before << 6) | more


def _unpack(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window)."""
    q, before, more = x >> 12, (x >> 6) & 63, x & 63
    return q, q - before, q - before + more


def anchors(raw: np.ndarray, piece: int = 1 << 23) -> tuple[np.ndarray, np.ndarray]:
    """(packed anchors, ranks of their BASE bytes) of a text.

    A window's anchor is the leftmost least of the upper 40 bits of its ranks; the lower 24 bits hold the place meanwhile.
    """
    n, packed, found = len(raw) - LENGTH + 1, [], []
    wide, low = LENGTH - BASE + 1, np.uint64((1 << 24) - 1)
    for base in range(0, n, piece):
        ranks = hashing.byte_windows(raw[base:base + piece + LENGTH - 1], BASE)
        k, span = len(ranks) - wide + 1, 1
        least = (ranks & ~low) | np.arange(len(ranks), dtype=np.uint64)
        while span * 2 <= wide:
            least, span = np.minimum(least[:-span], least[span:]), span * 2
        at = (np.minimum(least[:k], least[wide - span:wide - span + k]) & low).astype(np.int64)
        lo = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        hi = np.append(lo[1:], k) - 1
        packed.append(_pack(at[lo] + base, at[lo] - lo, hi - lo))
        found.append(ranks[at[lo]])
    return (np.concatenate(packed), np.concatenate(found)) if packed else (np.empty(0, np.int64), np.empty(0, np.uint64))


def _rows(batch) -> Iterator[tuple]:
    """Rows of a batch, the last column (text) as bytes; a part of the batch at a time."""
    texts = batch.column(batch.num_columns - 1)
    for lo, hi in batches(texts, 4 << 20):
        part = batch.slice(lo, hi - lo)
        yield from zip(*(c.to_pylist() for c in part.columns[:-1]), (np.frombuffer(t.as_buffer(), np.uint8) for t in part.columns[-1]), strict=True)


def _frequent(rows: Iterator) -> Iterator:
    """(rank, times) of ranks that a task sees often in some million anchors."""
    import pyarrow as pa

    counts: dict[int, int] = {}
    held: list[np.ndarray] = []

    def count() -> None:
        ranks, times = np.unique(np.concatenate(held) if held else np.empty(0, np.uint64), return_counts=True)
        often = times >= SEEN_LEAST
        for r, k in zip(ranks[often].view(np.int64).tolist(), times[often].tolist(), strict=True):
            counts[r] = counts.get(r, 0) + k
        held.clear()

    waiting = 0
    for batch in rows:
        for (raw,) in _rows(batch):
            held.append(anchors(raw)[1])
            waiting += len(held[-1])
            if waiting > 1 << 20:
                count()
                waiting = 0
    count()
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["rank", "times"])


def _batch(names: tuple[str, ...], columns: list[list[np.ndarray]], fp: bool):
    """A batch of the columns; ``fp`` only where it tells rows apart."""
    import pyarrow as pa

    kept = [k for k, n in enumerate(names) if fp or n != "fp"]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(columns[k])) for k in kept], names=[names[k] for k in kept])


def _base(rows: Iterator, bits: int, frequent, fp: bool) -> Iterator:
    """(rank, doc_id, fp, q) of all anchors; ranks of so many bits.

    Anchors of frequent ranks are sure to be kept: their q is negated bit by bit, and each gets a rank of its own, so that they
    are dealt out evenly.
    """
    names = ("rank", "doc_id", "fp", "q")

    mask, often = np.uint64((1 << bits) - 1), frequent.value
    out, held = ([], [], [], []), 0
    for batch in rows:
        for doc_id, tell, raw in _rows(batch):
            packed, ranks = anchors(raw)
            sure = np.isin(ranks, often)
            ranks = np.where(sure, hashing.mix(packed.astype(np.uint64) * np.uint64(31) + np.uint64(doc_id & (1 << 63) - 1)), ranks) & mask
            for c, x in zip(out, (ranks.view(np.int64), np.full(len(ranks), doc_id), np.full(len(ranks), tell), np.where(sure, ~packed, packed)), strict=True):
                c.append(x)
            held += len(ranks)
            if held > 200_000:
                yield _batch(names, out, fp)
                out, held = ([], [], [], []), 0
    if held:
        yield _batch(names, out, fp)


def _ends(windows: np.ndarray, n: int, at: np.ndarray) -> np.ndarray:
    """Ranks of the MIDDLE bytes at some places; 0 where they don't lie in the text (no such window then)."""
    inside = (at >= 0) & (at < n - MIDDLE + 1)
    out = np.zeros(len(at), np.uint64)
    out[inside] = windows[at[inside]]
    return out


def _settle(rank: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks, and which rows are settled: those whose rank a smaller document of the batch has.

    A settled row gets a rank of its own, so that it is dealt out like any other and meets none.
    """
    order = np.lexsort((doc, rank))
    first = np.concatenate([[True], rank[order][1:] != rank[order][:-1]])
    least = doc[order][np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
    settled = np.zeros(len(order), bool)
    settled[order] = doc[order] > least
    own = hashing.mix(doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64))
    return np.where(settled, own, rank).view(np.int64), settled


def _runs(rows: Iterator, fp: bool) -> Iterator:
    """Runs of the anchors asked for: (doc_id, fp, q, run, left, right); the q of a settled run is negated bit by bit."""
    def made(out: list[list[np.ndarray]]):
        doc, tell, q, run, left, right = map(np.concatenate, out)
        run, settled = _settle(run, doc, q)
        left[settled] = right[settled] = 0
        return _batch(("doc_id", "fp", "q", "run", "left", "right"), [[x] for x in (doc, tell, np.where(settled, ~q, q), run, left, right)], fp)

    out: list[list[np.ndarray]] = [[] for _ in range(6)]
    held_rows = 0
    for batch in rows:
        for doc_id, tell, held, raw in _rows(batch):
            packed = np.array(held, np.int64)
            q, lo, hi = _unpack(packed)
            part = further(hashing.byte_windows(raw, BASE))
            whole = further(part)
            run = hashing.mix(hashing.mix(whole[lo] + (packed & 4095).astype(np.uint64)) ^ whole[hi])
            left, right = _ends(part, len(raw), q - STEP), _ends(part, len(raw), q)
            for c, x in zip(out, (np.full(len(q), doc_id), np.full(len(q), tell), packed, run, left.view(np.int64), right.view(np.int64)), strict=True):
                c.append(x)
            held_rows += len(q)
            if held_rows > SETTLED_AT_ONCE:
                yield made(out)
                out, held_rows = [[] for _ in range(6)], 0
    if held_rows:
        yield made(out)


def _windows(rows: Iterator, fp: bool) -> Iterator:
    """(rank, doc_id, fp, p) of every window of the runs asked for; the p of a settled one is negated bit by bit."""
    def made(out: list[list[np.ndarray]]):
        rank, doc, tell, p = map(np.concatenate, out)
        rank, settled = _settle(rank, doc, p)
        return _batch(("rank", "doc_id", "fp", "p"), [[x] for x in (rank, doc, tell, np.where(settled, ~p, p))], fp)

    out: list[list[np.ndarray]] = [[] for _ in range(4)]
    held_rows = 0
    for batch in rows:
        for doc_id, tell, held, raw in _rows(batch):
            _, lo, hi = _unpack(np.array(held, np.int64))
            sizes = hi - lo + 1
            p = np.unique(np.repeat(lo - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum()))
            for c, x in zip(out, (further(further(hashing.byte_windows(raw, BASE)))[p], np.full(len(p), doc_id), np.full(len(p), tell), p), strict=True):
                c.append(x)
            held_rows += len(p)
            if held_rows > 4 * SETTLED_AT_ONCE:
                yield made(out)
                out, held_rows = [[] for _ in range(4)], 0
    if held_rows:
        yield made(out)


def _remove(rows: Iterator) -> Iterator:
    """(doc_id, fp, n_removed, spans, kept) of documents with ranges of windows to remove."""
    import pyarrow as pa

    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("n_removed", pa.int64()),
                        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("kept_sha256", pa.string())])
    for batch in rows:
        out = []
        for doc_id, fp, starts, stops, raw in _rows(batch):
            edges = np.zeros(len(raw) + 1, np.int64)
            np.add.at(edges, np.array(starts, np.int64), 1)
            np.add.at(edges, np.array(stops, np.int64), -1)
            gone = np.cumsum(edges[:-1]) > 0
            turns = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
            spans = [{"start": int(a), "stop": int(b)} for a, b in turns.reshape(-1, 2)]
            out.append((doc_id, fp, int(gone.sum()), spans, hashlib.sha256(raw[~gone].tobytes()).hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 5, schema, strict=True)], schema=schema)


class SuffixDedup:
    """Removal over one table; ``result`` has spans, and digests of what is kept."""

    def __init__(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> None:
        self.rows = pick(docs, doc_id=doc_id, text=text).withColumn("text", text_or_empty("text"))

    def _with_texts(self, lists: DataFrame, *columns: str) -> DataFrame:
        """(doc_id, fp, lists, raw) of the documents in ``lists``; while they are provably few, only their texts move."""
        ids = lists.select(F.col("doc_id").alias("of"))
        texts = self.docs.where("doc_id IS NOT NULL").join(broadcast_if_small(ids, 16), F.col("doc_id") == F.col("of"), "left_semi")
        texts = texts.dropDuplicates(["doc_id", "fp"]) if self.repeated else texts
        return lists.join(texts, ["doc_id", "fp"]).select("doc_id", "fp", *columns, F.encode("text", "UTF-8").alias("raw"))

    def _told(self, df: DataFrame) -> DataFrame:
        """``df`` with fp, which is only shuffled where rows of one id must be told apart."""
        return df if "fp" in df.columns else df.withColumn("fp", F.lit(0).cast("long"))

    def _copies(self) -> None:
        """Digests of all rows, and the copies of texts that stand in a smaller document. fp tells rows of one id apart."""
        known = cut(self.rows.select("doc_id", F.xxhash64("text").alias("fp"), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")))
        self.repeated = not known.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty()
        tell = F.xxhash64("text") if self.repeated else F.lit(0).cast("long")
        self.names = "doc_id long, fp long" if self.repeated else "doc_id long"
        self.docs, self.known = self.rows.withColumn("fp", tell), known if self.repeated else known.withColumn("fp", tell)
        firsts = known.where("doc_id IS NOT NULL").groupBy("sha").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first")
        self.copies = cut(self.known.join(firsts, "sha").where(f"doc_id > first AND n_bytes >= {LENGTH}").select("doc_id", "fp").distinct())
        total = known.agg(F.sum("n_bytes")).first()[0] or 0
        self.bits = min(64, max(total // 16, 1).bit_length() + 14)

    def _alike(self) -> DataFrame:
        """(doc_id, fp, held): anchors whose first bytes also stand at an anchor of another document."""
        gone = broadcast_if_small(self.copies.select(F.col("doc_id").alias("of"), F.col("fp").alias("of_fp")), 24)
        rows = self.docs.where(f"doc_id IS NOT NULL AND octet_length(text) >= {LENGTH}").join(
            gone, (F.col("doc_id") == F.col("of")) & (F.col("fp") == F.col("of_fp")), "left_anti")
        raw = rows.select("doc_id", "fp", F.encode("text", "UTF-8").alias("raw"))
        seen = raw.select("raw").mapInArrow(_frequent, "rank long, times long").groupBy("rank").agg(F.sum("times").alias("times"))
        often = np.array([r["rank"] for r in seen.where(F.col("times") >= FREQUENT_LEAST).orderBy(F.desc("times"), "rank").limit(FREQUENT).collect()], np.int64)
        shared = self.rows.sparkSession.sparkContext.broadcast(np.sort(often.view(np.uint64)))
        ranked = raw.mapInArrow(partial(_base, bits=self.bits, frequent=shared, fp=self.repeated), f"rank long, {self.names}, q long")
        group = Window.partitionBy("rank")
        ranked = ranked.withColumn("low", F.min("doc_id").over(group)).withColumn("high", F.max("doc_id").over(group)).where("low < high OR q < 0")
        return cut(self._told(ranked).groupBy("doc_id", "fp").agg(F.collect_list(F.when(F.col("q") < 0, F.bitwise_not("q")).otherwise(F.col("q"))).alias("held")))

    def _refined(self) -> DataFrame:
        """Runs with the smallest document that has each; settled ones have a smaller one than their own."""
        runs = self._with_texts(self._alike(), "held").mapInArrow(partial(_runs, fp=self.repeated), f"{self.names}, q long, run long, left long, right long")
        settled = (F.col("q") < 0) | (F.min("doc_id").over(Window.partitionBy("run")) < F.col("doc_id"))
        runs = self._told(runs.withColumn("settled", settled))
        return cut(runs.select("doc_id", "fp", F.when(F.col("q") < 0, F.bitwise_not("q")).otherwise(F.col("q")).alias("q"), "settled", "left", "right"))

    def _removed(self) -> DataFrame:
        """(doc_id, fp, start, stop): byte ranges to remove, before they are merged."""
        runs = self._refined()
        start = F.shiftright("q", 12) - F.shiftright("q", 6).bitwiseAND(F.lit(63))
        settled = runs.where("settled").select("doc_id", "fp", start.alias("start"), (start + F.col("q").bitwiseAND(F.lit(63)) + LENGTH).alias("stop"))

        stand = runs.where("NOT settled").select("doc_id", "fp", "q", F.explode(F.array("left", "right")).alias("rank")).where("rank <> 0")
        shared = stand.groupBy("rank").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("rank")
        left = cut(stand.join(shared, "rank").groupBy("doc_id", "fp").agg(F.collect_set("q").alias("held")))
        windows = self._with_texts(left, "held").mapInArrow(partial(_windows, fp=self.repeated), f"rank long, {self.names}, p long")
        windows = self._told(windows.withColumn("low", F.min("doc_id").over(Window.partitionBy("rank"))).where("p < 0 OR low < doc_id"))
        p = F.when(F.col("p") < 0, F.bitwise_not("p")).otherwise(F.col("p"))
        return settled.unionAll(windows.select("doc_id", "fp", p.alias("start"), (p + LENGTH).alias("stop")))

    def result(self) -> DataFrame:
        """doc_id, n_bytes, n_removed, spans (merged byte ranges) and kept_sha256 of every document."""
        self._copies()
        ranges = cut(self._removed().groupBy("doc_id", "fp").agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops")))
        parts = self._with_texts(ranges, "starts", "stops").mapInArrow(
            _remove, "doc_id long, fp long, n_removed long, spans array<struct<start:long,stop:long>>, kept_sha256 string")
        whole = self.copies.withColumn("whole", F.lit(True))
        out = self.known.join(whole, ["doc_id", "fp"], "left").join(parts, ["doc_id", "fp"], "left")
        none = F.array().cast("array<struct<start:long,stop:long>>")
        all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("stop")))
        return out.select(
            "doc_id", "n_bytes", F.when(F.col("whole"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
            F.when(F.col("whole"), all_of_it).otherwise(F.coalesce("spans", none)).alias("spans"),
            F.when(F.col("whole"), F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, spans, kept_sha256 of every document."""
    return SuffixDedup(docs, doc_id, text).result()
