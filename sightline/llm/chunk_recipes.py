"""Exact duplicates by recipes of content-defined chunks.

Texts are equal when they are the same after each run of white space became one space. A text is cut where its own bytes
say so (8 bytes whose product with a constant is small; never under ``LEAST`` or over ``MOST`` bytes apart), so equal
texts, and equal passages of some length, have equal chunks.

1. Recipes: a row per document with the ordered list of its chunks' identifiers. The text stays where it is.
2. Identifiers are verified: each different pair of identifier and chunk is shuffled once, combined in the tasks that
   read it, and no identifier may stand for two contents. Should one do, all are drawn anew, twice as long.
3. Lists are compared as they are: one row stays for each different list, of those with the smallest id.

From then on only recipes move. A recipe that many documents have meets its group by broadcast (see ``join_counted``), so a
group of copies of any size stays spread.

Null counts as empty; empty texts are equal to each other. Every row has its result: of rows with the same id and equal
texts one stays, and a row without id stays only if no equal text has one (``keep_id`` is null then). An empty table gives
an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import batches, cut, join_counted, map_arrow, pick

#: Bytes of a chunk: at least, at most (the last one of a text may be shorter), and on average between marks.
LEAST, MOST, MEAN = 256, 8192, 1024
#: Bytes of an identifier, unless two chunks share one.
DIGEST = 16
SLICE = 1 << 20
OUT_BYTES = 4 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MARK = np.uint64((1 << 64) // MEAN)
_BLANKS = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def normal(text: str | None) -> bytes:
    """UTF-8 of a text with each run of white space as one space."""
    raw = (text or "").encode().translate(_BLANKS)
    while b"  " in raw:
        raw = raw.replace(b"  ", b" ")
    return raw


def _marks(raw: bytes) -> Iterator[np.ndarray]:
    """Ends of the 8-byte windows that mark a boundary, in order."""
    for base in range(0, len(raw), SLICE):
        part = raw[base:base + SLICE + 7]
        found = [np.flatnonzero(np.frombuffer(part, "<u8", (len(part) - o) // 8, o) * _MIX < _MARK) * 8 + o for o in range(min(8, len(part)))]
        yield np.sort(np.concatenate(found)) + (base + 8)


def chunk_ends(raw: bytes) -> list[int]:
    """Where the chunks of a text end; none for an empty one."""
    ends, last = [], 0
    if len(raw) > LEAST:
        for marks in _marks(raw):
            for m in marks.tolist():
                while m - last > MOST:
                    ends.append(last := last + MOST)
                if m - last >= LEAST:
                    ends.append(last := m)
    while len(raw) - last > MOST:
        ends.append(last := last + MOST)
    if last < len(raw):
        ends.append(len(raw))
    return ends


def _chunks(raw: bytes, digest: int) -> Iterator[tuple[bytes, bytes]]:
    start = 0
    for end in chunk_ends(raw):
        chunk = raw[start:end]
        yield hashlib.blake2b(chunk, digest_size=digest).digest(), chunk
        start = end


def _texts(rows: Iterator) -> Iterator[tuple[list, list]]:
    """(other columns, texts) in small lists; the text is the last column."""
    for b in rows:
        for lo, hi in batches(b.column(b.num_columns - 1), OUT_BYTES):
            part = b.slice(lo, hi - lo)
            yield part.columns[:-1], part.columns[-1].to_pylist()


def _recipes(rows: Iterator, digest: int) -> Iterator:
    import pyarrow as pa

    for kept, texts in _texts(rows):
        sha, sizes, recipes = [], [], []
        for raw in map(normal, texts):
            sha.append(hashlib.sha256(raw).digest())
            sizes.append(len(raw))
            recipes.append([i for i, _ in _chunks(raw, digest)])
        yield pa.RecordBatch.from_arrays([*kept, pa.array(sha, pa.binary()), pa.array(sizes, pa.int64()), pa.array(recipes, pa.list_(pa.binary()))],
                                         names=["row", "doc_id", "sha", "n_bytes", "recipe"])


def _contents(rows: Iterator, digest: int) -> Iterator:
    import pyarrow as pa

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.binary())], names=["chunk", "content"])

    held: dict[bytes, bytes] = {}
    size = 0
    for _, texts in _texts(rows):
        for raw in map(normal, texts):
            for i, chunk in _chunks(raw, digest):
                if held.get(i) == chunk:
                    continue
                if size > OUT_BYTES or i in held:  # a second content of an identifier goes out as well
                    yield out()
                    held.clear()
                    size = 0
                held[i] = chunk
                size += len(chunk)
    yield out()


def chunks(docs: DataFrame, digest: int = DIGEST, text: str = "text") -> DataFrame:
    """Each different (chunk, content) once, the identifier first."""
    found = map_arrow(docs.select(F.col(text).alias("text")), partial(_contents, digest=digest), "chunk binary, content binary")
    return found.groupBy("chunk", "content").agg(F.count("*").alias("seen")).drop("seen")


def recipes(docs: DataFrame, digest: int = DIGEST, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, int]:
    """Recipes whose identifiers are verified, and the bytes of an identifier.

    A row per document: row (a number of its own), doc_id, sha (of the normalised text), n_bytes, recipe (list of identifiers).
    With ``chunks`` of the same digest they give all texts back.
    """
    rows = pick(docs, doc_id=doc_id, text=text).select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    while True:
        shared = chunks(docs, digest, text).groupBy("chunk").agg(F.count("*").alias("n")).where("n > 1")
        if shared.isEmpty():
            return cut(map_arrow(rows, partial(_recipes, digest=digest), "row long, doc_id long, sha binary, n_bytes long, recipe array<binary>")), digest
        if digest >= 64:
            raise RuntimeError("different chunks with one identifier of 64 bytes")
        digest = min(64, 2 * digest)


def dedup(docs: DataFrame, digest: int = DIGEST, **names: str) -> DataFrame:
    """A row per document: doc_id, keep_id, group_size, kept, text_sha256, n_bytes, n_chunks."""
    lists, _ = recipes(docs, digest, **names)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first")
    groups = cut(lists.groupBy("recipe").agg(first, F.count("*").alias("group_size")).where("group_size > 1"))
    out = join_counted(lists, groups, "recipe", "group_size", lists.count())
    alone = F.col("first").isNull()
    return out.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
                      F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
                      (alone | (F.col("row") == F.col("first.row"))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
                      "n_bytes", F.size("recipe").cast("long").alias("n_chunks"))


def distinct_documents(docs: DataFrame, **names: str) -> DataFrame:
    """The rows of ``dedup`` that stay."""
    return dedup(docs, **names).where("kept")
