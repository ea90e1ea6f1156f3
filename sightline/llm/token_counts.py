"""Token counts of whole documents; huge ones are encoded in overlapping chunks and spliced.

A document of up to ``chunk`` code points is encoded as it is. A longer one is cut every ``chunk`` code points; each
chunk reaches ``overlap`` code points over the cuts at both its ends, so that around every cut two encodings exist.
They are spliced where they are proven to agree: at a token that follows white space and starts at the same place in
both, with the same ids and places for ``AGREE`` tokens (or up to the end of the shorter run) on both sides. White
space ends every pre-token of the vocabularies this is meant for, so what stands before such a place can't change what
stands behind it. Documents with a cut where no such place exists are encoded again with an overlap four times as
wide, and in the last round whole. Chunks are rows of their own, spread over all tasks.

Null texts count as empty: no bytes, no tokens. Rows with equal or null ids are counted one by one. Equal long texts
are encoded once. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm.common import batches, cut, encoder, map_arrow, pick, text_or_empty

CHUNK = 32_768
OVERLAP = 512
AGREE = 8
LIMIT = 2048
EDGE = "array<struct<at:long,id:int,white:boolean,before:int>>"


def _count_short(rows: Iterator, vocabulary: str) -> Iterator:
    import pyarrow as pa

    enc = encoder(vocabulary)
    width = int(enc.dtype[-1])
    for b in rows:
        texts, counts = b.column(2), []
        for lo, hi in batches(texts):
            counts += [len(raw) // width for raw in enc.encode(texts.slice(lo, hi - lo).to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])


def _cut_chunks(rows: Iterator, chunk: int, overlap: int) -> Iterator:
    import pyarrow as pa

    names = ["key", "k", "last", "start", "cut", "piece"]
    for b in rows:
        for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            cuts = list(range(0, len(text), chunk)) or [0]
            for k, c in enumerate(cuts):
                start, last = max(0, c - overlap), k == len(cuts) - 1
                piece = text[start:] if last else text[start:c + chunk + overlap]
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (key, k, last, start, c, piece)], names=names)


def _edge(starts, ids, text: str, offset: int, lo: int, hi: int) -> list[dict]:
    """Tokens that start in [lo, hi) of the document, with the number of tokens of the chunk before each."""
    import numpy as np

    a, z = np.searchsorted(starts, [lo - offset, hi - offset])
    return [{"at": int(starts[i]) + offset, "id": int(ids[i]), "before": int(i),
             "white": starts[i] > 0 and text[starts[i] - 1] in " \t\n\v\f\r" and (i == 0 or starts[i - 1] < starts[i])} for i in range(a, z)]


def _encode_chunks(rows: Iterator, vocabulary: str, chunk: int, overlap: int) -> Iterator:
    import numpy as np
    import pyarrow as pa

    edge = pa.list_(pa.struct([("at", pa.int64()), ("id", pa.int32()), ("white", pa.bool_()), ("before", pa.int32())]))
    schema = pa.schema([("key", pa.string()), ("k", pa.int64()), ("last", pa.bool_()), ("n", pa.int64()), ("left", edge), ("right", edge)])
    tokenizer = encoder(vocabulary).tokenizer
    for b in rows:
        for key, k, last, start, c, piece in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
            e = tokenizer.encode(piece, add_special_tokens=False)
            starts, end = np.array([o[0] for o in e.offsets], np.int64), c + chunk
            yield pa.RecordBatch.from_pylist([{
                "key": key, "k": k, "last": last, "n": len(e.ids),
                "left": _edge(starts, e.ids, piece, start, c - overlap, c + overlap) if k else [],
                "right": [] if last else _edge(starts, e.ids, piece, start, end - overlap, end + overlap)}], schema=schema)


def _splice(rows: Iterator) -> Iterator:
    """Where the right edge of a chunk and the left edge of the next meet: tokens before that place in either."""
    import pyarrow as pa

    for b in rows:
        ends, skips = [], []
        for last, n, right, left in zip(*(b.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True):
            end, skip = (n, 0) if last else meet(right, left or [])
            ends.append(end)
            skips.append(skip)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ends, pa.int64()), pa.array(skips, pa.int64())],
                                         names=["key", "k", "stop", "skip"])


def meet(right: list[dict], left: list[dict], agree: int = AGREE) -> tuple[int | None, int | None]:
    """The splice nearest to the middle of the overlap, or (None, None) where the two encodings don't agree."""
    places = {t["at"]: i for i, t in reversed(list(enumerate(left)))}
    same = lambda x, y: x["at"] == y["at"] and x["id"] == y["id"]
    found = []
    for i, t in enumerate(right):
        j = places.get(t["at"]) if t["white"] else None
        if j is None or not left[j]["white"]:
            continue
        ahead, back = min(agree, len(right) - i, len(left) - j), min(agree, i, j)
        if ahead and all(same(right[i + d], left[j + d]) for d in range(ahead)) and all(same(right[i - d], left[j - d]) for d in range(1, back + 1)):
            found.append((abs(2 * i - len(right)), i, j))
    if not found:
        return None, None
    _, i, j = min(found)
    return right[i]["before"], left[j]["before"]


def _round(texts: DataFrame, vocabulary: str, chunk: int, overlap: int) -> DataFrame:
    """(key, n_tokens) of long texts; n_tokens is null where a cut could not be spliced."""
    chunks = map_arrow(texts, partial(_cut_chunks, chunk=chunk, overlap=overlap),
                              "key string, k long, last boolean, start long, cut long, piece string").repartition("key", "k")
    encoded = map_arrow(chunks, partial(_encode_chunks, vocabulary=vocabulary, chunk=chunk, overlap=overlap),
                                f"key string, k long, last boolean, n long, left {EDGE}, right {EDGE}")
    pairs = encoded.select("key", "k", "last", "n", "right", F.lead("left").over(Window.partitionBy("key").orderBy("k")).alias("next_left"))
    spliced = map_arrow(pairs, _splice, "key string, k long, stop long, skip long")
    return spliced.groupBy("key").agg(F.when(F.count("stop") == F.count("*"), F.sum("stop") - F.sum("skip")).alias("n_tokens"))


def count_long(texts: DataFrame, vocabulary: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(key, n_tokens) of a table (key, text) of long texts; keys are unique."""
    done: list[DataFrame] = []
    while True:
        whole = overlap >= chunk
        counted = cut(_round(texts, vocabulary, 1 << 62 if whole else chunk, 0 if whole else overlap))
        done.append(counted.where("n_tokens IS NOT NULL"))
        failed = counted.where("n_tokens IS NULL").select("key")
        if whole or failed.isEmpty():
            return reduce(DataFrame.unionAll, done)
        texts, overlap = texts.join(failed, "key", "left_semi"), 4 * overlap


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP,
                 doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""
    docs = pick(docs, doc_id=doc_id, text=text).select("doc_id", text_or_empty("text").alias("text")).select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    long = F.length("text") > chunk
    short = map_arrow(docs.where(~long), partial(_count_short, vocabulary=vocabulary), "doc_id long, n_bytes long, n_tokens long")
    keyed = docs.where(long).withColumn("key", F.sha2("text", 256))
    counted = count_long(keyed.select("key", "text").dropDuplicates(["key"]), vocabulary, chunk, overlap)
    spliced = keyed.select("doc_id", "n_bytes", "key").join(counted, "key").select("doc_id", "n_bytes", "n_tokens")
    return short.unionAll(spliced).withColumn("over_limit", F.col("n_tokens") > limit)
