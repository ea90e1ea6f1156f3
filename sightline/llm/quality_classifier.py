"""Quality of documents by a byte-level convolutional network in numpy.

Learned filters of ``WIDTH`` bytes slide over the whole text. Their responses are max-pooled over overlapping chunks
of two segments of ``SEGMENT`` bytes each; a small layer turns the pooled responses of a chunk into features, and the
mean of the chunks' features gives one probability. The first layer is a table of bytes by place, so scoring is a few
gathers and sums per byte, and memory is bounded by the slice of text at hand, not by the text.

The network is trained on the driver on a bounded sample: up to ``SAMPLE`` rows of each label, those with the least
hashes among all that have a document, whatever its length. A text of more than ``TRAIN_BYTES`` bytes is learned from
``PIECES`` pieces that together have as many bytes, one from each equal part of the text at a place chosen by hash; each
piece is pooled by itself, and the mean is taken over the chunks of all. Rows whose crc32 of the document id modulo 4 is
2 are held out and never seen. The sample is balanced, so the log odds of the labels among all rows that may be learned
from are put back.

Null texts count as empty; these and other texts get a score from their padding alone. Ids play no part in a score, so
null ids, ties and repeated rows are scored row by row. Without labels of both kinds, or where no labelled row has a
document, scores are the share of label 1, or 1 without any; where only the rows of one kind have documents, ``fit``
raises. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import batches, cut, map_arrow, pick, text_hash, text_or_empty

WIDTH = 6
FILTERS = 40
HIDDEN = 12
SEGMENT = 256
SAMPLE = 1200
TRAIN_BYTES = 32_768
PIECES = 16
EPOCHS = 10
THRESHOLD = 0.7
SLICE = 1 << 17


def held_out(doc_id: str | Column) -> Column:
    """Rows that are never learned from; null ids are not among them."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string")) % 4 == 2, F.lit(False))


class Network:
    """Weights, and how to score and train with them."""

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.p = {
            "filters": rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32), "lift": np.zeros(FILTERS, np.float32),
            "mix": rng.normal(0, (2 / FILTERS) ** 0.5, (FILTERS, HIDDEN)).astype(np.float32), "shift": np.zeros(HIDDEN, np.float32),
            "out": rng.normal(0, (1 / HIDDEN) ** 0.5, HIDDEN).astype(np.float32), "bias": np.zeros(1, np.float32)}
        self.odds, self.fixed = 0.0, None

    def respond(self, raw: np.ndarray) -> np.ndarray:
        """Filter responses at every place of bytes padded with WIDTH - 1 zeros."""
        n, t = len(raw) - WIDTH + 1, self.p["filters"]
        out = t[0].take(raw[:n], axis=0)
        for k in range(1, WIDTH):
            out += t[k].take(raw[k:n + k], axis=0)
        return out

    def pooled(self, text: bytes) -> np.ndarray:
        """Maxima of the responses over each chunk of one text."""
        raw, tops = np.frombuffer(text + bytes(WIDTH - 1), np.uint8), []
        n = max(1, len(text))
        if not text:
            raw = np.zeros(WIDTH, np.uint8)
        for lo in range(0, n, SLICE):
            r = self.respond(raw[lo:min(n, lo + SLICE) + WIDTH - 1])
            tops.append(np.maximum.reduceat(r, np.arange(0, len(r), SEGMENT), axis=0))
        top = np.concatenate(tops)
        return np.maximum(top[:-1], top[1:]) if len(top) > 1 else top

    def features(self, pooled: np.ndarray) -> np.ndarray:
        h = np.maximum(pooled + self.p["lift"], 0)
        return np.maximum(h @ self.p["mix"] + self.p["shift"], 0)

    def logit(self, text: bytes) -> float:
        return float(self.features(self.pooled(text)).mean(0) @ self.p["out"] + self.p["bias"][0])

    def score(self, text: bytes) -> float:
        if self.fixed is not None:
            return self.fixed
        return 1 / (1 + np.exp(-np.clip(self.logit(text) + self.odds, -30, 30)))

    def _tops(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of one text, the maxima over each of its chunks and the place of each maximum."""
        n = max(1, len(text))
        raw = np.frombuffer(text + bytes(WIDTH - 1), np.uint8) if text else np.zeros(WIDTH, np.uint8)
        r = self.respond(raw[:n + WIDTH - 1])
        starts = np.arange(0, len(r), SEGMENT)
        where = np.stack([r[s:s + SEGMENT].argmax(0) + s for s in starts])
        top = np.take_along_axis(r, where, 0)
        if len(top) > 1:
            left = top[:-1] >= top[1:]
            top, where = np.where(left, top[:-1], top[1:]), np.where(left, where[:-1], where[1:])
        return raw, top, where

    def gradients(self, text: bytes | list[bytes], label: int, g: dict[str, np.ndarray]) -> None:
        """Adds the gradients of the loss of one text, or of pieces of one; the maxima pass theirs to one place each."""
        p, base = self.p, 0
        raws, tops, places = [], [], []
        for raw, top, where in map(self._tops, [text] if isinstance(text, bytes) else text):
            raws.append(raw)
            tops.append(top)
            places.append(where + base)
            base += len(raw)
        raw, top, where = np.concatenate(raws), np.concatenate(tops), np.concatenate(places)
        h = np.maximum(top + p["lift"], 0)
        f = np.maximum(h @ p["mix"] + p["shift"], 0)
        mean = f.mean(0)
        d = 1 / (1 + np.exp(-(mean @ p["out"] + p["bias"][0]))) - label
        g["out"] += d * mean
        g["bias"] += d
        df = (f > 0) * (d * p["out"] / len(f))
        g["mix"] += h.T @ df
        g["shift"] += df.sum(0)
        dh = (df @ p["mix"].T) * (h > 0)
        g["lift"] += dh.sum(0)
        each = np.broadcast_to(np.arange(FILTERS), where.shape)
        for k in range(WIDTH):
            np.add.at(g["filters"][k], (raw[where + k], each), dh)

    def train(self, texts: list[bytes | list[bytes]], labels: list[int], epochs: int = EPOCHS, batch: int = 16, rate: float = 0.01, seed: int = 7) -> None:
        """Adam over the sample, in an order fixed by the seed."""
        rng, steps = np.random.default_rng(seed), 0
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        total = epochs * -(-len(texts) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for lo in range(0, len(order), batch):
                g = {k: np.zeros_like(x) for k, x in self.p.items()}
                some = order[lo:lo + batch]
                for i in some:
                    self.gradients(texts[i], labels[i], g)
                steps += 1
                now = rate * (1 - steps / (total + 1))
                for k, x in self.p.items():
                    d = g[k] / len(some)
                    m[k] += 0.1 * (d - m[k])
                    v[k] += 0.01 * (d * d - v[k])
                    x -= now * (m[k] / (1 - 0.9 ** steps)) / (np.sqrt(v[k] / (1 - 0.99 ** steps)) + 1e-8)


def _pieces(text: Column, key: Column) -> Column:
    """The bytes of a text as an array: whole, or of a long one PIECES pieces spread over it."""
    raw, part, size = F.encode(text, "UTF-8"), F.floor(F.octet_length(text) / PIECES), TRAIN_BYTES // PIECES
    at = lambda k: (k * part + F.pmod(F.xxhash64(key, k), part - size + 1) + 1).cast("int")
    spread = F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), lambda k: F.substring(raw, at(k), F.lit(size)))
    return F.when(F.octet_length(text) > TRAIN_BYTES, spread).otherwise(F.array(raw))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Network:
    """A network trained on a bounded sample of the labelled rows that are not held out."""
    known = pick(labels, label_of=doc_id, label=label).where(~held_out("label_of")).where("label IN (0, 1) AND label_of IS NOT NULL").dropDuplicates(["label_of", "label"])
    seen = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    net = Network()
    if len(seen) < 2:
        net.fixed = float(next(iter(seen), 1))
        return net
    order = F.xxhash64("label_of")
    rows = pick(docs, doc_id=doc_id, text=text)
    there = known.join(rows.select(F.col("doc_id").alias("label_of")), "label_of", "left_semi")
    least = lambda k: there.where(F.col("label") == k).orderBy(order, "label_of").limit(sample)
    chosen = cut(least(0).unionAll(least(1)))
    joined = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("label_of")).select(
        "label", order.alias("h"), text_hash("text").alias("t"), _pieces(text_or_empty("text"), F.col("doc_id")).alias("pieces"))
    texts, marks = [], []
    for k in (0, 1):
        for r in joined.where(F.col("label") == k).orderBy("h", "t").limit(sample).collect():
            texts.append([bytes(x) for x in r["pieces"]])
            marks.append(k)
    if not marks:
        net.fixed = seen[1] / (seen[0] + seen[1])
        return net
    if len(set(marks)) < 2:
        raise ValueError(f"none of the {seen[1 - marks[0]]} rows of label {1 - marks[0]} has a document to learn from")
    net.train(texts, marks)
    n1 = sum(marks)
    net.odds = float(np.log(seen[1] / seen[0]) - np.log(n1 / (len(marks) - n1)))
    return net


def _score(rows: Iterator, shared, at: int, keep: int) -> Iterator:
    import pyarrow as pa

    net = shared.value
    for b in rows:
        texts, scores = b.column(at), []
        for lo, hi in batches(texts):
            scores += [float(net.score((t or "").encode())) for t in texts.slice(lo, hi - lo).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns[:keep], pa.array(scores, pa.float64())], names=[*b.schema.names[:keep], "score"])


def score(docs: DataFrame, net: Network, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) and ``score``; an equally named one is replaced."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != "score"]
    order = keep if text in keep else [*keep, text]
    rows = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(order)])
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes[:len(keep)]) + ", score double"
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a fixed size: the weights
    scored = map_arrow(rows, partial(_score, shared=shared, at=order.index(text), keep=len(keep)), schema.removeprefix(", "))
    return scored.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], "score")


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text",
             label: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    net = fit(docs, labels, sample, doc_id, text, label)
    scored = score(pick(docs, doc_id=doc_id, text=text), net, keep=["doc_id"]).select("doc_id", held_out("doc_id").alias("held_out"), "score")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
