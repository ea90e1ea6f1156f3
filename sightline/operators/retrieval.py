"""Descriptors and image retrieval: pooling, whitening, codebooks, the ASMK inverted index, similarity.

``desc(scene, img_id, feat_id, vec, attn)`` holds local descriptors, ``codebook(word, vec)`` the centroids.
The ASMK score follows Tolias et al. (2013, 2016): per shared word the binary residuals give
u = 1 − 2·hamming/d, a pair scores Σ u^α over words with u above the threshold, divided by the root of the
product of both images' word counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.functions.camera import normalise
from sightline.operators.ordered import best_first, cap_pairs, pair_partitions, row_number, salted_join, sum_vectors, top_k
from sightline.scale import broadcast_if_small, collect_bounded, cut, max_broadcast_bytes

ALPHA = 3.0  # exponent of the match kernel
BUILD_ASSIGN, QUERY_ASSIGN = 1, 5  # words per descriptor when indexing and when querying
MAX_DIM = 4096  # largest descriptor whose covariance the driver decomposes
TILE = 1024  # rows of one distance block
IMAGES = 2048  # images of a tile whose words are compared
SOME = 256  # of them at once
FOUND = 100_000  # found pairs whose codes are compared at once


def dimension(df: DataFrame, vec: str = "vec") -> int:
    row = df.select(F.size(vec).alias("d")).first()
    return 0 if row is None else int(row["d"])


# ------------------------------------------------------------------ pooling and whitening
def select_local(desc: DataFrame, nfeat: float, by: Sequence[str] = ("scene", "img_id")) -> DataFrame:
    """The ``nfeat`` descriptors of highest attention per image; −0.25 keeps a quarter of them."""
    if nfeat >= 0:
        return top_k(desc, by, [best_first("attn"), F.col("feat_id")], int(nfeat))
    ranked = row_number(desc.withColumn("_neg", best_first("attn")), by, ["_neg", "feat_id"], "_rn")
    sizes = desc.groupBy(*by).agg(F.floor(F.lit(-float(nfeat)) * F.count("*")).alias("_keep"))
    return ranked.join(sizes, list(by)).where(F.col("_rn") <= F.col("_keep")).drop("_neg", "_rn", "_keep")


def sample_features(desc: DataFrame, cap: int, by: Sequence[str] = ("scene", "img_id")) -> DataFrame:
    """A reproducible random ``cap`` descriptors per image, chosen by hash of the id."""
    key = F.sha2(F.concat_ws("|", *by, "feat_id"), 256)
    return top_k(desc.withColumn("_h", key), by, [F.col("_h"), F.col("feat_id")], cap).drop("_h")


def spoc(desc: DataFrame, dim: int | None = None, by: Sequence[str] = ("scene", "img_id")) -> DataFrame:
    """One L2-normalised, attention-weighted sum of local descriptors per image."""
    dim = dim or dimension(desc)
    weighted = F.transform("vec", lambda v: v * F.col("attn"))
    return sum_vectors(desc, by, weighted, dim).withColumn("vec", normalise(F.col("vec")))


def fit_whitening(desc: DataFrame, shrinkage: float = 1.0, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection of PCA whitening with shrinkage.

    Each task reduces its rows to one Gram matrix with numpy; the matrices are summed by row index in
    Spark, and only the d × d sum reaches the driver.
    """
    dim = dim or dimension(desc)
    if dim > MAX_DIM:
        raise ValueError(f"dimension {dim} is above {MAX_DIM}")

    def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dim + 1, dim + 1))
        for pdf in batches:
            if len(pdf):
                x = np.hstack([np.stack(pdf["vec"].to_numpy()).astype(float), np.ones((len(pdf), 1))])
                total += x.T @ x
        yield pd.DataFrame({"row": np.arange(dim + 1), "vec": list(total)})

    # few tasks, each reading many rows: every task hands on a whole matrix
    rows = desc.select(F.col("vec").cast("array<double>").alias("vec")).coalesce(4 * desc.sparkSession.sparkContext.defaultParallelism)
    parts = rows.mapInPandas(gram, "row long, vec array<double>")
    rows = sorted(collect_bounded(sum_vectors(parts, ["row"], F.col("vec"), dim + 1), dim + 1, "Gram matrix"),
                  key=lambda r: r["row"])
    g = np.array([r["vec"] for r in rows])
    n = g[dim, dim]
    mean = g[dim, :dim] / n
    cov = g[:dim, :dim] / n - np.outer(mean, mean)
    val, vec = np.linalg.eigh((cov + cov.T) / 2)
    order = np.argsort(val)[::-1]
    val, vec = np.maximum(val[order], 1e-14), vec[:, order]
    return mean, vec * val ** (-0.5 * shrinkage)


def whiten(df: DataFrame, mean: np.ndarray, proj: np.ndarray, vec: str = "vec", l2: bool = False) -> DataFrame:
    """(x − mean)·P on a whole Arrow batch at a time."""
    @F.pandas_udf("array<double>")
    def apply(s: pd.Series) -> pd.Series:
        if s.empty:
            return s
        return pd.Series(list((np.stack(s.to_numpy()) - mean) @ proj), index=s.index)

    out = apply(F.col(vec).cast("array<double>"))
    return df.withColumn(vec, normalise(out) if l2 else out)


# ------------------------------------------------------------------ codebook
def _least(d: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k least values of each row; of equal values the first columns."""
    if k == 1:
        return d.argmin(1)[:, None]
    if k >= d.shape[1]:
        return np.tile(np.arange(k), (len(d), 1))
    pick = np.argpartition(d, k - 1, axis=1)[:, :k]
    last = np.take_along_axis(d, pick, 1).max(1)
    for row in np.flatnonzero((d <= last[:, None]).sum(1) > k):  # more equal values than places
        pick[row] = np.argsort(d[row], kind="stable")[:k]
    return pick


def _nearest(keys: list[str], words: np.ndarray, centres: np.ndarray, k: int) -> Callable:
    k = min(k, len(words))
    half = (centres ** 2).sum(1) / 2

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), TILE):
                part = pdf.iloc[at:at + TILE]
                x = np.stack(part["vec"].to_numpy()).astype(float)
                d = half[None, :] - x @ centres.T  # distance up to a constant per row
                pick = _least(d, k)
                rows = np.repeat(np.arange(len(part)), k)
                out = part[[*keys, "vec"]].iloc[rows].reset_index(drop=True)
                cols = pick.ravel()
                out["word"] = words[cols]
                out["dist"] = np.sqrt(np.maximum(2 * d[rows, cols] + (x ** 2).sum(1)[rows], 0))
                yield out

    return assign


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x ** 2).sum(1)[:, None] + (y ** 2).sum(1)[None, :] - 2 * x @ y.T, 0))


def _by_nearness(points: np.ndarray, ids: np.ndarray, leaf: int = 2) -> list[int]:
    """``ids`` in an order that keeps near points together: halves along the line to a far point, again and again."""
    if len(ids) <= leaf:
        return ids.tolist()
    x = points[ids]
    one = ((x - x[0]) ** 2).sum(1).argmax()
    other = ((x - x[one]) ** 2).sum(1).argmax()
    at = np.argsort(x @ (x[other] - x[one]), kind="stable")
    half = len(ids) // 2
    return _by_nearness(points, ids[at[:half]], leaf) + _by_nearness(points, ids[at[half:]], leaf)


class PivotTree:
    """Two levels over a large codebook: slices, which travel to the descriptors, hold cells of near words.

    Pivots are words themselves. A word belongs to the cell of its nearest pivot and lies between ``low`` and ``high``
    from it. Neighbouring cells share a slice of about ``limit`` words; a cell above that is spread over several.
    """

    def __init__(self, pivots: np.ndarray, low: np.ndarray, high: np.ndarray, count: np.ndarray, limit: int) -> None:
        self.pivots, self.low, self.high, self.count = pivots, low, high, count
        self.between = _distances(pivots, pivots)
        self.first, self.parts = np.zeros(len(pivots), int), np.ones(len(pivots), int)
        at, room = 0, limit
        for c in _by_nearness(pivots, np.arange(len(pivots))):
            if count[c] > room and room < limit:
                at, room = at + 1, limit
            self.first[c], self.parts[c] = at, max(1, -(-int(count[c]) // limit))
            at, room = (at, room - count[c]) if count[c] <= limit else (at + self.parts[c], limit)

    def home(self, x: np.ndarray) -> np.ndarray:
        """The cell each row is looked for first."""
        return np.where(self.count > 0, _distances(x, self.pivots), np.inf).argmin(1)

    def may_hold(self, x: np.ndarray, within: np.ndarray, k: int) -> np.ndarray:
        """Cells that may hold one of the k nearest words of each row, of which k are known ``within`` a distance.

        By the triangle inequality no word of a cell is nearer than d - high or low - d, with d from row to pivot, and
        none is nearer than the plane between its pivot and the row's nearest pivot. Rounding gets some slack.
        """
        d = _distances(x, self.pivots)
        if k <= len(self.pivots):
            within = np.minimum(within, np.partition(d, k - 1, axis=1)[:, k - 1])
        near = d.argmin(1)
        gap = self.between[near]
        plane = np.where(gap > 0, (d ** 2 - d.min(1)[:, None] ** 2) / np.where(gap > 0, 2 * gap, 1), 0)
        bound = np.maximum(np.maximum(d - self.high, self.low - d), plane)
        slack = 1e-6 * (1 + np.sqrt((x ** 2).sum(1)) + np.sqrt((self.pivots ** 2).sum(1)).max())
        return (self.count > 0) & (bound <= (within + slack)[:, None])


def pivot_tree(book: DataFrame, limit: int) -> tuple[PivotTree, DataFrame]:
    """The tree of ``book(word, vec)`` and its words with cell and slice: word, vec, cell, slice.

    Some sixteen pivots a slice, at most ``limit`` and 4096, are the words of least hash; they and two distances per
    cell are all that reaches the driver.
    """
    n = book.count()
    want = max(2, min(4096, 16 * -(-n // limit), limit))
    got = book.orderBy(F.xxhash64("word", "vec"), "word").limit(want).collect()
    pivots = np.unique(np.array([r["vec"] for r in got]), axis=0)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), TILE):
                part = pdf.iloc[at:at + TILE]
                d = _distances(np.stack(part["vec"].to_numpy()).astype(float), pivots)
                yield part.assign(cell=d.argmin(1), r=d.min(1))

    words = cut(book.mapInPandas(place, "word long, vec array<double>, cell long, r double"))
    low, high, count = np.zeros(len(pivots)), np.zeros(len(pivots)), np.zeros(len(pivots), int)
    for r in words.groupBy("cell").agg(F.min("r").alias("low"), F.max("r").alias("high"), F.count("*").alias("n")).collect():
        low[r["cell"]], high[r["cell"]], count[r["cell"]] = r["low"], r["high"], r["n"]
    tree = PivotTree(pivots, low, high, count, limit)
    places = book.sparkSession.createDataFrame([(c, int(f), int(p)) for c, (f, p) in enumerate(zip(tree.first, tree.parts))],
                                               "cell long, first long, parts long")
    placed = words.join(F.broadcast(places), "cell").withColumn("slice", F.col("first") + F.pmod(F.hash("word"), F.col("parts")))
    return tree, placed.select("word", "vec", "cell", "slice")


def route(rows: DataFrame, tree: PivotTree, k: int, known: bool) -> DataFrame:
    """One row per descriptor and slice to be searched, with the cells there.

    Without ``known`` that is the home cell alone (of a spread cell its first slice). With it, rows bring ``tau``, the
    distance within which k words are known, and go to what else may hold nearer ones.
    """
    schema = T.StructType([f for f in rows.schema.fields if f.name != "tau"] + [T.StructField("slice", T.LongType()),
                                                                                 T.StructField("cells", T.ArrayType(T.LongType()))])

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), TILE):
                part = pdf.iloc[lo:lo + TILE].reset_index(drop=True)
                x = np.stack(part["vec"].to_numpy()).astype(float)
                home = tree.home(x)
                if not known:
                    yield part.assign(slice=tree.first[home], cells=[[c] for c in home])
                    continue
                row, cell = np.nonzero(tree.may_hold(x, part.pop("tau").to_numpy(), k))
                times = tree.parts[cell]
                row, cell = np.repeat(row, times), np.repeat(cell, times)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                seen = (home[row] == cell) & (nth == 0)
                todo = pd.DataFrame({"row": row, "slice": tree.first[cell] + nth, "cell": cell})[~seen]
                todo = todo.groupby(["row", "slice"])["cell"].agg(list).reset_index()
                yield part.iloc[todo["row"]].reset_index(drop=True).assign(slice=todo["slice"], cells=todo["cell"])

    return rows.mapInPandas(send, schema)


def _search(routed: DataFrame, words: DataFrame, keys: list[str], fields: list[T.StructField], k: int, groups: int) -> DataFrame:
    """The k nearest words of each routed row in its cells of its slice; ``tau`` is the k-th distance, on one of the rows."""
    schema = T.StructType([*fields, T.StructField("tau", T.DoubleType()), T.StructField("lead", T.BooleanType())])
    left = routed.withColumn("_g", F.pmod(F.xxhash64(*keys), F.lit(groups)))
    right = words.withColumn("_rg", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))

    def meet(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({f.name: pd.Series(dtype=object) for f in schema.fields})
        a["_row"] = np.arange(len(a))
        row, cell = np.repeat(a["_row"].to_numpy(), a["cells"].map(len)), np.concatenate(a["cells"].to_numpy())
        found = []
        for c, g in b.sort_values("word").groupby("cell"):
            fn = _nearest([*keys, "_row"], g["word"].to_numpy(), np.stack(g["vec"].to_numpy()), k)
            found.extend(fn(iter([a.iloc[row[cell == c]]])))
        out = pd.concat(found, ignore_index=True).sort_values(["_row", "dist", "word"])
        nth = out.groupby("_row").cumcount()
        out, nth = out[nth < k], nth[nth < k]
        full = out.groupby("_row")["dist"].transform("size") == k
        out["tau"] = np.where(full, out.groupby("_row")["dist"].transform("max"), np.inf)
        out["lead"] = nth == 0
        return out[[f.name for f in schema.fields]]

    return left.groupBy("_g", "slice").cogroup(right.groupBy("_rg", "slice")).applyInPandas(meet, schema)


def quantise(desc: DataFrame, codebook: DataFrame, k: int = 1, keys: Sequence[str] = ("scene", "img_id", "feat_id"),
             slice_words: int | None = None) -> DataFrame:
    """The k nearest words of each descriptor by exact L2 distance: keys, vec, word, dist.

    A codebook of at most ``slice_words`` words (default: what the broadcast limit holds) is shipped to every task and
    compared by matrix product. A larger one is searched through a ``PivotTree``: each descriptor meets its home cell, and
    then only the slices and cells that its distances to the pivots can't rule out. ``keys`` must be unique there.
    """
    keys = list(keys)
    dim = dimension(codebook)
    fields = [desc.schema[c] for c in keys] + [T.StructField("vec", T.ArrayType(T.DoubleType())),
                                               T.StructField("word", T.LongType()), T.StructField("dist", T.DoubleType())]
    rows = desc.select(*keys, F.col("vec").cast("array<double>").alias("vec"))
    limit = slice_words or max(1, max_broadcast_bytes(desc.sparkSession) // (8 * max(dim, 1)))
    book = codebook.select(F.col("word").cast("long").alias("word"), F.col("vec").cast("array<double>").alias("vec"))
    if book.count() <= limit:
        got = sorted(collect_bounded(book, limit, "codebook"), key=lambda r: r["word"])
        words, centres = np.array([r["word"] for r in got]), np.array([r["vec"] for r in got])
        return rows.mapInPandas(_nearest(keys, words, centres, k), T.StructType(fields))
    tree, words = pivot_tree(book, limit)
    groups = pair_partitions(desc)
    near = cut(_search(route(rows, tree, k, False), words, keys, fields, k, groups))
    more = _search(route(near.where("lead").select(*keys, "vec", "tau"), tree, k, True), words, keys, fields, k, groups)
    return top_k(near.unionByName(more).drop("tau", "lead"), keys, [F.col("dist"), F.col("word")], k)


@F.pandas_udf(T.ArrayType(T.LongType()))
def residual_signs(total: pd.Series, centre: pd.Series) -> pd.Series:
    """Signs of Σx − n·c as longs of 32 bits; ``total`` holds Σx followed by n."""
    if total.empty:
        return total
    t, c = np.stack(total.to_numpy()), np.stack(centre.to_numpy())
    bits = t[:, :-1] - t[:, -1:] * c > 0
    bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 32)))
    words = np.packbits(bits, axis=1, bitorder="little").view("<u4").astype(np.int64)
    return pd.Series(list(words), index=total.index)


def asmk_aggregate(desc: DataFrame, codebook: DataFrame, k: int = BUILD_ASSIGN) -> DataFrame:
    """(scene, img_id, word, bits): sign bits of the summed residuals of an image at a word."""
    dim = dimension(codebook)
    near = quantise(desc, codebook, k)
    sums = sum_vectors(near.withColumn("_one", F.lit(1.0)), ["scene", "img_id", "word"],
                       F.concat("vec", F.array("_one")), dim + 1)
    book = codebook.select(F.col("word").cast("long").alias("word"), F.col("vec").cast("array<double>").alias("_c"))
    return sums.join(book, "word").select("scene", "img_id", "word", residual_signs("vec", "_c").alias("bits"))


def _kernel(both: DataFrame, nq: DataFrame, nd: DataFrame, dim: int, alpha: float, thr: float, past_only: bool) -> DataFrame:
    """Scores from rows that share a word: scene, i, j and both images' bits."""
    if past_only:
        both = both.where(F.col("j") < F.col("i"))
    ham = F.aggregate(F.zip_with("_bq", "_bd", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, v: s + v)
    u = 1 - 2 * ham / dim
    hits = both.select("scene", "i", "j", u.alias("u")).where(F.col("u") > thr)
    total = hits.groupBy("scene", "i", "j").agg(F.sum(F.pow("u", F.lit(alpha))).alias("_s"))
    return (total.join(nq, ["scene", "i"]).join(nd, ["scene", "j"])
            .select("scene", "i", "j", (F.col("_s") / F.sqrt(F.col("_nq") * F.col("_nd"))).alias("s")))


def _word_counts(rows: DataFrame, image: str, count: str) -> DataFrame:
    return rows.groupBy("scene", F.col("img_id").alias(image)).agg(F.count("*").alias(count))


def asmk_scores(query: DataFrame, index: DataFrame, dim: int, alpha: float = ALPHA, thr: float = 0.0,
                past_only: bool = False) -> DataFrame:
    """(scene, i, j, s): score of indexed image j for query image i, over their shared words.

    Images meet through words only; frequent words are salted on both sides. Where images share a word or more on average,
    tiles of images meet instead, and a pair of images is a cell of a task. Pairs without a positive word have no row,
    which stands for zero.
    """
    if thr >= 0 and _share_words(query, index):
        return _scores_by_tiles(query, index, dim, alpha, thr, past_only)
    q = query.select("scene", "word", F.col("img_id").alias("i"), F.col("bits").alias("_bq"))
    d = index.select("scene", "word", F.col("img_id").alias("j"), F.col("bits").alias("_bd"))
    both = salted_join(q, d, ["scene", "word"])
    return _kernel(both, _word_counts(query, "i", "_nq"), _word_counts(index, "j", "_nd"), dim, alpha, thr, past_only)


def _share_words(query: DataFrame, index: DataFrame) -> bool:
    """Whether there are as many meetings of images at words as pairs of images, and all codes are of one length."""
    lengths = [df.agg(F.min(F.size("bits")).alias("lo"), F.max(F.size("bits")).alias("hi"),
                      F.count_if(F.col("bits").isNull() | F.exists("bits", lambda b: b.isNull())).alias("odd")).first() for df in (query, index)]
    if any(r["lo"] is None or r["odd"] for r in lengths) or len({x for r in lengths for x in (r["lo"], r["hi"])}) > 1:
        return False

    def total(by: list[str], count: Column) -> float:
        a, b = (df.groupBy(*by).agg(count.cast("double").alias(n)) for df, n in ((query, "a"), (index, "b")))
        return a.join(b, by).agg(F.sum(F.col("a") * F.col("b")).alias("t")).first()["t"] or 0.0

    return total(["scene", "word"], F.count("*")) >= max(total(["scene"], F.count_distinct("img_id")), 1.0)


def _by_word(rows: pd.DataFrame, image: str, presence: int) -> tuple[np.ndarray, np.ndarray, dict, dict]:
    """(images, their numbers of rows, rows of a word as (image, signs), signs of all images at words that half of them have).

    Two more columns push a product with an image that lacks the word out of the range of codes that meet.
    """
    images, at = np.unique(rows[image].to_numpy(), return_inverse=True)
    count, known = np.bincount(at), rows["word"].notna().to_numpy()
    rows, at = rows[known], at[known]
    if rows.empty:
        return images, count, {}, {}
    codes = np.stack(rows["bits"].to_numpy()).astype("<u4")
    signs = np.unpackbits(codes.view(np.uint8), axis=1, bitorder="little").astype(np.float32) * 2 - 1
    n, words, whole = signs.shape[1], {}, {}
    order = np.argsort(rows["word"].to_numpy(), kind="stable")
    word = rows["word"].to_numpy()[order]
    starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    for lo, hi in zip(starts, np.append(starts[1:], len(word))):
        r = order[lo:hi]
        words[word[lo]] = at[r], signs[r]
        if 2 * len(r) >= len(images) and len(np.unique(at[r])) == len(r):
            all_of = np.zeros((len(images), n + 2), np.float32)
            all_of[:, n + presence] = -2 * n
            all_of[:, n + 1 - presence] = 1
            all_of[at[r], :n], all_of[at[r], n + presence] = signs[r], 0
            whole[word[lo]] = all_of
    return images, count, words, whole


def _scores_by_tiles(query: DataFrame, index: DataFrame, dim: int, alpha: float, thr: float, past_only: bool, tile: int = IMAGES) -> DataFrame:
    """``asmk_scores`` by tiles of images with all their words: what moves is codes, once per tile met, and no pair of images."""
    def tiles(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("scene").agg(F.ceil(F.count_distinct("img_id") / tile).cast("int").alias(name))

    parts = 4 * pair_partitions(query)
    sizes = broadcast_if_small(cut(tiles(query, "_nq").join(tiles(index, "_nd"), "scene")))
    keys = ["scene", "_a", "_b"]

    def side(df: DataFrame, image: str, mine: str, other: str, a: str, b: str) -> DataFrame:
        rows = df.where("img_id is not null").join(sizes, "scene").withColumn(a, F.pmod(F.hash("img_id"), mine))
        return rows.withColumn(b, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).select(*keys, F.col("img_id").alias(image), "word", "bits")

    left = side(query, "i", "_nq", "_nd", "_a", "_b").repartition(parts, *keys)
    right = side(index, "j", "_nd", "_nq", "_b", "_a").select(*[F.col(c).alias(f"_of_{c}") for c in keys], "j", "word", "bits").repartition(
        parts, *[f"_of_{c}" for c in keys])
    schema = T.StructType([query.schema["scene"], T.StructField("i", query.schema["img_id"].dataType),
                           T.StructField("j", index.schema["img_id"].dataType), T.StructField("s", T.DoubleType())])

    def meet(key: tuple, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return pd.DataFrame({f.name: pd.Series(dtype=object) for f in schema.fields})
        i, nq, words, whole = _by_word(x, "i", 0)
        j, nd, other, across = _by_word(y, "j", 1)
        n = 32 * len(x["bits"].iloc[0])
        u = 1 - 2 * np.arange(n + 1) / dim
        worth = np.zeros(3 * n + 1)  # of a pair of codes by the bits that differ
        worth[:n + 1][u > thr] = u[u > thr] ** alpha
        value = lambda a, b: worth.take(((n - a @ b.T) / 2).astype(np.int32))
        found = []
        for lo in range(0, len(i), SOME):
            total = np.zeros((min(SOME, len(i) - lo), len(j)))
            for w in words.keys() & other.keys():
                if w in whole and w in across:
                    total += value(whole[w][lo:lo + SOME], across[w])
                else:
                    at, signs = words[w]
                    here = (at >= lo) & (at < lo + SOME)
                    np.add.at(total, np.ix_(at[here] - lo, other[w][0]), value(signs[here], other[w][1]))
            r, c = np.nonzero(total > 0 if not past_only else (total > 0) & (j[None, :] < i[lo:lo + SOME, None]))
            found.append((i[lo + r], j[c], total[r, c] / np.sqrt(nq[lo + r] * nd[c])))
        a, b, s = (np.concatenate(v) for v in zip(*found))
        return pd.DataFrame({"scene": key[0], "i": a, "j": b, "s": s})

    return left.groupBy(*keys).cogroup(right.groupBy(*[f"_of_{c}" for c in keys])).applyInPandas(meet, schema)


def save_index(index: DataFrame, name: str, buckets: int, frequent: int = 65_536) -> None:
    """The index as tables of the catalog: ``name`` bucketed by word, ``name_frequent`` and ``name_images``.

    Words with more than ``frequent`` images in a scene would make one bucket long; they stand apart, spread by image.
    ``name_images`` holds the words per image, so that a query needn't count the index again.
    """
    spark = index.sparkSession
    index = cut(index.select("scene", "img_id", "word", "bits"))
    often = cut(index.groupBy("scene", "word").count().where(F.col("count") > frequent).select("scene", "word"))
    few = index.join(often, ["scene", "word"], "left_anti").select(index.columns)
    few.repartition(buckets, "scene", "word").write.mode("overwrite").bucketBy(buckets, "scene", "word").sortBy("scene", "word").saveAsTable(name)
    many = index.join(often, ["scene", "word"], "left_semi").select(index.columns)
    many.write.mode("overwrite").saveAsTable(f"{name}_frequent")
    sizes = _word_counts(index, "j", "_nd")
    sizes.repartition(buckets, "scene", "j").write.mode("overwrite").bucketBy(buckets, "scene", "j").sortBy("scene", "j").saveAsTable(f"{name}_images")
    spark.catalog.refreshTable(name)


def scores_of_saved(query: DataFrame, name: str, dim: int, alpha: float = ALPHA, thr: float = 0.0, past_only: bool = False) -> DataFrame:
    """``asmk_scores`` against a saved index: only the query's rows are shuffled, to the buckets of their words."""
    spark = query.sparkSession
    query = cut(query)
    q = query.select("scene", "word", F.col("img_id").alias("i"), F.col("bits").alias("_bq"))

    def side(table: str) -> DataFrame:
        return spark.table(table).select("scene", "word", F.col("img_id").alias("j"), F.col("bits").alias("_bd"))

    both = q.join(side(name).hint("merge"), ["scene", "word"])
    often = side(f"{name}_frequent")
    if not often.isEmpty():
        both = both.unionByName(salted_join(q, often, ["scene", "word"]))
    return _kernel(both, _word_counts(query, "i", "_nq"), spark.table(f"{name}_images"), dim, alpha, thr, past_only)


# ------------------------------------------------------------------ similarity
def _tiles(left: DataFrame, right: DataFrame, by: list[str], lid: list[str], rid: list[str], tile: int,
           keep: Callable[[np.ndarray, pd.DataFrame, pd.DataFrame], tuple[np.ndarray, np.ndarray]], carry: Sequence[str] = ()) -> DataFrame:
    """Tile-wise products of the vectors of two tables: ids of the kept cells and their cosine ``s``.

    Rows of a group are hashed into tiles of about ``tile`` rows; each pair of tiles is one small task that
    multiplies two matrices and emits only the cells that ``keep`` names; it also sees the columns ``carry`` of both.
    """
    def sized(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*by).agg(F.ceil(F.count("*") / tile).cast("int").alias(name))

    sizes = sized(left, "_nl").join(sized(right, "_nr"), by)
    unit = normalise(F.col("vec").cast("array<double>"))
    a = (left.join(sizes, by).withColumn("_a", F.pmod(F.hash(*lid), "_nl"))
         .withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_nr") - 1))).select(*by, "_a", "_b", *lid, *carry, unit.alias("vec")))
    b = (right.join(sizes, by).withColumn("_b", F.pmod(F.hash(*rid), "_nr"))
         .withColumn("_a", F.explode(F.sequence(F.lit(0), F.col("_nl") - 1)))
         .select(*[F.col(c).alias(f"_g_{c}") for c in (*by, "_a", "_b")], *[F.col(c).alias(c) for c in (*rid, *carry)], unit.alias("vec")))
    schema = T.StructType([*[left.schema[c] for c in by], *[left.schema[c] for c in lid],
                           *[right.schema[c] for c in rid], T.StructField("s", T.DoubleType())])

    def multiply(key: tuple, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        cols = [f.name for f in schema.fields]
        if x.empty or y.empty:
            return pd.DataFrame({c: pd.Series(dtype=object) for c in cols})
        x, y = x.sort_values(lid).reset_index(drop=True), y.sort_values(rid).reset_index(drop=True)
        s = np.clip(np.stack(x["vec"].to_numpy()) @ np.stack(y["vec"].to_numpy()).T, -1, 1)
        rows, at = keep(s, x, y)
        out = pd.concat([x[[*by, *lid]].iloc[rows].reset_index(drop=True), y[rid].iloc[at].reset_index(drop=True)], axis=1)
        out["s"] = s[rows, at]
        return out[cols]

    return a.groupBy(*by, "_a", "_b").cogroup(b.groupBy(*[f"_g_{c}" for c in (*by, "_a", "_b")])).applyInPandas(multiply, schema)


def top_similar(glob: DataFrame, k: int, past_only: bool = True, tile: int = 2048) -> DataFrame:
    """(scene, i, j, s): the k images most similar to each image by cosine of one vector per image.

    Each pair of tiles keeps k cells per row, so the full similarity matrix is never written.
    """
    left = glob.select("scene", F.col("img_id").alias("i"), "vec")
    right = glob.select("scene", F.col("img_id").alias("j"), "vec")

    def keep(s: np.ndarray, x: pd.DataFrame, y: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        i, j = x["i"].to_numpy()[:, None], y["j"].to_numpy()[None, :]
        allowed = (j < i) if past_only else (j != i)
        masked = np.where(allowed, s, -np.inf)
        order = np.argsort(-masked, axis=1, kind="stable")[:, :k]
        rows = np.repeat(np.arange(len(x)), order.shape[1])
        cols = order.ravel()
        ok = np.isfinite(masked[rows, cols])
        return rows[ok], cols[ok]

    best = _tiles(left, right, ["scene"], ["i"], ["j"], tile, keep)
    return top_k(best, ["scene", "i"], [F.col("s").desc(), F.col("j")], k)


def past_similar(glob: DataFrame, k: int, queries: DataFrame | None = None, tile: int = 2048) -> tuple[DataFrame, DataFrame]:
    """(scene, i, j, s) with the k past images most similar to each image by cosine, and (scene, low), the least cosine met.

    One pass of tile-wise products gives both: a pair of tiles keeps k cells per row and its least cell. ``queries``
    (scene, i) limits the images asked for; ``low`` then only covers theirs.
    """
    left = glob.select("scene", F.col("img_id").alias("i"), "vec")
    right = glob.select("scene", F.col("img_id").alias("j"), "vec")
    if queries is not None:
        left = left.join(queries.select("scene", "i"), ["scene", "i"], "left_semi")

    def keep(s: np.ndarray, x: pd.DataFrame, y: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        past = y["j"].to_numpy()[None, :] < x["i"].to_numpy()[:, None]
        masked = np.where(past, s, -np.inf)
        order = np.argsort(-masked, axis=1, kind="stable")[:, :k]
        chosen = np.zeros_like(past)
        np.put_along_axis(chosen, order, True, axis=1)
        chosen.ravel()[np.where(past, s, np.inf).argmin()] = True
        return np.nonzero(chosen & past)

    kept = cut(_tiles(left, right, ["scene"], ["i"], ["j"], tile, keep))
    return top_k(kept, ["scene", "i"], [F.col("s").desc(), F.col("j")], k), kept.groupBy("scene").agg(F.min("s").alias("low"))


def similar_patches(patches: DataFrame, pairs: DataFrame, thr: float | None = None, cap: int | None = None,
                    tile: int = 2048) -> DataFrame:
    """(scene, i, j, a, b, s): patch pairs of the listed image pairs whose absolute cosine exceeds ``thr``.

    The default threshold is 3/√d. ``cap`` keeps the best pairs of each image pair.
    """
    thr = 3 / dimension(patches) ** 0.5 if thr is None else thr
    left = pairs.select("scene", "i", "j").join(
        patches.select("scene", F.col("img_id").alias("i"), F.col("patch").alias("a"), "vec"), ["scene", "i"])
    right = pairs.select("scene", "i", "j").join(
        patches.select("scene", F.col("img_id").alias("j"), F.col("patch").alias("b"), "vec"), ["scene", "j"])

    def keep(s: np.ndarray, x: pd.DataFrame, y: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        return np.nonzero(np.abs(s) > thr)

    found = _tiles(left, right.select(*left.columns[:3], "b", "vec"), ["scene", "i", "j"], ["a"], ["b"], tile, keep)
    found = found.withColumn("s", F.abs("s"))
    return found if cap is None else cap_pairs(found, ["scene", "i", "j"], "s", ["a", "b"], cap)


def hash_bands(thr: float, recall: float, bits: int) -> int:
    """Bands of ``bits`` signs each that let a pair of absolute cosine ``thr`` meet with probability ``recall``.

    A random hyperplane gives both vectors the same sign with probability 1 − angle/π. All signs of a band must
    agree, or all must differ, since the sign of the cosine does not count.
    """
    p = 1 - np.arccos(np.clip(thr, 0, 1)) / np.pi
    hit = p ** bits + (1 - p) ** bits
    return 1 if hit >= 1 else max(1, int(np.ceil(np.log1p(-recall) / np.log1p(-hit))))


def sign_codes(vec: Column, dim: int, bits: int, bands: int, seed: int = 7) -> Column:
    """Array of ``bands`` integers: signs of products with random hyperplanes, the same for a vector and its negative."""
    @F.pandas_udf("array<long>")
    def codes(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        planes = np.random.default_rng(seed).normal(size=(dim, bands * bits))
        power = 1 << np.arange(bits, dtype=np.int64)
        for part in parts:
            if part.empty:
                yield pd.Series([], dtype=object)
                continue
            sign = (np.stack(part.to_numpy()) @ planes > 0).reshape(len(part), bands, bits)
            code = (sign ^ sign[:, :, -1:]) @ power  # the last sign becomes 0
            yield pd.Series(list(code))
    return codes(vec.cast("array<double>"))


def similar_patches_hashed(patches: DataFrame, pairs: DataFrame, thr: float, cap: int | None = None, recall: float = 0.99,
                           bits: int = 8, seed: int = 7) -> DataFrame:
    """``similar_patches`` through random-hyperplane hashing, for thresholds high enough to prune.

    Patches meet where a band of signs agrees; large buckets are cut into tiles, none is capped. Every met pair is
    checked on its vectors, so nothing wrong is returned, and a pair at the threshold is met with probability
    ``recall``, one above it with a higher one. A patch brings its vector and codes to each of its bands, and met pairs are
    checked where they meet: what is shuffled is patches times bands, and of the pairs only those found, each in the first
    band it agrees in. Where so many bands are needed that most pairs would meet anyway, the exact tile-wise form runs
    instead. Zero vectors are similar to nothing.
    """
    dim, bands = dimension(patches), hash_bands(thr, recall, bits)
    if dim == 0 or 2 * bands > 1 << (bits - 1):
        return similar_patches(patches, pairs, thr, cap)
    coded = cut(patches.select("scene", "img_id", "patch", "vec", sign_codes(F.col("vec"), dim, bits, bands, seed).alias("codes")))
    pairs = pairs.select("scene", "i", "j").distinct()
    keys = ["scene", "i", "j", "band", "code"]

    def side(img: str, patch: str) -> DataFrame:
        rows = pairs.join(coded.withColumnsRenamed({"img_id": img, "patch": patch}), ["scene", img])
        return rows.select("scene", "i", "j", patch, "vec", "codes", F.posexplode("codes").alias("band", "code"))

    def keep(s: np.ndarray, x: pd.DataFrame, y: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        row, col = np.nonzero(np.abs(s) > thr)
        if len(row):
            left, right = np.stack(x["codes"].to_numpy()), np.stack(y["codes"].to_numpy())
            first = np.concatenate([(left[row[at:at + FOUND]] == right[col[at:at + FOUND]]).argmax(1) for at in range(0, len(row), FOUND)])
            row, col = row[first == x["band"].iloc[0]], col[first == x["band"].iloc[0]]
        return row, col

    found = _tiles(side("i", "a"), side("j", "b"), keys, ["a"], ["b"], TILE, keep, ["codes"])
    found = found.select("scene", "i", "j", "a", "b", F.least(F.abs("s"), F.lit(1.0)).alias("s"))
    return found if cap is None else cap_pairs(found, ["scene", "i", "j"], "s", ["a", "b"], cap)
