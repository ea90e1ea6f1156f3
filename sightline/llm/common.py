"""What several operators share: shared folders, files seen by every executor, and a memoised encoder."""

from __future__ import annotations

import os
import uuid
from array import array
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.scale import broadcast_if_small, cut, shared_dir

__all__ = ["cut", "fresh_folder", "open_store", "text_or_empty", "text_hash", "pick", "words_column", "join_counted", "Encoder"]

#: White space of every word pattern of this package: space and 0x09 to 0x0D.
SPACE = r"[\x20\x09-\x0D]+"


def fresh_folder(spark: SparkSession, what: str) -> str:
    """A new folder under the shared one, for files that tasks write themselves."""
    return f"{shared_dir(spark).rstrip('/')}/sightline/{what}-{uuid.uuid4().hex}"


def open_store(uri: str):
    """The file system of ``uri`` and the path in it; any store that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns under the operator's own names, so that no other column can clash."""
    return df.select(*[df[source].alias(name) for name, source in columns.items()])


def text_or_empty(column: str | Column) -> Column:
    """Null texts count as empty ones."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def text_hash(text: str | Column) -> Column:
    """Tells apart texts whose rows have the same id or none."""
    return F.xxhash64(text_or_empty(text))


def words_column(text: str | Column) -> Column:
    """Array of the words of a text, split at SPACE; no empty strings, null gives no words."""
    return F.filter(F.split(text_or_empty(text), SPACE), lambda w: w != "")


#: Bytes of an Arrow batch; several batches per task exist at once, in the JVM and in Python, and texts come on top.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


class _Released:
    """A task body that gives Arrow's unused memory back when it is done; idle workers would keep it."""

    def __init__(self, body: Callable) -> None:
        self.body = body

    def __call__(self, rows: Iterator) -> Iterator:
        import pyarrow as pa

        yield from self.body(rows)
        pa.default_memory_pool().release_unused()


def map_arrow(df: DataFrame, body: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` in batches of bounded size; lowers the session's limit where it is larger."""
    spark = df.sparkSession
    limit = (spark.conf.get(_BATCH, None) or "").removesuffix("b")
    if not limit.isdigit() or not 0 < int(limit) <= BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    return df.mapInArrow(_Released(body), schema)


#: A key is heavy when it holds more than this share of all rows, so at most so many keys are.
HEAVY = 1000


def join_counted(rows: DataFrame, groups: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Left join of ``rows`` with a written table of one row per key that tells how many rows the key has.

    No more than ``HEAVY`` keys can be heavy; these are broadcast, so that their rows stay where they are. All other
    rows are shuffled to their key.
    """
    heavy = F.col(count) > max(1, total // HEAVY)
    few = broadcast_if_small(groups.where(heavy))
    rest = rows.join(few.select(key), key, "left_anti").join(groups.where(~heavy), key, "left")
    return rows.join(few, key).unionByName(rest)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, although ``body`` uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


#: Punctuation that may end a word; behind an ASCII letter or digit the pre-tokenizer ends a piece before it.
_TAIL = b".,!?;:|%#$&*"


class _Words(dict):
    """Raw ids by word, learned when first asked for. Only words of ASCII alone are lower-cased here.

    The library composes marks with their letters before it lower-cases, and some letters (J with caron) are composed in
    lower case only; so all other words reach it as they stand.
    """

    def __init__(self, owner: Encoder, old: dict) -> None:
        self.owner, self.old = owner, old

    def __missing__(self, word: bytes) -> bytes:
        if (ids := self.old.get(word)) is None:
            head = word.rstrip(_TAIL)
            if len(head) < len(word) and head[-1:].isalnum():
                ids = self[head] + self[word[len(head):]]
            elif word.isascii() and (low := word.lower()) != word:
                ids = self[low]
            else:
                ids = self.owner.of_word(word.decode())
        self[word] = ids
        return ids


class Encoder:
    """Token ids of texts by a ``tokenizers`` file that lower-cases and never joins pieces across white space.

    A text is cut at ASCII white space; each different word is encoded once by the library and remembered, words of
    plain letters by its model alone. Of ``memo_words`` words the younger half at least is kept, so memory is bounded.
    Texts that may hold special strings, and all texts where a probe shows that the vocabulary doesn't allow this, are
    encoded whole.
    """

    def __init__(self, path: str, memo_words: int = 400_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = "<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        self.special = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.generation = memo_words // 2
        self.letters = self._plain_letters()
        self.words = _Words(self, {})
        probe = "Ab cd.\tEF, g9!?\n\ndog's it's|x \u00e9t\u00e9, \u00c9. J\u030ca H\u0331a T\u0308a W\u030aa Y\u030aa j\u030cA"
        self.by_word = self._ids(probe) == b"".join(self.words[w] for w in probe.encode().split())

    def _plain_letters(self) -> dict[int, str]:
        """How the pre-tokenizer spells lower-case Latin letters that the normalizer leaves alone."""
        normal, pieces, spelt = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer, {}
        for c in [*"abcdefghijklmnopqrstuvwxyz", *map(chr, range(0xDF, 0x100))] if normal and pieces else []:
            twice = pieces.pre_tokenize_str(c + c)
            if c.isalpha() and normal.normalize_str(c + c) == c + c and len(twice) == 1:
                spelt[ord(c)] = twice[0][0][:len(twice[0][0]) // 2]
        return spelt

    def _ids(self, text: str) -> bytes:
        return self._raw(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _raw(self, ids: list[int]) -> bytes:
        return array("H" if self.dtype == "<u2" else "I", ids).tobytes()

    def of_word(self, word: str) -> bytes:
        if len(word) < 100 and self.letters.keys() >= set(map(ord, word)):
            return self._raw([t.id for t in self.tokenizer.model.tokenize(word.translate(self.letters))])
        return self._ids(word)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Raw little-endian ids of each text; null and empty texts give none."""
        out = []
        for t in texts:
            raw = (t or "").encode()
            low = raw.lower()
            if not self.by_word or any(x in low for x in self.special):
                out.append(self._ids(t or ""))
                continue
            if len(self.words) > self.generation:
                self.words = _Words(self, dict(self.words))
            out.append(b"".join(map(self.words.__getitem__, raw.split())))
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def batches(texts, size: int = 1 << 20) -> Iterable[tuple[int, int]]:
    """Ranges of rows of an Arrow string column with some ``size`` bytes each, at least one row."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(ends):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + size, "right")))
        yield start, stop
        start = stop
