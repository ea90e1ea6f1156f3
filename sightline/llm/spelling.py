"""Spelling variants by permuterm rotations: words that differ by one inserted, deleted or replaced letter.

A word gets a terminator and all its rotations. Of a rotation that ends in the edited letter, all but that letter is a prefix
that words differing in it alone share; the word without the letter has that prefix as a rotation of its own. So every
rotation stands under itself and under itself but for the last letter, the rows are sorted and grouped by
that prefix, and a group holds one word without the letter and at most one word for each letter: no group
exceeds the alphabet. Each member leaves with the number of its neighbours there and the best of them; pairs are not written. A
letter that could be left out of a run of equal ones counts once, at the run's first.

Prefixes longer than ``LITERAL`` letters stand as 127-bit polynomial hashes of their letters, so that a word of n letters gives 2 n + 1
rows of fixed size, whatever n is; their groups' members are named by hash and looked up in the word list.

Words come from whole texts: maximal runs of Latin letters, A-Z in lower case. One run in ``TYPO`` of a document, as a checksum of
document and run says, loses a letter. Null and empty texts have no words; a null id counts as an empty one in the
checksum; rows are counted one by one, also those that share an id. An empty table has no words. Other columns are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import batches, cut, map_arrow, pick

LETTERS = r"[A-Za-zÀ-ÿ]"
LEAST_LENGTH, LEAST_TIMES = 7, 2
TYPO = 31
#: A form is so many times more frequent.
RATIO = 10
LITERAL = 40
END = "$"
#: Different words a task holds before it hands their counts on.
HELD = 200_000
_PRIME, _BASE = (1 << 127) - 1, 0x5DEECE66D1CE4E5B9BF58476D1CE4E5
MAX_ROUNDS = 64  # a form is RATIO times more frequent, so chains are shorter than a count's digits


def _count(rows: Iterator) -> Iterator:
    import pyarrow as pa

    runs = re.compile(f"{LETTERS}{{{LEAST_LENGTH},}}").findall
    held: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    for b in rows:
        ids, texts = b.column(0).to_pylist(), b.column(1)
        for lo, hi in batches(texts):
            for doc_id, text in zip(ids[lo:hi], texts.slice(lo, hi - lo).to_pylist(), strict=True):
                seed = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
                low = (text or "").encode().lower().decode()  # of bytes, so A-Z alone
                for word, n in Counter(runs(low)).items():
                    h = zlib.crc32(word.encode(), seed)
                    if h % TYPO == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                        if len(word) < LEAST_LENGTH:
                            continue
                    held[word] += n
            if len(held) > HELD:
                yield out()
                held.clear()
    yield out()


def words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of all words that are long and frequent enough."""
    found = map_arrow(pick(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long"), "text"), _count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_TIMES)


def rotations(listed: DataFrame, literal: int = LITERAL) -> DataFrame:
    """(prefix, letter, n) of words whose prefix has at most ``literal`` letters; the letter is empty where none is skipped."""
    size = F.length("word")
    turned = F.transform(F.sequence(F.lit(0), size), lambda i: F.concat(
        F.substr(F.col("word"), i + 1, size), F.lit(END), F.substr(F.col("word"), F.lit(1), i)))
    each = listed.where(size <= literal).select("n", size.alias("size"), F.explode(turned).alias("whole"))
    both = F.array(F.struct(F.col("whole").alias("prefix"), F.lit("").alias("letter")),
                   F.struct(F.substr(F.col("whole"), F.lit(1), F.col("size")).alias("prefix"), F.substr(F.col("whole"), F.lit(-1), F.lit(1)).alias("letter")))
    return each.select("n", F.inline(both)).where((F.col("letter") != END) & (F.length("prefix") <= literal)).select("prefix", "letter", "n")


def _near(rows: DataFrame) -> DataFrame:
    """(word, near, best) of each member of each group; best is (-n, word) of its best neighbour there."""
    members = rows.groupBy("prefix").agg(F.collect_list(F.struct("letter", "n")).alias("m")).where(F.size("m") > 1)
    before, after = F.substring_index("prefix", END, -1), F.substring_index("prefix", END, 1)
    ranked = members.select(before.alias("before"), F.array_sort(F.transform("m", lambda s: F.struct(
        (-s["n"]).alias("r"), F.concat(before, s["letter"], after).alias("word"), s["letter"].alias("letter")))).alias("m"))
    last = F.substr(F.col("before"), F.lit(-1), F.lit(1))
    longer = F.size(F.filter("m", lambda s: s["letter"] != ""))
    first_of_run = F.size(F.filter("m", lambda s: (s["letter"] != "") & ~((F.col("before") != "") & (s["letter"] == last))))
    ranked = ranked.select("before", "m", longer.alias("longer"), first_of_run.alias("firsts"))
    each = ranked.select("*", F.posexplode("m").alias("i", "s"))
    whole = F.col("s.letter") == ""
    linked = F.when((F.size("m") > F.col("longer")) & ~((F.col("before") != "") & (F.col("s.letter") == last)), 1).otherwise(0)
    best = F.get("m", F.when(F.col("i") == 0, 1).otherwise(0))
    return each.select(F.col("s.word").alias("word"), F.when(whole, F.col("firsts")).otherwise(F.col("longer") - 1 + linked).cast("long").alias("near"),
                       F.struct(best["r"].alias("r"), best["word"].alias("word")).alias("best")).where("near > 0")


def _hashed(rows: Iterator, literal: int) -> Iterator:
    """(prefix, letter, first, n, ref) of words with prefixes above ``literal`` letters, prefixes as hashes."""
    import pyarrow as pa

    names = ["prefix", "letter", "first", "n", "ref"]
    kinds = [pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.string()]
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=names)

    for b in rows:
        for word, n, ref in zip(*[c.to_pylist() for c in b.columns], strict=True):
            size, upto, power = len(word), [0], [1]
            for c in word:
                upto.append((upto[-1] * _BASE + ord(c)) % _PRIME)
                power.append(power[-1] * _BASE % _PRIME)

            def name(start: int, stop: int) -> str:
                """The letters from ``start``, the terminator, the letters before ``stop``."""
                tail = (upto[size] - upto[start] * power[size - start]) % _PRIME
                return f"#{((tail * _BASE + ord(END)) * power[stop] + upto[stop]) % _PRIME:x}:{size - start}:{stop}"

            for i in range(size + 1):
                out.append((name(i, i), "", True, n, ref))
                if size > literal and i < size:
                    out.append((name(i + 1, i), word[i], i == 0 or word[i - 1] != word[i], n, ref))
                if len(out) >= 50_000:
                    yield batch()
                    out.clear()
    yield batch()


def _near_hashed(listed: DataFrame, literal: int) -> DataFrame:
    """The same as ``_near`` for prefixes that are hashes; a row per pair, as the words themselves decide ties."""
    named = cut(listed.where(F.length("word") >= literal).withColumn("ref", F.sha2("word", 256)))
    rows = map_arrow(named.select("word", "n", "ref"), partial(_hashed, literal=literal), "prefix string, letter string, first boolean, n long, ref string")
    members = rows.groupBy("prefix").agg(F.collect_list(F.struct("letter", "first", "n", "ref")).alias("m")).where(F.size("m") > 1)
    one = members.select("m", F.explode("m").alias("a")).select("a", F.explode("m").alias("b"))
    replaced = (F.col("a.letter") != "") & (F.col("b.letter") != "")
    pairs = one.where((F.col("a.ref") != F.col("b.ref")) & (replaced | F.col("a.first") & F.col("b.first"))).select(F.col("a.ref").alias("ref"), F.col("b.ref").alias("other"), F.col("b.n").alias("n"))
    mine, others = named.select("ref", "word"), named.select(F.col("ref").alias("other"), F.col("word").alias("_w"))
    return pairs.join(mine, "ref").join(others, "other").select("word", F.lit(1).cast("long").alias("near"), F.struct((-F.col("n")).alias("r"), F.col("_w").alias("word")).alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): forms followed to the last, by doubling."""
    at = cut(forms.select("word", F.col("form").alias("root")))
    for _ in range(MAX_ROUNDS):
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = cut(at.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        at = step.drop("moved")
        if step.where("moved").isEmpty():
            return at
    raise RuntimeError("forms did not end")


def group(listed: DataFrame, literal: int = LITERAL) -> DataFrame:
    """Variants of a table (word, n): word, n, n_near, form, form_n, root."""
    listed = cut(listed)
    none = F.lit(None).cast("struct<r: bigint, word: string>")
    found = _near(rotations(listed, literal)).unionByName(_near_hashed(listed, literal))
    every = listed.select("word", "n", F.lit(0).cast("long").alias("near"), none.alias("best")).unionByName(
        found.select("word", F.lit(None).cast("long").alias("n"), "near", "best"))
    merged = every.groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), F.min("best").alias("best"))
    far = -F.col("best.r") >= RATIO * F.col("n")
    merged = cut(merged.select("word", "n", "n_near", F.when(far, F.col("best.word")).alias("form"), F.when(far, -F.col("best.r")).alias("form_n")))
    return merged.join(_roots(merged.where("form IS NOT NULL")), "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, **names: str) -> DataFrame:
    """Spelling variants of the words of a corpus."""
    return group(words(docs, **names))
