"""Readers for files larger than a row or a task may hold: byte ranges of binary models, elements of JSON arrays.

Tasks open files themselves through pyarrow's file systems, at the place they need, and hold one buffer of them.
"""

from __future__ import annotations

import codecs
import gzip
import json
import math
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.scale import cut

RANGE = 64 << 20  # bytes of a model that one task reads
WINDOW = 1 << 20  # bytes held of a file
MAX_NAME = 4096  # longest name a record found by search may have; records that follow a known one have no limit
FOLLOWERS = 2  # records that must follow a place found by search
HEAD = struct.Struct("<idddddddi")
RECORD = "path string, at long, next long, image_id long, name string, qw double, qx double, qy double, qz double, tx double, ty double, tz double, camera_id long"


def open_file(path: str):
    """A file that can be read at any place, in any store that pyarrow knows."""
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)
    return store.open_input_file(inner)


class Window:
    """Bytes of a file at any place through one buffer of ``WINDOW`` bytes."""

    def __init__(self, file) -> None:
        self.file, self.size, self.lo, self.buf = file, file.size(), 0, b""

    def at(self, place: int, n: int) -> bytes:
        """Up to ``n`` bytes; fewer at the end of the file."""
        if place < self.lo or place + n > self.lo + len(self.buf):
            self.lo = place
            self.buf = self.file.read_at(max(0, min(max(n, WINDOW), self.size - place)), place) if place < self.size else b""
        return self.buf[place - self.lo:place - self.lo + n]

    def until_zero(self, place: int, most: int | None = None) -> bytes | None:
        """The bytes before the next zero byte, or None without one within ``most``."""
        n = 256
        while True:
            got = self.at(place, n if most is None else min(n, most + 1))
            end = got.find(b"\0")
            if end >= 0:
                return got[:end]
            if len(got) < n:
                return None
            n *= 4


def _record(w: Window, at: int, strict: bool) -> tuple | None:
    """(next place, fields) of the record at a place; None where there can't be one. ``strict`` doubts what it reads."""
    head = w.at(at, HEAD.size)
    if len(head) < HEAD.size:
        return None
    image, *pose, camera = HEAD.unpack(head)
    name = w.until_zero(at + HEAD.size, MAX_NAME if strict else None)
    if name is None:
        return None
    end = at + HEAD.size + len(name) + 1
    count = w.at(end, 8)
    if len(count) < 8:
        return None
    end += 8 + 24 * int.from_bytes(count, "little")
    if end > w.size:
        return None
    try:
        text = name.decode("utf-8")
    except UnicodeDecodeError:
        return None
    if strict and not (image > 0 and camera >= 0 and text and text.isprintable() and all(map(math.isfinite, pose))
                       and abs(sum(q * q for q in pose[:4]) - 1) < 1e-3):
        return None
    return end, (image, text, *pose, camera)


def _candidates(w: Window, lo: int, hi: int) -> Iterator[int]:
    """Places in [lo, hi) followed, after four bytes, by four doubles of unit length, as rotations are."""
    for start in range(lo, hi, WINDOW):
        stop = min(start + WINDOW, hi)
        buf = w.at(start, stop - start + 36)
        found = []
        for shift in range(8):
            n = (len(buf) - 4 - shift) // 8
            if n < 4:
                continue
            with np.errstate(all="ignore"):
                sq = np.frombuffer(buf, "<f8", n, 4 + shift) ** 2
                norm = sq[:-3] + sq[1:-2] + sq[2:-1] + sq[3:]
                found.append(np.flatnonzero(np.abs(norm - 1) < 1e-3) * 8 + shift + start)
        yield from (int(p) for p in np.sort(np.concatenate(found)) if p < stop) if found else ()


def _followed(w: Window, at: int) -> bool:
    """Whether a record stands at a place and two more, or the end of the file, behind it."""
    for _ in range(FOLLOWERS + 1):
        if at == w.size:
            return True
        got = _record(w, at, True)
        if got is None:
            return False
        at = got[0]
    return True


def _rows(path: str, w: Window, lo: int, hi: int) -> Iterator[tuple]:
    """Records that start in [lo, hi); the count at the head of the file is a record without a name."""
    at = lo
    if lo == 0:
        yield path, 0, 8, int.from_bytes(w.at(0, 8), "little"), None, *[None] * 7, None
        at = 8
    else:
        at = next((p for p in _candidates(w, lo, hi) if _followed(w, p)), hi)
    while at < min(hi, w.size):
        got = _record(w, at, False)
        if got is None:
            return
        yield path, at, got[0], *got[1]
        at = got[0]


def _frames(rows: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    block = []
    for row in rows:
        block.append(row)
        if len(block) == 4096:
            yield pd.DataFrame(block, columns=columns)
            block = []
    if block:
        yield pd.DataFrame(block, columns=columns)


_COLUMNS = [c.split()[0] for c in RECORD.split(", ")]


def _read_ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path, lo, hi in zip(pdf["path"], pdf["lo"], pdf["hi"]):
            with open_file(path) as f:
                yield from _frames(_rows(path, Window(f), lo, hi), _COLUMNS)


def _read_in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def rows(path: str) -> Iterator[tuple]:
        with open_file(path) as f:
            w = Window(f)
            at = 8
            for k in range(int.from_bytes(w.at(0, 8), "little")):
                got = _record(w, at, False)
                if got is None:
                    raise ValueError(f"{path}: record {k} at byte {at} is broken")
                yield path, at, got[0], *got[1]
                at = got[0]

    for pdf in batches:
        for path in pdf["path"]:
            yield from _frames(rows(path), _COLUMNS)


def image_records(spark: SparkSession, paths: Sequence[str], size: int = RANGE) -> DataFrame:
    """Records of ``images.bin`` files, in ranges of ``size`` bytes: the columns of ``RECORD``.

    A task looks for the first record that starts in its range and follows the chain from there to the range's end. Then
    each file is proved: the places where records end must be those where others start, from the first byte to the last,
    and their number that in the file's head. A file that fails (rotations that aren't unit quaternions, bytes behind
    the last record) is read again from its beginning by one task, in constant memory; a broken one raises.
    """
    files = spark.read.format("binaryFile").load(list(paths)).select("path", F.col("length").alias("size"))
    n = F.greatest(F.ceil(F.col("size") / size), F.lit(1))
    cells = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("k"))
    cells = cells.select("path", (F.col("k") * size).alias("lo"), ((F.col("k") + 1) * size).alias("hi"))
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    got = cut(cells.repartition(tasks, "path", "lo").mapInPandas(_read_ranges, RECORD))
    number = lambda c: F.xxhash64(c).cast("decimal(20,0)")
    seen = got.groupBy("path").agg(F.sum(number("at") - number("next")).alias("open"), F.count("name").alias("n"),
                                   F.max(F.when(F.col("at") == 0, F.col("image_id"))).alias("claimed"))
    proof = (F.col("open") == number(F.lit(0).cast("long")) - number("size")) & (F.col("n") == F.col("claimed"))
    doubtful = cut(files.join(seen, "path", "left").where(~F.coalesce(proof, F.lit(False))).select("path"))
    again = doubtful.repartition(tasks, "path").mapInPandas(_read_in_order, RECORD)
    return got.where(F.col("at") > 0).join(doubtful, "path", "left_anti").unionByName(again)


# ------------------------------------------------------------------ JSON
ENDS = " \t\r\n,:]}"  # what may follow a value


class _Json:
    """Walks JSON text that arrives in pieces; holds one value and one piece."""

    def __init__(self, stream, piece: int) -> None:
        self.stream, self.piece, self.buf, self.at = stream, piece, "", 0
        self.decode, self.values, self.ended = codecs.getincrementaldecoder("utf-8-sig")().decode, json.JSONDecoder(), False

    def more(self, n: int) -> None:
        data = self.stream.read(n)
        self.ended = not data
        self.buf, self.at = self.buf[self.at:] + self.decode(data, self.ended), 0

    def peek(self) -> str:
        """The next character that isn't white space; empty at the end."""
        while True:
            while self.at < len(self.buf) and self.buf[self.at] in " \t\r\n":
                self.at += 1
            if self.at < len(self.buf) or self.ended:
                return self.buf[self.at:self.at + 1]
            self.more(self.piece)

    def expect(self, allowed: str) -> str:
        c = self.peek()
        if not c or c not in allowed:
            raise ValueError(f"one of {allowed!r} expected, found {c!r}")
        self.at += 1
        return c

    def value(self) -> str:
        """The text of the next value; pieces double while it doesn't end."""
        self.peek()
        n = self.piece
        while True:
            try:
                _, end = self.values.raw_decode(self.buf, self.at)
                if self.buf[end:end + 1] in ENDS and (end < len(self.buf) or self.ended):
                    text, self.at = self.buf[self.at:end], end
                    return text
            except json.JSONDecodeError:
                if self.ended:
                    raise
            self.more(n)
            n *= 2

    def elements(self) -> Iterator[str]:
        self.expect("[")
        if self.peek() == "]":
            self.at += 1
            return
        while True:
            yield self.value()
            if self.expect(",]") == "]":
                return

    def under(self, key: str) -> Iterator[str]:
        """Elements of the array that an object holds under a key; other arrays pass element by element."""
        self.expect("{")
        if self.peek() == "}":
            return
        while True:
            name = json.loads(self.value())
            self.expect(":")
            if self.peek() == "[":
                for element in self.elements():
                    if name == key:
                        yield element
            else:
                self.value()
            if self.expect(",}") == "}":
                return


def json_elements(spark: SparkSession, paths: Sequence[str], key: str | None = None, piece: int = WINDOW) -> DataFrame:
    """(path, element): the text of each element of a top-level array, or of the array under ``key``.

    Files may be gzipped whatever their suffix. A file is one task's stream, since gzip can't be entered in the middle;
    a row never holds more than an element. Text that isn't such JSON raises.
    """
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path in pdf["path"]:
                with open_file(path) as f:
                    zipped = f.read(2) == b"\x1f\x8b"
                    f.seek(0)
                    walk = _Json(gzip.GzipFile(fileobj=f) if zipped else f, piece)
                    found = walk.elements() if key is None else walk.under(key)
                    try:
                        yield from _frames(((path, e) for e in found), ["path", "element"])
                    except (json.JSONDecodeError, UnicodeDecodeError, EOFError) as e:
                        raise ValueError(f"{path}: {e}") from e

    files = spark.read.format("binaryFile").load(list(paths)).select("path")
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return files.repartition(tasks, "path").mapInPandas(read, "path string, element string")
