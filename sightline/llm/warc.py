"""WARC archives: a writer with revisit records and a reader that splits inside files.

Writing: each page is one gzip member with one record. Of the pages with equal payloads of at least ``min_bytes``
bytes, the one with the smallest id is a response and the others revisit it; smaller payloads are all responses. Tasks
write files under names of their own; only files of the manifest table count, so a lost attempt is never read.

Reading: a task gets a range of bytes of a file. It looks for the gzip magic number from the start of its range on,
takes a place for a member when its header decodes to a WARC version line, and from there follows member after member.
It owns the records whose members begin inside its range, and reads past the end of the range to finish the last. The
magic number holds a byte that can't occur there in UTF-8, so text payloads never imitate it; in other payloads
only a stored copy of a whole archive could.

Payloads are the pages' html in UTF-8; null counts as empty. A row with a null id is archived under an empty id and is
a response only if no row with the same payload has an id. Rows that share both the smallest id and the payload are all
responses. An empty table gives archives without records.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import cut, fresh_folder, map_arrow, open_store, pick, text_or_empty
from sightline.scale import broadcast_if_small

MIN_BYTES = 100
SPLIT_BYTES = 16 << 20
HOT = 4096  # pages of one payload from which its digest is broadcast
#: Fixed values of the formats.
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def with_originals(pages: DataFrame, min_bytes: int = MIN_BYTES, hot: int = HOT) -> DataFrame:
    """Adds digest and refers_to (null for responses) to (page_id, url, html).

    Payloads found more than ``hot`` times are at most one in ``hot`` pages; their digests are broadcast while they are
    few, so that their pages need not meet in one task. Pages that can't be revisits are spread evenly.
    """
    pages = pages.withColumn("digest", F.sha2(F.encode("html", "UTF-8"), 256))
    may_repeat = F.octet_length("html") >= min_bytes
    shared = cut(pages.where(may_repeat).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
                 .where("n > 1 AND first IS NOT NULL"))
    often = shared.where(F.col("n") > hot).select(F.col("digest").alias("often"), F.col("first").alias("often_first"))
    rare = shared.where(F.col("n") <= hot).select(F.col("digest").alias("key"), "first")
    pages = pages.join(broadcast_if_small(often), F.col("digest") == F.col("often"), "left")
    alone = F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string"))
    pages = pages.withColumn("key", F.when(may_repeat & F.col("often").isNull(), F.col("digest")).otherwise(alone))
    first = F.coalesce("often_first", "first")
    return pages.join(rare, "key", "left").withColumn("refers_to", F.when(F.col("page_id").isNull() | (F.col("page_id") != first), first))


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, before compression; a revisit keeps the HTTP head and leaves out the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id)}",
            f"WARC-Date: {DATE}", f"WARC-Target-URI: {' '.join((url or '').split())}", f"WARC-Payload-Digest: sha256:{digest}",
            "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}"]
        payload = b""
    head.append(f"Content-Length: {len(http) + len(payload)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


def member(raw: bytes, level: int = 1) -> bytes:
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(raw) + pack.flush()


def _write(rows: Iterator, folder: str) -> Iterator:
    import pyarrow as pa

    store, at = open_store(folder)
    store.create_dir(at, recursive=True)
    path, size = f"{at}/{uuid.uuid4().hex}.warc.gz", 0
    with store.open_output_stream(path, compression=None) as out:
        for b in rows:
            for page_id, url, html, digest, refers_to in zip(*(b.column(i) for i in range(5)), strict=True):
                packed = member(record(page_id.as_py(), url.as_py(), html.as_buffer().to_pybytes(), digest.as_py(), refers_to.as_py()))
                out.write(packed)
                size += len(packed)
    yield pa.RecordBatch.from_pydict({"path": [path], "size": [size]})


class _Window:
    """A file read forward in steps, with look-ahead; drops what lies behind."""

    def __init__(self, file, start: int, step: int = 1 << 20) -> None:
        self.file, self.at, self.step, self.held = file, start, step, b""
        file.seek(start)

    def more(self) -> bool:
        got = self.file.read(self.step)
        self.held += got
        return bool(got)

    def drop(self, n: int) -> None:
        self.held, self.at = self.held[n:], self.at + n


def _is_member(window: _Window) -> bool:
    """Whether what follows inflates to a WARC version line."""
    while True:
        try:
            head = zlib.decompressobj(31).decompress(window.held[:4096], len(VERSION) + 2)
        except zlib.error:
            return False
        if len(head) > len(VERSION):
            return head.startswith(b"WARC/1.")
        if len(window.held) >= 4096 or not window.more():
            return False


def members(file, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of the members that begin in [start, end)."""
    window = _Window(file, start)
    while window.at < end:
        k = window.held.find(MAGIC)
        if k < 0:
            window.drop(max(0, len(window.held) - 2))
            if not window.more():
                return
            continue
        window.drop(k)
        if window.at >= end:
            return
        if not _is_member(window):
            window.drop(1)
            continue
        offset, unpack, content = window.at, zlib.decompressobj(31), []
        while not unpack.eof:
            if not window.held and not window.more():
                raise ValueError(f"the archive ends inside the member at {offset}")
            content.append(unpack.decompress(window.held))
            used = len(window.held) - len(unpack.unused_data)
            window.drop(used)
        yield offset, b"".join(content)


def parse(content: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields, HTTP head and payload of a record."""
    head, _, block = content.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    http, _, payload = block[:int(fields["Content-Length"])].partition(b"\r\n\r\n")
    return fields, http, payload


def _number(urn: str | None) -> int | None:
    digits = urn[len("<urn:page:"):-1] if urn else ""
    return int(digits) if digits else None


def _read(rows: Iterator, folder: str) -> Iterator:
    import pyarrow as pa

    store, _ = open_store(folder)
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("record_type", pa.string()), ("refers_to", pa.int64())])
    for b in rows:
        for path, start, end in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            found = []
            with store.open_input_file(path) as file:
                for offset, content in members(file, start, end):
                    fields, http, payload = parse(content)
                    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    size = int(http.rsplit(b"Content-Length: ", 1)[1])
                    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"{path}: the record at {offset} is damaged")
                    found.append((_number(fields["WARC-Record-ID"]), size, digest, kind, _number(fields.get("WARC-Refers-To"))))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found, strict=True) if found else [[]] * 5, schema, strict=True)], schema=schema)


def write_archives(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = MIN_BYTES) -> tuple[str, DataFrame]:
    """Writes all pages; gives the folder and the manifest (path, size), a row per file."""
    rows = pick(pages, page_id=page_id, url=url, html=html).withColumn("html", text_or_empty("html"))
    folder = fresh_folder(pages.sparkSession, "warc")
    records = with_originals(rows, min_bytes).select("page_id", "url", "html", "digest", "refers_to")
    return folder, cut(map_arrow(records, partial(_write, folder=folder), "path string, size long"))


def read_archives(folder: str, manifest: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """A row per record: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    splits = manifest.where("size > 0").select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    total = manifest.agg(F.sum(F.ceil(F.col("size") / split_bytes))).first()[0] or 1
    splits = splits.select("path", "start", F.least(F.col("size"), F.col("start") + split_bytes).alias("end")).repartition(min(int(total), 100_000))
    return map_arrow(splits, partial(_read, folder=folder), RECORDS)


def archive(pages: DataFrame, split_bytes: int = SPLIT_BYTES, **columns: str) -> DataFrame:
    """Write the pages and give back what the archives hold."""
    return read_archives(*write_archives(pages, **columns), split_bytes)
