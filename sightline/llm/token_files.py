"""Token-id files of independent zstandard frames with a trailing seek table.

One file per range of document ids::

    frame, frame, ...      zstandard frames of whole documents' ids (little-endian, width in the index), some
                           ``frame_bytes`` each; a longer document has a frame of its own
    index                  skippable frame: JSON header, then doc ids, validity, ids per document, frame per document,
                           and the size of all that
    seek table             skippable frame: compressed size, raw size and checksum of each frame, number of frames,
                           descriptor, magic number (the public seekable format)

A reader fetches the two tables at the end and then only the frames of the documents it wants, and checks each frame
by its checksum. Tasks write files under names of their own; only files listed in the manifest table count, so an
attempt lost with its executor leaves nothing behind that is read.

Null and empty texts give a document of the end id alone. Rows are ordered by document id, then by text; null ids
come last; repeated rows stay. An empty table gives one file without documents or none.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import batches, cut, encoder, fresh_folder, map_arrow, open_store, pick

#: Fixed values of the zstandard container formats.
SKIPPABLE = 0x184D2A50
SEEK_TABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1

FRAME_BYTES = 1 << 20
MANIFEST = "part int, path string, n_docs long, n_ids long, n_frames int"


class _Writer:
    """Appends documents to one file, frame by frame; holds one frame and the index."""

    def __init__(self, store, path: str, dtype: str, frame_bytes: int) -> None:
        import zstandard

        self.out, self.dtype, self.frame_bytes = store.open_output_stream(path, compression=None), dtype, frame_bytes
        self.pack = zstandard.ZstdCompressor(level=1, write_content_size=True)
        self.frame, self.size, self.seek = [], 0, []
        self.ids, self.valid, self.lengths, self.frames = [], [], [], []

    def add(self, doc_id: int | None, raw: bytes) -> None:
        if self.size and self.size + len(raw) > self.frame_bytes:
            self.flush()
        self.frame.append(raw)
        self.size += len(raw)
        self.ids.append(doc_id or 0)
        self.valid.append(doc_id is not None)
        self.lengths.append(len(raw))
        self.frames.append(len(self.seek))

    def flush(self) -> None:
        import xxhash

        raw = b"".join(self.frame)
        packed = self.pack.compress(raw)
        self.out.write(packed)
        self.seek.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.frame, self.size = [], 0

    def close(self) -> tuple[int, int, int]:
        import numpy as np

        if self.size:
            self.flush()
        width = int(self.dtype[-1])
        lengths = np.array(self.lengths, np.int64) // width
        head = json.dumps({"dtype": self.dtype, "docs": len(self.ids)}).encode()
        index = struct.pack("<I", len(head)) + head + np.array(self.ids, "<i8").tobytes() + np.array(self.valid, "u1").tobytes()
        index += lengths.astype("<i8").tobytes() + np.array(self.frames, "<u4").tobytes()
        index += struct.pack("<I", len(index))
        table = b"".join(struct.pack("<III", *x) for x in self.seek) + struct.pack("<IBI", len(self.seek), 0x80, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(index)) + index + struct.pack("<II", SEEK_TABLE, len(table)) + table)
        self.out.close()
        return len(self.ids), int(lengths.sum()), len(self.seek)


class TokenFile:
    """Reads one file: the tables once, then any frame or document."""

    def __init__(self, store, path: str) -> None:
        import numpy as np

        self.file = store.open_input_file(path)
        size = self.file.size()
        n_frames, descriptor, seekable = struct.unpack("<IBI", self._at(size - 9, 9))
        if seekable != SEEKABLE or descriptor != 0x80:
            raise ValueError(f"{path} is no token file")
        end = size - 9 - 12 * n_frames
        table = self._at(end, 12 * n_frames)
        n = struct.unpack("<I", self._at(end - 12, 4))[0]
        index = self._at(end - 12 - n, n)
        self.seek = np.frombuffer(table, "<u4", 3 * n_frames).reshape(-1, 3).astype(np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.seek[:, 0])])
        head = struct.unpack_from("<I", index)[0]
        meta, at = json.loads(index[4:4 + head]), 4 + head
        docs, self.dtype = meta["docs"], meta["dtype"]
        self.doc_ids = np.frombuffer(index, "<i8", docs, at)
        self.valid = np.frombuffer(index, "u1", docs, at + 8 * docs)
        self.lengths = np.frombuffer(index, "<i8", docs, at + 9 * docs)
        self.frames = np.frombuffer(index, "<u4", docs, at + 17 * docs)
        self.starts = np.cumsum(self.lengths) - self.lengths
        first = np.searchsorted(self.frames, np.arange(n_frames))
        self.frame_starts = self.starts[first] if n_frames else self.starts[:0]

    def _at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def frame(self, k: int):
        """Ids of one frame, checked against the seek table."""
        import numpy as np
        import xxhash
        import zstandard

        raw = zstandard.ZstdDecompressor().decompress(self._at(int(self.offsets[k]), int(self.seek[k, 0])), int(self.seek[k, 1]))
        if len(raw) != self.seek[k, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.seek[k, 2]:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(raw, self.dtype)

    def document(self, row: int):
        """Ids of the document in place ``row``; decompresses its frame alone."""
        k = int(self.frames[row])
        at = int(self.starts[row] - self.frame_starts[k])
        return self.frame(k)[at:at + int(self.lengths[row])]

    def documents(self) -> Iterator[tuple[int, int, object]]:
        """(row, start, ids) of all documents in order, one frame in memory at a time."""
        held, ids = -1, None
        for row, k in enumerate(self.frames.tolist()):
            if k != held:
                held, ids = k, self.frame(k)
            at = int(self.starts[row] - self.frame_starts[k])
            yield row, int(self.starts[row]), ids[at:at + int(self.lengths[row])]


def _write(rows: Iterator, folder: str, vocabulary: str, end_id: int, frame_bytes: int) -> Iterator:
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    store, at = open_store(folder)
    store.create_dir(at, recursive=True)
    part = TaskContext.get().partitionId()
    path = f"{at}/part-{part:05d}-{uuid.uuid4().hex}.zst"
    enc = encoder(vocabulary)
    out, end = _Writer(store, path, enc.dtype, frame_bytes), np.array([end_id], enc.dtype).tobytes()
    for b in rows:
        ids, texts = b.column(0).to_pylist(), b.column(1)
        for lo, hi in batches(texts):
            for doc_id, raw in zip(ids[lo:hi], enc.encode(texts.slice(lo, hi - lo).to_pylist()), strict=True):
                out.add(doc_id, raw + end)
    yield pa.RecordBatch.from_pylist([dict(zip(("part", "path", "n_docs", "n_ids", "n_frames"), (part, path, *out.close()), strict=True))],
                                     schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_frames", pa.int32())]))


def _read(rows: Iterator, folder: str) -> Iterator:
    import numpy as np
    import pyarrow as pa

    store, _ = open_store(folder)
    for b in rows:
        for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            f = TokenFile(store, path)
            crc = np.fromiter((zlib.crc32(ids.astype("<u4").tobytes()) for _, _, ids in f.documents()), np.int64, len(f.doc_ids))
            for lo in range(0, len(crc), 50_000):
                cut_at = slice(lo, lo + 50_000)
                yield pa.RecordBatch.from_arrays([
                    pa.array(f.doc_ids[cut_at], mask=f.valid[cut_at] == 0), pa.array(f.starts[cut_at] + base),
                    pa.array(f.lengths[cut_at]), pa.array(crc[cut_at])], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int = 1, doc_id: str = "doc_id", text: str = "text",
                      frame_bytes: int = FRAME_BYTES) -> tuple[str, DataFrame]:
    """Encode and write all documents in ascending id order; gives the folder and the manifest, a row per file."""
    spark = docs.sparkSession
    folder = fresh_folder(spark, "tokens")
    ordered = pick(docs, doc_id=doc_id, text=text).repartitionByRange(F.col("doc_id").asc_nulls_last()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_last(), "text")
    return folder, cut(map_arrow(ordered, partial(_write, folder=folder, vocabulary=vocabulary, end_id=end_id, frame_bytes=frame_bytes), MANIFEST))


def read_token_files(folder: str, manifest: DataFrame) -> DataFrame:
    """A row per document from the files: doc_id, start (ids before it), n_tokens, ids_crc32.

    The manifest has one row per file, so its running sum is a driver-side list of as many numbers as there were
    output tasks.
    """
    spark, files, base = manifest.sparkSession, [], 0
    for f in manifest.orderBy("part").select("path", "n_ids").collect():
        files.append((f.path, base))
        base += f.n_ids
    splits = spark.createDataFrame(files, "path string, base long").repartition(max(1, len(files)))
    return map_arrow(splits, partial(_read, folder=folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, vocabulary: str, end_id: int = 1, **names: str) -> DataFrame:
    """Write the documents and give back what the files hold."""
    return read_token_files(*write_token_files(docs, vocabulary, end_id, **names))
