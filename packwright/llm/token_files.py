"""Token ids in files of independent zstandard frames with a trailing seek table.

A file is a run of zstandard frames, each whole documents and each with its own content checksum;
then a skippable frame with the document index; then the seek table in the public seekable format
(a skippable frame of compressed size, raw size and the low 32 bits of XXH64 for each frame, with a
footer).  A reader fetches the tail, then only the frames of the documents it is asked for.

Documents are range-partitioned and sorted by doc_id; each partition writes one file, under a name
that depends on the partition alone, so a task that runs again replaces its own file.  Rows of one
doc_id are told apart by a hash of the text and by their place in the input, so no id, however often
it is repeated, has to meet in one task.  A long text is encoded piece by piece.

Defined cases: a null text is an end id alone; null doc_ids sort first and read back as null; equal
doc_ids are ordered by a hash of the text; an empty table makes no files and no rows; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .files import filesystem, new_folder, stored, write_whole
from .textscan import chunks

#: Fixed values of the public zstandard formats: magic numbers of skippable frames and of the seek table's footer.
INDEX_MAGIC, SEEK_MAGIC, FOOTER_MAGIC = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
#: known: 0 for a null doc_id, which stands before all others
ENTRY = np.dtype([("known", "u1"), ("doc_id", "<i8"), ("frame", "<u4"), ("at", "<u4"), ("n", "<u4")])


@dataclass(frozen=True)
class Format:
    """frame_tokens: a frame closes at the first document end beyond it; wide: 4 bytes an id, else 2."""

    frame_tokens: int = 1 << 17
    level: int = 1
    wide: bool = False

    @property
    def dtype(self) -> str:
        return "<u4" if self.wide else "<u2"


class FrameWriter:
    """Yields a file's bytes for documents added in order."""

    def __init__(self, layout: Format):
        import zstandard

        self.layout, self.press = layout, zstandard.ZstdCompressor(level=layout.level, write_checksum=True)
        self.open, self.size, self.frames, self.entries = [], 0, [], []
        self.tokens = 0

    def add(self, doc_ids: list[int | None], ids: np.ndarray, bounds: np.ndarray) -> Iterator[bytes]:
        for doc_id, a, b in zip(doc_ids, bounds[:-1].tolist(), bounds[1:].tolist()):
            yield from self.add_parts(doc_id, (ids[a:b],))

    def add_parts(self, doc_id: int | None, parts: Iterable[np.ndarray]) -> Iterator[bytes]:
        """One document whose ids come in parts."""
        at = self.size
        for ids in parts:
            self.open.append(ids)
            self.size += len(ids)
        self.entries.append((doc_id is not None, doc_id or 0, len(self.frames), at, self.size - at))
        self.tokens += self.size - at
        if self.size >= self.layout.frame_tokens:
            yield self._frame()

    def _frame(self) -> bytes:
        import xxhash

        ids = np.concatenate(self.open)
        if not self.layout.wide and len(ids) and ids.max() > 0xFFFF:
            raise ValueError("these ids need a wide format")
        raw = ids.astype(self.layout.dtype).tobytes()
        pressed = self.press.compress(raw)
        self.frames.append((len(pressed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.open, self.size = [], 0
        return pressed

    def close(self) -> Iterator[bytes]:
        if self.open:
            yield self._frame()
        index = struct.pack("<BI", 4 if self.layout.wide else 2, len(self.entries)) + np.array(self.entries, ENTRY).tobytes()
        index = self.press.compress(index)
        yield struct.pack("<II", INDEX_MAGIC, len(index)) + index
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0x80, FOOTER_MAGIC)
        yield struct.pack("<II", SEEK_MAGIC, len(table)) + table


class TokenFile:
    """Reader: ``document(doc_id)`` decompresses one frame; ``documents()`` streams all."""

    def __init__(self, uri: str):
        import zstandard

        system, path = filesystem(uri)
        self.file, self.open = system.open_input_file(path), zstandard.ZstdDecompressor()
        end = self.file.size()
        count, flags, magic = struct.unpack("<IBI", self._read(end - 9, 9))
        if magic != FOOTER_MAGIC or not flags & 0x80:
            raise ValueError(f"{uri} has no seek table with checksums")
        table_at = end - 9 - 12 * count - 8
        self.frames = np.frombuffer(self._read(table_at + 8, 12 * count), "<u4").reshape(count, 3).astype(np.int64)
        self.frame_at = np.concatenate([[0], np.cumsum(self.frames[:, 0])])
        index_at = int(self.frame_at[-1])
        index = self.open.decompress(self._read(index_at + 8, table_at - index_at - 8))
        width, self.n_documents = struct.unpack_from("<BI", index)
        self.dtype, self.index = f"<u{width}", np.frombuffer(index, ENTRY, self.n_documents, 5)
        self.known = self.index[np.count_nonzero(self.index["known"] == 0) :]

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def frame(self, number: int) -> np.ndarray:
        import xxhash

        raw = self.open.decompress(self._read(int(self.frame_at[number]), int(self.frames[number, 0])))
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.frames[number, 2]:
            raise ValueError(f"frame {number} is damaged")
        return np.frombuffer(raw, self.dtype)

    def document(self, doc_id: int) -> np.ndarray:
        at = int(np.searchsorted(self.known["doc_id"], doc_id))
        if at == len(self.known) or self.known[at]["doc_id"] != doc_id:
            raise KeyError(doc_id)
        entry = self.known[at]
        return self.frame(int(entry["frame"]))[entry["at"] : entry["at"] + entry["n"]]

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        number, ids = -1, None
        for known, doc_id, frame, at, n in self.index.tolist():
            if frame != number:
                number, ids = frame, self.frame(frame)
            yield doc_id if known else None, ids[at : at + n]


def with_end(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end_id`` after each document."""
    rows = len(bounds) - 1
    out = np.full(len(ids) + rows, end_id, np.uint32)
    out[np.arange(len(ids)) + np.repeat(np.arange(rows), np.diff(bounds))] = ids
    return out, bounds + np.arange(rows + 1)


def write_token_files(docs: DataFrame, vocabulary: str, folder: str, end_id: int = 0, layout: Format = Format()) -> DataFrame:
    """Writes docs(doc_id, text) in doc_id order; the manifest has shard, path, n_docs, n_tokens and bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from .bpe import worker_coder

        coder, shard = worker_coder(vocabulary), TaskContext.get().partitionId()
        writer, path = FrameWriter(layout), f"{folder}/part-{shard:06d}.tokens.zst"

        def parts() -> Iterable[bytes]:
            for batch in batches:
                for at, end, data, offsets in chunks(batch.column(1)):
                    if len(data) > coder.piece and end == at + 1:
                        yield from writer.add_parts(batch.column(0)[at].as_py(), chain(coder.encode_row(data), (np.array([end_id], np.uint32),)))
                        continue
                    ids, bounds = with_end(*coder.encode(data, offsets), end_id)
                    yield from writer.add(batch.column(0)[at:end].to_pylist(), ids, bounds)
            if writer.entries:
                yield from writer.close()

        stream = iter(parts())
        head = next(stream, None)
        if head is None:
            return
        size = write_whole(path, (p for source in ((head,), stream) for p in source))
        yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [path], "n_docs": [len(writer.entries)], "n_tokens": [writer.tokens], "bytes": [size]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark"), F.monotonically_increasing_id().alias("place"))
    ordered = rows.repartitionByRange("doc_id", "mark", "place").sortWithinPartitions("doc_id", "mark", "place").select("doc_id", "text")
    return stored(ordered.mapInArrow(run, "shard long, path string, n_docs long, n_tokens long, bytes long"), "token-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files of a manifest (one row a file)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                for doc_id, ids in TokenFile(path).documents():
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("path", before.alias("start"))
    return files.repartition(max(1, manifest.count())).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files_round_trip(docs: DataFrame, vocabulary: str, end_id: int = 0, layout: Format = Format()) -> DataFrame:
    return read_token_files(write_token_files(docs, vocabulary, new_folder(docs.sparkSession, "tokens"), end_id, layout))
