"""Packing of documents into sequences of one length each, without padding: power-of-two decomposition.

A document's ids, with the end id, are cut into pieces whose lengths are powers of two: as many of the
longest length as fit, then the binary digits of the rest, from the greatest on.  Each piece is a sequence
of its own, so no sequence crosses documents and none is padded.  Pieces of equal length form a bucket:
a training batch takes sequences of one bucket.  The buckets are written as Parquet, one folder a length,
in files that are levelled by size, whichever length is common.

``sequence_id`` holds the bucket, the task and the place in it, so ids of a bucket are one range; they need
no pass over all pieces, and a task that runs again gives the same ones.

The words of a text are encoded by the tokenizers library, each distinct one once: white space ends
pretokens of this vocabulary, and its normal forms don't join over it, so a text's ids are its words' ids.
A text of over ``PIECE_BYTES`` is worked off in pieces that end at white space; a word is held whole.

Defined cases: a null or empty text is the end id alone, one sequence of length 1; null doc_ids are kept;
repeated rows and equal doc_ids are documents of their own; an empty table gives no pieces; other columns
are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PIECE_BYTES, ByteBpe
from .files import new_folder
from .textscan import FOLD_AZ, IS_SPACE, chunks, map_columns, word_spans

#: 0: white space, 1: ASCII letter or digit, 2: ASCII sign that is no apostrophe, 3: any other byte.
_KIND = np.full(256, 3, np.uint8)
_KIND[33:127] = 2
_KIND[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")] = 1
_KIND[39], _KIND[IS_SPACE] = 3, 0

#: Fixed value of the vocabulary: what the last token of a pretoken ends with.
END_OF_WORD = "</w>"
#: Words that are one pretoken in any surroundings: Latin letters that stay such in lower case, or ASCII signs.
_SIMPLE = re.compile("[A-Za-zÀ-ÖØ-öø-įı-ſ]+|[!-&(-/:-@\\[-`{-~]+")

PIECES = "doc_id long, start long, length int, doc_tokens long, sequence_id long, offset int, ids binary"


@dataclass(frozen=True)
class Packing:
    """longest: ids of the longest sequence, a power of two; end_id: follows each document; wide: 4 bytes an id, else 2."""

    longest: int = 2048
    end_id: int = 1
    wide: bool = False

    def __post_init__(self):
        if self.longest < 1 or self.longest & (self.longest - 1):
            raise ValueError("the longest length is a power of two")

    @property
    def dtype(self) -> str:
        return "<u4" if self.wide else "<u2"


class WordBpe(ByteBpe):
    """Encoder whose pretokens never span white space: remembers ids by word.

    A word is also cut between an ASCII letter or digit and an ASCII sign other than an apostrophe, where no
    pretoken and no normal form goes on, unless the texts hold the string of a special token.
    """

    def __init__(self, path: str, keep: int = 800_000, piece: int = PIECE_BYTES):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.keep, self.piece = keep, piece
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith(END_OF_WORD)]] = True
        self._forget()

    def _simple(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of words of one pretoken each, encoded as one text, and how many each has."""
        ids = np.array(self.library.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        return ids, np.diff(np.append(-1, np.flatnonzero(self.ends_word[ids])))

    def _other(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words, each encoded alone, and how many each has."""
        found = [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(words, add_special_tokens=False)]
        return np.concatenate(found), np.array([len(x) for x in found], np.int64)

    def _learn(self, texts: list[str]) -> range:
        simple = np.array([_SIMPLE.fullmatch(t) is not None for t in texts], bool)
        order = np.concatenate([np.flatnonzero(simple), np.flatnonzero(~simple)])
        parts = [f([texts[i] for i in own.tolist()]) for f, own in ((self._simple, np.flatnonzero(simple)), (self._other, np.flatnonzero(~simple))) if len(own)]
        size = np.concatenate([p[1] for p in parts])
        first = np.empty(len(texts), np.int64)
        first[order] = self.used + np.cumsum(size) - size
        own = np.empty(len(texts), np.int64)
        own[order] = size
        new = self._remember([t.encode() for t in texts], np.concatenate([p[0] for p in parts]), own)
        self.first[new.start : new.stop] = first
        return new

    def _spans(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Folded bytes, starts and ends of words, and for each row the index of its first word (rows + 1 entries)."""
        whole = data.tobytes()
        if any(s in whole for s in self.special):
            return data, *word_spans(data, offsets)
        kind, n = _KIND[data], len(data)
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        both = kind[1:] * 4 + kind[:-1]
        edge[1:n] |= (kind[:-1] == 0) | (both == 9) | (both == 6)
        edge[:n] &= kind > 0
        start = np.flatnonzero(edge[:n])
        ends = np.ones(n, bool)
        ends[:-1] = (kind[1:] == 0) | edge[1:n]
        cut = offsets[(offsets > 0) & (offsets < n)]
        ends[cut - 1] = True
        end = np.flatnonzero(ends & (kind > 0)) + 1
        folded = FOLD_AZ[data]
        # a letter that a mark may follow stays, as the normal form comes before lower case
        before_mark = np.flatnonzero(data[1:] > 127)
        folded[before_mark] = data[before_mark]
        return folded, start, end, np.searchsorted(start, offsets)

    def _encoded(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data, start, end, first = self._spans(data, offsets) if len(data) else (data, *word_spans(data, offsets))
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64), np.zeros(0, np.int64)
        if len(self.known) > self.keep or self.used > 8 * self.keep or self.text_used > 32 * self.keep:
            self._forget()
        entry = self._entries(data, start, end)
        size = self.count[entry]
        bound = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=bound[1:])
        return self.flat[np.repeat(self.first[entry] - bound[:-1], size) + np.arange(bound[-1])], bound[first], size

    def encode_row(self, data: np.ndarray) -> Iterator[np.ndarray]:
        """Ids of one text of any length, in parts that end where a word ends."""
        at = 0
        while at < len(data):
            end = at + self.piece
            while end < len(data) and not IS_SPACE[data[end]]:
                end += 1
            end = min(end, len(data))
            yield self._encoded(data[at:end], np.array([0, end - at]))[0]
            at = end


@lru_cache(maxsize=2)
def worker_coder(path: str) -> WordBpe:
    """One coder for all tasks of a Python worker."""
    return WordBpe(path)


def binary_lengths(n: int, longest: int) -> np.ndarray:
    """Powers of two with sum ``n``: the longest as often as it fits, then the digits of the rest."""
    rest = n % longest
    return np.array([longest] * (n // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1], np.int64)


class Bucketed:
    """Gives each piece of a task its sequence: the bucket's exponent, the task and the place among its own of that length."""

    def __init__(self, task: int):
        self.task, self.placed = task, np.zeros(64, np.int64)

    def __call__(self, lengths: np.ndarray) -> np.ndarray:
        exponent = np.log2(lengths).astype(np.int64)
        # places of equal lengths in their order
        order = np.argsort(exponent, kind="stable")
        found, first, count = np.unique(exponent[order], return_index=True, return_counts=True)
        place = np.empty(len(lengths), np.int64)
        place[order] = np.arange(len(lengths)) - np.repeat(first, count) + np.repeat(self.placed[found], count)
        self.placed[found] += count
        return exponent << 58 | self.task << 34 | place


def pieces(docs: DataFrame, path: str, options: Packing = Packing()) -> DataFrame:
    """Columns ``PIECES`` of docs(doc_id, text); ids are little-endian."""
    names = [c.split()[0] for c in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, bucketed, table = worker_coder(path), Bucketed(TaskContext.get().partitionId()), {}

        def cut(n: int) -> np.ndarray:
            if n not in table:
                table[n] = binary_lengths(n, options.longest)
            return table[n] if n < 1 << 14 else table.pop(n)

        for batch in batches:
            for at, end, data, offsets in chunks(batch.column(1)):
                if len(data) > coder.piece and end == at + 1:
                    ids = np.concatenate([*coder.encode_row(data), np.zeros(0, np.uint32)])
                    bounds = np.array([0, len(ids)])
                else:
                    ids, bounds = coder.encode(data, offsets)
                if not options.wide and len(ids) and ids.max() > 0xFFFF:
                    raise ValueError("these ids need a wide format")
                whole = np.full(len(ids) + end - at, options.end_id, options.dtype)
                whole[np.arange(len(ids)) + np.repeat(np.arange(end - at), np.diff(bounds))] = ids
                bounds = bounds + np.arange(end - at + 1)
                cuts = [cut(n) for n in np.diff(bounds).tolist()]
                length = np.concatenate(cuts)
                bound = np.concatenate([[0], np.cumsum(length)])  # the pieces cover the ids in their order
                of = np.repeat(np.arange(end - at), [len(c) for c in cuts])
                flat = pa.BinaryArray.from_buffers(pa.binary(), len(length), [None, pa.py_buffer((bound * whole.itemsize).astype(np.int32)), pa.py_buffer(whole)])
                doc_id = batch.column(0)[at:end].cast(pa.int64()).take(pa.array(of))
                columns = [doc_id, bound[:-1] - bounds[of], length.astype(np.int32), np.diff(bounds)[of], bucketed(length), np.zeros(len(length), np.int32), flat]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)

    return map_columns(docs, ["doc_id", "text"], run, PIECES)


def write_sequences(docs: DataFrame, path: str, folder: str, options: Packing = Packing()) -> None:
    """Writes the sequences of docs(doc_id, text) under ``folder``, one folder a length, in files levelled by size."""
    pieces(docs, path, options).hint("rebalance", "length").write.partitionBy("length").parquet(folder)


def read_sequences(spark, folder: str) -> DataFrame:
    """Columns ``PIECES`` from a folder of sequences; ``length`` is pruned by folder."""
    columns = [c.split()[0] for c in PIECES.split(", ")]
    return spark.read.schema(PIECES).parquet(folder).select(*columns)


def sequence_digests(sequences: DataFrame, options: Packing = Packing()) -> DataFrame:
    """The sequences with ids_crc32, of the ids as unsigned 32-bit numbers, in place of ids."""
    kept = [c.split()[0] for c in PIECES.split(", ")][:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = [zlib.crc32(np.frombuffer(x.as_buffer(), options.dtype).astype("<u4").tobytes()) for x in batch.column(len(kept))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(crc, pa.int64())], [*kept, "ids_crc32"])

    return map_columns(sequences, [*kept, "ids"], run, PIECES.replace("ids binary", "ids_crc32 long"))


def packed(docs: DataFrame, path: str, options: Packing = Packing()) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece, read back from the written sequences."""
    folder = new_folder(docs.sparkSession, "sequences")
    write_sequences(docs, path, folder, options)
    long = ("length", "offset")
    found = sequence_digests(read_sequences(docs.sparkSession, folder), options)
    return found.select("doc_id", "start", *[F.col(c).cast("long").alias(c) for c in long[:1]], "ids_crc32", "doc_tokens", "sequence_id", F.col("offset").cast("long").alias("offset"))
