"""Vectorised scans of Arrow text batches: words, word hashes, shingle sets.

Everything here runs inside ``mapInArrow`` tasks.  A batch is cut into chunks of a few MB so that
the numpy temporaries stay small whatever the Arrow batch size; a longer document is a chunk alone.

A word is a maximal run of bytes outside ``\\x20\\x09-\\x0D``.  Those bytes never occur inside a
multi-byte UTF-8 sequence, so byte scans equal code point scans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

CHUNK_BYTES = 1 << 20

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
FOLD_AZ = np.arange(256, dtype=np.uint8)
FOLD_AZ[65:91] += 32
STARTS_CHAR = (np.arange(256) & 0xC0) != 0x80  # not a UTF-8 continuation byte

_U = np.uint64
_ODD = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], np.uint64)
_AT_ONCE = 1 << 18  # spans worked off together, so that temporaries stay small
EXACT_BYTES = 8  # spans of equal size up to this have equal hashes only if they are equal: each step is a bijection
_LONG_SPAN = 128  # bytes; longer spans are hashed and compared one by one


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows with about ``limit`` bytes together."""
    data, offsets = text_buffers(column)
    rows, at = len(offsets) - 1, 0
    while at < rows:
        end = max(at + 1, min(rows, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1))
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _eights(data: np.ndarray, first: int, last: int) -> tuple[np.ndarray, int]:
    """For each byte from ``first`` to ``last`` the eight from it on as a number (little-endian), and what to take off places."""
    padded = np.zeros(last - first + 8, np.uint8)
    padded[: last - first] = data[first:last]
    return np.ndarray(last - first + 1, "<u8", padded, strides=(1,)), first


def _eight(eights: tuple[np.ndarray, int], at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The first ``size`` (at most eight) bytes from ``at`` on."""
    return eights[0][at - eights[1]] & (_U(0xFFFFFFFFFFFFFFFF) >> (_U(64) - _U(8) * np.minimum(size, 8).astype(np.uint64)))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each data[start:end] (bytes), the same wherever the span stands.

    Eight bytes at a time go through the finaliser, so it is not linear in the text; two seeds give independent
    hashes.  Equal hashes are still no proof: what must be exact compares the bytes (``equal_spans``).
    """
    if len(start) > _AT_ONCE:
        return np.concatenate([span_hashes(data, start[i : i + _AT_ONCE], end[i : i + _AT_ONCE], seed) for i in range(0, len(start), _AT_ONCE)])
    size = end - start
    out = mixed(size.astype(np.uint64) * _ODD[1] + _U(seed) * _ODD[0])
    if not len(size):
        return out
    eights = _eights(data, int(start.min()), int(end.max()))
    if size.min() > 0:
        out = mixed((out ^ _eight(eights, start, size)) * _ODD[0])
        done, open_ = 8, np.flatnonzero((size > 8) & (size <= _LONG_SPAN))
    else:
        done, open_ = 0, np.flatnonzero((size > 0) & (size <= _LONG_SPAN))
    while len(open_):
        out[open_] = mixed((out[open_] ^ _eight(eights, start[open_] + done, size[open_] - done)) * _ODD[0])
        done += 8
        open_ = open_[size[open_] > done]
    for i in np.flatnonzero(size > _LONG_SPAN).tolist():
        out[i] = xxhash.xxh3_64_intdigest(memoryview(data[start[i] : end[i]]), seed)
    return out


def equal_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray, other_start: np.ndarray, other_end: np.ndarray) -> np.ndarray:
    """Whether data[start:end] equals other[other_start:other_end], byte by byte, for each pair of spans."""
    if len(start) > _AT_ONCE:
        return np.concatenate([equal_spans(data, start[p], end[p], other, other_start[p], other_end[p]) for i in range(0, len(start), _AT_ONCE) for p in [slice(i, i + _AT_ONCE)]])
    size = end - start
    same = size == other_end - other_start
    open_, done = np.flatnonzero(same & (size > 0) & (size <= _LONG_SPAN)), 0
    if len(open_):
        mine, theirs = (_eights(d, int(a[open_].min()), int(b[open_].max())) for d, a, b in ((data, start, end), (other, other_start, other_end)))
    while len(open_):
        left = size[open_] - done
        differ = _eight(mine, start[open_] + done, left) != _eight(theirs, other_start[open_] + done, left)
        same[open_[differ]] = False
        open_ = open_[~differ & (left > 8)]
        done += 8
    for i in np.flatnonzero(same & (size > _LONG_SPAN)).tolist():
        same[i] = np.array_equal(data[start[i] : end[i]], other[other_start[i] : other_end[i]])
    return same


def repeats(keys: np.ndarray, most: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Places of the keys that occur more than once, and for each the first place of its key; about ``most`` keys at a time."""
    parts = max(1, 2 * len(keys) // most)
    part = (keys % _U(parts)).astype(np.uint8 if parts <= 256 else np.uint32) if parts > 1 else None
    places, leads = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(parts):
        own = np.flatnonzero(part == i) if parts > 1 else np.arange(len(keys))
        _, first, which, count = np.unique(keys[own], return_index=True, return_inverse=True, return_counts=True)
        again = count[which] > 1
        places.append(own[again])
        leads.append(own[first[which[again]]])
    return np.concatenate(places), np.concatenate(leads)


def told_apart(places: np.ndarray, leads: np.ndarray, same: np.ndarray, exact) -> tuple[np.ndarray, np.ndarray]:
    """The repeats of which ``same`` says that they equal their lead; groups with others are formed anew by ``exact(place)``."""
    wrong = np.isin(leads, leads[~same])
    if not wrong.any():
        return places, leads
    groups: dict = {}
    for i in np.sort(places[wrong]).tolist():
        groups.setdefault(exact(i), []).append(i)
    anew = [(i, own[0]) for own in groups.values() if len(own) > 1 for i in own]
    more = np.array(anew, np.int64).reshape(-1, 2)
    return np.concatenate([places[~wrong], more[:, 0]]), np.concatenate([leads[~wrong], more[:, 1]])


def repeated_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans that equal another span of their row, byte by byte, and for each the first of its equals."""
    places, leads = repeats(mixed(span_hashes(data, start, end) + row.astype(np.uint64) * _ODD[1]))
    same = (row[places] == row[leads]) & equal_spans(data, start[places], end[places], data, start[leads], end[leads])
    return told_apart(places, leads, same, lambda i: (int(row[i]), data[start[i] : end[i]].tobytes()))


def word_spans(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the index of its first word (rows + 1 entries); between: bytes that part words."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    ink = ~between[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    edge = np.empty(n, bool)
    edge[0] = ink[0]
    np.logical_not(ink[:-1], out=edge[1:])
    edge[1:] |= cut[1:n]
    edge &= ink
    start = np.flatnonzero(edge)
    edge[-1] = ink[-1]
    np.logical_not(ink[1:], out=edge[:-1])
    edge[:-1] |= cut[1:n]
    edge &= ink
    end = np.flatnonzero(edge) + 1
    return start, end, np.searchsorted(start, offsets)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """One hash for each run of ``size`` words; fewer words give none."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    total = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        total = mixed(total * _U(0x9FB21C651E98DF25) + words[i : len(words) - size + 1 + i])
    return total


class CharPlaces:
    """Code points before a byte of a text, without a number for each byte."""

    def __init__(self, data: np.ndarray, block: int = 1 << 12):
        self.data, self.block = data, block
        starts = np.arange(0, len(data), block)
        sums = np.add.reduceat(STARTS_CHAR[data], starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)
        self.before = np.concatenate([[0], np.cumsum(sums)])

    def __call__(self, at: int) -> int:
        block = at // self.block
        return int(self.before[block]) + int(np.count_nonzero(STARTS_CHAR[self.data[block * self.block : at]]))


def map_columns(df, columns: list[str], run, schema: str):
    """``df.select(columns).mapInArrow(run)``: run gets and yields record batches."""
    return df.select(*columns).mapInArrow(run, schema)


def map_rows(df, run):
    """``mapInArrow`` over whole rows with the schema kept; run sees the columns' own names, whatever signs they hold."""
    from pyspark.sql import types as T

    names, plain = df.columns, [f"_{i}" for i in range(len(df.columns))]

    def renamed(batches):
        for out in run(pa.RecordBatch.from_arrays(b.columns, names=names) for b in batches):
            yield pa.RecordBatch.from_arrays(out.columns, names=plain)

    schema = T.StructType([T.StructField(p, f.dataType, f.nullable) for p, f in zip(plain, df.schema.fields)])
    return df.toDF(*plain).mapInArrow(renamed, schema).toDF(*names)
