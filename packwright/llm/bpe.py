"""Byte-level BPE encoding and decoding of whole texts, equal to the tokenizers library.

The library encodes one pretoken at a time; here its regular expression becomes array operations
over the code points of a chunk, each distinct pretoken goes through the library once, and the ids
of all texts are gathered from those.  A pretoken that its rule cannot split (a very long run of
one character class) is encoded by tree concatenation: its halves, cut down to leaves, are encoded
in one parallel batch; then each join re-encodes a window around the seam, growing it until its
first id equals the left side's id at that place and its last id the right side's.  BPE ids are
right if and only if each adjacent pair of ids is, so agreement at both ends makes the whole exact.

A pretoken that was met before is found by a hash and then compared byte by byte, so texts whose
hashes collide keep their own ids.  A text of more than ``PIECE_BYTES`` is worked off in pieces that
end where pretokens end, so memory does not grow with it.  Where a run leaves no such place, it is cut
anywhere, and the ids on both sides of the cut are joined like two halves of the tree.

Defined cases: null reads as empty; an empty text has no ids; the special token's string in a text
is its single id, as the library has it; repeated rows give repeated rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textscan import EXACT_BYTES, IS_SPACE, STARTS_CHAR, chunks, equal_spans, map_columns, span_hashes

LETTER, NUMBER, SPACE, OTHER, UNKNOWN = 1, 2, 3, 4, 0
SLOT_BITS = 19
PIECE_BYTES = 1 << 20
#: The suffixes that the byte-level rule splits off after an apostrophe.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def byte_alphabet() -> dict[str, int]:
    """The visible character that stands for each byte in a byte-level vocabulary."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteBpe:
    """Encoder and decoder for one worker.  leaf: code points of a tree leaf; keep: pretokens remembered; piece: bytes at a time of a long text."""

    def __init__(self, path: str, leaf: int = 2048, window: int = 8, keep: int = 200_000, piece: int = PIECE_BYTES):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.leaf, self.window, self.keep, self.piece = leaf, window, keep, piece
        letters = byte_alphabet()
        self.model = self.library.model
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.special = [str(t.content) for t in self.library.get_added_tokens_decoder().values()]
        self.pieces = [b""] * (max(vocabulary.values()) + 1)
        for token, number in vocabulary.items():
            self.pieces[number] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.piece_size = np.array([len(p) for p in self.pieces], np.int64)
        self.piece_at = np.cumsum(self.piece_size) - self.piece_size
        self.piece_bytes = np.frombuffer(b"".join(self.pieces), np.uint8)
        decimals = [f"{i},".encode() for i in range(len(self.pieces))]
        self.decimal_size = np.array([len(d) for d in decimals], np.int64)
        self.decimals = np.array(decimals, "S8").view(np.uint64)
        #: Latin-1 reading of a text's UTF-8 to the byte alphabet.
        self.shown = {byte: letter for letter, byte in letters.items()}
        self.classes = np.zeros(0x110000, np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.clashing: dict[bytes, int] = {}  # pretokens whose hash belongs to another one
        # the first pretoken of each slot is found by array operations, later ones by the dictionary
        self.slot_key, self.slot_entry = np.zeros(1 << SLOT_BITS, np.uint64), np.full(1 << SLOT_BITS, -1, np.int32)
        self.entries, self.first, self.count = 0, np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.flat, self.used = np.zeros(4096, np.uint32), 0
        self.text_at, self.text_end = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.text, self.text_used = np.zeros(4096, np.uint8), 0

    def _classify(self, code_points: np.ndarray) -> np.ndarray:
        found = self.classes[code_points]
        if not found.all():
            parts = lambda text: len(self.library.pre_tokenizer.pre_tokenize_str(text))
            for point in np.unique(code_points[found == UNKNOWN]).tolist():
                c = chr(point)
                self.classes[point] = next((kind for kind, before in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if parts(before + c) == 1), SPACE)
            found = self.classes[code_points]
        return found

    def _pretokens(self, text: str, points: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Start of each pretoken; rows: code point offsets of the texts."""
        n = len(points)
        cuts, inner = rows, []
        for special in self.special:
            at = text.find(special)
            while at >= 0:
                row_end = rows[np.searchsorted(rows, at, "right")]
                if at + len(special) <= row_end:
                    inner.append((at, at + len(special)))
                    at = text.find(special, at + len(special))
                else:  # two texts that meet
                    at = text.find(special, at + 1)
        if inner:
            cuts = np.union1d(rows, np.array(inner).ravel())
        kind = self._classify(points)
        edge = np.zeros(n + 1, bool)
        edge[cuts] = True
        change = np.ones(n, bool)
        change[1:] = kind[1:] != kind[:-1]
        run = change | edge[:-1]
        starts = run.copy()
        after_space = np.flatnonzero(run[1:] & ~edge[1:n] & (kind[1:] != SPACE) & (kind[:-1] == SPACE)) + 1
        starts[after_space - 1] = True
        joined = after_space[points[after_space - 1] == 32]
        starts[joined] = False
        quotes = np.flatnonzero(run & (points == 39))
        for p in quotes[(quotes + 1 < n)].tolist():
            if kind[p + 1] != LETTER or edge[p + 1] or (p and points[p - 1] == 32 and not edge[p]):
                continue
            end = int(cuts[np.searchsorted(cuts, p, "right")])
            size = next((len(s) for s in CONTRACTIONS if p + 1 + len(s) <= end and text.startswith(s, p + 1)), 0)
            if size:
                starts[p + 1] = False
                if p + 1 + size < n:
                    starts[p + 1 + size] = True
        for begin, end in inner:
            starts[begin:end] = False
            starts[begin] = True
        return np.flatnonzero(starts)

    def encode_pieces(self, texts: list[str]) -> list[list[int]]:
        """The library's batch encoding: leaves of a tree in parallel."""
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_pretoken(self, text: str) -> list[int]:
        """The library's BPE model alone, for what its pretoken rule would leave whole anyway."""
        if text in self.special:
            return [self.library.token_to_id(text)]
        return [t.id for t in self.model.tokenize(text.encode().decode("latin-1").translate(self.shown))]

    def encode_long(self, text: str) -> np.ndarray:
        """Tree concatenation of a run that the pretoken rule leaves whole."""
        bounds = [0, len(text)]
        while bounds[1] - bounds[0] > self.leaf:
            bounds = sorted({*bounds, *((a + b) // 2 for a, b in zip(bounds, bounds[1:]))})
        level: list[np.ndarray] = []
        for i in range(0, len(bounds) - 1, 256):  # as arrays, which are smaller than lists
            part = bounds[i : i + 257]
            level += [np.array(x, np.uint32) for x in self.encode_pieces([text[a:b] for a, b in zip(part, part[1:])])]
        while len(level) > 1:
            level = [self.join(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of the concatenation of two encoded halves of one run."""
        if not len(left) or not len(right):
            return left if len(left) else right
        opens = lambda ids, i: i in (0, len(ids)) or STARTS_CHAR[self.pieces[ids[i]][0]]
        size = self.window
        while True:
            i, j = max(0, len(left) - size), min(len(right), size)
            while not opens(left, i):
                i -= 1
            while not opens(right, j):
                j += 1
            seam = self.encode_pieces([b"".join(self.pieces[x] for x in (*left[i:], *right[:j])).decode()])[0]
            if (i == 0 or seam[0] == left[i]) and (j == len(right) or seam[-1] == right[j - 1]):
                return np.concatenate([left[:i], np.array(seam, np.uint32), right[j:]])
            size *= 2

    def _learn(self, texts: list[str]) -> range:
        """Entries of new pretokens."""
        ids = [self.encode_pretoken(t) if len(t) <= self.leaf else self.encode_long(t) for t in texts]
        return self._remember([t.encode() for t in texts], np.concatenate([np.asarray(x, np.uint32) for x in ids]), np.array([len(x) for x in ids], np.int64))

    def _remember(self, raw: list[bytes], ids: np.ndarray, size: np.ndarray) -> range:
        """Entries of new pretokens with all their ids and how many each has."""
        n, new = self.entries, len(raw)
        self.entries = n + new
        while self.entries > len(self.first):
            self.first, self.count, self.text_at, self.text_end = (np.concatenate([x, np.zeros(len(x) // 2, x.dtype)]) for x in (self.first, self.count, self.text_at, self.text_end))
        self.count[n : n + new] = size
        self.first[n : n + new] = self.used + np.cumsum(size) - size
        self.flat, self.used = _appended(self.flat, self.used, ids)
        size = np.array([len(x) for x in raw], np.int64)
        self.text_end[n : n + new] = self.text_used + np.cumsum(size)
        self.text_at[n : n + new] = self.text_end[n : n + new] - size
        self.text, self.text_used = _appended(self.text, self.text_used, np.frombuffer(b"".join(raw), np.uint8))
        return range(n, n + new)

    def _entries(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Where the ids of each pretoken data[start:end] stand; new ones are learned."""
        text = lambda i: data[start[i] : end[i]].tobytes().decode()
        keys = span_hashes(data, start, end)
        slots = keys >> np.uint64(64 - SLOT_BITS)
        entry = self.slot_entry[slots]
        miss = np.flatnonzero((entry < 0) | (self.slot_key[slots] != keys))
        if len(miss):
            rare, at, which = np.unique(keys[miss], return_index=True, return_inverse=True)
            rare, at = rare.tolist(), miss[at]
            new = [i for i, k in enumerate(rare) if k not in self.known]
            if new:
                learned = self._learn([text(at[i]) for i in new])
                self.known.update((rare[i], n) for i, n in zip(new, learned))
                fresh = np.array([rare[i] for i in new], np.uint64)
                slot, place = np.unique(fresh >> np.uint64(64 - SLOT_BITS), return_index=True)
                free = self.slot_entry[slot] < 0
                self.slot_key[slot[free]], self.slot_entry[slot[free]] = fresh[place[free]], learned.start + place[free]
            entry[miss] = np.fromiter(map(self.known.__getitem__, rare), np.int32, len(rare))[which]
        size = end - start
        same = size == self.text_end[entry] - self.text_at[entry]
        long = np.flatnonzero(same & (size > EXACT_BYTES))
        same[long] = equal_spans(data, start[long], end[long], self.text, self.text_at[entry[long]], self.text_end[entry[long]])
        for i in np.flatnonzero(~same).tolist():
            own = data[start[i] : end[i]].tobytes()
            if own not in self.clashing:
                self.clashing[own] = self._learn([own.decode()])[0]
            entry[i] = self.clashing[own]
        return entry

    def _encoded(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of a chunk of texts, each text's bounds in them (rows + 1 entries), and the number of ids of each pretoken."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64), np.zeros(0, np.int64)
        try:
            text = data.tobytes().decode()
            chars = np.zeros(len(data) + 1, np.int64)
            np.cumsum(STARTS_CHAR[data], out=chars[1:])
            rows = chars[offsets]
        except UnicodeDecodeError:  # a broken row must not shift its neighbours
            parts = [data[a:b].tobytes().decode(errors="replace") for a, b in zip(offsets[:-1], offsets[1:])]
            text, rows = "".join(parts), np.cumsum([0, *map(len, parts)])
            data = np.frombuffer(text.encode(), np.uint8)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        start = self._pretokens(text, points, rows)
        if len(self.known) > self.keep or self.used > 8 * self.keep or self.text_used > 32 * self.keep:
            self._forget()
        at = start if len(points) == len(data) else np.flatnonzero(STARTS_CHAR[data])[start]
        entry = self._entries(data, at, np.append(at[1:], len(data)))
        size = self.count[entry]
        bound = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=bound[1:])
        ids = self.flat[np.repeat(self.first[entry] - bound[:-1], size) + np.arange(bound[-1])]
        return ids, bound[np.searchsorted(start, rows)], size

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a chunk of texts, and each text's bounds in them (rows + 1 entries)."""
        return self._encoded(data, offsets)[:2]

    def _cut(self, data: np.ndarray, at: int) -> tuple[int, bool]:
        """The first place from ``at`` on where a pretoken starts whatever stands around it; or a place inside a run, and True."""
        size, n = 1 << 12, len(data)
        while True:
            end = min(n, at + size)
            before, after = data[at - 1 : end - 1], data[at:end]
            for p in (np.flatnonzero(IS_SPACE[after] & ~IS_SPACE[before] & (before < 128)) + at).tolist():
                if not self._in_special(data, p):
                    return p, False
            window = slice(at + int(STARTS_CHAR[after].argmax()), end - int(STARTS_CHAR[after][::-1].argmax()) - 1)
            try:
                points = np.frombuffer(data[window].tobytes().decode().encode("utf-32-le"), np.uint32)
            except UnicodeDecodeError:
                points = np.zeros(0, np.uint32)
            if len(points) > 8:
                kind, where = self._classify(points), np.flatnonzero(STARTS_CHAR[data[window]]) + window.start
                quote = np.flatnonzero(points == 39)
                calm = np.ones(len(points), bool)
                for by in range(-3, 5):  # an apostrophe may take letters that follow it
                    calm[np.clip(quote + by, 0, len(points) - 1)] = False
                fit = np.flatnonzero((kind[1:] != kind[:-1]) & (kind[:-1] != SPACE) & (kind[1:] != SPACE) & calm[1:]) + 1
                for p in where[fit[fit > 3]].tolist():
                    if not self._in_special(data, p):
                        return p, False
                if size >= self.piece:
                    whole = np.flatnonzero((kind[2:] == kind[1:-1]) & (kind[1:-1] == kind[:-2])) + 1
                    for p in where[whole[:64]].tolist():
                        if not self._in_special(data, p):
                            return p, True
            if end == n:
                return n, False
            size *= 2

    def _in_special(self, data: np.ndarray, at: int) -> bool:
        return any(s.encode() in data[max(0, at - len(s.encode()) + 1) : at + len(s.encode()) - 1].tobytes() for s in self.special)

    def _parts(self, ids: np.ndarray) -> Iterator[np.ndarray]:
        """The ids of a run in parts that start with a character."""
        a = 0
        while a < len(ids):
            b = min(len(ids), a + self.piece // 4 + 1)
            while b < len(ids) and not STARTS_CHAR[self.pieces[ids[b]][0]]:
                b += 1
            yield ids[a:b]
            a = b

    def encode_row(self, data: np.ndarray) -> Iterator[np.ndarray]:
        """Ids of one text of any length, in parts that end where a character ends."""
        a, run, inside = 0, np.zeros(0, np.uint32), False
        while a < len(data):
            b, cut = self._cut(data, a + self.piece) if a + self.piece < len(data) else (len(data), False)
            ids, _, sizes = self._encoded(data[a:b], np.array([0, b - a]))
            if inside:  # the first pretoken goes on with the run
                run, ids, sizes = self.join(run, ids[: sizes[0]]), ids[sizes[0] :], sizes[1:]
            if len(sizes) or not cut:
                yield from self._parts(run)
                whole = len(ids) - int(sizes[-1]) if cut else len(ids)
                if whole:
                    yield ids[:whole]
                run = ids[whole:]
            a, inside = b, cut

    def decode_bytes(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes that the ids stand for, and each text's bounds in them."""
        size = self.piece_size[ids]
        bound = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=bound[1:])
        return self.piece_bytes[np.repeat(self.piece_at[ids] - bound[:-1], size) + np.arange(bound[-1])], bound[bounds]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """UTF-8 of each decoded text; bytes that are no UTF-8 become U+FFFD."""
        data, at = self.decode_bytes(ids, bounds)
        whole = data.tobytes()
        texts = [whole[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        return [t if _is_utf8(t) else t.decode(errors="replace").encode() for t in texts]

    def decimal_text(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """Each text's ids in decimal, joined by commas."""
        size = self.decimal_size[ids]
        at = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(size, out=at[1:])
        table = self.decimals[ids].view(np.uint8).reshape(-1, 8)
        whole = table[np.arange(8) < size[:, None]].tobytes()
        return [whole[a : max(a, b - 1)] for a, b in zip(at[bounds[:-1]].tolist(), at[bounds[1:]].tolist())]


@lru_cache(maxsize=2)
def worker_coder(path: str, leaf: int = 2048) -> ByteBpe:
    """One coder for all tasks of a Python worker, so that later tasks know the pretokens of earlier ones."""
    return ByteBpe(path, leaf)


def _appended(store: np.ndarray, used: int, more: np.ndarray) -> tuple[np.ndarray, int]:
    """``store`` with ``more`` from ``used`` on, with half of its size more where it has no room, and what is used then."""
    while used + len(more) > len(store):
        store = np.concatenate([store, np.zeros(len(store) // 2, store.dtype)])
    store[used : used + len(more)] = more
    return store, used + len(more)


def _is_utf8(data: bytes) -> bool:
    try:
        data.decode()
    except UnicodeDecodeError:
        return False
    return True


def encode_texts(docs: DataFrame, path: str, leaf: int = 2048) -> DataFrame:
    """doc_id, ids of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = worker_coder(path, leaf)
        for batch in batches:
            for at, end, data, offsets in chunks(batch.column(1)):
                if len(data) > coder.piece and end == at + 1:
                    ids = np.concatenate(list(coder.encode_row(data)))
                    bounds = np.array([0, len(ids)])
                else:
                    ids, bounds = coder.encode(data, offsets)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[at:end].cast(pa.int64()), lists], ["doc_id", "ids"])

    return map_columns(docs, ["doc_id", "text"], run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of encoded(doc_id, ids); null ids read as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = worker_coder(path)
        for batch in batches:
            ids = [np.asarray(x or (), np.int64) for x in batch.column(1).to_pylist()]
            texts = coder.decode(np.concatenate([np.zeros(0, np.int64), *ids]), np.cumsum([0, *map(len, ids)]))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "text"])

    return map_columns(encoded, ["doc_id", "ids"], run, "doc_id long, text string")


def long_digests(coder: ByteBpe, data: np.ndarray) -> tuple[int, str, str]:
    """Number of ids and both digests of one long text, piece by piece."""
    n, ids_digest, text_digest = 0, hashlib.sha256(), hashlib.sha256()
    for ids in coder.encode_row(data):
        bounds = np.array([0, len(ids)])
        ids_digest.update((b"," if n else b"") + coder.decimal_text(ids, bounds)[0])
        text_digest.update(coder.decode(ids, bounds)[0])
        n += len(ids)
    return n, ids_digest.hexdigest(), text_digest.hexdigest()


def round_trip_digests(docs: DataFrame, path: str, leaf: int = 2048) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes and decodes every text in one map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = worker_coder(path, leaf)
        digest = lambda parts: pa.array([hashlib.sha256(p).hexdigest() for p in parts], pa.string())
        for batch in batches:
            for at, end, data, offsets in chunks(batch.column(1)):
                if len(data) > coder.piece and end == at + 1:
                    columns = [batch.column(0)[at:end].cast(pa.int64()), *([x] for x in long_digests(coder, data))]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                    continue
                ids, bounds = coder.encode(data, offsets)
                columns = [batch.column(0)[at:end].cast(pa.int64()), pa.array(np.diff(bounds), pa.int64()), digest(coder.decimal_text(ids, bounds)), digest(coder.decode(ids, bounds))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_columns(docs, ["doc_id", "text"], run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
