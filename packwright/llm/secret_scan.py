"""Secret scans: fixed patterns, and a linear-chain conditional random field that adds spans.

The field tags each token as begin, inside or outside of a secret, from its shape, the words around
it and features of the whole file.  It is trained on a bounded sample of documents, whose fixed
patterns label it, with invented credentials set among words of their texts, so that it also learns
contexts that no fixed pattern names.  What a first field tags in drawn texts without a fixed pattern there
is set against it as it is fitted on, one half of them after the other (``rounds``).  Over all of them a margin
is found that a secret has to gain over plain text: what the best of their false spans gains, but no more
than leaves ``kept`` of invented credentials, which are kept out of the fit as well.

Decoding is exact Viterbi, but only where it can matter: a bound on what leaving ``outside`` can gain
shows of most tokens that the best path stays there.  The few stretches between are decoded, and all
that the field tags is reported, with a digit in it or not.  A long text goes through the field in
pieces, with the tokens around each cut and the open stretch carried over, so its spans are the same.

Defined cases: null reads as empty; an empty text has no spans; a model span that touches a fixed
span is dropped in its favour; repeated rows give repeated rows; a token longer than a piece of a
long text is held whole; other columns pass through ``redacted`` and are not read by ``scan_secrets``; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import stored
from .textscan import CHUNK_BYTES, FOLD_AZ, IS_SPACE, CharPlaces, chunks, map_columns, map_rows, span_hashes

#: The patterns, in the order in which kinds are listed, and the least size of what they hold.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
KINDS = {"assign": (ASSIGN, 2, 6), "access": (ACCESS, 0, 20), "hex": (HEX, 0, 24)}
MODEL_KIND = "crf"
ORDER = {kind: i for i, kind in enumerate((*KINDS, MODEL_KIND))}

OUT, BEGIN, INSIDE = 0, 1, 2
WORD_BITS = 12
_WORDS = 1 << WORD_BITS
NEVER = -1e9  # a secret starts with ``begin``
PIECE_BYTES = 1 << 16  # of a long text at a time
_AROUND = 1 << 12  # bytes that hold a training window
_SIZES = np.array([1, 2, 3, 4, 5, 6, 8, 12, 16, 20, 24, 32, 40, 64, 128])

IS_HEX = np.zeros(256, bool)
IS_HEX[list(b"0123456789abcdef")] = True
_CLASS = np.full(256, 2, np.uint8)  # 2: a mark that is a token alone
_CLASS[IS_SPACE] = 0
_CLASS[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.-")] = 1
_CLASS[128:] = 1
_KIND_OF_BYTE = np.zeros((5, 256), np.uint8)
_KIND_OF_BYTE[0, 97:123] = _KIND_OF_BYTE[1, 65:91] = _KIND_OF_BYTE[2, 48:58] = _KIND_OF_BYTE[4, 128:] = 1
_KIND_OF_BYTE[3, list(b"+/_.-")] = 1


@dataclass(frozen=True)
class Training:
    """sample_rows: distinct labelled texts to fit on, out of about drawn_rows, each giving windows of ``reach`` tokens; copies: invented credentials; hard: windows of false spans."""

    sample_rows: int = 400
    drawn_rows: int = 10_000
    copies: int = 800
    reach: int = 30
    hard: int = 2000
    rounds: int = 2
    kept: float = 0.99
    epochs: int = 4
    rate: float = 0.2
    decay: float = 1e-4
    seed: int = 11


@dataclass(frozen=True)
class Field:
    """weights: a row of three scores for each feature value; moves[a, b]: score of going from a to b."""

    weights: np.ndarray
    moves: np.ndarray


class Raw:
    """Tokens of a chunk of rows, and what each shows by itself."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        kind, n = _CLASS[data], len(data)
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        begins = kind != 0
        if n:
            begins[1:] &= (kind[1:] == 2) | (kind[:-1] != kind[1:]) | cut[1:n]
        ends = kind != 0
        if n:
            ends[:-1] &= (kind[:-1] == 2) | (kind[:-1] != kind[1:]) | cut[1:n]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(self.first))
        size = self.end - self.start
        inside = []
        total = np.zeros(len(data) + 1, np.int32)
        for table in _KIND_OF_BYTE:
            np.cumsum(table[data], out=total[1:])
            inside.append(total[self.end] - total[self.start])
        lower, upper, digit, mark, wide = inside
        np.cumsum(IS_HEX[data], out=total[1:])
        pure_hex = (total[self.end] - total[self.start] == size) & (size > 1)
        digits = _KIND_OF_BYTE[2][data]
        np.cumsum(np.concatenate([[0], digits[1:] != digits[:-1]]), out=total[1:]) if n else None
        turns = total[self.end] - total[np.minimum(self.start + 1, self.end)]
        self.long = np.searchsorted(_SIZES, size, "right").astype(np.int32)
        self.shape = ((lower > 0) + 2 * (upper > 0) + 4 * (digit > 0) + 8 * (mark > 0) + 16 * (wide > 0) + 32 * pure_hex).astype(np.int32)
        self.mix = (np.minimum(self.long // 2, 7) * 64 + (8 * digit // (size + 1)) * 8 + np.minimum(turns, 7)).astype(np.int32)
        self.word = (span_hashes(FOLD_AZ[data], self.start, self.end) >> np.uint64(64 - WORD_BITS)).astype(np.int32)
        self.word[size > 24] = 0
        self.equals = data[self.start] == 61

    def joined(self, later: Raw, moved: int) -> Raw:
        """These tokens and those of ``later``, whose bytes start ``moved`` further on; all of one row."""
        both = object.__new__(Raw)
        for name in ("long", "shape", "mix", "word", "row", "equals"):
            setattr(both, name, np.concatenate([getattr(self, name), getattr(later, name)]))
        both.start, both.end = np.concatenate([self.start, later.start + moved]), np.concatenate([self.end, later.end + moved])
        return both

    def after(self, n: int) -> Raw:
        rest = object.__new__(Raw)
        for name in ("long", "shape", "mix", "word", "row", "equals", "start", "end"):
            setattr(rest, name, getattr(self, name)[n:])
        return rest


def share_feature(digits: np.ndarray, equals: np.ndarray, count: np.ndarray) -> np.ndarray:
    """What a file's tokens with digits and its equal signs tell of all its tokens."""
    share = lambda n: np.minimum(7, 16 * n // np.maximum(count, 1)).astype(np.int32)
    return share(digits) * 8 + share(equals)


def feature_columns(raw: Raw, file: np.ndarray) -> Iterator[np.ndarray]:
    """Feature values of the tokens, one feature after the other; file: each token's file feature."""

    def moved(values: np.ndarray, by: int, none: int) -> np.ndarray:
        """The value of the token ``by`` places on, ``none`` beyond the row."""
        out = np.full(len(values), none, np.int32)
        if by < 0 and len(values) > -by:
            out[-by:] = np.where(raw.row[-by:] == raw.row[:by], values[:by], none)
        elif by > 0 and len(values) > by:
            out[:-by] = np.where(raw.row[:-by] == raw.row[by:], values[by:], none)
        return out

    word, shape = raw.word, raw.shape
    columns = (
        lambda: raw.long, lambda: shape, lambda: raw.mix, lambda: moved(word, -1, 0), lambda: moved(word, -2, 0), lambda: moved(word, -3, 0), lambda: moved(word, 1, 0),
        lambda: moved(shape, -1, 64), lambda: moved(shape, 1, 64), lambda: file * 64 + shape,
    )
    return (column() + base for column, base in zip(columns, BASES))


def feature_values(raw: Raw, file: np.ndarray) -> np.ndarray:
    """Feature values of the tokens, one column a feature."""
    return np.stack([np.asarray(c, np.int32) for c in feature_columns(raw, file)], 1)


class Tokens:
    """Tokens of a chunk of rows and their feature values, one column a feature."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        raw = Raw(data, offsets)
        self.start, self.end, self.first, self.row = raw.start, raw.end, raw.first, raw.row
        if not len(raw.start):
            self.features = np.zeros((0, len(TABLES)), np.int32)
            return
        rows = len(self.first) - 1
        count = lambda flags: np.bincount(self.row, flags, rows).astype(np.int64)
        file = share_feature(count(raw.shape & 4 > 0), count(raw.equals), np.diff(self.first))
        self.features = feature_values(raw, file[self.row])


TABLES = (16, 64, 512, _WORDS, _WORDS, _WORDS, _WORDS, 65, 65, 64 * 64)
BASES = np.cumsum((0, *TABLES[:-1])).astype(np.int32)


def viterbi(scores: np.ndarray, moves: np.ndarray) -> list[int]:
    """Best tags of a stretch with ``outside`` before and after it."""
    best, back = scores[0].astype(np.float64) + moves[OUT], []
    for row in scores[1:]:
        ways = best[:, None] + moves
        back.append(ways.argmax(0))
        best = ways.max(0) + row
    tags = [int((best + moves[:, OUT]).argmax())]
    for pointers in reversed(back):
        tags.append(int(pointers[tags[-1]]))
    return tags[::-1]


def stretches(scores: np.ndarray, moves: np.ndarray, row: np.ndarray, carried: float = 0.0) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Ranges of tokens outside of which the best path is ``outside``, and the largest sum that ends at each token.

    Let u be the most that a token can gain over ``outside``, with one move.  If the best path has a
    secret over t that goes on, starting it at t + 1 instead is no better, so the sum of u from its
    start to t is at least -(the best move - the opening move + what ``inside`` gains over ``begin``
    at t + 1); if it ends at t, it is at least -(one move).  The largest sum that ends at t decides.
    carried: the largest sum that ends before the first token, where the row goes on from a piece before.
    """
    allowed = np.delete(moves.ravel(), OUT * 3 + INSIDE)
    step = max(0.0, float(allowed.max() - moves[OUT, OUT]))
    u = scores[:, BEGIN:].max(1).astype(np.float64) - scores[:, OUT] + step
    # a drop at each row's start keeps sums from reaching into the row before
    drop = -1e6 * (row - row[0])
    before = np.concatenate([[0.0], np.cumsum(u)[:-1]]) + drop
    largest = before + u - np.minimum(np.minimum.accumulate(before), -max(0.0, carried))
    later = np.append(np.maximum(0.0, scores[1:, INSIDE] - scores[1:, BEGIN]), 0.0)
    slack = np.maximum(step, float(allowed.max() - moves[OUT, BEGIN]) + later) + 1e-3
    held = largest >= -slack
    edge = np.flatnonzero(np.diff(np.concatenate([[False], held, [False]]).astype(np.int8)))
    out = []
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        cuts = [a, *(np.flatnonzero(row[a + 1 : b] != row[a : b - 1]) + a + 1).tolist(), b]
        out += zip(cuts, cuts[1:])
    return out, largest


def _scores(columns: Iterable[np.ndarray], count: int, field: Field) -> np.ndarray:
    scores = np.zeros((count, 3), np.float32)
    for column in columns:
        scores += field.weights[column]
    return scores


def _tagged(scores: np.ndarray, moves: np.ndarray, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Token ranges of the secrets in the stretch of tokens start to end."""
    opened = None
    for i, tag in enumerate([*viterbi(scores[start:end], moves), OUT], start):
        if opened is not None and tag != INSIDE:
            yield opened, i
            opened = None
        if tag == BEGIN or (tag == INSIDE and opened is None):
            opened = i


def model_spans(tokens: Tokens, field: Field) -> list[tuple[int, int, int]]:
    """(row, first byte, end byte) of what the field tags."""
    if not len(tokens.start):
        return []
    scores = _scores(tokens.features.T, len(tokens.start), field)
    ranges = stretches(scores, field.moves, tokens.row)[0]
    return [(int(tokens.row[a]), int(tokens.start[a]), int(tokens.end[b - 1])) for s, e in ranges for a, b in _tagged(scores, field.moves, s, e)]


def _token_cut(data: np.ndarray, at: int) -> int:
    """The first place from ``at`` on where no token is open."""
    size = 1 << 12
    while at < len(data):
        kind = _CLASS[data[at - 1 : at + size]]
        free = np.flatnonzero((kind[1:] != kind[:-1]) | (kind[1:] != 1))
        if len(free):
            return at + int(free[0])
        at += size
    return len(data)


def _pieces(data: np.ndarray, piece: int) -> Iterator[tuple[int, Raw, bool]]:
    """Where each piece starts, its tokens, and whether it is the last; pieces end where tokens end."""
    a = 0
    while a < len(data):
        b = _token_cut(data, a + piece) if a + piece < len(data) else len(data)
        yield a, Raw(data[a:b], np.array([0, b - a])), b == len(data)
        a = b


def file_feature(data: np.ndarray, piece: int = PIECE_BYTES) -> np.ndarray:
    """``share_feature`` of one text of any length."""
    n = digits = equals = 0
    for _, raw, _ in _pieces(data, piece):
        n, digits, equals = n + len(raw.start), digits + int(np.count_nonzero(raw.shape & 4)), equals + int(np.count_nonzero(raw.equals))
    return share_feature(np.array([digits]), np.array([equals]), np.array([n]))


def long_spans(data: np.ndarray, field: Field, piece: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """``model_spans`` of one text of any length, in two passes over its pieces: the file's features, then the spans."""
    for *span, _, _ in long_stretches(data, field, piece):
        yield tuple(span)


def long_stretches(data: np.ndarray, field: Field, piece: int = PIECE_BYTES) -> Iterator[tuple[int, int, float, int]]:
    """(first byte, end byte) of each span, and what its stretch gains over plain text, for each of how many spans."""
    file = file_feature(data, piece)
    held, context, carried = None, 0, 0.0  # tokens not decided yet, after ``context`` tokens that only show what stands before
    for a, raw, last in _pieces(data, piece):
        raw.start, raw.end = raw.start + a, raw.end + a
        held = raw if held is None else held.joined(raw, 0)
        if len(held.start) <= context + 1 and not last:
            continue
        if len(held.start) == context:
            continue
        scores = _scores((c[context:] for c in feature_columns(held, np.repeat(file, len(held.start)))), len(held.start) - context, field)
        ranges, largest = stretches(scores, field.moves, np.zeros(len(scores), np.int32), carried)
        done = len(scores) if last else len(scores) - 1
        if ranges and not last and ranges[-1][1] >= done:
            done = min(done, ranges[-1][0])
        for s, e in ranges:
            if e <= done and (found := list(_tagged(scores, field.moves, s, e))):
                gained = gain(scores[s:e], field.moves)
                for i, k in found:
                    yield int(held.start[context + i]), int(held.end[context + k - 1]), gained, len(found)
        if done:
            carried = float(largest[done - 1])
        keep = max(0, context + done - 3)
        context, held = context + done - keep, held.after(keep)


def gain(scores: np.ndarray, moves: np.ndarray) -> float:
    """What the best tags of a stretch score over ``outside`` throughout."""
    best = scores[0].astype(np.float64) + moves[OUT]
    for row in scores[1:]:
        best = (best[:, None] + moves).max(0) + row
    return float((best + moves[:, OUT]).max() - scores[:, OUT].sum(dtype=np.float64) - (len(scores) + 1) * moves[OUT, OUT])


def base_spans(text: bytes) -> list[tuple[str, int, int]]:
    """Fixed patterns in a text, in bytes; each kind leftmost and without overlap, too short matches dropped."""
    return [(kind, m.start(), m.end()) for kind, (pattern, group, least) in KINDS.items() for m in pattern.finditer(text) if len(m[group]) >= least]


def rows_to_match(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows that can hold a match of a fixed pattern; all other rows have none."""
    folded, raw, at = FOLD_AZ[data].tobytes(), data.tobytes(), []
    for where, needle in ((folded, b"passw"), (folded, b"secret"), (folded, b"token"), (folded, b"apikey"), (folded, b"api_key"), (raw, b"AKIA")):
        i = where.find(needle)
        while i >= 0:
            at.append(i)
            i = where.find(needle, i + 1)
    # a run of 24 holds a whole aligned block of 12
    full = data[: len(data) // 12 * 12].reshape(-1, 12)
    at.extend((12 * np.flatnonzero(IS_HEX[full].all(1)) + 11).tolist())
    return np.unique(np.searchsorted(offsets, np.array(at, np.int64), "right") - 1)


def _touches(kinds: Iterable[list[tuple[str, int, int]]], start: int, end: int) -> bool:
    """Whether a span overlaps start to end; those of one kind are in order and don't overlap."""
    for spans in kinds:
        i = bisect_left(spans, end, key=lambda x: x[1])
        if i and spans[i - 1][2] > start:
            return True
    return False


def chunk_spans(data: np.ndarray, offsets: np.ndarray, field: Field | None) -> list[list[tuple[str, int, int]]]:
    """For each row its spans as (kind, start, end) in bytes of the chunk, by start and then kind."""
    spans: list[list[tuple[str, int, int]]] = [[] for _ in range(len(offsets) - 1)]
    added: list[list[tuple[str, int, int]]] = [[] for _ in spans]
    kinds: dict[int, list[list[tuple[str, int, int]]]] = {}
    for row in rows_to_match(data, offsets).tolist():
        a = int(offsets[row])
        spans[row] = [(kind, a + s, a + e) for kind, s, e in base_spans(data[a : offsets[row + 1]].tobytes())]
    if field is not None:
        long = len(spans) == 1 and len(data) > CHUNK_BYTES
        for row, start, end in ((0, s, e) for s, e in long_spans(data, field)) if long else model_spans(Tokens(data, offsets), field):
            if row not in kinds:
                kinds[row] = [[x for x in spans[row] if x[0] == kind] for kind in KINDS] if spans[row] else []
            if not _touches(kinds[row], start, end):
                added[row].append((MODEL_KIND, start, end))
    return [sorted(base + more, key=lambda x: (x[1], ORDER[x[0]])) for base, more in zip(spans, added)]


_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: What invented credentials consist of: (letters, sizes, prefixes), names, and forms; NUL marks the ends of the secret.
VALUES = (
    (_UPPER + _DIGITS, (16,), ("AKIA",)), (_DIGITS + "abcdef", (32, 40, 64), ("",)), (_UPPER + _LOWER + _DIGITS + "+/", range(24, 65), ("",)),
    (_UPPER + _LOWER + _DIGITS, range(24, 41), ("ghp_", "sk_live_", "xoxb-", "glpat-")), (_UPPER + _LOWER + _DIGITS + "_-", range(16, 41), ("",)),
)
NAMES = ("password", "passwd", "pwd", "secret", "client_secret", "token", "auth_token", "api_key", "apikey", "access_key", "private_key", "Authorization", "credential")
FORMS = ('{n} = "\0{v}\0"', "{n}=\0{v}\0", "{n}: \0{v}\0", '"{n}": "\0{v}\0"', "{n}: Bearer \0{v}\0", "\0{v}\0")


def _credential(rnd: random.Random, values=VALUES, names=NAMES, forms=FORMS) -> str:
    """An invented credential in one of the usual forms, with what stands before and after it."""
    letters, sizes, prefixes = rnd.choice(values)
    value = rnd.choice(prefixes) + "".join(rnd.choice(letters) for _ in range(rnd.choice(sizes)))
    return rnd.choice(forms).format(n=rnd.choice(names), v=value)


Sequence = tuple[np.ndarray, np.ndarray]


def _window(data: np.ndarray, file: np.ndarray, place: int, secrets: list[tuple[int, int]], reach: int) -> Sequence | None:
    """Features and tags of the tokens around a place of a text."""
    a = _token_cut(data, place - _AROUND) if place > _AROUND else 0
    b = _token_cut(data, place + _AROUND) if place + _AROUND < len(data) else len(data)
    raw = Raw(data[a:b], np.array([0, b - a]))
    if not len(raw.start):
        return None
    features, tags = feature_values(raw, np.repeat(file, len(raw.start))), np.zeros(len(raw.start), np.int64)
    for s, e in secrets:
        held = np.flatnonzero((raw.start + a >= s) & (raw.end + a <= e))
        tags[held[1:]], tags[held[:1]] = INSIDE, BEGIN
    middle = max(0, int(np.searchsorted(raw.start, place - a, "right")) - 1)
    window = slice(max(0, middle - reach), middle + reach)
    return features[window], tags[window]


def labelled_windows(data: np.ndarray, options: Training) -> list[Sequence]:
    """Of a text with fixed patterns the window of the first; of another four at fixed places."""
    raw, rnd = data.tobytes(), random.Random(len(data) * 31 + int(data[:64].sum()))
    # of an assignment only the value is secret
    spans = [(ASSIGN.match(raw, s).start(2), e) if kind == "assign" else (s, e) for kind, s, e in base_spans(raw)]
    places = [min(spans)[0]] if spans else [rnd.randrange(len(raw)) for _ in range(4)] if raw else []
    file = file_feature(data)
    return [w for p in places if (w := _window(data, file, p, spans, options.reach))]


def false_windows(data: np.ndarray, field: Field, options: Training) -> list[tuple[float, Sequence]]:
    """What the field tags apart from the fixed patterns' spans: the gain of each span, and its window, of which nothing is secret."""
    base = sorted((s, e) for _, s, e in base_spans(data.tobytes()))
    file, out = file_feature(data), []
    secrets = [(s, e) for s, e in base]
    for s, e, gained, among in long_stretches(data, field):
        if not any(a < e and s < b for a, b in base):
            out.append((gained / among, _window(data, file, s, secrets, options.reach)))
    return out


def contexts_of(text: str, count: int) -> list[tuple[str, str]]:
    """Up to 40 words before and after ``count`` fixed places of a text."""
    rnd, out = random.Random(len(text)), []
    for _ in range(count):
        at = rnd.randrange(len(text) + 1)
        before, after = text[max(0, at - _AROUND) : at].split(" ")[-40:], text[at : at + _AROUND].split(" ")[:40]
        out.append((" ".join(before), " ".join(after)))
    return out


def planted(context: tuple[str, str], rnd: random.Random, credential) -> tuple[np.ndarray, tuple[int, int]]:
    """An invented credential among words, and where its secret lies."""
    before, value, after = credential(rnd).split("\0")
    head = f"{context[0]} {before}".encode(errors="replace")
    raw = head + value.encode() + after.encode() + b" " + context[1].encode(errors="replace")
    return np.frombuffer(raw, np.uint8), (len(head), len(head) + len(value))


def planted_windows(contexts: list[tuple[str, str]], count: int, options: Training, credential, seed: int) -> list[Sequence]:
    rnd, out = random.Random(seed), []
    for _ in range(count):
        data, secret = planted(rnd.choice(contexts), rnd, credential)
        if w := _window(data, file_feature(data), secret[0], [secret], options.reach):
            out.append(w)
    return out


def fit(sequences: list[Sequence], options: Training, start: Field | None = None) -> Field:
    """Stochastic gradient on the likelihood of the tags; from ``start`` on in one epoch."""
    weights, moves = (np.zeros((sum(TABLES), 3)), np.zeros((3, 3))) if start is None else (start.weights.astype(np.float64), start.moves.copy())
    moves[OUT, INSIDE] = NEVER
    order, rnd = list(range(len(sequences))), random.Random(options.seed)
    for epoch in range(options.epochs if start is None else 1):
        rnd.shuffle(order)
        rate = options.rate / (1 + epoch if start is None else options.epochs)
        for i in order:
            _step(weights, moves, *sequences[i], rate, options.decay)
    return Field(weights.astype(np.float32), moves)


def with_margin(field: Field, false_gains: list[float], contexts: list[tuple[str, str]], options: Training, credential) -> Field:
    """The field whose ``begin`` costs as much more as false spans gain, as far as that leaves ``kept`` of invented credentials."""
    rnd, gains = random.Random(options.seed + 1), []
    for _ in range(400):
        data, (s, e) = planted(rnd.choice(contexts), rnd, credential)
        gains.append(max((gained / among for a, b, gained, among in long_stretches(data, field) if a < e and s < b), default=0.0))
    most = sorted(gains)[int(len(gains) * (1 - options.kept))] * 0.8
    margin = max(0.0, min(max(false_gains, default=0.0) + 0.5, most))
    weights = field.weights.copy()
    weights[BASES[0] : BASES[1], BEGIN] -= margin  # each token has one value of the first feature
    return Field(weights, field.moves)


def train(texts: list[str], options: Training = Training(), credential=_credential) -> Field:
    """Fits the field on the texts given; false spans are looked for in the halves of them by turns."""
    datas = [np.frombuffer(t.encode(errors="replace"), np.uint8) for t in texts]
    contexts = [c for t in texts if t for c in contexts_of(t, 3)] or [("some plain words", "stand here")]
    sequences = [w for d in datas for w in labelled_windows(d, options)] + planted_windows(contexts, options.copies, options, credential, options.seed)
    field, hard = fit(sequences, options), []
    for i in range(options.rounds):
        more = [w for d in datas[i % 2 :: 2] for _, w in false_windows(d, field, options)][: options.hard]
        if not more:
            continue
        hard += more
        field = fit(sequences + hard, options, field)
    gains = [g for d in datas for g, _ in false_windows(d, field, options)]
    return with_margin(field, gains, contexts, options, credential)


def _step(weights: np.ndarray, moves: np.ndarray, features: np.ndarray, tags: np.ndarray, rate: float, decay: float) -> None:
    """One gradient step on a sequence: observed minus expected counts."""
    scores = weights[features].sum(1)
    n, power = len(tags), np.exp(moves)
    local = np.exp(scores - scores.max(1, keepdims=True))
    ahead, behind = np.empty((n, 3)), np.ones((n, 3))
    ahead[0] = local[0] / local[0].sum()
    for t in range(1, n):
        ahead[t] = (ahead[t - 1] @ power) * local[t]
        ahead[t] /= ahead[t].sum()
    for t in range(n - 2, -1, -1):
        behind[t] = power @ (local[t + 1] * behind[t + 1])
        behind[t] /= behind[t].sum()
    belief = ahead * behind
    belief /= belief.sum(1, keepdims=True)
    gradient = -belief
    gradient[np.arange(n), tags] += 1
    np.add.at(weights, features, rate * gradient[:, None, :])
    weights[features] *= 1 - rate * decay
    if n > 1:
        both = ahead[:-1, :, None] * power * (local[1:] * behind[1:])[:, None, :]
        both /= both.sum((1, 2), keepdims=True)
        observed = np.zeros((3, 3))
        np.add.at(observed, (tags[:-1], tags[1:]), 1)
        moves += 0.1 * rate * (observed - both.sum(0))
        moves[OUT, INSIDE] = NEVER


_WINDOW = "part double, gain double, features binary, tags binary"


def _window_rows(found: Iterable[tuple[float, float, Sequence]]) -> pa.RecordBatch:
    rows = [(part, gained, f.tobytes(), t.astype(np.int8).tobytes()) for part, gained, (f, t) in found]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.float64(), pa.float64(), pa.binary(), pa.binary()))], ["part", "gain", "features", "tags"])


def _windows_from(rows) -> list[Sequence]:
    return [(np.frombuffer(r["features"], np.int32).reshape(-1, len(TABLES)), np.frombuffer(r["tags"], np.int8).astype(np.int64)) for r in rows]


def train_on(docs: DataFrame, options: Training = Training(), credential=_credential) -> Field:
    """Fits on a bounded sample of the distinct texts, about ``drawn_rows`` of them.

    ``sample_rows`` of these, half of them with a fixed pattern's mark, give labelled windows; false spans are
    looked for in the halves of the drawn texts by turns, the margin in all.  Tasks read whole texts and send windows.
    """
    spark, text = docs.sparkSession, F.col("text")
    known = docs.select("text").where(text.isNotNull() & (F.length("text") > 0))
    n = known.agg(F.approx_count_distinct(F.xxhash64("text")).alias("n")).first()["n"]
    share = min(1.0, options.drawn_rows / max(1, n))
    mark = "AKIA[A-Z0-9]{16}|[0-9a-f]{24}|(?i)(password|passwd|secret|token|api_?key)[\"']? *[:=]"
    at = F.pmod(F.xxhash64("text", F.lit(options.seed)), F.lit(1 << 30)) / (1 << 30) / share
    # copies share a hash, so they would all enter together
    drawn = stored(known.where(at < 1).distinct().select("text", text.rlike(mark).alias("marked"), at.alias("at")), "secret-sample")

    def chosen(flag: bool) -> DataFrame | None:
        own = drawn.where(F.col("marked") == flag)
        places = own.select("at").orderBy("at").limit(options.sample_rows // 2).collect()  # numbers only
        return own.where(F.col("at") <= places[-1]["at"]) if places else None

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                yield _window_rows((at, 0.0, w) for w in labelled_windows(np.frombuffer(raw, np.uint8), options))

    def surrounding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(at, *c) for at, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for c in contexts_of(t, 3)]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.float64(), pa.string(), pa.string()))], ["at", "before", "after"])

    parts = [p.select("at", "text") for p in (chosen(True), chosen(False)) if p is not None]
    if not parts:
        return with_margin(fit(planted_windows([("some plain words", "stand here")], options.copies, options, credential, options.seed), options), [], [("", "")], options, credential)
    sample = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    order = ("part", "gain", "features", "tags")
    sequences = _windows_from(sample.mapInArrow(labelled, _WINDOW).orderBy(*order).collect())
    contexts = [(r["before"], r["after"]) for r in sample.mapInArrow(surrounding, "at double, before string, after string").orderBy("at", "before", "after").collect()]
    sequences += planted_windows(contexts, options.copies, options, credential, options.seed)

    def false_ones(field: Field, rows: DataFrame) -> DataFrame:
        shared = spark.sparkContext.broadcast(field)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first, end, data, offsets in chunks(batch.column(1)):
                    # all texts of a chunk at once, then those with spans again one by one
                    rows = [0] if end == first + 1 else sorted({row for row, _, _ in model_spans(Tokens(data, offsets), shared.value)})
                    for row in rows:
                        found = false_windows(data[offsets[row] : offsets[row + 1]], shared.value, options)
                        if found:
                            at = batch.column(0)[first + row].as_py()
                            yield _window_rows((at, g, w) for g, w in found)

        return rows.select("at", "text").mapInArrow(run, _WINDOW)

    field, hard = fit(sequences, options), []
    for i in range(options.rounds):
        half = drawn.where(F.floor(F.col("at") * (1 << 20)) % 2 == i % 2)
        more = _windows_from(false_ones(field, half).orderBy(*order).limit(options.hard).collect())
        if not more:
            continue
        hard += more
        field = fit(sequences + hard, options, field)
    top = false_ones(field, drawn).agg(F.max("gain").alias("gain")).first()["gain"]
    return with_margin(field, [] if top is None else [top], contexts, options, credential)


def scan_secrets(docs: DataFrame, field: Field | None = None, options: Training = Training()) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_model of docs(doc_id, text)."""
    field = field or train_on(docs, options)
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, offsets in chunks(batch.column(1)):
                chars = CharPlaces(data)
                counts, digests, texts = [], [], []
                for row, spans in enumerate(chunk_spans(data, offsets, shared.value)):
                    shift = chars(int(offsets[row])) if spans else 0
                    told = [(kind, f"{kind}:{chars(s) - shift}:{chars(e) - shift}") for kind, s, e in spans]
                    counts.append([sum(kind == k for k, _ in told) for kind in (*KINDS, MODEL_KIND)])
                    digests.append(hashlib.sha256(",".join(t for kind, t in told if kind != MODEL_KIND).encode()).hexdigest())
                    texts.append(",".join(t for _, t in told))
                counts = np.array(counts, np.int64).reshape(-1, 4)
                columns = [batch.column(0)[at:end].cast(pa.int64()), *(pa.array(counts[:, i]) for i in range(3)), pa.array(digests, pa.string()), pa.array(texts, pa.string()), pa.array(counts[:, 3])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_model"])

    return map_columns(docs, ["doc_id", "text"], run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_model long")


def redacted(docs: DataFrame, field: Field | None = None, options: Training = Training(), mark: str = "[secret]") -> DataFrame:
    """The same rows and columns, each secret in ``text`` replaced by ``mark``; n_chars, where there is one, follows."""
    field = field or train_on(docs, options)
    shared, put = docs.sparkSession.sparkContext.broadcast(field), mark.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, names = batch.schema.get_field_index("text"), batch.schema.names
            column, texts = batch.column(place), []
            for at, end, data, offsets in chunks(column):
                for row, spans in enumerate(chunk_spans(data, offsets, shared.value)):
                    if column[at + row].as_py() is None or not spans:
                        texts.append(column[at + row].as_py())
                        continue
                    out, last = [], int(offsets[row])
                    for _, s, e in spans:
                        if e > last:
                            out += [data[last : max(s, last)].tobytes(), put] if s >= last else []
                            last = e
                    texts.append((b"".join(out) + data[last : offsets[row + 1]].tobytes()).decode(errors="replace"))
            arrays = list(batch.columns)
            if "n_chars" in names:
                i = names.index("n_chars")
                old = column.to_pylist()
                arrays[i] = pa.array([n if a == b else len(b) for n, a, b in zip(arrays[i].to_pylist(), old, texts)], arrays[i].type)
            arrays[place] = pa.array(texts, column.type)
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return map_rows(docs, run)
