"""Quality rules as a short-circuit cascade.

The base counts and the base rules are fixed.  On top of them stands a set of rules, each a
function from a chunk's shared counts to a reject mask over the rows still alive.  Their cost, and
which of them reject together, are measured on a sample.  The cascade takes the rule with the most
rejections per second first, and then always that with the most among the rows which the ones before
would leave.  The order changes the cost, never the verdict: a row is kept if and only if no rule
rejects it.

Equal lines, words and windows are found by hashes and then compared byte by byte.

Defined cases: null and empty texts have zero counts and fail the base rule on word count; a very long
text is one chunk, of which a few bytes a character are held; repeated rows give repeated rows; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textscan import IS_SPACE, STARTS_CHAR, chunks, equal_spans, map_columns, mixed, repeated_spans, repeats, span_hashes, told_apart, window_hashes, word_spans

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
LETTER = np.zeros(256, bool)  # ASCII letters, and any byte of a non-ASCII character
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True

NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = "doc_id long, " + ", ".join(f"{n} long" for n in NAMES) + ", base_failed boolean, kept boolean, failed_rule string"


def _per_row(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of flags[bounds[i]:bounds[i+1]]."""
    out = np.zeros(len(bounds) - 1, np.int64)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(full):
        out[full] = np.add.reduceat(flags, bounds[full], dtype=np.int64)
    return out


class Counts:
    """Base counts of a chunk of rows, and the arrays that further rules share."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.rows = data, offsets, len(offsets) - 1
        self.start, self.end, self.first = word_spans(data, offsets)
        self.n_words = np.diff(self.first)
        self.word_row = np.repeat(np.arange(self.rows, dtype=np.int32), self.n_words)
        self.word_chars = _per_row(~IS_SPACE[data] & STARTS_CHAR[data], offsets)
        self.n_symbols = _per_row(SYMBOL[data], offsets)
        self._lines()
        self._repeats()

    def _lines(self) -> None:
        breaks = np.flatnonzero(self.data == 10)
        row_starts = self.offsets[:-1]
        start = np.sort(np.concatenate([row_starts, breaks + 1]), kind="stable")
        # a break that ends its row opens an empty last line, which stands where the next row starts
        row = np.searchsorted(self.offsets, start, "right") - 1
        end = np.append(start[1:], len(self.data))
        bodies = end - ((end > start) & (self.data[np.maximum(end - 1, 0)] == 10) if len(self.data) else 0)
        full = (row < self.rows) & (np.searchsorted(self.start, bodies) > np.searchsorted(self.start, start))
        row, start, end = row[full], start[full], bodies[full]
        self.n_lines = np.bincount(row, minlength=self.rows)
        places, leads = repeated_spans(self.data, start, end, row)
        self.n_dup_lines = np.bincount(row[places[places != leads]], minlength=self.rows)

    def _repeats(self) -> None:
        words = span_hashes(self.data, self.start, self.end)
        windows = window_hashes(words, 3)
        self.n_repeat_words = np.zeros(self.rows, np.int64)
        if not len(windows):
            return
        row = self.word_row[: len(windows)]
        windows = mixed(windows + row.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
        inside = row == self.word_row[2:]
        if not inside.all():  # windows over two rows equal none
            windows, inside = windows[inside], np.flatnonzero(inside)
        else:
            inside = np.arange(len(windows), dtype=np.int32)
        places, leads = (inside[x] for x in repeats(windows))
        same = row[places] == row[leads]
        for i in range(3):
            same &= equal_spans(self.data, self.start[places + i], self.end[places + i], self.data, self.start[leads + i], self.end[leads + i])
        word = lambda i: self.data[self.start[i] : self.end[i]].tobytes()
        places, _ = told_apart(places, leads, same, lambda i: (int(row[i]), word(i), word(i + 1), word(i + 2)))
        covered = np.zeros(len(words), bool)
        for i in range(3):
            covered[places + i] = True
        self.n_repeat_words = np.bincount(self.word_row[covered], minlength=self.rows)

    def base_failed(self) -> np.ndarray:
        return (self.n_words < 50) | (100 * self.n_repeat_words > 50 * self.n_words)


def symbol_share(c: Counts, rows: np.ndarray) -> np.ndarray:
    return 100 * c.n_symbols[rows] > 10 * c.n_words[rows]


def word_length(c: Counts, rows: np.ndarray) -> np.ndarray:
    """Mean word length outside 2 to 20 code points."""
    return (c.word_chars[rows] < 2 * c.n_words[rows]) | (c.word_chars[rows] > 20 * c.n_words[rows])


def repeated_lines(c: Counts, rows: np.ndarray) -> np.ndarray:
    return 100 * c.n_dup_lines[rows] > 30 * c.n_lines[rows]


def _of_rows(c: Counts, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the words of these rows, and for each the row's place in ``rows``."""
    n = c.n_words[rows]
    place = np.repeat(np.arange(len(rows)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(c.first[rows], n), place


def letterless_words(c: Counts, rows: np.ndarray) -> np.ndarray:
    """Over 30 % of the words have no letter."""
    if not len(c.start):
        return np.zeros(len(rows), bool)
    words, place = _of_rows(c, rows)
    # what stands between a word and the next one is white space, so it adds no letter
    bare = ~np.logical_or.reduceat(LETTER[c.data], c.start)[words]
    return 100 * np.bincount(place, bare, len(rows)) > 30 * c.n_words[rows]


def one_word_share(c: Counts, rows: np.ndarray) -> np.ndarray:
    """One word makes up over 30 % of the text."""
    words, place = _of_rows(c, rows)
    _, leads = repeated_spans(c.data, c.start[words], c.end[words], place)
    first, count = np.unique(leads, return_counts=True)
    most = np.minimum(c.n_words[rows], 1)
    np.maximum.at(most, place[first], count)
    return 100 * most > 30 * c.n_words[rows]


Rule = Callable[[Counts, np.ndarray], np.ndarray]
RULES: dict[str, Rule] = {f.__name__: f for f in (one_word_share, letterless_words, repeated_lines, word_length, symbol_share)}


@dataclass(frozen=True)
class Cascade:
    """sample_fraction: share of the rows on which cost and selectivity are measured."""

    sample_fraction: float = 0.01
    seed: int = 7


def cascade_order(names: list[str], seconds: dict[str, float], together: dict[int, int]) -> list[str]:
    """Rules by rejections per second among the rows that the rules before leave.

    together: number of rows by which rules reject them, as a sum of 1 << place in ``names``.
    """
    order, left, alive = [], list(names), dict(together)
    total = max(1, sum(together.values()))
    while left:
        rows = sum(alive.values()) / total
        rate = {n: sum(k for mask, k in alive.items() if mask >> names.index(n) & 1) / max(seconds.get(n, 0.0) * rows, 1e-9) for n in left}
        best = max(left, key=lambda n: (rate[n], -names.index(n)))
        order.append(best)
        left.remove(best)
        alive = {mask: k for mask, k in alive.items() if not mask >> names.index(best) & 1}
    return order


def measured_order(docs: DataFrame, rules: dict[str, Rule] = RULES, options: Cascade = Cascade()) -> list[str]:
    """Order of the cascade, measured on a sample; ties and an empty sample keep the given order."""
    names = list(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seconds, together = [0.0] * len(names), Counter()
            for _, _, data, offsets in chunks(batch.column(0)):
                c = Counts(data, offsets)
                alive = np.flatnonzero(~c.base_failed())
                mask = np.zeros(len(alive), np.int64)
                for i, name in enumerate(names):
                    began = time.perf_counter()
                    mask |= rules[name](c, alive).astype(np.int64) << i
                    seconds[i] += time.perf_counter() - began
                together.update(mask.tolist())
            rows = [(name, None, s, 0) for name, s in zip(names, seconds)] + [(None, m, 0.0, k) for m, k in together.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.float64(), pa.int64()))], ["rule", "mask", "seconds", "n"])

    sample = docs.select("text").sample(options.sample_fraction, options.seed)
    # one row a rule and one for each set of rules that reject together
    found = sample.mapInArrow(run, "rule string, mask long, seconds double, n long").groupBy("rule", "mask").agg(F.sum("seconds").alias("s"), F.sum("n").alias("n")).collect()
    return cascade_order(names, {r["rule"]: r["s"] for r in found if r["rule"]}, {r["mask"]: r["n"] for r in found if r["rule"] is None})


def judge_quality(docs: DataFrame, rules: dict[str, Rule] = RULES, order: list[str] | None = None, options: Cascade = Cascade()) -> DataFrame:
    """Base counts, base_failed, kept and the first rule that rejected, for every row of docs(doc_id, text)."""
    order = order or measured_order(docs, rules, options)

    def judged(data: np.ndarray, offsets: np.ndarray) -> list:
        c = Counts(data, offsets)
        failed = c.base_failed()
        why = np.full(c.rows, None, object)
        why[failed] = "base"
        alive = np.flatnonzero(~failed)
        for name in order:
            if not len(alive):
                break
            bad = rules[name](c, alive)
            why[alive[bad]] = name
            alive = alive[~bad]
        kept = np.zeros(c.rows, bool)
        kept[alive] = True
        return [*(pa.array(getattr(c, n), pa.int64()) for n in NAMES), pa.array(failed), pa.array(kept), pa.array(why, pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, offsets in chunks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0)[at:end].cast(pa.int64()), *judged(data, offsets)], ["doc_id", *NAMES, "base_failed", "kept", "failed_rule"])

    return map_columns(docs, ["doc_id", "text"], run, SCHEMA)
