"""Benchmark decontamination: rare n-gram seeds find passages, Smith-Waterman alignment scores them.

Words are runs of ASCII letters and digits (A-Z lower-cased) and non-ASCII characters, so case and
punctuation don't matter.  Documents meet test items at their rare words (n-grams of one word, as edits may
leave no longer one whole).  The seeds of an item are its rarest words by a count over all documents, and
as many as make them exact: an alignment with the least score matches at least that many words and so
leaves out no more than the others; of ``n - least + seed_hits`` words it matches ``seed_hits``, whichever an
edit took and however often a version occurs.  Only where that many seeds of an item stand no further apart
than an alignment reaches is a window opened, as wide as any alignment over them.  A window of many words
is aligned in blocks that overlap by the widest alignment.  A block whose words cannot reach the least score,
whatever their order, is skipped before alignment, and so is one of which no stretch can, if all its words
that the item has matched; these bounds lose nothing either.  So the result is that of
aligning every document with every item.  Words are compared by hashes, and a leak must hold under a
second, independent hash as well.

The test items are read in blocks of bounded size and broadcast; a larger benchmark takes more
blocks, each with passes of its own.  Items of equal words are aligned once.  No document is shuffled.

A short item needs at least ``floor_words`` words of score, and all its words if it has no more.  An
item of fewer than ``judged_words`` words occurs by chance, so it takes no document: ``unjudged`` lists them.

Defined cases: null and empty texts on either side have no leaks; a document gets one row for each item
that it leaks, equal items included; a very long text is one chunk, of which some bytes a character are held;
equal scores keep the first place in the text; repeated rows repeat in the result; other columns pass
through ``clean_documents`` and are not read by ``leaks``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textscan import FOLD_AZ, STARTS_CHAR, chunks, map_columns, map_rows, span_hashes, word_spans

BETWEEN = np.ones(256, bool)
BETWEEN[48:58] = BETWEEN[65:91] = BETWEEN[97:123] = BETWEEN[128:] = False


@dataclass(frozen=True)
class Alignment:
    """A leak is an alignment of at least ``least_share`` of the item's words, or of ``least_words`` in all, net of penalties.

    ``floor_words``: less than this, or the whole of a shorter item, is no leak; ``judged_words``: items with fewer words are only listed.
    """

    seed_hits: int = 5
    least_share: float = 0.5
    least_words: float = 40.0
    floor_words: float = 7.0
    judged_words: int = 5
    mismatch: float = 0.5
    gap: float = 0.5
    block_bytes: int = 16 << 20

    def chain(self, words: np.ndarray) -> np.ndarray:
        """The longest gap that an alignment can pay for."""
        return np.ceil((words - self.least(words)) / self.gap).astype(np.int64)

    def least(self, words: np.ndarray) -> np.ndarray:
        return np.minimum(np.maximum(self.least_share * words, np.minimum(words, self.floor_words)), self.least_words)


@dataclass
class Items:
    """Words of the distinct test items of a block under both hashes, and the ids of each; seeds: their rare words in order, the owners of the i-th at first[i]:first[i + 1]; need: seeds that an alignment matches."""

    ids: list[list[int]]
    words: list[np.ndarray]
    others: list[np.ndarray]
    size: np.ndarray = field(init=False)
    start: np.ndarray = field(init=False)
    flat: np.ndarray = field(init=False)
    ordered: list[np.ndarray] = field(init=False)
    need: np.ndarray = field(init=False)
    seeds: np.ndarray = field(init=False)
    first: np.ndarray = field(init=False)
    owner: np.ndarray = field(init=False)

    def __post_init__(self):
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.concatenate(self.words) if self.words else np.zeros(0, np.uint64)
        self.ordered = [np.sort(w) for w in self.words]

    @classmethod
    def of(cls, rows: list[tuple[int, str]], options: Alignment) -> Items:
        ids, words, others = [], [], []
        known: dict[bytes, int] = {}
        for item_id, text in rows:
            data = np.frombuffer((text or "").encode(errors="replace"), np.uint8)
            found, _, start, end = _words(data, np.array([0, len(data)]))
            if len(found) < max(1, options.judged_words):
                continue
            other = span_hashes(FOLD_AZ[data], start, end, 1)
            place_of = known.setdefault(found.tobytes() + other.tobytes(), len(ids))
            if place_of < len(ids):  # the same words again
                ids[place_of].append(item_id)
                continue
            ids.append([item_id])
            words.append(found)
            others.append(other)
        return cls(ids, words, others)

    def vocabulary(self) -> np.ndarray:
        return np.unique(self.flat)

    def seeded(self, counts: np.ndarray, options: Alignment) -> Items:
        """Chooses the seeds; counts: of the words of ``vocabulary`` in the documents."""
        vocabulary, pairs, need = self.vocabulary(), [], []
        for i, words in enumerate(self.words):
            least = int(np.ceil(options.least(np.array([len(words)]))[0] - 1e-9))
            hits = min(options.seed_hits, least)
            rarest = np.argsort(counts[np.searchsorted(vocabulary, words)], kind="stable")[: len(words) - least + hits]
            own = np.unique(words[rarest])
            # a word that an item holds more than once may be one seed for several of its places
            pairs.append(np.stack([own, np.full(len(own), i, np.uint64)]))
            need.append(hits)
        word, owner = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), np.uint64)
        order = np.argsort(word, kind="stable")
        self.seeds, first = np.unique(word[order], return_index=True)
        self.first, self.owner, self.need = np.append(first, len(word)), owner[order].astype(np.int64), np.array(need, np.int64)
        return self


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    start, end, first = word_spans(data, offsets, BETWEEN)
    return span_hashes(FOLD_AZ[data], start, end), first, start, end


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], ..., start[0] + size[0] - 1, start[1], ..."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def words_in_windows(items: Items, owner: np.ndarray, words: np.ndarray, begin: np.ndarray, end: np.ndarray, most: int = 1 << 18) -> np.ndarray:
    """How many words of each item ``owner`` stand in words[begin:end], whatever their order; about ``most`` at a time."""
    present, rank = np.unique(words, return_inverse=True)
    step = len(words) + 1
    places = np.sort(rank.reshape(-1) * step + np.arange(len(words)))
    size = items.size[owner]
    total, out, a = np.cumsum(size), np.zeros(len(owner), np.int64), 0
    while a < len(owner):
        b = max(a + 1, int(np.searchsorted(total, total[a] - size[a] + most, "right")))
        own = size[a:b]
        word = items.flat[_spread(items.start[owner[a:b]], own)]
        key = np.minimum(np.searchsorted(present, word), len(present) - 1)
        low, high = key * step + np.repeat(begin[a:b], own), key * step + np.repeat(end[a:b], own)
        after = np.minimum(np.searchsorted(places, low), len(places) - 1)
        held = (present[key] == word) & (places[after] >= low) & (places[after] < high)
        out[a:b] = np.add.reduceat(held.astype(np.int64), np.cumsum(own) - own)
        a = b
    return out


def align(item: np.ndarray, window: np.ndarray, mismatch: float, gap: float) -> tuple[float, int, int]:
    """Best local alignment: score in matched words net of penalties, and the window's range that it covers."""
    n = len(window)
    slope = gap * np.arange(n + 1)
    above, start = np.zeros(n + 1), np.arange(n + 1)
    best, begin, end = 0.0, 0, 0
    for word in item:
        step = np.where(window == word, 1.0, -mismatch)
        slant = np.concatenate([[0.0], above[:-1] + step])
        here = np.maximum(np.maximum(slant, above - gap), 0.0)
        came = np.where(here <= 0, np.arange(n + 1), np.where(slant >= above - gap, np.concatenate([[0], start[:-1]]), start))
        lifted = here + slope
        row = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == row, np.arange(n + 1), 0))
        above, start = row - slope, came[source]
        at = int(above.argmax())
        if above[at] > best + 1e-9:
            best, begin, end = float(above[at]), int(start[at]), at
    return best, begin, end


def reach(item: np.ndarray, window: np.ndarray, options: Alignment) -> float:
    """What no alignment scores more than: the best stretch of the window if each of its words that the item (its words in order) has matches, and each other one costs a penalty."""
    at = np.minimum(np.searchsorted(item, window), len(item) - 1)
    steps = np.where(item[at] == window, 1.0, -min(options.mismatch, options.gap))
    total = np.concatenate([[0.0], np.cumsum(steps)])
    return float((total - np.minimum.accumulate(total)).max())


def _windows(items: Items, words: np.ndarray, first: np.ndarray, options: Alignment) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, item, begin and end (words of the chunk) of the blocks that hold every alignment with enough seeds; first: the rows' first words."""
    none = (np.zeros(0, np.int64),) * 4
    if not len(words) or not len(items.seeds):
        return none
    at = np.minimum(np.searchsorted(items.seeds, words), len(items.seeds) - 1)
    where = np.flatnonzero(items.seeds[at] == words)
    seed = at[where]
    shared = items.first[seed + 1] - items.first[seed]
    owner, where = items.owner[_spread(items.first[seed], shared)], np.repeat(where, shared)
    row = np.searchsorted(first, where, "right") - 1
    key = row * len(items.ids) + owner
    order = np.argsort(key, kind="stable")  # places stay in order
    key, where = key[order], where[order]
    row, owner = np.divmod(key, len(items.ids))
    chain = options.chain(items.size[owner])
    widest, last = items.size[owner] + chain, np.arange(len(key)) + items.need[owner] - 1
    inside = np.minimum(last, len(key) - 1)
    near = np.flatnonzero((last < len(key)) & (key[inside] == key) & (where[inside] - where < widest))
    if not len(near):
        return none
    key, row, owner, widest = key[near], row[near], owner[near], widest[near]
    begin, end = np.maximum(first[row], where[last[near]] - widest), np.minimum(first[row + 1], where[near] + widest + 1)
    head = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (begin[1:] > end[:-1])]))
    row, owner, widest, begin, end = row[head], owner[head], widest[head], begin[head], end[np.append(head[1:], len(key)) - 1]
    # blocks that overlap by the widest alignment, so that each lies in one of them whole
    blocks = np.maximum(1, -(-(end - begin - widest) // (3 * widest)))
    step = np.repeat(3 * widest, blocks) * (np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks))
    row, owner, begin, end, widest = (np.repeat(x, blocks) for x in (row, owner, begin, end, widest))
    return row, owner, begin + step, np.minimum(end, begin + step + 4 * widest)


def chunk_leaks(items: Items, data: np.ndarray, offsets: np.ndarray, options: Alignment) -> Iterator[tuple[int, int, float, int, int]]:
    """(row, item, share of the item, start, end in bytes of the chunk)."""
    words, first, start, end = _words(data, offsets)
    row, owner, begin, stop = _windows(items, words, first, options)
    if not len(row):
        return

    def others(a: int, b: int) -> np.ndarray:
        """Second hashes of words[a:b]."""
        low, high = int(start[a]), int(end[b - 1])
        return span_hashes(FOLD_AZ[data[low:high]], start[a:b] - low, end[a:b] - low, 1)

    least = options.least(items.size[owner])
    found: dict[tuple[int, int], tuple[float, int, int]] = {}
    # no alignment matches more words of the item than the window holds
    for i in np.flatnonzero(words_in_windows(items, owner, words, begin, stop) >= least).tolist():
        item, s, e = (int(row[i]), int(owner[i])), int(begin[i]), int(stop[i])
        floor = max(least[i] - 1e-9, found.get(item, (0.0, 0, 0))[0] + 1e-9)
        if reach(items.ordered[item[1]], words[s:e], options) >= floor and align(items.words[item[1]], words[s:e], options.mismatch, options.gap)[0] >= floor:
            score, x, y = align(items.others[item[1]], others(s, e), options.mismatch, options.gap)
            if score >= floor:
                found[item] = (score, s + x, s + y)
    for (r, item), (score, s, e) in sorted(found.items()):
        yield r, item, score / len(items.words[item]), int(start[s]), int(end[e - 1])


def word_counts(docs: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """How often each word of the vocabulary (hashes, in order) stands in the documents."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        total = np.zeros(len(own), np.int64)
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0)):
                words = _words(data, offsets)[0]
                at = np.minimum(np.searchsorted(own, words), len(own) - 1)
                total += np.bincount(at[own[at] == words], minlength=len(own))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["word", "n"])

    counts = np.zeros(len(vocabulary), np.int64)
    if len(vocabulary):
        # at most one row for each word of a block of items
        found = map_columns(docs, ["text"], run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
        counts[found["word"].to_numpy()] = found["n"].to_numpy()
    return counts


def _n_words(text) -> F.Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "[^A-Za-z0-9\\x{80}-\\x{10FFFF}]+"), lambda w: w != ""))


def unjudged(benchmark: DataFrame, options: Alignment = Alignment()) -> DataFrame:
    """item_id, words of the test items that are too short to take a document."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), _n_words(F.col("text")).alias("words"))
    return rows.where(F.col("words") < max(1, options.judged_words))


def item_blocks(docs: DataFrame, benchmark: DataFrame, options: Alignment) -> Iterator[Items]:
    """The benchmark in blocks of bounded size, with the seeds that are rare in the documents."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(_n_words(F.col("text")) >= max(1, options.judged_words))
    size = rows.agg(F.sum(F.octet_length("text")).alias("s")).first()["s"] or 0
    blocks = size // options.block_bytes + 1
    for i in range(blocks):
        # of equal texts one comes, with the ids of all
        own = rows.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == i).groupBy("text").agg(F.sort_array(F.collect_list("item_id")).alias("ids")).collect()
        own = sorted(((item_id, r["text"]) for r in own for item_id in r["ids"]), key=lambda x: (x[0], x[1]))
        items = Items.of(own, options)
        if items.ids:
            yield items.seeded(word_counts(docs, items.vocabulary()), options)


def leaks(docs: DataFrame, benchmark: DataFrame, options: Alignment = Alignment()) -> DataFrame:
    """doc_id, item_id, score (share of the item's words, net of penalties), start, end (code points) of each leak."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, score double, start long, end long"
    result = spark.createDataFrame([], schema)
    for items in item_blocks(docs, benchmark, options):
        result = result.union(_block_leaks(docs, spark.sparkContext.broadcast(items), options, schema))
    return result


def _block_leaks(docs: DataFrame, shared, options: Alignment, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in batches:
            for at, _, data, offsets in chunks(batch.column(1)):
                found = list(chunk_leaks(items, data, offsets, options))
                if not found:
                    continue
                chars = lambda a, b: int(np.count_nonzero(STARTS_CHAR[data[a:b]]))  # noqa: E731, B023
                rows = [(at + row, item_id, score, chars(offsets[row], s), chars(offsets[row], e)) for row, item, score, s, e in found for item_id in items.ids[item]]
                row, item, score, s, e = zip(*rows)
                doc = batch.column(0).cast(pa.int64()).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([doc, pa.array(item, pa.int64()), pa.array(score), pa.array(s, pa.int64()), pa.array(e, pa.int64())], ["doc_id", "item_id", "score", "start", "end"])

    return map_columns(docs, ["doc_id", "text"], run, schema)


def clean_documents(docs: DataFrame, benchmark: DataFrame, options: Alignment = Alignment()) -> DataFrame:
    """The rows of docs, all columns, whose text leaks no test item."""
    for items in item_blocks(docs, benchmark, options):
        docs = _clean_of(docs, docs.sparkSession.sparkContext.broadcast(items), options)
    return docs


def _clean_of(docs: DataFrame, shared, options: Alignment) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            for at, _, data, offsets in chunks(batch.column(batch.schema.get_field_index("text"))):
                for row, *_ in chunk_leaks(shared.value, data, offsets, options):
                    clean[at + row] = False
            yield batch.filter(pa.array(clean))

    return map_rows(docs, run)
