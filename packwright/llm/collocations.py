"""Collocations: phrases whose words come together more often than their parts do apart.

Texts are lower-cased (A to Z), cut into pieces at ``.,;:!?`` and line ends, and pieces into words at
spaces and tabs.  All counts are per language and over all documents.  A candidate is a phrase of two
to ``max_n`` words that occurs ``least`` times; cut into two parts its score is
``floor(scale * a / (l + r))``, and the lowest of its cuts counts.  A candidate inside a longer one that
is nearly as frequent goes.  The best of each language are ranked.

Counting: each word position is one row, the window of up to ``max_n`` words from there, equal windows
of a stretch of text merged; the windows are dealt by their first two words, exploded into all the
n-grams that start there, and hash-aggregated.  So one row a word is shuffled and not one a phrase.
A word that occurs less than ``least`` times is in no candidate and in no part of one, and ends a
window like a full stop.  Pairs of two words that each make up a ``hot_share`` of all words are dealt
in ``salts`` parts, told apart by the third word, and only the pair's own parts are added up again.

Rows carry word numbers.  The numbered words are held by each worker, up to ``vocabulary_bytes``, the most
frequent first; phrases with a frequent word beyond them are counted as text (``_unnumbered``), with
the same result.

Defined cases: a null text has no words; a null language is ``und``, and joins that language's rows;
repeated rows count again; an empty table or one without candidates gives no rows; ties in score go to
the higher count, then to the phrase in byte order; a text of over ``PART_BYTES`` is worked off in parts
that end where a piece ends (one piece is held whole); other columns, doc_id among them, are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .files import stored
from .textscan import FOLD_AZ, chunks, equal_spans, map_columns, mixed, span_hashes, word_spans

PART_BYTES = 1 << 21
NO_LANGUAGE = "und"
#: Fixed values of the contract: bytes that end a piece, and bytes that part words inside one.
ENDS_PIECE, PARTS_WORDS = np.zeros(256, bool), np.zeros(256, bool)
ENDS_PIECE[list(b".,;:!?\n\x0b\x0c\r")] = True
PARTS_WORDS[list(b" \t")] = True
BETWEEN = ENDS_PIECE | PARTS_WORDS

_U = np.uint64
_LOW = _U(0xFFFFFFFF)


@dataclass(frozen=True)
class Phrases:
    """max_n: words of the longest phrase (2 to 4); least: occurrences of a candidate; covered: percent of a
    candidate's occurrences inside a longer one from which it goes; top: rows a language."""

    max_n: int = 4
    least: int = 30
    scale: int = 2_000_000
    covered: int = 80
    top: int = 2000
    vocabulary_bytes: int = 1 << 26
    hot_share: float = 0.001
    salts: int = 32

    def __post_init__(self):
        if not 2 <= self.max_n <= 4:
            raise ValueError("max_n is 2, 3 or 4")


class Words:
    """The words of a few texts: their bytes, language and piece, and for each the first that equals it."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, codes: np.ndarray, seeds: np.ndarray):
        self.data = FOLD_AZ[data]
        self.start, self.end, first = word_spans(self.data, offsets, BETWEEN)
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        self.code = codes[row]
        # both terms only grow, so words of one piece share the sum and others don't
        self.piece = np.searchsorted(np.flatnonzero(ENDS_PIECE[self.data]), self.start) + row
        self.hash = mixed(span_hashes(self.data, self.start, self.end) + seeds[self.code])
        _, lead, which = np.unique(self.hash, return_index=True, return_inverse=True)
        lead = lead[which]
        same = (self.code == self.code[lead]) & equal_spans(self.data, self.start, self.end, self.data, self.start[lead], self.end[lead])
        self.lead = np.where(same, lead, np.arange(len(lead)))  # a word whose hash is another's stands for itself

    def __len__(self) -> int:
        return len(self.start)

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()

    def texts(self, at: np.ndarray) -> pa.Array:
        start, size = self.start[at], self.end[at] - self.start[at]
        bound = np.concatenate([[0], np.cumsum(size)])
        flat = self.data[np.repeat(start - bound[:-1], size) + np.arange(bound[-1])]
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(bound.astype(np.int32)), pa.py_buffer(flat))


def _language_seeds(names: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(n.encode(), 1) for n in names], np.uint64)


def _parts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A chunk; or of one long text the parts, each to the end of a piece."""
    if len(offsets) > 2 or len(data) <= PART_BYTES:
        yield data, offsets
        return
    at = 0
    while at < len(data):
        end = at + PART_BYTES
        while end < len(data):
            found = np.flatnonzero(ENDS_PIECE[data[end : end + PART_BYTES]])
            if len(found):
                end += int(found[0])
                break
            end += PART_BYTES
        end = min(end, len(data))
        yield data[at:end], np.array([0, end - at])
        at = end


def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], Words]]:
    """Language names and words of (lang, text) batches, a few MB of text at a time."""
    for batch in batches:
        langs = batch.column(0).cast(pa.string()).fill_null(NO_LANGUAGE).dictionary_encode()
        names, codes = langs.dictionary.to_pylist(), langs.indices.to_numpy(zero_copy_only=False)
        seeds = _language_seeds(names)
        for at, end, data, offsets in chunks(batch.column(1), PART_BYTES):
            for part, bounds in _parts(data, offsets):
                if len(found := Words(part, bounds, codes[at:end], seeds)):
                    yield names, found


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, f: occurrences of each word in each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, words in words_of(batches):
            at, count = np.unique(words.lead, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()).take(pa.array(words.code[at])), words.texts(at), pa.array(count, pa.int64())], ["lang", "word", "f"])

    return map_columns(docs, ["lang", "text"], run, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


class Numbered:
    """Words with numbers from 1 on, by falling frequency; ``find`` gives 0 for others."""

    def __init__(self, langs: list[str], words: list[str], hot: int):
        self.langs, self.hot = langs, hot
        raw = [w.encode() for w in words]
        self.data = np.frombuffer(b"".join(raw), np.uint8)
        self.bound = np.concatenate([[0], np.cumsum([len(w) for w in raw], dtype=np.int64)])
        self.names = sorted(set(langs))
        place = {n: i for i, n in enumerate(self.names)}
        self.code = np.array([place[n] for n in langs], np.int64)
        hashes = mixed(span_hashes(self.data, self.bound[:-1], self.bound[1:]) + _language_seeds(self.names)[self.code]) if raw else np.zeros(0, np.uint64)
        self.order = np.argsort(hashes, kind="stable")
        self.sorted = hashes[self.order]
        again = np.flatnonzero(self.sorted[1:] == self.sorted[:-1]) + 1
        self.clashing = {(langs[i], raw[i]): i + 1 for i in self.order[again].tolist()}  # words behind another one's hash

    def __len__(self) -> int:
        return len(self.langs)

    def word(self, number: int) -> bytes:
        return self.data[self.bound[number - 1] : self.bound[number]].tobytes()

    def find(self, names: list[str], words: Words) -> np.ndarray:
        """The number of each word."""
        out = np.zeros(len(words), np.int64)
        if not len(self):
            return out
        leads = np.unique(words.lead)
        place = {n: i for i, n in enumerate(self.names)}
        code = np.array([place.get(n, -1) for n in names], np.int64)[words.code[leads]]
        slot = np.minimum(np.searchsorted(self.sorted, words.hash[leads]), len(self) - 1)
        entry = self.order[slot]
        same = (self.sorted[slot] == words.hash[leads]) & (self.code[entry] == code)
        at = np.flatnonzero(same)
        same[at] = equal_spans(words.data, words.start[leads[at]], words.end[leads[at]], self.data, self.bound[entry[at]], self.bound[entry[at] + 1])
        out[leads] = np.where(same, entry + 1, 0)
        if self.clashing:
            for i in leads[~same].tolist():
                out[i] = self.clashing.get((names[words.code[i]], words.text(i)), 0)
        return out[words.lead]


def numbered(frequent: DataFrame, total: int, options: Phrases) -> tuple[Numbered, bool]:
    """The most frequent words that fit ``vocabulary_bytes``, and whether these are all; frequent: lang, word, f."""
    size = F.octet_length("word") + F.octet_length("lang") + 64
    level = F.floor(F.log2(F.col("f").cast("double")) * 4)
    levels = frequent.groupBy(level.alias("level")).agg(F.sum(size).alias("bytes")).orderBy(F.desc("level")).collect()  # 256 levels at most
    room, lowest = options.vocabulary_bytes, None
    for r in levels:
        if r["bytes"] > room:
            break
        room, lowest = room - r["bytes"], r["level"]
    complete = lowest is not None and lowest == levels[-1]["level"] or not levels
    if lowest is None:
        return Numbered([], [], 0), complete
    rows = frequent.where(level >= lowest).select("lang", "word", "f").toArrow()
    rows = rows.sort_by([("f", "descending"), ("lang", "ascending"), ("word", "ascending")])
    hot = int(np.count_nonzero(rows["f"].to_numpy() >= max(1, total * options.hot_share)))
    return Numbered(rows["lang"].to_pylist(), rows["word"].to_pylist(), hot), complete


def _windows(ids: np.ndarray, piece: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The window from each pair of numbered neighbours on, as two numbers of two words each, and how many there are; equal ones are merged."""
    n = len(ids)
    pair = np.zeros(n + 2, bool)
    pair[: n - 1] = (ids[:-1] > 0) & (ids[1:] > 0) & (piece[1:] == piece[:-1])
    at = np.flatnonzero(pair)
    ids = np.concatenate([ids.astype(np.uint64), np.zeros(3, np.uint64)])
    third = pair[at + 1] if most > 2 else np.zeros(len(at), bool)
    fourth = third & pair[at + 2] if most > 3 else np.zeros(len(at), bool)
    head = ids[at] << _U(32) | ids[at + 1]
    tail = np.where(third, ids[at + 2] << _U(32), _U(0)) | np.where(fourth, ids[at + 3], _U(0))
    order = np.argsort(mixed(head * _U(0x9E3779B97F4A7C15) + mixed(tail)))
    head, tail = head[order], tail[order]
    new = np.ones(len(at), bool)
    new[1:] = (head[1:] != head[:-1]) | (tail[1:] != tail[:-1])
    first = np.flatnonzero(new)
    return head[first].view(np.int64), tail[first].view(np.int64), np.diff(np.append(first, len(at)))


def _numbered_phrases(spark: SparkSession, docs: DataFrame, known: Numbered, options: Phrases) -> DataFrame:
    """lang, n, phrase, f of the frequent phrases whose words all have numbers."""
    shared, most, salts = spark.sparkContext.broadcast(known), options.max_n, options.salts

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, words in words_of(batches):
            head, tail, count = _windows(shared.value.find(names, words), words.piece, most)
            if len(head):
                yield pa.RecordBatch.from_arrays([pa.array(head), pa.array(tail), pa.array(count, pa.int64())], ["head", "tail", "f"])

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        for batch in batches:
            head, tail = (batch.column(i).to_numpy().view(np.uint64) for i in (0, 1))
            numbers = np.stack([head >> _U(32), head & _LOW, tail >> _U(32), tail & _LOW], axis=1).astype(np.int64)
            phrases = [b" ".join(vocabulary.word(x) for x in row if x) for row in numbers.tolist()]
            langs = [vocabulary.langs[x - 1] for x in numbers[:, 0].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(np.count_nonzero(numbers, axis=1), pa.int32()), pa.array(phrases, pa.binary()).cast(pa.string()), batch.column(2)], ["lang", "n", "phrase", "f"])

    word = lambda c, low: F.col(c).bitwiseAND(0xFFFFFFFF) if low else F.shiftrightunsigned(c, 32)
    hot = (word("head", False) <= known.hot) & (word("head", True) <= known.hot)
    salt = F.when(hot, F.pmod(F.xxhash64(word("tail", False)), F.lit(salts))).otherwise(F.lit(-1)).cast("int")
    rows = map_columns(docs, ["lang", "text"], windows, "head long, tail long, f long").withColumn("salt", salt).repartition("head", "salt")
    none, three = F.lit(0).cast("long"), F.col("tail").bitwiseAND(-0x100000000)
    starts = F.when(F.col("tail") == 0, F.array(none)).when(word("tail", True) == 0, F.array(none, three)).otherwise(F.array(none, three, F.col("tail")))
    grams = rows.select("head", "salt", "f", F.explode(starts).alias("rest"))
    counts = grams.groupBy("head", "salt", "rest").agg(F.sum("f").alias("f")).where((F.col("f") >= options.least) | ((F.col("rest") == 0) & (F.col("salt") >= 0)))
    whole = counts.groupBy("head", "rest").agg(F.sum("f").alias("f")).where(F.col("f") >= options.least)
    return whole.select("head", "rest", "f").mapInArrow(spelled, "lang string, n int, phrase string, f long")


def _unnumbered(spark: SparkSession, docs: DataFrame, known: Numbered, options: Phrases) -> DataFrame:
    """lang, n, phrase, f of the frequent phrases with a word that has no number, counted as text."""
    shared, most = spark.sparkContext.broadcast(known), options.max_n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, words in words_of(batches):
            ids, found = shared.value.find(names, words), Counter()
            bare = np.concatenate([[0], np.cumsum(ids == 0)])
            for n in range(2, most + 1):
                at = np.arange(max(0, len(ids) - n + 1))
                at = at[(words.piece[at] == words.piece[at + n - 1]) & (bare[at + n] > bare[at])]
                for i in at.tolist():
                    found[int(words.code[i]), n, b" ".join(words.text(j) for j in range(i, i + n))] += 1
            if found:
                code, n, phrase = zip(*found)
                columns = [pa.array([names[c] for c in code], pa.string()), pa.array(n, pa.int32()), pa.array(phrase, pa.binary()).cast(pa.string()), pa.array(list(found.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "n", "phrase", "f"])

    rows = map_columns(docs, ["lang", "text"], run, "lang string, n int, phrase string, f long")
    return rows.groupBy("lang", "n", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= options.least)


def phrase_counts(docs: DataFrame, options: Phrases = Phrases()) -> tuple[DataFrame, DataFrame]:
    """(lang, n, phrase, f) of all words and phrases that occur ``least`` times, and (lang, total) with the words of each language."""
    spark = docs.sparkSession
    words = stored(word_counts(docs), "collocation-words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("total"))
    frequent = words.where(F.col("f") >= options.least)
    total = words.agg(F.sum("f")).first()[0] or 0
    known, complete = numbered(frequent, total, options)
    found = frequent.select("lang", F.lit(1).alias("n"), F.col("word").alias("phrase"), "f").unionByName(_numbered_phrases(spark, docs, known, options))
    if not complete:
        found = found.unionByName(_unnumbered(spark, docs, known, options))
    return stored(found, "collocation-counts"), totals


def scored(counts: DataFrame, options: Phrases = Phrases()) -> DataFrame:
    """lang, n, phrase, a, l, r, k, score of every candidate, at its lowest-scoring cut."""
    words = F.split("phrase", " ")
    part = lambda start, length: F.array_join(F.slice(words, start, length), " ")
    cuts = counts.where("n >= 2").select("lang", "n", "phrase", F.col("f").alias("a"), F.explode(F.expr("sequence(1, n - 1)")).alias("k"))
    cuts = cuts.select("lang", "n", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("n") - F.col("k")).alias("rest"))
    both = cuts.join(counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    # decimals, as the products may pass 64 bits; div drops the fraction
    score = F.expr(f"(CAST(a AS DECIMAL(19,0)) * {options.scale}BD) div (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0)))").cast("long")
    return both.groupBy("lang", "n", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("x")).select("lang", "n", "phrase", "a", "x.l", "x.r", "x.k", "x.score")


def maximal(candidates: DataFrame, options: Phrases = Phrases()) -> DataFrame:
    """The candidates without those that a longer one covers.

    A phrase inside a longer candidate is inside a candidate of one word more, which is as frequent at
    least as that longer one: so extensions by one word decide.
    """
    words = F.split("phrase", " ")
    inner = F.array(F.array_join(F.slice(words, F.lit(1), F.col("n") - 1), " "), F.array_join(F.slice(words, F.lit(2), F.col("n") - 1), " "))
    longer = candidates.where("n >= 3").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    covers = F.expr(f"CAST(longer AS DECIMAL(19,0)) * 100BD >= CAST(a AS DECIMAL(19,0)) * {options.covered}BD")
    c, x = candidates.alias("c"), longer.alias("x")
    return c.join(x, (F.col("c.lang") == F.col("x.lang")) & (F.col("c.phrase") == F.col("x.phrase")) & covers, "left_anti")


def collocations(docs: DataFrame, options: Phrases = Phrases()) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of docs(lang, text): the best phrases of each language; n: its words."""
    counts, totals = phrase_counts(docs, options)
    best = maximal(scored(counts, options), options).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(32)))
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    # the first of each part come before the first of all, so no language meets in one task
    first = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= options.top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= options.top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
