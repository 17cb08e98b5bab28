"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are read as lower-case letters with one space between words.  Their n-grams fall into hashed
buckets; a bucket's value is its share of the text's n-grams times its inverse document frequency,
which is counted over all training documents.  Weights are fitted by follow-the-regularised-leader
(proximal, with L1 and L2 penalties) on a bounded sample of labelled rows, and the scores are
calibrated by a temperature on rows that the fit did not see.  A prediction uses the text alone.

Since a value is linear in the counts, predicting a text of any length is one table lookup for each
of its n-grams.  The sums are of whole numbers (weights times 2**20), so equal texts have equal scores
wherever they stand, and a long text is worked off in pieces, in the fit as well.

The fit and the broadcast model take about 3 MB for each language at 2**16 buckets.

Defined cases: a null text or one without a letter is ``und`` with score 0, and so is every text
when there is nothing to learn from; equal scores take the first language by name; repeated rows
repeat in the result; a null doc_id is neither learned from nor held out; other columns pass through ``confident`` and are not read otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .textscan import STARTS_CHAR, chunks, map_columns, map_rows

UNDETERMINED = "und"
PIECE_BYTES = 1 << 17  # of a long text at a time
_CONTEXT = 8  # code points that a piece sees of the one before; no order is longer
_KEYS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


@dataclass(frozen=True)
class Fit:
    """rows_per_language, sample_bytes: bounds of the labelled sample, in texts of each language and in bytes of all counts; its calibrating part is never fitted on."""

    orders: tuple[int, ...] = (1, 2, 3)
    bits: int = 16
    least_documents: int = 2
    rows_per_language: int = 800
    sample_bytes: int = 1 << 27
    calibrating: float = 0.2
    epochs: int = 4
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.01
    scale: float = 10.0
    seed: int = 5


@dataclass(frozen=True)
class Model:
    languages: list[str]
    weights: np.ndarray  # buckets x languages, times inverse document frequency
    bias: np.ndarray
    temperature: float
    options: Fit


class Letters:
    """Folded code points of a chunk: letters lower-cased, anything else a space, spaces merged."""

    def __init__(self) -> None:
        self.folded = np.full(0x110000, 0xFFFFFFFF, np.uint32)

    def read(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code points, row offsets and number of letters by row; each row starts with a space."""
        rows = len(offsets) - 1
        points = np.frombuffer(data.tobytes().decode(errors="replace").encode("utf-32-le"), np.uint32)
        chars = np.zeros(len(data) + 1, np.int64)
        np.cumsum(STARTS_CHAR[data], out=chars[1:])
        bounds = chars[offsets] if chars[-1] == len(points) else np.minimum(chars[offsets], len(points))
        folded = self.folded[points]
        if (folded == 0xFFFFFFFF).any():
            for p in np.unique(points[folded == 0xFFFFFFFF]).tolist():
                c = chr(p)
                self.folded[p] = ord(c.lower()[0]) if c.isalpha() else 32
            folded = self.folded[points]
        # a space before each row, so that rows never share an n-gram of letters
        spaced = np.full(len(folded) + rows, 32, np.uint32)
        row = np.repeat(np.arange(rows), np.diff(bounds))
        spaced[np.arange(len(folded)) + row + 1] = folded
        begins = bounds[:-1] + np.arange(rows)
        keep = spaced != 32
        letters = np.zeros(len(spaced) + 1, np.int64)
        np.cumsum(keep, out=letters[1:])
        ends = np.append(begins[1:], len(spaced))
        n_letters = letters[ends] - letters[begins]
        keep[1:] |= keep[:-1]
        keep[begins] = True
        place = np.zeros(len(spaced) + 1, np.int64)
        np.cumsum(keep, out=place[1:])
        return spaced[keep], place[np.append(begins, len(spaced))], n_letters


def buckets(points: np.ndarray, order: int, bits: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each place."""
    n = max(0, len(points) - order + 1)
    total = np.full(n, order, np.uint64) * _KEYS[3]
    for i in range(order):
        total = (total ^ points[i : i + n]) * _KEYS[i % 3]
        total ^= total >> np.uint64(29)
    return (total * _KEYS[0] >> np.uint64(64 - bits)).astype(np.int64)


def long_points(letters: Letters, data: np.ndarray, piece: int = PIECE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Folded code points of one text in pieces: those of each piece, the last few before it, and its number of letters."""
    a, tail = 0, np.zeros(0, np.uint32)
    while a < len(data):
        b = min(len(data), a + piece)
        while b < len(data) and not STARTS_CHAR[data[b]]:
            b += 1
        points, _, n_letters = letters.read(data[a:b], np.array([0, b - a]))
        # the space that ``read`` puts before a row stands here only where the text has one
        if a and (data[a:b][:4].tobytes().decode(errors="ignore")[:1].isalpha() or tail[-1:] == 32):
            points = points[1:]
        yield points, tail, int(n_letters[0])
        tail = np.concatenate([tail, points[-_CONTEXT:]])[-_CONTEXT:]
        a = b


def piece_grams(points: np.ndarray, tail: np.ndarray, order: int, bits: int) -> np.ndarray:
    """Buckets of the n-grams of a piece, those over the cut before it with it."""
    return buckets(np.concatenate([tail[len(tail) - min(order - 1, len(tail)) :], points]), order, bits)


def _row_grams(points: np.ndarray, rows: np.ndarray, options: Fit) -> Iterator[np.ndarray]:
    """All buckets of each row, every order."""
    grams = [buckets(points, order, options.bits) for order in options.orders]
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist()):
        yield np.concatenate([g[a : max(a, b - order + 1)] for g, order in zip(grams, options.orders)])


def training_rows(docs: DataFrame) -> Column:
    """doc_ids that a query may learn from: crc32 of the id as text, mod 5, is not 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0, F.lit(False))


def inverse_frequencies(texts: DataFrame, options: Fit) -> np.ndarray:
    """log((1 + n) / (1 + documents with the bucket)) + 1 over all rows; rare buckets are 0."""
    size = 1 << options.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, total, rows_seen, place = Letters(), np.zeros(size, np.int64), 0, np.zeros(size, np.int64)
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0)):
                rows_seen += len(offsets) - 1
                if len(offsets) == 2 and len(data) > PIECE_BYTES:
                    seen = np.zeros(size, bool)
                    for points, tail, _ in long_points(letters, data):
                        for order in options.orders:
                            seen[piece_grams(points, tail, order, options.bits)] = True
                    total += seen
                    continue
                points, rows, _ = letters.read(data, offsets)
                for grams in _row_grams(points, rows, options):
                    order = np.arange(len(grams))
                    place[grams] = order
                    total[grams[place[grams] == order]] += 1
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], rows_seen))], ["bucket", "n"])

    counts = np.zeros(size + 1, np.int64)
    # at most one row for each bucket: a bounded result
    found = map_columns(texts, ["text"], run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts[found["bucket"].to_numpy()] = found["n"].to_numpy()
    inverse = np.log((1 + counts[-1]) / (1 + counts[:-1])) + 1
    inverse[counts[:-1] < min(options.least_documents, max(1, counts[-1] // 2))] = 0
    return inverse


def labelled_sample(rows: DataFrame, options: Fit) -> list[tuple[str, bool, np.ndarray, np.ndarray]]:
    """(language, calibrating, buckets, shares) of a sample of the distinct rows(text, lang), about ``rows_per_language`` of each, and of a short piece of each.

    Whole texts are reduced to counts in the tasks; of each language an equal part of ``sample_bytes`` comes to the driver.
    """
    counts = {r["lang"]: max(1, r["n"]) for r in rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n")).collect()}
    if not counts:
        return []
    at = F.pmod(F.xxhash64("text", F.lit(options.seed)), F.lit(1 << 30)) / (1 << 30)
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, options.rows_per_language / n))])
    # copies share a hash, so they would all enter together
    sample = rows.where(at < share[F.col("lang")]).distinct()

    def counted(lang: str, grams: np.ndarray, key: int) -> tuple:
        found, n = np.unique(grams, return_counts=True)
        return lang, found.astype(np.int32).tobytes(), (n / len(grams)).astype(np.float32).tobytes(), key

    def long_counted(lang: str, letters: Letters, data: np.ndarray) -> list[tuple]:
        total, out, any_letters, key = np.zeros(1 << options.bits, np.int64), [], False, 0
        for points, tail, n_letters in long_points(letters, data):
            any_letters |= n_letters > 0
            for order in options.orders:
                total += np.bincount(piece_grams(points, tail, order, options.bits), minlength=len(total))
            if not len(tail) and len(points) > 200:
                spot = int(points.sum(dtype=np.int64)) % (len(points) - 200)
                short = np.concatenate([buckets(points[spot : spot + 200], order, options.bits) for order in options.orders])
                key = int(short[:50].sum())
                out.append(counted(lang, short, key))
        found = np.flatnonzero(total)
        out.append((lang, found.astype(np.int32).tobytes(), (total[found] / total.sum()).astype(np.float32).tobytes(), key))
        return out if any_letters else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = Letters()
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for at, end, data, offsets in chunks(batch.column(1)):
                out = []
                if end == at + 1 and len(data) > PIECE_BYTES:
                    out = long_counted(langs[at], letters, data)
                else:
                    points, rows, n_letters = letters.read(data, offsets)
                    for i, (a, b) in enumerate(zip(rows[:-1].tolist(), rows[1:].tolist())):
                        if not n_letters[i]:
                            continue
                        spot = a + int(points[a:b].sum(dtype=np.int64)) % (b - a)  # any fixed place
                        piece = points[spot : min(b, spot + 40 + spot % 160)]
                        grams, short = (np.concatenate([buckets(p, order, options.bits) for order in options.orders]) for p in (points[a:b], piece))
                        out += [counted(langs[at + i], own, int(grams[:50].sum())) for own in (grams, short) if len(own)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.binary(), pa.binary(), pa.int64()))], ["lang", "bucket", "share", "key"])

    rows_found = map_columns(sample, ["lang", "text"], run, "lang string, bucket binary, share binary, key long")
    order = ("key", "lang", "bucket")
    so_far = F.sum(F.octet_length("bucket") + F.octet_length("share")).over(Window.partitionBy("lang").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    first = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    bounded = rows_found.withColumn("_size", so_far).withColumn("_n", first).where((F.col("_size") <= options.sample_bytes // len(counts)) | (F.col("_n") <= 2))
    found = bounded.select("lang", "bucket", "share", "key").orderBy(*order).collect()
    step = max(2, round(1 / options.calibrating))
    return [(r["lang"], r["key"] % step == 0, np.frombuffer(r["bucket"], np.int32), np.frombuffer(r["share"], np.float32)) for r in found]


def fit(sample: list[tuple[str, bool, np.ndarray, np.ndarray]], inverse: np.ndarray, options: Fit) -> Model | None:
    """FTRL-proximal with an elastic net, then the temperature."""
    languages = sorted({lang for lang, *_ in sample})
    if not languages:
        return None
    k, index = len(languages), {lang: i for i, lang in enumerate(languages)}
    scaled = inverse * options.scale
    z, n = np.zeros((len(inverse) + 1, k)), np.zeros((len(inverse) + 1, k))  # the last row is the bias

    def weights(rows: np.ndarray) -> np.ndarray:
        zr, nr = z[rows], n[rows]
        l1 = np.where(rows == len(inverse), 0.0, options.l1)[:, None]
        return np.where(np.abs(zr) <= l1, 0.0, -(zr - np.sign(zr) * l1) / ((options.beta + np.sqrt(nr)) / options.alpha + options.l2))

    fitted = [s for s in sample if not s[1]] or sample
    shuffle = np.random.default_rng(options.seed)
    for _ in range(options.epochs):
        for i in shuffle.permutation(len(fitted)):
            lang, _, bucket, share = fitted[i]
            rows = np.append(bucket, len(inverse))
            values = np.append(share * scaled[bucket], 1.0)
            w = weights(rows)
            g = values[:, None] * (_softmax(values @ w) - (np.arange(k) == index[lang]))
            grown = n[rows] + g * g
            z[rows] += g - (np.sqrt(grown) - np.sqrt(n[rows])) / options.alpha * w
            n[rows] = grown
    full = weights(np.arange(len(inverse) + 1))
    weighted, bias = full[:-1] * scaled[:, None], full[-1]
    calibrating = [s for s in sample if s[1]] or sample
    logits = np.array([share @ weighted[bucket] + bias for _, _, bucket, share in calibrating])
    truth = np.array([index[lang] for lang, *_ in calibrating])
    loss = lambda t: -np.log(np.maximum(_softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean()
    temperature = min(np.geomspace(0.05, 20, 200).tolist(), key=loss)
    return Model(languages, weighted.astype(np.float32), bias, temperature, options)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def learn(labelled: DataFrame, options: Fit = Fit()) -> Model | None:
    """Learns from labelled(text, lang) rows with both; None if there are none."""
    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    sample = labelled_sample(rows, options)
    return fit(sample, inverse_frequencies(rows, options), options) if sample else None


class Predictor:
    """Languages and calibrated scores of chunks of rows, for one task."""

    def __init__(self, model: Model | None, piece: int = PIECE_BYTES):
        self.model, self.letters, self.piece = model, Letters(), piece
        if model is not None:
            self.tables = np.rint(model.weights.T.astype(np.float64) * (1 << 20)).astype(np.int64)

    def _sums(self, points: np.ndarray, order: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Summed weights of the n-grams that start in [begin, end) of each row."""
        grams = buckets(points, order, self.model.options.bits)
        running = np.zeros(len(grams) + 1, np.int64)
        out = np.zeros((len(begin), len(self.tables)), np.int64)
        for i, table in enumerate(self.tables):
            np.cumsum(table[grams], out=running[1:])
            out[:, i] = running[np.minimum(end, len(grams))] - running[np.minimum(begin, len(grams))]
        return out

    def _rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Weight sums, number of n-grams and of letters of each row."""
        points, rows, n_letters = self.letters.read(data, offsets)
        total, count = 0, 0
        for order in self.model.options.orders:
            end = np.maximum(rows[:-1], rows[1:] - order + 1)
            total = total + self._sums(points, order, rows[:-1], end)
            count = count + end - rows[:-1]
        return total, count, n_letters

    def _long_row(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same of one text, piece by piece; n-grams over a cut are counted with the later piece."""
        total, count, n_letters = np.zeros((1, len(self.tables)), np.int64), 0, 0
        for points, tail, letters in long_points(self.letters, data, self.piece):
            for order in self.model.options.orders:
                grams = piece_grams(points, tail, order, self.model.options.bits)
                total += np.array([int(table[grams].sum()) for table in self.tables])
                count += len(grams)
            n_letters += letters
        return total, np.array([count]), np.array([n_letters])

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        rows_in = len(offsets) - 1
        if self.model is None:
            return [UNDETERMINED] * rows_in, np.zeros(rows_in)
        total, count, n_letters = self._long_row(data) if rows_in == 1 and len(data) > self.piece else self._rows(data, offsets)
        chance = _softmax((total / (1 << 20) / np.maximum(count, 1)[:, None] + self.model.bias) / self.model.temperature)
        best = chance.argmax(1)
        none = n_letters == 0
        score = chance[np.arange(rows_in), best]
        return [UNDETERMINED if u else self.model.languages[b] for u, b in zip(none.tolist(), best.tolist())], np.where(none, 0.0, score)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs(doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(shared.value)
        for batch in batches:
            for at, end, data, offsets in chunks(batch.column(2)):
                lang, score = predictor.predict(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0)[at:end], batch.column(1)[at:end], pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    doc_id = F.col("doc_id").cast("long").alias("doc_id")
    rows = docs.select(doc_id, (F.col("doc_id").isNotNull() & ~training_rows(docs)).alias("held_out"), "text")
    return map_columns(rows, ["doc_id", "held_out", "text"], run, "doc_id long, held_out boolean, lang_pred string, score double")


def confident(docs: DataFrame, model: Model | None, least_score: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose language is determined with at least this score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(shared.value)
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for at, end, data, offsets in chunks(batch.column(batch.schema.get_field_index("text"))):
                lang, score = predictor.predict(data, offsets)
                keep[at:end] = (score >= least_score) & (np.array(lang) != UNDETERMINED)
            yield batch.filter(pa.array(keep))

    return map_rows(docs, run)
