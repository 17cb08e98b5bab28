"""Near-duplicate groups by bottom-k sketches of one hash function, verified on full shingle sets.

1. Every text becomes its set of shingle hashes; equal sets form a class at once, whatever its size.
2. The k smallest hashes of a set are its sketch.  Two sets as similar as the threshold share at
   least ``least`` of the k smallest values of their union, but for a chance of the given number of
   standard deviations.  So, with values ordered from rare to frequent, their sketches share one of
   their first k - least + 1 values: only those enter the inverted lists, and frequent values don't.
3. A short list gives all its pairs.  A long one (a large group of near copies) gives a star around
   its most typical member; after the linked sets are joined, members of different components of one
   list are left.  Those are told apart by what they don't share with the hub (``remaining_links``),
   which is exact.  Long lists are dealt out by salt, so no list meets in one task.
4. Short digests of the sketches tell which candidate pairs can be links at all (``alike``); what stays is
   verified exactly on the full sets.  Links and classes then join into components.

Tables between the steps are deleted once nothing reads them any more, and shuffle files with them.

Sketches and lists use one hash of the shingles.  A class, and a link, must also hold on the full sets
under a second, independent hash, so texts whose hashes collide are neither equal nor linked for that.

The order of values decides cost, not results: it comes from counts over all sketches.

Defined cases: a text without words has an empty set and is linked with nothing; a shorter text
than a shingle is one shingle; a very long text is one chunk, of which some bytes a character are held;
null doc_ids get a null component and are kept; repeated rows repeat in the result; rows of one doc_id
are one document, linked wherever one of its texts is; ties take the smallest doc_id; other columns are
not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .files import released
from .files import staged_lean as stored
from .textscan import FOLD_AZ, chunks, map_columns, mixed, span_hashes, window_hashes, word_spans


@dataclass(frozen=True)
class Near:
    """percent: least similarity of a link.  k: sketch size.  hot_values: most frequent values that are put last.  direct_pairs: up to so many pairs the members of long lists are tried pair by pair; beyond that in further rounds of hubs, as long as these shrink the lists.
    judged_list: lists of up to so many members are judged by digests first, all of a list in one task.
    broadcast_rows: up to so many document ids are broadcast; beyond that they are joined by shuffle.
    """

    words: int = 5
    percent: int = 80
    k: int = 128
    deviations: float = 5.0
    hot_values: int = 1 << 16
    short_list: int = 24
    salted_from: int = 512
    hub_orders: int = 4
    direct_pairs: int = 1 << 16
    judged_list: int = 1024
    broadcast_rows: int = 1 << 21

    @property
    def least(self) -> int:
        share = self.percent / 100
        return max(1, int(self.k * (share - self.deviations * (share * (1 - share) / self.k) ** 0.5)))

    def prefix(self, size: int) -> int:
        """Values of a set's sketch that enter the lists."""
        if size >= self.k:
            return self.k - self.least + 1
        return size - min(self.least, -(-size * self.percent // 100)) + 1

    def shared(self, both: np.ndarray) -> np.ndarray:
        """Values that two linked sets' sketches, of ``both`` values together, share: ``least`` of the k smallest of the union or, where that is smaller, the percentage of all."""
        return np.minimum(self.least, -(-both * self.percent // (100 + self.percent)))

    def linked(self, common: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int):
        return 100 * common >= self.percent * (a + b - common)

    def sets_linked(self, x: np.ndarray, y: np.ndarray) -> bool:
        return bool(self.linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)))


_SECOND = mixed(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def _sums(words: np.ndarray, size: int) -> np.ndarray:
    """A second hash of each run of ``size`` words, from their second hashes."""
    n = len(words) - size + 1
    total = np.zeros(n, np.uint64)
    for i in range(size):
        total += words[i : i + n] * _SECOND[i % 64] * np.uint64(2 * (i // 64) + 1)
    return total


def text_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The shingle set of each text under both hashes; a shorter text is one shingle, one without words has none."""
    start, end, first = word_spans(data, offsets)
    folded = FOLD_AZ[data]
    words, others = span_hashes(folded, start, end), span_hashes(folded, start, end, 1)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        k = min(size, b - a)
        yield (np.unique(window_hashes(words[a:b], k)), np.unique(_sums(others[a:b], k))) if k else (words[a:a], words[a:a])


def signatures(docs: DataFrame, options: Near) -> DataFrame:
    """doc_id, n, a 128-bit fingerprint of the set, and the sketch on the first row of each set in its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for at, end, data, offsets in chunks(batch.column(1)):
                sizes, prints, sketches = [], [], []
                for s, other in text_sets(data, offsets, options.words):
                    mark = hashlib.blake2b(s.tobytes() + other.tobytes(), digest_size=16).digest()
                    sizes.append(max(len(s), len(other)))
                    prints.append(mark)
                    sketches.append(None if mark in seen or not len(s) else s[: options.k].tobytes())
                    seen.add(mark)
                halves = np.frombuffer(b"".join(prints), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([batch.column(0)[at:end], pa.array(sizes, pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(sketches, pa.binary())], ["doc_id", "n", "f1", "f2", "sketch"])

    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stored(map_columns(typed, ["doc_id", "text"], run, "doc_id long, n long, f1 long, f2 long, sketch binary"), "signatures")


def frequent_values(sketches: DataFrame, options: Near) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent sketch values, ascending, and their counts; at most ``hot_values``, so a bounded result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0

        def counted():
            values, count = np.unique(np.concatenate(parts), return_counts=True)
            often = count > 1  # a value that is frequent in all is so in some partition
            return pa.RecordBatch.from_arrays([pa.array(values[often].view(np.int64)), pa.array(count[often])], ["value", "n"])

        for batch in batches:
            parts += [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(0)]
            held += sum(map(len, parts[-len(batch.column(0)) :]))
            if held > 1 << 22:
                yield counted()
                parts, held = [], 0
        if parts:
            yield counted()

    counts = map_columns(sketches, ["sketch"], run, "value long, n long").groupBy("value").agg(F.sum("n").alias("n")).where("n >= 4")
    counts = stored(counts, "frequent")
    # the least count from which at most hot_values values remain: a histogram first, so no task sends more than is kept
    least, room = 1 << 62, options.hot_values
    for r in counts.groupBy(F.least("n", F.lit(1 << 20)).alias("n")).agg(F.count("*").alias("values")).orderBy(F.desc("n")).toLocalIterator():
        room -= r["values"]
        if room < 0:
            break
        least = r["n"]
    rows = counts.where(F.col("n") >= least).toArrow()
    released(counts)
    values, n = rows["value"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    order = np.argsort(values)
    return values[order], n[order]


def _hot_counts(hot: tuple[np.ndarray, np.ndarray], values: np.ndarray) -> np.ndarray:
    """Count of each value that is among the frequent ones, else 0."""
    known, counts = hot
    if not len(known):
        return np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return np.where(known[at] == values, counts[at], 0)


def list_entries(sketches: DataFrame, options: Near) -> DataFrame:
    """The inverted lists of the rarest values of each sketch; own: how many of a sketch's values are not frequent."""
    hot = sketches.sparkSession.sparkContext.broadcast(frequent_values(sketches, options))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, parts, sizes, own = [], [], [], []
            columns = [batch.column(i).to_numpy() for i in range(3)]
            for n, raw in zip(columns[1].tolist(), batch.column(3)):
                sketch = np.frombuffer(raw.as_buffer(), np.uint64)
                count = _hot_counts(hot.value, sketch)
                first = np.argsort(count, kind="stable")[: options.prefix(n)]
                own.append(int((count == 0).sum()))
                values.append(sketch[first])
                parts.append(count[first] // options.salted_from + 1)
                sizes.append(len(first))
            if not sizes:
                continue
            doc_id, n, f, own = (np.repeat(c, sizes) for c in (*columns, np.array(own)))
            facts = np.minimum(np.concatenate(parts), _MOST_PARTS) << _N_BITS + _OWN_BITS | n << _OWN_BITS | np.minimum(own, _MOST_OWN)
            yield pa.RecordBatch.from_pydict({"value": np.concatenate(values).view(np.int64), "f": f, "doc_id": doc_id, "facts": facts})

    return map_columns(sketches, ["doc_id", "n", "f1", "sketch"], run, ENTRY_SCHEMA)


#: facts: parts, n and own in one number, as these rows are the most that are shuffled; parts and own decide cost alone.
ENTRY_SCHEMA = "value long, f long, doc_id long, facts long"
_N_BITS, _OWN_BITS = 31, 12
_MOST_PARTS, _MOST_OWN = (1 << 20) - 1, (1 << _OWN_BITS) - 1


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """value, salt, parts, f, doc_id, n, own of entries."""
    for batch in batches:
        value, f, doc_id, facts = (batch.column(i).to_numpy() for i in range(4))
        parts = facts >> _N_BITS + _OWN_BITS
        columns = [value, f % parts, parts, f, doc_id, facts >> _OWN_BITS & (1 << _N_BITS) - 1, facts & _MOST_OWN]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["value", "salt", "parts", "f", "doc_id", "n", "own"])


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of each list (equal value and salt) of sorted entries; lists of one only if they are a part of more."""
    kept: list[np.ndarray] | None = None

    def cut(columns: list[np.ndarray], last: bool) -> Iterator[list[np.ndarray]]:
        nonlocal kept
        change = (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])
        cuts = np.concatenate([[0], np.flatnonzero(change) + 1, [len(columns[0])]])
        end = len(cuts) - 1 - (not last)
        wanted = (np.diff(cuts) > 1) | (columns[2][cuts[:-1]] > 1)
        for i in np.flatnonzero(wanted[:end]).tolist():
            yield [c[cuts[i] : cuts[i + 1]] for c in columns]
        kept = [c[cuts[end] :] for c in columns]

    for batch in batches:
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
        if kept is not None:
            columns = [np.concatenate(x) for x in zip(kept, columns)]
        if len(columns[0]):
            yield from cut(columns, False)
    if kept is not None and len(kept[0]):
        yield from cut(kept, True)


PAIR, HUB, LONG = 0, 1, 2
#: Of a digest; two of unlike sketches of 128 values differ in some 200 bits, those of a link in 80 at most.
DIGEST_BITS = 1024
STAR_SCHEMA = "kind int, a long, b long, value long, f long, n long, own long"


def stars(entries: DataFrame, options: Near) -> DataFrame:
    """All pairs of short lists, stars of long ones, the hubs of parts of a list, and the members of long lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[np.ndarray, ...]] = []
        held = 0

        def add(kind: int, a: np.ndarray, b: np.ndarray, value: int = 0, *more: np.ndarray) -> None:
            nonlocal held
            none = np.zeros(len(a), np.int64)
            rows.append((np.full(len(a), kind, np.int32), a, b, none + value, *(more or (none, none, none))))
            held += len(a)

        for value, _, parts, f, doc, n, own in _lists(_unpacked(batches)):
            alone = np.concatenate([[True], f[1:] != f[:-1]])  # rows of equal sets are one member
            f, doc, n, own, m = f[alone], doc[alone], n[alone], own[alone], int(alone.sum())
            if m > 1 and m <= options.short_list:
                i, j = np.triu_indices(m, 1)
                fit = 100 * np.minimum(n[i], n[j]) >= options.percent * np.maximum(n[i], n[j])
                add(PAIR, np.minimum(doc[i], doc[j])[fit], np.maximum(doc[i], doc[j])[fit])
            seed = mixed(np.array([value[0] % options.hub_orders + 1]).view(np.uint64))
            hub = int(np.lexsort((mixed(f.view(np.uint64) ^ seed), own))[0])  # the most typical one
            if m > options.short_list:
                fit = 100 * np.minimum(n, n[hub]) >= options.percent * np.maximum(n, n[hub])
                fit[hub] = False
                add(PAIR, np.minimum(doc[fit], doc[hub]), np.maximum(doc[fit], doc[hub]))
            if parts[0] > 1:
                add(HUB, doc[hub : hub + 1], doc[hub : hub + 1], value[0], *(c[hub : hub + 1] for c in (f, n, own)))
            if m > options.short_list or parts[0] > 1:
                add(LONG, doc, doc, value[0], f, n, own)
            if held > 1 << 16:
                yield _batch(rows)
                rows.clear()
                held = 0
        if rows:
            yield _batch(rows)

    salt = F.pmod("f", F.shiftright("facts", _N_BITS + _OWN_BITS))
    ordered = entries.repartition("value", salt).sortWithinPartitions("value", salt, "f", "doc_id")
    return map_columns(ordered, ["value", "f", "doc_id", "facts"], run, STAR_SCHEMA)


def _batch(rows: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows)], ["kind", "a", "b", "value", "f", "n", "own"])


def partners(lists: DataFrame, digests: DataFrame, options: Near) -> DataFrame:
    """kind, a, b, value, component, n, own: what is left of open lists(value, component, doc_id, own, n), each in one task.

    Members whose digests rule out a link with all of other components go, which are most of a list of texts that
    share a phrase by chance.  What is left is given as pairs or, where these are many, as members (a) of the list.
    """
    words = DIGEST_BITS // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for value, _, _, doc, component, n, own, digest in _lists(batches):
            order = np.argsort(n, kind="stable")
            doc, component, n, own, digest = (c[order] for c in (doc, component, n, own, digest))
            known = all(d is not None for d in digest)
            marks = np.frombuffer(b"".join(digest), np.uint64).reshape(-1, words + 1) if known else np.zeros((len(doc), 0), np.uint64)
            kept, pairs, count = np.full(len(doc), not known), [], 0
            to = np.searchsorted(n, n * 100 // options.percent, "right")
            step = max(1, (1 << 21) // (words * len(doc)))
            for i in range(0, len(doc) if known else 0, step):
                j = to[min(i + step, len(doc)) - 1]
                x, y = marks[i : i + step], marks[i:j]
                both = (x[:, None, words] + y[None, :, words]).astype(np.int64)
                apart = np.bitwise_count(x[:, None, :words] ^ y[None, :, :words]).sum(axis=2, dtype=np.int64)
                fit = (apart <= both - 2 * options.shared(both)) & (component[i : i + step, None] != component[None, i:j])
                at, other = np.nonzero(np.triu(fit, 1))
                kept[i + at] = kept[i + other] = True
                count += len(at)
                if count <= 8 * len(doc):
                    pairs.append((doc[i + at], doc[i + other]))
            if known and count <= 8 * len(doc):
                a, b = (np.concatenate(c) for c in zip(*pairs))
                none = np.zeros(len(a), np.int64)
                yield _part([none + PAIR, np.minimum(a, b), np.maximum(a, b), none, none, none, none])
            else:
                none = np.zeros(int(kept.sum()), np.int64)
                yield _part([none + LONG, doc[kept], none, none + value[0], component[kept], n[kept], own[kept]])

    zero = F.lit(0).cast("long")
    wanted = among(digests, lists.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b")), options).distinct()
    rows = lists.join(wanted, "doc_id", "left").select("value", zero.alias("salt"), (zero + 1).alias("parts"), "doc_id", "component", "n", "own", "digest")
    return map_columns(rows.repartition("value").sortWithinPartitions("value"), rows.columns, run, PARTNER_SCHEMA)


PARTNER_SCHEMA = "kind long, a long, b long, value long, component long, n long, own long"


def _part(columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["kind", "a", "b", "value", "component", "n", "own"])


def hub_members(lists: DataFrame, groups: DataFrame, digests: DataFrame, options: Near) -> tuple[DataFrame, DataFrame]:
    """hub, hub_component, doc_id, component, n: members of long lists(value, doc_id, own, n) that hold different components; and pairs(a, b) of those lists that are settled by pairs.

    A list's hub is its most typical member, that with the fewest values of its own; lists with one hub are one group.
    """
    labelled = lists.join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("value", F.coalesce("component", "doc_id").alias("component"), "doc_id", "own", "n")
    labelled = stored(labelled.distinct(), "members")
    open_lists = stored(labelled.groupBy("value").agg(F.count("*").alias("m"), F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("value", "m"), "open-lists")
    rows = labelled.join(open_lists, "value")
    judged = stored(partners(rows.where(F.col("m") <= options.judged_list).drop("m"), digests, options), "partners")
    pairs = stored(judged.where(F.col("kind") == PAIR).select("a", "b").distinct(), "list-pairs")
    columns = ["value", "component", "doc_id", "own", "n"]
    rows = rows.where(F.col("m") > options.judged_list).select(columns).union(judged.where(F.col("kind") == LONG).withColumnRenamed("a", "doc_id").select(columns)).distinct()
    typical = F.min(F.struct("own", F.xxhash64("doc_id").alias("order"), "doc_id", "component")).alias("hub")
    hubs = rows.groupBy("value").agg(typical).select("value", F.col("hub.doc_id").alias("hub"), F.col("hub.component").alias("hub_component"))
    members = stored(rows.join(hubs, "value").where("doc_id <> hub").select("hub", "hub_component", "doc_id", "component", "n").distinct(), "hub-members")
    released(labelled, open_lists, judged)
    return members, pairs


def differences(members: DataFrame, sets: DataFrame, options: Near) -> DataFrame:
    """a, b, linked, doc_id, component, n, diff: each member's exact link with its hub, and the values that tell them apart.

    The values are hashed with the hub, so that those of different hubs never meet.
    """
    parts = members.groupBy("hub").agg((F.floor(F.count("*") / options.salted_from) + 1).alias("parts"))
    hubs = parts.join(sets.select(F.col("doc_id").alias("hub"), F.col("full").alias("hub_full"), F.col("other").alias("hub_other")), "hub").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = members.join(parts, "hub").withColumn("salt", F.pmod(F.xxhash64("doc_id"), "parts")).drop("parts")
    rows = dealt.join(sets.select("doc_id", "full", "other"), "doc_id").join(hubs.drop("parts"), ["hub", "salt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hub, doc = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            linked, diffs = [], []
            for h, *sets_of in zip(hub, *(batch.column(i) for i in range(5, 9))):
                x, y, other_x, other_y = (np.frombuffer(s.as_buffer(), np.uint64) for s in sets_of)
                apart = np.setxor1d(x, y, assume_unique=True)
                linked.append(bool(options.linked((len(x) + len(y) - len(apart)) // 2, len(x), len(y))) and options.sets_linked(other_x, other_y))
                diffs.append(np.sort(mixed(apart ^ mixed(np.array([h]).view(np.uint64)))).tobytes())
            linked = np.array(linked, bool) & (batch.column(1).to_numpy() != batch.column(3).to_numpy())
            yield pa.RecordBatch.from_pydict({"a": np.minimum(hub, doc), "b": np.maximum(hub, doc), "linked": linked, "doc_id": batch.column(2), "component": batch.column(3), "n": batch.column(4), "diff": pa.array(diffs, pa.binary())})

    columns = ["hub", "hub_component", "doc_id", "component", "n", "full", "hub_full", "other", "hub_other"]
    return stored(map_columns(rows, columns, run, "a long, b long, linked boolean, doc_id long, component long, n long, diff binary"), "differences")


def reach(size, other, n, m, percent: int):
    """Last place, in its ordered differences, at which a set can first meet another one that it is linked with.

    With the sizes of both sets and of their differences from one hub, a link needs
    (size + other - most) / 2 common differences, where most is the largest symmetric difference of a link.
    """
    return (size - other + (100 - percent) * (n + m) // (100 + percent)) // 2


def difference_entries(rows: DataFrame, options: Near) -> DataFrame:
    """value, doc_id, component, n, size, pos: the rarest differences of each member, as far as any link can reach."""
    hot = rows.sparkSession.sparkContext.broadcast(frequent_values(rows.select(F.col("diff").alias("sketch")), options))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(2).to_numpy()
            values, places, sizes, counts = [], [], [], []
            for size, raw in zip(n.tolist(), batch.column(3)):
                diff = np.frombuffer(raw.as_buffer(), np.uint64)
                first = np.argsort(_hot_counts(hot.value, diff), kind="stable")[: (100 - options.percent) * size // options.percent + 1]
                values.append(diff[first])
                places.append(np.arange(len(first)))
                sizes.append(len(diff))
                counts.append(len(first))
            if sum(counts):
                doc_id, component, n, sizes = (np.repeat(c, counts) for c in (batch.column(0).to_numpy(), batch.column(1).to_numpy(), n, np.array(sizes)))
                yield pa.RecordBatch.from_pydict({"value": np.concatenate(values).view(np.int64), "doc_id": doc_id, "component": component, "n": n, "size": sizes, "pos": np.concatenate(places)})

    return stored(map_columns(rows, ["doc_id", "component", "n", "diff"], run, "value long, doc_id long, component long, n long, size long, pos long"), "difference-entries")


def _fits(n: np.ndarray, size: np.ndarray, pos: np.ndarray, i: int, percent: int) -> np.ndarray:
    """Which entries of one list can be linked with entry i, by their places."""
    return (pos <= reach(size, size[i], n, n[i], percent)) & (pos[i] <= reach(size[i], size, n, n[i], percent))


def possible_entries(entries: DataFrame, options: Near) -> DataFrame:
    """The entries that can be linked with one of another component in their list.

    Entries of equal n, size and pos are judged as one, so a list of any length is a bounded matter.
    """
    kinds = entries.groupBy("value", "n", "size", "pos").agg(F.min("component").alias("least"), F.max("component").alias("most"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for value, _, parts, n, size, pos, least, most in _lists(batches):
            open_kind = np.zeros(len(n), bool)
            for i in range(len(n)):
                apart = (least != least[i]) | (most != most[i]) | (least != most)
                open_kind[i] = (apart & _fits(n, size, pos, i, options.percent)).any()
            if open_kind.any():
                yield pa.RecordBatch.from_pydict({"value": value[open_kind], "n": n[open_kind], "size": size[open_kind], "pos": pos[open_kind]})

    zero = F.lit(0).cast("long")
    # ``parts`` over 1 keeps lists of one kind, which may still hold two components
    dealt = kinds.select("value", zero.alias("salt"), F.when(F.col("least") < F.col("most"), 2).otherwise(1).cast("long").alias("parts"), "n", "size", "pos", "least", "most")
    dealt = dealt.repartition("value").sortWithinPartitions("value", "salt")
    found = stored(map_columns(dealt, dealt.columns, run, "value long, n long, size long, pos long"), "possible")
    possible = stored(entries.join(found, ["value", "n", "size", "pos"]), "possible-entries")
    released(found)
    return possible


def place_pairs(entries: DataFrame, options: Near) -> DataFrame:
    """a, b of one list and of different components that can be linked by their places.

    A list is dealt out by pairs of blocks of its members, so none has to meet in one task.
    """
    sizes = entries.groupBy("value").agg((F.floor(F.count("*") / 1024) + 1).alias("blocks"))
    rows = entries.join(sizes, "value").withColumn("own", F.pmod(F.xxhash64("doc_id"), "blocks"))
    dealt = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    x, y, one = F.least("own", "other"), F.greatest("own", "other"), F.lit(1).cast("long")
    cells = dealt.select(F.xxhash64("value", x, y).alias("cell"), (one - 1).alias("salt"), one.alias("parts"), (F.col("own") == x).alias("first"), (x == y).alias("same"), "component", "doc_id", "n", "size", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, first, same, component, doc, n, size, pos in _lists(batches):
            for i in np.flatnonzero(first).tolist():
                fit = _fits(n, size, pos, i, options.percent) & (component != component[i])
                fit &= np.arange(len(doc)) > i if same[0] else ~first
                if fit.any():
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(doc[fit], doc[i])), pa.array(np.maximum(doc[fit], doc[i]))], ["a", "b"])

    ordered = cells.repartition("cell").sortWithinPartitions("cell")
    return map_columns(ordered, cells.columns, run, "a long, b long").distinct()


def remaining_links(lists: DataFrame, groups: DataFrame, docs: DataFrame, digests: DataFrame, options: Near) -> Iterator[DataFrame]:
    """Links between different components of long lists(value, doc_id, own, n), in rounds; sent the components after each.

    Lists in which digests leave few pairs are settled by these.  Members of the others have much in common, so what counts is what tells them from their hub: two
    sets of which one is not linked with the hub are linked only if they share enough of that.  Those
    differences, from rare to frequent, form new lists.  Short ones give pairs; long ones are the next
    round's lists, around other hubs.  Once long lists no longer shrink, their pairs are formed as well.
    """
    sets, before, spent = None, None, []
    while True:
        members, listed = hub_members(lists, groups, digests, options)
        released(*spent)
        settled = links(listed, options, docs)
        released(listed)
        if members.isEmpty():
            released(members, *([sets] if sets else []))
            if not settled.isEmpty():
                yield settled
            return
        if sets is None:
            sets = full_sets(docs, members.select(F.col("hub").alias("a"), F.col("doc_id").alias("b")), options)
        found = differences(members, sets, options)
        told = difference_entries(found.where(F.length("diff") > 0), options)
        entries = possible_entries(told, options)
        released(told, members)
        long = entries.groupBy("value").agg(F.count("*").alias("m")).where(F.col("m") > options.short_list)
        long = stored(long, "long-lists")
        size = long.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("m").cast("double") * F.col("m")), F.lit(0.0)).alias("pairs")).first()
        last = size["pairs"] <= options.direct_pairs or (before is not None and 10 * size["n"] > 9 * before)
        before = size["n"]
        short = entries if last else entries.join(long.select("value"), "value", "left_anti")
        pairs = stored(place_pairs(short, options), "place-pairs")
        close = alike(pairs, sketch_digests(sets.select("doc_id", F.substring("full", 1, 8 * options.k).alias("sketch"))), options)
        confirmed = links(close, options, sets=sets)
        star = found.where("linked").select("a", "b").distinct()
        groups = yield star.union(confirmed).union(settled)
        released(found, pairs, close, confirmed, settled)
        spent = [entries, long]
        if last:
            released(sets, *spent)
            return
        lists = entries.join(long.select("value"), "value", "left_semi").select("value", "doc_id", F.col("pos").alias("own"), "n")


def among(rows: DataFrame, pairs: DataFrame, options: Near) -> DataFrame:
    """The rows whose doc_id is in a pair."""
    nodes = stored(pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct(), "nodes")
    if nodes.count() <= options.broadcast_rows:  # so no text is shuffled
        nodes = F.broadcast(nodes)
    return rows.join(nodes, "doc_id", "left_semi")


def full_sets(docs: DataFrame, pairs: DataFrame, options: Near) -> DataFrame:
    """doc_id, full, other (the sets under both hashes) of the documents in ``pairs``, from their whole texts."""
    wanted = among(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), pairs, options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, offsets in chunks(batch.column(1)):
                sets = [(s.tobytes(), other.tobytes()) for s, other in text_sets(data, offsets, options.words)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[at:end], *(pa.array(c, pa.binary()) for c in zip(*sets))], ["doc_id", "full", "other"])

    return stored(map_columns(wanted, ["doc_id", "text"], run, "doc_id long, full binary, other binary").where(F.length("full") > 0), "sets")


def _kept_pairs(pairs: DataFrame, sets: DataFrame, columns: tuple[str, ...], accept) -> DataFrame:
    """The pairs whose values of ``columns``, first a's and then b's, pass ``accept``."""
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("doc_id").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in columns)), side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            views = [[np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(i)] for i in range(2, batch.num_columns)]
            fit = pa.array([bool(accept(*row)) for row in zip(*views)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(fit)

    wanted = ["a", "b", *(f"{side}_{c}" for side in ("a", "b") for c in columns)]
    return stored(map_columns(pairs, wanted, run, "a long, b long").distinct(), f"{columns[0]}-pairs")


def sketch_digests(sketches: DataFrame) -> DataFrame:
    """doc_id, digest of each sketch: a bit for each place on which an odd number of its values fall, and how many these are.

    Two digests differ in no more bits than their sketches in values, and they are an eighth of their size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for raw in batch.column(1):
                sketch = np.frombuffer(raw.as_buffer(), np.uint64)
                odd = np.bincount((mixed(sketch) % np.uint64(DIGEST_BITS)).view(np.int64), minlength=DIGEST_BITS) & 1
                found.append(np.packbits(odd.astype(np.uint8)).tobytes() + len(sketch).to_bytes(8, "little"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["doc_id", "digest"])

    return map_columns(sketches, ["doc_id", "sketch"], run, "doc_id long, digest binary")


def alike(pairs: DataFrame, digests: DataFrame, options: Near) -> DataFrame:
    """The candidate pairs but those whose sketches, by their digests, share too few values for a link."""
    words = DIGEST_BITS // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(-1, words + 1) for i in (2, 3))
            apart = np.bitwise_count(x[:, :words] ^ y[:, :words]).sum(axis=1, dtype=np.int64)
            both = (x[:, words] + y[:, words]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(apart <= both - 2 * options.shared(both)))

    digests = among(digests, pairs, options)
    for side in ("a", "b"):
        pairs = pairs.join(digests.select(F.col("doc_id").alias(side), F.col("digest").alias(f"{side}_digest")), side)
    return stored(map_columns(pairs, ["a", "b", "a_digest", "b_digest"], run, "a long, b long").distinct(), "alike")


def links(pairs: DataFrame, options: Near, docs: DataFrame | None = None, sets: DataFrame | None = None) -> DataFrame:
    """The candidate pairs that are links on their full sets: either ``sets`` or those of the whole texts of ``docs``."""

    def same(x: np.ndarray, other_x: np.ndarray, y: np.ndarray, other_y: np.ndarray) -> bool:
        return options.sets_linked(x, y) and options.sets_linked(other_x, other_y)

    if sets is not None:
        return _kept_pairs(pairs, sets, ("full", "other"), same)

    def sets_of(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The sets of each text; equal ones that follow each other are one."""
        column = column.fill_null("")
        fresh = np.concatenate([[True], pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)])
        found = (s for _, _, data, offsets in chunks(column.filter(pa.array(fresh))) for s in text_sets(data, offsets, options.words))
        for new in fresh.tolist():
            last = next(found) if new else last
            yield last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                fit = [len(x) > 0 and same(x, u, y, v) for (x, u), (y, v) in zip(sets_of(batch.column(2)), sets_of(batch.column(3)))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(fit, pa.bool_()))

    # texts are a quarter of their sets, so these are made where the pairs meet
    texts = among(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), pairs, options)
    for side in ("a", "b"):
        pairs = pairs.join(texts.select(F.col("doc_id").alias(side), F.col("text").alias(f"{side}_text")), side)
    return stored(map_columns(pairs, ["a", "b", "a_text", "b_text"], run, "a long, b long").distinct(), "full-pairs")


def near_duplicates(docs: DataFrame, options: Near = Near()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs(doc_id, text)."""
    marks = signatures(docs, options)
    filled = marks.where("n > 0 AND doc_id IS NOT NULL")
    copies = filled.groupBy("f1", "f2").agg(F.count("*").alias("rows"), F.min("doc_id").alias("class_id")).where("rows > 1").drop("rows")
    copies = stored(copies, "copies")
    member = marks.select("doc_id", "n", "f1", "f2").join(copies, ["f1", "f2"], "left")
    member = stored(member.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("class_id", "doc_id")).otherwise(F.col("doc_id")).alias("class_id")), "classes")
    # a set's first row in a partition stands for it in the lists; where that is not its least row, the class is looked up
    aliases = stored(member.where("class_id <> doc_id").select("doc_id", "class_id").distinct(), "aliases")

    def by_class(rows: DataFrame, column: str) -> DataFrame:
        return rows.join(aliases.select(F.col("doc_id").alias(column), F.col("class_id").alias("other")), column, "left").withColumn(column, F.coalesce("other", column)).drop("other")

    sketches = filled.where("sketch IS NOT NULL")
    found = stored(stars(list_entries(sketches, options), options), "stars")
    facts = F.lit(1 << _N_BITS + _OWN_BITS).bitwiseOR(F.shiftleft("n", _OWN_BITS)).bitwiseOR(F.col("own"))  # of one part
    hubs = found.where(F.col("kind") == HUB).select("value", "f", F.col("a").alias("doc_id"), facts.alias("facts"))
    pairs = stored(found.where(F.col("kind") == PAIR).select("a", "b").union(stars(hubs, options).where(F.col("kind") == PAIR).select("a", "b")).distinct(), "pairs")
    digests = stored(sketch_digests(sketches), "digests")
    released(marks)
    close = alike(pairs, digests, options)
    released(pairs)
    linked = links(close, options, docs)
    released(close)
    linked = by_class(by_class(linked, "a"), "b").where("a <> b")
    # a doc_id with texts of different classes is one document, which links them
    several = member.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("class_id").alias("least"), F.max("class_id").alias("most")).where("least <> most").select("doc_id")
    linked = linked.union(aliases.join(several, "doc_id", "left_semi").select("doc_id", "class_id"))
    groups = components(linked)

    long = by_class(found.where(F.col("kind") == LONG).select("value", F.col("a").alias("doc_id"), "own", "n"), "doc_id")
    rounds = remaining_links(long, groups, docs, by_class(digests, "doc_id"), options)
    more = next(rounds, None)
    while more is not None:
        linked = stored(linked.union(by_class(by_class(more, "a"), "b").where("a <> b")), "linked")
        groups = components(linked)
        try:
            more = rounds.send(groups)
        except StopIteration:
            break
    released(found, digests)
    joined = member.join(groups.withColumnRenamed("node", "class_id"), "class_id", "left")
    component = F.coalesce("component", "class_id")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
