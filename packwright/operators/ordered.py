"""Work along an order inside groups of any size: a fold whose step is not associative, and running sums.

Rows are dealt by range of (group, order), so a large group lies in several parts, one after the other, and no
task sees all of it.  What a part says of the groups that reach over its ends is a few rows; those are
put together in a second step.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from packwright.sources.staging import staged


class Successors:
    """A stretch of one group's candidates: where the fold ends, for each candidate that may be the first to take over.

    A candidate (score, size, what) takes the place of the one so far if it scores more, or if it is larger and at
    most ``near`` points worse; a missing score or size never compares.  Only a candidate that no earlier one
    of the stretch equals or beats in both can be the first to replace what comes from before: it is an
    entry.  Entries whose folds have met share one state, so few are open at a time.
    """

    def __init__(self, near: float):
        self.near, self.entries, self.open, self.front, self.count = near, [], [], [], 0

    def replaces(self, new: tuple, old: tuple) -> bool:
        if new[0] is None or old[0] is None:
            return False
        return new[0] > old[0] or (new[1] is not None and old[1] is not None and new[1] > old[1] and new[0] >= old[0] - self.near)

    def add(self, candidate: tuple) -> None:
        size = float("-inf") if candidate[1] is None else candidate[1]
        entry = not self.count or (candidate[0] is not None and not any(s >= candidate[0] and c >= size for s, c in self.front))
        self.count += 1
        met = [x for x in self.open if self.replaces(candidate, x[0])]
        if not met and not entry:
            return
        members = max((x[1] for x in met), key=len, default=[])
        for x in met:
            if x[1] is not members:
                members += x[1]
        if entry:
            members.append(len(self.entries))
            self.entries.append(candidate)
            if candidate[0] is not None:
                self.front = [(s, c) for s, c in self.front if s > candidate[0] or c > size] + [(candidate[0], size)]
        self.open = [x for x in self.open if x not in met] + [(candidate, members)]

    def ends(self) -> list[tuple]:
        """The last candidate of the fold that starts at each entry."""
        out: list[tuple] = [()] * len(self.entries)
        for state, members in self.open:
            for i in members:
                out[i] = state
        return out


_PART = "_group string, _key string, _part int, _entry int, score double, size double, what string, end_score double, end_size double, end_what string, n long, whole boolean"
_NAMES = [c.split()[0] for c in _PART.split(", ")]


def last_of_fold(rows: DataFrame, group: str, key: str, order: list[str], score: str, size: str, what: str, near: float) -> DataFrame:
    """group, key, what: the candidate that the ordered fold of ``Successors`` leaves, of the keys with more than one row."""

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, own, fold, at_start = TaskContext.get().partitionId(), None, None, True

        def told(whole: bool) -> list[tuple]:
            if whole:  # nothing of this key stands in other parts
                return [(*own, part, 0, None, None, None, *fold.ends()[0], fold.count, True)] if fold.count > 1 else []
            return [(*own, part, i, *entry, *end, fold.count, False) for i, (entry, end) in enumerate(zip(fold.entries, fold.ends()))]

        def made(out: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.string(), pa.float64(), pa.float64(), pa.string(), pa.int64(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], _NAMES)

        for batch in batches:
            out = []
            for g, k, s, c, w in zip(*(c.to_pylist() for c in batch.columns)):
                if fold is None or own != (g, k):
                    if fold is not None:
                        out += told(not at_start)
                        at_start = False
                    own, fold = (g, k), Successors(near)
                fold.add((s, c, w))
            if out:
                yield made(out)
        if fold is not None:
            yield made(told(False))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule, own, state, n, done_part = Successors(near), None, None, 0, None
        out: list[tuple] = []
        for batch in batches:
            for g, k, part, i, s, c, w, es, ec, ew, count in zip(*(col.to_pylist() for col in batch.columns)):
                if own != (g, k):
                    if own is not None and n > 1:
                        out.append((*own, state[2]))
                    own, state, n, done_part = (g, k), None, 0, None
                n += count if not i else 0
                if state is None:
                    state, done_part = (es, ec, ew), part
                elif part != done_part and rule.replaces((s, c), state):
                    state, done_part = (es, ec, ew), part
        if own is not None and n > 1:
            out.append((*own, state[2]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], ["_group", "_key", "what"])

    slim = rows.select(F.col(group).alias("_group"), F.col(key).alias("_key"), F.col(score).cast("double").alias("score"), F.col(size).cast("double").alias("size"), F.col(what).alias("what"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    by = ["_group", "_key", *[f"_o{i}" for i in range(len(order))], "score", "size", "what"]
    parts = staged(slim.repartitionByRange(*by).sortWithinPartitions(*by).select("_group", "_key", "score", "size", "what").mapInArrow(stretches, _PART), "fold-parts")
    whole = parts.where("whole").select("_group", "_key", F.col("end_what").alias("what"))
    # two keys a part at most reach over its ends
    open_ = parts.where("NOT whole").select("_group", "_key", "_part", "_entry", "score", "size", "what", "end_score", "end_size", "end_what", "n")
    ends = open_.repartition("_group", "_key").sortWithinPartitions("_group", "_key", "_part", "_entry").mapInArrow(joined, "_group string, _key string, what string")
    return whole.unionByName(ends).select(F.col("_group").alias(group), F.col("_key").alias(key), "what")


def sums_before(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Adds ``before``: the sum of ``value`` (a long; null is 0) over the group's earlier rows.

    Each part sums its own rows as they pass; a group that goes on from the part before is the first of its
    part, so what has to be added is one number a part.
    """
    names = rows.columns
    schema = T.StructType([*rows.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_own", T.LongType())])
    g, v = names.index(group), names.index(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, own, total, any_ = TaskContext.get().partitionId(), None, 0, False
        for batch in batches:
            sums = []
            for k, x in zip(batch.column(g).to_pylist(), batch.column(v).to_pylist()):
                if not any_ or k != own:
                    own, total, any_ = k, 0, True
                sums.append(total)
                total += x or 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(sums), pa.int32()), pa.array(sums, pa.int64())], [*batch.schema.names, "_part", "_own"])

    ranged = rows.repartitionByRange(group, order).sortWithinPartitions(group, order)
    placed = staged(ranged.mapInArrow(run, schema), "running-sums")
    totals = placed.groupBy(F.col(group).alias("_g"), "_part").agg(F.sum(value).alias("_total"))
    earlier = F.sum("_total").over(Window.partitionBy("_g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    # a group in an earlier part: at most one for each part
    carried = totals.withColumn("_carried", earlier).where("_carried IS NOT NULL").select("_g", F.col("_part").alias("_p"), "_carried")
    whole = placed.join(F.broadcast(carried), (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")), "left")
    return whole.select(*[F.col(f"`{c}`") for c in names], (F.col("_own") + F.coalesce("_carried", F.lit(0))).alias("before"))


def first_by(rows: DataFrame, groups: list[str], order: list[Column], most: int, spread: Column, salts: int = 16) -> DataFrame:
    """The first ``most`` rows of each group: of ``salts`` parts of a group first, then of those."""
    part = rows.withColumn("_part", F.pmod(F.xxhash64(spread), F.lit(salts)))
    few = part.withColumn("_n", F.row_number().over(Window.partitionBy(*groups, "_part").orderBy(*order))).where(F.col("_n") <= most)
    return few.withColumn("_n", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col("_n") <= most).drop("_n", "_part")
