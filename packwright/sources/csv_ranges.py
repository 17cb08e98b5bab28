"""Reading of large CSV files by byte ranges, although quoted values may hold line ends.

Whether a line is the start of a record depends on every quote before it.  A first pass over all ranges
finds, for both cases (a range starts between records, or inside a quoted value), in which case it ends
and how many records start in it.  Each range is then a function of two states, and these are composed in
file order by windows over one small row a range: what holds at a range's start is what the last range with
a constant outcome left, switched once for each range since then that switches.  The second pass knows for
each range where its first record starts and what number it has, and reads on behind the range's end
for the rest of its last record.  No row is shuffled, and the numbers are the rows' places.

A line belongs to the range in which it starts.  Records end at a line feed, with or without a carriage
return; a quote opens a value at the value's start alone and is text elsewhere.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from packwright.sources.files import filesystem

RANGE_BYTES = 1 << 25
LEAST_TASKS = 128
BYTE_ORDER_MARK = b"\xef\xbb\xbf"
_QUOTED = rb'"(?:[^"]++|"")*+'
_INSIDE = re.compile(rb'(?:[^"]++|"")*+')
#: One record; group 1 is empty if its last value is an open quote, group 2 if no line end was met.
_RECORD_BYTES = rb"(?:(?:" + _QUOTED + rb'"?+)?+[^,\n]*+,)*+(?:' + _QUOTED + rb'("?+))?+[^,\n]*+(\n|\Z)'
_RECORD = re.compile(_RECORD_BYTES)
_REST = re.compile(rb"[^,\n]*+(?:(?:\n|\Z)|," + _RECORD_BYTES + rb")")
_VALUE = re.compile(rb'(?:"((?:[^"]++|"")*+)"?([^,]*+)|([^,]*+))(,|\Z)')
_BLANK = (b"\n", b"\r\n", b"\r")
_MORE, _BATCH_ROWS, _BATCH_BYTES = 1 << 16, 10_000, 1 << 23


def _uri(path: str) -> str:
    return re.sub(r"^file:/+", "file:///", path)


class Lines:
    """One file, read by range."""

    def __init__(self, path: str):
        system, local = filesystem(_uri(path))
        self.file = system.open_input_file(local)
        self.size = self.file.size()

    def read(self, at: int, end: int) -> bytes:
        self.file.seek(at)
        return self.file.read(max(0, min(end, self.size) - at))

    def line_start(self, at: int) -> int:
        """The first start of a line from ``at`` on, or the file's end."""
        if at <= 0:
            return 0
        at -= 1
        while at < self.size:
            part = self.read(at, at + _MORE)
            found = part.find(b"\n")
            if found >= 0:
                return at + found + 1
            at += len(part)
        return self.size

    def segment(self, start: int, end: int) -> tuple[int, bytes]:
        """Where the first line that starts in the range starts, and all lines that do."""
        first = self.line_start(start)
        if first >= min(end, self.size):
            return first, b""
        return first, self.read(first, self.line_start(end))


def record_start(data: bytes, inside: bool) -> tuple[int, bool]:
    """Where the first record starts in whole lines, and whether none does as a quote stays open."""
    if not inside:
        return 0, False
    at = _INSIDE.match(data).end()
    if at == len(data):
        return at, True
    rest = _REST.match(data, at + 1)
    return rest.end(), rest.group(1) == b""


def scanned(data: bytes, inside: bool) -> tuple[bool, int]:
    """Whether whole lines end inside a quoted value, and how many records start in them; blank lines are none."""
    at, open_ = record_start(data, inside)
    count = 0
    while at < len(data):
        m = _RECORD.match(data, at)
        open_ = m.group(1) == b""
        count += m.end() - at > 2 or data[at : m.end()] not in _BLANK
        at = m.end()
    return open_, count


def values(record: bytes) -> list[bytes]:
    """The values of a record that ends without its line end."""
    if b'"' not in record:
        return record.split(b",")
    out, at = [], 0
    while True:
        m = _VALUE.match(record, at)
        quoted, rest, plain, comma = m.groups()
        out.append(plain if quoted is None else quoted.replace(b'""', b'"') + rest)
        if not comma:
            return out
        at = m.end()


def _line(data: bytes, at: int, m: re.Match) -> bytes:
    return data[at : m.end()].removesuffix(b"\n").removesuffix(b"\r") if m.group(2) else data[at : m.end()]


def records(file: Lines, data: bytes, at: int, more: int) -> Iterator[bytes]:
    """Records that start in the lines ``data`` from ``at`` on; ``more`` is the file's place behind them."""
    until = len(data)
    while at < until:
        m = _RECORD.match(data, at)
        while not m.group(2) and more < file.size:
            part = file.read(more, more + max(_MORE, len(data) - at))
            data, more = data + part, more + len(part)
            m = _RECORD.match(data, at)
        if data[at : min(m.end(), at + 3)] not in _BLANK:
            yield _line(data, at, m)
        at = m.end()


def _text(value: bytes) -> str:
    return value.decode(errors="replace")


def header(first: str) -> list[str]:
    """Names of a file's columns; unnamed and repeated ones get their place."""
    file = Lines(first)
    data = file.segment(0, 1)[1]
    start = len(BYTE_ORDER_MARK) if data.startswith(BYTE_ORDER_MARK) else 0
    names = [_text(v) for v in values(next(records(file, data, start, len(data)), b""))]
    return [f"_c{i}" if not n else n if names.index(n) == i else f"{n}{i}" for i, n in enumerate(names)]


def ranges(spark: SparkSession, path: str, size: int) -> DataFrame:
    """path, start, end of all ranges of the files."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes")).where("bytes > 0")
    return files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(size).cast("long"))).alias("start")).withColumn("end", F.col("start") + size)


def _spread(rows: DataFrame, size: int) -> DataFrame:
    """Ranges of ``size`` bytes dealt to tasks: beyond LEAST_TASKS small ones share a task of about RANGE_BYTES, so tasks and files stay few."""
    count = rows.count()
    least = max(LEAST_TASKS, 3 * rows.sparkSession.sparkContext.defaultParallelism)
    return rows.repartition(max(1, min(count, max(least, -(-count * size // RANGE_BYTES)))))


def placed_ranges(spark: SparkSession, path: str, size: int) -> DataFrame:
    """path, start, end, inside, before: whether a range starts inside a quoted value, and the rows before it in all files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for p, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                data = Lines(p).segment(start, end)[1]
                if not start:
                    data = data.removeprefix(BYTE_ORDER_MARK)
                (out, n), (in_, m) = scanned(data, False), scanned(data, True)
                rows.append((p, start, end, out, n, in_, m))
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], pa.schema(list(zip(names, kinds))))

    names, kinds = ["path", "start", "end", "out_to", "out_rows", "in_to", "in_rows"], [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64()]
    from packwright.sources.staging import staged

    found = staged(_spread(ranges(spark, path, size), size).mapInArrow(run, "path string, start long, end long, out_to boolean, out_rows long, in_to boolean, in_rows long"), "csv-ranges")
    # one row a range from here on
    file = Window.partitionBy("path").orderBy("start")
    earlier = file.rowsBetween(Window.unboundedPreceding, -1)
    switches = F.coalesce(F.sum(F.col("out_to").cast("int") * (~F.col("in_to")).cast("int")).over(file.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    known = found.withColumn("switches", switches).withColumn("fixed", F.when(F.col("out_to") == F.col("in_to"), F.struct("out_to", "switches")))
    last = F.last("fixed", ignorenulls=True).over(earlier)
    so_far = F.coalesce(F.lag("switches").over(file), F.lit(0)) - F.coalesce(last["switches"], F.lit(0))
    state = known.withColumn("inside", F.coalesce(last["out_to"], F.lit(False)) != (so_far % 2 == 1)).withColumn("rows", F.when(F.col("inside"), F.col("in_rows")).otherwise(F.col("out_rows")))
    # a file's first record is its header
    own = state.withColumn("own", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
    files = own.groupBy("path").agg((F.sum("rows") - 1).alias("n"))
    files = files.withColumn("files_before", F.coalesce(F.sum("n").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return own.join(files, "path").select("path", "start", "end", "inside", (F.col("files_before") + F.col("own") - F.when(F.col("start") > 0, 1).otherwise(0)).alias("before"))


def read_ranges(spark: SparkSession, path: str, size: int = RANGE_BYTES) -> DataFrame:
    """All columns as text by the first file's header, and row_index, the row's place in the files by name.

    Each file has a header.  Short rows are filled with empty text, values beyond the header go, blank lines are
    skipped, what is no UTF-8 reads as U+FFFD; a column of the name row_index gives way.  No files, no rows.
    """
    from packwright.sources.staging import staged

    placed = staged(placed_ranges(spark, path, size), "csv-places")
    first = placed.agg(F.min("path")).first()[0]
    columns = [(i, c) for i, c in enumerate(header(first) if first else []) if c != "row_index"]
    schema = T.StructType([*(T.StructField(c, T.StringType()) for _, c in columns), T.StructField("row_index", T.LongType())])
    names = pa.schema([*((c, pa.string()) for _, c in columns), ("row_index", pa.int64())])

    def made(rows: list[list[bytes]], at: int) -> pa.RecordBatch:
        texts = [pa.array([_text(r[i]) if i < len(r) else "" for r in rows], pa.string()) for i, _ in columns]
        return pa.RecordBatch.from_arrays([*texts, pa.array(range(at, at + len(rows)), pa.int64())], schema=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, start, end, inside, number in zip(*(c.to_pylist() for c in batch.columns)):
                file = Lines(p)
                where, data = file.segment(start, end)
                at = len(BYTE_ORDER_MARK) if not start and data.startswith(BYTE_ORDER_MARK) else record_start(data, inside)[0]
                found = records(file, data, at, where + len(data))
                if not start:
                    next(found, None)  # the header
                rows, held = [], 0
                for record in found:
                    rows.append(values(record))
                    held += len(record)
                    if len(rows) >= _BATCH_ROWS or held > _BATCH_BYTES:
                        yield made(rows, number)
                        number, rows, held = number + len(rows), [], 0
                if rows:
                    yield made(rows, number)

    return _spread(placed, size).mapInArrow(run, schema)
