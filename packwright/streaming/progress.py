"""Incremental runs: page streams to packets, progress counters, windowed progress, time budgets."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from packwright.functions.text import duration, half_up
from packwright.operators.enrichment import to_call
from packwright.sources.files import filesystem, write_whole
from packwright.sources.staging import staged
from packwright.sources.tables import write_json_lines

#: State that needs no room in the JVM's memory.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BUCKETS = 16


def page_stream(spark: SparkSession, folder: str, schema, files_a_batch: int = 64) -> DataFrame:
    """Parquet files of fetched pages as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def few(pages: Iterator[tuple], rows: int = 1000, characters: int = 1 << 21) -> Iterator[list[tuple]]:
    """The pages in lists of so many rows, or of so many characters and the page that passes them, at most."""
    part: list[tuple] = []
    held = 0
    for page in pages:
        part.append(page)
        held += sum(len(v) for v in page if isinstance(v, str | bytes))
        if len(part) >= rows or held >= characters:
            yield part
            part, held = [], 0
    if part:
        yield part


class Gathered(StatefulProcessor):
    """State of a key: its pages so far.  Gives all of them whenever some come."""

    def __init__(self, schema: T.StructType):
        self.schema = schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pages = handle.getListState("pages", self.schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        names = self.schema.fieldNames()
        for some in rows:
            plain = (tuple(None if v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v) else v for v in r) for r in some[names].itertuples(index=False))
            for part in few(plain):
                self.pages.appendList(part)
        for part in few(self.pages.get()):
            yield pd.DataFrame(part, columns=names)

    def close(self) -> None:
        pass


def start_results(pages: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, key: str = "company"):
    """Starts a query that keeps ``transform`` of all pages so far, for each key that a batch brings pages of.

    What ``transform`` says of a key depends on all its pages (lines repeated over a site, duplicates, a
    budget), and these may come in several batches.  So the pages of a key are its state, and a batch reads
    those of its own keys alone, however long the stream has run.  ``latest_results`` takes each key's rows
    from the last batch that had it.  A batch that runs again starts from the state before it and replaces
    its own folder.
    """
    spark = pages.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)

    def write(batch: DataFrame, number: int) -> None:
        batch = staged(batch, "stream-batch")  # the state is read once, whatever transform does
        transform(batch).withColumn("_hash", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")).write.mode("overwrite").partitionBy("_hash").parquet(f"{out}/results/batch={number}")
        batch.select(key).distinct().write.mode("overwrite").parquet(f"{out}/keys/batch={number}")

    kept = pages.groupBy(key).transformWithStateInPandas(Gathered(pages.schema), pages.schema, "Append", "None")
    return kept.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def latest_results(spark: SparkSession, out: str, key: str = "company") -> DataFrame:
    """The results of a stream: of each key, the rows of the last batch that had it, found from the keys of the batches."""
    last = spark.read.parquet(f"{out}/keys").groupBy(key).agg(F.max("batch").alias("batch"))
    rows = spark.read.parquet(f"{out}/results")
    last = last.withColumn("_hash", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int"))
    return rows.join(last, [key, "batch", "_hash"], "left_semi").drop("batch", "_hash")


def append_once(rows: DataFrame, folder: str, number: int) -> bool:
    """Appends a batch as JSON lines exactly once: rows count when the ledger names them, which is the last thing written.

    A run that stops in between leaves files that nobody reads; the batch is then written anew.
    """
    entry = f"{folder}/ledger/{number:012d}.json"
    system, path = filesystem(entry)
    if system.get_file_info(path).type.name == "File":
        return False
    attempt = f"rows/batch={number}/{uuid.uuid4().hex}"
    write_json_lines(rows, f"{folder}/{attempt}")
    write_whole(entry, [json.dumps({"batch": number, "rows": attempt}).encode()])
    return True


def committed_rows(spark: SparkSession, folder: str, schema) -> DataFrame:
    """All rows of the batches that the ledger names."""
    from pyarrow import fs

    system, path = filesystem(f"{folder}/ledger")
    files = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    names = [json.loads(system.open_input_file(f.path).read())["rows"] for f in files if not f.base_name.startswith(".")]  # one line a batch
    if not names:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json([f"{folder}/{n}" for n in sorted(names)])


def start_append(rows: DataFrame, folder: str, checkpoint: str):
    """A stream into an exactly-once table of JSON lines."""
    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, number: append_once(batch, folder, number) and None).start()


def remaining_cases(spark: SparkSession, cases: DataFrame, done: DataFrame) -> DataFrame:
    """Resume: the cases that have no row in the results yet."""
    return to_call(cases, done.select("case_id").distinct())


def start_snapshots(events: DataFrame, every: int, out: str, checkpoint: str):
    """Running counters of a stream, complete after each batch, and a snapshot each time another ``every`` rows are through.

    Snapshots are JSON lines under ``out``, by batch; the newest is there whatever its number.
    """
    counts = events.agg(*counters())

    def keep(batch: DataFrame, number: int) -> None:
        row = batch.first()  # one row of counters
        system, path = filesystem(f"{out}/state.json")
        known = system.get_file_info(path).type.name == "File"
        before = json.loads(system.open_input_file(path).read()) if known else {"batch": -1, "completed": 0, "kept": []}
        kept = [k for k in before["kept"] if k < number]
        if row["completed"] // every > before["completed"] // every or not kept:
            kept.append(number)
        batch.write.mode("overwrite").json(f"{out}/snapshot={number}")
        write_whole(f"{out}/state.json", [json.dumps({"batch": number, "completed": row["completed"], "kept": kept}).encode()])
        if known and before["batch"] not in kept and before["batch"] != number:
            old, place = filesystem(f"{out}/snapshot={before['batch']}")
            old.delete_dir(place)

    return counts.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(keep).start()


def counters() -> list[Column]:
    failed = F.col("event_type") == "error"
    return [F.count("*").alias("completed"), F.count_if(~failed).alias("successful"), F.count_if(failed).alias("failed")]


def progress(events: DataFrame, total: int, elapsed_minutes: float) -> DataFrame:
    """Counters, rate and time left; batch or stream (complete mode)."""
    counts = events.agg(*counters())
    rate = F.col("completed") / max(0.001, elapsed_minutes)
    left = F.greatest(F.lit(0), F.lit(total) - F.col("completed"))
    return counts.select("completed", "successful", "failed", half_up(rate, 1).alias("rate_per_minute"), half_up(F.col("completed") / max(1, total) * 100, 1).alias("percent"), duration(F.when(rate > 0, left / rate * 60).otherwise(0.0)).alias("eta"))


def hourly_progress(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events by type and hour; on a stream, hours close once the watermark passes them."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    counts = timed.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("failed"))
    return counts.select("event_type", F.col("w.start").alias("window_start"), "n", "failed")


BUDGET_OUT = "row_index long, position long, status string, remaining long"
BUDGET_STATE = "spent long, remaining long, first_late long"


def stream_within_time(sources: DataFrame, budget_ms: int) -> DataFrame:
    """The time budget on a stream: state is what a company has spent and what came too late.

    sources: row_index, position, elapsed_ms.  A late source updates the company's timeout row.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        spent, remaining, first_late = state.get if state.exists else (0, 0, -1)
        rows, late = [], remaining
        for batch in batches:
            for position, elapsed in batch.sort_values("position")[["position", "elapsed_ms"]].itertuples(index=False):
                if spent < budget_ms:
                    rows.append((key[0], position, "done", 0))
                else:
                    remaining, first_late = remaining + 1, position if first_late < 0 else first_late
                spent += int(elapsed)
        if remaining > late:
            rows.append((key[0], first_late, "timeout", remaining))
        state.update((spent, remaining, first_late))
        yield pd.DataFrame(rows, columns=["row_index", "position", "status", "remaining"])

    return sources.groupBy("row_index").applyInPandasWithState(step, BUDGET_OUT, BUDGET_STATE, "append", "NoTimeout")
