"""Streams against the same work on all rows at once."""

from pyspark.sql import functions as F

from packwright.operators import cleaning, enrichment
from packwright.operators.source import within_time
from packwright.streaming.progress import append_once, committed_rows, hourly_progress, latest_results, page_stream, remaining_cases, start_append, start_results, start_snapshots, stream_within_time

SCHEMA = "company string, pos long, body string"


def test_company_split_over_batches_equals_one_batch(spark, tmp_path):
    rows = [(c, i, f"Shared line of {c}\nOwn line {i}\nShared line of {c}") for c in ("a", "b", "c") for i in range(6)]
    for n, part in enumerate((rows[:4], rows[4:9], rows[9:], [("a", 99, "Shared line of a\nlate page")])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    spark.conf.set("spark.sql.streaming.schemaInference", "false")
    pages = page_stream(spark, f"{tmp_path}/in/*", SCHEMA, 1)
    clean = lambda df: cleaning.clean_pages(df).select("company", "pos", "clean_text")
    query = start_results(pages, clean, f"{tmp_path}/out", f"{tmp_path}/check")
    query.awaitTermination()
    batches = {r["batch"]: r["n"] for r in spark.read.parquet(f"{tmp_path}/out/results").groupBy("batch").agg(F.count("*").alias("n")).collect()}
    assert len(batches) == 4 and batches[3] == 7  # a batch works on its own companies' pages alone
    every = spark.createDataFrame([*rows, ("a", 99, "Shared line of a\nlate page")], SCHEMA)
    key = lambda df: sorted(map(tuple, df.select("company", "pos", "clean_text").collect()))
    assert key(latest_results(spark, f"{tmp_path}/out")) == key(clean(every))


def test_resume_leaves_what_is_done(spark, tmp_path):
    cases = spark.createDataFrame([(1,), (2,), (3,)], "case_id int")
    spark.createDataFrame([(2, "x"), (2, "y")], "case_id int, raw string").write.parquet(f"{tmp_path}/done")
    assert sorted(r[0] for r in remaining_cases(spark, cases, spark.read.parquet(f"{tmp_path}/done")).collect()) == [1, 3]
    both = enrichment.with_cache(spark.createDataFrame([(1, "c")], "case_id int, raw string"), spark.createDataFrame([(1, "f"), (2, "f")], "case_id int, raw string"))
    assert sorted(map(tuple, both.collect())) == [(1, "c"), (2, "f")]


def test_time_budget_of_a_stream_equals_the_batch(spark, tmp_path):
    rows = [(k, i, f"u{i}", 40 + k) for k in (1, 2) for i in range(8)]
    spark.createDataFrame(rows, "row_index long, position long, url string, elapsed_ms long").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = stream_within_time(spark.readStream.schema("row_index long, position long, url string, elapsed_ms long").parquet(f"{tmp_path}/in"), 200)
    stream.writeStream.format("memory").queryName("budget").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/check").start().awaitTermination()
    want = within_time(spark.createDataFrame(rows, "row_index long, position long, url string, elapsed_ms long"), 200).select("row_index", "position", "status", F.col("remaining"))
    assert sorted(map(tuple, spark.table("budget").collect())) == sorted(map(tuple, want.collect()))


def test_a_run_stopped_between_sink_and_ledger_loses_and_repeats_nothing(spark, tmp_path, monkeypatch):
    from packwright.streaming import progress

    for n in range(4):
        spark.createDataFrame([(10 * n + i, f"r{i}") for i in range(5)], "case_id long, raw string").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    rows = lambda: page_stream(spark, f"{tmp_path}/in/*", "case_id long, raw string", 1)
    whole, calls = progress.write_whole, []

    def stops(uri, parts):
        calls.append(uri)
        if len(calls) == 3:
            raise RuntimeError("stopped")
        return whole(uri, parts)

    monkeypatch.setattr(progress, "write_whole", stops)
    out, schema = f"file://{tmp_path}/out", "case_id long, raw string"
    assert committed_rows(spark, out, schema).count() == 0
    try:
        start_append(rows(), out, f"{tmp_path}/check").awaitTermination()
    except Exception as e:  # noqa: BLE001
        assert "stopped" in str(e)
    assert committed_rows(spark, out, schema).count() == 10
    start_append(rows(), out, f"{tmp_path}/check").awaitTermination()
    got = [r["case_id"] for r in committed_rows(spark, out, schema).collect()]
    assert sorted(got) == [10 * n + i for n in range(4) for i in range(5)]
    assert spark.read.schema(schema).option("recursiveFileLookup", True).json(f"{out}/rows").count() == 25  # the stopped batch's first files lie there, unread
    assert not append_once(spark.createDataFrame([(1, "again")], schema), out, 0)


def test_snapshots_grow(spark, tmp_path):
    for n in range(6):
        spark.createDataFrame([("error" if i % 4 == 0 else "view",) for i in range(10)], "event_type string").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    out = f"file://{tmp_path}/out"
    start_snapshots(page_stream(spark, f"{tmp_path}/in/*", "event_type string", 1), 25, out, f"{tmp_path}/check").awaitTermination()
    kept = spark.read.schema("completed long, successful long, failed long, snapshot int").json(f"{out}/snapshot=*").collect()
    assert sorted(tuple(r)[:3] for r in kept) == [(10, 7, 3), (30, 21, 9), (50, 35, 15), (60, 42, 18)]


def test_hours_of_a_stream_equal_the_batch(spark, tmp_path):
    rows = spark.range(400).select(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60).alias("ts"), F.when(F.col("id") % 5 == 0, "error").otherwise("view").alias("event_type"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = hourly_progress(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), "10 minutes")
    stream.writeStream.format("memory").queryName("hours").outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/check").start().awaitTermination()
    assert sorted(map(tuple, spark.table("hours").collect())) == sorted(map(tuple, hourly_progress(rows).collect()))


def test_large_pages_are_handed_on_in_small_parts():
    from packwright.streaming.progress import few

    pages = [(i, "x" * 1_000_000, None) for i in range(7)] + [(i, "", None) for i in range(2500)]
    parts = list(few(iter(pages)))
    assert [p for part in parts for p in part] == pages
    assert max(sum(len(p[1]) for p in part) for part in parts) <= 3_000_000 and max(map(len, parts)) <= 1000
