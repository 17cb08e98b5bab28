"""Row numbers and CSV by ranges against plain loops."""

import csv
import io
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from packwright.operators.source import with_row_index
from packwright.sources import csv_ranges, tables

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("adaptive", ["true", "false"])
@pytest.mark.parametrize("parts", [1, 8, 64])
def test_wide_rows_keep_their_numbers(spark, adaptive, parts):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = with_row_index(orders, "o_orderkey").orderBy("o_orderkey").toPandas()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert got["row_index"].tolist() == list(range(orders.count()))
    assert got.drop(columns="row_index").equals(orders.orderBy("o_orderkey").toPandas())


def test_rows_of_equal_order_and_odd_names(spark):
    rows = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("a.b"), F.col("id").alias("row_index"), F.create_map(F.lit("k"), "id").alias("m"))
    got = with_row_index(rows, F.col("`a.b`"))
    assert got.columns == ["a.b", "m", "row_index"]
    found = got.orderBy("row_index").collect()
    assert [r["row_index"] for r in found] == list(range(9000)) and [r[0] for r in found] == sorted(r[0] for r in found)
    assert with_row_index(rows.limit(0), F.col("`a.b`")).count() == 0


def plain_records(data: bytes) -> list[list[bytes]]:
    """A loop over bytes."""
    out, record, value, state, any_ = [], [], b"", "start", False
    for c in (data[i : i + 1] for i in range(len(data))):
        if state == "quoted":
            state, value = ("closing", value) if c == b'"' else ("quoted", value + c)
        elif state == "closing" and c == b'"':
            state, value = "quoted", value + c
        elif state == "start" and c == b'"':
            state, any_ = "quoted", True
        elif c == b",":
            record, value, state, any_ = [*record, value], b"", "start", True
        elif c == b"\n":
            if any_ or value not in (b"", b"\r"):
                out.append([*record, value.removesuffix(b"\r")])
            record, value, state, any_ = [], b"", "start", False
        else:
            state, value = "plain", value + c
    if any_ or value not in (b"", b"\r"):
        out.append([*record, value])
    return out


def by_ranges(path: str, size: int) -> list[tuple[int, list[bytes]]]:
    """What the tasks do, one range after the other, with states composed by a loop."""
    file, inside, number, out = csv_ranges.Lines(path), False, 0, []
    for start in range(0, max(1, file.size), size):
        where, data = file.segment(start, start + size)
        both = {s: csv_ranges.scanned(data, s) for s in (False, True)}
        at = csv_ranges.record_start(data, inside)[0]
        own = [csv_ranges.values(r) for r in csv_ranges.records(file, data, at, where + len(data))]
        assert len(own) == both[inside][1]
        out += [(number + i, r) for i, r in enumerate(own)]
        inside, number = both[inside][0], number + both[inside][1]
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([b"a", b",", b'"', b'""', b"\n", b"\r\n", b'"x\ny",', b"bc", b'\n"', b'",', b"\xc3\xa9"]), max_size=40).map(b"".join), st.integers(1, 30))
def test_ranges_equal_a_loop(tmp_path_factory, data, size):
    path = f"{tmp_path_factory.getbasetemp()}/x.csv"
    with open(path, "wb") as f:
        f.write(data)
    want = plain_records(data)
    assert by_ranges(path, size) == list(enumerate(want))


def test_one_file_by_many_tasks(spark, tmp_path):
    """Documents in one file of quoted texts with line ends and quotes."""
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    docs += [(-1, 'a "quoted"\r\nvalue, "" and\n\n\nmore ' * 9000, ""), (-2, "", ""), (-3, '"', ",")]
    path = f"{tmp_path}/one.csv"
    with open(path, "w", newline="", encoding="utf-8-sig") as f:
        csv.writer(f).writerows([("doc_id", "text", "lang"), *docs])
    got = tables.read_csv(spark, f"file://{path}", 1 << 15)
    assert got.rdd.getNumPartitions() >= os.path.getsize(path) // (1 << 15)
    assert [(int(r["doc_id"]), r["text"], r["lang"]) for r in got.orderBy("row_index").collect()] == [(a, b or "", c or "") for a, b, c in docs]
    assert [r["row_index"] for r in got.select("row_index").orderBy("row_index").collect()] == list(range(len(docs)))


def test_small_ranges_share_tasks(spark, tmp_path):
    """Thousands of ranges far smaller than a task's share do not make thousands of tasks."""
    rows = [(i, f'"{i}"\n,') for i in range(4000)]
    with open(f"{tmp_path}/many.csv", "w", newline="") as f:
        csv.writer(f).writerows([("a", "b"), *rows])
    got = tables.read_csv(spark, f"file://{tmp_path}/many.csv", 16)
    assert got.rdd.getNumPartitions() <= 2 * csv_ranges.LEAST_TASKS < os.path.getsize(f"{tmp_path}/many.csv") // 16
    assert [(int(r["a"]), r["b"]) for r in got.orderBy("row_index").collect()] == rows


def test_several_files_and_ragged_rows(spark, tmp_path):
    for i in range(3):
        with open(f"{tmp_path}/{i}.csv", "w", newline="") as f:
            f.write('a,b,,a\n\n"1\n",x\ny,2,3,4,5,6\n \n' + ('"open' if i == 2 else ""))
    want = [["1\n", "x", "", ""], ["y", "2", "3", "4"], [" ", "", "", ""]] * 3 + [["open", "", "", ""]]
    got = tables.read_csv(spark, f"file://{tmp_path}", 3)
    assert got.columns == ["a", "b", "_c2", "a3", "row_index"]
    assert [list(r[:4]) for r in got.orderBy("row_index").collect()] == want


def test_written_values_come_back(spark, tmp_path):
    texts = ['"', '""', ",", "\n", "\r", "\r\n", " ", "", None, "é\u2028x", 'a"b', "x,\r\n\"y\""]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(2)
    tables.write_csv(rows, f"file://{tmp_path}/out")
    got = {int(r["i"]): r["t"] for r in tables.read_csv(spark, f"file://{tmp_path}/out", 4).collect()}
    assert got == {i: t or "" for i, t in enumerate(texts)}
    assert list(csv.reader(io.StringIO("a\n"))) == [["a"]]
