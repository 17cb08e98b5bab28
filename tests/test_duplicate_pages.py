"""The choice among copies of a page against a plain ordered fold."""

import random
from contextlib import redirect_stdout
from io import StringIO

import pytest
from pyspark.sql import functions as F

from packwright.operators.ordered import Successors, last_of_fold, sums_before
from packwright.operators.packets import NEAR_SCORE, duplicate_pages
from packwright.operators.source import within_time


def test_choice_equals_plain_fold_and_gathers_no_array(spark):
    rnd, rows = random.Random(6), []
    for pos in range(900):
        url = "https://a.test/hot" if pos % 3 == 0 else f"https://a.test/p{rnd.randrange(150)}"
        rows.append(("a.test", pos, rnd.choice([None, *range(12)]), rnd.choice([None, *range(9)]), url, url[14:], f"h{rnd.randrange(4)}", ""))
    scored = spark.createDataFrame(rows, "company string, pos long, score long, clean_chars long, final_url string, page_path string, content_hash string, markdown_file string").repartition(5)
    best, n = {}, {}
    for _, _, score, chars, url, _, content, _ in rows:
        n[url] = n.get(url, 0) + 1
        old = best.get(url)
        if old is None:
            best[url] = (score, chars, content)
        elif None not in (score, old[0]) and (score > old[0] or (None not in (chars, old[1]) and chars > old[1] and score >= old[0] - NEAR_SCORE)):
            best[url] = (score, chars, content)
    want = {(r[1], n[r[4]] == 1 or best[r[4]][2] == r[6]) for r in rows}
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = duplicate_pages(scored)
        assert {(r["pos"], r["selected"]) for r in got.collect()} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    with redirect_stdout(StringIO()) as plan:
        got.explain(True)
    assert "collect_list" not in plan.getvalue()


def fold(candidates, near):
    rule, state = Successors(near), None
    for c in candidates:
        if state is None or rule.replaces(c, state):
            state = c
    return state


@pytest.mark.parametrize("seed", range(40))
def test_stretches_compose_to_the_whole_fold(seed):
    """The fold over stretches, each reduced to its entries, is the fold over all."""
    rnd = random.Random(seed)
    rows = [(rnd.choice([None, *range(seed % 7 + 3)]) if rnd.random() < 0.2 else rnd.randrange(40), rnd.choice([None, 3]) if rnd.random() < 0.1 else rnd.randrange(60), f"p{i}") for i in range(120)]
    state, at = None, 0
    while at < len(rows):
        end = at + rnd.randrange(1, 30)
        part = Successors(5)
        for r in rows[at:end]:
            part.add(r)
        assert len(part.entries) <= part.count
        ends = part.ends()
        if state is None:
            state = ends[0]
        else:
            state = next((e for c, e in zip(part.entries, ends) if part.replaces(c, state)), state)
        at = end
    assert state == fold(rows, 5)


def test_one_key_with_a_third_of_all_rows_is_no_task_alone(spark):
    rnd = random.Random(3)
    rows = [("a" if i % 3 == 0 else f"c{i % 40}", "hot" if i % 3 == 0 else f"k{i % 7}", i, rnd.randrange(30), rnd.randrange(50), f"p{i}") for i in range(9000)]
    want = {}
    for g, k, _, s, c, w in rows:
        want.setdefault((g, k), []).append((s, c, w))
    want = {key: fold(own, 5)[2] for key, own in want.items() if len(own) > 1}
    frame = spark.createDataFrame(rows, "g string, k string, pos long, s long, c long, w string").repartition(6)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", 24)
    try:
        got = {(r["g"], r["k"]): r["what"] for r in last_of_fold(frame, "g", "k", ["pos"], "s", "c", "w", 5).collect()}
        by_range = frame.repartitionByRange("g", "k", "pos").groupBy(F.spark_partition_id()).count().collect()
        sums = sums_before(frame.withColumn("v", F.col("pos") % 11), "g", "pos", "v").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert got == want
    assert max(r["count"] for r in by_range) < 1000  # of the 3000 rows of the hot key
    running = {}
    for r in sorted(sums, key=lambda r: r["pos"]):
        assert r["before"] == running.get(r["g"], 0)
        running[r["g"]] = r["before"] + r["v"]
    assert len(sums) == len(rows)


def test_time_budget_of_one_large_company(spark):
    rows = [(1, i, f"u{i}", 3) for i in range(4000)] + [(None, 5, "x", None), (2, 1, "y", 500), (2, 2, "z", 1)]
    got = {(r["row_index"], r["status"]): r for r in within_time(spark.createDataFrame(rows, "row_index long, position long, url string, elapsed_ms long").repartition(5), 300).where("status = 'timeout' OR row_index IS NULL").collect()}
    assert got[1, "timeout"]["remaining"] == 3900 and got[1, "timeout"]["position"] == 100
    assert got[2, "timeout"]["remaining"] == 1 and (None, "done") in got
