"""Tables whose rows take long each go to all cores, though their file is read by one task."""

import pytest

from packwright.plans import customer_records, evidence_queries, page_queries, record_queries, run_queries  # noqa: F401
from packwright.plans.registry import QUERIES


@pytest.mark.parametrize("name", ["v1_customer_errors", "v5_j10_order_issues", "v6_order_lean_issues"])
def test_rows_are_dealt(spark, name):
    frame = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert frame.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_events_are_dealt(spark):
    frame = QUERIES["v9_schema_violations"](spark, "/root/testdata/sf0.001")
    assert "RoundRobinPartitioning" in frame._jdf.queryExecution().executedPlan().toString()


def test_seeds_are_told_apart_in_their_row(spark):
    from packwright.operators.source import seed_urls

    rows = [(0, "a-b.com", "https://www.a-b.com/"), (1, "", "https://x.org/contact/"), (2, "ab.com", ""), (3, "", ""), (4, None, None)]
    frame = seed_urls(spark.createDataFrame(rows, "row_index long, domain string, website_url string"), ("home", "domain", "contact"))
    got = [tuple(r) for r in frame.select("row_index", "position", "family", "url").orderBy("row_index", "position").collect()]
    assert got == [
        (0, 0, "homepage", "https://www.a-b.com/"), (0, 2, "domain_variant", "https://ab.com/"), (0, 4, "contact", "https://www.a-b.com/contact"), (0, 5, "contact", "https://www.a-b.com/contact-us"),
        (1, 0, "homepage", "https://x.org/contact/"), (1, 2, "contact", "https://x.org/contact-us"), (2, 0, "homepage", "https://ab.com"), (2, 2, "contact", "https://ab.com/contact"), (2, 3, "contact", "https://ab.com/contact-us"),
    ]
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan
