"""Every registered query of the library against its SQL, on the smallest tables."""

import duckdb
import pytest

from packwright.plans import customer_records, document_queries, evidence_queries, page_queries, record_queries, run_queries  # noqa: F401
from packwright.plans.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(map(tuple, frame[columns].astype(str).values))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    got = rows(QUERIES[name](spark, SF).toPandas())
    assert got == rows(duck.execute(SQL[name]).df()) and got[1]


def test_frontier_of_a_worked_example(spark):
    assert sorted(set(QUERIES) - set(SQL)) == ["h8_links_by_standard"]
    from packwright.operators.source import frontier

    seeds = spark.createDataFrame([(1, 0, "https://a.test/"), (1, 1, "https://www.a.test/contact/"), (2, 0, "https://b.test")], "row_index long, position int, url string")
    links = ["https://a.test/contact", "https://a.test/team", "https://a.test/x.png", "https://other.test/", "https://a.test/about#x", "https://a.test/zzz", "https://a.test/about"]
    found = spark.createDataFrame([(1, "homepage", "a.test", "https://a.test", "https://a.test/", links), (2, "contact", "b.test", "", "https://b.test/", ["https://b.test/team"])], "row_index long, family string, domain string, website_url string, page_url string, links array<string>")
    got = {(r["row_index"], r["phase"], r["url"]) for r in frontier(seeds, found, 2).collect()}
    assert got == {(1, 0, "https://a.test/"), (1, 0, "https://www.a.test/contact/"), (2, 0, "https://b.test"), (1, 1, "https://a.test/about"), (1, 1, "https://a.test/team")}


def test_links_equal_the_parser_alone(spark):
    """The query without SQL against the standard's parser on each link: the usual forms give the same."""
    from packwright.functions.urls import joined_url

    base = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = QUERIES["h8_links_by_standard"](spark, SF).collect()
    assert len(rows) > 1000 and [r for r in rows if r["full"] != joined_url(r["link"], base[r["page_id"]])] == []
