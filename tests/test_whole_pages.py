"""Queries over pages keep texts that are longer than the contract's default sizes."""

import duckdb
import pytest
from pyspark.sql import functions as F

from packwright.plans import page_queries
from packwright.plans.registry import QUERIES, SQL

NAMES = ("h3_html_to_markdown", "f18_clean_pages", "ag2_company_quality", "ag4_run_quality", "packet_documents", "clean_source_documents")


@pytest.fixture(scope="module")
def long_pages(spark, tmp_path_factory):
    """Pages of 66,000 and 250,000 characters in lines of their own, and a short one."""
    folder = str(tmp_path_factory.mktemp("long-pages"))
    text = lambda n: F.concat(F.lit("<html><title>Own</title><body>"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("<p>line "), i.cast("string"), F.lit(" tells of saws</p>"))), ""), F.lit("</body></html>"))
    size = F.when(F.col("page_id") == 0, 2_800).when(F.col("page_id") == 1, 13_500).otherwise(20)
    pages = spark.range(3).withColumnRenamed("id", "page_id").select("page_id", F.concat(F.lit("https://a.test/about/"), F.col("page_id").cast("string")).alias("url"), text(size).alias("html"))
    pages.coalesce(1).write.parquet(f"{folder}/pages.parquet")
    return folder


@pytest.mark.parametrize("name", NAMES)
def test_long_pages_stay_whole(spark, long_pages, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{long_pages}/pages.parquet/*.parquet')")
    right = con.sql(SQL[name])
    got = QUERIES[name](spark, long_pages).select(*right.columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, right.fetchall()))


def test_a_page_is_longer_than_the_default(spark, long_pages):
    assert page_queries.f18_clean_pages(spark, long_pages).agg(F.max("clean_chars")).first()[0] > 220_000
