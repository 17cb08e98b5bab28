"""The page view that the company operators work on, made from raw pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packwright.functions.html import html_to_markdown
from packwright.functions.text import host_of, page_name_of, page_path_of, text_hash
from packwright.operators.packets import source_bucket


FAMILIES = ("nav_link", "homepage", "third_party_profile", "first_party_about", "directory")


def site_pages(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) as fetched pages of companies, a company being a host.

    The table has neither statuses nor families, so page ids stand for them: some pages failed, some were
    not found, and families go round.  Texts are whole, however long.
    """
    number = F.col("pos")
    family = F.element_at(F.array(*[F.lit(f) for f in FAMILIES]), (number % len(FAMILIES) + 1).cast("int"))
    url, html = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    parsed = pages.select(F.col("page_id").cast("long").alias("pos"), url.alias("final_url"), html_to_markdown(html, url, None).alias("parsed"))
    return parsed.select(
        host_of(F.col("final_url")).alias("company"),
        "pos",
        "final_url",
        page_path_of(F.col("final_url")).alias("page_path"),
        page_name_of(F.col("final_url")).alias("page_name"),
        F.when(number % 17 == 5, "failed").otherwise("ok").alias("fetch_status"),
        F.when(number % 19 == 3, 404).otherwise(200).alias("http_status"),
        family.alias("source_family"),
        source_bucket(F.lit(""), family).alias("source_bucket"),
        F.col("parsed.title").alias("title"),
        F.col("parsed.markdown").alias("body"),
        F.length("parsed.markdown").cast("long").alias("raw_chars"),
        F.lit("").alias("markdown_file"),
        text_hash(F.col("parsed.markdown")).alias("content_hash"),
    )
