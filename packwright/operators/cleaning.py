"""Boilerplate: lines repeated over a company's pages, and page text without them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packwright.functions.facts import is_fact_line
from packwright.functions.text import bound, cut, one_spaced, replaced

# ---- Fixed values of the contract ----
CHROME_SHARE, CHROME_FROM, CHROME_LENGTH = 0.45, 2, 180
PAGE_CHARS = 60_000
LINE_PREFIX = r"(?i)^(company|domain|page path|final url):"
MENU_LINE = r"(?i)^(skip to content|menu|close|open menu|shopping cart|your cart|forgot your password|log in|register now|reset your password)\z"
FOOTER_PREFIX = r"(?i)^(quick links|follow us|follow our socials|all rights reserved|copyright|©|developed by|powered by)"
BARE_LINK = r"(?i)^\[[^\]]{1,45}\]\(https?://[^)]+\)\z"
# --------------------------------------


def normalize_line(line: Column) -> Column:
    """Mail and phone links become their target, white space single spaces."""
    return one_spaced(replaced(line, (r"(?i)\[[^\]]*\]\((mailto:|tel:)([^)]+)\)", "$2")))


def lines_of(body: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(body, F.lit("")), r"\r?\n"), normalize_line), lambda x: x != "")


def repeated_lines(pages: DataFrame, share: float = CHROME_SHARE, least: int = CHROME_FROM) -> DataFrame:
    """company, line, n_pages of lines that stand on at least ``share`` of a company's pages.

    pages: company, body.  Lines are counted once a page, so the count is a plain sum with partial
    aggregation; a company with very many pages does not meet in one task.
    """
    keys = F.array_distinct(F.transform(F.filter(lines_of(F.col("body")), lambda x: (F.length(x) <= CHROME_LENGTH) & ~is_fact_line(x)), F.lower))
    counts = pages.select("company", F.explode(keys).alias("line")).groupBy("company", "line").agg(F.count("*").alias("n_pages"))
    totals = pages.groupBy("company").agg(F.count("*").alias("pages"))
    needed = F.greatest(F.lit(least), F.ceil(F.col("pages") * share))
    return counts.where(F.col("n_pages") >= least).join(totals, "company").where(F.col("n_pages") >= needed).select("company", "line", "n_pages")


def kept_lines(lines: Column, chrome: Column) -> Column:
    """Lines that are no boilerplate; of equal lines the first stays, lines with facts always do.

    Lines and chrome are sorted together by text, so equal ones are neighbours: a line whose neighbour
    before it is equal is chrome or no first occurrence.  Then the lines go back to their places.
    """
    plain = F.filter(lines, lambda x: ~(x.rlike(LINE_PREFIX) | (x.rlike(r"^#\s+") & (F.length(x) < 4)) | x.rlike(MENU_LINE) | x.rlike(FOOTER_PREFIX) | (x.rlike(BARE_LINK) & ~is_fact_line(x))))
    entry = lambda key, place, line: F.struct(key.alias("key"), place.alias("place"), line.alias("line"))
    both = F.concat(F.transform(plain, lambda x, i: entry(F.lower(x), i, x)), F.transform(chrome, lambda c: entry(c, F.lit(-1), c)))
    stays = lambda e, i, every: (e["place"] >= 0) & ((i == 0) | (F.get(every, i - 1)["key"] != e["key"]) | is_fact_line(e["line"]))
    kept = bound(F.array_sort(both), lambda every: F.filter(every, lambda e, i: stays(e, i, every)))
    return F.transform(F.array_sort(F.transform(kept, lambda e: F.struct(e["place"].alias("place"), e["line"].alias("line")))), lambda e: e["line"])


def clean_pages(pages: DataFrame, share: float = CHROME_SHARE, least: int = CHROME_FROM, size: int | None = PAGE_CHARS) -> DataFrame:
    """pages with clean_text and clean_chars; only the small sets of repeated lines are joined."""
    chrome = repeated_lines(pages, share, least).groupBy("company").agg(F.collect_list("line").alias("chrome"))
    joined = pages.join(chrome, "company", "left")
    # no line is blank or has spaces at its ends, so there is nothing to clip but the length
    text = cut(F.array_join(kept_lines(lines_of(F.col("body")), F.coalesce("chrome", F.array().cast("array<string>"))), "\n"), size)
    return joined.withColumn("clean_text", text).withColumn("clean_chars", F.length("clean_text").cast("long")).drop("chrome")
