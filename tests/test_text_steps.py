"""Cheaper forms of the text steps against the plain ones."""

import re

from pyspark.sql import functions as F

from packwright.functions import facts, text
from packwright.functions.facts import FACT_LINE
from packwright.functions.html import html_to_markdown

SPACES = "\t\n\x0b\f\r          　﻿"


def hashed(value: str) -> str:
    h, units = 5381, value.encode("utf-16-le")
    for i in range(0, len(units), 2):
        h = ((h * 33) & 0xFFFFFFFF) ^ int.from_bytes(units[i : i + 2], "little")
    return f"{h:x}"


def test_spaces_and_hashes(spark):
    texts = ["", " ", "a", "a b", "  a  b ", "a b", "a   b", "﻿a\n\nb　", "é\x85 x", "𝔸b𝔸", "\U0010ffff", "a\x00b", "​x​", *(f"{s}x{s}y{s}{s}z{s}" for s in SPACES)]
    frame = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    got = frame.select("t", text.trimmed(F.col("t")).alias("trimmed"), text.one_spaced(F.col("t")).alias("spaced"), text.text_hash(F.col("t")).alias("hash")).collect()
    for r in got[:-1]:
        assert r["trimmed"] == r["t"].strip(SPACES + "".join(map(chr, range(0x2000, 0x200B)))), repr(r["t"])
        assert r["spaced"] == re.sub(f"[{SPACES} - ]+", " ", r["t"]).strip(" "), repr(r["t"])
        assert r["hash"] == hashed(r["t"]), repr(r["t"])
    assert tuple(got[-1]) == (None, None, None, None)


def test_a_text_is_scanned_once_for_a_step(spark):
    """Trimming looks at the ends alone, and a line's kinds of facts share their word boundaries."""
    plan = spark.createDataFrame([("x",)], "t string").select(text.trimmed(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and FACT_LINE.count(text.WORD_START) == 1


def test_links_and_headings_at_the_ends(spark):
    pages = ["<h1>A</h1>", "<a href='/x'>X</A>", "x <a href='/y'>Y</a>\n", "</a>", "<H2 id=1>B &amp; c</H2>tail <a href=\"/z\">Z &lt;</a> rest", "no tags & none"]
    frame = spark.createDataFrame([(p,) for p in pages], "h string").select(html_to_markdown(F.col("h"), F.lit("https://s.org/"), None)["markdown"])
    assert [r[0] for r in frame.collect()] == ["# A", "[X](https://s.org/x)", "x [Y](https://s.org/y)", "", "## B & c\ntail [Z <](https://s.org/z) rest", "no tags & none"]


def test_a_text_is_lowered_once_for_all_terms(spark):
    frame = spark.createDataFrame([("Seed FUNDS and Software.  Next",), ("",), (None,)], "t string").select(facts.terms(F.col("t")).alias("x"))
    assert [r[0] for r in frame.collect()] == [["seed", "software"], [], []]
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"transform\(array\(lower\(", plan), plan  # in no lambda over the terms
