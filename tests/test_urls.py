"""Links by the standard: its own examples and cases of each part."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from packwright.functions.urls import joined_url, resolved_urls

BASE = "https://user@host.test:8443/a/b/c?q=1#f"
CASES = {
    "": "https://user@host.test:8443/a/b/c?q=1", "#x y": "https://user@host.test:8443/a/b/c?q=1#x%20y", "?z='\"": "https://user@host.test:8443/a/b/c?z=%27%22", "d": "https://user@host.test:8443/a/b/d", "../d": "https://user@host.test:8443/a/d",
    "../../../d": "https://user@host.test:8443/d", ".": "https://user@host.test:8443/a/b/", "..": "https://user@host.test:8443/a/", "%2e%2E/x": "https://user@host.test:8443/a/x", "\\d\\e": "https://user@host.test:8443/d/e", "/d e": "https://user@host.test:8443/d%20e",
    "//X.test": "https://x.test/", "\\\\x.test/p": "https://x.test/p", "http:/x.test": "http://x.test/", "https:d": "https://user@host.test:8443/a/b/d", "https:/d": "https://user@host.test:8443/d", "https:////x.test": "https://x.test/", "HTTP://X.test:80/": "http://x.test/",
    "http://x.test:8080": "http://x.test:8080/", "http://x.test:99999/": "", "http://x.test:a/": "", "http://": "", "http://a b/": "", "http://a%62.test/": "http://ab.test/", "http://1.2.3/": "http://1.2.0.3/", "http://0x7f.1/": "http://127.0.0.1/", "http://256.1.1.1/": "",
    "http://[::1]/x": "http://[::1]/x", "http://[::1/x": "", "http://u:p:w@x.test/": "http://u:p%3Aw@x.test/", "http://u@v@x.test/": "http://u%40v@x.test/", "http://bücher.test/ü?ü#ü": "http://xn--bcher-kva.test/%C3%BC?%C3%BC#%C3%BC", " \t\n/x\ny ": "https://user@host.test:8443/xy",
    "mailto:a@b.test": "mailto:a@b.test", "tel:+1 2": "tel:+1 2", "data:text/plain,é": "data:text/plain,%C3%A9", "/a{b}^`|": "https://user@host.test:8443/a%7Bb%7D%5E%60|", "a:b": "a:b", "1:b": "https://user@host.test:8443/a/b/1:b", "/./..//x": "https://user@host.test:8443//x",
}


@pytest.mark.parametrize("link", CASES)
def test_cases(link):
    assert joined_url(link, BASE) == CASES[link]


def test_no_page():
    assert joined_url("/x", "nothing") == "" and joined_url("http://x.test", "nothing") == "" and joined_url("/x", "mailto:a") == ""


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab/.\\:?#%@2eE é[]{}'\"<>`^|0x1\t", max_size=16))
def test_absolute_forms_are_stable(link):
    once = joined_url(link, BASE)
    assert once == "" or not once.startswith("http") or joined_url(once, BASE) == once


def test_array_equals_the_parser(spark):
    links = [*CASES, "/usual/path", "https://a.test/x;y=1,2", "/für/ü", "/a/../b", "/a/b.", "/..a/...", "/a:b@c", "https://1a.test/", "https://a.test", "/" + "ü" * 50]
    bases = [BASE, "https://www.site.test/p/q", "http://site.test", "nothing", "", None, "https://1.2.3.4/x"]
    rows = spark.createDataFrame([(i, b, links) for i, b in enumerate(bases)] + [(99, BASE, []), (98, BASE, None)], "i int, base string, links array<string>")
    got = {r["i"]: r["full"] for r in rows.select("i", resolved_urls(F.col("links"), F.col("base")).alias("full")).collect()}
    for i, b in enumerate(bases):
        assert dict(zip(links, got[i])) == {x: joined_url(x, b or "https://example.com") for x in links}
    assert not got[99] and not got[98]
