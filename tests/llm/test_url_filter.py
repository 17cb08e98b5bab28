import random
import re
from urllib.parse import unquote_to_bytes

import pytest

from packwright.llm.url_filter import DEFAULT_RULES, Rule, RuleIndex, Vocabulary, host_and_path, judge_urls, vocabulary_of

CASES = [
    ("http://A.Example.COM/x?q#f", "a.example.com", "/x", "com/", "allow"),
    ("https://www.example.com/en/1", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
    ("https://m.example.com/en/1", "m.example.com", "/en/1", "example.com/en/", "block"),
    ("https://example.net/es/1", "example.net", "/es/1", "net/es/", "block"),
    ("https://example.com", "example.com", "", None, "allow"),
    ("http://x.org/casino", "x.org", "/casino", None, "block"),
    ("http://x.org/casinos-royal", "x.org", "/casinos-royal", None, "block"),
    ("http://x.org/occasino", "x.org", "/occasino", None, "allow"),
    ("http://x.org/casino1", "x.org", "/casino1", None, "allow"),
    ("http://x.org/free", "x.org", "/free", None, "allow"),
    ("http://x.org/free/free", "x.org", "/free/free", None, "allow"),
    ("http://FREE-bets.org/", "free-bets.org", "/", None, "allow"),
    ("http://FREE-bets.org/poker", "free-bets.org", "/poker", None, "block"),
    ("http://x.org/%63asino%2Dx", "x.org", "/%63asino%2Dx", None, "block"),
    ("http://netcom/", "netcom", "/", None, "allow"),
    ("no scheme free bets poker", "", "", None, "block"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("ftp://h?x://y/z", "h", "", None, "allow"),
]


def test_verdicts(spark):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, (u, *_) in enumerate(CASES)], "page_id long, url string, host string, verdict string")
    got = judge_urls(pages).orderBy("page_id").collect()
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in got] == [tuple(c[1:]) for c in CASES]
    assert judge_urls(pages.limit(0)).count() == 0


def test_long_url_and_empty_vocabulary(spark):
    pages = spark.createDataFrame([(1, "http://x.org/" + "a/" * 100_000 + "porn")], "page_id long, url string")
    assert judge_urls(pages).first()["verdict"] == "block"
    assert judge_urls(pages, vocabulary=Vocabulary((), {})).first()["verdict"] == "allow"


@pytest.mark.parametrize(("url", "expected"), [("a://B:80/c/d#e?f", ("b:80", "/c/d")), ("://", ("", "")), ("x://?q", ("", "")), ("x://É.com/", ("É.com", "/"))])
def test_parts(url, expected):
    assert host_and_path(url) == expected


def brute(url, rules, vocabulary):
    """Verdict, rule and counts by trying every rule and every term."""
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fitting = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    rule = min(fitting, key=lambda r: (-len(r.text), r.text)) if fitting else None
    plain = re.sub("[A-Z]", lambda x: x[0].lower(), unquote_to_bytes(url or "").decode(errors="replace"))
    alone = lambda t: re.search(rf"(?<![a-z0-9]){re.escape(t)}(?![a-z0-9])", plain)
    strict, soft = sum(bool(alone(t)) for t in vocabulary.strict), [w for t, w in vocabulary.soft.items() if alone(t)]
    own = "block" if strict or sum(soft) >= vocabulary.reject_at - 1e-9 else "allow"
    return host, path, rule and rule.text, rule.verdict if rule else own, strict, len(soft)


def test_equals_brute_force(spark):
    rnd, vocabulary = random.Random(12), Vocabulary()
    parts = ["casino", "free", "bets", "Poker", "x", "/", "/", "-", ".", "com", "net", "example.com", "en/", "www.", "?q=", "#", "%70oker", "%", "%ff", "é", "win", "sex", "1", "://", "http://", "es/"]
    rules = [*DEFAULT_RULES, Rule("block", "example.com", "/en/x"), Rule("allow", "m.example.com", "/"), Rule("block", "com", "/"), Rule("allow", "", "/es/")]
    urls = ["http://" * (k % 3 > 0) + "".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 9))) for k in range(3000)] + [None, ""]
    for used in (DEFAULT_RULES, rules):
        got = judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), used, vocabulary).orderBy("page_id").collect()
        assert [(r["host"], r["path"], r["rule"], r["verdict"], r["n_strict"], r["n_soft"]) for r in got] == [brute(u, used, vocabulary) for u in urls]


def test_vocabulary_from_a_table(spark):
    terms = spark.createDataFrame([("Bad", 0.5, True), ("so", 1.5, False), ("so", 0.5, None), ("la", 0.5, None), (None, 1.0, True), (" ", 1.0, True)], "term string, weight double, strict boolean")
    own = vocabulary_of(terms)
    pages = spark.createDataFrame(list(enumerate(["a://h/bad", "a://h/so", "a://h/so-la", "a://h/la"])), "page_id long, url string")
    assert [r["verdict"] for r in judge_urls(pages, (), own).orderBy("page_id").collect()] == ["block", "allow", "block", "allow"]
    with pytest.raises(ValueError, match="does not fit"):
        vocabulary_of(terms, most_terms=1)
    assert RuleIndex(()).find("a.b", "/") is None
