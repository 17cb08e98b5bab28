"""Weighted URL vocabulary: strict and soft terms, counted by one Aho-Corasick pass with boundary checks.

Host rules decide first (the longest fitting rule wins, looked up by the host and its parents); every
other URL gets the vocabulary's verdict.  Terms are looked for in the URL with its percent escapes
decoded and in lower case, and count where no ASCII letter or digit touches them.  Each distinct term adds
its own weight once; a URL with a strict term, or whose weights reach ``reject_at``, is blocked, so
several distinct soft terms block it.  Terms and weights are a parameter; ``vocabulary_of`` reads them
from a table, which is collected after its size is checked, as each task holds all of it.

Defined cases: a null URL or one without ``://`` has empty host and path, and its terms still
count; an empty URL is allowed; escapes that are no UTF-8 read as U+FFFD; a very long URL is read whole; repeated rows give repeated rows; an empty table gives no rows;
other columns of the table are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textscan import map_columns

#: Default terms: strict ones, and soft ones by what each adds.
STRICT = (
    "camgirls", "casino", "casinos", "cialis", "crackz", "escort", "escorts", "hentai", "keygen", "keygens", "malware", "milf", "onlinecasino", "phishing", "porn", "porno", "pornhub", "porns", "pornstar", "ransomware", "sexcam", "sexcams", "sextube",
    "spyware", "viagra", "warez", "webcamsex", "xanax", "xxx", "youporn",
)
SOFT = {
    1.0: ("adult", "betting", "blackjack", "erotic", "escorting", "gambling", "jackpot", "lottery", "naked", "nude", "nudes", "payday", "pills", "poker", "roulette", "sex", "sexy", "slots", "sportsbook", "torrent", "torrents"),
    0.7: ("bet", "bets", "bonus", "cheap", "coupon", "coupons", "crack", "cracked", "dating", "discount", "download", "farm", "forex", "free", "loan", "loans", "pharmacy", "pill", "promo", "replica", "spam", "win", "winner"),
}
_FOLD = {upper: upper + 32 for upper in range(65, 91)}
_ALNUM = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
SCHEMA = "page_id long, host string, path string, rule string, verdict string, n_strict int, n_soft int, weight double"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: str, path: str) -> bool:
        return (host == self.host or host.endswith("." + self.host)) and path.startswith(self.path)


@dataclass(frozen=True)
class Vocabulary:
    """strict: terms of which one blocks; soft: weight of each other term."""

    strict: tuple[str, ...] = STRICT
    soft: dict[str, float] = field(default_factory=lambda: {term: weight for weight, terms in SOFT.items() for term in terms})
    reject_at: float = 2.0

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for term, weight in self.soft.items():
            found.add_word(term.translate(_FOLD), (term.translate(_FOLD), weight, False))
        for term in self.strict:
            found.add_word(term.translate(_FOLD), (term.translate(_FOLD), self.reject_at, True))
        if len(found):
            found.make_automaton()
        return found


def vocabulary_of(terms: DataFrame, reject_at: float = 2.0, most_terms: int = 1 << 20) -> Vocabulary:
    """The vocabulary of a table terms(term, weight, strict); blank terms are left out, of repeated ones the largest weight counts."""
    rows = terms.where("term IS NOT NULL AND trim(term) <> ''").groupBy("term").agg(F.max(F.coalesce("weight", F.lit(0.0)).cast("double")).alias("weight"), F.max(F.coalesce("strict", F.lit(False))).alias("strict"))
    found = rows.limit(most_terms + 1).collect()
    if len(found) > most_terms:
        raise ValueError(f"a vocabulary of over {most_terms} terms does not fit into a task")
    return Vocabulary(tuple(r["term"] for r in found if r["strict"]), {r["term"]: r["weight"] for r in found if not r["strict"]}, reject_at)


class RuleIndex:
    """Rules by host; a URL looks up its host and each parent of it."""

    def __init__(self, rules: Iterable[Rule]):
        self.by_host: dict[str, list[Rule]] = {}
        for rule in rules:
            self.by_host.setdefault(rule.host, []).append(rule)

    def find(self, host: str, path: str) -> Rule | None:
        """The longest rule that fits; of equally long ones the first by text."""
        best, at = None, 0
        while at >= 0:
            for rule in self.by_host.get(host[at:], ()):
                if path.startswith(rule.path) and (best is None or (-len(rule.text), rule.text) < (-len(best.text), best.text)):
                    best = rule
            at = host.find(".", at) + 1 or -1
        return best


DEFAULT_RULES = (Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"))


def host_and_path(url: str | None) -> tuple[str, str]:
    _, separator, rest = (url or "").partition("://")
    if not separator:
        return "", ""
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    return host.translate(_FOLD), path


def distinct_terms(automaton, url: str | None) -> dict[str, tuple[float, bool]]:
    """Distinct terms that stand alone in the URL, with weight and strictness."""
    url = unquote(url or "", errors="replace").translate(_FOLD)
    hits: dict[str, tuple[float, bool]] = {}
    if not len(automaton):
        return hits
    for last, (term, weight, strict) in automaton.iter(url):
        before, after = last - len(term), last + 1
        if (before < 0 or url[before] not in _ALNUM) and (after == len(url) or url[after] not in _ALNUM):
            hits[term] = (weight, strict)
    return hits


def judge_urls(pages: DataFrame, rules: Iterable[Rule] = DEFAULT_RULES, vocabulary: Vocabulary = Vocabulary()) -> DataFrame:
    """page_id, host, path, rule, verdict, n_strict, n_soft, weight of every row; one map over the url column."""
    index = RuleIndex(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = vocabulary.automaton()
        for batch in batches:
            rows = []
            for url in batch.column(1).to_pylist():
                host, path = host_and_path(url)
                rule = index.find(host, path)
                hits = distinct_terms(automaton, url).values()
                strict = sum(is_strict for _, is_strict in hits)
                weight = float(sum(w for w, _ in hits))
                own = "block" if strict or weight >= vocabulary.reject_at - 1e-9 else "allow"
                rows.append((host, path, rule and rule.text, rule.verdict if rule else own, strict, len(hits) - strict, weight))
            types = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64())
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *columns], ["page_id", "host", "path", "rule", "verdict", "n_strict", "n_soft", "weight"])

    return map_columns(pages, ["page_id", "url"], run, SCHEMA)
