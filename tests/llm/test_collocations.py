import random
import re
from collections import Counter

import pytest

from packwright.llm import collocations as c
from packwright.llm.collocations import Phrases, collocations

from .conftest import EDGE_TEXTS


def brute(docs, o=Phrases()):
    """Counts of every n-gram, every cut, and every longer candidate."""
    counts, total = Counter(), Counter()
    for text, lang in docs:
        low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang or "und" if lang is None else lang] += len(words)
            for n in range(1, o.max_n + 1):
                for i in range(len(words) - n + 1):
                    counts[lang if lang is not None else "und", tuple(words[i : i + n])] += 1
    candidates = {k: f for k, f in counts.items() if len(k[1]) > 1 and f >= o.least}
    out = []
    for (lang, p), a in candidates.items():
        cuts = [(o.scale * a // (counts[lang, p[:k]] + counts[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        inside = lambda q, p=p: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        if not any(m == lang and len(q) > len(p) and 100 * f >= o.covered * a and inside(q) for (m, q), f in candidates.items()):
            out.append((lang, " ".join(p), a, counts[lang, p[:k]], counts[lang, p[k:]], total[lang], score))
    ranked = []
    for lang in {r[0] for r in out}:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(lang, i + 1, *r[1:]) for i, r in enumerate(own[: o.top])]
    return sorted(ranked)


def documents(n=260, seed=5):
    draw = random.Random(seed)
    words = "alpha Beta the of é日 delta, run-on x. new york San francisco; Über a".split(" ")
    fixed = ["the of the of", "San Francisco bay area", "alpha beta\tdelta x", "one two three four five"]
    docs = []
    for i in range(n):
        text = " ".join(draw.choice(fixed) if draw.random() < 0.3 else draw.choice(words) for _ in range(draw.randint(0, 40)))
        docs.append((text, draw.choice(["en", "en", "de", None])))
    return docs


@pytest.fixture(scope="module")
def rows(spark):
    docs = documents() + [(t, "en") for _, t in EDGE_TEXTS] + [("same row here", "xx")] * 50 + [(None, None)] * 40
    data = [(t, lang, 1, "x", 2.0) for t, lang in docs]
    return docs, spark.createDataFrame(data, "text string, lang string, phrase int, word string, score double").repartition(3)


PLAIN = Phrases(least=5)
WAYS = {
    "plain": PLAIN,
    "hot pairs in parts": Phrases(least=5, hot_share=0.0, salts=4),
    "some words numbered": Phrases(least=5, vocabulary_bytes=800),
    "no words numbered": Phrases(least=5, vocabulary_bytes=0),
    "pairs": Phrases(least=5, max_n=2),
    "triples, few": Phrases(least=9, max_n=3, top=3, covered=60),
}


@pytest.mark.parametrize("way", WAYS)
def test_equals_plain_version(rows, way):
    docs, frame = rows
    got = sorted(tuple(r) for r in collocations(frame, WAYS[way]).collect())
    assert got == brute(docs, WAYS[way]) and len(got) > 5


def test_words_with_equal_hashes_keep_their_counts(rows, monkeypatch):
    """In this process: a hash that is the same for all words of a length."""
    docs, frame = rows
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(c, "span_hashes", lambda data, start, end, seed=0: (end - start).astype(np.uint64))
    batches = [pa.RecordBatch.from_arrays([pa.array([d[1] for d in docs]), pa.array([d[0] for d in docs])], ["lang", "text"])]
    (names, words), *_ = c.words_of(iter(batches))
    keys = sorted({(names[words.code[i]], words.text(i).decode()) for i in range(len(words))})[::2]
    known = c.Numbered([k[0] for k in keys], [k[1] for k in keys], 0)
    number = {k: i + 1 for i, k in enumerate(keys)}
    assert known.find(names, words).tolist() == [number.get((names[words.code[i]], words.text(i).decode()), 0) for i in range(len(words))]


def test_long_text_in_parts(spark, monkeypatch):
    text = "one two three four. five six " * 300_000
    frame = spark.createDataFrame([(text, "en"), ("no stop at all " * 400_000, "de")], "text string, lang string")
    got = {(r["lang"], r["phrase"]): (r["a"], r["n"]) for r in collocations(frame).collect()}
    assert got["en", "one two three four"][0] == got["en", "five six one two"][0] + 1 == 300_000
    assert got["de", "no stop at all"] == (400_000, 1_600_000)


def test_no_rows(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert collocations(empty).count() == 0
    assert collocations(spark.createDataFrame([(None, None), ("a b", "en")], "text string, lang string")).count() == 0
    with pytest.raises(ValueError, match="max_n"):
        Phrases(max_n=5)
