import hashlib

import pytest
import regex

from packwright.llm.fill_in_middle import CODE_POINTS, LINES, WORDS, Middle, Units, fill_in_middle, middle_digests, restored

from .conftest import EDGE_TEXTS


def brute(doc_id, text, options=Middle()):
    text = text or ""
    units = regex.findall(options.units.pattern, text) if options.units.per_match == 1 else list(text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in options.markers) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    p, s, m = options.markers
    spm = h4 % 100 < 20
    return doc_id, n, "spm" if spm else "psm", len(prefix), len(middle), s + suffix + p + prefix + m + middle if spm else p + prefix + s + suffix + m + middle


def sorted_rows(rows):
    return sorted((tuple(r) for r in rows), key=str)


TEXTS = EDGE_TEXTS + [(20, "has <M> inside"), (21, "<S"), (22, "a<P"), (23, "<<>P>S>M"), (24, "𝒜b\r\n\n é" * 3000), (-5, "minus"), (25, "y" * 4096), (26, "z" * 8192)] + [(100 + i, f"line {i}\n words  and\tmore\n" * (i % 9)) for i in range(120)]


@pytest.mark.parametrize("units", [CODE_POINTS, Units(r"(?s).{1,3}", 3), WORDS, LINES], ids=["points", "short runs", "words", "lines"])
def test_equals_plain_version(frame, units):
    options = Middle(units=units)
    got = fill_in_middle(frame(TEXTS), options)
    assert sorted_rows(got.drop("text").collect()) == sorted_rows(brute(*r, options) for r in TEXTS)
    again = got.select("text", restored(got["output"], got["form"], options).alias("again"))
    assert all(r["again"] == r["text"] for r in again.collect())


def test_digests(frame):
    want = [(*(b := brute(*r))[:5], hashlib.sha256(b[5].encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in TEXTS]
    assert sorted_rows(middle_digests(frame(TEXTS)).collect()) == sorted_rows(want)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}


def test_empty_table_and_repeated_rows(frame):
    assert middle_digests(frame(TEXTS).limit(0)).count() == 0
    rows = [(7, "the same row again")] * 400 + [(None, "null id")] * 300 + [(i, "one text, many ids") for i in range(300)]
    assert sorted_rows(fill_in_middle(frame(rows)).drop("text").collect()) == sorted_rows(brute(*r) for r in rows)


def test_only_numbers_of_units_and_one_copy_of_the_text_are_shuffled(frame):
    plan = middle_digests(frame(TEXTS))._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
