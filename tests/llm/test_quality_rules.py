import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from packwright.llm import quality_rules, textscan
from packwright.llm.quality_rules import NAMES, RULES, Counts, cascade_order, judge_quality, measured_order
from packwright.llm.textscan import chunks

from .conftest import EDGE_TEXTS

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    words = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    count = Counter(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if count[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.none() | st.lists(st.sampled_from(["a", "b", " ", "\n", "é", "\t", "#", "a b c", " ", "\x0b"]), max_size=40).map("".join), min_size=1, max_size=5), st.integers(1, 60))
def test_counts(texts, limit):
    got = [row for _, _, data, offsets in chunks(pa.array(texts, pa.string()), limit) for c in [Counts(data, offsets)] for row in zip(*(getattr(c, n).tolist() for n in NAMES))]
    assert got == [brute(t) for t in texts]


GOOD = " ".join(f"alpha{i} is beta{i} and gamma{i} too." for i in range(30))
BAD = {20: GOOD.replace(" ", " # ", 60), 21: " ".join(f"same same u{i}" for i in range(60)), 22: "12 34 5678 901 " * 3 + " ".join(str(i) for i in range(100)) + " few letters", 23: ("one line of words again\n" + "\n".join(f"x{i}" for i in range(8)) + "\n") * 1 + "\n".join(["dup line"] * 20) + "\n" + "\n".join(f"unique words {i} on line" for i in range(30))}


def test_verdicts_do_not_depend_on_order(frame):
    docs = frame([*EDGE_TEXTS, (10, GOOD), *BAD.items()])
    orders = [list(RULES), list(reversed(RULES))]
    one, two = ({(r["doc_id"], r["n_words"]): r["kept"] for r in judge_quality(docs, order=o).collect()} for o in orders)
    assert one == two
    assert {i: k for (i, _), k in one.items() if i is not None and i >= 10} == {10: True, 20: False, 21: False, 22: False, 23: False}


def test_order_is_measured(frame):
    docs = frame([(i, GOOD if i % 2 else BAD[20]) for i in range(400)])
    order = measured_order(docs)
    assert sorted(order) == sorted(RULES)
    assert measured_order(docs.limit(0)) == list(RULES) and judge_quality(docs.limit(0)).count() == 0


def thue_morse(n, letters="ab"):
    return "".join(letters[i.bit_count() & 1] for i in range(n))


def test_lines_and_words_with_equal_hashes_are_told_apart(monkeypatch):
    one, two = thue_morse(2048), thue_morse(2048, "ba")
    texts = [f"{one}\n{two}\n{one}", "a b c a b c", " ".join([one, two, one] * 2), "x y\nz w\nx y\nu v\n", None]
    numbers = lambda: [row for _, _, data, offsets in chunks(pa.array(texts, pa.string())) for c in [Counts(data, offsets)] for row in zip(*(getattr(c, n).tolist() for n in NAMES))]
    assert numbers() == [brute(t) for t in texts]
    weak = lambda data, start, end, seed=0: ((end - start) % 2).astype(np.uint64)
    monkeypatch.setattr(quality_rules, "span_hashes", weak)
    monkeypatch.setattr(textscan, "span_hashes", weak)
    assert numbers() == [brute(t) for t in texts]
    c = Counts(*textscan.text_buffers(pa.array(["aa bb cc dd ee ff aa gg hh ii", "aa bb aa cc", "bb aa cc dd aa"])))
    assert RULES["one_word_share"](c, np.arange(3)).tolist() == [False, True, True]


def test_order_counts_what_the_rules_before_leave():
    # b rejects most of what a rejects; c rejects other rows
    assert cascade_order(["b", "a", "c"], {"a": 1.0, "b": 1.0, "c": 1.0}, {0b011: 50, 0b010: 10, 0b100: 20, 0: 100}) == ["a", "c", "b"]


def test_memory_of_one_long_text():
    text = np.tile(np.frombuffer(b"some words of a line that stands there\n", np.uint8), 16_000_000 // 39)
    tracemalloc.start()
    c = Counts(text, np.array([0, len(text)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert int(c.n_words[0]) == 8 * (16_000_000 // 39) and int(c.n_dup_lines[0]) == 16_000_000 // 39 - 1
    assert peak < 20 * len(text)
