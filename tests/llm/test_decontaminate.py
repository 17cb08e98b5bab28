import random
import re
import tracemalloc
import zlib

import numpy as np
import pytest

from packwright.llm.decontaminate import Alignment, Items, align, chunk_leaks, clean_documents, leaks, unjudged, words_in_windows

from .conftest import EDGE_TEXTS

RND = random.Random(8)
VOCABULARY = [f"w{i}" for i in range(400)]


def text(n):
    return [RND.choice(VOCABULARY) for _ in range(n)]


ITEMS = [text(RND.randrange(15, 60)) for _ in range(12)] + [text(2)]


def edited(words, share):
    out = []
    for w in words:
        u = RND.random()
        out += [] if u < share / 3 else [f"n{RND.randrange(10**6)}"] if u < 2 * share / 3 else [w, "extra"] if u < share else [w]
    return out


def brute_align(item, window, mismatch, gap):
    best = 0.0
    score = np.zeros((len(item) + 1, len(window) + 1))
    for i in range(1, len(item) + 1):
        for j in range(1, len(window) + 1):
            step = 1.0 if item[i - 1] == window[j - 1] else -mismatch
            score[i, j] = max(0.0, score[i - 1, j - 1] + step, score[i - 1, j] - gap, score[i, j - 1] - gap)
            best = max(best, score[i, j])
    return best


def seeded(rows, options=Alignment()):
    items = Items.of(rows, options)
    return items.seeded(np.zeros(len(items.vocabulary()), np.int64), options)


def everything(docs, items, options=Alignment()):
    """Every document aligned with every item."""
    found = {}
    for doc_id, t in docs:
        words = re.findall("[A-Za-z0-9\x80-\U0010ffff]+", (t or "").lower())
        for item_id, own in items:
            item = re.findall("[A-Za-z0-9\x80-\U0010ffff]+", (own or "").lower())
            if len(item) < options.judged_words or not words:
                continue
            score = align(*(np.array([zlib.crc32(w.encode()) for w in x], np.uint64) for x in (item, words)), options.mismatch, options.gap)[0]
            if score >= float(options.least(np.array([len(item)]))[0]) - 1e-9:
                found[doc_id, item_id] = score / len(item)
    return found


@pytest.mark.parametrize("seed_hits", [1, 3, 6])
def test_equals_aligning_everything(spark, frame, seed_hits):
    """Few words, so that chance matches abound; copies exact, edited at each second or third word, cut, in a third of all documents."""
    rnd = random.Random(44)
    few = [f"w{i}" for i in range(60)] + ["the"] * 30
    line = lambda n: [rnd.choice(few) for _ in range(n)]
    items = [(i, " ".join(line(rnd.randrange(3, 50)))) for i in range(25)] + [(90, " ".join(line(120))), (91, None), (92, "the the the the the the the the")]
    change = lambda words, k: [w if j % k else rnd.choice(few) for j, w in enumerate(words)]
    rows = []
    for i in range(330):
        item = rnd.choice(items)[1] or ""
        own = item.split(" ")
        copy = [own, change(own, 2), change(own, 3), own[: len(own) * 2 // 3], [x for w in own for x in ([w, "new"] if rnd.random() < 0.4 else [w])]][i % 5]
        rows.append((i, " ".join(line(rnd.randrange(60)) + (copy if i % 3 else items[7][1].split(" ")) + line(rnd.randrange(60)))))
    options = Alignment(seed_hits=seed_hits)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in leaks(frame(rows), benchmark, options).collect()}
    assert got == pytest.approx(everything(rows, items, options)) and len(got) > 150
    gone = {d for d, _ in got}
    assert sorted(r["doc_id"] for r in clean_documents(frame(rows), benchmark, options).collect()) == [i for i, _ in rows if i not in gone]


def test_repeated_rows_repeat(spark, frame):
    text = "one two three four five six seven eight nine ten"
    got = leaks(frame([(1, text)] * 3 + [(None, text)]), spark.createDataFrame([(5, text)], "item_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["item_id"], r["score"]) for r in got) == [(0, 5, 1.0)] + [(1, 5, 1.0)] * 3


def test_alignment_equals_plain_dynamic_programming():
    rnd = np.random.default_rng(2)
    for _ in range(300):
        item, window = rnd.integers(0, 5, rnd.integers(1, 15)).astype(np.uint64), rnd.integers(0, 5, rnd.integers(1, 25)).astype(np.uint64)
        score, start, end = align(item, window, 0.5, 0.5)
        assert score == pytest.approx(brute_align(item.tolist(), window.tolist(), 0.5, 0.5))
        if score:
            assert brute_align(item.tolist(), window[start:end].tolist(), 0.5, 0.5) == pytest.approx(score)


@pytest.fixture(scope="module")
def tables(spark, frame):
    items = spark.createDataFrame([(i, " ".join(w), "c") for i, w in enumerate(ITEMS)] + [(90, None, "c"), (91, "", "c"), (92, " ".join(ITEMS[0]), "c")], "item_id long, text string, doc_id string")
    rows, planted = list(EDGE_TEXTS), set()
    for i in range(300):
        body, at = text(RND.randrange(30, 300)), RND.randrange(20)
        if i < 60:
            k = i % 12
            body[at:at] = [w.upper() + "," for w in ITEMS[k]] if i % 2 else edited(ITEMS[k], 0.2)
            planted |= {(100 + i, k)} | ({(100 + i, 92)} if k == 0 else set())
        rows.append((100 + i, " ".join(body)))
    rows += [(1000 + i, " ".join(text(40) + ITEMS[3] + text(40))) for i in range(150)]  # an item in a third of all documents
    planted |= {(1000 + i, 3) for i in range(150)}
    return frame(rows), items, planted


def test_planted_passages(tables):
    docs, items, planted = tables
    got = leaks(docs, items).collect()
    long = {(r["doc_id"], r["item_id"]) for r in got if r["item_id"] != 12}
    assert long == planted
    assert all(0.5 <= r["score"] <= 1 for r in got)


def test_span_holds_the_passage(tables):
    docs, items, _ = tables
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in leaks(docs, items).where("doc_id >= 1000 AND item_id = 3").collect():
        assert texts[r["doc_id"]][r["start"] : r["end"]] == " ".join(ITEMS[3])


def test_blocks_give_the_same(tables):
    docs, items, _ = tables
    key = lambda frame: sorted((r["doc_id"] or -1, r["item_id"], round(r["score"], 9)) for r in frame.collect())
    assert key(leaks(docs, items)) == key(leaks(docs, items, Alignment(block_bytes=400)))


def test_cleaning_keeps_clean_rows(tables, spark):
    docs, items, planted = tables
    out = clean_documents(docs, items)
    assert out.columns == docs.columns
    bad = {r["doc_id"] for r in leaks(docs, items).collect()}
    assert sorted(r["doc_id"] or -1 for r in out.collect()) == sorted(i or -1 for i in [r["doc_id"] for r in docs.collect()] if i not in bad)
    empty = items.limit(0)
    assert leaks(docs, empty).count() == 0 and clean_documents(docs, empty).count() == docs.count() and leaks(docs.limit(0), items).count() == 0


def test_versions_that_stand_in_many_documents(spark, frame):
    """An edited and a half-quoted item in a third of the documents, the exact item in one."""
    rnd = random.Random(21)
    words = lambda n: [f"v{rnd.randrange(10**6)}" for _ in range(n)]
    whole, quoted = words(60), words(60)
    fifth = [f"x{i}" if i % 5 == 4 else w for i, w in enumerate(whole)]
    rows = [(i, " ".join(words(30))) for i in range(400)]
    rows += [(1000 + i, " ".join(words(20) + fifth + words(20))) for i in range(100)]
    rows += [(2000 + i, " ".join(words(20) + quoted[:32] + words(20))) for i in range(100)]
    rows += [(3000, " ".join(whole)), (3001, " ".join(quoted))]
    items = spark.createDataFrame([(0, " ".join(whole)), (1, " ".join(quoted))], "item_id long, text string")
    want = {(1000 + i, 0) for i in range(100)} | {(2000 + i, 1) for i in range(100)} | {(3000, 0), (3001, 1)}
    docs = frame(rows)
    assert {(r["doc_id"], r["item_id"]) for r in leaks(docs, items).collect()} == want
    assert sorted(r["doc_id"] for r in clean_documents(docs, items).collect()) == list(range(400))


def test_words_in_windows_equal_plain_counts():
    rnd = np.random.default_rng(4)
    items = Items.of([(i, " ".join(f"a{x}" for x in rnd.integers(0, 30, rnd.integers(1, 20)))) for i in range(9)], Alignment(judged_words=1))
    words = Items.of([(0, " ".join(f"a{x}" for x in rnd.integers(0, 40, 50)))], Alignment()).words[0]
    owner = rnd.integers(0, 9, 40)
    begin = rnd.integers(0, 50, 40)
    end = np.minimum(50, begin + rnd.integers(0, 20, 40))
    want = [int(np.isin(items.words[o], words[a:b]).sum()) for o, a, b in zip(owner, begin, end)]
    for most in (1, 25, 1 << 18):
        assert words_in_windows(items, owner, words, begin, end, most).tolist() == want


def test_short_items_take_no_clean_documents(spark, frame):
    rows = [(1, "yes it is"), (2, "the cat sat somewhere else and was not seen again"), (3, "so The cat sat, on the mat today"), (4, "one two three four five x y z"), (5, "one two three four five six seven")]
    items = spark.createDataFrame([(0, "yes"), (1, "the cat sat"), (2, "the cat sat on the mat"), (3, "one two three four five six seven eight nine ten")], "item_id long, text string")
    docs = frame(rows)
    assert {(r["doc_id"], r["item_id"]) for r in leaks(docs, items).collect()} == {(3, 2), (5, 3)}
    assert sorted(r["doc_id"] for r in clean_documents(docs, items).collect()) == [1, 2, 4]
    assert sorted(map(tuple, unjudged(items).collect())) == [(0, 1), (1, 3)]


def test_a_long_insertion_does_not_split_a_copy(spark, frame):
    rnd = random.Random(5)
    words = lambda n: [f"v{rnd.randrange(10**6)}" for _ in range(n)]
    item = words(60)
    half = lambda part: [f"x{i}" if i % 8 == 7 else w for i, w in enumerate(part)]
    rows = [(k, " ".join(words(30) + half(item[:30]) + words(k) + half(item[30:]) + words(30))) for k in (10, 20, 33, 40)]
    items = spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")
    got = {r["doc_id"]: r["score"] for r in leaks(frame(rows), items).collect()}
    whole = {k: brute_align(item, t.split(" "), 0.5, 0.5) for k, t in rows}
    assert got == pytest.approx({k: v / 60 for k, v in whole.items() if v >= 30}) and {10, 20} <= set(got)


def test_blocks_of_long_windows_equal_whole_alignment(spark, frame):
    """Hits of one item all over long documents chain into windows far wider than it."""
    rnd = random.Random(6)
    item = [rnd.choice("abcdefghij") * 3 for _ in range(20)]
    rows = [(i, " ".join(rnd.choice("abcdefghij") * 3 for _ in range(700))) for i in range(6)]
    items = spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")
    options = Alignment(least_share=0.55)
    got = {r["doc_id"]: r["score"] for r in leaks(frame(rows), items, options).collect()}
    whole = {i: brute_align(item, t.split(" "), 0.5, 0.5) for i, t in rows}
    assert got == pytest.approx({i: v / 20 for i, v in whole.items() if v >= 11})


def test_equal_items_are_one_alignment_and_words_with_equal_hashes_are_no_leak(monkeypatch):
    text = " ".join(f"w{i}" for i in range(20))
    items = seeded([(i, text) for i in range(1000)])
    assert len(items.words) == 1 and items.ids == [list(range(1000))]
    data = np.frombuffer(text.encode(), np.uint8)
    assert [x[:3] for x in chunk_leaks(items, data, np.array([0, len(data)]), Alignment())] == [(0, 0, 1.0)]
    items.others[0] = items.others[0][::-1]  # as if only the first hashes agreed
    assert not list(chunk_leaks(items, data, np.array([0, len(data)]), Alignment()))


def test_memory_of_one_long_text():
    text = np.tile(np.frombuffer(b"some words of a line that stands there\n", np.uint8), 16_000_000 // 39)
    items = seeded([(0, "words of another test item that is long enough to be judged")])
    tracemalloc.start()
    assert not list(chunk_leaks(items, text, np.array([0, len(text)]), Alignment()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 * len(text)
