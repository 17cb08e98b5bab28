import os
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from packwright.llm import near_dedup
from packwright.llm.components import components
from packwright.llm.near_dedup import Near, links, near_duplicates

from .conftest import EDGE_TEXTS

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text, size):
    words = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    k = min(size, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def brute(rows, options):
    sets = {i: shingles(t, options.words) for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= options.percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return sorted((i, len(shingles(t, options.words)), None if i is None else root(i), i is None or root(i) == i) for i, t in rows if i is not None)


def run(docs, options):
    return sorted(tuple(r) for r in near_duplicates(docs, options).collect() if r["doc_id"] is not None)


def edited(rnd, words, n):
    words = list(words)
    for _ in range(n):
        words[rnd.randrange(len(words))] = f"e{rnd.randrange(10**9)}"
    return " ".join(words)


def corpus(seed):
    """Copies, near copies at all distances from the threshold, chains, shared passages, a large group."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    text = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    texts = []
    for n in (4, 10, 40, 200, 900):
        base = text(n)
        texts += [" ".join(base)] * 2 + [edited(rnd, base, k) for k in (1, 1, 2, n // 60 + 1, n // 40 + 1, n // 25 + 1, n // 15 + 1)]
    chain = text(150)
    for _ in range(12):
        chain = edited(rnd, chain, 3).split(" ")
        texts.append(" ".join(chain))
    hot = text(120)
    texts += [edited(rnd, hot, rnd.randrange(4)) for _ in range(90)] + [" ".join(hot)] * 40
    passage = text(60)
    texts += [" ".join(passage + text(rnd.randrange(3, 30))) for _ in range(60)]
    texts += [" ".join(text(rnd.randrange(1, 120))) for _ in range(60)] + [" ".join(hot).upper()]
    rnd.shuffle(texts)
    return [(i + 20, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("seed", "options"), [(1, Near(words=3, percent=85)), (2, Near(words=5, percent=80)), (3, Near(words=3, percent=85, k=32, short_list=3, salted_from=7, hub_orders=1, direct_pairs=0))])
def test_equals_brute_force(frame, seed, options):
    rows = corpus(seed) + [(i, t) for i, t in EDGE_TEXTS if i not in (9, None)]
    assert run(frame(rows), options) == brute(rows, options)


def test_edge_cases(frame):
    docs = frame(EDGE_TEXTS)
    got = near_duplicates(docs, Near(words=3, percent=85))
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(EDGE_TEXTS) and [r for r in rows if r[0] is None] == [(None, 3, None, True)]
    assert sorted(r[2] for r in rows if r[0] in (0, 1, 2)) == [0, 1, 2]
    assert {r[0]: r[2] for r in rows if r[0] in (4, 5)} == {4: 4, 5: 4}
    assert [r[3] for r in rows if r[0] == 9] == [True, True]
    assert near_duplicates(docs.limit(0)).count() == 0


def thue_morse(n, letters="ab"):
    return "".join(letters[i.bit_count() & 1] for i in range(n))


def test_colliding_hashes_link_nothing(frame, spark, monkeypatch):
    rows = [(1, thue_morse(4096)), (2, thue_morse(4096, "ba")), (3, thue_morse(4096, "ba") + " ")]
    assert {r[0]: r[2] for r in run(frame(rows), Near(words=3, percent=85))} == {1: 1, 2: 2, 3: 2}
    # sets that agree under the first hash only
    import numpy as np

    far = lambda *parts: np.unique(np.array(parts, np.uint64))
    sets = [(7, far(1, 2).tobytes(), far(5, 6).tobytes()), (8, far(1, 2).tobytes(), far(7, 8).tobytes()), (9, far(1, 2).tobytes(), far(7, 8).tobytes())]
    table = spark.createDataFrame(sets, "doc_id long, full binary, other binary")
    pairs = spark.createDataFrame([(7, 8), (7, 9), (8, 9)], "a long, b long")
    assert [tuple(r) for r in links(pairs, Near(), sets=table).collect()] == [(8, 9)]


def test_large_ids(frame):
    big = 5 * 10**18
    rows = [(big + i, "one two three four five six seven") for i in range(3)] + [(-big, "one two three four five six eight nine ten eleven"), (-big - 1, "one two three four five six eight nine ten eleven twelve")]
    assert {r[0]: r[2] for r in run(frame(rows), Near(words=3, percent=80))} == {big: big, big + 1: big, big + 2: big, -big: -big - 1, -big - 1: -big - 1}


def test_rows_of_one_id_are_one_document(frame):
    one, two, other = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(7, one), (7, two), (3, one), (5, two), (9, other), (9, other), (8, two + " more")]
    got = [tuple(r) for r in near_duplicates(frame(rows), Near(words=3, percent=85)).collect()]
    assert sorted((r[0], r[2]) for r in got) == [(3, 3), (5, 3), (7, 3), (7, 3), (8, 3), (9, 9), (9, 9)]


def test_recall_of_queries_against_all_rows(frame):
    """Links of every tenth document with all others, by brute force: none is missed."""
    options = Near(words=3, percent=85)
    rows = corpus(9)
    groups = {r[0]: r[2] for r in run(frame(rows), options)}
    sets = {i: shingles(t, 3) for i, t in rows}
    truth = [(a, b) for a in sets if a % 10 == 0 for b in sets if b != a and options.linked(len(sets[a] & sets[b]), len(sets[a]), len(sets[b]))]
    assert len(truth) > 200 and all(groups[a] == groups[b] for a, b in truth)


def test_result_does_not_depend_on_partitions(spark, frame):
    rows = corpus(5)
    one = run(frame(rows).coalesce(1), Near(words=3, percent=85))
    assert one == run(frame(rows).repartition(9), Near(words=3, percent=85))


def test_components(spark):
    rnd = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(1000, 1000 + i) for i in range(1, 50)] + [(rnd.randrange(2000, 2100), rnd.randrange(2000, 2100)) for _ in range(60)] + [(7, 7)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert components(spark.createDataFrame(edges, "a long, b long").where(F.lit(False))).count() == 0


def shared_passage(seed, docs=260):
    """Texts that have a passage in common by chance, so lists of many unlike members, and a few copies with edits."""
    rnd = random.Random(seed)
    text = lambda n: [rnd.choice("abcdefgh") + str(rnd.randrange(10**6)) for _ in range(n)]
    passage, copies = text(30), []
    texts = [text(130) + passage + text(130) for _ in range(docs)]
    for t in texts[:12]:
        copies += [edited(rnd, t, k) for k in (3, 8, 14, 30)]
    return list(enumerate([" ".join(t) for t in texts] + copies))


def test_chance_lists_move_no_sets(frame, monkeypatch):
    """Members of a long list with little in common are told apart without their full sets."""
    written, store = {}, near_dedup.stored

    def measured(df, kind):
        table = store(df, kind)
        written[kind] = written.get(kind, 0) + sum(os.path.getsize(f.removeprefix("file:")) for f in (x.replace("///", "/") for x in table.inputFiles()))
        return table

    monkeypatch.setattr(near_dedup, "stored", measured)
    options = Near(words=3, percent=85, hot_values=0)
    rows = shared_passage(6)
    assert run(frame(rows), options) == brute(rows, options)
    assert sum(n for kind, n in written.items() if kind != "signatures") < written["signatures"]


def test_passed_tables_and_shuffle_files_go(frame, spark):
    def left():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return sum(files.apply(i).length() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_"))

    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    docs = frame(shared_passage(7))
    docs.count()
    tables, files = set(os.listdir(shared)), left()
    got = near_duplicates(docs, Near(words=3, percent=85, hot_values=0))
    kinds = {x.rpartition("-")[0] for x in set(os.listdir(shared)) - tables}
    assert not kinds & {"signatures", "frequent", "stars", "pairs", "digests", "alike", "sets", "differences", "difference-entries", "hub-members", "members"}
    for _ in range(50):
        if left() - files < 100_000:
            break
        time.sleep(0.1)
    assert left() - files < 100_000 and got.count() == 308


def test_digests_leave_all_links(spark):
    """Pairs on both sides of the threshold, small and large sets: no link goes, unlike ones do."""
    import numpy as np

    rnd = np.random.default_rng(3)
    for options in (Near(words=3, percent=85), Near(words=5, percent=80), Near(words=3, percent=85, k=32)):
        sketches, truth, unlike = [], set(), set()
        for i in range(300):
            n = int(rnd.integers(2, 400))
            x = np.unique(rnd.integers(0, 1 << 63, n, np.int64).astype(np.uint64))
            cut = int(rnd.integers(0, n // 5 + 1)) if i % 3 else n
            y = np.unique(np.concatenate([x[rnd.permutation(len(x))[cut:]], rnd.integers(0, 1 << 63, cut, np.int64).astype(np.uint64)]))
            sketches += [(2 * i, x[: options.k].tobytes()), (2 * i + 1, y[: options.k].tobytes())]
            if options.sets_linked(x, y):
                truth.add((2 * i, 2 * i + 1))
            elif cut == n and n > 50:
                unlike.add((2 * i, 2 * i + 1))
        digests = near_dedup.sketch_digests(spark.createDataFrame(sketches, "doc_id long, sketch binary"))
        pairs = spark.createDataFrame([(2 * i, 2 * i + 1) for i in range(300)], "a long, b long")
        kept = {tuple(r) for r in near_dedup.alike(pairs, digests, options).collect()}
        assert len(truth) > 50 and truth <= kept and len(unlike) > 50 and not unlike & kept


def test_empty_rows_of_an_id_link_nothing(frame):
    one = [f"a{i}" for i in range(100)]
    two = [*one[:50], "b", *one[50:75], "c", *one[75:], "d", "e", "f", "g", "h", "i", "j", "k", "l", "m"]
    rows = [(7, " ".join(one)), (7, None), (8, " ".join(two)), (8, "")]
    assert {r[0]: r[2] for r in run(frame(rows), Near(words=3, percent=85))} == {7: 7, 8: 8}
