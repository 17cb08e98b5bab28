import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from packwright.llm.files import new_folder
from packwright.llm.packing import Bucketed, Packing, WordBpe, binary_lengths, packed, read_sequences, worker_coder, write_sequences

from .conftest import EDGE_TEXTS


@pytest.fixture(scope="module")
def words():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def library_ids(coder, text):
    return [*coder.library.encode(text or "", add_special_tokens=False).ids, 1]


ODD = st.sampled_from(["a", "B", "é", "é", "́", "'s", "'S", "'re", "’t", " ", "  ", "\n", "\t", "\x0b", "\x85", " ", " ", " ", "　", "1", "23", "½", "!?", "<|endoftext|>", "<|startoftext|>", "<|", "日本", "각", "가", "İ", "ß", "Σς", "😀", "‍", "\x1c", "\x1f", "H\u0331", "=\u0338", "\u0331", "(", ").", "x1", "-", "Z", "Ï", "ß", "ŉ", "Ŀ", "×"])


@settings(max_examples=1500, deadline=None)
@given(st.lists(ODD | st.text(max_size=4), max_size=24).map("".join))
def test_ids_equal_the_library(text):
    import public_tokenizers

    coder = worker_coder(public_tokenizers.path("word_bpe_49k.json"))
    data = np.frombuffer(text.encode(errors="replace"), np.uint8)
    assert coder.encode(data, np.array([0, len(data)]))[0].tolist() == library_ids(coder, data.tobytes().decode())[:-1]


@settings(deadline=None)
@given(st.integers(0, 1 << 16), st.integers(2, 12))
def test_lengths_are_powers_of_two(n, k):
    found = binary_lengths(n, 1 << k)
    assert found.sum() == n and all(x & (x - 1) == 0 and x <= 1 << k for x in found.tolist()) and sorted(found.tolist(), reverse=True) == found.tolist()
    assert max(Counter(x for x in found.tolist() if x < 1 << k).values(), default=1) == 1


def test_buckets_number_their_pieces():
    give = Bucketed(3)
    ids = np.concatenate([give(np.array([4, 1, 4])), give(np.array([1, 1, 2048, 4]))])
    assert len(set(ids.tolist())) == 7 and (ids >> 58).tolist() == [2, 0, 2, 0, 0, 11, 2]
    assert [int(x) & (1 << 34) - 1 for x in ids] == [0, 0, 1, 1, 2, 0, 2]


def check(rows, docs, coder, options=Packing()):
    """Every id of each document in one piece, sequences gapless and without padding."""
    want = Counter()
    for doc_id, text in docs:
        ids, at = library_ids(coder, text), 0
        for size in binary_lengths(len(ids), options.longest).tolist():
            part = np.array(ids[at : at + size], "<u4")
            want[doc_id, at, size, zlib.crc32(part.tobytes()), len(ids), 0] += 1
            at += size
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"], r["offset"]) for r in rows) == want
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    buckets = {}
    for r in rows:
        buckets.setdefault(r["length"], []).append(r["sequence_id"])
    ranges = sorted((min(x), max(x), length) for length, x in buckets.items())
    assert [r[2] for r in ranges] == sorted(buckets) and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))


def test_packs_whole_documents(frame, words):
    docs = EDGE_TEXTS + [(100 + i, f"Some {i} words, don't they?  " * (i * 7 % 400)) for i in range(60)] + [(8, "x y " * 700_000), (None, "again"), (100, "same id")]
    check(packed(frame(docs), words).collect(), docs, WordBpe(words))
    check(packed(frame(docs[:40]), words, Packing(longest=8)).collect(), docs[:40], WordBpe(words), Packing(longest=8))
    assert packed(frame(docs).limit(0), words).count() == 0


def test_sequences_are_written_by_length(frame, spark, words):
    docs = [(i, "many words " * i) for i in range(200)]
    folder = new_folder(spark, "s")
    write_sequences(frame(docs), words, folder, Packing(wide=True))
    found = read_sequences(spark, folder)
    assert sum(1 for r in found.collect() if len(r["ids"]) != 4 * r["length"]) == 0
    plan = found.where("length = 64")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(length" in plan
    coder = WordBpe(words)
    parts = {}
    for r in found.collect():
        parts.setdefault(r["doc_id"], []).append((r["start"], np.frombuffer(r["ids"], "<u4").tolist()))
    assert all([x for _, part in sorted(parts[i]) for x in part] == library_ids(coder, t) for i, t in docs)


def test_bad_parameters(frame, words):
    with pytest.raises(ValueError, match="power of two"):
        Packing(longest=1000)
