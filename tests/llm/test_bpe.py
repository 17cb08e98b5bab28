import copy
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from packwright.llm import bpe
from packwright.llm.bpe import ByteBpe, decode_ids, encode_texts, long_digests, round_trip_digests
from packwright.llm.textscan import chunks

from .conftest import EDGE_TEXTS


@pytest.fixture(scope="module")
def coder(vocabulary):
    return ByteBpe(vocabulary, leaf=40, window=2)


def with_piece(coder, size):
    small = copy.copy(coder)
    small.piece = size
    small._forget()
    return small


def own(coder, texts, limit=200):
    out = []
    for _, _, data, offsets in chunks(pa.array(texts, pa.string()), limit):
        ids, bounds = coder.encode(data, offsets)
        out += [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]
        assert coder.decode(ids, bounds) == [coder.library.decode(x, skip_special_tokens=False).encode() for x in out[-len(bounds) + 1 :]]
    return out


def library(coder, texts):
    return [e.ids for e in coder.library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


PIECES = st.sampled_from(["a", "b", "the", "'", "'s", "'ll", " ", "  ", "\n", "\t", "1", "23", "!", "é", "日本", "😀", " ", "<|endoftext|>", "<|", "|>", "s", "́", "²", "'S", "_", " "])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(PIECES, max_size=25).map("".join), min_size=1, max_size=4))
def test_equals_library(coder, texts):
    assert own(coder, texts) == library(coder, texts)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdeé日"), min_size=41, max_size=400) | st.text(alphabet=st.sampled_from("!?#-=日😀"), min_size=41, max_size=300) | st.integers(41, 300).map(lambda n: " " * n + "a"))
def test_long_unsplit_text_equals_library(coder, text):
    assert own(coder, [text]) == library(coder, [text])


def test_join_grows_until_both_sides_agree(coder):
    rnd = random.Random(1)
    for _ in range(200):
        text = "".join(rnd.choice("abcdefghij") for _ in range(80))
        cut = rnd.randrange(1, 80)
        left, right, whole = (np.array(x, np.uint32) for x in coder.encode_pieces([text[:cut], text[cut:], text]))
        assert coder.join(left, right).tolist() == whole.tolist()


def test_remembers_a_bounded_number_of_pretokens(vocabulary):
    small = ByteBpe(vocabulary, keep=5)
    texts = [f"alpha{i} beta{i} gamma" for i in range(50)]
    assert own(small, texts, 40) == library(small, texts) and len(small.known) < 20


def test_query_and_round_trip(frame, vocabulary, coder):
    docs = frame(EDGE_TEXTS)
    got = sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in round_trip_digests(docs, vocabulary, leaf=64).collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    ids = library(coder, [t for _, t in EDGE_TEXTS])
    assert got == sorted((i or -1, len(x), sha(",".join(map(str, x)).encode()), sha((t or "").encode())) for (i, t), x in zip(EDGE_TEXTS, ids))
    back = decode_ids(encode_texts(docs, vocabulary), vocabulary)
    assert sorted((r["doc_id"] or -1, r["text"]) for r in back.collect()) == sorted((i or -1, t or "") for i, t in EDGE_TEXTS)
    assert round_trip_digests(docs.limit(0), vocabulary).count() == 0


def test_broken_bytes_do_not_shift_neighbours(coder):
    data, offsets = np.frombuffer(b"ab\xff" + b"cd", np.uint8), np.array([0, 3, 5])
    ids, bounds = coder.encode(data, offsets)
    assert ids[bounds[1] :].tolist() == library(coder, ["cd"])[0]


def thue_morse(n, letters="ab"):
    return "".join(letters[i.bit_count() & 1] for i in range(n))


def test_colliding_hashes_keep_their_own_ids(coder, vocabulary, monkeypatch):
    """Texts that a linear hash confuses; then a hash that confuses most texts."""
    texts = [thue_morse(4096), thue_morse(4096, "ba"), thue_morse(64), thue_morse(64, "ba")]
    assert own(coder, texts, 1 << 20) == library(coder, texts)
    monkeypatch.setattr(bpe, "span_hashes", lambda data, start, end: ((end - start) % 3).astype(np.uint64))
    monkeypatch.setattr(bpe, "EXACT_BYTES", 0)
    weak = ByteBpe(vocabulary, leaf=40)
    texts = ["a few words that are of equal sizes", "few a words, are of that sizes equal", ""] * 2
    assert own(weak, texts, 20) == library(weak, texts) and weak.clashing


ODD_PIECES = st.sampled_from(["a" * 30, "'s", "''", "don't", " ", "   ", "\n\n", "\u00a0", "123456789", "!?" * 9, "日本語" * 8, "é" * 20, "<|endoftext|>", "word ", "。", "x"])


@settings(max_examples=300, deadline=None)
@given(st.lists(ODD_PIECES, min_size=1, max_size=40).map("".join), st.sampled_from([5, 17, 64]))
def test_pieces_of_a_long_text_equal_library(coder, text, piece):
    small = with_piece(coder, piece)
    data = np.frombuffer(text.encode(), np.uint8)
    parts = list(small.encode_row(data))
    assert [x for p in parts for x in p.tolist()] == library(coder, [text])[0]
    assert b"".join(small.decode(p, np.array([0, len(p)]))[0] for p in parts) == text.encode()


@pytest.mark.parametrize("text", ["x" * 9000, " " * 9000 + "a", "ab" * 5000, "\n" * 8191 + " b", "'" * 9001 + "s", "日" * 5000, "a1" * 4000 + "é" * 6000])
def test_runs_cut_anywhere_equal_library(coder, text):
    assert [x for p in with_piece(coder, 1000).encode_row(np.frombuffer(text.encode(), np.uint8)) for x in p.tolist()] == library(coder, [text])[0]


def test_memory_does_not_grow_with_one_text(vocabulary):
    """24 MB of words, and 8 MB of one letter run, at under 10 bytes a byte beyond the text."""
    import tracemalloc

    coder = ByteBpe(vocabulary)
    for text in (np.tile(np.frombuffer("Some words, numbers 123 and signs; ".encode(), np.uint8), 24_000_000 // 35), np.frombuffer(b"abcdefgh" * 1_000_000, np.uint8)):
        tracemalloc.start()
        n, _, decoded = long_digests(coder, text)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert n and decoded == hashlib.sha256(text.tobytes()).hexdigest() and peak < 10 * len(text) // (4 if len(text) > 20_000_000 else 1)
