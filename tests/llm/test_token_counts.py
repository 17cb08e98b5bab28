import tracemalloc

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from packwright.llm.queries import vocabulary_path
from packwright.llm.token_counts import UnigramCounter, count_tokens, sentencepiece_vocabulary

from .conftest import EDGE_TEXTS


def library(vocabulary, fallback):
    from tokenizers import Tokenizer, models, pre_tokenizers

    tokenizer = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=fallback))
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always")
    return tokenizer


@pytest.fixture(scope="module")
def public():
    vocabulary = sentencepiece_vocabulary(vocabulary_path("piece_bpe_32k.model"))
    return UnigramCounter(vocabulary), library(vocabulary, True)


TIES = [("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("aba", -3.0), ("▁a", -2.0), ("▁ab", -3.0)]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab c▁d\n"), max_size=30))
def test_ties_and_fused_unknowns_equal_library(text):
    assert UnigramCounter(TIES).count_text(text) == len(library(TIES, False).encode(text, add_special_tokens=False).ids)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["the ", "tion", "é", "日", "😀", "  ", "\n", "<unk>", "<s>", "▁", "x", "Ω", "́", "<0x0A>", " "]), max_size=20).map("".join))
def test_public_vocabulary_equals_library(public, text):
    counter, reference = public
    assert counter.count_text(text) == len(reference.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("text", ["ab" * 9000 + " a" * 3, "a c" * 40_000, "abaxx" * 5000])
def test_long_units_and_texts_equal_library(text):
    assert UnigramCounter(TIES).count_text(text) == len(library(TIES, False).encode(text, add_special_tokens=False).ids)


def test_memory_of_unspaced_text(public):
    text = "unspaced" * 100_000
    tracemalloc.start()
    assert public[0].count_text(text) > 100_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * len(text)


def test_query(frame, public):
    got = sorted((r["doc_id"] or -1, r["n_tokens"]) for r in count_tokens(frame(EDGE_TEXTS), vocabulary_path("piece_bpe_32k.model")).collect())
    assert got == sorted((i or -1, len(public[1].encode(t or "", add_special_tokens=False).ids)) for i, t in EDGE_TEXTS)
    assert count_tokens(frame(EDGE_TEXTS).limit(0), vocabulary_path("piece_bpe_32k.model")).count() == 0
