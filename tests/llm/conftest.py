import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """documents from (doc_id, text) pairs, spread over partitions, with columns whose names clash with outputs."""

    def make(rows, **more):
        data = [(i, t, more.get("lang", {}).get(i, "en"), "s", len(t or ""), 0.5, False) for i, t in rows]
        return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean").repartition(3)

    return make


@pytest.fixture(scope="session")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


EDGE_TEXTS = [(0, None), (1, ""), (2, " \n\t "), (3, "a"), (4, "a b"), (5, "a b"), (6, "x" * 30_000), (7, "word " * 5_000), (8, "é😀 日本\n"), (9, "a b c d e f"), (9, "a b c d e f"), (None, "no id here at all")]
