import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
from packwright.llm.language_id import UNDETERMINED, Fit, Model, Predictor, confident, identify, labelled_sample, learn, training_rows
from packwright.llm.textscan import text_buffers

from .conftest import EDGE_TEXTS

STEMS = {"aa": ["ka", "to", "mi", "ren", "sol"], "bb": ["sch", "ung", "eit", "ver", "ost"], "cc": ["çé", "oux", "ain", "ê", "lle"], "дд": ["про", "ста", "ние", "ова", "ть"]}


def corpus(n, seed=1):
    rnd = random.Random(seed)
    rows, lang = [], {}
    for i in range(n):
        name = sorted(STEMS)[i % len(STEMS)]
        words = ["".join(rnd.choice(STEMS[name]) for _ in range(rnd.randrange(1, 4))) for _ in range(rnd.randrange(3, 120))]
        rows.append((i, " ".join(words).capitalize() + " 12!"))
        lang[i] = name
    return rows, lang


def test_held_out_accuracy_and_contract(frame):
    rows, lang = corpus(800)
    edge = [(5000 + (77 if i is None else i), t) for i, t in EDGE_TEXTS] + [(6000, "123 !! 456")]
    docs = frame(rows + edge, lang=lang | {i: None for i, _ in edge})
    model = learn(docs.where(training_rows(docs)))
    got = {r["doc_id"]: r for r in identify(docs, model).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [i for i in lang if got[i]["held_out"]]
    assert sum(got[i]["lang_pred"] == lang[i] for i in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    for i in (5000, 5001, 5002, 6000):
        assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
    assert got[5007]["lang_pred"] in STEMS
    # only the text decides
    other = docs.selectExpr("doc_id", "text", "'zz' AS lang", "'q' AS source")
    assert {r["doc_id"]: (r["lang_pred"], r["score"]) for r in identify(other, model).collect()} == {i: (r["lang_pred"], r["score"]) for i, r in got.items()}
    sparse = (model.weights == 0).all(1).mean()
    assert sparse > 0.5
    kept = confident(docs, model)
    assert kept.columns == docs.columns and {5000, 6000}.isdisjoint({r["doc_id"] for r in kept.collect()}) and kept.count() >= 780


def test_nothing_to_learn(frame):
    docs = frame(corpus(5)[0], lang={i: None for i in range(5)})
    assert learn(docs) is None
    assert {(r["lang_pred"], r["score"]) for r in identify(docs, None).collect()} == {("und", 0.0)}
    assert identify(docs.limit(0), None).count() == 0 and confident(docs, None).count() == 0


def test_one_language(frame):
    docs = frame(corpus(8)[0], lang={i: "aa" for i in range(8)})
    assert {r["lang_pred"] for r in identify(docs, learn(docs)).collect()} == {"aa"}


def test_sample_is_bounded_by_distinct_texts(spark):
    rows = spark.createDataFrame([(f"text number {'abcdefghij'[k % 10] * (k + 3)}", "aa") for k in range(20) for _ in range(60)], "text string, lang string")
    assert len(labelled_sample(rows, Fit(rows_per_language=50))) == 40  # each text and a piece of it
    assert len(labelled_sample(rows, Fit(rows_per_language=5))) <= 30


def some_model(seed=0):
    rnd = np.random.default_rng(seed)
    return Model(["aa", "bb", "cc"], rnd.normal(0, 1, (1 << 10, 3)).astype(np.float32), rnd.normal(0, 0.1, 3), 0.7, Fit(bits=10))


def plain(model, text):
    """The prediction as a loop over the text's n-grams."""
    from packwright.llm.language_id import buckets

    folded = " "
    for c in text or "":
        c = c.lower()[0] if c.isalpha() else " "
        folded += "" if c == folded[-1] == " " else c
    grams = [buckets(np.array([ord(c) for c in folded[i : i + k]], np.uint32), k, model.options.bits)[0] for k in model.options.orders for i in range(len(folded) - k + 1)]
    if not any(c.isalpha() for c in text or ""):
        return UNDETERMINED, 0.0
    x = np.array([sum(np.rint(model.weights[g, j].astype(float) * (1 << 20)) for g in grams) / (1 << 20) / len(grams) + model.bias[j] for j in range(3)]) / model.temperature
    chance = np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    return model.languages[int(chance.argmax())], float(chance.max())


TEXTS = ["Some WORDS, and  12 signs!", "É日本 x", "", None, "12 !", "a", " ab ", "ab\n\n\ncd", "Straße İi", "z" * 50 + "  " * 20 + "y"]


def test_scores_equal_a_plain_loop_and_do_not_depend_on_neighbours():
    model = some_model()
    data, offsets = text_buffers(pa.array(TEXTS * 2))
    lang, score = Predictor(model).predict(data, offsets)
    for i, t in enumerate(TEXTS):
        want = plain(model, t)
        assert lang[i] == lang[i + len(TEXTS)] == want[0] and score[i] == score[i + len(TEXTS)] and abs(score[i] - want[1]) < 1e-9


def test_pieces_of_a_long_text_score_as_the_whole():
    model = some_model(1)
    for text in [t for t in TEXTS if t] + ["".join(t or "" for t in TEXTS)]:
        data = np.frombuffer(text.encode(), np.uint8)
        offsets = np.array([0, len(data)])
        for piece in (1, 2, 3, 5, 8):
            one, two = (Predictor(model, p).predict(data, offsets) for p in (piece, 1 << 20))
            assert one[0] == two[0] and one[1].tolist() == two[1].tolist()


def test_memory_of_one_long_text():
    text = np.tile(np.frombuffer(b"some words of a line that stands there\n", np.uint8), 16_000_000 // 39)
    tracemalloc.start()
    assert Predictor(some_model()).predict(text, np.array([0, len(text)]))[0] != [UNDETERMINED]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * len(text)


def test_long_texts_are_counted_whole(spark, monkeypatch):
    from packwright.llm import language_id

    monkeypatch.setattr(language_id, "PIECE_BYTES", 1 << 30)
    text = "Ein Text, der lang ist, mit 12 Zeichen; " * 9000 + "zuletzt etwas anderes çà"
    rows = spark.createDataFrame([(text, "aa"), ("kurz und gut", "aa"), ("1234 " * 60_000, "aa")], "text string, lang string")
    letters, size = language_id.Letters(), 1 << 16
    data = np.frombuffer(text.encode(), np.uint8)
    for piece in (1 << 10, 1 << 17):
        for order in (1, 2, 3):
            parts = [language_id.piece_grams(p, t, order, 16) for p, t, _ in language_id.long_points(letters, data, piece)]
            points, bounds, _ = letters.read(data, np.array([0, len(data)]))
            assert (np.bincount(np.concatenate(parts), minlength=size) == np.bincount(language_id.buckets(points, order, 16), minlength=size)).all()
    whole = sorted((s[0], s[2].tolist()) for s in labelled_sample(rows, Fit()))
    assert len(whole) == 4 and max(len(x[1]) for x in whole) > 100
    small = labelled_sample(rows, Fit(sample_bytes=8))
    assert len(small) == 2  # the first of a language stay, whatever their size


def test_held_out_of_a_null_id(frame):
    docs = frame([(None, "some text"), (1, "some text")])
    assert {r["held_out"] for r in identify(docs.where("doc_id IS NULL"), None).collect()} == {False}
