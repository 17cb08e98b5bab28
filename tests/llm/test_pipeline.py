"""The pipeline's stages on small tables, against plain versions of what they decide."""

import hashlib
import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from packwright.llm.bpe import ByteBpe

SECRET = "0123456789abcdef0123456789abcdef01234567"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(3)
    stems = {"aa": ["ka", "to", "mi", "ren"], "bb": ["sch", "ung", "eit", "ver"]}
    words = lambda lang, n: ["".join(rnd.choice(stems[lang]) for _ in range(rnd.randrange(1, 5))) for _ in range(n)]
    docs = [(i, " ".join(words(lang, 80)), lang) for i in range(120) for lang in ["aa" if i % 2 else "bb"]]
    item = " ".join(words("aa", 30))
    copy = docs[5][1].split(" ")
    docs += [
        (200, docs[4][1], "bb"), (201, " ".join([*copy[:-1], "changed"]), "aa"), (202, None, "aa"), (203, "12 !!", "aa"), (204, " ".join(words("aa", 20)) + " " + item + " " + " ".join(words("aa", 20)), "aa"),
        (205, " ".join(words("aa", 30)) + f' token = "{SECRET}" ' + " ".join(words("aa", 30)), "aa"),
    ]
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t, lang, "s", len(t or "")) for i, t, lang in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, {i: t for i, t, _ in docs}


def test_pipeline(spark, folder, vocabulary):
    path, texts = folder
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, path).collect()}
    assert set(got) == set(range(120)) | {205}
    library = ByteBpe(vocabulary).library
    for i, r in got.items():
        text = texts[i].replace(f'token = "{SECRET}', "[secret]")
        ids = library.encode(text, add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_dedup", "decontaminate", "secrets", "bpe"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder[0]).columns == docs.columns


def test_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder[0]).count() == 0


def test_null_ids_repeated_rows_clashing_columns_and_long_texts(spark, folder, tmp_path):
    """Edge rows pass every stage: what stays is whole, and extra columns keep their values."""
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    text = docs.where("doc_id = 7").first()["text"]
    long = " ".join(f"{w}{i}" if i % 9 == 0 else w for i, w in enumerate((docs.where("doc_id = 9").first()["text"] + " ") .split(" ") * 2500))
    rows = [(None, text + " extra words here", "aa", "s", 1, 0.25, "x"), (300, text, "aa", "s", 1, 0.5, "y"), (7, text, "aa", "s", 1, 0.75, "z"), (7, text, "aa", "s", 1, 0.75, "z"), (301, long, "aa", "s", 1, 1.0, "w"), (302, "", "aa", "s", 0, 1.0, "v")]
    edge = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, spans string")
    learned = docs.withColumn("score", F.lit(0.0)).withColumn("spans", F.lit("")).unionByName(edge)
    assert len(long) > 1_000_000
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, learned, folder[0]).where("score > 0" if name != "bpe" else "doc_id = 301 OR doc_id = 7 OR doc_id = 300 OR doc_id IS NULL").collect()
        if name == "language":
            assert sorted((r["doc_id"] or 0, r["score"]) for r in out) == [(0, 0.25), (7, 0.75), (7, 0.75), (300, 0.5), (301, 1.0)]
        elif name == "near_dedup":
            assert sorted((r["doc_id"] or 0, r["spans"]) for r in out) == [(0, "x"), (7, "z"), (7, "z"), (301, "w"), (302, "v")]
        elif name == "secrets":
            assert {r["doc_id"]: r["text"] for r in out}[301] == long
        elif name == "bpe":
            assert {r["doc_id"]: r["decoded_sha256"] for r in out}[301] == hashlib.sha256(long.encode()).hexdigest()


def test_odd_names_of_extra_columns(spark, folder):
    """Dots, spaces, quotes and, in a case-sensitive session, names that differ by case alone."""
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    odd = docs.select("*", *[F.col("doc_id").alias(n) for n in ("a.b", "a b", "x`y", "_gone", "kept", "")])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, folder[0])
        assert out.columns == odd.columns and all(r["doc_id"] == r["a.b"] == r["x`y"] == r["_gone"] for r in out.collect())
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        clash = docs.withColumn("TEXT", F.lit("other")).withColumn("Doc_Id", F.lit(-1))
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, clash, folder[0])
            assert out.columns == clash.columns and {(r["TEXT"], r["Doc_Id"]) for r in out.collect()} == {("other", -1)}
    finally:
        spark.conf.unset("spark.sql.caseSensitive")
