"""Index documents in parts: their texts together are the document, whatever a company's pages."""

import json

from packwright.operators.documents import INDEX_MEMBERS, company_index

SCHEMA = "company string, pos long, final_url string, got string, `other.member` string"


def rows():
    hot = [("hot", i // 2, f"https://h.test/{i} \"ä\"", None if i % 3 else "x", "o") for i in range(500)]  # positions repeat
    return hot + [("one", 7, None, "", "o"), ("unlisted", 1, "u", "g", "o"), (None, 1, "n", "g", "o")]


def test_parts_make_the_document(spark):
    companies = spark.createDataFrame([("hot", 1.5), ("one", None), ("none", 2.0), (None, 3.0)], "company string, `a score` double")
    got = company_index(companies, spark.createDataFrame(rows(), SCHEMA), 16).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r["company"] or "", r["part"])):
        by.setdefault(r["company"], []).append(r)
        assert r["n_pages"] <= 16 and len(json.loads(r["pages"])) == r["n_pages"]
    assert {c: (len(p), {x["parts"] for x in p}, [x["part"] for x in p]) for c, p in by.items()} == {"hot": (32, {32}, list(range(32))), "one": (1, {1}, [0]), "none": (1, {1}, [0]), None: (1, {1}, [0])}
    whole = {c: json.loads("".join(x["index"] for x in p)) for c, p in by.items()}
    blank = {m: "" for m in INDEX_MEMBERS if m not in ("final_url", "got")}
    want = [{k: v for k, v in {**blank, "final_url": u, "got": g}.items() if v is not None} for _, _, u, g, _ in rows()[:500]]
    plain = lambda pages: sorted(json.dumps(p, sort_keys=True) for p in pages)
    assert plain(whole["hot"].pop("pages")) == plain(want) and whole["hot"] == {"company": "hot", "a score": 1.5}
    assert whole["one"] == {"company": "one", "pages": [{**blank, "got": ""}]}
    assert whole["none"] == {"company": "none", "a score": 2.0, "pages": []} and whole[None] == {"a score": 3.0, "pages": []}


def test_positions_keep_their_order(spark):
    companies = spark.createDataFrame([("hot",)], "company string")
    got = company_index(companies, spark.createDataFrame(rows(), SCHEMA), 16).orderBy("part").collect()
    places = [int(p["final_url"].split("/")[3].split(" ")[0]) // 2 for r in got for p in json.loads(r["pages"])]
    assert places == sorted(places)


def test_no_pages_at_all(spark):
    companies = spark.createDataFrame([("a",)], "company string")
    got = company_index(companies, spark.createDataFrame([], SCHEMA)).collect()
    assert [(r["company"], r["part"], r["parts"], r["n_pages"], r["index"]) for r in got] == [("a", 0, 1, 0, '{"company":"a","pages":[]}')]
