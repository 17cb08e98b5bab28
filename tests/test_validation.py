import copy
import json
import re

import pytest
from pyspark.sql import functions as F

from packwright.operators import benchmark, enrichment, source, validation

COMPANY = {
    "source_record_id": "r1",
    "identity": {"canonical_name": "Acme", "domain": "acme.test", "website_url": "https://acme.test", "one_line_description": "Makes things"},
    "firmographics": {"primary_industry": "tools", "headquarters": {"city": "Oslo", "region": "", "country": "Norway"}},
    "offering": {"products_and_services": ["a", "b"]}, "commercial_signals": {}, "qualification": {"status": "not_scored", "icp_score": None},
    "outreach": {}, "quality": {"confidence_score": 0.5}, "source_evidence": [{"field": "x", "claim": "c"}],
}
CAPITAL = {"verification": {}, "profile": {}, "capital_profile": {}, "source_evidence": [{"claim": "c"}]}


def changed(record, path, value=...):
    out = copy.deepcopy(record)
    *folders, last = path.split(".")
    at = out
    for f in folders:
        at = at[f]
    if value is ...:
        del at[last]
    else:
        at[last] = value
    return out


def evaluate(spark, expression, *values):
    """The expression over a column ``v`` of texts."""
    frame = spark.createDataFrame([(i, v if isinstance(v, str) or v is None else json.dumps(v)) for i, v in enumerate(values)], "i int, v string")
    return [r["x"] for r in frame.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


def test_company_record(spark):
    good, no_site, no_evidence, wrong_status, absent_score, text, array = evaluate(
        spark, validation.company_errors, COMPANY, changed(COMPANY, "identity.website_url", " "), changed(COMPANY, "source_evidence", []), changed(COMPANY, "qualification.status", "great"), changed(COMPANY, "qualification.icp_score"), "no json", "[1]"
    )
    assert good == []
    assert no_site == ["identity.website_url must be a non-empty string"]
    assert no_evidence == ["source_evidence must contain at least one item"]
    assert wrong_status == ["qualification.status is invalid", "qualification.icp_score must be a number when ICP scoring is active"]
    assert absent_score == ["qualification.icp_score must be null when status is not_scored"]
    assert text == array == ["output must be an object"]


def test_qualification_mode(spark):
    scored = changed(changed(COMPANY, "qualification.status", "strong_fit"), "qualification.icp_score", 86)
    assert [len(x) for x in evaluate(spark, lambda v: validation.qualification_errors(v, False), COMPANY, scored)] == [0, 2]
    assert [len(x) for x in evaluate(spark, lambda v: validation.qualification_errors(v, True), COMPANY, scored)] == [1, 0]
    assert evaluate(spark, validation.company_errors, scored) == [[]]


def test_capital_record(spark):
    assert evaluate(spark, validation.capital_errors, CAPITAL, changed(CAPITAL, "profile", "x")) == [[], ["profile must be an object"]]
    assert evaluate(spark, validation.is_complete_record, CAPITAL, changed(CAPITAL, "source_evidence", [])) == [True, False]


def test_flat_company(spark):
    row = spark.createDataFrame([(json.dumps(COMPANY),)], "v string").select(*validation.flatten_company(F.col("v"))).first()
    assert len(row) == 26 and row["headquarters"] == "Oslo, Norway" and row["products_and_services"] == "a | b" and row["confidence_score"] == "0.5" and row["icp_score"] == ""


def test_generic_flatten(spark):
    frame = spark.createDataFrame([("k", json.dumps({"a": {"b": 1, "c": {"d": "x"}}, "e": [1, 2], "f": None}))], "key string, v string")
    assert {(r["path"], r["value"]) for r in validation.flattened(frame, "key", "v").collect()} == {("a.b", "1"), ("a.c.d", "x"), ("e", "[1,2]"), ("f", "")}


def test_json_object(spark):
    cases = ['{"a": 1}', '```json\n{"a": 1}\n```', 'Here: {"a": {"b": "}"}} done', '{"a": "{"} and {x}', "```json\n{broken}\n```", "[1]", None]
    assert [x and json.loads(x) for x in evaluate(spark, validation.json_object, *cases)] == [{"a": 1}, {"a": 1}, {"a": {"b": "}"}}, {"a": "{"}, None, None, None]


@pytest.mark.parametrize(("value", "says"), [("x", True), ("unknown", False), ("No public information available", False), (0, True), (False, True), (None, False), ([], False), (["none", "n/a"], False), ({"a": {"b": ["not found", 3]}}, True), ({"key only": ""}, False)])
def test_material_values(spark, value, says):
    frame = spark.createDataFrame([(json.dumps({"p": value}),)], "v string")
    assert frame.select(validation.is_material(validation.Record(F.col("v")).json("p")).alias("x")).first()["x"] is says


def test_verification_issues(spark):
    record = {"is_capital_source": True, "confidence_score": 0.2, "type": "unknown", "evidence": [{"source_url": "ftp://x", "claim": "c", "source_type": "web"}, {"source_type": "source_record"}]}
    (found, none) = evaluate(spark, validation.verification_issues, record, {"evidence": []})
    assert [(i["severity"], i["path"]) for i in found] == [("high", "evidence"), ("medium", "confidence_score"), ("medium", "type")]
    assert [i["detail"] for i in none] == ["Verification has no evidence."]


def test_enrichment_issues(spark):
    record = {"domain": "www.acme.test", "verification": {"is_capital_source": True}, "capital_profile": {"commitment_size_min_usd": 5}, "source_evidence": [
        {"field_path": "verification", "claim": "see [a](b)", "source_url": "https://other.test/x", "source_type": "official_website"}]}
    (found,) = evaluate(spark, validation.enrichment_issues, record)
    assert [(i["severity"], i["path"]) for i in found] == [("medium", "source_evidence.source_type"), ("medium", "source_evidence.claim"), ("medium", "capital_profile"), ("high", "capital_profile.commitment_size")]


def test_lean_issues(spark):
    record = {"domain": "acme.test", "source_evidence": [{"field_path": "invests_in_vc_funds", "claim": "wealth management", "source_url": "https://acme.test", "source_type": "source_record"}], "evidence_urls": ["source_record", "x"], "invests_in_vc_funds": "no",
              "known_fund_investments": ["Portfolio Company 1", "Acme Fund II"], "logo_url": "logo.png", "aum_usd": 3, "embedding_text": "e" * 700}
    (found,) = evaluate(spark, validation.lean_issues, record)
    assert [(i["severity"], i["path"]) for i in found] == [("high", "evidence_urls"), ("medium", "logo_url"), ("medium", "known_fund_investments"), ("high", "aum_usd"), ("medium", "logo_url"), ("low", "invests_in_vc_funds"), ("medium", "invests_in_vc_funds"), ("high", "known_fund_investments.0")]
    counts = spark.createDataFrame([(json.dumps(record),)], "v string").select(validation.issue_counts(validation.lean_issues(F.col("v"))).alias("c")).first()["c"]
    assert (counts["high"], counts["medium"], counts["low"]) == (3, 4, 1)


def test_retry_classes(spark):
    frame = spark.createDataFrame([(s,) for s in (0, 429, 503, 409, 400, 200)], "s int")
    assert [r[0] for r in frame.select(enrichment.is_retryable(F.col("s"))).collect()] == [True, True, True, True, False, False]


def test_empty_packets(spark):
    both = "# Scraped content for X\n\nNo usable company-site content was kept after cleanup.\nNo usable third-party content was kept after cleanup.\n" + "words " * 40
    assert evaluate(spark, enrichment.is_empty_packet, both, "short", "real content " * 20) == [True, True, False]


def test_gate_ignores_metadata(spark):
    terms = {"fund/funds": r"(?<![0-9a-z_])funds?(?![0-9a-z_])"}
    frame = spark.createDataFrame([(1, "Company: Fund Co\ntext"), (2, "Our Funds grow"), (3, "funding")], "case_id int, markdown string")
    assert [r["route"] for r in enrichment.routed(frame, terms).orderBy("case_id").collect()] == ["no_keyword", "pass", "no_keyword"]


def test_input_contract(spark):
    frame = spark.createDataFrame([(0, "a", "A", "a.test", "https://a.test", "gold"), (1, " ", "B", "b.test", "", "x")], "row_index long, source_record_id string, company_name string, domain string, website_url string, account_tier string")
    with pytest.raises(ValueError, match="row 3: source_record_id is required\nrow 3: website_url is required"):
        source.check_contract(frame)
    assert source.entities(frame).orderBy("row_index").first()["source_context"] == {"account_tier": "gold"}
    with pytest.raises(ValueError, match="no rows"):
        source.check_contract(frame.limit(0))


def test_model_choice(spark):
    frame = spark.createDataFrame(
        [("gold", 100000, 2e-6, 8e-6, ["response_format"]), ("cheap", 100000, 1e-6, 1e-6, ["response_format"]), ("free", 100000, 0.0, 0.0, ["response_format"]), ("small", 10, 1e-6, 1e-6, ["response_format"]), ("bare", 100000, 1e-6, 1e-6, [])],
        "id string, context_length long, prompt double, completion double, params array<string>",
    ).withColumn("in_modalities", F.lit(None).cast("array<string>")).withColumn("out_modalities", F.lit(None).cast("array<string>"))
    assert [r["id"] for r in benchmark.candidate_models(frame, "gold", 1000).collect()] == ["cheap"]
    assert [r["id"] for r in benchmark.listed_models(frame, ["small", "none", "gold"]).collect()] == ["small", "gold"]


def test_case_quality(spark):
    frame = spark.createDataFrame([("Acme Tools", "acme tools", 0.5, 0.7, ["a"], ["a", "b"])], "a string, g string, n double, m double, x array<string>, y array<string>")
    fields = [(F.col("a"), F.col("g"), "string", 2), (F.col("n"), F.col("m"), "number", 1), (F.col("x"), F.col("y"), "array", 1)]
    q = frame.select(benchmark.case_quality(fields, F.lit(True), F.lit(1), 1, F.lit(True)).alias("q")).first()["q"]
    assert q["agreement_score"] == 0.825 and q["known_field_recall"] == 1.0 and q["quality_score"] == pytest.approx(0.825 * 0.82 + 0.12 + 0.06, abs=1e-4)


def test_defaults_and_cache(spark):
    frame = spark.createDataFrame([("unknown", "", "B"), ("A", "X", "Y"), (None, None, None)], "v string, c1 string, c2 string")
    assert [r[0] for r in frame.select(enrichment.filled_default(F.col("v"), F.col("c1"), F.col("c2"))).collect()] == ["B", "A", None]
    cases, cache = spark.createDataFrame([(1,), (2,)], "case_id int"), spark.createDataFrame([(1, "r")], "case_id int, raw string")
    assert [r[0] for r in enrichment.to_call(cases, cache).collect()] == [2] and enrichment.to_call(cases, cache, True).count() == 2


def test_gate_terms_by_their_first_letters(spark):
    terms = enrichment.allocator_terms()
    forms = {label: enrichment.letters_first(pattern) for label, pattern in terms.items()}
    assert all(first for first, _ in forms.values())
    assert forms["LP"] == ("lp", "lp(?<![0-9a-z_]lp)s?(?![0-9a-z_])") and forms["asset"][0] == "asset"
    for other in ("a|b", "(?<![0-9a-z_])(?:ab|cd)(?![0-9a-z_])", "(?<![0-9a-z_])(?:ab)|(?:cd)(?![0-9a-z_])", "(?<![0-9a-z_])(?:abc{0})(?![0-9a-z_])", "(?<![0-9a-z_])(?:a?b)(?![0-9a-z_])"):
        assert enrichment.letters_first(other) == ("", other)
    words = ["investor", "reinvest", "LP", "help lpsx", "lps", "x_fund", "funds", "fund-of-funds", "co invests", "assets", "assetss", "first time", "LP secondaries", "OCIO", None, "", "nothing, Company: capital", "company: capital", "co-investor"]
    rows = spark.createDataFrame([(w,) for w in words], "t string").select("t", enrichment.gate_labels(F.col("t"), terms).alias("labels")).collect()
    for r in rows:
        text = "" if (r["t"] or "").startswith("company:") else (r["t"] or "").lower()
        assert r["labels"] == [label for label, p in terms.items() if re.search(p, text)], r["t"]
