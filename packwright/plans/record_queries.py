"""Queries over records: validators, predicates, flattening, scores and choices.

The driver's tables hold no such records, so each query carries literal ones, and its SQL lists the
rows that the rules give for them.
"""

from __future__ import annotations

import copy
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packwright.functions import facts
from packwright.operators import benchmark, enrichment, presets, validation

from .document_queries import values_sql
from .registry import query

COMPANY = {
    "source_record_id": "r1",
    "identity": {"canonical_name": "Acme", "domain": "acme.test", "website_url": "https://acme.test", "one_line_description": "Makes things"},
    "firmographics": {"primary_industry": "tools", "headquarters": {"city": "Oslo", "region": "", "country": "Norway"}},
    "offering": {"products_and_services": ["saws", "drills"]}, "commercial_signals": {}, "qualification": {"status": "not_scored", "icp_score": None},
    "outreach": {}, "quality": {"confidence_score": 0.5}, "source_evidence": [{"field": "x", "claim": "c"}],
}
CAPITAL = {"canonical_name": "Fund A", "type": "endowment", "verification": {"status": "verified", "is_capital_source": True}, "profile": {"address": "unknown"}, "capital_profile": {"sector_focus": ["a", "b"]}, "source_evidence": [{"claim": "c"}]}


def changed(record: dict, **members) -> dict:
    """The record with members replaced; two underscores stand for a dot, Ellipsis takes a member out."""
    out = copy.deepcopy(record)
    for path, value in members.items():
        *folders, last = path.split("__")
        at = out
        for f in folders:
            at = at[f]
        if value is ...:
            del at[last]
        else:
            at[last] = value
    return out


def literal(spark: SparkSession, *values) -> DataFrame:
    """n and v: the values as JSON, texts as they are."""
    return spark.createDataFrame([(i, v if isinstance(v, str) or v is None else json.dumps(v)) for i, v in enumerate(values)], "n long, v string")


def listed(*rows) -> list[tuple]:
    return list(enumerate(rows))


def numbered(*rows: tuple) -> list[tuple]:
    return [(i, *r) for i, r in enumerate(rows)]


@query(values_sql("n, errors", listed(
    "", "identity.website_url must be a non-empty string", "source_evidence must contain at least one item", "qualification.status is invalid; qualification.icp_score must be a number when ICP scoring is active",
    "qualification.icp_score must be null when status is not_scored", "output must be an object", "output must be an object", "", "source_record_id must be a non-empty string; outreach must be an object; source_evidence must contain at least one item",
)))
def v1_company_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = (
        COMPANY, changed(COMPANY, identity__website_url=" "), changed(COMPANY, source_evidence=[]), changed(COMPANY, qualification__status="great"), changed(COMPANY, qualification__icp_score=...), "no json", "[1]",
        changed(COMPANY, qualification={"status": "weak_fit", "icp_score": 12.5}), changed(COMPANY, source_record_id=7, outreach=[], source_evidence={}),
    )
    return literal(spark, *cases).select("n", F.array_join(validation.company_errors(F.col("v")), "; ").alias("errors"))


@query(values_sql("n, without_icp, with_icp", numbered(("", "qualification.status must not be not_scored when an ICP is provided"), ("qualification.status must be not_scored without an ICP; qualification.icp_score must be null without an ICP", ""), ("qualification.status must be not_scored without an ICP", ""))))
def v2_qualification_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = literal(spark, COMPANY, changed(COMPANY, qualification={"status": "strong_fit", "icp_score": 86}), changed(COMPANY, qualification={"status": "manual_review"}))
    joined = lambda icp: F.array_join(validation.qualification_errors(F.col("v"), icp), "; ")
    return rows.select("n", joined(False).alias("without_icp"), joined(True).alias("with_icp"))


@query(values_sql("n, errors, complete", numbered(("", True), ("profile must be an object", False), ("verification must be an object; source_evidence must contain at least one item", False), ("output must be an object", False))))
def v3_pf16_capital_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = literal(spark, CAPITAL, changed(CAPITAL, profile="x"), changed(CAPITAL, verification=..., source_evidence=[]), "{broken")
    return rows.select("n", F.array_join(validation.capital_errors(F.col("v")), "; ").alias("errors"), validation.is_complete_record(F.col("v")).alias("complete"))


def told(issues) -> F.Column:
    return F.array_join(F.transform(issues, lambda i: F.concat_ws(" ", i["severity"], i["path"])), "; ")


@query(values_sql("n, issues, high", numbered(("high evidence; medium confidence_score; medium type", 1), ("high evidence", 1), ("", 0))))
def v4_ag12_verification_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = {"is_capital_source": True, "confidence_score": 0.2, "type": "unknown", "evidence": [{"source_url": "ftp://x", "claim": "c", "source_type": "web"}, {"source_type": "source_record"}]}
    good = {"is_capital_source": True, "confidence_score": 0.9, "type": "pension", "evidence": [{"source_url": "https://x.test", "claim": "c", "source_type": "web"}]}
    issues = validation.verification_issues(F.col("v"))
    return literal(spark, bad, {"evidence": []}, good).select("n", told(issues).alias("issues"), validation.issue_counts(issues)["high"].alias("high"))


_FULL = {"domain": "www.acme.test", "verification": {"is_capital_source": True}, "capital_profile": {"commitment_size_min_usd": 5}, "source_evidence": [{"field_path": "verification", "claim": "see [a](b)", "source_url": "https://other.test/x", "source_type": "official_website"}]}


@query(values_sql("n, issues", listed("medium source_evidence.source_type; medium source_evidence.claim; medium capital_profile; high capital_profile.commitment_size", "high source_evidence; high verification.is_capital_source", "")))
def v5_j10_enrichment_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence is matched with the members that need it by path, in either direction."""
    cited = {"field_path": "capital_profile.commitment_size_min_usd", "claim": "c", "source_url": "https://sub.acme.test/", "source_type": "official_website"}
    good = changed(_FULL, source_evidence=[cited, {"field_path": "verification.status", "claim": "c", "source_type": "source_record"}])
    return literal(spark, _FULL, {"source_evidence": []}, good).select("n", told(validation.enrichment_issues(F.col("v"))).alias("issues"))


_LEAN = {"domain": "acme.test", "source_evidence": [{"field_path": "invests_in_vc_funds", "claim": "wealth management", "source_url": "https://acme.test", "source_type": "source_record"}], "evidence_urls": ["source_record", "x"], "invests_in_vc_funds": "no", "known_fund_investments": ["Portfolio Company 1", "Acme Fund II"], "logo_url": "logo.png", "aum_usd": 3, "embedding_text": "e" * 700}
_PLAIN = {"domain": "acme.test", "source_evidence": [{"field_path": "type", "claim": "c", "source_url": "https://acme.test", "source_type": "official_website"}], "evidence_urls": ["https://acme.test"], "type": "pension", "invests_directly": "unknown", "co_investment_appetite": "unknown", "embedding_text": "e" * 700}


@query(values_sql("n, issues", listed(
    "high evidence_urls; medium logo_url; medium known_fund_investments; high aum_usd; medium logo_url; low invests_in_vc_funds; medium invests_in_vc_funds; high known_fund_investments.0", "", "medium embedding_text",
    "low invests_in_vc_funds", "medium co_investors; high co_investors.0; high co_investors.1".replace("medium co_investors; ", ""),
)))
def v6_lean_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    denied = changed(_PLAIN, invests_in_vc_funds="no", source_evidence=[*_PLAIN["source_evidence"], {"field_path": "invests_in_vc_funds", "claim": "financial advisory that does not make fund commitments", "source_type": "source_record"}])
    cases = (_LEAN, _PLAIN, changed(_PLAIN, embedding_text="thin"), denied, changed(_PLAIN, co_investors=["Company12", "Technology_Company_3", "Twelve Co"]))
    return literal(spark, *cases).select("n", told(validation.lean_issues(F.col("v"))).alias("issues"))


@query(values_sql("n, placeholder", listed(True, True, True, True, True, False, False, False, True, False, True)))
def pf21_placeholder_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("Portfolio Company 1", "company", "Company12", "Technology_Company_3", "acme_tools_7", "Acme Tools 7", "unknown", "Acme", "real estate platform", "", "Firm 9")
    return literal(spark, *names).select("n", validation.is_placeholder_name(F.col("v")).alias("placeholder"))


@query(values_sql("n, material", listed(True, False, False, True, True, False, False, False, True, False)))
def pf19_material_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = ("x", "unknown", "No public information available", 0, False, None, [], ["none", "n/a"], {"a": {"b": ["not found", 3]}}, {"key only": ""})
    return literal(spark, *({"p": c} for c in cases)).select("n", validation.is_material(validation.Record(F.col("v")).json("p")).alias("material"))


@query(values_sql("n, advisory", listed(True, True, False, False, True)))
def pf22_advisory_wording(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = ("wealth management for families", "serving clients", "financial planning, and does not make fund investments", "invests in funds", "reports on client portfolios")
    return literal(spark, *claims).select("n", validation.is_advisory_wording(F.col("v")).alias("advisory"))


@query(values_sql("n, same, inside", numbered((True, True), (True, True), (False, False), (False, True), (False, False))))
def v7_domains_and_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(0, "https://www.acme.test/x", "profile.address"), (1, "http://sub.acme.test", "profile"), (2, "https://notacme.test", "profiles"), (3, "acme.test", "profile[0].address"), (4, "", None)]
    frame = spark.createDataFrame(rows, "n long, url string, path string")
    return frame.select("n", validation.same_domain(F.col("url"), F.lit("acme.test")).alias("same"), F.coalesce(validation.path_matches("profile", F.col("path")), F.lit(False)).alias("inside"))


@query(values_sql("n, object", listed('{"a": 1}', '{"a": 1}', '{"a": {"b": "}"}}', '{"a": "{"}', None, None, None)))
def n1_json_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = ('{"a": 1}', '```json\n{"a": 1}\n```', 'Here: {"a": {"b": "}"}} done', '{"a": "{"} and {x}', "```json\n{broken}\n```", "[1]", None)
    return literal(spark, *cases).select("n", validation.json_object(F.col("v")).alias("object"))


@query(values_sql("source_record_id, canonical_name, headquarters, products_and_services, icp_score, confidence_score, qualification_status, columns", [("r1", "Acme", "Oslo, Norway", "saws | drills", "", "0.5", "not_scored", 26)]))
def n3_flat_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = literal(spark, COMPANY).select(*validation.flatten_company(F.col("v")))
    return flat.withColumn("columns", F.lit(len(flat.columns)).cast("long")).select("source_record_id", "canonical_name", "headquarters", "products_and_services", "icp_score", "confidence_score", "qualification_status", "columns")


@query(values_sql("k, path, value", [("r", "a.b", "1"), ("r", "a.c.d.e.f.g.h", "deep"), ("r", "e", "[1,2]"), ("r", "f", ""), ("s", "x", "true")]))
def n4_flattened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects seven levels deep; arrays stay JSON."""
    deep = {"a": {"b": 1, "c": {"d": {"e": {"f": {"g": {"h": "deep"}}}}}}, "e": [1, 2], "f": None}
    rows = spark.createDataFrame([("r", json.dumps(deep)), ("s", '{"x": true}')], "k string, v string")
    return validation.flattened(rows, "k", "v")


_EMPTY = "# Scraped content for X\n\nNo usable company-site content was kept after cleanup.\nNo usable third-party content was kept after cleanup.\n" + "words " * 40


@query(values_sql("n, empty, legacy_empty", numbered((True, True), (True, False), (False, False), (True, False))))
def pf10_pf11_empty_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = literal(spark, _EMPTY, "short", "real content " * 20, "---\n" + "title: x\n" * 40 + "---\n# few | words")
    return rows.select("n", enrichment.is_empty_packet(F.col("v")).alias("empty"), enrichment.lacks_both_sources(F.col("v")).alias("legacy_empty"))


@query(values_sql("status, again, plain", [(0, True, False), (200, False, False), (400, False, True), (404, False, True), (408, True, False), (409, True, False), (422, False, True), (429, True, False), (503, True, False)]))
def pf14_pf15_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(s,) for s in (0, 200, 400, 404, 408, 409, 422, 429, 503)], "status long")
    return rows.select("status", enrichment.is_retryable(F.col("status")).alias("again"), enrichment.needs_plain_format(F.col("status")).alias("plain"))


def _models(spark: SparkSession) -> DataFrame:
    rows = [("gold", 100000, 2e-6, 8e-6, ["response_format"]), ("cheap", 100000, 1e-6, 1e-6, ["response_format"]), ("free", 100000, 0.0, 0.0, ["response_format"]), ("small", 10, 1e-6, 1e-6, ["response_format"]), ("bare", 100000, 1e-6, 1e-6, []), ("cheaper", 0, 5e-7, 1e-6, ["response_format"]), ("denied-x", 100000, 1e-7, 1e-7, ["response_format"])]
    frame = spark.createDataFrame(rows, "id string, context_length long, prompt double, completion double, params array<string>")
    return frame.withColumn("in_modalities", F.lit(None).cast("array<string>")).withColumn("out_modalities", F.lit(None).cast("array<string>"))


@query(values_sql("id, blended", [("cheaper", 0.55), ("cheap", 1.0)]))
def pf17_s4_candidate_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark.candidate_models(_models(spark), "gold", 1000, ("^denied",)).select("id", F.round("price.blended_90_10_per_1m", 6).alias("blended"))


@query(values_sql("position, id", [(0, "small"), (2, "gold")]))
def j8_listed_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark.listed_models(_models(spark), ["small", "none", "gold"]).select(F.col("position").cast("long").alias("position"), "id")


@query(values_sql("model, quality, context_length", [("gold", 0.9, 100000), ("lost", 0.5, 0)]))
def j7_scores_with_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = spark.createDataFrame([("gold", 0.9), ("lost", 0.5)], "model string, quality double")
    priced = _models(spark).select("id", "context_length", benchmark.prices(F.col("prompt"), F.col("completion"))["blended_90_10_per_1m"].alias("blended_90_10_per_1m"))
    return presets.with_models(scored, priced).select("model", "quality", F.coalesce("context_length", F.lit(0)).alias("context_length"))


@query(values_sql("n, score", listed(1.0, 0.76, 0.45, 0.0, 0.45, 0.0, 1.0 / 3)))
def sc1_score_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal, contained, filled where gold is unknown, missing, and shared tokens; ``n/a`` normalises to two letters, which are no unknown word."""
    rows = [("Acme Tools", "acme tools"), ("Acme Tools Ltd", "acme tools"), ("something", "unknown"), ("", "Acme"), ("n/a", None), ("abc", "xyz"), ("red saws", "blue saws")]
    frame = spark.createDataFrame(numbered(*rows), "n long, a string, g string")
    return frame.select("n", benchmark.score_value(F.col("a"), F.col("g"), "string").alias("score"))


@query(values_sql("n, score", listed(1.0, 0.4, 0.0)))
def sc6_schema_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(0, True, 9), (1, False, 5), (2, False, 0)], "n long, ok boolean, present long")
    return rows.select("n", benchmark.schema_shape(F.col("ok"), F.col("present"), 10).alias("score"))


@query(values_sql("agreement_score, known_field_recall, schema_shape_score, quality_score", [(0.825, 1.0, 1.0, 0.8565)]))
def sc7_case_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = spark.createDataFrame([("Acme Tools", "acme tools", 0.5, 0.7, ["a"], ["a", "b"])], "a string, g string, n double, m double, x array<string>, y array<string>")
    fields = [(F.col("a"), F.col("g"), "string", 2), (F.col("n"), F.col("m"), "number", 1), (F.col("x"), F.col("y"), "array", 1)]
    return frame.select(benchmark.case_quality(fields, F.lit(True), F.lit(1), 1, F.lit(True)).alias("q")).select("q.*")


@query(values_sql("case_id, agreement, fields", [("absent name", 0.8864, 10), ("overfilled", 0.9375, 10), ("same", 1.0, 10)]))
def ag11_sc9_weighted_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses against their gold records by the company preset's ten weighted fields (44 in all); one case has no gold."""
    actual = {"same": COMPANY, "absent name": changed(COMPANY, identity__canonical_name=...), "overfilled": changed(COMPANY, offering__target_customers=["builders"]), "no gold": COMPANY}
    responses = spark.createDataFrame([(k, json.dumps(v)) for k, v in actual.items()], "case_id string, raw string")
    gold = spark.createDataFrame([(k, json.dumps(COMPANY)) for k in actual if k != "no gold"], "case_id string, raw string")
    rows = presets.against_gold(responses, gold).withColumn("scores", presets.field_scores(F.col("raw"), F.col("gold_raw"), presets.preset("company")))
    return rows.select("case_id", presets.weighted_agreement(F.col("scores")).alias("agreement"), F.size("scores").cast("long").alias("fields"))


@query(values_sql("id, fields, weight, gate, flat", [("capital-source", 5, 29, 8, False), ("company", 10, 44, 10, True)]))
def u1_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The presets as objects; their weights are parameters of scores."""
    rows = [(p.id, len(p.fields), sum(w for *_, w in p.fields), len(p.gate), p.flat is not None) for p in presets.PRESETS.values()]
    return spark.createDataFrame(rows, "id string, fields long, weight long, gate long, flat boolean")


@query(values_sql("n, flag, number", numbered((True, 3.5), (False, 7.0), (True, 7.0), (True, 7.0))))
def pf18_coercions(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = spark.createDataFrame(numbered(("yes", "3.5"), ("0", "x"), ("", ""), (None, None)), "n long, f string, v string")
    return frame.select("n", presets.as_boolean(F.col("f"), True).alias("flag"), presets.as_number(F.col("v"), 7.0).alias("number"))


@query(values_sql("case_id, source_record_id, canonical_name, domain, website_url, logo_url, profile__address, profile__postal_code, profile__hq_location", [
    ("c1", "r9", "Fund A", "a.test", "https://a.test", "https://a.test/i.ico", "1 Main St", "12345", "1 Main St"), ("c2", "c2", "Packet Name", "p.test", "", "", "", "", ""),
]))
def v8_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    packet = {"entity": {"source_record_id": "r9", "company_name": "Entity", "domain": "a.test", "website_url": "https://a.test", "full_address": "1 Main St"}, "candidates": {"assets": {"logo_url": " ", "favicon_candidates": ["https://a.test/i.ico"]}, "address": {"postal_code": "12345", "full_address": "2 Other St"}}}
    rows = [("c1", "Packet Name", "p.test", json.dumps(changed(CAPITAL, domain="NULL")), json.dumps(packet)), ("c2", "Packet Name", "p.test", "{}", "{}")]
    return presets.with_defaults(spark.createDataFrame(rows, "case_id string, company_name string, domain string, raw string, packet_json string"))


@query(values_sql("case_id, parse_ok, cost_usd, canonical_name, type, verification_status, is_capital_source, sector_focus, columns", [("c1", True, 0.001235, "Fund A", "endowment", "verified", "true", "a|b", 32), ("c2", False, 0.0, "", "", "", "", "", 32)]))
def c5_summary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("c1", "A", "a.test", True, "m", 0.0012345678, 12, 5, 6, "j", "r", "p", "", json.dumps(CAPITAL)), ("c2", "B", "b.test", False, "m", 0.0, 0, 0, 0, "", "r", "p", "boom", None)]
    frame = spark.createDataFrame(rows, "case_id string, company_name string, domain string, ok boolean, model string, cost_usd double, latency_ms long, prompt_tokens long, completion_tokens long, json_file string, response_file string, packet_path string, error string, raw string")
    wide = presets.summary_rows(frame)
    return wide.withColumn("columns", F.lit(len(wide.columns)).cast("long")).select("case_id", "parse_ok", "cost_usd", "canonical_name", "type", "verification_status", "is_capital_source", "sector_focus", "columns")


@query(values_sql("n, mails", listed("a@b.co", "x@d.org %y@e.net", "", "", "first.last@sub.site.io")))
def f10_email_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placeholder domains go; an address may start right where the one before ended; long runs cost one look each."""
    cases = ("A@B.co and me@example.com", "x@d.org%y@e.net", "z" * 200_000, "no at all", "write First.Last@sub.site.io, or me@yourdomain.com")
    return literal(spark, *cases).select("n", F.array_join(facts.emails(F.col("v")), " ").alias("mails"))
