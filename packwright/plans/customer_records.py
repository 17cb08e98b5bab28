"""Validators, predicates, flattening and scores over records that Spark makes from the given tables.

Customers stand for companies, parts for models and numbers, events for responses; which member is missing or
wrong follows from the row's own columns, and so it does in the SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packwright.functions import facts
from packwright.operators import benchmark, enrichment, presets, source, validation

from .registry import dealt, query, table

_NONE = "list_filter({x}, lambda m: m IS NOT NULL)"
_JOINED = "array_to_string(list_filter({x}, lambda m: m IS NOT NULL), '; ')"


def key_() -> Column:
    return F.col("c_custkey")


def company_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """c_custkey, c_name, segment and ``raw``: a company record of each customer."""
    some = lambda n, c: F.when(key_() % n == 0, None).otherwise(c)
    status = F.element_at(F.array(*map(F.lit, ("not_scored", "strong_fit", "great", "weak_fit"))), (key_() % 4 + 1).cast("int"))
    score = F.when(key_() % 3 == 0, F.lit("null")).otherwise(F.col("c_nationkey").cast("string"))
    json = lambda c: F.to_json(F.struct(c.alias("x")))
    text = lambda c: F.expr("substring(j, 6, length(j) - 6)") if c is None else F.regexp_replace(json(c), r'^\{"x":|\}$', "")
    parts = [
        F.lit('{"source_record_id":"r'), key_().cast("string"), F.lit('","identity":{"canonical_name":'), text(F.col("c_name")), F.lit(',"domain":"c.test","website_url":"'), F.when(key_() % 5 == 0, " ").otherwise("https://c.test"), F.lit('","one_line_description":"d"},'),
        F.lit('"firmographics":{"primary_industry":'), text(F.col("c_mktsegment")), F.lit(',"headquarters":{"city":"Oslo","region":"","country":"Norway"}},"offering":{"products_and_services":["saws","'), key_().cast("string"), F.lit('"],"target_customers":'),
        F.when(key_() % 6 == 1, '["builders"]').otherwise("[]"), F.lit('},"commercial_signals":'), F.when(key_() % 7 == 0, "[]").otherwise("{}"), F.lit(',"qualification":{"status":"'), status, F.lit('","icp_score":'), score, F.lit('},"outreach":{},"quality":{"confidence_score":0.5},"source_evidence":'),
        F.when(key_() % 11 == 0, "[]").otherwise('[{"field":"x"}]'), F.lit("}"),
    ]
    raw = F.when(key_() % 13 == 0, "no json").otherwise(F.concat(*parts))
    return dealt(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey", raw.alias("raw"))


_STATUS = "['not_scored', 'strong_fit', 'great', 'weak_fit'][c_custkey % 4 + 1]"
_SCORED = "c_custkey % 3 <> 0"


@query(f"""SELECT c_custkey, CASE WHEN c_custkey % 13 = 0 THEN 'output must be an object' ELSE {_JOINED.format(x=f"""[CASE WHEN c_custkey % 7 = 0 THEN 'commercial_signals must be an object' END, CASE WHEN c_custkey % 11 = 0 THEN 'source_evidence must contain at least one item' END,
 CASE WHEN c_custkey % 5 = 0 THEN 'identity.website_url must be a non-empty string' END, CASE WHEN {_STATUS} = 'great' THEN 'qualification.status is invalid' END,
 CASE WHEN {_STATUS} = 'not_scored' AND {_SCORED} THEN 'qualification.icp_score must be null when status is not_scored' END, CASE WHEN {_STATUS} <> 'not_scored' AND NOT ({_SCORED}) THEN 'qualification.icp_score must be a number when ICP scoring is active' END]""")} END AS errors FROM customer""")
def v1_customer_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return company_records(spark, sf_dir).select("c_custkey", F.array_join(validation.company_errors(F.col("raw")), "; ").alias("errors"))


@query(f"""SELECT c_custkey, {_JOINED.format(x=f"[CASE WHEN {_STATUS} <> 'not_scored' THEN 'qualification.status must be not_scored without an ICP' END, CASE WHEN {_SCORED} THEN 'qualification.icp_score must be null without an ICP' END]")} AS without_icp,
 CASE WHEN {_STATUS} = 'not_scored' THEN 'qualification.status must not be not_scored when an ICP is provided' ELSE '' END AS with_icp FROM customer WHERE c_custkey % 13 <> 0""")
def v2_customer_qualification(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = lambda icp: F.array_join(validation.qualification_errors(F.col("raw"), icp), "; ")
    return company_records(spark, sf_dir).where("raw <> 'no json'").select("c_custkey", joined(False).alias("without_icp"), joined(True).alias("with_icp"))


@query("""SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_custkey % 4 = 0 THEN 'verification must be an object' END, CASE WHEN c_custkey % 5 = 0 THEN 'profile must be an object' END, CASE WHEN c_custkey % 3 = 0 THEN 'source_evidence must contain at least one item' END], lambda m: m IS NOT NULL), '; ') AS errors,
 c_custkey % 4 <> 0 AND c_custkey % 5 <> 0 AND c_custkey % 3 <> 0 AS complete FROM customer""")
def v3_pf16_customer_capital(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as capital sources; the section that is no object has the customer's name as its value."""
    name = F.to_json(F.array("c_name"))
    raw = F.concat(F.lit('{"verification":'), F.when(key_() % 4 == 0, name).otherwise("{}"), F.lit(',"profile":'), F.when(key_() % 5 == 0, name).otherwise("{}"), F.lit(',"capital_profile":{},"source_evidence":'), F.when(key_() % 3 == 0, "[]").otherwise(name), F.lit("}"))
    rows = dealt(spark, sf_dir, "customer").select("c_custkey", raw.alias("raw"))
    return rows.select("c_custkey", F.array_join(validation.capital_errors(F.col("raw")), "; ").alias("errors"), validation.is_complete_record(F.col("raw")).alias("complete"))


@query("""WITH h AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)), '^www\\.', '') ELSE '' END AS host FROM pages)
SELECT page_id, host <> '' AND (host = 'example.com' OR host LIKE '%.example.com') AS same, page_id % 4 < 3 AS inside FROM h""")
def v7_page_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.element_at(F.array(*map(F.lit, ("profile.address", "profile[0].x", "profile", "profiles.y"))), (F.col("page_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", validation.same_domain(F.col("url"), F.lit("example.com")).alias("same"), validation.path_matches("profile", path).alias("inside"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN true WHEN p_partkey % 6 = 5 THEN true ELSE p_partkey % 6 IN (1, 3) END AS material FROM part""")
def pf19_part_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name, a size, words that say nothing, an empty list, a list of one that says something, a nested one."""
    n, name = F.col("p_partkey") % 6, F.to_json(F.array("p_name"))
    value = F.when(n == 0, F.col("p_size").cast("string")).when(n == 1, name).when(n == 2, '"No public information available"').when(n == 3, F.concat(F.lit('["none",'), F.col("p_size").cast("string"), F.lit("]"))).when(n == 4, '["n/a","unknown"]').otherwise(F.concat(F.lit('{"a":{"b":'), name, F.lit("}}")))
    raw = F.concat(F.lit('{"p":'), value, F.lit("}"))
    return table(spark, sf_dir, "part").select("p_partkey", validation.is_material(validation.Record(raw).json("p")).alias("material"))


@query("""SELECT event_id, CASE WHEN event_id % 5 = 3 THEN NULL WHEN event_id % 5 = 4 THEN NULL ELSE json_extract_string(props, '$.k') END AS k FROM events""")
def n1_event_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Props as responses: bare, fenced, inside prose, in a broken fence, as an array."""
    n, props = F.col("event_id") % 5, F.col("props")
    raw = F.when(n == 0, props).when(n == 1, F.concat(F.lit("```json\n"), props, F.lit("\n```"))).when(n == 2, F.concat(F.lit('Here it is: '), props, F.lit(' and "}" after'))).when(n == 3, F.concat(F.lit("```json\n{"), props, F.lit("broken\n```"))).otherwise(F.concat(F.lit("["), F.lit("1"), F.lit("]")))
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(validation.json_object(raw), "$.k").alias("k"))


@query("""SELECT 'r' || c_custkey AS source_record_id, c_name AS canonical_name, 'Oslo, Norway' AS headquarters, 'saws | ' || c_custkey AS products_and_services, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE CAST(c_nationkey AS VARCHAR) END AS icp_score, '0.5' AS confidence_score, CAST(26 AS BIGINT) AS columns FROM customer WHERE c_custkey % 13 <> 0""")
def n3_flat_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = company_records(spark, sf_dir).where("raw <> 'no json'").select(*validation.flatten_company(F.col("raw")))
    return flat.withColumn("columns", F.lit(len(flat.columns)).cast("long")).select("source_record_id", "canonical_name", "headquarters", "products_and_services", "icp_score", "confidence_score", "columns")


@query("""SELECT CAST(event_id AS VARCHAR) AS k, unnest(['event.type', 'event.props.k', 'list', 'none']) AS path, unnest([event_type, json_extract_string(props, '$.k'), '[' || event_id || ']', '']) AS value FROM events""")
def n4_flat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit('{"event":{"type":"'), F.col("event_type"), F.lit('","props":'), F.col("props"), F.lit('},"list":['), F.col("event_id").cast("string"), F.lit('],"none":null}'))
    return validation.flattened(table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("k"), raw.alias("v")), "k", "v")


@query("""SELECT event_id, s IN (0, 408, 409, 429) OR s >= 500 AS again, s IN (400, 404, 422) AS plain FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN 500 + event_id % 20 ELSE 400 + event_id % 31 END AS s FROM events)""")
def pf14_pf15_event_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "error", 500 + F.col("event_id") % 20).otherwise(400 + F.col("event_id") % 31)
    return table(spark, sf_dir, "events").select("event_id", enrichment.is_retryable(status).alias("again"), enrichment.needs_plain_format(status).alias("plain"))


def part_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a catalogue of models."""
    key = F.col("p_partkey")
    params = F.when(key % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("response_format")))
    kinds = F.when(key % 9 == 0, F.array(F.lit("image"))).otherwise(F.array(F.lit("text"), F.lit("image")))
    return table(spark, sf_dir, "part").select(F.concat(F.when(key % 10 == 0, "denied-").otherwise("m-"), key.cast("string")).alias("id"), (F.col("p_size") * 100).cast("long").alias("context_length"), (F.col("p_size") / 1e6).alias("prompt"), (key % 50 / 1e6).alias("completion"), params.alias("params"), kinds.alias("in_modalities"), F.array(F.lit("text")).alias("out_modalities"))


_MODELS = "SELECT CASE WHEN p_partkey % 10 = 0 THEN 'denied-' ELSE 'm-' END || p_partkey AS id, p_partkey, p_size * 100 AS context_length, p_size / 1e6::DOUBLE * 1e6 * 0.9 + p_partkey % 50 / 1e6::DOUBLE * 1e6 * 0.1 AS blended FROM part"


@query(f"""WITH m AS ({_MODELS}) SELECT id, round(blended, 6) AS blended FROM m WHERE p_partkey % 4 <> 0 AND p_partkey % 9 <> 0 AND p_partkey % 10 <> 0 AND (context_length = 0 OR context_length >= 1000) AND blended <> 0 AND round(blended, 9) < (SELECT round(blended, 9) FROM m WHERE id = 'm-7')""")
def pf17_s4_part_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark.candidate_models(part_models(spark, sf_dir), "m-7", 1000, ("^denied",)).select("id", F.round("price.blended_90_10_per_1m", 6).alias("blended"))


@query(f"""WITH m AS ({_MODELS}) SELECT CAST(position AS BIGINT) AS position, m.id FROM (VALUES (0, 'm-7'), (1, 'absent'), (2, 'denied-20'), (3, 'm-1')) AS w(position, id) JOIN m USING (id)""")
def j8_listed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark.listed_models(part_models(spark, sf_dir), ["m-7", "absent", "denied-20", "m-1"]).select(F.col("position").cast("long").alias("position"), "id")


@query(f"""WITH m AS ({_MODELS}) SELECT o_orderkey, coalesce(context_length, 0) AS context_length FROM orders LEFT JOIN m ON m.id = 'm-' || (o_custkey % 300)""")
def j7_orders_with_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as scores of models, some of which the catalogue lacks."""
    priced = part_models(spark, sf_dir).select("id", "context_length", benchmark.prices(F.col("prompt"), F.col("completion"))["blended_90_10_per_1m"].alias("blended_90_10_per_1m"))
    scored = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("m-"), (F.col("o_custkey") % 300).cast("string")).alias("model"))
    return presets.with_models(scored, priced).select("o_orderkey", F.coalesce("context_length", F.lit(0)).cast("long").alias("context_length"))


@query("""SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.76 WHEN 2 THEN 0.45 WHEN 3 THEN 0.0 ELSE CASE WHEN lower(c_mktsegment) = 'building' THEN 0.76 ELSE 1 / 3.0::DOUBLE END END::DOUBLE AS score FROM customer""")
def sc1_customer_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names against themselves, with an addition, where gold is unknown, where nothing is given, and a segment against another."""
    n = key_() % 5
    actual = F.when(n == 0, F.upper("c_name")).when(n == 1, F.concat("c_name", F.lit(" Ltd"))).when(n == 3, "").when(n == 4, F.concat("c_mktsegment", F.lit(" tools"))).otherwise(F.col("c_name"))
    gold = F.when(n == 2, "unknown").when(n == 4, F.lit("building tools")).otherwise(F.col("c_name"))
    gold = F.when((n == 4) & (F.lower("c_mktsegment") == "building"), F.lit("building tools of steel")).otherwise(gold)
    return table(spark, sf_dir, "customer").select("c_custkey", benchmark.score_value(actual, gold, "string").alias("score"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 1.0::DOUBLE ELSE 0.8::DOUBLE * (p_size % 11) / 10::DOUBLE END AS score FROM part")
def sc6_part_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", benchmark.schema_shape(F.col("p_partkey") % 3 == 0, F.col("p_size") % 11, 10).alias("score"))


@query("""WITH s AS (SELECT p_partkey, CASE WHEN p_size = 25 THEN 1.0 ELSE greatest(0.0, 1 - abs(p_size - 25) / 25.0) END::DOUBLE AS n, CASE WHEN p_partkey % 2 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS t, p_partkey % 5 <> 0 AS parsed FROM part), q AS (SELECT *, (n + 3 * t) / 4 AS a FROM s)
SELECT p_partkey, floor(a * 1e4 + 0.5) / 1e4 AS agreement_score, CASE WHEN parsed THEN floor((a * 0.82 + 0.12 + 0.06) * 1e4 + 0.5) / 1e4 ELSE 0.0 END AS quality_score FROM q""")
def sc7_part_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number against 25 and a brand against itself or nothing like it."""
    key = F.col("p_partkey")
    fields = [(F.col("p_size").cast("double"), F.lit(25.0), "number", 1), (F.col("p_brand"), F.when(key % 2 == 0, F.col("p_brand")).otherwise("zzz"), "string", 3)]
    rows = table(spark, sf_dir, "part").select("p_partkey", benchmark.case_quality(fields, F.lit(True), F.lit(1), 1, key % 5 != 0).alias("q"))
    return rows.select("p_partkey", "q.agreement_score", "q.quality_score")


@query("""SELECT c_custkey, floor(CASE c_custkey % 6 WHEN 1 THEN (44 - 5 * 0.55) / 44.0 ELSE CASE c_custkey % 5 WHEN 2 THEN 39 / 44.0 ELSE 1.0 END END::DOUBLE * 1e4 + 0.5) / 1e4 AS agreement, CAST(10 AS BIGINT) AS fields FROM customer WHERE c_custkey % 13 <> 0 AND (c_custkey % 6 <> 1 OR c_custkey % 5 <> 2)""")
def ag11_sc9_customer_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records against gold ones that have no target customers, and some another industry's name for the company's."""
    rows = company_records(spark, sf_dir).where("raw <> 'no json' AND (c_custkey % 6 <> 1 OR c_custkey % 5 <> 2)")
    gold = rows.select(key_().alias("case_id"), F.regexp_replace("raw", r'"target_customers":\["builders"\]', '"target_customers":[]').alias("raw"))
    actual = F.when(key_() % 5 == 2, F.regexp_replace("raw", r'"canonical_name":"[^"]*"', '"canonical_name":"unknown"')).otherwise(F.col("raw"))
    both = presets.against_gold(rows.select(key_().alias("case_id"), actual.alias("raw")), gold).withColumn("scores", presets.field_scores(F.col("raw"), F.col("gold_raw"), presets.preset("company")))
    return both.select(F.col("case_id").alias("c_custkey"), presets.weighted_agreement(F.col("scores")).alias("agreement"), F.size("scores").cast("long").alias("fields"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true ELSE event_type IN ('on', 'yes') END AS flag, CASE event_id % 3 WHEN 0 THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) + 0.5 ELSE 7.0 END::DOUBLE AS number FROM events""")
def pf18_event_coercions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = F.col("event_id"), F.get_json_object("props", "$.k")
    flag = F.when(n % 4 == 0, " Yes ").when(n % 4 == 1, "0").when(n % 4 == 2, "").otherwise(F.col("event_type"))
    number = F.when(n % 3 == 0, F.concat(k, F.lit(".5"))).when(n % 3 == 1, F.col("event_type")).otherwise("")
    return table(spark, sf_dir, "events").select("event_id", presets.as_boolean(flag, True).alias("flag"), presets.as_number(number, 7.0).alias("number"))


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'CA' WHEN 1 THEN 'NY' ELSE upper(substr(c_mktsegment, 1, 2)) END AS code FROM customer WHERE c_custkey % 3 < 2""")
def f13_customer_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where("c_custkey % 3 < 2").select("c_custkey", facts.state_code(F.when(key_() % 3 == 0, " california").otherwise("New York")).alias("code"))


@query("""SELECT c_custkey, 'Springfield' AS city, CASE WHEN c_custkey % 2 = 0 THEN 'IL' ELSE 'Ontario' END AS state, CASE WHEN c_custkey % 2 = 0 THEN 'United States' ELSE '' END AS country FROM customer""")
def f16_customer_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.concat(key_().cast("string"), F.lit(" Main St, Springfield, "))
    address = F.when(key_() % 2 == 0, F.concat(head, F.lit("IL, 62701, United States"))).otherwise(F.concat(head, F.lit("Ontario, K1A 0B1")))
    return table(spark, sf_dir, "customer").select("c_custkey", facts.location_parts(address).alias("p")).select("c_custkey", "p.city", "p.state", "p.country")


@query("""WITH a AS (SELECT c_custkey, c_custkey || ' Main Street, Suite 5 Springfield, Illinois ' || (10000 + c_custkey % 80000) AS place, CAST(10000 + c_custkey % 80000 AS VARCHAR) AS code FROM customer)
SELECT c_custkey, code, place AS street, place || ', Springfield, Illinois, ' || code || ', US' AS full_address, 'scraped_site_text' AS source, 'high' AS confidence FROM a WHERE c_custkey BETWEEN 1 AND 99999""")
def f12_f15_customer_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = (10000 + key_() % 80000).cast("string")
    t = F.concat(key_().cast("string"), F.lit(" Main Street, Suite 5 Springfield, Illinois "), code, F.lit(" Phone: 1"))
    rows = table(spark, sf_dir, "customer").where("c_custkey BETWEEN 1 AND 99999").select("c_custkey", t.alias("t"))
    city, state, country = F.lit("Springfield"), F.lit("Illinois"), F.lit("US")
    found = rows.select("c_custkey", facts.postal_code(F.col("t"), city, state).alias("code"), facts.street_address(F.col("t")).alias("street"))
    choice = facts.address_choice(F.col("street"), F.col("code"), city, state, country)
    return found.select("c_custkey", "code", "street", choice.alias("a")).select("c_custkey", "code", "street", "a.full_address", "a.source", "a.confidence")


@query("""WITH p AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin FROM pages WHERE regexp_matches(url, '^https?://[a-z0-9.-]+/')), i AS (SELECT *, CASE WHEN page_id % 3 = 0 THEN origin || '/i.ico' ELSE origin || '/favicon.ico' END AS icon FROM p)
SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'http://own.test/' || page_id WHEN page_id % 2 = 0 THEN origin || '/l.png' ELSE icon END AS logo_url, CASE WHEN page_id % 4 = 0 THEN 'csv.logo_url' WHEN page_id % 2 = 0 THEN 'scraped_site_asset' ELSE 'favicon_fallback' END AS logo_source,
 icon AS favicon_url, CASE WHEN page_id % 3 = 0 THEN 'scraped_icon_link' ELSE 'origin_favicon_fallback' END AS favicon_source FROM i""")
def f17_page_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, origin = F.col("page_id"), F.regexp_extract("url", "^(https?://[^/?#]+)", 1)
    own, logo, icon = F.when(n % 4 == 0, F.concat(F.lit("http://own.test/"), n.cast("string"))), F.when(n % 2 == 0, F.concat(origin, F.lit("/l.png"))), F.when(n % 3 == 0, F.concat(origin, F.lit("/i.ico")))
    rows = table(spark, sf_dir, "pages").where(F.col("url").rlike("^https?://[a-z0-9.-]+/"))
    return rows.select("page_id", source.asset_choice(own, logo, icon, F.col("url"), F.lit("")).alias("x")).select("page_id", "x.*")


@query("""SELECT c_custkey, c_name AS canonical_name, c_mktsegment AS type, CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END AS is_capital_source, c_name || '|b' AS sector_focus, floor(c_nationkey / 3.0::DOUBLE * 1e6 + 0.5) / 1e6 AS cost_usd, CAST(32 AS BIGINT) AS columns FROM customer""")
def c5_customer_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.to_json(F.struct(F.col("c_name").alias("canonical_name"), F.col("c_mktsegment").alias("type"), F.struct((key_() % 2 == 0).alias("is_capital_source")).alias("verification"), F.struct(F.array(F.col("c_name"), F.lit("b")).alias("sector_focus")).alias("capital_profile")))
    none = [F.lit("").alias(c) for c in ("json_file", "response_file", "packet_path", "error")]
    counts = [F.lit(0).cast("long").alias(c) for c in ("latency_ms", "prompt_tokens", "completion_tokens")]
    rows = table(spark, sf_dir, "customer").select(key_().alias("case_id"), F.col("c_name").alias("company_name"), F.lit("").alias("domain"), F.lit(True).alias("ok"), F.lit("m").alias("model"), (F.col("c_nationkey") / 3).alias("cost_usd"), *counts, *none, raw.alias("raw"))
    wide = presets.summary_rows(rows)
    return wide.select(F.col("case_id").alias("c_custkey"), "canonical_name", "type", "is_capital_source", "sector_focus", "cost_usd", F.lit(len(wide.columns)).cast("long").alias("columns"))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS case_id, 'e' || c_custkey AS source_record_id, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'Entity ' || c_custkey END AS canonical_name, CASE WHEN c_custkey % 3 = 0 THEN 'p.test' ELSE 'a.test' END AS domain, c_custkey || ' Main St' AS profile__address FROM customer""")
def v8_customer_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members that a record lacks or calls unknown, from the packet's entity, else from the packet."""
    raw = F.when(key_() % 2 == 0, F.to_json(F.struct(F.col("c_name").alias("canonical_name"), F.lit("unknown").alias("domain")))).otherwise("{}")
    entity = F.struct(F.concat(F.lit("e"), key_().cast("string")).alias("source_record_id"), F.concat(F.lit("Entity "), key_().cast("string")).alias("company_name"), F.when(key_() % 3 != 0, "a.test").alias("domain"), F.concat(key_().cast("string"), F.lit(" Main St")).alias("full_address"))
    rows = table(spark, sf_dir, "customer").select(key_().cast("string").alias("case_id"), F.lit("Packet").alias("company_name"), F.lit("p.test").alias("domain"), raw.alias("raw"), F.to_json(F.struct(entity.alias("entity"))).alias("packet_json"))
    return presets.with_defaults(rows).select("case_id", "source_record_id", "canonical_name", "domain", "profile__address")


def told(issues: Column) -> Column:
    return F.array_join(F.transform(issues, lambda i: F.concat_ws(" ", i["severity"], i["path"])), "; ")


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'high evidence; medium confidence_score; medium type' WHEN 1 THEN 'high evidence' ELSE '' END AS issues, CAST(CASE c_custkey % 3 WHEN 2 THEN 0 ELSE 1 END AS BIGINT) AS high FROM customer""")
def v4_ag12_customer_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verifications of customers: unsure and of unknown type with evidence of no web address, without evidence, and good."""
    url = F.concat(F.when(key_() % 3 == 0, "ftp://").otherwise("https://"), F.lit("c"), key_().cast("string"), F.lit(".test"))
    evidence = F.when(key_() % 3 == 1, F.array().cast("array<struct<source_url:string,claim:string,source_type:string>>")).otherwise(F.array(F.struct(url.alias("source_url"), F.col("c_name").alias("claim"), F.lit("web").alias("source_type"))))
    full = F.to_json(F.struct(F.lit(True).alias("is_capital_source"), F.when(key_() % 3 == 0, 0.2).otherwise(0.9).alias("confidence_score"), F.when(key_() % 3 == 0, "unknown").otherwise("pension").alias("type"), evidence.alias("evidence")))
    raw = F.when(key_() % 3 == 1, '{"evidence": []}').otherwise(full)
    issues = validation.verification_issues(F.col("raw"))
    counted = table(spark, sf_dir, "customer").select("c_custkey", raw.alias("raw")).select("c_custkey", told(issues).alias("issues"), validation.issue_counts(issues)["high"].alias("high"))
    return counted.withColumn("high", F.col("high").cast("long"))
