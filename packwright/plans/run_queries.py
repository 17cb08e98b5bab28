"""Queries over company lists, attempts, scores and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packwright.functions import text
from packwright.operators import benchmark, enrichment, source

from .registry import dealt, query, spread, table, texts

# ---- SQL shared by the queries below ----
SQL_NORMAL = "trim(regexp_replace(regexp_replace(lower({x}), 'https?://\\S+', ' ', 'g'), '[^a-z0-9_]+', ' ', 'g'))"
SQL_TOKENS = "list_distinct(list_filter(string_split_regex({x}, '\\s+'), lambda t: length(t) > 2))"
SQL_SCORES = """SELECT source AS model, CAST(doc_id AS VARCHAR) AS case_id, doc_id AS position, (n_chars % 100) / 100.0::DOUBLE AS quality_score, n_chars % 13 <> 0 AS parse_ok, n_chars % 7 = 0 AS fallback,
  n_chars / 1000000.0::DOUBLE AS cost_usd, n_chars % 500 AS latency_ms, n_chars % 11 <> 0 AS ok FROM documents"""
SQL_CSV = """SELECT c_custkey - 1 AS row_index, CAST(c_custkey AS VARCHAR) AS source_record_id, CASE WHEN c_custkey % 50 = 0 THEN ' ' ELSE c_name END AS company_name,
  CASE WHEN c_custkey % 70 = 0 THEN '' ELSE 'WWW.Cust-' || c_custkey || '.Example.com/path?x=1' END AS domain, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'see http://site-' || c_custkey || '.example.org/a, or call' END AS website_url, c_mktsegment FROM customer"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as scored cases, their source being the model."""
    n = F.col("n_chars")
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("model"), F.col("doc_id").cast("string").alias("case_id"), F.col("doc_id").alias("position"), ((n % 100) / 100.0).alias("quality_score"), (n % 13 != 0).alias("parse_ok"),
        (n % 7 == 0).alias("fallback"), (n / 1000000.0).alias("cost_usd"), (n % 500).alias("latency_ms"), (n % 11 != 0).alias("ok"),
    )


def company_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a company list, some with blank values."""
    key = F.col("c_custkey")
    return spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")).select(
        (key - 1).alias("row_index"), key.cast("string").alias("source_record_id"), F.when(key % 50 == 0, " ").otherwise(F.col("c_name")).alias("company_name"),
        F.when(key % 70 == 0, "").otherwise(F.concat(F.lit("WWW.Cust-"), key.cast("string"), F.lit(".Example.com/path?x=1"))).alias("domain"),
        F.when(key % 3 == 0, "").otherwise(F.concat(F.lit("see http://site-"), key.cast("string"), F.lit(".example.org/a, or call"))).alias("website_url"), "c_mktsegment",
    )


@query(f"""SELECT row_index, "column", 'row ' || (row_index + 2) || ': ' || "column" || ' is required' AS issue FROM (
 SELECT row_index, unnest(['source_record_id', 'company_name', 'domain', 'website_url']) AS "column", unnest([source_record_id, company_name, domain, website_url]) AS v FROM ({SQL_CSV})) WHERE trim(v) = ''""")
def io2_contract_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.contract_issues(company_list(spark, sf_dir))


_DOMAIN = "CASE WHEN domain = '' THEN regexp_replace(regexp_replace(regexp_replace(lower(website_url), '^https?://', ''), '^www\\.', ''), '[/?#:].*$', '') ELSE 'cust-' || source_record_id || '.example.com' END"
_URL = "CASE WHEN website_url = '' THEN CASE WHEN ({d}) = '' THEN '' ELSE 'https://' || ({d}) END ELSE 'http://site-' || source_record_id || '.example.org/a' END"


@query(f"SELECT * FROM (SELECT row_index, source_record_id, trim(company_name) AS company_name, {_DOMAIN} AS domain, {_URL.format(d=_DOMAIN)} AS website_url, c_mktsegment AS segment FROM ({SQL_CSV})) WHERE company_name <> '' OR domain <> '' OR website_url <> ''")
def io4_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = source.entities(company_list(spark, sf_dir))
    return out.select("row_index", "source_record_id", "company_name", "domain", "website_url", F.col("source_context")["c_mktsegment"].alias("segment"))


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 25 OFFSET 10")
def io5_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slice is the feature here: rows 10 to 34 by key."""
    return source.sliced(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", 10, 25)


@query("SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS row_index FROM orders")
def io1_row_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.with_row_index(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


@query("SELECT *, CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS row_index FROM orders")
def io1_wide_row_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of rows that keep all their columns."""
    return source.with_row_index(table(spark, sf_dir, "orders"), "o_orderkey")


@query(f"""WITH e AS (SELECT row_index, {_DOMAIN} AS domain, {_URL.format(d=_DOMAIN)} AS url FROM ({SQL_CSV})), o AS (SELECT *, regexp_extract(url, '^(https?://[^/]+)', 1) AS origin FROM e),
s AS (SELECT row_index, unnest([0, 1, 2, 3, 4, 5]) AS position, unnest(['homepage', 'domain_variant', 'domain_variant', 'contact', 'contact', 'team']) AS family, unnest([url,
  CASE WHEN contains(domain, '-') THEN 'https://' || replace(domain, '-', '') || '/' END, CASE WHEN contains(domain, '-') THEN 'https://www.' || replace(domain, '-', '') || '/' END, origin || '/contact', origin || '/contact-us', origin || '/team']) AS url FROM o),
k AS (SELECT *, regexp_replace(regexp_replace(lower(url), '^(https?://)(www\\.)?', '\\1'), '/$', '') AS key FROM s WHERE coalesce(url, '') NOT IN ('', '/contact', '/contact-us', '/team'))
SELECT row_index, family, url FROM (SELECT *, row_number() OVER (PARTITION BY row_index, key ORDER BY position) AS n FROM k) WHERE n = 1""")
def pf1_seed_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.seed_urls(source.entities(company_list(spark, sf_dir)), ("home", "contact", "team")).select("row_index", "family", "url")


_TIER = "CASE " + " ".join(f"WHEN regexp_matches(lower(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1)), '{p}') THEN {t}" for p, t in source.PATH_TIERS) + " ELSE 10 END"


@query(f"SELECT page_id, {_TIER} AS tier, NOT regexp_matches(lower(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1)), '\\.(?:png|jpe?g|gif|webp|svg|ico|css|js|mjs|map|json|xml|txt|woff2?|ttf|eot|zip|gz|tar|mp4|mov|avi|mp3|wav)$') AS page_like FROM pages")
def pf2_s2_link_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", source.path_tier(F.col("url")).alias("tier"), source.is_page_like(F.col("url")).alias("page_like"))


def _frontier_sql() -> str:
    """Seeds and links as rows; of each company's equal addresses the first, and of what is found the first twenty."""
    from .page_queries import SQL_ENCODED, SQL_HOST, SQL_LINKS, SQL_ORIGIN, SQL_PATH

    path, web = f"lower({SQL_PATH})", "regexp_matches(url, '(?i)^https?://')"
    tier = "CASE " + " ".join(f"WHEN regexp_matches({path}, '{p}') THEN {t}" for p, t in source.PATH_TIERS) + f" ELSE {source.OTHER_TIER} END"
    key = f"CASE WHEN {web} THEN lower(regexp_extract(url, '^([A-Za-z]+)', 1)) || '://' || {SQL_HOST} || CASE WHEN {SQL_PATH} IN ('', '/') THEN '/' ELSE regexp_replace({SQL_PATH}, '/$', '') END ELSE trim(url) END"
    return f"""WITH l AS ({SQL_LINKS}), x AS (SELECT url, h FROM (SELECT url, unnest(hrefs) AS h FROM l) WHERE h <> '' AND NOT regexp_matches(h, '(?i)^#|^javascript:')),
f AS (SELECT DISTINCT {SQL_HOST} AS company, regexp_replace({SQL_ORIGIN} || {SQL_ENCODED.format(x='h')}, '#.*$', '') AS url FROM x),
e AS (SELECT company, url, CAST(1 AS INT) AS phase, CAST({tier} AS BIGINT) AS tier FROM f WHERE {web} AND NOT regexp_matches({path}, '{source.NOT_A_PAGE}') UNION ALL SELECT {SQL_HOST}, url, 0, page_id FROM pages),
n AS (SELECT *, row_number() OVER (PARTITION BY company, {key} ORDER BY phase, tier, url) AS first FROM e), c AS (SELECT *, row_number() OVER (PARTITION BY company, phase ORDER BY tier, url) AS place FROM n WHERE first = 1)
SELECT company, phase, tier, url FROM c WHERE phase = 0 OR place <= 20"""


@query(_frontier_sql())
def w7_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts as companies, their pages as seeds, the pages' links as what is discovered."""
    from packwright.functions.html import page_links

    pages = texts(spark, sf_dir, "pages").select(text.host_of(F.col("url")).alias("row_index"), F.col("page_id").alias("position"), "url", page_links(F.col("html"), F.col("url")).alias("links"))
    found = pages.select("row_index", F.lit("homepage").alias("family"), F.col("row_index").alias("domain"), F.col("url").alias("website_url"), F.col("url").alias("page_url"), "links")
    return source.frontier(pages.select("row_index", "position", "url"), found, 20).select(F.col("row_index").alias("company"), "phase", "tier", "url")


@query("""WITH s AS (SELECT user_id AS row_index, event_id, event_type, event_type <> 'error' AS good, row_number() OVER (PARTITION BY user_id, event_type <> 'error' ORDER BY event_id) AS n FROM events)
SELECT row_index, count(*) AS sources, CAST(count(*) FILTER (good) AS BIGINT) AS source_ok, CAST(count(*) FILTER (NOT good) AS BIGINT) AS source_failed,
 coalesce(string_agg(event_type || ': ' || event_id, ' | ' ORDER BY event_id) FILTER (good AND n <= 4), '') AS evidence, 'l' || min(event_id) FILTER (event_id % 3 = 0) AS logo_url FROM s GROUP BY row_index""")
def ag6_entity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the sources of their users; some have a logo."""
    e = texts(spark, sf_dir, "events")
    none = F.array().cast("array<string>")
    logo = F.when(F.col("event_id") % 3 == 0, F.array(F.concat(F.lit("l"), F.col("event_id").cast("string")))).otherwise(none)
    sources = e.select(F.col("user_id").alias("row_index"), F.col("event_id").alias("position"), F.when(F.col("event_type") != "error", "ok").otherwise("failed").alias("status"), F.col("event_type").alias("family"), F.col("event_id").cast("string").alias("url"), logo.alias("logo_candidates"), none.alias("favicon_candidates"))
    return source.entity_summary(sources).select("row_index", "sources", "source_ok", "source_failed", "evidence", "logo_url")


@query("""WITH s AS (SELECT user_id, count(*) FILTER (event_type <> 'error') AS good, count(*) FILTER (event_type = 'error') AS bad FROM events GROUP BY user_id)
SELECT count(*) AS completed, count(*) FILTER (good > 0) AS successful, count(*) FILTER (good = 0 AND bad > 0) AS failed, count(*) FILTER (good = 0 AND bad = 0) AS empty, CAST(sum(good) AS BIGINT) AS source_ok, CAST(sum(bad) AS BIGINT) AS source_failed,
 count(*) FILTER (user_id % 2 = 0) AS logos, count(*) FILTER (user_id % 3 = 0) AS favicons, count(*) FILTER (user_id % 5 = 0) AS addresses, count(*) FILTER (user_id % 7 = 0) AS postal_codes FROM s""")
def ag5_crawl_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All counters of a run; users stand for companies, some with a logo, an icon, an address, a postal code."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") != "error").alias("source_ok"), F.count_if(F.col("event_type") == "error").alias("source_failed"))
    some = lambda n: F.when(F.col("user_id") % n == 0, "x").otherwise("")
    return source.crawl_counters(e.select("*", some(2).alias("logo_url"), some(3).alias("favicon_url"), some(5).alias("full_address"), some(7).alias("postal_code")))


@query(f"""SELECT row_index, 'r1' AS run_id, trim(company_name) AS company_name, {_DOMAIN} AS domain, repeat('d', 797) || '...' AS description, '' AS logo_url, CAST(42 AS BIGINT) AS entity_columns, CAST(21 AS BIGINT) AS source_columns
FROM ({SQL_CSV}) WHERE trim(company_name) <> '' OR ({_DOMAIN}) <> '' OR ({_URL.format(d=_DOMAIN)}) <> ''""")
def io13_wide_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide tables of entities and sources: all columns, in order, whatever the rows have."""
    rows = source.entities(company_list(spark, sf_dir).withColumn("company_overview", F.repeat(F.lit("d"), 900)))
    wide, sources = source.projected(rows.withColumn("run_id", F.lit("r1")), source.ENTITY_COLUMNS), source.projected(rows, source.SOURCE_COLUMNS)
    sizes = F.lit(len(wide.columns)).cast("long").alias("entity_columns"), F.lit(len(sources.columns)).cast("long").alias("source_columns")
    return wide.select("row_index", "run_id", "company_name", "domain", "description", "logo_url", *sizes)


@query("""WITH t AS (SELECT user_id AS row_index, event_id AS position, coalesce(sum(CAST(floor(abs(value)) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM events)
SELECT row_index, position, 'done' AS status, CAST(0 AS BIGINT) AS remaining FROM t WHERE spent < 300 UNION ALL SELECT row_index, min(position), 'timeout', count(*) FROM t WHERE spent >= 300 GROUP BY row_index""")
def st4_time_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("row_index"), F.col("event_id").alias("position"), F.col("event_id").cast("string").alias("url"), F.floor(F.abs("value")).cast("long").alias("elapsed_ms"))
    return source.within_time(e, 300).select("row_index", "position", "status", "remaining")


_ATTEMPTS = "SELECT user_id AS case_id, event_id AS attempt, CASE event_type WHEN 'error' THEN 503 WHEN 'view' THEN 429 ELSE 200 END AS status FROM events"


@query(f"""WITH a AS ({_ATTEMPTS}), r AS (SELECT *, (status IN (0, 408, 409, 429) OR status >= 500) AS again, count(*) OVER (PARTITION BY case_id) AS attempts FROM a)
SELECT case_id, attempt, status, attempts FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY again, CASE WHEN again THEN -attempt ELSE attempt END) AS n FROM r) WHERE n = 1""")
def w9_chosen_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "error", 503).when(F.col("event_type") == "view", 429).otherwise(200)
    return enrichment.chosen_attempts(table(spark, sf_dir, "events").select(F.col("user_id").alias("case_id"), F.col("event_id").alias("attempt"), status.alias("status")))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def io15_uncached(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, n).select(F.col("doc_id").alias("case_id")) for n in ("documents", "labels"))
    return enrichment.to_call(docs, labels).select(F.col("case_id").alias("doc_id"))


@query("SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) AS first_value, len(json_keys(props)) AS n_keys FROM events")
def n2_json_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.json_object_keys("props")
    path = F.concat(F.lit("$."), keys[0])
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), path, "string").alias("first_value"), F.size(keys).cast("long").alias("n_keys"))


@query(f"""SELECT count(*) AS total, count(*) FILTER (ok) AS successful, count(*) FILTER (NOT ok) AS failed, count(*) FILTER (parse_ok) AS parse_ok, floor(sum(cost_usd) * 1e6 + 0.5) / 1e6 AS total_cost_usd,
 CAST(floor(avg(latency_ms) + 0.5) AS BIGINT) AS avg_latency_ms, CASE WHEN count(*) = count(*) FILTER (ok) THEN 'completed' ELSE 'completed_with_failures' END AS status FROM ({SQL_SCORES})""")
def ag7_ag8_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrichment.run_summary(scores(spark, sf_dir).withColumn("parsed", F.col("parse_ok")))


def _board(digits: int, eligible: str, extra: str) -> str:
    r = lambda x, d: f"floor(({x}) * 1e{d} + 0.5) / 1e{d}"
    return (
        f"SELECT model, count(*) AS cases, {r('avg(quality_score)', 4)} AS avg_quality_score, {r('avg(CAST(parse_ok AS INT))', 4)} AS parse_rate, {r('sum(cost_usd)', digits)} AS total_cost_usd, "
        f"{r('sum(cost_usd) / count(*)', digits)} AS avg_cost_per_case_usd, {eligible} AS eligible{extra.format(r=r)} FROM ({SQL_SCORES}) GROUP BY model"
    )


_FALLBACK = ", floor(avg(CAST(fallback AS INT)) * 1e4 + 0.5) / 1e4 AS fallback_rate, CAST(floor(avg(latency_ms) + 0.5) AS BIGINT) AS avg_latency_ms, floor(avg(quality_score) / (sum(cost_usd) / count(*)) * 1e4 + 0.5) / 1e4 AS best_value_score"


@query(_board(6, "avg(quality_score) >= 0.45 AND avg(CAST(parse_ok AS INT)) >= 0.9", _FALLBACK))
def ag9_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark.leaderboard(scores(spark, sf_dir), 0.45)


SQL_GRID = "(SELECT max(n) AS cases, count(*) AS models FROM (SELECT count(*) AS n FROM documents GROUP BY source))"
_VERIFIED = _board(4, f"count(*) >= (SELECT cases FROM {SQL_GRID}) AND avg(quality_score) >= 0.45 AND avg(CAST(parse_ok AS INT)) >= 0.9", "")


@query(_VERIFIED)
def ag10_verified_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scores(spark, sf_dir)
    return benchmark.verified_leaderboard(rows, grid(rows)[0], 0.45).drop("first_position")


def grid(rows: DataFrame) -> tuple[int, int]:
    """Expected cases of a model, which are those of the model with most, and models."""
    most = rows.groupBy("model").agg(F.count("*").alias("n")).agg(F.max("n").alias("cases"), F.count("*").alias("models")).first()
    return most["cases"] or 0, most["models"]


@query(f"""WITH b AS ({_VERIFIED}), x AS (SELECT CAST(cases * models AS BIGINT) AS pairs FROM {SQL_GRID}), c AS (SELECT model, avg_cost_per_case_usd AS cost, avg_quality_score AS q FROM b WHERE eligible ORDER BY 2, 3 DESC, 1 LIMIT 1), t AS (SELECT * FROM b, x)
SELECT any_value(pairs) AS expected_scores, CAST(sum(cases) AS BIGINT) AS scored_cases, floor(sum(cases) / any_value(pairs)::DOUBLE * 1e4 + 0.5) / 1e4 AS completed_fraction, sum(cases) >= any_value(pairs) AS complete, max(avg_quality_score) AS best_quality_score,
 CAST(count(*) FILTER (eligible) AS BIGINT) AS eligible_models, (SELECT model FROM c) AS cheapest_eligible_model, (SELECT model FROM b JOIN (SELECT source AS model, min(doc_id) AS f FROM documents GROUP BY source) USING (model) ORDER BY avg_quality_score DESC, f LIMIT 1) AS highest_quality_model,
 CASE WHEN sum(cases) >= any_value(pairs) AND (SELECT count(*) FROM c) > 0 THEN floor((greatest(0, 10000 - (SELECT cost FROM c) * 1e6) + (SELECT q FROM c) * 100) * 1e4 + 0.5) / 1e4 ELSE 0.0 END AS primary_score FROM t""")
def ag10_benchmark_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scores(spark, sf_dir)
    return benchmark.benchmark_kpis(rows, *grid(rows), 0.45)


@query("""WITH s AS (SELECT DISTINCT source AS model, CAST(n_chars % 300 AS VARCHAR) AS case_id FROM documents)
SELECT m.model, c.case_id FROM (SELECT DISTINCT model FROM s) AS m, (SELECT DISTINCT case_id FROM s) AS c EXCEPT SELECT model, case_id FROM s""")
def j9_missing_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of documents stand for cases; which source has none of a length that occurs."""
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("model"), (F.col("n_chars") % 300).cast("string").alias("case_id"))
    return benchmark.missing_pairs(rows)


@query(f"SELECT case_id, model, CAST(row_number() OVER (ORDER BY case_id) - 1 AS BIGINT) AS row_index FROM ({SQL_SCORES})")
def s5_rows_by_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark.rows_by_case(scores(spark, sf_dir).select("case_id", "model"))


_ICP_LOW = "CASE p_size % 5 WHEN 0 THEN '-1' WHEN 1 THEN '' WHEN 2 THEN 'many' ELSE CAST(p_size AS VARCHAR) END"


@query(f"""WITH p AS (SELECT *, {_ICP_LOW} AS low FROM part), i AS (SELECT p_partkey, low, [CASE WHEN p_partkey % 7 = 0 THEN 'must include a non-empty name' END, CASE WHEN low IN ('-1', 'many') THEN 'employee bounds must be non-negative numbers or null' END, CASE WHEN try_cast(low AS DOUBLE) > 25 THEN 'has employee_count_min greater than employee_count_max' END] AS x FROM p)
SELECT p_partkey, array_to_string(list_filter(x, lambda m: m IS NOT NULL), '; ') AS issues, try_cast(low AS DOUBLE) AS low, CAST(2 AS BIGINT) AS industries FROM i""")
def n7_icp_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as ideal customer profiles, their sizes as bounds."""
    from packwright.operators.presets import icp_rows

    size = F.col("p_size")
    low = F.when(size % 5 == 0, "-1").when(size % 5 == 1, "").when(size % 5 == 2, "many").otherwise(size.cast("string"))
    name = F.when(F.col("p_partkey") % 7 == 0, "  ").otherwise(F.col("p_name"))
    raw = F.to_json(F.struct(name.alias("name"), F.col("p_type").alias("description"), F.array(F.col("p_brand"), F.lit(" "), F.lit(" x ")).alias("target_industries"), low.alias("employee_count_min"), F.lit(25).alias("employee_count_max")))
    rows = table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw"))
    profile, issues = icp_rows(F.col("raw"))
    return rows.select("p_partkey", F.array_join(issues, "; ").alias("issues"), profile["employee_count_min"].alias("low"), F.size(profile["target_industries"]).cast("long").alias("industries"))


EVENT_SCHEMA = {
    "type": "object", "additionalProperties": False, "required": ["kind", "score", "tags"],
    "properties": {
        "kind": {"type": "string", "enum": ["view", "click", "error"]}, "score": {"type": ["number", "null"], "minimum": 0, "maximum": 100}, "props": {"type": "object", "properties": {"k": {"type": "integer", "maximum": 50}}, "additionalProperties": False},
        "tags": {"type": "array", "minItems": 1, "maxItems": 2, "items": {"type": "string", "maxLength": 5}},
    },
}
_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


@query(f"""WITH e AS (SELECT event_id AS id, event_type, value, {_K} AS k FROM events)
SELECT id, '$.kind' AS path, 'enum' AS rule FROM e WHERE event_type NOT IN ('view', 'click', 'error') UNION ALL SELECT id, '$.score', 'minimum' FROM e WHERE k % 9 <> 0 AND value < 0 UNION ALL SELECT id, '$.score', 'maximum' FROM e WHERE k % 9 <> 0 AND value > 100
UNION ALL SELECT id, '$.score', 'required' FROM e WHERE k % 9 = 0 UNION ALL SELECT id, '$.props.k', 'maximum' FROM e WHERE k > 50 UNION ALL SELECT id, '$.more', 'additionalProperties' FROM e WHERE k % 8 = 0
UNION ALL SELECT id, '$.tags[1]', 'maxLength' FROM e WHERE k % 4 <> 0 AND length(event_type) > 5 UNION ALL SELECT id, '$.tags', 'type' FROM e WHERE k % 4 = 0 UNION ALL SELECT id, '$', 'json' FROM e WHERE false""")
def v9_schema_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as records, their props as they stand in them; some lack members, have others, or a list that is none."""
    from packwright.operators.conformance import violations

    k = F.get_json_object("props", "$.k").cast("long")
    score, more = F.when(k % 9 != 0, F.col("value")), F.when(k % 8 == 0, F.lit(1))
    tags = F.when(k % 4 == 0, F.lit('"none"')).otherwise(F.to_json(F.array(F.lit("t"), F.col("event_type"))))
    head = F.to_json(F.struct(F.col("event_type").alias("kind"), score.alias("score"), more.alias("more")))
    raw = F.concat(F.expr("substring(h, 1, length(h) - 1)"), F.lit(',"props":'), F.col("props"), F.lit(',"tags":'), F.col("tags"), F.lit("}"))
    rows = dealt(spark, sf_dir, "events").select(F.col("event_id").alias("case_id"), "props", head.alias("h"), tags.alias("tags")).select("case_id", raw.alias("raw"))
    return violations(rows, EVENT_SCHEMA)


@query(f"""SELECT event_id, CASE WHEN {_K} % 2 = 1 THEN 'k is odd' ELSE '' END AS errors, CASE WHEN {_K} % 2 = 0 THEN {_K} ELSE -1 END AS k, CASE WHEN {_K} % 2 = 0 THEN {_K} // 10 ELSE -1 END AS tens FROM events""")
def u2_user_preset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A preset whose checks and flat columns are a user's functions, over the props of all events."""
    from packwright.operators import presets

    own = presets.user_preset("props", _odd, ("k long, tens long", _tens))
    rows = presets.preset_rows(table(spark, sf_dir, "events").select("event_id", F.col("props").alias("raw")), own)
    return rows.select("event_id", F.array_join("errors", "; ").alias("errors"), *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("k", "tens")])


def _odd(raw):
    import json

    import pyarrow as pa

    return pa.array([["k is odd"] if json.loads(x)["k"] % 2 else [] for x in raw.to_pylist()], pa.list_(pa.string()))


def _tens(raw):
    import json

    import pyarrow as pa

    found = [None if x is None else json.loads(x)["k"] for x in raw.to_pylist()]
    return pa.array([{"k": k, "tens": None if k is None else k // 10} for k in found], pa.struct([("k", pa.int64()), ("tens", pa.int64())]))


@query(f"""WITH s AS (SELECT *, latency_ms % 3 = 0 AS cached, ok AND parse_ok AS good FROM ({SQL_SCORES})),
n AS (SELECT *, count(*) FILTER (NOT good) OVER (PARTITION BY model ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS failed FROM s)
SELECT case_id, model, NOT cached AND failed >= 3 AS skipped FROM n""")
def w8_stopped_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases that a model with three failures, of call or of parsing, is not asked any more; some have a cached response.

    Up to the third failure every case is run, so the failures before a case are those of all cases before it.
    """
    return benchmark.stopped_rows(scores(spark, sf_dir).withColumn("cached", F.col("latency_ms") % 3 == 0)).select("case_id", "model", "skipped")


@query(f"""WITH i AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS place, item_id, text, count(*) OVER () AS n FROM benchmark),
p AS (SELECT d.doc_id, i.item_id, {SQL_NORMAL.format(x="coalesce(d.text, '')")} AS a, {SQL_NORMAL.format(x="coalesce(i.text, '')")} AS g FROM documents d JOIN i ON d.doc_id % i.n = i.place),
t AS (SELECT *, {SQL_TOKENS.format(x='a')} AS ta, {SQL_TOKENS.format(x='g')} AS tg FROM p)
SELECT doc_id, item_id, CASE WHEN a = g THEN 1.0 WHEN a = '' OR g = '' THEN 0.0 WHEN contains(a, g) OR contains(g, a) THEN 0.76 ELSE least(0.82, CASE WHEN len(ta) = 0 AND len(tg) = 0 THEN 1.0 WHEN len(ta) = 0 OR len(tg) = 0 THEN 0.0
  ELSE len(list_intersect(ta, tg)) / len(list_distinct(list_concat(ta, tg)))::DOUBLE END) END::DOUBLE AS score FROM t""")
def sc2_score_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document against one item of the benchmark, by turns, so that every item takes part."""
    items = source.with_row_index(table(spark, sf_dir, "benchmark"), "item_id").select("item_id", F.col("row_index").alias("place"), text.normalized_text(F.col("text")).alias("gold"))
    n = max(1, table(spark, sf_dir, "benchmark").count())
    docs = texts(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % n).alias("place"), text.normalized_text(F.col("text")).alias("own"))
    return docs.join(items, "place").select("doc_id", "item_id", benchmark.score_normalized(F.col("own"), F.col("gold")).alias("score"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN a = g THEN 1.0 WHEN g BETWEEN 0 AND 1 AND a BETWEEN 0 AND 1 THEN greatest(0, 1 - abs(a - g)) ELSE greatest(0, 1 - abs(a - g) / greatest(1, abs(g))) END::DOUBLE AS score
FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN l_discount ELSE l_quantity END AS a, CASE WHEN l_linenumber % 2 = 0 THEN l_tax ELSE l_tax * 500 END AS g FROM lineitem)""")
def sc3_score_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.col("l_linenumber") % 2 == 0
    a, g = F.when(even, F.col("l_discount")).otherwise(F.col("l_quantity")), F.when(even, F.col("l_tax")).otherwise(F.col("l_tax") * 500)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", benchmark.score_number(a, g).alias("score"))


_ITEMS = "list_distinct(list_filter(list_transform(string_split({x}, ' '), lambda t: " + SQL_NORMAL.format(x="t") + "), lambda t: t <> ''))"


@query(f"""WITH p AS (SELECT p_partkey, {_ITEMS.format(x='p_name')} AS a, {_ITEMS.format(x='p_type')} AS g FROM part)
SELECT p_partkey, CASE WHEN len(a) = 0 AND len(g) = 0 THEN 1.0 WHEN len(g) = 0 THEN 0.45 WHEN len(a) = 0 THEN 0.0 ELSE len(list_intersect(a, g)) / len(list_distinct(list_concat(a, g)))::DOUBLE END::DOUBLE AS score FROM p""")
def sc4_score_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", benchmark.score_array(F.split("p_name", " "), F.split("p_type", " ")).alias("score"))


@query("""SELECT p_partkey, p * 1000000 AS input_per_1m, c * 1000000 AS output_per_1m, p * 1000000 * 0.9::DOUBLE + c * 1000000 * 0.1::DOUBLE AS blended_90_10_per_1m FROM (SELECT p_partkey, p_retailprice AS p, CAST(p_size AS DOUBLE) AS c FROM part)""")
def sc8_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", benchmark.prices(F.col("p_retailprice"), F.col("p_size")).alias("x")).select("p_partkey", "x.*")


_GATE = {"the": r"(?<![0-9a-z_])the(?![0-9a-z_])", "und": r"(?<![0-9a-z_])und(?![0-9a-z_])", "que": r"(?<![0-9a-z_])que(?![0-9a-z_])"}


@query("""WITH l AS (SELECT doc_id, lower(text) AS t FROM documents) SELECT doc_id, array_to_string(list_filter(['the', 'und', 'que'], lambda x: regexp_matches(t, '\\b' || x || '\\b')), ',') AS labels,
 CASE WHEN regexp_matches(t, '\\b(the|und|que)\\b') THEN 'pass' ELSE 'no_keyword' END AS route FROM l""")
def pf12_pf13_keyword_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate with terms that occur in the tables."""
    packets = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"), F.col("text").alias("markdown"))
    return enrichment.routed(packets, _GATE).select(F.col("case_id").alias("doc_id"), F.array_join("labels", ",").alias("labels"), "route")


@query("""SELECT event_type, date_trunc('hour', ts) AS window_start, count(*) AS n, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1, 2""")
def st5_hourly_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    from packwright.streaming.progress import hourly_progress

    return hourly_progress(table(spark, sf_dir, "events"))


def arriving(rows: DataFrame, files: int, files_a_batch: int) -> DataFrame:
    """A table as a stream of its files, several a batch."""
    from packwright.sources.staging import new_folder
    from packwright.streaming.progress import page_stream

    folder = new_folder(rows.sparkSession, "arriving")
    rows.repartition(files).write.parquet(folder)
    return page_stream(rows.sparkSession, folder, rows.schema, files_a_batch)


_HOST = "regexp_extract(url, '^https?://([^/?#]*)', 1)"


@query(f"""SELECT {_HOST} AS company, count(*) AS pages, count(DISTINCT html) AS different, CAST(sum(length(coalesce(html, ''))) AS BIGINT) AS chars, max(page_id) AS last_page FROM pages GROUP BY 1""")
def st1_incremental_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages in several batches, a host's results made anew from its state whenever pages of it come."""
    from packwright.sources.staging import new_folder
    from packwright.streaming import progress

    pages = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^https?://([^/?#]*)", 1).alias("company"), F.col("page_id").alias("pos"), F.coalesce("html", F.lit("")).alias("html"))
    made = lambda df: df.groupBy("company").agg(F.count("*").alias("pages"), F.count_distinct("html").alias("different"), F.sum(F.length("html")).alias("chars"), F.max("pos").alias("last_page"))
    out = new_folder(spark, "incremental")
    progress.start_results(arriving(pages, 4, 2), made, out, f"{out}/checkpoint").awaitTermination()
    return progress.latest_results(spark, out)


@query("SELECT count(*) AS completed, count(*) FILTER (event_type <> 'error') AS successful, count(*) FILTER (event_type = 'error') AS failed FROM events")
def st2_last_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest snapshot of the counters of a stream."""
    from packwright.sources.staging import new_folder
    from packwright.streaming import progress

    out = new_folder(spark, "snapshots")
    progress.start_snapshots(arriving(table(spark, sf_dir, "events").select("event_type"), 6, 2), 300, out, f"{out}/checkpoint").awaitTermination()
    kept = spark.read.schema("completed long, successful long, failed long").json(f"{out}/snapshot=*")
    return kept.agg(F.max(F.struct("completed", "successful", "failed")).alias("x")).select("x.*")


@query("SELECT doc_id AS case_id, coalesce(text, '') AS raw_text FROM documents")
def st3_resumed_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over documents of which a part came through, resumed over those without a row: each once."""
    from packwright.sources.staging import new_folder
    from packwright.streaming import progress

    cases = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"), F.coalesce("text", F.lit("")).alias("raw_text"))
    out, schema = new_folder(spark, "results"), "case_id long, raw_text string"
    progress.start_append(arriving(cases.where("case_id % 3 = 0"), 3, 1), out, f"{out}/checkpoint").awaitTermination()
    progress.append_once(progress.remaining_cases(spark, cases, progress.committed_rows(spark, out, schema)), out, 1 << 20)
    return progress.committed_rows(spark, out, schema)
