"""Packets, names, claims, choices and evidence rules over records that Spark makes from the given tables.

Orders stand for enriched records with up to three items of evidence; each item's path, source, address and claim
follow from the row's own columns, and so they do in the SQL, which knows the outcome of each from its number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packwright.operators import benchmark, enrichment, validation

from .customer_records import told
from .page_queries import _chain, _spaced
from .registry import dealt, query, table, texts
from .run_queries import SQL_NORMAL

_BOTH = " ".join(f"{s.capitalize()}." for s in enrichment.SENTINELS)
_PACKET = f"""coalesce(text, '') || CASE doc_id % 7 WHEN 0 THEN chr(10) || '{_BOTH}' WHEN 1 THEN chr(10) || '{enrichment.SENTINELS[0]}' ELSE '' END"""
_PLAIN = _spaced(_chain("packet", ("(?s)---.*?---", "' '"), ("[#*_`>|\\[\\]()-]", "' '")))


@query(f"""WITH p AS (SELECT doc_id, {_PACKET} AS packet FROM documents), q AS (SELECT doc_id, {_PLAIN} AS plain, {' AND '.join(f"contains(lower(packet), '{s}')" for s in enrichment.SENTINELS)} AS none FROM p)
SELECT doc_id, length(plain) < {enrichment.LEAST_PACKET_CHARS} OR none AS empty, none AS legacy_empty FROM q""")
def pf10_pf11_document_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as packets; some end in both sentences that say that nothing was kept, some in one of them."""
    end = F.when(F.col("doc_id") % 7 == 0, "\n" + _BOTH).when(F.col("doc_id") % 7 == 1, "\n" + enrichment.SENTINELS[0]).otherwise("")
    packet = F.concat(F.coalesce("text", F.lit("")), end)
    return texts(spark, sf_dir, "documents").select("doc_id", packet.alias("packet")).select("doc_id", enrichment.is_empty_packet(F.col("packet")).alias("empty"), enrichment.lacks_both_sources(F.col("packet")).alias("legacy_empty"))


_SLUG = _chain("lower(name)", ("[^a-z0-9]+", "'_'"), ("^_+|_+$", "''"))


@query(f"""WITH f AS (SELECT p_partkey, unnest([0, 1, 2, 3, 4, 5]) AS form, unnest([p_name, lower(p_brand), p_brand, 'Portfolio  Company ' || p_size, p_name || ' ' || p_size, CASE p_partkey % 3 WHEN 0 THEN 'n/a' WHEN 1 THEN 'Real Estate Platform' ELSE 'Technology-Company-' || p_size END]) AS raw FROM part),
n AS (SELECT *, {_spaced('raw')} AS name FROM f), s AS (SELECT *, {_SLUG} AS slug FROM n)
SELECT p_partkey, CAST(form AS BIGINT) AS form, lower(name) NOT IN ({', '.join(f"'{w}'" for w in validation.NOT_PLACEHOLDER)}) AND (regexp_matches(lower(name), '{validation.PLACEHOLDER_NAME}') OR regexp_matches(slug, '{validation.PLACEHOLDER_SLUG}') OR (regexp_matches(slug, '^[a-z]+(_[a-z]+)*_[0-9]+$') AND NOT regexp_matches(name, '[A-Z]'))) AS placeholder FROM s""")
def pf21_part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and brands of parts as they stand, in lower case and with a number, and generic nouns with the part's size."""
    size, n = F.col("p_size").cast("string"), F.col("p_partkey") % 3
    forms = F.array("p_name", F.lower("p_brand"), "p_brand", F.concat(F.lit("Portfolio  Company "), size), F.concat("p_name", F.lit(" "), size), F.when(n == 0, "n/a").when(n == 1, "Real Estate Platform").otherwise(F.concat(F.lit("Technology-Company-"), size)))
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(forms).alias("form", "name")).select("p_partkey", F.col("form").cast("long").alias("form"), validation.is_placeholder_name(F.col("name")).alias("placeholder"))


_ENDS = ("", "\nWealth management for families.", "\nWealth management; it does not make fund investments.", "\nThey invest in funds.", "\nNo public fund is known.")


@query(f"""WITH c AS (SELECT doc_id, coalesce(text, '') || [{', '.join("'" + e.replace(chr(10), "' || chr(10) || '") + "'" for e in _ENDS)}][doc_id % 5 + 1] AS claim FROM documents)
SELECT doc_id, regexp_matches(claim, '(?i)\\b(?:{validation.ADVISORY_WORDING})\\b') AND NOT regexp_matches(claim, '{validation.NEGATIVE_FUND.replace("(?<![0-9A-Za-z_])", chr(92) + "b").replace("(?![0-9A-Za-z_])", chr(92) + "b")}') AS advisory FROM c""")
def pf22_document_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as claims, with a line that words advice, one that denies fund investments beside it, or neither."""
    end = F.element_at(F.array(*map(F.lit, _ENDS)), (F.col("doc_id") % 5 + 1).cast("int"))
    claim = F.concat(F.coalesce("text", F.lit("")), end)
    return texts(spark, sf_dir, "documents").select("doc_id", validation.is_advisory_wording(claim).alias("advisory"))


_UNKNOWN = "(" + SQL_NORMAL + " IN ('', " + ", ".join(f"'{w}'" for w in benchmark.UNKNOWN_WORDS) + "))"


@query(f"""WITH v AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN ' Not  Disclosed. ' WHEN 1 THEN p_name WHEN 2 THEN 'n/a' WHEN 3 THEN '??' WHEN 4 THEN 'none ' || p_brand ELSE 'https://x.test/' || p_partkey END AS v FROM part)
SELECT p_partkey, {_UNKNOWN.format(x='v')} AS one, CASE p_partkey % 4 WHEN 0 THEN true ELSE {_UNKNOWN.format(x='v')} AND p_partkey % 4 <> 3 END AS every FROM v""")
def pf20_part_unknowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts and lists that say something or nothing: an empty list, a list of the text, one of it and a size."""
    n, key = F.col("p_partkey") % 6, F.col("p_partkey") % 4
    v = F.when(n == 0, " Not  Disclosed. ").when(n == 1, F.col("p_name")).when(n == 2, "n/a").when(n == 3, "??").when(n == 4, F.concat(F.lit("none "), "p_brand")).otherwise(F.concat(F.lit("https://x.test/"), F.col("p_partkey").cast("string")))
    listed = F.when(key == 0, F.array().cast("array<string>")).when(key == 3, F.array(F.col("v"), F.col("p_size").cast("string"))).otherwise(F.array(F.col("v"), F.lit("None")))
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", v.alias("v")).select("p_partkey", benchmark.is_unknown(F.col("v")).alias("one"), benchmark.all_unknown(listed).alias("every"))


@query("""SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN c_name WHEN 1 THEN c_mktsegment WHEN 2 THEN '' WHEN 3 THEN '[1]' ELSE 'null or so' END AS chosen, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment WHEN c_custkey % 3 = 0 THEN c_name ELSE 'Unknown ' END AS filled FROM customer""")
def w6_customer_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of several values that says something, and the first candidate for a value that is not set."""
    n, key = F.col("c_custkey") % 5, F.col("c_custkey")
    last = F.when(n == 0, F.concat(F.lit("  "), "c_name")).when(n == 1, F.col("c_mktsegment")).when(n == 3, "[1]").when(n == 4, "null or so")
    chosen = enrichment.first_material(F.lit(" "), F.when(n < 2, "[]").otherwise("{}"), F.when(n == 2, "NULL"), last, F.when(n == 0, "later"))
    filled = enrichment.filled_default(F.when(key % 2 == 0, F.col("c_mktsegment")).otherwise("Unknown "), F.lit(" "), F.when(key % 3 == 0, F.col("c_name")))
    return table(spark, sf_dir, "customer").select("c_custkey", chosen.alias("chosen"), filled.alias("filled"))


def pick(at: Column, values: list) -> Column:
    return F.element_at(F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values]), (at + 1).cast("int"))


def evidence(paths: list[str], claims: list) -> Column:
    """As many items as the order's key leaves by four, in the order of their number."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")

    def item(i: Column) -> Column:
        path, kind = pick((customer + i * 5) % 6, paths), pick((F.floor(key / 4) + i) % 5, ["source_record", "official_website", "official_website", "web", "web"])
        url, claim = pick((F.floor(customer / 3) + i) % 4, ["ftp://x", "https://other.test/", "https://sub.acme.test/a", "http://www.acme.test"]), pick((F.floor(key / 3) + i) % 3, claims)
        return F.struct(path.alias("field_path"), claim.alias("claim"), url.alias("source_url"), kind.alias("source_type"))

    return F.transform(F.filter(F.array(*map(F.lit, (1, 2, 3))), lambda i: i <= key % 4), item)


#: k, c and the items: path, source, address, claim by number
_ITEMS = """SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS st, o_orderpriority AS pr, list_transform(range(1, o_orderkey % 4 + 1), lambda i: {'m': (o_custkey + i * 5) % 6, 's': (o_orderkey // 4 + i) % 5, 'u': (o_custkey // 3 + i) % 4, 'g': (o_orderkey // 3 + i) % 3}) AS es FROM orders"""
_ANY = "len(list_filter(es, lambda e: {test})) > 0"
_LISTED = "array_to_string(list_filter(flatten([{parts}]), lambda x: x IS NOT NULL), '; ')"


def _told(*parts: str) -> str:
    return _LISTED.format(parts=", ".join(parts))


def _when(issue: str, test: str) -> str:
    return f"CASE WHEN {test} THEN '{issue}' END"


def _row(*issues: tuple[str, str]) -> str:
    return "[" + ", ".join(_when(*i) for i in issues) + "]"


def _each(*issues: tuple[str, str]) -> str:
    return f"flatten(list_transform(es, lambda e: {_row(*issues)}))"


def _cited(*numbers: int) -> str:
    return _ANY.format(test=f"e.m IN ({', '.join(map(str, numbers))})")


_WEB = (("high source_evidence", "e.s <> 0 AND e.u = 0"), ("medium source_evidence.source_type", "e.s IN (1, 2) AND e.u IN (0, 1)"))


@query(f"""WITH o AS ({_ITEMS}) SELECT k AS o_orderkey, {_told(
    _row(("high source_evidence", "k % 4 = 0")), _each(*_WEB, ("medium source_evidence.claim", "e.g < 2")),
    _row(
        ("high verification.is_capital_source", "st <> 'F'"), ("medium verification", f"NOT ({_cited(0, 5)})"), ("medium profile.capital_source_context", f"k % 5 <> 0 AND NOT ({_cited(3)})"),
        ("medium capital_profile", f"k % 2 = 0 AND NOT ({_cited(1)})"), ("medium contacts", f"k % 3 = 0 AND NOT ({_cited(2)})"), ("medium outreach.fit_risk_notes", f"k % 7 = 1 AND NOT ({_cited(4)})"),
        ("high capital_profile.commitment_size", f"k % 2 = 0 AND NOT ({_cited(1)})"),
    ),
)} AS issues FROM o""")  # fmt: skip
def v5_j10_order_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enriched records of orders: evidence of any kind, sections that say something, nothing or are not there."""
    key, status, priority = F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority")
    items = evidence(["verification", "capital_profile.commitment_size_min_usd", "contacts[0].name", "profile", "outreach", "verification.status"], ["see [a](b)", "at utm_source=openai", priority])
    record = F.struct(
        F.lit("www.Acme.test").alias("domain"), F.struct(F.when(status == "F", True).when(status != "P", False).alias("is_capital_source"), F.when(status == "P", "true").alias("word")).alias("verification"),
        F.struct(F.when(key % 5 == 0, "Unknown").otherwise(priority).alias("capital_source_context")).alias("profile"), F.when(key % 6 != 1, F.struct(F.when(key % 2 == 0, F.col("o_totalprice")).alias("commitment_size_min_usd"))).alias("capital_profile"),
        F.when(key % 3 == 0, F.array(F.struct(priority.alias("name")))).alias("contacts"), F.when(key % 7 < 2, F.struct(F.when(key % 7 == 0, "No public data").otherwise(priority).alias("fit_risk_notes"))).alias("outreach"), items.alias("source_evidence"),
    )
    # a text in the place of the boolean, where the status says so
    raw = F.regexp_replace(F.to_json(record), '"word":', '"is_capital_source":')
    return dealt(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw")).select("o_orderkey", told(validation.enrichment_issues(F.col("raw"))).alias("issues"))


_OWN = "list_filter(es, lambda e: e.m = {m})"
_ONLY_RECORD = "(len({own}) > 0 AND len(list_filter({own}, lambda e: e.s <> 0)) = 0)"


@query(f"""WITH o AS ({_ITEMS}) SELECT k AS o_orderkey, {_told(
    _row(("high source_evidence", "k % 4 = 0"), ("high evidence_urls", "c % 4 = 0")), _each(*_WEB, ("medium source_evidence.claim", "e.g = 0 AND e.m IN (0, 2, 5)")), _row(("high evidence_urls", "c % 4 IN (1, 2)")),
    _row(
        ("medium type", "st = 'F' AND pr LIKE '5%'"), ("medium confidence_score", "st = 'F' AND k % 100 < 55"),
        ("medium logo_url", "k % 11 < 2"), ("medium type", f"pr NOT LIKE '5%' AND NOT ({_cited(1)})"), ("medium vc_fund_lp_signal", "k % 7 = 0"), ("medium known_fund_investments", f"k % 5 = 0 AND NOT ({_cited(0)})"),
        ("high aum_usd", f"k % 6 = 0 AND NOT ({_cited(4)})"), ("medium logo_url", "k % 11 = 0"), ("high fund_cheque_size", f"k % 9 = 0 AND NOT ({_cited(3)})"), ("high cheque_size_basis", "k % 18 = 0"),
        ("high fund_commitment_appetite", "c % 3 = 0 AND k % 4 = 0"), ("medium vc_fund_lp_signal", "k % 7 = 0 AND c % 3 <> 0"), ("medium invests_in_vc_funds", "k % 7 <> 0 AND c % 3 = 0"),
        ("low invests_in_vc_funds", "c % 3 <> 2 AND " + _ONLY_RECORD.format(own=_OWN.format(m=2))), ("medium invests_in_vc_funds", "c % 3 = 1 AND " + _ANY.format(test="e.m = 2 AND e.g = 1")),
        ("low invests_directly", "k % 8 BETWEEN 1 AND 4 AND " + _ONLY_RECORD.format(own=_OWN.format(m=5))),
        ("high known_fund_investments.0", "k % 5 = 0"), ("high known_fund_investments.2", "k % 5 = 0"), ("medium embedding_text", "k % 13 = 0"),
    ),
)} AS issues FROM o""")  # fmt: skip
def v6_order_lean_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lean records of orders, each with its own mixture of what the rules look at."""
    key, customer, priority = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderpriority")
    number = lambda n: F.when(key % n == 0, F.col("o_totalprice"))
    items = evidence(["known_fund_investments", "type", "invests_in_vc_funds", "fund_cheque_size_min_usd", "aum_usd", "invests_directly"], ["Source-backed context supports it", "wealth management for families", "wealth management; does not make fund investments"])
    named = F.array(F.concat(F.lit("Portfolio Company "), customer.cast("string")), priority, F.concat(F.lit("acme fund "), customer.cast("string")))
    urls = pick(customer % 4, [F.array().cast("array<string>"), F.array(F.lit("source_record"), F.lit("ftp://x")), F.array(F.lit("https://acme.test"), F.lit("www.acme.test")), F.array(F.lit("https://acme.test"))])
    record = F.struct(
        F.lit("acme.test").alias("domain"), items.alias("source_evidence"), urls.alias("evidence_urls"), F.when(F.col("o_orderstatus") == "F", "verified").otherwise("rejected").alias("verification_status"), F.when(priority.startswith("5"), "unknown").otherwise(priority).alias("type"),
        (key % 100 / 100).alias("confidence_score"), F.when(key % 11 == 0, "logo.png").when(key % 11 == 1, "https://x.test/l.png").when(key % 11 == 2, "unknown").alias("logo_url"), F.when(key % 7 == 0, "explicit_yes").when(key % 7 == 1, "none").alias("vc_fund_lp_signal"),
        F.when(key % 5 == 0, named).alias("known_fund_investments"), number(6).alias("aum_usd"), number(9).alias("fund_cheque_size_min_usd"), F.when(key % 2 == 0, "observed_historical").alias("cheque_size_basis"), pick(customer % 3, ["yes", "no", "unknown"]).alias("invests_in_vc_funds"),
        F.when(key % 4 == 0, "no").otherwise("unknown").alias("fund_commitment_appetite"), F.when((key % 8).between(1, 4), "yes").otherwise("unknown").alias("invests_directly"), F.lit("unknown").alias("co_investment_appetite"), F.when(key % 13 == 0, priority).otherwise("e" * validation.LEAST_EMBEDDING).alias("embedding_text"),
    )
    return dealt(spark, sf_dir, "orders").select("o_orderkey", F.to_json(record).alias("raw")).select("o_orderkey", told(validation.lean_issues(F.col("raw"))).alias("issues"))
