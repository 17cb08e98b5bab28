"""Queries over tables as files and documents: CSV, JSON lines, page documents, packets, indexes, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packwright.functions import facts, text
from packwright.operators import benchmark, documents, enrichment, source
from packwright.operators.gate import GATE_TERMS
from packwright.sources import tables
from packwright.sources.staging import new_folder, staged

from .registry import query, table, texts
from .run_queries import SQL_SCORES, scores

SQL_PAGE_URL = "regexp_extract(url, '^https?://([^/?#]*)', 1)"


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang FROM documents")
def io1_csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as CSV and read back, quoted line ends as they stand."""
    path = new_folder(spark, "csv")
    tables.write_csv(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), path)
    return tables.read_csv(spark, path).select("doc_id", "text", "lang")


@query("""SELECT CAST(doc_id AS VARCHAR) AS doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source, CAST(n_chars AS VARCHAR) AS n_chars, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS row_index FROM documents""")
def io1_csv_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as CSV in the order of doc_id, read in ranges far smaller than the files, with the rows' places."""
    path = new_folder(spark, "csv")
    tables.write_csv(table(spark, sf_dir, "documents").repartitionByRange("doc_id").sortWithinPartitions("doc_id"), path)
    return tables.read_csv(spark, path, 1 << 17)


@query("""SELECT doc_id, CAST(doc_id AS VARCHAR) || ',' || CASE WHEN regexp_matches(coalesce(text, ''), '[",\\n\\r]') THEN '"' || replace(text, '"', '""') || '"' ELSE coalesce(text, '') END || ',' ||
 '"[""' || coalesce(lang, '') || '"",""' || source || '""]"' AS line FROM documents""")
def io11_csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of CSV with a text and an array."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.array(F.coalesce("lang", F.lit("")), F.col("source")).alias("labels"))
    return tables.csv_lines(docs).select(F.regexp_extract("line", r"\A(\d+),", 1).cast("long").alias("doc_id"), "line")


@query("SELECT doc_id, text, lang FROM documents UNION ALL SELECT doc_id, text, 'again' FROM documents")
def io10_io12_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents appended twice to a table of JSON lines, and read back."""
    path, docs = new_folder(spark, "json-lines"), table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    tables.write_json_lines(docs, path)
    tables.write_json_lines(docs.withColumn("lang", F.lit("again")), path, append=True)
    return tables.read_json_lines(spark, path, "doc_id long, text string, lang string")


@query("""SELECT page_id, CAST(page_id AS VARCHAR) AS page, url, 'it is: plain' AS note, '' AS empty, '[1,2]' AS list, CAST(4 AS BIGINT) AS members, 'Body of ' || page_id || chr(10) || '---' || chr(10) || 'end' AS body FROM pages""")
def io8_split_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a header: a number, a JSON text, a text in single quotes, a repeated name, a line without a colon."""
    lines = [F.lit("---"), F.concat(F.lit("page: "), F.col("page_id").cast("string")), F.concat(F.lit("url:   "), documents.json_text(F.col("url"))), F.lit("note: first"), F.lit("no separator"), F.lit("note: 'it is: plain'"), F.lit("list: [1,2]"), F.lit("---"), F.lit("")]
    raw = F.concat(F.concat_ws("\n", *lines), F.lit("\nBody of "), F.col("page_id").cast("string"), F.lit("\n---\nend \n"))
    split = table(spark, sf_dir, "pages").select("page_id", documents.split_header(raw).alias("d")).select("page_id", "d.frontmatter", "d.body")
    at = lambda k: F.col("frontmatter")[k]
    return split.select("page_id", at("page").alias("page"), at("url").alias("url"), at("note").alias("note"), F.coalesce(at("empty"), F.lit("")).alias("empty"), at("list").alias("list"), F.size("frontmatter").cast("long").alias("members"), "body")


def _header_line(name: str) -> str:
    values = {"run_id": "'r1'", "row_index": "CAST(page_id AS VARCHAR)", "company_name": "url", "domain": SQL_PAGE_URL, "final_url": "url", "page_name": "'page ' || page_id"}
    if name == "logo_candidates":
        return "'logo_candidates: [' || CAST(to_json(url) AS VARCHAR) || ']'"
    return f"'{name}: ' || CAST(to_json({values.get(name, chr(39) * 2)}) AS VARCHAR)"


@query(f"""SELECT page_id, array_to_string(['---', {', '.join(map(_header_line, documents.PAGE_MEMBERS))}, '---', '', '# page ' || page_id, '', 'Company: ' || url, 'Domain: ' || {SQL_PAGE_URL}, 'Page path: ', 'Final URL: ' || url, ''], chr(10)) || 'text of ' || page_id || chr(10) AS document FROM pages""")
def io9_page_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(
        "page_id", F.lit("r1").alias("run_id"), F.col("page_id").alias("row_index"), F.col("url").alias("company_name"), F.regexp_extract("url", "^https?://([^/?#]*)", 1).alias("domain"), F.col("url").alias("final_url"),
        F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("page_name"), F.array("url").alias("logo_candidates"), F.concat(F.lit("text of "), F.col("page_id").cast("string")).alias("markdown"),
    )
    return pages.select("page_id", documents.page_document(pages).alias("document"))


@query("""SELECT lpad(CAST(n_nationkey AS VARCHAR), 6, '0') AS case_id, n_name AS company_name, lower(n_name) || '.test' AS domain, CAST(length('Company: ' || n_name || chr(10) || 'Domain: ' || lower(n_name) || '.test' || chr(10)) AS BIGINT) AS md_chars,
 CASE WHEN n_regionkey = 0 THEN '{}' ELSE '{"region":' || n_regionkey || '}' END AS packet_json, count(*) OVER () AS packets FROM nation""")
def io6_io7_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets written as folders and scanned again; some have no side file."""
    name = F.col("n_name")
    packets = table(spark, sf_dir, "nation").select(
        text.zero_padded(F.col("n_nationkey")).alias("case_id"), F.concat(F.lit("Company: "), name, F.lit("\nDomain: "), F.lower(name), F.lit(".test\n")).alias("markdown"),
        F.when(F.col("n_regionkey") != 0, F.to_json(F.struct(F.col("n_regionkey").alias("region")))).alias("packet_json"),
    )
    root = new_folder(spark, "packets")
    staged(documents.write_packets(packets, root), "packet-files")
    found = documents.packet_facts(documents.read_packets(spark, root))
    return found.crossJoin(found.agg(F.count("*").alias("packets"))).select("case_id", "company_name", "domain", "md_chars", "packet_json", "packets")


@query("""SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS case_id, 'Company: ' || s_name || chr(10) AS markdown, CASE WHEN s_suppkey % 3 = 0 THEN '{}' ELSE '{"nation":' || s_nationkey || '}' END AS packet_json FROM supplier""")
def io6_packet_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packet folders of all suppliers, read by the data source."""
    from packwright.sources import packets as source_of

    key = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(text.zero_padded(key).alias("case_id"), F.concat(F.lit("Company: "), F.col("s_name"), F.lit("\n")).alias("markdown"), F.when(key % 3 != 0, F.to_json(F.struct(F.col("s_nationkey").alias("nation")))).alias("packet_json"))
    root = new_folder(spark, "packets")
    staged(documents.write_packets(rows, root), "packet-files")
    source_of.register(spark)
    return spark.read.format("packets").option("folders_a_task", 32).load(root)


@query("""SELECT d.doc_id, l.doc_id IS NULL AS synthetic, CASE WHEN l.doc_id IS NULL THEN coalesce(d.text, '') ELSE 'quality ' || l.quality END AS body, CASE WHEN l.doc_id IS NULL THEN 'first_party' WHEN l.toxic = 1 THEN 'third_party' ELSE 'unknown' END AS source_bucket FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def j1_indexed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the index, labels as the files that some of them have; the others stand for themselves."""
    index = table(spark, sf_dir, "documents").select(F.col("source").alias("company"), F.lit("extra").alias("source_family"), F.col("doc_id").cast("string").alias("markdown_file"), F.col("text").alias("got"), "doc_id")
    kind = F.when(F.col("toxic") == 1, "third_party").otherwise("other")
    files = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("markdown_file"), F.concat(F.lit("---\nsource_type: "), kind, F.lit("\n---\n\nquality "), F.col("quality").cast("string"), F.lit("\n")).alias("raw"))
    return documents.indexed_pages(index, files).select("doc_id", "synthetic", "body", "source_bucket")


def host_index(spark: SparkSession, sf_dir: str, part_pages: int) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^https?://([^/?#]*)", 1).alias("company"), F.col("page_id").alias("pos"), F.col("url").alias("final_url"))
    return documents.company_index(pages.select("company").distinct(), pages, part_pages)


@query(f"""SELECT {SQL_PAGE_URL} AS company, count(*) AS n_pages, first(url ORDER BY page_id) AS first_url, last(url ORDER BY page_id) AS last_url FROM pages GROUP BY 1""")
def io14_company_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index document of each host; its pages are read back from the JSON of its parts."""
    read = F.from_json("pages", "array<struct<final_url:string>>")
    parts = host_index(spark, sf_dir, 1024).select("company", "part", "n_pages", F.element_at(read, 1)["final_url"].alias("first"), F.element_at(read, -1)["final_url"].alias("last"))
    return parts.groupBy("company").agg(F.sum("n_pages").alias("n_pages"), F.min_by("first", "part").alias("first_url"), F.max_by("last", "part").alias("last_url"))


_PAGE_JSON = "'{' || string_agg(CASE WHEN m = 'final_url' THEN '\"final_url\":' || to_json(url) ELSE '\"' || m || '\":\"\"' END, ',' ORDER BY o) || '}'"


@query(f"""WITH p AS (SELECT {SQL_PAGE_URL} AS company, page_id, url FROM pages WHERE url IS NOT NULL),
m AS (SELECT company, page_id, {_PAGE_JSON} AS page FROM p, (SELECT unnest({list(documents.INDEX_MEMBERS)}) AS m, unnest(range({len(documents.INDEX_MEMBERS)})) AS o) GROUP BY company, page_id),
r AS (SELECT *, (row_number() OVER (PARTITION BY company ORDER BY page_id) - 1) // 4 AS part, count(*) OVER (PARTITION BY company) AS n FROM m),
g AS (SELECT company, part, count(*) AS n_pages, (n + 3) // 4 AS parts, string_agg(page, ',' ORDER BY page_id) AS pages FROM r GROUP BY company, part, n)
SELECT company, part, parts, n_pages, CASE WHEN part = 0 THEN '{{"company":' || to_json(company) || ',"pages":[' ELSE ',' END || pages || CASE WHEN part = parts - 1 THEN ']}}' ELSE '' END AS index FROM g""")
def io14_index_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of index documents in parts of four pages."""
    return host_index(spark, sf_dir, 4).drop("pages")


@query(f"""WITH b AS (SELECT * FROM ({SQL_SCORES})) SELECT '{{"run_id":"r1","status_of":"bench","total":' || count(*) || ',"failed":' || count(*) FILTER (NOT ok) || '}}' AS manifest FROM b""")
def io16_run_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scores(spark, sf_dir).withColumn("parsed", F.col("parse_ok"))
    return documents.run_manifest({"run_id": "r1", "status_of": "bench"}, enrichment.run_summary(rows).select("total", "failed"))


@query(f"""SELECT model, count(*) AS cases FROM ({SQL_SCORES}) GROUP BY model""")
def c7_board_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary document of a leaderboard, read line by line."""
    board = documents.board_summary(benchmark.leaderboard(scores(spark, sf_dir), 0.45))
    lines = board.select(F.explode(F.slice(F.split("markdown", "\n"), 5, 1 << 20)).alias("line")).where("line <> ''")
    cell = F.split("line", r" \| ")
    return lines.select(F.regexp_replace(cell[0], r"^\| ", "").alias("model"), cell[1].cast("long").alias("cases"))


@query("SELECT doc_id, 'Judge this.' || chr(10) || chr(10) || CASE WHEN lang IS NULL THEN '' ELSE 'Ideal customer profile:' || chr(10) || lang || chr(10) || chr(10) END || coalesce(text, '') AS prompt FROM documents")
def c6_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", documents.prompt(F.coalesce("text", F.lit("")), "Judge this.", F.col("lang")).alias("prompt"))


@query("SELECT max(CAST(ceil(length(coalesce(text, '')) / 4.0) AS BIGINT)) AS max_tokens, floor(sum(n_chars / 1000000.0::DOUBLE) * 1e6 + 0.5) / 1e6 AS gold_cost_usd FROM documents")
def ag13_ag14_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest packet's tokens and what the gold outputs cost."""
    return table(spark, sf_dir, "documents").agg(F.max(text.estimated_tokens(F.col("text"))).alias("max_tokens"), text.half_up(F.sum(F.col("n_chars") / 1000000.0), 6).alias("gold_cost_usd"))


@query("""SELECT doc_id, CASE WHEN length(md) <= 1500 THEN md ELSE trim(substr(md, 1, greatest(1000, 1500 - 120 - length(task)))) || chr(10) || chr(10) || '[Content trimmed to benchmark budget: 1500 chars.]' || chr(10) || task END AS packet
FROM (SELECT doc_id, md, chr(10) || '## Task: last of two' AS task FROM (SELECT doc_id, 'Packet' || replace(regexp_replace(coalesce(text, ''), '[\\s\\x{00A0}\\x0B]+', '_', 'g'), '#', '') || chr(10) || '## Task: first' || chr(10) || '## Task: last of two' AS md FROM documents))""")
def f25_trimmed_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = F.replace(F.regexp_replace(F.coalesce("text", F.lit("")), f"{text.WS}+", "_"), F.lit("#"), F.lit(""))
    md = F.concat(F.lit("Packet"), plain, F.lit("\n## Task: first\n## Task: last of two"))
    return table(spark, sf_dir, "documents").select("doc_id", md.alias("md")).select("doc_id", text.trimmed_packet(F.col("md"), 1500).alias("packet"))


@query("""SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 6, '0') || '-' || substr(regexp_replace(regexp_replace(lower(c_name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 52) || '-' || 'r' || c_custkey AS folder,
 regexp_replace(c_name || '.x(y)', '([.*+?^${}()|\\[\\]\\\\])', '\\\\\\1', 'g') AS escaped FROM customer""")
def f26_f27_folders_escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    folder = text.output_folder(key - 1, F.col("c_name"), F.lit(""), F.concat(F.lit("r"), key.cast("string")))
    return table(spark, sf_dir, "customer").select("c_custkey", folder.alias("folder"), text.regex_escaped(F.concat("c_name", F.lit(".x(y)"))).alias("escaped"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H-%M-%S-') || lpad(CAST((epoch_us(ts) // 1000) % 1000 AS VARCHAR), 3, '0') || 'Z' AS stamp,
 CASE WHEN m < 60 THEN m || 'm' ELSE CAST(floor(m / 60) AS BIGINT) || 'h ' || (m % 60) || 'm' END AS duration FROM (SELECT *, CAST(ceil(event_id * 7 / 60.0) AS BIGINT) AS m FROM events)""")
def m_stamps_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", text.stamp(F.col("ts")).alias("stamp"), text.duration(F.col("event_id") * 7).alias("duration"))


@query("""SELECT conv_id, turn, text AS one, text || chr(10) || role AS parts FROM conversations""")
def n5_message_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as a JSON text and as a JSON array of parts."""
    part = lambda c: F.struct(F.lit("text").alias("type"), F.col(c).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", documents.json_text(F.col("text")).alias("a"), F.to_json(F.array(part("text"), part("role"))).alias("b"))
    return rows.select("conv_id", "turn", enrichment.message_text(F.col("a")).alias("one"), enrichment.message_text(F.col("b")).alias("parts"))


_GATE = "[" + ", ".join(f"'\\b(?:{p})\\b'" for _, p in GATE_TERMS) + "]"


@query(f"""WITH g AS (SELECT doc_id, lower(coalesce(text, '')) || ' our fund of funds is the ' || replace(source, '_', ' ') || ' lps and co-invests' AS t FROM documents),
 h AS (SELECT doc_id, t, CAST(len(list_filter({_GATE}, lambda p: regexp_matches(t, p))) AS BIGINT) AS n FROM g) SELECT doc_id, n AS n_labels, CASE WHEN n = 0 THEN 'no_keyword' ELSE 'pass' END AS route FROM h""")
def pf12_gate_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole list of the gate over all documents, each with some of its terms."""
    md = F.concat(F.coalesce("text", F.lit("")), F.lit(" our fund of funds is the "), F.replace("source", F.lit("_"), F.lit(" ")), F.lit(" lps and co-invests"))
    routed = enrichment.routed(texts(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"), F.replace(md, F.lit("\n"), F.lit(" ")).alias("markdown")))
    return routed.select(F.col("case_id").alias("doc_id"), F.size("labels").cast("long").alias("n_labels"), "route")


@query("""WITH s AS (SELECT user_id AS k, event_id, ts FROM events) SELECT k, event_id, CAST(n AS INTEGER) AS recent FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY event_id DESC) AS n FROM s) WHERE n <= 3""")
def w10_recent_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), "event_id")
    return enrichment.recent_rows(rows, "k", "event_id", 3).select("k", "event_id", "recent")


@query("""SELECT coalesce(l.doc_id, d.doc_id) AS case_id, CASE WHEN l.doc_id IS NOT NULL THEN 'cached' ELSE 'fresh' END AS origin FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def io15_with_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("case_id"), F.lit("cached").alias("origin"))
    return enrichment.with_cache(cache, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"), F.lit("fresh").alias("origin")))


@query("""SELECT d.doc_id AS case_id, CASE WHEN l.toxic = 1 THEN 'quality ' || l.quality END AS raw_text, CASE WHEN n_chars % 3 = 0 THEN CAST(ceil(length(coalesce(text, '')) / 4.0) AS BIGINT) ELSE n_chars % 3 END AS tokens,
 (CASE WHEN n_chars % 3 = 0 THEN CAST(ceil(length(coalesce(text, '')) / 4.0) AS BIGINT) ELSE n_chars % 3 END * 0.4::DOUBLE + 10 * 1.6::DOUBLE) / 1e6 AS cost_usd FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def j5_n6_fixtures_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture responses of one variant, token counts with their estimate, and the cost."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"), "text", "n_chars")
    fixtures = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("case_id"), F.when(F.col("toxic") == 1, "icp").otherwise("plain").alias("variant"), F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("raw_text"))
    tokens = enrichment.token_usage(F.col("n_chars") % 3, F.col("text"))
    rows = enrichment.fixture_responses(docs, fixtures, "icp").withColumn("tokens", tokens)
    return rows.select("case_id", "raw_text", "tokens", enrichment.usage_cost(F.col("tokens"), F.lit(10), 0.4, 1.6).alias("cost_usd"))


@query("SELECT DISTINCT d.doc_id AS case_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def j6_missing_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, gold = (table(spark, sf_dir, n).select(F.col("doc_id").alias("case_id")) for n in ("documents", "labels"))
    return benchmark.missing_gold(docs, gold)


@query(f"""WITH b AS (SELECT model, floor(avg(quality_score) * 1e4 + 0.5) / 1e4 AS q, floor(sum(cost_usd) / count(*) * 1e6 + 0.5) / 1e6 AS c, avg(quality_score) >= 0.45 AND avg(CAST(parse_ok AS INT)) >= 0.9 AS e FROM ({SQL_SCORES}) GROUP BY model)
SELECT model, CAST(row_number() OVER (ORDER BY e DESC, CASE WHEN e THEN c END NULLS FIRST, q DESC, c, model) AS BIGINT) AS place FROM b""")
def s3_ranked_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = benchmark.ranked_leaderboard(benchmark.leaderboard(scores(spark, sf_dir), 0.45))
    return source.with_row_index(ranked.withColumn("_at", F.monotonically_increasing_id()), "_at").select("model", (F.col("row_index") + 1).alias("place"))


_PLACES = (
    ("100 Main Street, Suite 5 Springfield, Illinois 62701 Phone: 1", "Springfield", "Illinois", "US"), ("near Springfield, IL 62701-1234 today", "Springfield", "Illinois", ""), ("code k1a 0b1 or K1A 0B1", "", "", "Canada"),
    ("", "Oslo", "", "Norway"), ("nothing here", "", "", ""), ("write to 12 Elm Rd. mailto:a@b.test 90210", "", "", ""),
)
_EXPECTED_PLACES = (
    (0, "62701", "100 Main Street, Suite 5 Springfield, Illinois 62701", "100 Main Street, Suite 5 Springfield, Illinois 62701, Springfield, Illinois, 62701, US", "scraped_site_text", "high"),
    (1, "62701-1234", "", "Springfield, Illinois 62701-1234", "csv_location_plus_scraped_postal_code", "medium"), (2, "K1A 0B1", "", "Canada K1A 0B1", "csv_location_plus_scraped_postal_code", "medium"),
    (3, "", "", "Oslo, Norway", "csv_city_state_country", "low"), (4, "", "", "", "", "none"), (5, "90210", "12 Elm Rd.", "12 Elm Rd., 90210", "scraped_site_text", "high"),
)


def values_sql(columns: str, rows) -> str:
    def literal(v) -> str:
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"CAST({v} AS DOUBLE)" if isinstance(v, float) else f"CAST({v} AS BIGINT)"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) AS v({columns})"


@query(values_sql("place, code, street, full_address, source, confidence", _EXPECTED_PLACES))
def f12_f15_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postal code, street and choice of address of literal texts; the tables hold no addresses."""
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(_PLACES)], "place long, t string, city string, state string, country string")
    found = rows.select("place", "city", "state", "country", facts.postal_code(F.col("t"), F.col("city"), F.col("state")).alias("code"), facts.street_address(F.col("t")).alias("street"))
    choice = facts.address_choice(F.col("street"), F.col("code"), F.col("city"), F.col("state"), F.col("country"))
    return found.select("place", "code", "street", choice.alias("a")).select("place", "code", "street", "a.full_address", "a.source", "a.confidence")


@query(values_sql("n, code", [(0, "CA"), (1, "NY"), (2, "DC"), (3, "Ontario"), (4, ""), (5, "TX")]))
def f13_state_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(list(enumerate(["California", "new york", " District of Columbia ", "Ontario", "", "TX"])), "n long, s string")
    return rows.select("n", facts.state_code(F.col("s")).alias("code"))


@query(values_sql("n, city, state, country", [(0, "Springfield", "IL", "United States"), (1, "", "", ""), (2, "Ottawa", "Ontario", ""), (3, "", "", "")]))
def f16_location_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(list(enumerate(["1 Main St, Springfield, IL, 62701, United States", "Oslo", "2 B Rd, Ottawa, Ontario, K1A 0B1", None])), "n long, a string")
    return rows.select("n", facts.location_parts(F.col("a")).alias("p")).select("n", "p.*")


@query(values_sql("n, logo_url, logo_source, favicon_url, favicon_source", [
    (0, "http://c.test/l.png", "csv.logo_url", "https://a.test/i.ico", "scraped_icon_link"), (1, "https://a.test/l.png", "scraped_site_asset", "https://a.test/favicon.ico", "origin_favicon_fallback"),
    (2, "https://b.test/favicon.ico", "favicon_fallback", "https://b.test/favicon.ico", "origin_favicon_fallback"), (3, "", "", "", ""),
]))
def f17_asset_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(0, "http://c.test/l.png", "https://a.test/l.png", "https://a.test/i.ico", "https://a.test/x", ""), (1, "", "https://a.test/l.png", "", "https://a.test/x", ""), (2, "", "", None, "", "b.test"), (3, None, None, None, None, None)]
    frame = spark.createDataFrame(rows, "n long, own string, logo string, icon string, url string, domain string")
    return frame.select("n", source.asset_choice(*[F.col(c) for c in ("own", "logo", "icon", "url", "domain")]).alias("x")).select("n", "x.*")
