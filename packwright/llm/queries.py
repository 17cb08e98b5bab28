"""Queries of the training-data operators and their SQL; __spark_entry__ adds them where this subpackage exists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parameter of all operators that encode: where the public vocabulary lies.
BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"


def vocabulary_path(name: str = BYTE_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify, learn, training_rows

    docs = table(spark, sf_dir, "documents")
    return identify(docs, learn(docs.where(training_rows(docs))))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), vocabulary_path("piece_bpe_32k.model"))


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import round_trip_digests

    return round_trip_digests(table(spark, sf_dir, "documents"), vocabulary_path())


def op5_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .arc_warc import archive_round_trip

    return archive_round_trip(table(spark, sf_dir, "pages"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import judge_quality

    return judge_quality(table(spark, sf_dir, "documents")).drop("failed_rule")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import scan_secrets

    return scan_secrets(table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import token_files_round_trip

    return token_files_round_trip(table(spark, sf_dir, "documents"), vocabulary_path())


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import Near, near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), Near(words=3, percent=85))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge_urls

    return judge_urls(table(spark, sf_dir, "pages"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fill_in_middle import middle_digests

    return middle_digests(table(spark, sf_dir, "documents"))


def op12_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import packed

    return packed(table(spark, sf_dir, "documents"), vocabulary_path(WORD_BPE))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


# ---- The columns of these operators that SQL can express, over the same whole tables ----


def language_id_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_language_id(spark, sf_dir).selectExpr("doc_id", "held_out", "lang_pred = 'und' AS undetermined")


def archive_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_arc_to_warc(spark, sf_dir).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def secret_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def near_dedup_exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many groups each set of documents with equal words falls into: one."""
    words = F.regexp_replace(F.regexp_replace(F.lower("text"), "[\\x20\\x09-\\x0D]+", " "), "^ | $", "")
    # digests are joined, not texts, and as bytes up to the end
    docs = table(spark, sf_dir, "documents").select("doc_id", F.unhex(F.sha2(words, 256)).alias("digest"))
    both = op9_near_dedup(spark, sf_dir).where("n_shingles > 0").select("doc_id", "component_id").join(docs, "doc_id")
    found = both.groupBy("digest").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_id"), F.count_distinct("component_id").alias("groups"))
    return found.select(F.lower(F.hex("digest")).alias("words_sha256"), "documents", "first_id", "groups")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_url_filter(spark, sf_dir).selectExpr("page_id", "host", "path", "rule", "CASE WHEN rule IS NOT NULL THEN verdict END AS rule_verdict")


_OPERATORS = (op1_language_id, op2_decontaminate, op3_token_counts, op4_bpe_round_trip, op5_arc_to_warc, op6_quality_rules, op7_secret_scan, op8_token_files, op9_near_dedup, op10_url_filter, op11_fill_in_middle, op12_binary_packing, op13_collocations)
_COLUMNS = (language_id_split, archive_records, quality_base_counts, secret_base_counts, near_dedup_exact_copies, url_rules)
QUERIES = {f.__name__: f for f in (*_OPERATORS, *_COLUMNS)}

_WORD = "[^\\x20\\x09-\\x0D]+"
_CRC_STEP = "list_reduce(list_prepend(xor(h, c), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"

#: SQL of op11, op13 and the queries of ``_COLUMNS``; what the other dealt methods add to them is no SQL and is tested against brute force.
SQL: dict[str, str] = {
    "language_id_split": f"""SELECT doc_id, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda h, c: {_CRC_STEP}), 4294967295) % 5 = 0 AS held_out,
 text IS NULL OR NOT regexp_matches(text, '\\pL') AS undetermined FROM documents""",
    "archive_records": """WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages), s AS (SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest FROM p),
 f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM s)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to FROM f""",
    "quality_base_counts": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), w AS (SELECT doc_id, t, regexp_extract_all(t, '{_WORD}') AS ws FROM d),
 l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls FROM d),
 g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w)),
 r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
 c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) AS s(k) GROUP BY doc_id),
 b AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM w JOIN l USING (doc_id) LEFT JOIN c USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b""",
    "secret_base_counts": """SELECT doc_id, CAST(len(list_filter(regexp_extract_all(t, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda x: length(x) >= 6)) AS BIGINT) AS n_assign,
 CAST(len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) AS BIGINT) AS n_access, CAST(len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 24)) AS BIGINT) AS n_hex
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""",
    "near_dedup_exact_copies": """SELECT sha256(regexp_replace(regexp_replace(lower(text), '[\x20\x09-\x0D]+', ' ', 'g'), '^ | $', '', 'g')) AS words_sha256, count(*) AS documents, min(doc_id) AS first_id, CAST(1 AS BIGINT) AS groups
FROM documents WHERE regexp_matches(text, '[^\x20\x09-\x0D]') GROUP BY 1""",
    "url_rules": """WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*') ELSE '' END AS host, CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages),
 h AS (SELECT page_id, translate(host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM u), r(rhost, rpath, rverdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block'))
SELECT page_id, host, path, rhost || rpath AS rule, rverdict AS rule_verdict FROM h LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC NULLS LAST) = 1""",
    "op11_fill_in_middle": """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
 g AS (SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
 c AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
 p AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM p""",
    "op13_collocations": """WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
 w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p), t AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
 g AS (SELECT lang, k, unnest(list_transform(generate_series(1, len(ws) - k + 1), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3), (4)) AS s(k)),
 f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 30),
 c AS (SELECT *, unnest(generate_series(1, k - 1)) AS cut, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
 s AS (SELECT c.lang, c.k, c.phrase, c.a, cut, x.a AS l, y.a AS r, (CAST(c.a AS HUGEINT) * 2000000) // (CAST(x.a AS HUGEINT) + y.a) AS score FROM c JOIN f AS x ON x.lang = c.lang AND x.phrase = array_to_string(ws[1:cut], ' ') JOIN f AS y ON y.lang = c.lang AND y.phrase = array_to_string(ws[cut + 1:], ' ')),
 m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
 e AS (SELECT DISTINCT m.lang, m.phrase FROM m JOIN (SELECT lang, a, unnest([array_to_string(ws[1:k - 1], ' '), array_to_string(ws[2:], ' ')]) AS phrase FROM c WHERE k > 2 AND cut = 1) AS q ON q.lang = m.lang AND q.phrase = m.phrase AND 100 * CAST(q.a AS HUGEINT) >= 80 * CAST(m.a AS HUGEINT))
SELECT m.lang, row_number() OVER (PARTITION BY m.lang ORDER BY score DESC, m.a DESC, encode(m.phrase)) AS rank, m.phrase, m.a, m.l, m.r, t.n, CAST(score AS BIGINT) AS score FROM m JOIN t ON t.lang = m.lang ANTI JOIN e ON e.lang = m.lang AND e.phrase = m.phrase
QUALIFY rank <= 2000""",
}
