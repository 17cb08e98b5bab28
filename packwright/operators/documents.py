"""Documents: pages with a header of named values, packet folders, company indexes, prompts and summaries."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packwright.functions.text import WS, bound, text_hash, text_or_empty, trimmed
from packwright.operators.ordered import sums_before
from packwright.operators.packets import source_bucket
from packwright.sources.files import write_whole
from packwright.sources.staging import staged

# ---- Fixed values of the contract ----
PACKET_TEXT, PACKET_JSON = "llm_input.md", "llm_input.json"
PAGE_MEMBERS = ("run_id", "row_index", "source_record_id", "company_name", "legal_name", "domain", "website_url", "investor_type", "source_context", "csv_city", "csv_state", "csv_country", "source_type", "source_family", "reason", "requested_url", "final_url", "page_name", "page_path", "page_title", "markdown_file", "fetched_at", "fetch_status", "http_status", "content_type", "markdown_chars", "text_chars", "logo_candidates", "favicon_candidates")
INDEX_MEMBERS = ("page_name", "page_path", "source_family", "requested_url", "final_url", "fetch_status", "http_status", "markdown_file", "got")
# --------------------------------------


def header_value(text: Column) -> Column:
    """A header's value: what it holds as JSON text, or without one quote at either end."""
    bare = F.regexp_replace(text, "^['\"]|['\"]\\z", "")
    parsed = F.try_parse_json(F.when(text != "", text))
    kind = F.schema_of_variant(parsed)
    return F.when(kind == "STRING", F.try_variant_get(parsed, "$", "string")).when(kind == "VOID", F.lit("")).when(parsed.isNotNull(), text).otherwise(bare)


def split_header(raw: Column) -> Column:
    """frontmatter (map of texts) and body of a document; of repeated names the last counts.

    A document without an opening and a closing line of three dashes is all body.
    """
    pattern = r"(?s)\A---\n(.*?)\n---(.*)\z"
    line = lambda x: bound(F.locate(":", x), lambda at: F.when(at > 0, F.struct(trimmed(F.substring(x, F.lit(1), at - 1)).alias("key"), header_value(trimmed(F.substring(x, at + 1, F.length(x)))).alias("value"))))
    entries = F.filter(F.transform(F.split(trimmed(F.regexp_extract(raw, pattern, 1)), r"\r?\n"), line), lambda e: e.isNotNull())
    last = lambda es: F.filter(es, lambda e, i: ~F.exists(F.slice(es, i + 2, F.size(es)), lambda later: later["key"] == e["key"]))
    body = trimmed(F.substring(F.regexp_extract(raw, pattern, 2), 2, 1 << 30))
    empty = F.create_map().cast("map<string,string>")
    both = F.struct(bound(entries, lambda es: F.map_from_entries(last(es))).alias("frontmatter"), body.alias("body"))
    return F.when(raw.rlike(r"(?s)\A---\n.*?\n---"), both).otherwise(F.struct(empty.alias("frontmatter"), F.coalesce(raw, F.lit("")).alias("body")))


def json_text(text: Column) -> Column:
    """A text as a JSON string."""
    return bound(F.to_json(F.array(text)), lambda j: F.substring(j, F.lit(2), F.length(j) - 2))


def rendered_header(values: dict[str, Column], structured: tuple[str, ...] = ()) -> Column:
    """Lines ``name: value`` between dashes; ``structured`` members are JSON already."""
    lines = [F.concat(F.lit(f"{k}: "), F.coalesce(v, F.lit('""')) if k in structured else json_text(text_or_empty(v))) for k, v in values.items()]
    return F.concat_ws("\n", F.lit("---"), *lines, F.lit("---"))


def page_document(pages: DataFrame) -> Column:
    """The document of a fetched page: a header of PAGE_MEMBERS, a title, four lines, and the Markdown.

    Columns that ``pages`` lacks are empty; arrays and maps are written as JSON.
    """
    kinds = dict(pages.dtypes)
    structured = tuple(k for k in PAGE_MEMBERS if kinds.get(k, "string").startswith(("array", "map", "struct")))
    values = {k: (F.to_json(F.col(k)) if k in structured else F.col(k)) if k in kinds else F.lit("") for k in PAGE_MEMBERS}
    value = lambda k: F.coalesce(F.col(k).cast("string"), F.lit("")) if k in kinds else F.lit("")
    final = F.coalesce(F.nullif(value("final_url"), F.lit("")), value("requested_url"))
    lines = [rendered_header(values, structured), F.lit(""), F.concat(F.lit("# "), value("page_name")), F.lit("")]
    lines += [F.concat(F.lit(label), v) for label, v in (("Company: ", value("company_name")), ("Domain: ", value("domain")), ("Page path: ", value("page_path")), ("Final URL: ", final))]
    return F.concat(F.concat_ws("\n", *lines, F.lit("")), value("markdown"), F.lit("\n"))


def indexed_pages(index: DataFrame, files: DataFrame) -> DataFrame:
    """Each indexed page with its document's header and body; one without a document stands for itself.

    index: company, source_family, markdown_file, got, ...; files: markdown_file, raw.  The join keeps every
    indexed page: where there is no file, ``got`` is the body and the page counts as the company's own.
    """
    parsed = files.select("markdown_file", F.col("raw").alias("_raw"), split_header(F.col("raw")).alias("_doc"))
    joined = index.join(parsed, "markdown_file", "left")
    found, got = F.col("_raw").isNotNull(), F.coalesce("got", F.lit(""))
    third = F.when(F.coalesce(F.col("source_family"), F.lit("")).contains("third"), "third_party").otherwise("first_party_external")
    own = F.create_map(F.lit("company_name"), F.col("company"), F.lit("source_type"), third)
    kind = F.when(found, F.coalesce(F.element_at("_doc.frontmatter", "source_type"), F.lit(""))).otherwise("first_party_external")
    body = F.when(found, F.col("_doc.body")).otherwise(got)
    out = joined.withColumn("frontmatter", F.when(found, F.col("_doc.frontmatter")).otherwise(own)).withColumn("body", body).withColumn("raw_chars", F.length(F.coalesce("_raw", got)).cast("long"))
    return out.withColumn("content_hash", text_hash(F.col("body"))).withColumn("source_bucket", source_bucket(kind, F.coalesce("source_family", F.lit("")))).withColumn("synthetic", ~found).drop("_raw", "_doc")


def company_index(entities: DataFrame, sources: DataFrame, part_pages: int = 1024) -> DataFrame:
    """company, part, parts, n_pages, pages, index: the JSON document of a company with its pages by ``pos``, in parts.

    ``pages`` is the JSON array of a part's pages; the texts of ``index``, in the order of their parts, are the
    document.  A part holds ``part_pages`` pages, so a company of any number of pages is never whole in a task.
    A company without pages has one part; pages of no listed company, or of none, are left out.
    """
    members = [F.col(c) if c in sources.columns else F.lit("").alias(c) for c in INDEX_MEMBERS]
    slim = sources.where("company IS NOT NULL").select("company", "pos", F.to_json(F.struct(*members)).alias("page"), F.lit(1).cast("long").alias("_one"))
    placed = sums_before(slim, "company", "pos", "_one").withColumn("part", F.floor(F.col("before") / part_pages))
    pages = F.transform(F.array_sort(F.collect_list(F.struct("before", "page"))), lambda x: x["page"])
    pieces = staged(placed.groupBy("company", "part").agg(F.array_join(pages, ",").alias("_pages"), F.count("*").alias("n_pages")), "index-parts")
    parts = pieces.groupBy("company").agg(F.count("*").alias("parts"))
    head = entities.select("company", F.to_json(F.struct(*[F.col(f"`{c}`") for c in entities.columns])).alias("_head")).join(parts, "company", "left")
    joined = head.join(pieces, "company", "left").select("company", F.coalesce("part", F.lit(0)).alias("part"), F.coalesce("parts", F.lit(1)).alias("parts"), F.coalesce("n_pages", F.lit(0)).alias("n_pages"), F.coalesce("_pages", F.lit("")).alias("_pages"), "_head")
    opened = F.concat(F.substring("_head", F.lit(1), F.length("_head") - 1), F.when(F.col("_head") == "{}", "").otherwise(","), F.lit('"pages":['))
    text = F.concat(F.when(F.col("part") == 0, opened).otherwise(","), "_pages", F.when(F.col("part") == F.col("parts") - 1, "]}").otherwise(""))
    return joined.select("company", "part", "parts", "n_pages", F.concat(F.lit("["), "_pages", F.lit("]")).alias("pages"), text.alias("index"))


def write_packets(packets: DataFrame, root: str) -> DataFrame:
    """Writes packets(case_id, markdown, packet_json) as folders under ``root``; rows: case_id, files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, files = batch.column(0).to_pylist(), []
            for case_id, markdown, packet in zip(ids, batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if packet is not None:
                    write_whole(f"{root}/{case_id}/{PACKET_JSON}", [packet.encode()])
                # the document comes last: a packet is there when it is
                write_whole(f"{root}/{case_id}/{PACKET_TEXT}", [(markdown or "").encode()])
                files.append(1 + (packet is not None))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(files, pa.int32())], ["case_id", "files"])

    return packets.select("case_id", "markdown", "packet_json").mapInArrow(run, "case_id string, files int")


def read_packets(spark: SparkSession, root: str, hidden: bool = True) -> DataFrame:
    """case_id, markdown, packet_json of the packet folders under ``root``; folders without a packet text don't count.

    hidden: whether folders whose name starts with an underscore count too.
    """

    def files(name: str, column: str) -> DataFrame:
        path = F.col("_metadata.file_path")
        return spark.read.text(f"{root}/*/{name}", wholetext=True).select(F.url_decode(F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)).alias("case_id"), F.col("value").alias(column))

    texts = files(PACKET_TEXT, "markdown")
    texts = texts if hidden else texts.where(~F.col("case_id").startswith("_"))
    try:
        side = files(PACKET_JSON, "packet_json")
    except Exception as e:  # no folder has a side file
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return texts.withColumn("packet_json", F.lit("{}"))
    return texts.join(side, "case_id", "left").withColumn("packet_json", F.coalesce("packet_json", F.lit("{}")))


def packet_facts(packets: DataFrame) -> DataFrame:
    """packets with company_name and domain, as their lines name them, and their number of characters."""
    named = lambda label: trimmed(F.regexp_extract("markdown", rf"(?m)^{label}:{WS}*(.+)$", 1))
    return packets.withColumn("company_name", F.coalesce(F.nullif(named("Company"), F.lit("")), F.col("case_id"))).withColumn("domain", named("Domain")).withColumn("md_chars", F.length("markdown").cast("long"))


def prompt(markdown: Column, instructions: str, profile: Column | None = None) -> Column:
    """Instructions, the customer profile where there is one, and the packet."""
    parts = [F.lit(instructions)] + ([F.when(F.coalesce(profile, F.lit("")) != "", F.concat(F.lit("Ideal customer profile:\n"), profile))] if profile is not None else [])
    return F.concat_ws("\n\n", *parts, markdown)


def board_summary(board: DataFrame) -> DataFrame:
    """markdown: a leaderboard of at most as many lines as there are models, as a table."""
    cells = ["model", "cases", "avg_quality_score", "parse_rate", "avg_cost_per_case_usd", "eligible"]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cells]), F.lit(" |"))
    order = F.struct((~F.col("eligible")).alias("a"), F.when(F.col("eligible"), F.col("avg_cost_per_case_usd")).alias("b"), (-F.col("avg_quality_score")).alias("c"), F.col("avg_cost_per_case_usd").alias("d"), F.col("model").alias("e"), line.alias("line"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["line"]), "\n")
    head = "| " + " | ".join(cells) + " |\n|" + " --- |" * len(cells)
    return board.agg(F.concat(F.lit("# Leaderboard\n\n" + head + "\n"), lines, F.lit("\n")).alias("markdown"))


def run_manifest(run: dict[str, str], *summaries: DataFrame) -> DataFrame:
    """manifest: one JSON document of a run's settings and the members of one-row summaries."""
    spark = summaries[0].sparkSession
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in run.items()])
    for summary in summaries:
        row = row.crossJoin(summary)  # each side is one row
    return row.select(F.to_json(F.struct(*[F.col(c) for c in row.columns])).alias("manifest"))
