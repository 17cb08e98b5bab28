"""Scoring, deduplication, ranking and budgeting of cleaned pages, and the packet that results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from packwright.functions.facts import emails, fact_signals, first_sentence, location_parts, phones, postal_hints, snippets, terms, without_urls
from packwright.functions.text import clip_text, half_up, page_key, text_hash, trimmed, whole_word
from packwright.operators.ordered import last_of_fold
from packwright.sources.staging import staged

# ---- Fixed values of the contract ----
MIN_USEFUL, BUDGET, MAX_PAGES = 220, 1_000_000, 999
PATH_SIGNALS = (
    ("contact|location|office|address", 62, "contact_address_signal"),
    ("about|company|who-we-are|who_we_are|overview|foundation|history|mission", 52, "company_profile_signal"),
    ("team|people|leadership|partner|founder|management", 42, "team_people_signal"),
    ("portfolio|investments|companies|startups|grants|funding|fund|strategy|approach|thesis|criteria", 46, "capital_or_portfolio_signal"),
    ("services|solutions|products|industries|markets|capabilities|sectors", 34, "services_capabilities_signal"),
    ("blog|news|press|article|insights|events", 8, "news_or_blog_context"),
)
HOMEPAGE = (36, "homepage_identity_signal")
TEMPLATE_URL = r"(?i)%7b%7b|\{\{|\}\}|\[object object\]"
BINARY_URL, BINARY_TEXT = r"\.(pdf|zip|gz|tar)(?:\z|\?)", "(?i)^%pdf"
ACCOUNT_WORDS = "account|login|logout|signin|sign-in|register|cart|checkout|basket|password|auth|authentication"
LEGAL_WORDS = "privacy|terms|cookie|cookies|accessibility|sitemap|site-map|legal|disclaimer"
SEARCH_WORDS = r"search|\?s=|\?q=|filter=|tag=|category="
NOT_FOUND = whole_word("404") + r"|page can.?t be found|page not found|page you are looking for does not|not found template"
PARKED = whole_word("domain geparkt") + "|" + whole_word("domain parked") + r"|domainparking|easyname\.com|domain wird von .* verwaltet"
NOT_FOUND_WITHIN, PARKED_WITHIN = 1600, 2200
PENALTIES = (
    (("legal_or_policy_page", "account_or_commerce_utility_page"), 70),
    (("binary_or_pdf_not_text_ready", "placeholder_or_template_url"), 90),
    (("fetch_failed_or_error_status", "not_found_template", "domain_parking_page"), 100),
    (("too_little_useful_text",), 25),
)
PACKET_LINES = (
    "Use this as the primary source.",
    "Use this only when the company's own site does not answer something or needs corroboration.",
    "Fill the enriched JSON for this company using the scraped content above. Do not use CSV type/classification labels as truth. If something is not supported by the scraped content, leave it empty or mark it unresolved.",
)
KEEP_ABOVE, NEAR_SCORE, MAX_LENGTH_BONUS, CHARS_PER_POINT = 20, 5, 20, 900
# --------------------------------------


@dataclass(frozen=True)
class PacketOptions:
    """salts: parts into which a company's pages are ranked first, so that a very large company is spread."""

    min_useful: int = MIN_USEFUL
    budget: int = BUDGET
    max_pages: int = MAX_PAGES
    salts: int = 16

    @property
    def most_kept(self) -> int:
        """No company can keep more pages than this: every kept page but the first has min_useful characters."""
        return min(self.max_pages, self.budget // max(1, self.min_useful) + 1)


def source_bucket(source_type: Column, source_family: Column) -> Column:
    label = F.lower(F.concat_ws(" ", source_type, source_family))
    return F.when(label.contains("third"), "third_party").when(label.rlike("first|homepage|nav_link"), "first_party").otherwise("unknown")


def drop_reasons(min_useful: int = MIN_USEFUL) -> Column:
    """Why a page is no evidence; columns fetch_status, http_status, page_path, final_url, clean_text."""
    path = F.lower(F.concat_ws(" ", F.coalesce("page_path", F.lit("")), F.coalesce("final_url", F.lit(""))))
    url = F.concat(F.coalesce("final_url", F.lit("")), F.coalesce("page_path", F.lit("")))
    text = F.coalesce("clean_text", F.lit(""))
    rules = (
        (~F.col("fetch_status").eqNullSafe("ok") | F.coalesce(F.col("http_status").cast("int") >= 400, F.lit(False)), "fetch_failed_or_error_status"),
        (F.length(text) < min_useful, "too_little_useful_text"),
        (url.rlike(TEMPLATE_URL), "placeholder_or_template_url"),
        (path.rlike(BINARY_URL) | trimmed(text).rlike(BINARY_TEXT), "binary_or_pdf_not_text_ready"),
        (path.rlike(whole_word(ACCOUNT_WORDS)), "account_or_commerce_utility_page"),
        (path.rlike(whole_word(LEGAL_WORDS)), "legal_or_policy_page"),
        (path.rlike(whole_word(SEARCH_WORDS)), "search_or_listing_noise"),
        (F.lower(F.substring(text, 1, NOT_FOUND_WITHIN)).rlike(NOT_FOUND), "not_found_template"),
        (F.lower(F.substring(text, 1, PARKED_WITHIN)).rlike(PARKED), "domain_parking_page"),
    )
    return F.array_compact(F.array(*[F.when(test, F.lit(why)) for test, why in rules]))


def score_pages(cleaned: DataFrame, options: PacketOptions = PacketOptions()) -> DataFrame:
    """cleaned pages with score, keep, keep_reasons and drop_reasons."""
    path = F.lower(F.concat_ws(" ", F.coalesce("page_path", F.lit("")), F.coalesce("final_url", F.lit(""))))
    home = (F.col("page_path") == "/") | (F.col("page_name") == "homepage")
    signals = [(F.coalesce(home, F.lit(False)), *HOMEPAGE)] + [(path.rlike(pattern), points, why) for pattern, points, why in PATH_SIGNALS]
    points = sum((F.when(test, F.lit(p)).otherwise(0) for test, p, _ in signals), F.lit(0))
    reasons = F.array_compact(F.array(*[F.when(test, F.lit(why)) for test, _, why in signals]))
    with_facts = cleaned.withColumn("drop_reasons", drop_reasons(options.min_useful)).withColumn("_facts", fact_signals(F.coalesce("clean_text", F.lit(""))))
    penalty = sum((F.when(F.arrays_overlap("drop_reasons", F.array(*[F.lit(g) for g in group])), F.lit(p)).otherwise(0) for group, p in PENALTIES), F.lit(0))
    bonus = F.least(F.lit(MAX_LENGTH_BONUS), F.floor(F.col("clean_chars") / CHARS_PER_POINT))
    score = (points + F.col("_facts.score") + bonus - penalty).cast("long")
    scored = with_facts.withColumn("score", score).withColumn("keep_reasons", F.concat(reasons, "_facts.reasons")).drop("_facts")
    return scored.withColumn("keep", (F.size("drop_reasons") == 0) & (F.col("score") > KEEP_ABOVE))


def duplicate_pages(scored: DataFrame) -> DataFrame:
    """company, pos, selected: whether the page, or one equal to it, is the copy that stays under its key.

    The choice is an ordered fold: a page replaces the copy so far if it scores more, or if it is
    longer and at most NEAR_SCORE points worse; so it depends on the order of pages, and on that alone.
    A key's pages are dealt by their order, any number of them to many tasks (``last_of_fold``).
    """
    slim = scored.select(
        "company", "pos", "score", "clean_chars",
        page_key(F.coalesce(F.when(F.col("final_url") != "", F.col("final_url")), F.lit("")), F.col("page_path"), F.col("content_hash")).alias("key"),
        F.concat_ws("|", F.coalesce("markdown_file", F.lit("")), F.coalesce("final_url", F.lit("")), "content_hash").alias("page"),
    )
    best = last_of_fold(slim, "company", "key", ["pos"], "score", "clean_chars", "page", NEAR_SCORE).withColumnRenamed("what", "best_page")
    return slim.join(best, ["company", "key"], "left").select("company", "pos", F.coalesce(F.col("page") == F.col("best_page"), F.lit(True)).alias("selected"))


def within_budget(keepable: DataFrame, options: PacketOptions = PacketOptions()) -> DataFrame:
    """company, pos of the pages that fit, by score, name and position; the first page always fits.

    A company's pages are ranked in ``salts`` parts first.  The best ``most_kept`` of each part hold
    every page that can be kept, so the second ranking sees a bounded number of rows for a company.
    """
    order = [F.desc("score"), F.collate("page_name", "UNICODE"), F.col("pos")]
    slim = keepable.select("company", "pos", "score", "page_name", "clean_chars").withColumn("_part", F.pmod(F.hash("pos"), F.lit(options.salts)))
    first = slim.withColumn("_rank", F.row_number().over(Window.partitionBy("company", "_part").orderBy(*order))).where(F.col("_rank") <= options.most_kept)
    ranked = Window.partitionBy("company").orderBy(*order)
    running = F.sum("clean_chars").over(ranked.rowsBetween(Window.unboundedPreceding, 0))
    chosen = first.withColumn("_running", running).withColumn("_rank", F.row_number().over(ranked))
    fits = (F.col("_rank") <= options.max_pages) & ((F.col("_running") <= options.budget) | (F.col("_rank") == 1))
    return chosen.where(fits).select("company", "pos", F.col("_running").alias("running_chars"), F.col("_rank").alias("rank"))


def choose_pages(scored: DataFrame, options: PacketOptions = PacketOptions()) -> DataFrame:
    """scored pages with their final keep and drop_reasons, after duplicates and budget.

    Duplicates and budget are decided on slim columns; only what changes comes back to the pages with
    their text, in one join.
    """
    slim = scored.select("company", "pos", "score", "keep", "page_name", "clean_chars").join(duplicate_pages(scored), ["company", "pos"])
    fits = within_budget(slim.where("keep AND selected"), options).select("company", "pos", F.lit(True).alias("_fits"))
    over = F.col("keep") & F.col("selected") & F.col("_fits").isNull()
    flags = slim.join(fits, ["company", "pos"], "left").select("company", "pos", (~F.col("selected")).alias("_lost"), over.alias("_over")).where("_lost OR _over")
    joined = scored.join(flags, ["company", "pos"], "left")
    lost, over = F.coalesce("_lost", F.lit(False)), F.coalesce("_over", F.lit(False))
    reasons = F.when(lost, F.array_union("drop_reasons", F.array(F.lit("duplicate_page_or_content")))).when(over, F.array_append("drop_reasons", F.lit("outside_llm_budget"))).otherwise(F.col("drop_reasons"))
    return joined.withColumn("drop_reasons", reasons).withColumn("keep", F.col("keep") & ~lost & ~over).drop("_lost", "_over")


def packet_pages(cleaned: DataFrame, options: PacketOptions = PacketOptions()) -> DataFrame:
    """From cleaned pages to the final inventory; adds the content hash where it is missing."""
    if "content_hash" not in cleaned.columns:
        cleaned = cleaned.withColumn("content_hash", text_hash(F.coalesce("body", F.lit(""))))
    for name in ("markdown_file",):
        if name not in cleaned.columns:
            cleaned = cleaned.withColumn(name, F.lit("").cast("string"))
    return choose_pages(staged(score_pages(cleaned, options), "scored-pages"), options)


def company_quality(final: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """One row a company: pages, characters, reduction, found facts, and why pages were dropped.

    facts: company with emails, phones, full_address, postal_code and logo_url (``company_facts``).
    """
    kept = F.col("keep")
    raw, llm = F.sum("raw_chars"), F.coalesce(F.sum(F.when(kept, F.col("clean_chars"))), F.lit(0))
    rows = final.groupBy("company").agg(
        F.count("*").alias("raw_pages"),
        F.count_if(kept).alias("kept_pages"),
        F.count_if(~kept).alias("dropped_pages"),
        raw.alias("raw_chars"),
        llm.alias("llm_chars"),
        F.when(raw > 0, half_up((1 - llm / raw) * 100, 1)).otherwise(0.0).alias("reduction_pct"),
        F.count_if(kept & (F.col("source_bucket") == "first_party")).alias("first_party_kept"),
        F.count_if(kept & (F.col("source_bucket") == "third_party")).alias("third_party_kept"),
    )
    # a company's reasons are at most as many as there are rules
    reasons = final.where("NOT keep").select("company", F.explode("drop_reasons").alias("reason")).groupBy("company", "reason").agg(F.count("*").alias("n"))
    reasons = reasons.groupBy("company").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("drop_reasons"))
    rows = rows.join(reasons, "company", "left").withColumn("drop_reasons", F.coalesce("drop_reasons", F.create_map().cast("map<string,bigint>")))
    if facts is None:
        return rows
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    number = lambda c: F.greatest(F.size(F.coalesce(F.col(c), F.array().cast("array<string>"))), F.lit(0)).cast("long")
    joined = rows.join(facts.select("company", "emails", "phones", "full_address", "postal_code", "logo_url"), "company", "left")
    found = {"emails_found": number("emails"), "phones_found": number("phones"), "address_found": filled("full_address"), "postal_code_found": filled("postal_code"), "logo_found": filled("logo_url")}
    return joined.select(*rows.columns, *[c.alias(n) for n, c in found.items()])


def company_facts(final: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """company, emails, phones, full_address, postal_code, logo_url that its pages and its row show.

    known: company with full_address, postal_code and logo_url of the crawl.  A postal code comes from
    there, else from the first kept page that shows one, else, where none is kept, from any page.
    """
    code = lambda text: F.get(postal_hints(text, None, 1), F.lit(0))
    codes = final.select("company", "pos", F.col("keep").alias("kept"), F.when(F.col("keep"), code(F.coalesce("clean_text", F.lit("")))).otherwise(code(F.coalesce("body", F.lit("")))).alias("code"))
    kept_chars = final.groupBy("company").agg(F.coalesce(F.sum(F.when(F.col("keep"), F.col("clean_chars"))), F.lit(0)).alias("_kept"))
    first = codes.where("code IS NOT NULL").groupBy("company").agg(F.min(F.when(F.col("kept"), F.struct("pos", "code")))["code"].alias("_own"), F.min(F.struct("pos", "code"))["code"].alias("_any"))
    out = kept_chars.join(first, "company", "left").join(company_contacts(final, "emails", 10).withColumnRenamed("values", "emails"), "company", "left").join(company_contacts(final, "phones", 8).withColumnRenamed("values", "phones"), "company", "left")
    hint = F.when(F.col("_kept") > 0, F.col("_own")).otherwise(F.col("_any"))
    if known is not None:
        out = out.join(known.select("company", "full_address", F.col("postal_code").alias("_code"), "logo_url"), "company", "left")
        hint = F.coalesce(F.nullif("_code", F.lit("")), hint)
    else:
        out = out.withColumn("full_address", F.lit("")).withColumn("logo_url", F.lit(""))
    return out.select("company", "emails", "phones", F.coalesce("full_address", F.lit("")).alias("full_address"), F.coalesce(hint, F.lit("")).alias("postal_code"), F.coalesce("logo_url", F.lit("")).alias("logo_url"))


def drop_histogram(final: DataFrame) -> DataFrame:
    return final.where("NOT keep").select(F.explode("drop_reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def run_quality(quality: DataFrame) -> DataFrame:
    """The run's report over the companies' quality rows."""
    raw, llm = F.coalesce(F.sum("raw_chars"), F.lit(0)), F.coalesce(F.sum("llm_chars"), F.lit(0))
    return quality.agg(
        F.count("*").alias("companies_processed"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("raw_pages", "kept_pages", "dropped_pages")],
        raw.alias("raw_chars"),
        llm.alias("llm_chars"),
        F.when(raw > 0, half_up((1 - llm / raw) * 100, 1)).otherwise(0.0).alias("reduction_pct"),
        F.coalesce(half_up(F.avg("kept_pages"), 1), F.lit(0.0)).alias("avg_kept_pages"),
        *[F.count_if(F.col(c)).alias(name) for c, name in (("address_found", "companies_with_address"), ("postal_code_found", "companies_with_postal_code"), ("logo_found", "companies_with_logo")) if c in quality.columns],
    )


def company_contacts(final: DataFrame, kind: str, limit: int, salts: int = 16) -> DataFrame:
    """company, values: the first distinct ``emails`` or ``phones`` of kept pages, and of all pages where those have none.

    First occurrences are least (page, place) by value, so nothing but values is shuffled; the first of
    ``salts`` parts of a company come before the first of all, so its values never meet in one task.
    """
    extract = {"emails": emails, "phones": phones}[kind]
    seen = final.select("company", "pos", F.col("keep").cast("int").alias("kept"), F.posexplode(F.array_distinct(F.when(F.col("keep"), F.concat(extract(F.coalesce("clean_text", F.lit(""))))).otherwise(extract(F.coalesce("body", F.lit("")))))).alias("place", "value"))
    every = final.where("keep").select("company", "pos", F.lit(0).alias("kept"), F.posexplode(extract(F.coalesce("body", F.lit("")))).alias("place", "value"))
    first = seen.unionByName(every).groupBy("company", "kept", "value").agg(F.min(F.struct("pos", "place")).alias("at"))
    part = Window.partitionBy("company", F.pmod(F.hash("value"), F.lit(salts))).orderBy(F.desc("kept"), "at")
    few = first.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= limit)
    whole = Window.partitionBy("company")
    ranked = few.withColumn("rank", F.row_number().over(whole.orderBy(F.desc("kept"), "at"))).withColumn("any_kept", F.max("kept").over(whole))
    chosen = ranked.where("kept = any_kept").where(F.col("rank") <= limit)
    return chosen.groupBy("company").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"]).alias("values"))


def text_candidates(text: Column, full_address: Column, postal: Column) -> Column:
    """Address, profile hint and focus terms that a company's evidence text shows."""
    hints = postal_hints(text, postal)
    parts = location_parts(full_address)
    known = F.coalesce(full_address, F.lit("")) != ""
    return F.struct(
        F.coalesce(full_address, F.lit("")).alias("full_address"), parts["city"].alias("city"), parts["state"].alias("state"), parts["country"].alias("country"),
        F.when(F.coalesce(postal, F.lit("")) != "", postal).otherwise(F.coalesce(F.get(hints, F.lit(0)), F.lit(""))).alias("postal_code"),
        hints.alias("postal_code_hints"), snippets(text).alias("evidence_snippets"),
        F.when(known, F.lit("medium")).when(F.size(hints) > 0, F.lit("low")).otherwise(F.lit("none")).alias("confidence"),
        clip_text(first_sentence(text), 700).alias("company_description_hint"), F.slice(terms(text), 1, 18).alias("services_or_focus_terms"),
    )


def render_packet(final: DataFrame, companies: DataFrame | None = None) -> DataFrame:
    """company, markdown: the packet document of each company's kept pages, in page order.

    companies: company, company_name, domain, full_address; without it the company stands for name and domain.
    The kept pages of a company are bounded by the budget, so their text may be gathered.
    """
    section = F.concat(F.lit("### "), F.coalesce("page_name", F.lit("")), F.lit("\n\n"), without_urls(F.col("clean_text")))
    kept = final.where("keep").select("company", "pos", "source_bucket", section.alias("section"))
    part = lambda bucket: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("source_bucket") == bucket, F.struct("pos", "section")))), lambda x: x["section"]), "\n\n")
    sources = kept.groupBy("company").agg(part("first_party").alias("own"), part("third_party").alias("other"))
    joined = final.select("company").distinct().join(sources, "company", "left")
    if companies is None:
        joined = joined.withColumn("company_name", F.col("company")).withColumn("domain", F.col("company")).withColumn("full_address", F.lit(""))
    else:
        joined = joined.join(companies.select("company", "company_name", "domain", "full_address"), "company", "left")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    or_none = lambda c, label: F.when(text(c) != "", F.col(c)).otherwise(F.lit(f"No usable {label} content was kept after cleanup."))
    own_use, other_use, task = PACKET_LINES
    return joined.select(
        "company",
        F.concat(
            F.lit("# Scraped content for "), F.when(text("company_name") != "", text("company_name")).otherwise(text("domain")), F.lit("\n\nCompany: "), text("company_name"), F.lit("\nDomain: "), text("domain"),
            F.lit("\nFull address: "), without_urls(text("full_address")), F.lit(f"\n\n## Primary source: scraped content from the company's own site\n{own_use}\n\n"), or_none("own", "company-site"),
            F.lit(f"\n\n## Secondary source: scraped content from third-party sites\n{other_use}\n\n"), or_none("other", "third-party"), F.lit(f"\n\n## Task\n{task}\n"),
        ).alias("markdown"),
    )


def render_clean_source(final: DataFrame, bucket: str, title: str) -> DataFrame:
    """company, markdown: a company's kept pages of one kind without their URLs."""
    section = F.concat(F.lit("### "), F.coalesce("page_name", F.lit("")), F.lit("\n\n"), without_urls(F.col("clean_text")))
    kept = final.where("keep").where(F.col("source_bucket") == bucket).select("company", "pos", section.alias("section"))
    sections = kept.groupBy("company").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "section"))), lambda x: x["section"]), "\n\n").alias("sections"))
    body = F.coalesce(F.nullif("sections", F.lit("")), F.lit("No usable scraped content was kept after cleanup."))
    head = F.concat(F.lit(f"# {title}\n\nCompany: "), "company", F.lit("\nDomain: "), "company", F.lit("\n\n"))
    return final.select("company").distinct().join(sections, "company", "left").select("company", F.concat(head, body, F.lit("\n")).alias("markdown"))
