"""Presets: what a kind of record is checked, flattened, gated and compared by; and the rows made from records."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packwright.functions.text import bound, half_up, normalized_text
from packwright.operators.benchmark import OVERFILLED, all_unknown, says_nothing, score_array, score_normalized, score_number
from packwright.operators.enrichment import filled_default
from packwright.operators.validation import Record, capital_errors, company_errors, flatten_company, once_parsed

# ---- Fixed values of the contract ----
COMPANY_FIELDS = (
    ("identity.canonical_name", "string", 5), ("identity.one_line_description", "string", 4), ("firmographics.primary_industry", "string", 5), ("firmographics.business_model", "string", 4), ("offering.products_and_services", "array", 5),
    ("offering.target_customers", "array", 5), ("commercial_signals.growth_signals", "array", 3), ("qualification.status", "string", 4), ("source_evidence", "array", 6), ("quality.confidence_score", "number", 3),
)
CAPITAL_FIELDS = (("verification.is_capital_source", "boolean", 6), ("type", "string", 5), ("capital_profile.invests_in_vc_funds", "string", 6), ("capital_profile.fund_commitment_appetite", "string", 6), ("source_evidence", "array", 6))
COMPANY_GATE = ("company", "about", "products", "services", "customers", "solutions", "platform", "software", "technology", "industry")
CAPITAL_GATE = ("allocator", "fund commitment", "family office", "endowment", "pension", "fund of funds", "private markets", "emerging manager")
#: Column of a summary row and the record's member; lists are joined by a bar.
SUMMARY_TEXTS = {
    "canonical_name": "canonical_name", "type": "type", "verification_status": "verification.status", "is_capital_source": "verification.is_capital_source", "confidence_score": "verification.confidence_score", "website_url": "website_url",
    "logo_url": "logo_url", "hq_location": "profile.hq_location", "address": "profile.address", "postal_code": "profile.postal_code", "fund_commitment_appetite": "capital_profile.fund_commitment_appetite",
    "invests_in_vc_funds": "capital_profile.invests_in_vc_funds", "invests_directly": "capital_profile.invests_directly", "needs_review": "quality.needs_review",
}
SUMMARY_LISTS = {"sector_focus": "capital_profile.sector_focus", "stage_focus": "capital_profile.stage_focus", "geography_focus": "capital_profile.geography_focus", "review_reasons": "quality.review_reasons"}
#: Member that is filled where it is unset, and where the packet has it.
DEFAULTS = {
    "source_record_id": ("entity.source_record_id", "case_id"), "canonical_name": ("entity.company_name", "entity.legal_name", "company_name"), "domain": ("entity.domain", "packet_domain"), "website_url": ("entity.website_url",),
    "logo_url": ("entity.logo_url", "candidates.assets.logo_url", "candidates.assets.logo_candidates[0]", "candidates.assets.favicon_candidates[0]"), "profile.address": ("entity.full_address", "candidates.address.full_address"),
    "profile.postal_code": ("entity.postal_code", "candidates.address.postal_code"), "profile.hq_location": ("entity.hq_location", "entity.full_address", "candidates.address.full_address"),
}
# --------------------------------------


@dataclass(frozen=True)
class Preset:
    """errors: messages of a record; flat: its flat columns, None for the generic flattening; gate: terms by label; fields: path, kind and weight."""

    id: str
    errors: Callable[[Column], Column]
    flat: Callable[[Column], list[Column]] | None
    gate: dict[str, str] = field(default_factory=dict)
    fields: tuple[tuple[str, str, int], ...] = ()


def _plain_gate(terms: tuple[str, ...]) -> dict[str, str]:
    return {t: rf"(?<![0-9a-z_]){t}(?![0-9a-z_])" for t in terms}


PRESETS = {
    "company": Preset("company", company_errors, flatten_company, _plain_gate(COMPANY_GATE), COMPANY_FIELDS),
    "capital-source": Preset("capital-source", capital_errors, None, _plain_gate(CAPITAL_GATE), CAPITAL_FIELDS),
}


def preset(name: str | None = None) -> Preset:
    """The preset of that name; the company preset for none."""
    found = PRESETS.get(name or "company")
    if found is None:
        raise ValueError(f"unknown preset {name}; known are {', '.join(sorted(PRESETS))}")
    return found


def as_boolean(value: Column, default: bool) -> Column:
    """A flag's text as a boolean: 1, true, yes and on are true, blank is the default."""
    low = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(low == "", F.lit(default)).otherwise(low.isin("1", "true", "yes", "on"))


def as_number(value: Column, default: float) -> Column:
    """A flag's text as a number; the default for blank text and what is no finite number."""
    number = F.nullif(F.trim(value), F.lit("")).try_cast("double")
    return F.coalesce(F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number), F.lit(default))


def field_scores(actual: Column, gold: Column, of: Preset) -> Column:
    """path, weight and score of each compared field of two JSON records; the kinds are those of the preset.

    Each record is parsed once, each member read once and its text normalised once.
    """

    def chosen(missing_a: Column, missing_g: Column, score: Column) -> Column:
        return F.when(missing_a & missing_g, 1.0).when(missing_g, OVERFILLED).when(missing_a, 0.0).otherwise(score)

    def of_lists(x: Column) -> Column:
        missing = F.struct(x["a"].alias("a"), x["g"].alias("g"), all_unknown(x["a"]).alias("no_a"), all_unknown(x["g"]).alias("no_g"))
        return bound(missing, lambda m: chosen(m["no_a"], m["no_g"], score_array(m["a"], m["g"])))

    def of_texts(x: Column, score) -> Column:
        known = F.struct(*[normalized_text(x[c]).alias(c) for c in ("a", "g")])
        return bound(known, lambda n: chosen(says_nothing(n["a"]), says_nothing(n["g"]), score(n)))

    def one(a: Record, g: Record, path: str, kind: str, weight: int) -> Column:
        both = lambda read: F.struct(read(a).alias("a"), read(g).alias("g"))
        if kind == "array":
            value = bound(both(lambda r: r.items(path)), of_lists)
        else:
            score = {"string": lambda x, n: score_normalized(n["a"], n["g"]), "number": lambda x, n: score_number(a.number(path), g.number(path)), "boolean": lambda x, n: F.when(x["a"] == x["g"], 1.0).otherwise(0.0)}[kind]
            value = bound(both(lambda r: r.text(path)), lambda x: of_texts(x, lambda n: score(x, n)))
        return F.struct(F.lit(path).alias("path"), F.lit(weight).alias("weight"), value.alias("score"))

    return once_parsed(actual, lambda a: once_parsed(gold, lambda g: F.array(*[one(a, g, *f) for f in of.fields])))


def weighted_agreement(scores: Column) -> Column:
    """Mean of the scores by their weights, to four digits."""
    total = lambda of: F.aggregate(scores, F.lit(0.0), lambda acc, s: acc + of(s))
    return half_up(total(lambda s: s["score"] * s["weight"]) / F.greatest(F.lit(1.0), total(lambda s: s["weight"].cast("double"))), 4)


def with_models(scores: DataFrame, models: DataFrame) -> DataFrame:
    """Scores with price and context of their model; a model that the catalogue lacks keeps its scores."""
    return scores.join(models.select(F.col("id").alias("model"), "context_length", "blended_90_10_per_1m"), "model", "left")


def against_gold(responses: DataFrame, gold: DataFrame) -> DataFrame:
    """Candidate responses with the gold record of their case; a case without one is missing here, see ``missing_gold``."""
    return responses.join(gold.select("case_id", F.col("raw").alias("gold_raw")), "case_id")


def with_defaults(cases: DataFrame) -> DataFrame:
    """cases(case_id, company_name, domain, raw, packet_json) with the eight members that a packet can fill.

    Columns are named as the members, dots as two underscores.
    """
    r, packet = Record(F.col("raw")), Record(F.col("packet_json"))

    def candidate(path: str) -> Column:
        own = {"case_id": F.col("case_id"), "company_name": F.col("company_name"), "packet_domain": F.col("domain")}
        return own[path] if path in own else packet.text(path)

    filled = {path.replace(".", "__"): F.coalesce(filled_default(r.text(path), *map(candidate, found)), F.lit("")) for path, found in DEFAULTS.items()}
    return cases.select("case_id", *[c.alias(n) for n, c in filled.items()])


def summary_rows(results: DataFrame) -> DataFrame:
    """The wide row of each result (case_id, company_name, domain, ok, model, cost_usd, latency_ms, tokens, files, error, raw)."""
    r = Record(F.col("raw"))
    texts = {n: F.coalesce(r.text(p), F.lit("")) for n, p in SUMMARY_TEXTS.items()} | {n: F.array_join(r.items(p), "|") for n, p in SUMMARY_LISTS.items()}
    order = ("canonical_name", "type", "verification_status", "is_capital_source", "confidence_score", "website_url", "logo_url", "hq_location", "address", "postal_code", "fund_commitment_appetite", "invests_in_vc_funds", "invests_directly", "sector_focus", "stage_focus", "geography_focus", "needs_review", "review_reasons")
    return results.select(
        "case_id", "company_name", "domain", "ok", F.coalesce(r.is_object(), F.lit(False)).alias("parse_ok"), "model", half_up(F.col("cost_usd"), 6).alias("cost_usd"), "latency_ms", "prompt_tokens", "completion_tokens",
        *[texts[n].alias(n) for n in order], "json_file", "response_file", "packet_path", "error",
    )


ICP_LISTS = ("target_industries", "target_geographies", "business_models", "must_have_signals", "disqualifiers")
ICP_ISSUES = ("must include a non-empty name", "must include a non-empty description", "employee bounds must be non-negative numbers or null", "has employee_count_min greater than employee_count_max")


def icp_rows(raw: Column) -> tuple[Column, Column]:
    """(profile, issues) of the JSON text of an ideal customer profile: trimmed texts, lists without blanks, bounds as numbers or null."""
    r = Record(raw)
    text = lambda p: F.when(r.kind(p) == "STRING", F.trim(r.text(p))).otherwise("")
    blank = lambda p: F.coalesce(F.trim(r.text(p)), F.lit("")) == ""
    bound_of = lambda p: F.when(blank(p), None).otherwise(F.trim(r.text(p)).try_cast("double"))
    low, high = bound_of("employee_count_min"), bound_of("employee_count_max")
    bad = lambda p, n: ~blank(p) & (n.isNull() | F.isnan(n) | (F.abs(n) == float("inf")) | (n < 0))
    tests = (text("name") == "", text("description") == "", bad("employee_count_min", low) | bad("employee_count_max", high), low > high)
    lists = [F.filter(F.transform(F.coalesce(F.from_json(F.when(r.kind(p) == "ARRAY", r.json(p)), "array<string>"), F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: F.coalesce(x, F.lit("")) != "").alias(p) for p in ICP_LISTS]
    profile = F.struct(text("name").alias("name"), text("description").alias("description"), *lists, low.alias("employee_count_min"), high.alias("employee_count_max"))
    return profile, F.array_compact(F.array(*[F.when(t, F.lit(m)) for t, m in zip(tests, ICP_ISSUES)]))


def read_icp(spark: SparkSession, path: str | None):
    """The profile in a JSON file as a row; None for no path; raises with the first issue."""
    if not path:
        return None
    profile, issues = icp_rows(F.col("value"))
    row = spark.read.text(path, wholetext=True).select(profile.alias("profile"), issues.alias("issues")).first()  # one small file
    if row is None or row["issues"]:
        raise ValueError(f"ICP file {path} {row['issues'][0] if row else 'is empty'}")
    return row["profile"]


def user_preset(name: str, errors, flat: tuple[str, Callable] | None = None, gate: tuple[str, ...] = (), fields: tuple[tuple[str, str, int], ...] = ()) -> Preset:
    """A preset made of a user's functions, which work on batches of JSON texts.

    errors: from an Arrow array of texts to one of lists of messages.  flat: a schema and a function from an Arrow
    array to a struct array of it; without one the generic flattening is used.
    """
    flattened = None
    if flat is not None:
        schema, made = flat
        udf = F.arrow_udf(made, f"struct<{schema}>")
        names = [c.strip().split()[0].split(":")[0] for c in schema.split(",")]
        flattened = lambda raw: bound_struct(udf(raw), names)
    return Preset(name, F.arrow_udf(errors, "array<string>"), flattened, _plain_gate(gate), fields)


def register_preset(own: Preset) -> Preset:
    """Makes a preset known by its name."""
    if own.id in PRESETS:
        raise ValueError(f"a preset {own.id} exists")
    PRESETS[own.id] = own
    return own


def bound_struct(value: Column, names: list[str]) -> list[Column]:
    return [value[n].alias(n) for n in names]


def preset_rows(records: DataFrame, of: Preset, raw: str = "raw") -> DataFrame:
    """The records with ``errors`` and, of those without any, the preset's flat columns."""
    errors = of.errors(F.col(raw))
    checked = records.withColumn("errors", errors)
    good = F.when(F.size("errors") == 0, F.col(raw))
    return checked if of.flat is None else checked.select("*", *of.flat(good))
