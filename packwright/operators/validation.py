"""Rule validators over JSON records, as arrays of issues in rule order.

Records are JSON text.  Presence, null and type are told apart on the parsed Variant, never on a
schema-bound reading, which would turn numbers into strings and wrong types into nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packwright.functions.text import bound, host_of, one_spaced, replaced, whole_word
from packwright.sources.staging import staged

# ---- Fixed values of the contract: members, words, thresholds and issue texts ----
COMPANY_SECTIONS = ("identity", "firmographics", "offering", "commercial_signals", "qualification", "outreach", "quality")
COMPANY_STRINGS = ("identity.canonical_name", "identity.domain", "identity.website_url", "identity.one_line_description")
STATUSES = ("not_scored", "strong_fit", "possible_fit", "weak_fit", "disqualified", "manual_review")
CAPITAL_SECTIONS = ("verification", "profile", "capital_profile")
MATERIAL_PATHS = ("verification", "profile.capital_source_context", "profile.ownership_background", "profile.public_principal_name", "capital_profile", "portfolio_signals", "contacts", "outreach.fundraise_fit_notes", "outreach.fit_risk_notes", "outreach.recent_trigger")
LEAN_MATERIAL_PATHS = ("logo_url", "favicon_url", "type", "detailed_profile_summary", "address", "postal_code", "aum_notes", "geography_focus", "sector_focus", "stage_focus", "capital_source_role", "fund_allocation_signal", "vc_fund_lp_signal", "fund_asset_classes", "investment_routes", "allocator_capabilities", "evidence_strength", "preferred_fund_stage", "fund_geography_preference", "direct_geography_preference", "geography_preference_notes", "known_fund_investments", "known_direct_investments", "fundraise_fit_notes", "fit_risk_notes")
PORTFOLIO_PATHS = ("known_fund_investments", "known_direct_investments", "co_investors")
SIGNAL_PATHS = ("invests_in_vc_funds", "invests_directly", "co_investment_appetite", "fund_commitment_appetite", "capital_source_role", "fund_allocation_signal", "vc_fund_lp_signal", "fund_asset_classes", "investment_routes", "allocator_capabilities", "evidence_strength", "emerging_manager_appetite", "first_time_fund_appetite")
IMMATERIAL_WORDS = ("unknown", "not found", "not_publicly_disclosed", "not publicly disclosed", "not available", "n/a", "none")
IMMATERIAL_SENTENCE = r"^no (publicly available |public |explicit )?(info|information|data|detail|details|disclosure|sizes?|cheque sizes?|check sizes?)(?![0-9A-Za-z_])"
GENERIC_CLAIM = r"^(source-backed context supports|source-record context supports)|^source record portfolio examples support direct-investment history\.\z"
ADVISORY_WORDING = "advisory/wealth-management orientation without|no explicit fund|no public fund|wealth management|financial planning|investment advisory|financial advisory|advisor(?:y)? services?|serving (?:families|clients)|for (?:families|clients)|client portfolios?"
NOT_PLACEHOLDER = ("", "unknown", "n/a", "na", "none", "not disclosed", "not public")
PLACEHOLDER_NAME = r"^(portfolio |known |direct |fund )?(company|firm|fund|investment|investor|startup|portfolio company|portfolio firm|manager|asset|deal|holding|co-investor|co investor)( \d+)?\z|^(financial services firm|real assets development|real estate platform|technology company|healthcare company|consumer company|industrial company|private equity fund|venture fund)( \d+)?\z"
PLACEHOLDER_SLUG = r"^(company|firm|fund|investment|startup|portfolio_company|portfolio_firm|financial_services_firm|real_assets_development|real_estate_platform|technology_company|healthcare_company|consumer_company|industrial_company)_?\d+\z"
NEGATIVE_FUND = r"(?i)(?<![0-9A-Za-z_])(no|not|without|does not|do not|avoid|avoids|excluding|rather than)(?![0-9A-Za-z_]).{0,100}(?<![0-9A-Za-z_])(vc fund|venture capital fund|fund commitments?|fund investments?|external managers?|fund manager|limited partner|lp commitment)(?![0-9A-Za-z_])"
CITATION_NOISE = r"(?i)\[[^\]]+\]\(|utm_source=openai"
LOW_CONFIDENCE, LEAST_EMBEDDING = 0.55, 700
UNCITED = "Material populated field has no matching source_evidence field_path."
# ---------------------------------------------------------------------------------

ISSUE = "struct<severity:string,path:string,detail:string>"
_LEAF = r'"(?:[^"\\]|\\.)*"\s*:?|true|false|-?\d[\d.eE+-]*'
EVIDENCE = "array<struct<field_path:string,claim:string,source_url:string,source_type:string>>"


class Record:
    """Access to a record by dotted path.  Arrays end a path."""

    def __init__(self, raw: Column, value: Column | None = None):
        self.raw = raw
        self.value = F.try_parse_json(raw) if value is None else value

    def at(self, path: str) -> Column:
        return F.try_variant_get(self.value, F.lit("$." + path), "variant")

    def kind(self, path: str = "") -> Column:
        """OBJECT, ARRAY, STRING, BOOLEAN, VOID (a JSON null), a number's type, or ABSENT."""
        here = self.at(path) if path else self.value
        return F.coalesce(F.regexp_extract(F.schema_of_variant(here), "^[A-Z]+", 0), F.lit("ABSENT"))

    def text(self, path: str) -> Column:
        return F.try_variant_get(self.value, F.lit("$." + path), "string")

    def number(self, path: str) -> Column:
        return F.try_variant_get(self.value, F.lit("$." + path), "double")

    def is_number(self, path: str) -> Column:
        return self.kind(path).isin("BIGINT", "DOUBLE", "DECIMAL", "FLOAT", "INT", "SMALLINT", "TINYINT")

    def is_object(self, path: str = "") -> Column:
        return self.kind(path) == "OBJECT"

    def is_filled(self, path: str) -> Column:
        return (self.kind(path) == "STRING") & (F.trim(F.coalesce(self.text(path), F.lit(""))) != "")

    def json(self, path: str) -> Column:
        return F.get_json_object(self.raw, "$." + path)

    def material(self, path: str) -> Column:
        """``is_material`` of a member, without reading the record's text again."""
        return _says_something(F.to_json(self.at(path)))

    def items(self, path: str, schema: str = "array<string>") -> Column:
        return F.coalesce(F.from_json(F.when(self.kind(path) == "ARRAY", self.json(path)), schema), F.array().cast(schema))


def is_material(json: Column) -> Column:
    """Whether a JSON value says something: some leaf that is a number, a boolean or an informative text."""
    return _says_something(F.when(json.rlike(r'^\s*[\[{]'), json).otherwise(F.to_json(F.array(json))))


def _says_something(json: Column) -> Column:
    leaves = F.filter(F.regexp_extract_all(json, F.lit(_LEAF), F.lit(0)), lambda x: ~x.endswith(":"))
    words = lambda x: F.lower(F.trim(replaced(x, ('^"|"$', ""))))
    says = lambda x: ~x.startswith('"') | ((words(x) != "") & ~words(x).isin(*IMMATERIAL_WORDS) & ~words(x).rlike(IMMATERIAL_SENTENCE))
    return F.coalesce(F.exists(leaves, says), F.lit(False))


def normalize_path(path: Column) -> Column:
    return replaced(F.coalesce(path, F.lit("")), (r"\[(\d+)\]", r".$1"), (r"\.+", "."), (r"^\.", ""))


def path_matches(prefix: str, path: Column) -> Column:
    """Equal, or one inside the other."""
    return bound(normalize_path(path), lambda p: _overlaps(prefix, p))


def _overlaps(prefix: str, path: Column) -> Column:
    return path.isin(prefix, *[prefix[:i] for i, c in enumerate(prefix) if c == "."]) | path.startswith(prefix + ".")


def same_domain(url: Column, domain: Column) -> Column:
    host = host_of(url)
    return (host != "") & ((host == domain) | host.endswith(F.concat(F.lit("."), domain)))


def is_placeholder_name(name: Column) -> Column:
    """A generic noun, alone or numbered in any spelling, or any lower-case words with a number."""
    text = one_spaced(F.coalesce(name, F.lit("")))
    slug = replaced(F.lower(text), ("[^a-z0-9]+", "_"), ("^_+|_+$", ""))
    numbered = slug.rlike(r"^[a-z]+(_[a-z]+)*_\d+\z") & ~text.rlike("[A-Z]")
    return ~F.lower(text).isin(*NOT_PLACEHOLDER) & (F.lower(text).rlike(PLACEHOLDER_NAME) | slug.rlike(PLACEHOLDER_SLUG) | numbered)


def _messages(*rules: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(text)) for broken, text in rules]))


def verdict(errors: Column) -> Column:
    return bound(errors, lambda e: F.struct((F.size(e) == 0).alias("ok"), e.alias("errors")))


def once_parsed(raw: Column, rules) -> Column:
    """``rules(record)`` of a record that is parsed once, however many rules look at it."""
    return bound(F.struct(raw.alias("raw"), F.try_parse_json(raw).alias("value")), lambda x: rules(Record(x["raw"], x["value"])))


def company_errors(raw: Column) -> Column:
    """Errors of a company record."""
    return once_parsed(raw, _company_rules)


def _company_rules(r: Record) -> Column:
    status = F.coalesce(r.text("qualification.status"), F.lit(""))
    scored = r.is_object("qualification")
    rules = [(~r.is_filled("source_record_id"), "source_record_id must be a non-empty string")]
    rules += [(~r.is_object(k), f"{k} must be an object") for k in COMPANY_SECTIONS]
    rules += [(~_has_items(r, "source_evidence"), "source_evidence must contain at least one item")]
    rules += [(r.is_object("identity") & ~r.is_filled(p), f"{p} must be a non-empty string") for p in COMPANY_STRINGS]
    rules += [
        (scored & ~status.isin(*STATUSES), "qualification.status is invalid"),
        (scored & (status == "not_scored") & (r.kind("qualification.icp_score") != "VOID"), "qualification.icp_score must be null when status is not_scored"),
        (scored & (status != "not_scored") & ~r.is_number("qualification.icp_score"), "qualification.icp_score must be a number when ICP scoring is active"),
    ]
    return F.when(r.is_object(), _messages(*rules)).otherwise(F.array(F.lit("output must be an object")))


def _has_items(r: Record, path: str) -> Column:
    return (r.kind(path) == "ARRAY") & (F.coalesce(F.json_array_length(F.to_json(r.at(path))), F.lit(0)) > 0)


def qualification_errors(raw: Column, with_icp: bool) -> Column:
    """Errors of the qualification against whether an ideal-customer profile was given."""
    return once_parsed(raw, lambda r: _qualification_rules(r, with_icp))


def _qualification_rules(r: Record, with_icp: bool) -> Column:
    status = F.coalesce(r.text("qualification.status"), F.lit(""))
    if with_icp:
        return _messages((status == "not_scored", "qualification.status must not be not_scored when an ICP is provided"))
    return _messages((status != "not_scored", "qualification.status must be not_scored without an ICP"), (~r.kind("qualification.icp_score").isin("VOID", "ABSENT"), "qualification.icp_score must be null without an ICP"))


def capital_errors(raw: Column) -> Column:
    return once_parsed(raw, _capital_rules)


def _capital_rules(r: Record) -> Column:
    rules = [(~r.is_object(k), f"{k} must be an object") for k in CAPITAL_SECTIONS]
    return F.when(r.is_object(), _messages(*rules, (~_has_items(r, "source_evidence"), "source_evidence must contain at least one item"))).otherwise(F.array(F.lit("output must be an object")))


def is_complete_record(raw: Column) -> Column:
    """Whether a record is an object with the sections that a finished record has."""
    def complete(r: Record) -> Column:
        sections = [r.is_object(k) for k in CAPITAL_SECTIONS]
        return F.coalesce(r.is_object() & sections[0] & sections[1] & sections[2] & _has_items(r, "source_evidence"), F.lit(False))

    return once_parsed(raw, complete)


def _issue(broken: Column, severity: str, path: str, detail: str | Column) -> Column:
    text = F.lit(detail) if isinstance(detail, str) else detail
    return F.when(F.coalesce(broken, F.lit(False)), F.struct(F.lit(severity).alias("severity"), F.lit(path).alias("path"), text.alias("detail")))


def _issues(*rules: Column) -> Column:
    return F.array_compact(F.array(*rules))


def _each(evidence: Column, *rules) -> Column:
    """Issues of the evidence items, item by item."""
    return F.flatten(F.transform(evidence, lambda e: _issues(*[rule(e) for rule in rules])))


def _bad_url(e: Column, path: str) -> Column:
    bad = ~e["source_type"].eqNullSafe("source_record") & ~F.coalesce(e["source_url"], F.lit("")).rlike("^https?://")
    return _issue(bad, "high", path, F.concat(F.lit("Invalid source URL for claim: "), F.substring(F.coalesce(e["claim"], F.lit("")), 1, 80)))


def _foreign_site(e: Column, domain: Column) -> Column:
    foreign = (e["source_type"] == "official_website") & (domain != "") & ~same_domain(F.coalesce(e["source_url"], F.lit("")), domain)
    return _issue(foreign, "medium", "source_evidence.source_type", "official_website source_type is used for a non-entity domain.")


def _cites(evidence: Column, paths: tuple[str, ...] | str, contains: bool = False) -> Column:
    one = lambda e, p: F.coalesce(e["field_path"], F.lit("")).contains(p) if contains else _overlaps(p, e["path"])
    listed = (paths,) if isinstance(paths, str) else paths

    def any_of(e: Column) -> Column:
        test = F.lit(False)
        for p in listed:
            test = test | one(e, p)
        return test

    return F.exists(evidence, any_of)


def _uncited(r: Record, evidence: Column, paths: tuple[str, ...]) -> list[Column]:
    return [_issue(r.material(p) & ~_cites(evidence, p), "medium", p, UNCITED) for p in paths]


def _with_evidence(raw: Column, path: str, rules) -> Column:
    """``rules(record, evidence)``; the record is parsed once and its evidence read once, however many rules look at them."""

    def parsed(x: Column) -> Column:
        r = Record(x["raw"], x["value"])
        items = F.transform(r.items(path, EVIDENCE), lambda e: F.struct(normalize_path(e["field_path"]).alias("path"), *[e[m].alias(m) for m in ("field_path", "claim", "source_url", "source_type")]))
        return bound(items, lambda evidence: rules(r, evidence))

    return bound(F.struct(raw.alias("raw"), F.try_parse_json(raw).alias("value")), parsed)


def verification_issues(raw: Column) -> Column:
    return _with_evidence(raw, "evidence", _verification_rules)


def _verification_rules(r: Record, evidence: Column) -> Column:
    capital = r.text("is_capital_source") == "true"
    return F.concat(
        _issues(_issue(F.size(evidence) == 0, "high", "evidence", "Verification has no evidence.")),
        _each(evidence, lambda e: _bad_url(e, "evidence")),
        _issues(
            _issue(capital & (F.coalesce(r.number("confidence_score"), F.lit(0.0)) < LOW_CONFIDENCE), "medium", "confidence_score", "Record is marked capital source with low confidence."),
            _issue(capital & (r.text("type") == "unknown"), "medium", "type", "Verified capital source needs a more specific institution/entity type or manual review."),
        ),
    )


def enrichment_issues(raw: Column) -> Column:
    return _with_evidence(raw, "source_evidence", _enrichment_rules)


def _enrichment_rules(r: Record, evidence: Column) -> Column:
    domain = replaced(F.lower(F.coalesce(r.text("domain"), F.lit(""))), (r"^www\.", ""))
    noisy = lambda e: _issue(F.concat_ws(" ", e["claim"], e["source_url"]).rlike(CITATION_NOISE), "medium", "source_evidence.claim", "Evidence contains markdown citation text or OpenAI tracking URL noise.")
    sized = r.is_number("capital_profile.commitment_size_min_usd") | r.is_number("capital_profile.commitment_size_max_usd")
    return F.concat(
        _issues(_issue(F.size(evidence) == 0, "high", "source_evidence", "No source evidence captured.")),
        _each(evidence, lambda e: _bad_url(e, "source_evidence"), lambda e: _foreign_site(e, domain), noisy),
        _issues(
            _issue(~((r.kind("verification.is_capital_source") == "BOOLEAN") & (r.text("verification.is_capital_source") == "true")), "high", "verification.is_capital_source", "Full enrichment should only run for verified capital sources."),
            *_uncited(r, evidence, MATERIAL_PATHS),
            _issue(sized & ~_cites(evidence, "commitment_size", True), "high", "capital_profile.commitment_size", "Commitment size must not be guessed; it needs explicit evidence."),
        ),
    )


def _placeholder_issues(r: Record, path: str) -> Column:
    def issue(v: Column, i: Column) -> Column:
        detail = F.concat(F.lit("Portfolio field contains a placeholder or generic name: "), F.substring(v, 1, 80))
        return F.when(is_placeholder_name(v), F.struct(F.lit("high").alias("severity"), F.concat(F.lit(path + "."), i.cast("string")).alias("path"), detail.alias("detail")))

    return F.array_compact(F.transform(r.items(path), issue))


def is_advisory_wording(claim: Column) -> Column:
    """Advisory or client-service wording that does not deny fund investments in so many words."""
    return claim.rlike("(?i)" + whole_word(ADVISORY_WORDING)) & ~claim.rlike(NEGATIVE_FUND)


def lean_issues(raw: Column) -> Column:
    return _with_evidence(raw, "source_evidence", _lean_rules)


def _lean_rules(r: Record, evidence: Column) -> Column:
    urls = r.items("evidence_urls")
    domain = replaced(F.lower(F.coalesce(r.text("domain"), F.lit(""))), (r"^www\.", ""))
    generic = lambda e: F.lower(F.trim(F.coalesce(e["claim"], F.lit("")))).rlike(GENERIC_CLAIM)
    about = lambda e, paths: _cites(F.array(e), paths)
    weak = lambda paths, text: lambda e: _issue(about(e, paths) & generic(e), "medium", "source_evidence.claim", text)
    bad_urls = F.transform(F.filter(urls, lambda u: (u != "source_record") & ~u.rlike("^https?://")), lambda u: F.struct(F.lit("high").alias("severity"), F.lit("evidence_urls").alias("path"), F.concat(F.lit("Invalid evidence URL: "), F.substring(u, 1, 80)).alias("detail")))
    verified = r.text("verification_status") == "verified"
    either = lambda a, b: r.is_number(a) | r.is_number(b)
    fund, direct = either("fund_cheque_size_min_usd", "fund_cheque_size_max_usd"), either("direct_cheque_size_min_usd", "direct_cheque_size_max_usd")
    guessed = lambda test, needed, path, what: _issue(test & ~_cites(evidence, needed, True), "high", path, f"{what} must not be guessed; it needs explicit evidence.")
    not_web = lambda p, what: _issue(r.material(p) & ~F.trim(F.coalesce(r.text(p), F.lit(""))).rlike("^https?://"), "medium", p, f"{what} URL must be a valid HTTP(S) URL or unknown.")
    is_ = lambda p, v: r.text(p).eqNullSafe(v)
    known = lambda p: ~F.coalesce(r.text(p), F.lit("")).isin("", "unknown")
    own = lambda p: F.filter(evidence, lambda e: _overlaps(p, e["path"]))
    only_record = lambda p: (F.size(own(p)) > 0) & F.forall(own(p), lambda e: e["source_type"].eqNullSafe("source_record"))
    advisory = lambda p: F.exists(own(p), lambda e: is_advisory_wording(F.coalesce(e["claim"], F.lit(""))))
    optional = [
        x
        for p in ("invests_in_vc_funds", "fund_commitment_appetite")
        for x in (
            _issue(known(p) & only_record(p), "low", p, "Optional fund-appetite value is backed only by source_record evidence; upgrade when cheap."),
            _issue(is_(p, "no") & advisory(p), "medium", p, "Generic advisory, wealth-management, or client-service wording is not enough evidence to mark VC fund/LP appetite as no."),
        )
    ]
    supporting = [_issue(~is_(p, "unknown") & only_record(p), "low", p, "Direct/co-invest values are supporting signals for VC fundraise matching; source_record-only evidence is acceptable for screening but should be upgraded when cheap.") for p in ("invests_directly", "co_investment_appetite")]
    placeholders = [_placeholder_issues(r, p) for p in PORTFOLIO_PATHS]
    return F.concat(
        _issues(_issue(F.size(evidence) == 0, "high", "source_evidence", "No source evidence captured."), _issue(F.size(urls) == 0, "high", "evidence_urls", "No evidence URLs captured.")),
        _each(
            evidence, lambda e: _bad_url(e, "source_evidence"), lambda e: _foreign_site(e, domain),
            weak(PORTFOLIO_PATHS, "Portfolio fields need explicit named evidence; generic source-backed evidence is not enough."),
            weak(SIGNAL_PATHS, "Investment appetite fields need explicit signal evidence; generic source-backed evidence is not enough."),
        ),
        bad_urls,
        _issues(
            _issue(verified & is_("type", "unknown"), "medium", "type", "Verified capital source needs a specific LP/institution type or manual review."),
            _issue(verified & (F.coalesce(r.number("confidence_score"), F.lit(0.0)) < LOW_CONFIDENCE), "medium", "confidence_score", "Record is marked verified with low confidence."),
            *_uncited(r, evidence, LEAN_MATERIAL_PATHS),
            guessed(either("commitment_size_min_usd", "commitment_size_max_usd"), ("commitment_size", "fund_cheque_size"), "commitment_size", "Commitment size"),
            guessed(r.is_number("aum_usd"), ("aum",), "aum_usd", "AUM"),
            not_web("logo_url", "Logo"), not_web("favicon_url", "Favicon"),
            guessed(fund, ("fund_cheque_size", "commitment_size", "cheque_size"), "fund_cheque_size", "Fund cheque size"),
            guessed(direct, ("direct_cheque_size", "cheque_size"), "direct_cheque_size", "Direct cheque size"),
            _issue((fund | direct) & is_("cheque_size_basis", "observed_historical"), "high", "cheque_size_basis", "Observed historical aggregate investment dollars must not be converted into fund/direct cheque-size preference fields."),
            _issue(is_("invests_in_vc_funds", "yes") & is_("fund_commitment_appetite", "no"), "high", "fund_commitment_appetite", "VC-fund appetite cannot be yes while fund-commitment appetite is no without explicit contradictory evidence."),
            _issue(is_("vc_fund_lp_signal", "explicit_yes") & ~is_("invests_in_vc_funds", "yes"), "medium", "vc_fund_lp_signal", "Explicit VC-fund LP signal should align with invests_in_vc_funds=yes for backward compatibility."),
            _issue(is_("invests_in_vc_funds", "yes") & ~is_("vc_fund_lp_signal", "explicit_yes"), "medium", "invests_in_vc_funds", "invests_in_vc_funds=yes now requires vc_fund_lp_signal=explicit_yes; use private-market allocation signals for weaker fund evidence."),
            *optional, *supporting,
        ),
        *placeholders,
        _issues(_issue(F.length(F.trim(F.coalesce(r.text("embedding_text"), F.lit("")))) < LEAST_EMBEDDING, "medium", "embedding_text", "Embedding text is too thin for useful vector retrieval.")),
    )


def issue_counts(issues: Column) -> Column:
    """Number of issues by severity."""
    number = lambda severity: F.size(F.filter(issues, lambda i: i["severity"] == severity)).cast("long").alias(severity)
    return F.struct(*[number(s) for s in ("high", "medium", "low")])


def json_object(text: Column) -> Column:
    """The first balanced JSON object in a model's text, fenced or not; null if it doesn't parse."""
    return bound(balanced_object(F.coalesce(text, F.lit(""))), lambda x: F.when(Record(x).is_object(), x))


def balanced_object(text: Column) -> Column:
    """Text from the first brace to the one that closes it; braces inside strings don't count."""
    from_first = F.regexp_extract(text, r"(?s)\{.*", 0)
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(0).alias("end"))

    def step(acc: Column, m: Column) -> Column:
        at, depth = acc["at"] + F.length(m), acc["depth"] + F.when(m == "{", 1).when(m == "}", -1).otherwise(0)
        closed = F.when((m == "}") & (depth == 0), at).otherwise(0)
        return F.when(acc["end"] > 0, acc).otherwise(F.struct(at.alias("at"), depth.alias("depth"), closed.alias("end")))

    marks = lambda t: F.regexp_extract_all(t, F.lit(r'(?s)("(?:[^"\\]|\\.)*"|[^"{}]+|[{}"])'), F.lit(1))
    return bound(from_first, lambda t: F.substring(t, F.lit(1), F.aggregate(marks(t), start, step, lambda acc: acc["end"])))


def flatten_company(raw: Column) -> list[Column]:
    """The flat columns of a company record."""
    r = Record(raw)
    joined = lambda p: F.array_join(r.items(p), " | ")
    text = lambda p: F.coalesce(r.text(p), F.lit(""))
    place = F.array_join(F.filter(F.array(*[text(f"firmographics.headquarters.{p}") for p in ("city", "region", "country")]), lambda x: x != ""), ", ")
    flat = {n: text(p) for n, p in (("source_record_id",) * 2, ("canonical_name", "identity.canonical_name"), ("domain", "identity.domain"), ("website_url", "identity.website_url"), ("one_line_description", "identity.one_line_description"), ("primary_industry", "firmographics.primary_industry"), ("business_model", "firmographics.business_model"), ("company_type", "firmographics.company_type"), ("employee_range", "firmographics.employee_range"), ("revenue_range", "firmographics.revenue_range"), ("founded_year", "firmographics.founded_year"))}
    flat |= {"headquarters": place, "operating_geographies": joined("firmographics.operating_geographies"), "products_and_services": joined("offering.products_and_services"), "target_customers": joined("offering.target_customers"), "value_proposition": text("offering.value_proposition"), "growth_signals": joined("commercial_signals.growth_signals"), "technology_signals": joined("commercial_signals.technology_signals")}
    flat |= {"qualification_status": text("qualification.status"), "icp_score": text("qualification.icp_score"), "qualification_rationale": text("qualification.rationale"), "account_summary": text("outreach.account_summary"), "personalization_angles": joined("outreach.personalization_angles"), "confidence_score": text("quality.confidence_score"), "evidence_coverage_score": text("quality.evidence_coverage_score"), "source_evidence": F.coalesce(r.json("source_evidence"), F.lit("[]"))}
    return [c.alias(n) for n, c in flat.items()]


def flattened(records: DataFrame, key: str, raw: str, levels: int = 4) -> DataFrame:
    """key, path, value of every leaf of the records; arrays stay JSON, objects open however deep they are.

    The first ``levels`` are one plan; where objects are left below, they are written out and opened further.
    """
    level = records.select(F.col(key).alias("_of"), F.lit("").alias("path"), F.try_parse_json(raw).alias("v"))
    done = None
    opened = 0
    while True:
        parts = level.lateralJoin(level.sparkSession.tvf.variant_explode(F.col("v").outer()))
        named = F.concat(F.when(F.col("path") != "", F.concat("path", F.lit("."))).otherwise(F.lit("")), "key")
        parts = parts.select("_of", named.alias("path"), F.col("value").alias("v"))
        kind = F.schema_of_variant("v")
        leaf = F.when(kind.startswith("ARRAY"), F.to_json("v")).otherwise(F.coalesce(F.try_variant_get("v", F.lit("$"), "string"), F.lit("")))
        leaves = parts.where(~kind.startswith("OBJECT") | F.col("v").isNull()).select(F.col("_of").alias(key), "path", leaf.alias("value"))
        done = leaves if done is None else done.unionByName(leaves)
        level, opened = parts.where(kind.startswith("OBJECT")), opened + 1
        if opened % levels == 0:
            level = staged(level.withColumn("v", F.to_json("v")), "deep-objects").withColumn("v", F.try_parse_json("v"))
            if level.isEmpty():
                return done
