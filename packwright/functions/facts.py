"""Contact and location facts in text: e-mails, phones, postal codes, addresses, terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WORD_END, WS, bound, clip_text, compact, cut, distinct_texts, matches, one_spaced, replaced, trimmed, whole_word

# ---- Fixed values of the contract: patterns, word lists and thresholds ----
EMAIL = r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"
STATE_CODES = {
    "Alabama": "AL", "Alaska": "AK", "Arizona": "AZ", "Arkansas": "AR", "California": "CA", "Colorado": "CO", "Connecticut": "CT", "Delaware": "DE", "District of Columbia": "DC", "Florida": "FL", "Georgia": "GA", "Hawaii": "HI", "Idaho": "ID",
    "Illinois": "IL", "Indiana": "IN", "Iowa": "IA", "Kansas": "KS", "Kentucky": "KY", "Louisiana": "LA", "Maine": "ME", "Maryland": "MD", "Massachusetts": "MA", "Michigan": "MI", "Minnesota": "MN", "Mississippi": "MS", "Missouri": "MO", "Montana": "MT",
    "Nebraska": "NE", "Nevada": "NV", "New Hampshire": "NH", "New Jersey": "NJ", "New Mexico": "NM", "New York": "NY", "North Carolina": "NC", "North Dakota": "ND", "Ohio": "OH", "Oklahoma": "OK", "Oregon": "OR", "Pennsylvania": "PA", "Rhode Island": "RI",
    "South Carolina": "SC", "South Dakota": "SD", "Tennessee": "TN", "Texas": "TX", "Utah": "UT", "Vermont": "VT", "Virginia": "VA", "Washington": "WA", "West Virginia": "WV", "Wisconsin": "WI", "Wyoming": "WY",
}
PLACEHOLDER_MAIL = r"example\.com|email\.com|email\.con|yourdomain|domain\.com|test\.com"
PHONE = r"(?:\+?1[\s.-]?)?(?:\(\d{3}\)|\d{3})[\s.-]?\d{3}[\s.-]?\d{4}"
DUMMY_PHONES = ("1234567890", "11234567890")
POSTAL_CA, POSTAL_US = r"[A-Za-z]\d[A-Za-z]\s?\d[A-Za-z]\d", r"\d{5}(?:-\d{4})?"
LONG_NUMBER = r"\d[\d\s().-]{7,}\d"
LINE_WORDS = "address|phone|email|founded|headquarters|aum|portfolio|investment|invests|office"
BUSINESS_WORDS = "founded|established|headquarters|address|office|aum|assets under management|portfolio|invests|investment|venture|private equity|family office|grant|funding|seed|series a|growth equity"
SNIPPET_WORDS = "address|headquarters|office|location|phone|email|contact"
TERMS = ("venture capital", "private equity", "family office", "growth equity", "seed", "series a", "portfolio", "technology", "software", "healthcare", "fintech", "logistics", "real estate", "wealth management", "investment management", "grantmaking", "asset management", "3pl", "sourcing", "licensing")
STREET_KINDS = r"Street|St\.?|Avenue|Ave\.?|Road|Rd\.?|Boulevard|Blvd\.?|Drive|Dr\.?|Lane|Ln\.?|Way|Place|Pl\.?|Court|Ct\.?|Circle|Cir\.?|Parkway|Pkwy\.?|Highway|Hwy\.?|Suite|Ste\.?"
ADDRESS_ENDS = "Email|E-mail|Phone|Tel|Fax|Contact|Subscribe|Newsletter|Privacy|Terms|Copyright|All Rights Reserved|LinkedIn|Twitter|Facebook|Instagram"
# ---------------------------------------------------------------------------

FACT_LINE = "(?i)@|" + whole_word("|".join((r"\+?" + LONG_NUMBER, POSTAL_US, POSTAL_CA, LINE_WORDS)))
STREET = r"(?i)(?<![0-9A-Za-z_])\d{1,6}\s+[A-Za-z0-9.'#&\-\s]{2,90}\s(?:" + STREET_KINDS + r")(?![0-9A-Za-z_])[^|\n]{0,90}"


#: EMAIL with each run of letters tried once, from its start or from where the last match ended.
_EMAIL_ONCE = r"(?i)(?:(?<![A-Z0-9._%+-])|\G)[A-Z0-9._%+-]++@[A-Z0-9.-]+\.[A-Z]{2,}"


def state_code(name: Column) -> Column:
    """Two-letter code of a US state's name in any case; other values as they are."""
    codes = F.create_map(*[F.lit(x) for name_, code in STATE_CODES.items() for x in (name_.lower(), code)])
    return F.coalesce(F.element_at(codes, F.lower(trimmed(name))), name)


def is_fact_line(line: Column) -> Column:
    return matches(line, FACT_LINE)


def emails(text: Column, placeholders: str = PLACEHOLDER_MAIL) -> Column:
    """Addresses in lower case, in order, those of placeholder domains left out."""
    found = F.transform(F.regexp_extract_all(text, F.lit(_EMAIL_ONCE), F.lit(0)), F.lower)
    found = F.filter(found, lambda m: ~m.rlike(placeholders)) if placeholders else found
    return F.when(text.isNull(), F.lit(None)).when(text.contains("@"), found).otherwise(F.array().cast("array<string>"))


def normalize_phone(raw: Column) -> Column:
    ten = lambda d: F.when((F.length(d) == 11) & d.startswith("1"), F.substring(d, 2, 10)).when(F.length(d) == 10, d)
    shown = lambda t: F.concat(F.lit("+1 ("), F.substring(t, 1, 3), F.lit(") "), F.substring(t, 4, 3), F.lit("-"), F.substring(t, 7, 4))
    return bound(replaced(raw, (r"\D", "")), lambda d: F.when(d.isin(*DUMMY_PHONES), F.lit("")).otherwise(F.coalesce(bound(ten(d), shown), F.lit(""))))


def phones(text: Column) -> Column:
    return distinct_texts(F.transform(F.regexp_extract_all(text, F.lit(PHONE), F.lit(0)), normalize_phone))


def postal_hints(text: Column, known: Column | None = None, limit: int = 8) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(f"({whole_word(POSTAL_CA + '|' + POSTAL_US)})"), F.lit(1)), F.upper)
    return F.slice(distinct_texts(F.concat(F.array(F.coalesce(known, F.lit(""))), found) if known is not None else found), 1, limit)


def postal_code(text: Column, city: Column, state: Column) -> Column:
    """A code that follows the city and the state or its two letters, else the first code of any kind."""
    spaced = replaced(text, (f"{WS}+", " "))
    quoted = lambda c: F.concat(F.lit(r"\Q"), c, F.lit(r"\E"))
    known = lambda c: F.coalesce(c, F.lit("")) != ""
    after = lambda place: F.concat(F.lit("(?i)"), quoted(city), F.lit(r"\s*,?\s*"), quoted(place), F.lit(rf"\s+({POSTAL_CA}|{POSTAL_US})"))
    near = [F.when(known(city) & known(state), F.nullif(F.call_function("regexp_extract", spaced, after(place), F.lit(1)), F.lit(""))) for place in (state, state_code(state))]
    return F.upper(F.coalesce(*near, F.regexp_extract(spaced, whole_word(r"[A-Z]\d[A-Z]\s?\d[A-Z]\d|" + POSTAL_US), 0)))


def clean_address(value: Column) -> Column:
    """An address without the contact labels, links and mail addresses that follow it, at most 260 characters."""
    cleaned = replaced(one_spaced(value), (rf"(?is){whole_word(ADDRESS_ENDS)}.*\z", ""), (r"(?is)(?:©|mailto:|https?://|www\.).*\z", ""), (r"(?i)(?<![0-9A-Za-z_])" + EMAIL.removeprefix("(?i)") + WORD_END, ""), (r"\s*,\s*\z", ""), (r"\s{2,}", " "))
    return cut(one_spaced(cleaned), 260)


def street_address(text: Column) -> Column:
    """The first street in a text with what follows it, cleaned."""
    return clean_address(cut(one_spaced(F.regexp_extract(replaced(text, (f"{WS}+", " ")), STREET, 0)), 220))


def location_parts(address: Column) -> Column:
    """city, state and country that a one-line address shows."""
    a = F.coalesce(address, F.lit(""))
    code = r"(?:[A-Za-z]\d[A-Za-z]|\d{5})"
    return F.struct(
        trimmed(F.regexp_extract(a, rf",\s*([^,]+),\s*[^,]+,\s*{code}", 1)).alias("city"),
        trimmed(F.regexp_extract(a, rf",\s*([A-Za-z]{{2}}|[A-Za-z ]{{4,30}}),\s*{code}", 1)).alias("state"),
        F.when(a.contains("United States"), F.lit("United States")).otherwise(F.lit("")).alias("country"),
    )


def address_choice(street: Column, postal: Column, city: Column, state: Column, country: Column) -> Column:
    """full_address, postal_code, source and confidence: the street first, then the row's place with a postal code, then either alone."""
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    joined = lambda *parts: F.array_join(F.filter(F.array(*[F.coalesce(p, F.lit("")) for p in parts]), lambda p: p != ""), ", ")
    tier = lambda full, code, source, sure: F.struct(full.alias("full_address"), code.alias("postal_code"), source.alias("source"), sure.alias("confidence"))
    place, code, text = compact(joined(city, state, country), 300), F.coalesce(postal, F.lit("")), F.lit
    return (
        F.when(has(street), tier(clean_address(compact(joined(street, city, state, postal, country), 420)), code, text("scraped_site_text"), F.when(has(postal), "high").otherwise("medium")))
        .when(has(postal) & (place != ""), tier(compact(F.concat_ws(" ", place, postal), 320), code, text("csv_location_plus_scraped_postal_code"), text("medium")))
        .when(place != "", tier(place, text(""), text("csv_city_state_country"), text("low")))
        .otherwise(tier(text(""), code, F.when(has(postal), "scraped_postal_code_only").otherwise(""), F.when(has(postal), "low").otherwise("none")))
    )


def fact_signals(text: Column) -> Column:
    """score and reasons of the facts that a text holds."""
    parts = (
        (text.contains("@") & (F.size(emails(text)) > 0), 12, "email_signal"),
        (F.size(phones(text)) > 0, 12, "phone_signal"),
        (matches(text, whole_word(f"{POSTAL_US}|{POSTAL_CA}")), 10, "postal_code_signal"),
        (matches(text, "(?i)" + whole_word(BUSINESS_WORDS)), 16, "business_or_capital_signal"),
    )
    found = F.filter(F.array(*[F.struct(test.alias("holds"), F.lit(points).alias("points"), F.lit(why).alias("why")) for test, points, why in parts]), lambda x: x["holds"])
    score = lambda fs: F.aggregate(fs, F.lit(0).cast("long"), lambda acc, x: acc + x["points"])
    return bound(found, lambda fs: F.struct(score(fs).alias("score"), F.transform(fs, lambda x: x["why"]).alias("reasons")))


def terms(text: Column, known: tuple[str, ...] = TERMS) -> Column:
    """The known terms that a text holds; it is lowered once for all of them."""
    return bound(F.lower(text), lambda low: F.filter(F.array(*[F.lit(t) for t in known]), lambda t: low.contains(t)))


def first_sentence(text: Column) -> Column:
    """The first sentence of over 80 characters that is no menu text."""
    parts = F.transform(F.split(replaced(text, (r"(?m)^#+\s+", "")), r"(?=\s)(?<=[.!?])\s+"), one_spaced)
    good = F.filter(parts, lambda p: (F.length(p) > 80) & ~p.rlike("(?i)^home|menu|skip to content|homepage"))
    return F.coalesce(F.get(good, F.lit(0)), F.lit(""))


def snippets(text: Column, pattern: str = "(?i)" + whole_word(f"{SNIPPET_WORDS}|{POSTAL_CA}|{POSTAL_US}"), limit: int = 12) -> Column:
    """Lines that match, each with the line before and two after, joined by `` / ``."""
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), one_spaced), lambda x: x != "")
    numbers = lambda ls: F.when(F.size(ls) > 0, F.sequence(F.lit(1), F.size(ls))).otherwise(F.array().cast("array<int>"))
    hits = lambda ls: F.slice(F.filter(numbers(ls), lambda i: F.get(ls, i - 1).rlike(pattern)), 1, limit)
    around = lambda ls, i: clip_text(F.array_join(F.slice(ls, F.greatest(i - 1, F.lit(1)), F.when(i == 1, F.lit(3)).otherwise(F.lit(4))), " / "), 420)
    return bound(lines, lambda ls: distinct_texts(F.transform(hits(ls), lambda i: around(ls, i))))


def without_urls(markdown: Column) -> Column:
    steps = ((r"(?i)\[([^\]]+)\]\((?:https?://|mailto:|tel:)[^)]+\)", "$1"), (r"(?i)https?://\S+", ""), (r"(?i)(?<![0-9A-Za-z_])(?:mailto|tel):\S+", ""), (r"[ \t]{2,}", " "), (r"\n{3,}", "\n\n"))
    return trimmed(replaced(markdown, *steps))
