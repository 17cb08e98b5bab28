"""From packets to enriched rows: gates, attempts, response cache, defaults, flattening, summaries."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from packwright.functions.text import bound, half_up, one_spaced, replaced
from packwright.operators.gate import GATE_TERMS

# ---- Fixed values of the contract ----
RETRYABLE, FALLBACK_STATUSES = (0, 408, 409, 429), (400, 404, 422)
SENTINELS = ("no usable company-site content was kept after cleanup", "no usable third-party content was kept after cleanup")
LEAST_PACKET_CHARS = 80
METADATA_LINE = r"(?im)^(# scraped content for|company:|domain:|full address:).*$"
BEFORE_TERM, AFTER_TERM = "(?<![0-9a-z_])", "(?![0-9a-z_])"
UNSET_WORDS = ("", "unknown", "null")
IMMATERIAL_TEXTS = ("", "[]", "{}", "null")
# --------------------------------------


def is_retryable(status: Column) -> Column:
    return status.isin(*RETRYABLE) | (status >= 500)


def needs_plain_format(status: Column) -> Column:
    """Whether a structured-output request should be repeated without its schema."""
    return status.isin(*FALLBACK_STATUSES)


def lacks_both_sources(markdown: Column) -> Column:
    low = F.lower(markdown)
    return low.contains(SENTINELS[0]) & low.contains(SENTINELS[1])


def is_empty_packet(markdown: Column) -> Column:
    """A packet without evidence: hardly any text, or both sentinel sentences."""
    plain = one_spaced(replaced(markdown, (r"(?s)---.*?---", " "), (r"[#*_`>|\[\]()-]", " ")))
    return (F.length(plain) < LEAST_PACKET_CHARS) | lacks_both_sources(markdown)


def allocator_terms() -> dict[str, str]:
    """The fixed list of the gate, label to regular expression."""
    return {label: f"{BEFORE_TERM}(?:{pattern}){AFTER_TERM}" for label, pattern in GATE_TERMS}


def gate_labels(markdown: Column, terms: dict[str, str]) -> Column:
    """Labels of the terms (label to regular expression) that a packet names outside its metadata lines.

    The text is made once for all terms; a term of the gate's own form is looked for by its first letters.
    """

    def named(text: Column, pattern: str) -> Column:
        first, form = letters_first(pattern)
        return text.contains(first) & text.rlike(form) if first else text.rlike(form)

    text = F.lower(replaced(markdown, (METADATA_LINE, "")))
    return bound(text, lambda t: F.array_compact(F.array(*[F.when(named(t, pattern), F.lit(label)) for label, pattern in terms.items()])))


def letters_first(pattern: str) -> tuple[str, str]:
    """The letters that any match of a term of the gate's form starts with, and an equal expression that looks for them
    before it looks behind; no letters and the same expression for other forms.
    """
    inner = pattern.removeprefix(BEFORE_TERM).removesuffix(AFTER_TERM)
    if pattern != f"{BEFORE_TERM}{inner}{AFTER_TERM}" or not inner.startswith("(?:") or not inner.endswith(")"):
        return "", pattern
    first, other = re.fullmatch(r"(?s)([a-z0-9 ]*)(.*)", inner[3:-1]).groups()
    # one alternative only: bars stand inside groups without groups in them
    if not re.fullmatch(r"(?:[a-z0-9 ]|\(\?:[a-z|]*\)|\[[a-z -]*\]|\?)*", other):
        return "", pattern
    if other.startswith("?"):
        first, other = first[:-1], first[-1:] + other
    return (first, f"{first}(?<![0-9a-z_]{first}){other}{AFTER_TERM}") if first else ("", pattern)


def routed(packets: DataFrame, terms: dict[str, str] | None = None) -> DataFrame:
    """packets(case_id, markdown) with route ``empty``, ``no_keyword`` or ``pass``, and the labels that matched."""
    labelled = packets.withColumn("labels", gate_labels(F.col("markdown"), allocator_terms() if terms is None else terms))
    return labelled.withColumn("route", F.when(lacks_both_sources(F.col("markdown")), "empty").when(F.size("labels") == 0, "no_keyword").otherwise("pass"))


def chosen_attempts(attempts: DataFrame, retry_unparsed: bool = False) -> DataFrame:
    """The attempt that stands for each case: the first that ends the retries, else the last.

    attempts: case_id, attempt, status, parsed, ...  An attempt ends the retries if its status isn't
    retryable; with ``retry_unparsed`` (the older policy), only if its body parsed.
    """
    ends = F.col("parsed") if retry_unparsed else ~is_retryable(F.col("status"))
    order = F.when(ends, F.struct(F.lit(0).alias("late"), F.col("attempt").alias("at"))).otherwise(F.struct(F.lit(1).alias("late"), (-F.col("attempt")).alias("at")))
    columns = [c for c in attempts.columns if c != "case_id"]
    best = attempts.groupBy("case_id").agg(F.min_by(F.struct(*columns), order).alias("_best"), F.count("*").alias("attempts"))
    return best.select("case_id", "_best.*", "attempts")


def to_call(cases: DataFrame, cache: DataFrame, force: bool = False) -> DataFrame:
    """Cases without a cached response; all of them if ``force``."""
    return cases if force else cases.join(cache.select("case_id"), "case_id", "left_anti")


def with_cache(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """Cached responses and fresh ones of other cases."""
    return cache.unionByName(fresh.join(cache.select("case_id"), "case_id", "left_anti"), allowMissingColumns=True)


def fixture_responses(cases: DataFrame, fixtures: DataFrame, variant: str) -> DataFrame:
    """Responses from a table of (case_id, variant, raw_text); cases without one have a null response."""
    return cases.join(fixtures.where(F.col("variant") == variant).select("case_id", "raw_text"), "case_id", "left")


def token_usage(reported: Column, text: Column) -> Column:
    """Reported tokens, or an estimate of four characters each."""
    return F.coalesce(F.nullif(reported, F.lit(0)), F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4)).cast("long")


def usage_cost(prompt_tokens: Column, completion_tokens: Column, input_per_1m: float, output_per_1m: float) -> Column:
    return (prompt_tokens * input_per_1m + completion_tokens * output_per_1m) / 1e6


def filled_default(value: Column, *candidates: Column) -> Column:
    """The value, or where it is unset the first candidate that isn't blank."""
    filled = F.coalesce(*[F.when(F.trim(F.coalesce(c, F.lit(""))) != "", c) for c in candidates])
    unset = F.lower(F.trim(F.coalesce(value, F.lit("")))).isin(*UNSET_WORDS)
    return F.when(unset & filled.isNotNull(), filled).otherwise(value)


def first_material(*values: Column) -> Column:
    """The first value, trimmed, that is no blank, empty list, empty object or null in words; else an empty text."""
    texts = [F.trim(F.coalesce(v.cast("string"), F.lit(""))) for v in values]
    return F.coalesce(*[F.when(~F.lower(t).isin(*IMMATERIAL_TEXTS), t) for t in texts], F.lit(""))


def run_summary(rows: DataFrame) -> DataFrame:
    """total, successful, failed, total cost, mean latency and status of a run's rows (ok, parsed, cost_usd, latency_ms)."""
    total, good = F.count("*"), F.count_if(F.coalesce("ok", F.lit(False)))
    finite = F.when(~F.isnan("latency_ms"), F.col("latency_ms"))
    return rows.agg(
        total.alias("total"), good.alias("successful"), (total - good).alias("failed"), F.count_if(F.coalesce("parsed", F.lit(False))).alias("parse_ok"),
        half_up(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 6).alias("total_cost_usd"), F.coalesce(half_up(F.avg(finite)), F.lit(0.0)).cast("long").alias("avg_latency_ms"),
        F.when(total == good, "completed").otherwise("completed_with_failures").alias("status"),
    )


def message_text(content: Column, joiner: str = "\n") -> Column:
    """Text of a message: a JSON string, or the texts of a JSON array of parts."""
    parts = F.from_json(content, "array<struct<type:string,text:string>>")
    joined = F.array_join(F.filter(F.transform(parts, lambda p: p["text"]), lambda t: t.isNotNull()), joiner)
    plain = F.get_json_object(F.concat(F.lit('{"v":'), content, F.lit("}")), "$.v")
    return F.when(content.rlike(r"^\s*\["), joined).otherwise(plain)


def recent_rows(rows: DataFrame, key: str, order: str, n: int = 80, salts: int = 16) -> DataFrame:
    """The latest n rows of each key, latest first; of ``salts`` parts of a key first, so that no key meets in one task."""
    last = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    few = rows.withColumn("recent", last(key, F.pmod(F.hash(order), F.lit(salts)))).where(F.col("recent") <= n)
    return few.withColumn("recent", last(key)).where(F.col("recent") <= n)
