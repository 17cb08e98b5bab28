"""Scoring of model outputs against a gold output, and the leaderboards over the scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from packwright.functions.text import bound, half_up, normalized_text
from packwright.operators.source import with_row_index
from packwright.sources.staging import staged

# ---- Fixed values of the contract ----
UNKNOWN_WORDS = ("unknown", "n/a", "na", "none", "not disclosed", "not available", "no information available")
CONTAINED, TOKEN_CAP, OVERFILLED = 0.76, 0.82, 0.45
AGREEMENT_WEIGHT, SHAPE_WEIGHT, RECALL_WEIGHT, SHAPE_CAP = 0.82, 0.12, 0.06, 0.8
MIN_QUALITY, MIN_PARSE_RATE, FREE_VALUE = 0.78, 0.9, 10_000
PROMPT_SHARE, COMPLETION_SHARE, PER_MILLION = 0.9, 0.1, 1_000_000
FAILURES_PER_MODEL, CONTEXT_MARGIN = 3, 4_000
# --------------------------------------


def is_unknown(value: Column) -> Column:
    """A text that says nothing."""
    return bound(normalized_text(value), says_nothing)


def says_nothing(normal: Column) -> Column:
    """``is_unknown`` of a text that is normalised already."""
    return (normal == "") | normal.isin(*UNKNOWN_WORDS)


def all_unknown(values: Column) -> Column:
    return F.coalesce(F.forall(values, is_unknown), F.lit(True))


def token_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of the distinct tokens of over two characters of two normalised texts."""
    tokens = lambda x: F.array_distinct(F.filter(F.split(x, r"\s+"), lambda t: F.length(t) > 2))
    both = F.struct(tokens(a).alias("a"), tokens(b).alias("b"))
    share = lambda s: F.size(F.array_intersect(s["a"], s["b"])) / F.size(F.array_union(s["a"], s["b"]))
    return bound(both, lambda s: F.when((F.size(s["a"]) == 0) & (F.size(s["b"]) == 0), 1.0).when((F.size(s["a"]) == 0) | (F.size(s["b"]) == 0), 0.0).otherwise(share(s)))


def score_string(actual: Column, gold: Column) -> Column:
    return score_normalized(normalized_text(actual), normalized_text(gold))


def score_normalized(actual: Column, gold: Column) -> Column:
    """``score_string`` of texts that are normalised already."""
    both = F.struct(actual.alias("a"), gold.alias("g"))
    return bound(
        both,
        lambda s: F.when(s["a"] == s["g"], 1.0)
        .when((s["a"] == "") | (s["g"] == ""), 0.0)
        .when(s["a"].contains(s["g"]) | s["g"].contains(s["a"]), CONTAINED)
        .otherwise(F.least(F.lit(TOKEN_CAP), token_jaccard(s["a"], s["g"]))),
    )


def score_number(actual: Column, gold: Column) -> Column:
    a, g = actual.cast("double"), gold.cast("double")
    apart = F.abs(a - g)
    unit = a.between(0, 1) & g.between(0, 1)
    near = F.when(unit, 1 - apart).otherwise(1 - apart / F.greatest(F.lit(1.0), F.abs(g)))
    return F.when(a.isNull() | g.isNull() | F.isnan(a) | F.isnan(g), 0.0).when(a == g, 1.0).otherwise(F.greatest(F.lit(0.0), near))


def score_array(actual: Column, gold: Column) -> Column:
    items = lambda x: F.array_distinct(F.filter(F.transform(F.coalesce(x, F.array().cast("array<string>")), normalized_text), lambda t: t != ""))
    both = F.struct(items(actual).alias("a"), items(gold).alias("g"))
    return bound(
        both,
        lambda s: F.when((F.size(s["a"]) == 0) & (F.size(s["g"]) == 0), 1.0)
        .when(F.size(s["g"]) == 0, OVERFILLED)
        .when(F.size(s["a"]) == 0, 0.0)
        .otherwise(F.size(F.array_intersect(s["a"], s["g"])) / F.size(F.array_union(s["a"], s["g"]))),
    )


def score_value(actual: Column, gold: Column, kind: str) -> Column:
    """Dispatch by the field's declared kind: string, number, boolean, array, or object (as JSON text)."""
    unknown = all_unknown if kind == "array" else lambda c: c.isNull() if kind in ("number", "boolean") else F.coalesce(is_unknown(c), F.lit(True))
    compare = {"string": score_string, "number": score_number, "array": score_array, "boolean": lambda a, g: F.when(a == g, 1.0).otherwise(0.0), "object": lambda a, g: token_jaccard(normalized_text(a), normalized_text(g))}[kind]
    a, g = F.coalesce(unknown(actual), F.lit(True)), F.coalesce(unknown(gold), F.lit(True))
    return F.when(a & g, 1.0).when(g, OVERFILLED).when(a, 0.0).otherwise(compare(actual, gold))


def schema_shape(valid: Column, present: Column, required: int) -> Column:
    """1 for a valid record, else the share of required members that are there, times SHAPE_CAP."""
    return F.when(valid, 1.0).otherwise(F.lit(SHAPE_CAP) * present / required if required else F.lit(0.0))


def case_quality(fields: list[tuple[Column, Column, str, int]], valid: Column, present: Column, required: int, parsed: Column) -> Column:
    """agreement_score, known_field_recall, schema_shape_score and quality_score of one case.

    fields: (actual, gold, kind, weight) of each compared field.
    """
    total = sum(w for *_, w in fields) or 1
    known = lambda c, kind: ~(all_unknown(c) if kind == "array" else c.isNull() if kind != "string" else F.coalesce(is_unknown(c), F.lit(True)))
    agreement = sum((score_value(a, g, kind) * w for a, g, kind, w in fields), F.lit(0.0)) / total
    gold_known = sum((known(g, kind).cast("int") for _, g, kind, _ in fields), F.lit(0))
    both_known = sum(((known(g, kind) & known(a, kind)).cast("int") for a, g, kind, _ in fields), F.lit(0))
    recall = F.when(gold_known > 0, both_known / gold_known).otherwise(1.0)
    shape = F.when(parsed, schema_shape(valid, present, required)).otherwise(0.0)
    quality = F.when(parsed, agreement * AGREEMENT_WEIGHT + shape * SHAPE_WEIGHT + recall * RECALL_WEIGHT).otherwise(0.0)
    names = ("agreement_score", "known_field_recall", "schema_shape_score", "quality_score")
    return F.struct(*[half_up(c, 4).alias(n) for c, n in zip((agreement, recall, shape, quality), names)])


def prices(prompt: Column, completion: Column) -> Column:
    """Prices by million tokens and their 90/10 blend; what is no number counts as 0."""
    number = lambda c: F.coalesce(c.try_cast("double"), F.lit(0.0))
    p, c = number(prompt) * PER_MILLION, number(completion) * PER_MILLION
    return F.struct(p.alias("input_per_1m"), c.alias("output_per_1m"), (p * PROMPT_SHARE + c * COMPLETION_SHARE).alias("blended_90_10_per_1m"))


def call_cost(request: Column, prompt: Column, completion: Column, prompt_tokens: Column, completion_tokens: Column) -> Column:
    return F.coalesce(request, F.lit(0.0)) + prompt_tokens * F.coalesce(prompt, F.lit(0.0)) + completion_tokens * F.coalesce(completion, F.lit(0.0))


def candidate_models(models: DataFrame, gold_id: str, least_context: int, denied: tuple[str, ...] = (), limit: int = 0, include_free: bool = False, need_format: bool = True) -> DataFrame:
    """Models cheaper than the gold model that read and write text, by blended price and id.

    models: id, context_length, prompt, completion, params, in_modalities, out_modalities.
    """
    text_only = F.array(F.lit("text"))
    priced = models.withColumn("price", prices(F.col("prompt"), F.col("completion")))
    gold = priced.where(F.col("id") == gold_id).agg(F.coalesce(F.max("price.blended_90_10_per_1m"), F.lit(0.0)).alias("gold_price"))
    blended, context = F.col("price.blended_90_10_per_1m"), F.coalesce("context_length", F.lit(0))
    fit = F.array_contains(F.coalesce("in_modalities", text_only), "text") & F.array_contains(F.coalesce("out_modalities", text_only), "text") & ((context == 0) | (context >= least_context))
    if need_format:
        fit = fit & F.array_contains(F.coalesce("params", F.array().cast("array<string>")), "response_format")
    if not include_free:
        fit = fit & (blended != 0)
    for pattern in denied:
        fit = fit & ~F.col("id").rlike(pattern)
    chosen = priced.crossJoin(F.broadcast(gold)).where(fit & (blended < F.col("gold_price"))).drop("gold_price")  # gold is one row
    ordered = chosen.orderBy("price.blended_90_10_per_1m", "id")
    return ordered.limit(limit) if limit else ordered


def listed_models(models: DataFrame, ids: list[str]) -> DataFrame:
    """The named models that the catalogue knows, in the order of the list."""
    wanted = models.sparkSession.createDataFrame([(i, m) for i, m in enumerate(ids)], "position int, id string")
    return models.join(F.broadcast(wanted), "id").orderBy("position")


def stopped_rows(scores: DataFrame, failures: int = FAILURES_PER_MODEL, salts: int = 16) -> DataFrame:
    """Adds skipped: whether a model had failed ``failures`` times before this case, which has no cached response.

    A case fails if its call or its parsing does; a cached one is read however often the model failed.
    All cases up to the last allowed failure are run, so that failure's position decides.  It is looked
    for in ``salts`` parts first, so no model's history meets in one task.
    """
    failed = scores.where(~(F.coalesce("ok", F.lit(False)) & F.coalesce("parse_ok", F.lit(False)))).select("model", "position")
    part = failed.withColumn("_part", F.pmod(F.hash("position"), F.lit(salts)))
    first = part.withColumn("_n", F.row_number().over(Window.partitionBy("model", "_part").orderBy("position"))).where(F.col("_n") <= failures)
    last = first.withColumn("_n", F.row_number().over(Window.partitionBy("model").orderBy("position"))).where(F.col("_n") == failures).select("model", F.col("position").alias("_last"))
    cached = F.coalesce("cached", F.lit(False)) if "cached" in scores.columns else F.lit(False)
    return scores.join(last, "model", "left").withColumn("skipped", ~cached & F.coalesce(F.col("position") > F.col("_last"), F.lit(False))).drop("_last")


def leaderboard(scores: DataFrame, min_quality: float = MIN_QUALITY) -> DataFrame:
    """One row a model: quality, parse and fallback rate, cost, latency, value, eligibility."""
    rate = lambda c: F.avg(F.col(c).cast("int"))
    sums = scores.groupBy("model").agg(
        F.count("*").alias("cases"), F.coalesce(F.avg("quality_score"), F.lit(0.0)).alias("_q"), F.coalesce(rate("parse_ok"), F.lit(0.0)).alias("_p"), F.coalesce(rate("fallback"), F.lit(0.0)).alias("_f"),
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("_c"), F.coalesce(F.avg("latency_ms"), F.lit(0.0)).alias("_l"),
    )
    each = F.col("_c") / F.col("cases")
    return sums.select(
        "model", "cases", half_up(F.col("_q"), 4).alias("avg_quality_score"), half_up(F.col("_p"), 4).alias("parse_rate"), half_up(F.col("_f"), 4).alias("fallback_rate"),
        half_up(F.col("_c"), 6).alias("total_cost_usd"), half_up(each, 6).alias("avg_cost_per_case_usd"), half_up(F.col("_l")).cast("long").alias("avg_latency_ms"),
        half_up(F.when(F.col("_c") > 0, F.col("_q") / each).otherwise(F.col("_q") * FREE_VALUE), 4).alias("best_value_score"),
        ((F.col("_q") >= min_quality) & (F.col("_p") >= MIN_PARSE_RATE)).alias("eligible"),
    )


def ranked_leaderboard(board: DataFrame) -> DataFrame:
    """Eligible models first, by cost; the others by quality, then cost."""
    cost = F.col("avg_cost_per_case_usd")
    return board.orderBy(F.desc("eligible"), F.when(F.col("eligible"), cost), F.desc("avg_quality_score"), cost, "model")


def verified_leaderboard(scores: DataFrame, expected_cases: int, min_quality: float = MIN_QUALITY) -> DataFrame:
    """The verifier's stricter board: a model must have all cases, and costs have four digits; first_position: of the model's first case."""
    first = F.min("position") if "position" in scores.columns else F.lit(0)
    sums = scores.where(F.coalesce("model", F.lit("")) != "").groupBy("model").agg(first.alias("first_position"), F.count("*").alias("cases"), F.coalesce(F.avg("quality_score"), F.lit(0.0)).alias("_q"), F.avg(F.col("parse_ok").eqNullSafe(True).cast("int")).alias("_p"), F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("_c"))
    return sums.select(
        "model", "cases", half_up(F.col("_q"), 4).alias("avg_quality_score"), half_up(F.col("_p"), 4).alias("parse_rate"), half_up(F.col("_c"), 4).alias("total_cost_usd"), half_up(F.col("_c") / F.col("cases"), 4).alias("avg_cost_per_case_usd"), "first_position",
        ((F.col("cases") >= expected_cases) & (F.col("_q") >= min_quality) & (F.col("_p") >= MIN_PARSE_RATE)).alias("eligible"),
    )


def benchmark_kpis(scores: DataFrame, expected_cases: int, expected_models: int, min_quality: float = MIN_QUALITY) -> DataFrame:
    """One row: completeness, best quality, eligible models, cheapest eligible and best model (of equal ones the first met), primary score."""
    board, expected = verified_leaderboard(scores, expected_cases, min_quality), expected_cases * expected_models
    eligible_cost = F.when(F.col("eligible"), F.struct("avg_cost_per_case_usd", (-F.col("avg_quality_score")).alias("q"), "model"))
    row = board.agg(
        F.coalesce(F.sum("cases"), F.lit(0)).alias("scored_cases"), F.coalesce(F.max("avg_quality_score"), F.lit(0.0)).alias("best_quality_score"), F.count_if("eligible").alias("eligible_models"),
        F.min(eligible_cost).alias("_cheapest"), F.min(F.struct((-F.col("avg_quality_score")).alias("q"), "first_position", "model"))["model"].alias("highest_quality_model"),
    )
    complete = (F.lit(expected) > 0) & (F.col("scored_cases") >= expected)
    primary = F.greatest(F.lit(0.0), F.lit(10_000.0) - F.col("_cheapest.avg_cost_per_case_usd") * PER_MILLION) - F.col("_cheapest.q") * 100
    return row.select(
        F.lit(expected).cast("long").alias("expected_scores"), "scored_cases", half_up(F.col("scored_cases") / max(1, expected), 4).alias("completed_fraction"), complete.alias("complete"), "best_quality_score", "eligible_models",
        F.col("_cheapest.model").alias("cheapest_eligible_model"), "highest_quality_model", half_up(F.when(complete & F.col("_cheapest").isNotNull(), primary).otherwise(0.0), 4).alias("primary_score"),
    )


def missing_gold(responses: DataFrame, gold: DataFrame) -> DataFrame:
    """Cases that have a response but no gold output; a benchmark must have none."""
    return responses.select("case_id").distinct().join(gold.select("case_id"), "case_id", "left_anti")


BITS = 64


def missing_pairs(scores: DataFrame) -> DataFrame:
    """model, case_id of each expected score that there is none of: every model against every case.

    A model's cases are bits, ``BITS`` cases a row; what is left of full rows is read off bit by bit, so of all
    pairs only the missing ones are ever formed.
    """
    known = scores.where("model IS NOT NULL AND case_id IS NOT NULL").select("model", "case_id")
    cases = staged(with_row_index(known.select("case_id").distinct(), "case_id"), "case-numbers")
    total = cases.count()
    numbered = known.join(cases, "case_id").select("model", F.floor(F.col("row_index") / BITS).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("row_index", F.lit(BITS)).cast("int")).alias("bit"))
    got = numbered.groupBy("model", "word").agg(F.bit_or("bit").alias("got"))
    words = known.select("model").distinct().select("model", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(0, total - 1) // BITS).cast("long"))).alias("word"))
    places = lambda bits: F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.call_function("getbit", bits, i) == 0)
    open_ = words.join(got, ["model", "word"], "left").select("model", F.explode(places(F.coalesce("got", F.lit(0).cast("long")))).alias("i"), "word")
    return open_.select("model", (F.col("word") * BITS + F.col("i")).alias("row_index")).join(cases, "row_index").select("model", "case_id")


def rows_by_case(rows: DataFrame) -> DataFrame:
    """The rows in the order of their case, numbered from 0 (``row_index``), as results are written."""
    return with_row_index(rows, "case_id")
