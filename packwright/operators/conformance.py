"""Conformance of JSON records to a schema: the schema as a table of rules by path, joined with the records' nodes.

A schema is what presets give: ``type`` (a name or a list), ``enum``, ``minimum``, ``maximum``, ``minLength``,
``maxLength``, ``minItems``, ``maxItems``, ``pattern``, ``required``, ``properties``, ``items`` and
``additionalProperties: false``.  It is compiled to one rule a path (``$.a[*].b``).  A record becomes a Variant,
whose members and elements are exploded level by level, as deep as the schema goes; each node meets the rule
of its path, and what it breaks is a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("object", "array", "string", "number", "integer", "boolean", "null")
_LIMITS = ("minimum", "maximum", "minLength", "maxLength", "minItems", "maxItems")
RULE = "rule_path string, types array<string>, enum array<string>, pattern string, minimum double, maximum double, minLength long, maxLength long, minItems long, maxItems long, required array<string>, members array<string>, closed boolean, depth int"


def compiled(schema: dict) -> list[tuple]:
    """Rows of ``RULE``; raises on a keyword that is not known, so that none is passed over."""
    known, out = {"type", "enum", "pattern", "required", "properties", "items", "additionalProperties", "description", "title", *_LIMITS}, []
    import json

    def add(node: dict, path: str, depth: int) -> None:
        if strange := set(node) - known:
            raise ValueError(f"{path}: unknown keywords {sorted(strange)}")
        types = [node["type"]] if isinstance(node.get("type"), str) else node.get("type")
        if wrong := set(types or ()) - set(KINDS):
            raise ValueError(f"{path}: unknown types {sorted(wrong)}")
        members = node.get("properties", {})
        enum = None if "enum" not in node else [json.dumps(v, ensure_ascii=False, separators=(",", ":")) for v in node["enum"]]
        limits = [None if node.get(k) is None else (float if k in ("minimum", "maximum") else int)(node[k]) for k in _LIMITS]
        out.append((path, types, enum, node.get("pattern"), *limits, node.get("required", []), sorted(members), node.get("additionalProperties") is False, depth))
        for name, child in members.items():
            add(child, f"{path}.{name}", depth + 1)
        if "items" in node:
            add(node["items"], f"{path}[*]", depth + 1)

    add(schema, "$", 0)
    return out


def node_kind(value: Column) -> Column:
    """Kind of a Variant; a whole number is ``integer``."""
    name = F.schema_of_variant(value)
    number = F.try_variant_get(value, "$", "double")
    whole = F.when(number == F.floor(number), "integer").otherwise("number")
    return F.when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "array").when(name == "STRING", "string").when(name == "BOOLEAN", "boolean").when(name == "VOID", "null").otherwise(whole)


def nodes(records: DataFrame, id_column: str, raw: str, depth: int) -> DataFrame:
    """id, path, rule_path, value, depth of every node of the records down to ``depth``; the path of an element has its place."""
    spark = records.sparkSession
    level = records.select(F.col(id_column).alias("id"), F.lit("$").alias("path"), F.lit("$").alias("rule_path"), F.try_parse_json(raw).alias("value"), F.lit(0).alias("depth"))
    every = level
    for d in range(1, depth + 1):
        inner = level.where(node_kind(F.col("value")).isin("object", "array"))
        children = inner.lateralJoin(spark.tvf.variant_explode(F.col("value").outer()).toDF("pos", "key", "child"))
        step = F.when(F.col("key").isNotNull(), F.concat(F.lit("."), F.col("key")))
        level = children.select("id", F.concat("path", F.coalesce(step, F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))).alias("path"), F.concat("rule_path", F.coalesce(step, F.lit("[*]"))).alias("rule_path"), F.col("child").alias("value"), F.lit(d).alias("depth"))
        every = every.unionByName(level)
    return every


def violations(records: DataFrame, schema: dict, id_column: str = "case_id", raw: str = "raw") -> DataFrame:
    """id, path, rule of everything that breaks the schema.

    A record that is no JSON breaks ``json``; a missing member is named by its path under ``required``, one that a
    closed object does not know under ``additionalProperties``; what has a wrong type is not looked at further.
    """
    rules = compiled(schema)
    table = records.sparkSession.createDataFrame(rules, RULE)  # as many rows as the schema has paths
    found = nodes(records.select(id_column, raw), id_column, raw, max(r[-1] for r in rules))
    met = found.join(F.broadcast(table.drop("depth")), "rule_path").withColumn("kind", node_kind(F.col("value")))
    value = F.col("value")
    text, number = F.try_variant_get(value, "$", "string"), F.try_variant_get(value, "$", "double")
    keys = F.coalesce(F.json_object_keys(F.to_json(value)), F.array().cast("array<string>"))
    size = F.json_array_length(F.to_json(value))
    typed = F.col("types").isNull() | F.array_contains("types", F.col("kind")) | ((F.col("kind") == "integer") & F.array_contains("types", "number"))
    one = lambda rule, broken: F.when(broken, F.array(F.struct(F.col("path").alias("path"), F.lit(rule).alias("rule")))).otherwise(F.array().cast("array<struct<path:string,rule:string>>"))
    under = lambda rule, names: F.transform(names, lambda n: F.struct(F.concat("path", F.lit("."), n).alias("path"), F.lit(rule).alias("rule")))
    none = F.array().cast("array<struct<path:string,rule:string>>")
    is_ = lambda *kinds: F.col("kind").isin(*kinds)
    inside = F.concat(
        one("enum", F.col("enum").isNotNull() & ~F.array_contains("enum", F.to_json(value))), one("pattern", is_("string") & ~F.rlike(text, F.col("pattern"))),
        one("minimum", is_("number", "integer") & (number < F.col("minimum"))), one("maximum", is_("number", "integer") & (number > F.col("maximum"))),
        one("minLength", is_("string") & (F.char_length(text) < F.col("minLength"))), one("maxLength", is_("string") & (F.char_length(text) > F.col("maxLength"))),
        one("minItems", is_("array") & (size < F.col("minItems"))), one("maxItems", is_("array") & (size > F.col("maxItems"))),
        F.when(is_("object"), under("required", F.array_except("required", keys))).otherwise(none), F.when(is_("object") & F.col("closed"), under("additionalProperties", F.array_except(keys, "members"))).otherwise(none),
    )
    broken = F.when(value.isNull(), F.array(F.struct(F.col("path").alias("path"), F.lit("json").alias("rule")))).when(~typed, F.array(F.struct(F.col("path").alias("path"), F.lit("type").alias("rule")))).otherwise(inside)
    return met.select("id", F.explode(broken).alias("x")).select("id", "x.path", "x.rule")
