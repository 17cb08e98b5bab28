"""Schema conformance, completeness of a grid, profiles and user presets against plain versions."""

import json
import random

import pyarrow as pa
import pytest

from packwright.functions.text import text_hash
from packwright.operators import presets
from packwright.operators.benchmark import benchmark_kpis, missing_pairs, rows_by_case
from packwright.operators.conformance import compiled, violations

SCHEMA = {
    "type": "object", "required": ["a", "list"], "additionalProperties": False,
    "properties": {
        "a": {"type": ["string", "null"], "minLength": 2, "maxLength": 4, "pattern": "^x"}, "n": {"type": "number", "minimum": 0, "maximum": 1}, "i": {"type": "integer"}, "e": {"enum": ["u", 3, None, True]}, "free": {"type": "object"},
        "list": {"type": "array", "minItems": 1, "maxItems": 3, "items": {"type": "object", "required": ["z"], "properties": {"z": {"type": "array", "items": {"type": "boolean"}}}, "additionalProperties": False}},
    },
}


def plain(value, node, path):
    """A recursive checker."""
    kinds = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null", int: "integer", float: "number"}
    kind = kinds[type(value)]
    if kind == "number" and value == int(value):
        kind = "integer"
    types = [node["type"]] if isinstance(node.get("type"), str) else node.get("type")
    if types and kind not in types and not (kind == "integer" and "number" in types):
        return [(path, "type")]
    out = []
    if "enum" in node and json.dumps(value) not in [json.dumps(e) for e in node["enum"]]:
        out.append((path, "enum"))
    if kind == "string":
        out += [(path, k) for k, bad in (("minLength", len(value) < node.get("minLength", 0)), ("maxLength", len(value) > node.get("maxLength", 99)), ("pattern", "pattern" in node and not value.startswith("x"))) if bad]
    if kind in ("number", "integer"):
        out += [(path, k) for k, bad in (("minimum", value < node.get("minimum", value)), ("maximum", value > node.get("maximum", value))) if bad]
    if kind == "array":
        out += [(path, k) for k, bad in (("minItems", len(value) < node.get("minItems", 0)), ("maxItems", len(value) > node.get("maxItems", 99))) if bad]
        out += [x for i, v in enumerate(value) if "items" in node for x in plain(v, node["items"], f"{path}[{i}]")]
    if kind == "object":
        own = node.get("properties", {})
        out += [(f"{path}.{m}", "required") for m in node.get("required", []) if m not in value]
        out += [(f"{path}.{m}", "additionalProperties") for m in value if node.get("additionalProperties") is False and m not in own]
        out += [x for m, v in value.items() if m in own for x in plain(v, own[m], f"{path}.{m}")]
    return out


def test_violations_equal_a_recursive_checker(spark):
    rnd = random.Random(9)
    scalar = lambda: rnd.choice([None, True, "", "x", "xé😀", "xlonger", "no", 0, 1, 7, 0.5, -2.0, 3, "u"])
    some = lambda d: d if rnd.random() < 0.8 else scalar()
    item = lambda: some({k: [scalar() if rnd.random() < 0.3 else rnd.random() < 0.5 for _ in range(rnd.randrange(3))] for k in rnd.sample(["z", "y"], rnd.randrange(3))})
    record = lambda: some({k: some([item() for _ in range(rnd.randrange(5))]) if k == "list" else {"q": [1]} if k == "free" else scalar() for k in rnd.sample(["a", "n", "i", "e", "free", "list", "odd"], rnd.randrange(8))})
    values = [record() for _ in range(400)]
    rows = [(i, json.dumps(v)) for i, v in enumerate(values)] + [(-1, "{broken"), (-2, None)]
    got = sorted((r["id"], r["path"], r["rule"]) for r in violations(spark.createDataFrame(rows, "case_id long, raw string"), SCHEMA).collect())
    want = sorted([(i, *x) for i, v in enumerate(values) for x in plain(v, SCHEMA, "$")] + [(-1, "$", "json"), (-2, "$", "json")])
    assert got == want and {x[2] for x in want} >= {"type", "enum", "required", "additionalProperties", "minItems", "maxItems", "minLength", "maxLength", "pattern", "maximum", "minimum"}


def test_unknown_keywords_are_refused():
    with pytest.raises(ValueError, match="oneOf"):
        compiled({"type": "object", "properties": {"a": {"oneOf": []}}})


def test_missing_pairs_equal_the_product(spark):
    rnd = random.Random(2)
    pairs = {(f"m{rnd.randrange(5)}", f"c{rnd.randrange(300)}") for _ in range(900)}
    rows = spark.createDataFrame([*pairs, *list(pairs)[:50], (None, "c1"), ("m1", None)], "model string, case_id string")
    models, cases = {m for m, _ in pairs}, {c for _, c in pairs}
    got = [tuple(r) for r in missing_pairs(rows).collect()]
    assert sorted(got) == sorted((m, c) for m in models for c in cases if (m, c) not in pairs)
    assert missing_pairs(rows.limit(0)).count() == 0


def test_of_equal_models_the_first_met_counts(spark):
    rows = [("b", "1", 5, 0.9, True, 0.1), ("a", "1", 7, 0.9, True, 0.1), ("c", "1", 1, 0.2, True, 0.1)]
    frame = spark.createDataFrame(rows, "model string, case_id string, position long, quality_score double, parse_ok boolean, cost_usd double")
    assert benchmark_kpis(frame, 1, 3, 0.5).first()["highest_quality_model"] == "b"
    assert [r["row_index"] for r in rows_by_case(frame).orderBy("row_index").collect()] == [0, 1, 2]


def test_hash_counts_code_units(spark):
    def plain_hash(text):
        h, raw = 5381, text.encode("utf-16-be")
        for i in range(0, len(raw), 2):
            h = (h * 33 & 0xFFFFFFFF) ^ (raw[i] << 8 | raw[i + 1])
        return f"{h:x}"

    texts = ["", "a", "a😀b", "é\U0010ffff", "日本"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r[0]: r[1] for r in rows.select("t", text_hash(rows["t"])).collect()} == {t: plain_hash(t) for t in texts}
    assert plain_hash("a😀b") == "7d9bcedb"


def test_profiles(spark, tmp_path):
    def load(value):
        path = f"{tmp_path}/icp.json"
        with open(path, "w") as f:
            json.dump(value, f)
        return presets.read_icp(spark, f"file://{path}")

    good = load({"name": " Mid ", "description": "d", "target_industries": ["a ", "", 3, " b"], "employee_count_min": "10", "employee_count_max": 200.5, "disqualifiers": "none"})
    assert (good["name"], good["target_industries"][0], good["employee_count_min"], good["employee_count_max"], good["disqualifiers"]) == ("Mid", "a", 10.0, 200.5, [])
    assert presets.read_icp(spark, None) is None
    for value, message in (({"description": "d"}, "non-empty name"), ({"name": "n", "description": " "}, "non-empty description"), ({"name": "n", "description": "d", "employee_count_min": -1}, "non-negative"), ({"name": "n", "description": "d", "employee_count_max": "many"}, "non-negative"), ({"name": "n", "description": "d", "employee_count_min": 5, "employee_count_max": 4}, "greater than")):
        with pytest.raises(ValueError, match=message):
            load(value)


def test_a_preset_of_user_functions(spark):
    def errors(raw):
        return pa.array([["no a"] if "a" not in json.loads(x) else [] for x in raw.to_pylist()], pa.list_(pa.string()))

    def flat(raw):
        return pa.array([{"a": None if x is None else json.loads(x)["a"], "size": None if x is None else len(x)} for x in raw.to_pylist()], pa.struct([("a", pa.string()), ("size", pa.int64())]))

    own = presets.register_preset(presets.user_preset("of-a-test", errors, ("a string, size long", flat), ("fund",), (("a", "string", 3),)))
    try:
        rows = spark.createDataFrame([(1, '{"a":"x"}'), (2, "{}")], "id long, raw string")
        got = {r["id"]: (r["errors"], r["a"], r["size"]) for r in presets.preset_rows(rows, presets.preset("of-a-test")).collect()}
        assert got == {1: ([], "x", 9), 2: (["no a"], None, None)} and "fund" in own.gate
        with pytest.raises(ValueError, match="exists"):
            presets.register_preset(own)
    finally:
        del presets.PRESETS["of-a-test"]
