"""Records are parsed once, however many rules look at them."""

import json

import pytest
from pyspark.sql import functions as F

from packwright.operators import presets, validation


def parses(spark, expression) -> int:
    frame = spark.createDataFrame([("{}", "{}")], "raw string, gold string").select(expression.alias("x"))
    return frame._jdf.queryExecution().optimizedPlan().toString().count("parseJson(")


@pytest.mark.parametrize("rules, records", [
    (validation.company_errors, 1), (validation.capital_errors, 1), (validation.is_complete_record, 1), (lambda r: validation.qualification_errors(r, False), 1),
    (lambda r: presets.field_scores(r, F.col("gold"), presets.preset("company")), 2),
])
def test_one_parse_a_record(spark, rules, records):
    assert parses(spark, rules(F.col("raw"))) == records


def test_scores_of_odd_records(spark):
    record = {"identity": {"canonical_name": "Acme Saws"}, "offering": {"products_and_services": ["saws", "blades"]}, "quality": {"confidence_score": 0.5}}
    other = {"identity": {"canonical_name": "acme  saws!"}, "offering": {"products_and_services": ["saws"], "target_customers": ["unknown"]}, "quality": {"confidence_score": None}}
    rows = [(json.dumps(record), json.dumps(other)), ("no json", json.dumps(record)), (json.dumps(record), None), (None, None), ("[]", "{}")]
    frame = spark.createDataFrame(rows, "raw string, gold string")
    got = [{s["path"]: s["score"] for s in r[0]} for r in frame.select(presets.field_scores(F.col("raw"), F.col("gold"), presets.preset("company"))).collect()]
    name, goods, sure = "identity.canonical_name", "offering.products_and_services", "quality.confidence_score"
    assert [(x[name], x[goods], x[sure]) for x in got] == [(1.0, 0.5, 0.45), (0.0, 0.0, 0.0), (0.45, 0.45, 0.45), (1.0, 1.0, 1.0), (1.0, 1.0, 1.0)]
    assert all(x["offering.target_customers"] == 1.0 for x in got)
