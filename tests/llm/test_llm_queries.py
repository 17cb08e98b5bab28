"""Queries on the columns that SQL can express, against their SQL."""

import duckdb
import pandas as pd
import pytest

from packwright.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want, got = con.execute(SQL[name]).df(), QUERIES[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)

    def rows(frame):
        plain = lambda v: None if pd.isna(v) else int(v) if isinstance(v, float) else v
        return sorted((tuple(map(plain, r)) for r in frame[columns].astype(object).values.tolist()), key=str)

    assert len(got) and rows(got) == rows(want)


def test_no_text_is_joined_for_exact_copies(spark):
    """Words are digested below the join with the groups, so that no text is shuffled."""
    plan = QUERIES["near_dedup_exact_copies"](spark, SF)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    joined = next(i for i, line in enumerate(plan) if "Join Inner" in line)
    assert joined < next(i for i, line in enumerate(plan) if "sha2(" in line)


def test_exact_copies_are_grouped_by_bytes(spark):
    """Digests are spelled out above the groups, so the groups' shuffles carry 32 bytes a document and not 64 characters."""
    plan = QUERIES["near_dedup_exact_copies"](spark, SF)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    grouped = [i for i, line in enumerate(plan) if "Aggregate" in line and "component_id" in line]
    assert not any("hex(digest" in line for line in plan[grouped[0] + 1 :])
