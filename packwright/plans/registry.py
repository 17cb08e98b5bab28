"""Registry of queries and of the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a table with fewer splits than cores (a file is read by row group), dealt to all cores.

    A table of the sizes that this library is for has more splits, and is not shuffled.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < 2 * cores else rows


def dealt(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows take long each, dealt to all cores."""
    return spread(table(spark, sf_dir, name))


#: Long texts take long each.
texts = dealt
