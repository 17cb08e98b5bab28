"""CSV and JSON tables: reading of ragged CSV, and sinks whose text any reader accepts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packwright.sources.csv_ranges import RANGE_BYTES, read_ranges


def read_csv(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """All columns as text, by the header; blank lines are skipped, short rows are filled with empty text.

    Quotes double inside quotes and quoted values may hold line ends, as they stand; files are still read in
    ranges of ``range_bytes`` by as many tasks.  ``row_index`` counts the rows in file order.
    """
    return read_ranges(spark, path, range_bytes)


def plain_text(value: Column, kind: T.DataType) -> Column:
    """A value as a table's text: null is empty, arrays, maps and structs are JSON."""
    as_json = isinstance(kind, (T.ArrayType, T.MapType, T.StructType))
    return F.coalesce(F.to_json(value) if as_json else value.cast("string"), F.lit(""))


def csv_escaped(text: Column) -> Column:
    """The text, in quotes if it holds a comma, a quote or a line end."""
    return F.when(text.rlike('[",\\n\\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_lines(rows: DataFrame) -> DataFrame:
    """``line``: each row as a line of CSV, the columns in their order."""
    return rows.select(F.concat_ws(",", *[csv_escaped(plain_text(F.col(f"`{f.name}`"), f.dataType)) for f in rows.schema.fields]).alias("line"))


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV files with a header each; every column is there whatever the first row holds."""
    texts = [repaired(plain_text(F.col(f"`{f.name}`"), f.dataType)).alias(f.name) for f in rows.schema.fields]
    rows.select(*texts).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def repaired(text: Column) -> Column:
    """The text with what is no valid character as U+FFFD."""
    return F.make_valid_utf8(text)


def write_json_lines(rows: DataFrame, path: str, append: bool = False) -> None:
    """One JSON object a line; nulls stay as nulls, so every row has all members."""
    texts = [(repaired(F.col(f"`{f.name}`")) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`")).alias(f.name) for f in rows.schema.fields]
    rows.select(*texts).write.mode("append" if append else "errorifexists").option("ignoreNullFields", False).json(path)


def read_json_lines(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)
