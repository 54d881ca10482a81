"""Small tables that are part of a query: one list of rows for Spark and for the SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _cell(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return f"{value!r}::DOUBLE"
    if isinstance(value, list | tuple):
        return "[" + ", ".join(map(_cell, value)) + "]"
    return str(value)


def values(rows: list[tuple], *names: str) -> str:
    """A derived table of the rows; string cells keep their line feeds."""
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(_cell, r)) + ")" for r in rows) + f") t({', '.join(names)}))"
