"""Import jobs: vendor CSV folders to tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from candlemill.sources.csv_files import accepted, read_bar_files, read_finance_files, rejected
from candlemill.sources.tables import append_statements, table_schema, write_bars


def load_bars(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """Replace the bar table by the files of a folder; returns the files turned down, one row each."""
    parsed = read_bar_files(spark, folder)
    write_bars(accepted(parsed), table)
    return rejected(parsed)


def load_statements(spark: SparkSession, folder: str, table: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Add the statement files of a folder to the statement table; returns the files turned down, one row each.

    A new table has the given columns, or those of the first readable file; one that exists keeps its own.
    """
    schema = table_schema(spark, table)
    parsed = read_finance_files(spark, folder, schema.names if schema else columns)
    append_statements(accepted(parsed), table)
    return rejected(parsed)
