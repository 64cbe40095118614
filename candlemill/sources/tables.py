"""Reading and writing the bar and statement tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlemill.schemas import BAR_SCHEMA


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The table, with the given columns or those it was written with."""
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def table_schema(spark: SparkSession, path: str) -> T.StructType | None:
    """The columns of a table that exists."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.parquet(path).schema


def fit(df: DataFrame, schema: T.StructType) -> DataFrame:
    """`df` in the columns of a table: missing ones NULL, further ones left out."""
    return df.select(*(
        F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ))


def fit_bars(df: DataFrame) -> DataFrame:
    return fit(df, BAR_SCHEMA)


def write_bars(bars: DataFrame, path: str) -> None:
    """Replace the bar table. Rows are ranged by stock and date, so that code and date filters skip files and row
    groups, and a stock with very many bars spreads over several files.
    """
    ranged = fit_bars(bars).repartitionByRange("stock_code", "trade_date").sortWithinPartitions("stock_code", "trade_date")
    ranged.write.mode("overwrite").parquet(path)


def append_statements(statements: DataFrame, path: str) -> None:
    """Add statements to the table, in its columns. Loading a file again adds its rows again."""
    schema = table_schema(statements.sparkSession, path)
    fitted = fit(statements, schema) if schema else statements
    fitted.write.mode("append").parquet(path)
