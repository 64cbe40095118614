"""Written intermediate tables of one job, in the folder that all executors share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from candlemill.sources.shared import keep, shuffles_removed

__all__ = ["Scratch", "shuffles_removed", "small_batches"]


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Rows with much in them go to Python a few at a time. Holds for what runs inside, not for lazy results."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Scratch:
    """Tables a job writes for itself: they cut lineage, are read many times and outlive lost executors.

    `drop` removes tables that nothing reads any more; those a lazy result still reads stay in `spark.checkpoint.dir`.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        return keep(df, name)

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for table in tables:
            for folder in {name.rsplit("/", 1)[0] for name in table.inputFiles()}:
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)
