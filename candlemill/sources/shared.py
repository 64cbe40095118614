"""Intermediate tables in the folder every executor of the cluster can reach."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

#: Folders written inside the innermost `scratch`, if any.
_owned: ContextVar[list[str] | None] = ContextVar("_owned", default=None)


def shared_folder(spark: SparkSession) -> str:
    """Folder named by spark.checkpoint.dir or by the session's `setCheckpointDir`."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    return named.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; the surrounding `scratch`, if any, removes it."""
    path = f"{shared_folder(spark)}/{name}-{uuid4().hex}"
    owned = _owned.get()
    if owned is not None:
        owned.append(path)
    return path


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once as a Parquet table and read it back, so that it is not computed again.

    The table outlives lost executors and cuts the lineage. It stays until the surrounding `scratch` ends.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def dealt_into(spark: SparkSession, tasks: int) -> Iterator[None]:
    """Exchanges have that many parts, which are not put together again. Holds for what runs inside, not for lazy results."""
    set_to = {"spark.sql.shuffle.partitions": str(tasks), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in set_to}
    for name, value in set_to.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go as soon as the job that wrote them has ended, rather than when the driver collects garbage.

    `toLocalIterator` ends its query before it reads a row, so inside it may only be called on what needs no shuffle.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, True)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def remove(spark: SparkSession, paths: Iterable[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Own the tables kept inside: they are removed at the end, so results must be written before it."""
    token = _owned.set([])
    try:
        yield
    finally:
        remove(spark, _owned.get())
        _owned.reset(token)
