"""Plumbing the operators share: importable workers, written tables, checked broadcasts, stable row ids."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigsearch.operators.joins import shared_folder

ROOT = str(Path(__file__).resolve().parents[2])
BROADCAST_ROWS = 400_000  # narrow rows up to which a counted side is broadcast
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def ready(spark: SparkSession) -> None:
    """Let Python workers import this package even where it is not installed, and get texts in batches of bounded size.

    A batch size that the session sets itself is left as it is.
    """
    if spark.conf.get(BATCH_KEY, None) is None:
        spark.conf.set(BATCH_KEY, BATCH_BYTES)
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of ``written`` that nothing will read again."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


SHUFFLE_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside delete their shuffle files as they end, not when the driver happens to collect its garbage."""
    before = spark.conf.get(SHUFFLE_KEY, None)
    spark.conf.set(SHUFFLE_KEY, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_KEY)
        else:
            spark.conf.set(SHUFFLE_KEY, before)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if the counted rows fit; otherwise Spark shuffles both sides."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def bounded_sample(df: DataFrame, rows: int, *key: str) -> DataFrame:
    """At most ``rows`` rows, chosen by the hash of ``key``.

    The table is thinned to about twice as many first, so that what the tasks send on does not grow with their number.
    """
    h = F.xxhash64(*key)
    share = max(1, df.count() // (2 * rows))
    return df.where(F.pmod(h, F.lit(share)) == 0).orderBy(h, *key).limit(rows)


def task_id() -> int:
    return TaskContext.get().partitionId()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have, whatever its case."""
    taken, name = {c.lower() for c in df.columns}, f"_{base}"
    while any(c.startswith(name) for c in taken):
        name = f"_{name}"
    return name


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is not in ``dropped``; a null doc_id is never dropped."""
    key = fresh(docs, "gone")
    gone = dropped.select(F.col("doc_id").alias(key)).where(F.col(key).isNotNull()).distinct()
    return docs.join(small(gone), F.col("doc_id") == F.col(key), "left_anti")
