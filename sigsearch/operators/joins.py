"""Joins that stay balanced: broadcast only what was measured, split hot keys otherwise."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 << 20  # text size up to which a measured side is broadcast
ROWS_PER_KEY = 200_000  # rows of one key that one task may get
MAX_PIECES = 1 << 16


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder the cluster names."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            shared = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(shared)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder for written tables; the same rule as for checkpoints."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        settle(spark.range(0))
    return sc.getCheckpointDir()


def tasks_for(spark: SparkSession, rows: int, rows_per_task: int = 200_000) -> int:
    """Number of tasks for work whose cost lies in the rows, not in their bytes."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // rows_per_task))


def text_bytes(df: DataFrame) -> int:
    """Size of all rows written as text, measured in one pass."""
    row = df.select(F.octet_length(F.to_json(F.struct(*df.columns))).cast("long").alias("b")).agg(
        F.coalesce(F.sum("b"), F.lit(0))
    )
    return row.first()[0]


def fits(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    return text_bytes(df) <= limit


def pieces(df: DataFrame, key: str, limit: int | None = None) -> list[DataFrame]:
    """Cut a table by the hash of ``key`` into parts that were each measured to fit a broadcast.

    One part for all but very large query logs.  The other side of a join with a part stays where it
    is, so its partitioning and balance do not depend on how frequent the join keys are.
    """
    limit = limit or BROADCAST_BYTES
    size = F.octet_length(F.to_json(F.struct(*df.columns))).cast("long")
    n = 1
    while n <= MAX_PIECES:
        part = F.pmod(F.xxhash64(key), F.lit(n))
        worst = df.groupBy(part.alias("p")).agg(F.sum(size).alias("b")).agg(F.max("b")).first()[0] or 0
        if worst <= limit:
            return [df] if n == 1 else [df.filter(part == i) for i in range(n)]
        n *= max(2, -(-worst // limit))
    raise ValueError(f"a row is larger than the {limit} bytes that may be broadcast")


def by_key(df: DataFrame) -> DataFrame:
    """Marks a table that grows with the input for its next join: rows of both sides move by key, neither is broadcast.

    Left to itself, Spark goes by the size of a table's files, and rows take many times as much in memory.
    """
    return df.hint("merge")


def split_hot_keys(
    left: DataFrame, right: DataFrame, on: list[str], spread_by: str, rows_per_key: int = ROWS_PER_KEY
) -> DataFrame:
    """Inner join where keys of ``left`` may be hot.

    Keys are counted first (combined map-side).  Only keys above ``rows_per_key`` are split into
    parts; their rows of ``right`` are copied once per part.  All other keys are joined as they are.
    Neither side is broadcast; a right side that was measured to be small needs no splitting.
    """
    hot = (
        left.groupBy(*on).count().filter(F.col("count") > rows_per_key)
        .select(*on, F.ceil(F.col("count") / rows_per_key).cast("int").alias("_parts"))
    )
    hot = settle(hot)
    if hot.isEmpty():
        return left.join(by_key(right), on)
    # At most (rows of left / rows_per_key) keys can be hot; without hint if that is still a lot.
    hint = F.broadcast if fits(hot) else (lambda d: d)
    parts = F.coalesce("_parts", F.lit(1))
    l = left.join(hint(hot), on, "left").withColumn("_part", F.pmod(F.xxhash64(spread_by), parts).cast("int"))
    r = right.join(hint(hot), on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return l.drop("_parts").join(by_key(r.drop("_parts")), [*on, "_part"]).drop("_part")
