"""Best rows per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Equal scores have no natural order; this one makes results repeatable.
TIE_BREAK = ["crate", "item_id", "impl_id"]


def first_per(df: DataFrame, group: list[str], order: list[str], k: int | None, rank: str | None = None) -> DataFrame:
    """First ``k`` rows per group.

    Spark limits the rows of a group in every input partition before moving them, so a group holding
    most of the rows costs at most ``k`` rows per partition.
    """
    name = rank or "_rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    if k is not None:
        ranked = ranked.filter(F.col(name) <= k)
    return ranked if rank else ranked.drop(name)
