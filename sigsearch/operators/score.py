"""From aligned rows to one (sum, count) per query and signature."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigsearch.operators.align import DIFFERENT, EQUAL, NEAR, PAIR


def bound_rows(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add the component of each generic: the first use binds it, later uses compare with that."""
    uses = Window.partitionBy(*PAIR, "generic").orderBy(*order)
    first = F.first("canon").over(uses)
    bind = F.when(F.row_number().over(uses) == 1, F.lit(NEAR)).otherwise(
        F.when(F.col("canon") == first, F.lit(EQUAL)).otherwise(F.lit(DIFFERENT))
    )
    has = F.col("generic").isNotNull()
    return (
        rows.withColumn("_b", bind)
        .withColumn("s", F.when(has, F.col("s") + F.col("_b")).otherwise(F.col("s")))
        .withColumn("c", F.when(has, F.col("c") + 1).otherwise(F.col("c")))
        .drop("_b")
    )


def pair_sums(rows: DataFrame) -> DataFrame:
    """Same result as summing ``bound_rows``, by grouping only.

    Of the uses of one generic, all that bind to the first one's text cost nothing but the first
    itself; so counting the uses per text, with the earliest position, is enough.
    """
    texts = rows.groupBy(*PAIR, "generic", "canon").agg(
        F.sum("s").alias("s"), F.sum("c").alias("c"), F.count("*").alias("n"), F.min("seq").alias("at")
    )
    uses = texts.groupBy(*PAIR, "generic").agg(
        F.sum("s").alias("s"), F.sum("c").alias("c"), F.sum("n").alias("n"), F.min_by("n", "at").alias("same")
    )
    has = F.col("generic").isNotNull()
    bind = F.when(has, NEAR + (F.col("n") - F.col("same")) * DIFFERENT).otherwise(0.0)
    return (
        uses.groupBy(*PAIR)
        .agg(
            F.sum(F.col("s") + bind).alias("s"),
            F.sum(F.col("c") + F.when(has, F.col("n")).otherwise(0)).alias("c"),
        )
    )


def reading_sums(rows: DataFrame, depth: int) -> DataFrame:
    """Same result as summing ``choose_readings`` of ``bound_rows``, by grouping only.

    First every reading of a pair becomes one row with its sums, generics bound over all readings; then, innermost aliases
    first, the best reading of each alias takes the place of the alias in the reading around it.  What is collected are
    the readings of one signature against one text.
    """
    uses = rows.groupBy(*PAIR, "generic", "canon", "alts").agg(
        F.sum("s").alias("s"), F.sum("c").alias("c"), F.count("*").alias("n"), F.min(F.struct("slot", "ord")).alias("at")
    )
    bound = uses.groupBy(*PAIR, "generic").agg(
        F.min(F.struct("at", "canon")).alias("first"), F.collect_list(F.struct("alts", "canon", "s", "c", "n", "at")).alias("u")
    ).withColumn("u", F.explode("u")).select(*PAIR, "generic", "first", "u.*")
    binds = (F.col("at") == F.col("first.at")).cast("int")
    other = F.when(F.col("canon") == F.col("first.canon"), F.lit(EQUAL)).otherwise(F.lit(DIFFERENT))
    has = F.col("generic").isNotNull()
    sums = bound.groupBy(*PAIR, "alts").agg(
        F.sum(F.col("s") + F.when(has, binds * NEAR + (F.col("n") - binds) * other).otherwise(0.0)).alias("s"),
        F.sum(F.col("c") + F.when(has, F.col("n")).otherwise(0)).alias("c"),
    )
    for level in range(depth, 0, -1):
        inner = F.get("alts", F.lit(level - 1))
        best = sums.select(
            *PAIR, F.slice("alts", F.lit(1), F.lit(level - 1)).alias("alts"), inner["alt"].alias("alt"), inner["b"].alias("b"), "s", "c"
        ).groupBy(*PAIR, "alts", "alt").agg(F.min(F.struct(F.round("s", 9).alias("near"), "b", "s", "c")).alias("best"))
        sums = best.groupBy(*PAIR, "alts").agg(F.sum("best.s").alias("s"), F.sum("best.c").alias("c"))
    return sums.select(*PAIR, "s", "c")


def choose_readings(rows: DataFrame, depth: int) -> DataFrame:
    """Keep one reading per alias: the lowest sum, the earliest on a tie; innermost aliases first.

    Uses of generics are bound over all readings before this, losing ones included.
    """
    for level in range(depth, 0, -1):
        inner = F.get("alts", F.lit(level - 1))
        rows = rows.withColumn("_alt", inner["alt"]).withColumn("_b", inner["b"]).withColumn(
            "_outer", F.slice("alts", F.lit(1), F.lit(level - 1))
        )
        place = [*PAIR, "_outer", "_alt"]
        cost = F.sum("s").over(Window.partitionBy(*place, "_b"))
        best = F.min(F.struct(F.round("_s", 9), "_b")).over(Window.partitionBy(*place))
        rows = (
            rows.withColumn("_s", cost)
            .withColumn("_best", best)
            .filter(F.col("_alt").isNull() | (F.col("_b") == F.col("_best._b")))
            .drop("_alt", "_b", "_outer", "_s", "_best")
        )
    return rows


def score(s: str = "s", c: str = "c"):
    """Mean of the components in single precision; NULL without components."""
    return F.when(F.col(c) > 0, (F.col(s) / F.col(c)).cast("float"))
