"""Scopes: which packages a query looks at."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigsearch.operators.joins import fits, settle, split_hot_keys
from sigsearch.operators.topk import TIE_BREAK, first_per

BUCKETS = 64  # folders of the functions table, by the hash of the package
COPIES = 50_000_000  # rows of functions and scopes from which functions are not copied; 13 million copies were still quicker
BITS = 32_768  # packages of one bitmap


def list_scopes(scopes: DataFrame) -> DataFrame:
    return scopes.select("scope").distinct()


def scope_problems(queries: DataFrame, scopes: DataFrame, crates: DataFrame) -> DataFrame:
    """(query_id, scope, crate, problem) for scopes that are misspelt, unknown or name unknown packages."""
    parts = F.split("scope", ":")
    good = (F.size(parts) == 2) & parts[0].isin("set", "crate")
    asked = queries.select("query_id", "scope")
    none = F.lit(None).cast("string")
    known = list_scopes(scopes)
    misspelt = asked.filter(~F.coalesce(good, F.lit(False))).select("query_id", "scope", none.alias("crate"), F.lit("misspelt").alias("problem"))
    unknown = asked.filter(good).join(known, "scope", "left_anti").select(
        "query_id", "scope", none.alias("crate"), F.lit("unknown scope").alias("problem")
    )
    missing = scopes.join(crates.select("crate").distinct(), "crate", "left_anti")
    # A log has few scopes, each many times: the problems are found per scope and sent to the log where they fit.
    lacking = missing.join(asked.filter(good).select("scope").distinct(), "scope", "left_semi")
    lost = (asked.join(F.broadcast(lacking), "scope") if fits(lacking) else split_hot_keys(asked, lacking, ["scope"], "query_id")).select(
        "query_id", "scope", "crate", F.lit("unknown crate").alias("problem"))
    return misspelt.unionByName(unknown).unionByName(lost)


def check_scopes(queries: DataFrame, scopes: DataFrame, crates: DataFrame) -> None:
    """Raise for a query whose scope is misspelt, unknown or names a package that is not there."""
    first = scope_problems(queries, scopes, crates).orderBy("query_id", "crate").first()
    if first is not None:
        raise ValueError(f"query {first.query_id}: {first.problem} {first.crate or first.scope}")


def asked_packages(scopes: DataFrame, asked: DataFrame) -> DataFrame:
    """(scope, crate) of the asked scopes."""
    return settle(scopes.join(asked.select("scope").distinct(), "scope", "left_semi").select("scope", "crate").distinct())


def _folders(fns: DataFrame, crates: DataFrame) -> DataFrame:
    """Functions in the folders of these packages; their number is at most that of the folders."""
    if "bucket" not in fns.columns:
        return fns
    wanted = [r.b for r in crates.select(F.pmod(F.hash("crate"), F.lit(BUCKETS)).alias("b")).distinct().collect()]
    return fns.filter(F.col("bucket").isin(wanted)).drop("bucket")


def in_scope(fns: DataFrame, scopes: DataFrame, asked: DataFrame) -> DataFrame:
    """Functions once per asked scope that contains their package."""
    return copied(fns, asked_packages(scopes, asked))


def copied(fns: DataFrame, used: DataFrame) -> DataFrame:
    """Functions once per scope of ``used`` (scope, crate) that contains their package."""
    fns = _folders(fns, used)
    if fits(used):
        return fns.join(F.broadcast(used), "crate")
    return split_hot_keys(fns, used, ["crate"], "item_id")


@dataclass
class Scoped:
    """The functions of the asked scopes, each once, and which packages each scope has.

    Packages are numbered in the order of their names; ``maps`` (scope, bucket, base, bits) has the numbers of a scope as
    bitmaps, cut to the bytes between its first and its last package.  ``fns`` has ``number``.
    """

    fns: DataFrame
    maps: DataFrame

    def first(self, fns: DataFrame, key: str, wanted: DataFrame, k: int | None) -> DataFrame:
        """``fns`` of every wanted (key, scope) with the scope; with ``k`` the first ``k`` of each.

        The packages of a key are listed once, not once per scope.  A scope's bitmap then tells which of them count, and in
        the order of packages the first few that together have ``k`` functions are enough.
        """
        if k is not None:
            fns = settle(first_per(fns, [key, "number"], TIE_BREAK, k))
        bucket = F.floor(F.col("number") / BITS)
        there = fns.groupBy(key, "number").agg(F.count(F.lit(1)).alias("n")).groupBy(key, bucket.alias("map")).agg(
            F.sort_array(F.collect_list(F.struct("number", "n"))).alias("at"))  # at most ``BITS`` packages
        met = split_hot_keys(wanted, there, [key], "scope")
        met = met.join(F.broadcast(self.maps) if fits(self.maps) else self.maps, ["scope", "map"])
        byte = f"conv(hex(substring(bits, cast(a.number % {BITS} div 8 - base + 1 AS int), 1)), 16, 10)"
        met = met.withColumn("at", F.expr(f"filter(at, a -> coalesce(getbit(cast({byte} AS int), cast(a.number % {BITS} % 8 AS int)), 0) = 1)"))
        if k is not None:
            met = met.withColumn("at", F.expr(f"""aggregate(at, named_struct('n', 0L, 'at', cast(array() AS array<struct<number:bigint,n:bigint>>)),
                (s, a) -> IF(s.n >= {k}, s, named_struct('n', s.n + a.n, 'at', array_append(s.at, a)))).at"""))
        spots = met.select(key, "scope", F.explode("at.number").alias("number"))
        rows = split_hot_keys(fns, settle(spots), [key, "number"], "item_id").drop("number")
        return rows if k is None else first_per(rows, [key, "scope"], TIE_BREAK, k)


def scope_maps(fns: DataFrame, used: DataFrame) -> Scoped:
    """``used`` (scope, crate) as bitmaps over numbered packages."""
    order = used.select("crate").distinct().repartitionByRange("crate").sortWithinPartitions("crate")
    # the ids that Spark deals out rise with the partition and within it, so over sorted ranges they keep the order
    numbers = settle(order.withColumn("number", F.monotonically_increasing_id()))
    place = F.col("number") % BITS
    maps = used.join(numbers, "crate").groupBy("scope", F.floor(F.col("number") / BITS).alias("map")).agg(
        F.bitmap_construct_agg(place).alias("bits"), F.floor(F.min(place) / 8).alias("base"), F.floor(F.max(place) / 8).alias("end"))
    maps = maps.withColumn("bits", F.expr("substring(bits, cast(base + 1 AS int), cast(end - base + 1 AS int))")).drop("end")
    fns = _folders(fns, numbers)
    here = fns.join(F.broadcast(numbers), "crate") if fits(numbers) else split_hot_keys(fns, numbers, ["crate"], "item_id")
    return Scoped(here, settle(maps))


def copies(fns: DataFrame, used: DataFrame) -> tuple[int, int]:
    """How many functions the packages of ``used`` have, and how many rows they are once per scope."""
    per_crate = used.groupBy("crate").agg(F.count(F.lit(1)).alias("scopes"))
    sizes = _folders(fns, used).groupBy("crate").agg(F.count(F.lit(1)).alias("n")).join(per_crate, "crate")
    row = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") * F.col("scopes")), F.lit(0))).first()
    return row[0], row[1]


def shared_much(fns: DataFrame, used: DataFrame) -> bool:
    """Whether scopes overlap so much that functions should not be copied."""
    if (used.groupBy("crate").count().agg(F.max("count")).first()[0] or 0) < 2:
        return False  # no package is in two scopes
    single, all_ = copies(fns, used)
    return all_ >= COPIES and all_ > 2 * single
