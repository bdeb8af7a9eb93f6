"""Name comparison as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def last_segment(name: str | Column) -> Column:
    """``io::Result`` -> ``Result``."""
    return F.substring_index(name, "::", -1)


def name_distance(query: str | Column, item: str | Column) -> Column:
    """Edit distance in characters over the longer name's length in bytes, 0 = equal; null for two empty names."""
    longer = F.greatest(F.octet_length(query), F.octet_length(item))
    return F.try_divide(F.levenshtein(query, item).cast("double"), longer)


def letters(name: str | Column) -> Column:
    """Which of 64 character classes occur in a name, as a bit set.

    One edit adds at most one class and removes at most one, so the number of classes present on one
    side only is a lower bound of the edit distance.
    """
    chars = F.array_distinct(F.split(F.lower(name), ""))
    return F.aggregate(chars, F.lit(0).cast("long"), lambda m, c: m.bitwiseOR(
        F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.ascii(c), F.lit(64)))))


def may_be_near(
    q_name: str, i_name: str, q_letters: str, i_letters: str, threshold: float
) -> Column:
    """Cheap necessary condition of ``name_distance < threshold``; never drops a near pair."""
    allowed = f"{threshold!r}D * greatest(octet_length({q_name}), octet_length({i_name}))"
    # The margin keeps float rounding of the real comparison on the safe side.
    return F.expr(
        f"abs(char_length({q_name}) - char_length({i_name})) <= {allowed} + 1e-3D"
        f" AND bit_count({q_letters} & ~{i_letters}) <= {allowed} + 1e-3D"
        f" AND bit_count({i_letters} & ~{q_letters}) <= {allowed} + 1e-3D"
    )
