"""An index of names by their pieces: near names meet by a shared piece instead of by their length alone.

Two names are near if their edit distance, in characters, over the longer one's bytes is below a threshold, so the longer
one (in bytes) says how many edits e are allowed.  It is cut into e + 1 pieces; of e edits one piece at least is left whole,
and stands in the other name.  Moreover there is a piece i, counted from 0, that is whole with at most i edits before and
at most e - i behind it (the first i for which the pieces up to it hold at most i edits).  So it is looked for only where
it has moved by at most i places and the rest still fits the other's length.

Every name is listed under its own pieces (way ``cut``), for queries that are not longer; under its parts of the sizes
that the pieces of longer queries have (``part``); and once as it is (``whole``).  The latter serves names with so many bytes
a character that they have more edits than characters, and longer queries with characters of several bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigsearch.functions.names import letters, may_be_near, name_distance
from sigsearch.operators.joins import fits, split_hot_keys

KEYS = ["chars", "bytes", "way", "place", "piece"]
ENTRY = "struct<way:string,place:int,piece:string>"


def _edits(length: str, threshold: float) -> str:
    """The most edits that are below the threshold for a longer name of so many bytes, as the comparison rounds them."""
    most = f"cast(ceil({threshold!r}D * {length}) AS int)"
    near = f"cast(cast({most} AS double) / {length} AS float) < cast({threshold!r} AS float)"
    return f"IF({length} = 0, 0, IF({near}, {most}, {most} - 1))"


def _start(i: str, length: str, parts: str) -> str:
    return f"cast(({i}) * {length} div ({parts}) AS int)"


def pieces_of(names: DataFrame, item: str, threshold: float) -> DataFrame:
    """(chars, bytes, way, place, piece) and the columns of ``names``: what each name is listed under.

    ``item`` is an expression for the part of a name that is compared, ``threshold`` below 1.
    """
    rows = names.withColumns({"_item": F.expr(item)}).withColumns({
        "chars": F.char_length("_item"), "bytes": F.octet_length("_item")}).withColumn("_e", F.expr(_edits("bytes", threshold)))
    start, end = _start("i", "chars", "_e + 1"), _start("i + 1", "chars", "_e + 1")
    cut = f"""IF(_e < chars, transform(sequence(0, _e), i -> struct('cut' AS way, i AS place,
        substring(_item, {start} + 1, {end} - {start}) AS piece)), cast(array() AS array<{ENTRY}>))"""
    # single-byte queries that are longer and near enough in length, and the sizes of their pieces
    top = f"cast(floor(chars / {1 - threshold!r}D) AS int) + 1"
    longer = f"IF({top} > bytes, filter(sequence(bytes + 1, {top}), m -> m - chars <= {_edits('m', threshold)}), cast(array() AS array<int>))"
    parts = f"({_edits('m', threshold)} + 1)"
    sizes = f"array_distinct(flatten(transform({longer}, m -> array(cast(m div {parts} AS int), cast((m + {parts} - 1) div {parts} AS int)))))"
    part = f"""flatten(transform(filter({sizes}, z -> z BETWEEN 1 AND chars), z -> transform(sequence(0, chars - z), p ->
        struct('part' AS way, p AS place, substring(_item, p + 1, z) AS piece))))"""
    whole = "array(struct('whole' AS way, 0 AS place, '' AS piece))"
    entries = F.expr(f"concat(cast({cut} AS array<{ENTRY}>), cast({part} AS array<{ENTRY}>), cast({whole} AS array<{ENTRY}>))")
    return rows.where("_item IS NOT NULL").withColumn("_k", F.explode(entries)).select("chars", "bytes", "_k.*", *names.columns)


def classes_of(listed: DataFrame) -> DataFrame:
    """(chars, bytes, len) of the names there are; ``len`` is -1 where characters have several bytes."""
    return listed.where("way = 'whole'").select("chars", "bytes").distinct().withColumn(
        "len", F.expr("IF(chars = bytes, chars, -1)"))


def probes(asked: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(chars, bytes, way, place, piece) and the columns of ``asked``: where each ``q_name`` has to be looked for."""
    longest = classes.agg(F.max("len")).first()[0] or 0
    rows = asked.where("q_name IS NOT NULL").withColumns({"_m": F.char_length("q_name"), "_mb": F.octet_length("q_name")})
    low = f"greatest(cast(floor(_m - {threshold!r}D * _mb) AS int) - 1, 0)"
    # compared as numbers before the cast: a threshold near 1 makes the first one huge
    high = f"cast(least(greatest(_m / {1 - threshold!r}D, _m + {threshold!r}D * _mb) + 1, {float(longest)!r}D) AS int)"
    lengths = f"IF({low} <= {high}, sequence({low}, {high}), cast(array() AS array<int>))"
    rows = rows.withColumn("len", F.explode(F.expr(f"array_append({lengths}, -1)"))).join(F.broadcast(classes) if fits(classes) else classes, "len")
    rows = rows.withColumn("_e", F.expr(_edits("greatest(bytes, _mb)", threshold))).where("abs(chars - _m) <= _e")

    def looked(way: str, own: str, other: str) -> str:
        """Entries of way ``way``: the cut name has ``own`` characters, the other one ``other``."""
        start, end = _start("i", own, "_e + 1"), _start("i + 1", own, "_e + 1")
        gap = f"({other} - {own})"
        # how far piece i may have moved
        a, b = f"greatest(-i, {gap} - (_e - i))", f"least(i, {gap} + (_e - i))"
        spans = f"transform(sequence(0, _e), i -> struct(i AS i, {start} AS p, {end} - {start} AS z, {a} AS a, {b} AS b))"
        inside = f"o >= 0 AND o + x.z <= {other}"
        entry = {
            "cut": "struct('cut' AS way, x.i AS place, substring(q_name, o + 1, x.z) AS piece)",
            "part": "struct('part' AS way, o AS place, substring(q_name, x.p + 1, x.z) AS piece)",
        }[way]
        return f"""flatten(transform(filter({spans}, x -> x.a <= x.b), x -> transform(filter(
            transform(sequence(x.a, x.b), s -> x.p + s), o -> {inside}), o -> {entry})))"""

    whole = f"cast(array(struct('whole' AS way, 0 AS place, '' AS piece)) AS array<{ENTRY}>)"
    entries = f"""CASE WHEN bytes >= _mb AND _e < chars THEN cast({looked('cut', 'chars', '_m')} AS array<{ENTRY}>)
        WHEN bytes < _mb AND _m = _mb THEN cast({looked('part', '_m', 'chars')} AS array<{ENTRY}>) ELSE {whole} END"""
    return rows.withColumn("_k", F.explode(F.array_distinct(F.expr(entries)))).select("chars", "bytes", "_k.*", *asked.columns)


def meeting(asked: DataFrame, listed: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Rows of ``listed`` and ``asked`` that share an entry; a pair comes once for each entry it shares."""
    wanted = probes(asked, classes, threshold)
    if fits(wanted):  # the names stay where they are, however many of them share a piece
        return listed.join(F.broadcast(wanted), KEYS)
    return split_hot_keys(listed, wanted, KEYS, "name")


def near_by_pieces(texts: DataFrame, listed: DataFrame, classes: DataFrame, item: str, threshold: float) -> DataFrame:
    """(text_id, name, d): names whose distance to a query's name is below the threshold."""
    asked = texts.select("text_id", "q_name").withColumn("q_letters", letters("q_name"))
    pairs = meeting(asked, listed, classes, threshold).where(may_be_near("q_name", item, "q_letters", "letters", threshold))
    return pairs.withColumn("d", name_distance("q_name", F.expr(item))).where(
        f"cast(d AS float) < cast({threshold!r} AS float)").select("text_id", "name", "d").distinct()
