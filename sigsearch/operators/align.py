"""Aligning the type trees of queries and functions, one row per pair of nodes.

Two nodes meet where slot, position and the kinds of all enclosing types agree.  A row carries the sum
``s`` and the number ``c`` of its score components; a bare generic of the function also carries what it
would stand for, since its score depends on the other uses of the same generic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigsearch.functions.refs import REST_TYPE, as_text, peel, peel_step

# --- fixed values: scores ---------------------------------------------------------------------------
EQUAL, NEAR, DIFFERENT = 0.0, 0.25, 1.0
# ----------------------------------------------------------------------------------------------------

NO_LIMIT = 2.0  # a threshold that no score reaches
POSITION = ["slot", "path", "spine"]
PAIR = ["text_id", "sig_id"]

# Rows in which a pointer chain plays no part and the whole row is one fixed component.
_PLAIN = "i_kind IN ('arity', 'unit', 'nontype') OR q_kind = 'unit'"

# Component sum of the two cores alone, and how many components that is.
_CORE_S = f"""CASE
  WHEN i_kind = 'arity' THEN abs(q_n - i_n) * {DIFFERENT}D
  WHEN i_kind = 'unit' AND q_kind = 'unit' THEN {EQUAL}D
  WHEN {_PLAIN} THEN {DIFFERENT}D
  WHEN i_kind = 'generic' THEN 0D
  WHEN q_kind <> i_kind THEN {DIFFERENT}D
  WHEN q_kind = 'prim' THEN IF(q_name = i_name, {EQUAL}D, {DIFFERENT}D)
  WHEN q_kind = 'tuple' THEN {EQUAL}D + abs(q_n - i_n) * {DIFFERENT}D
  WHEN q_kind = 'slice' THEN {EQUAL}D
  WHEN q_kind = 'path' THEN
    cast(levenshtein(q_name, i_name) AS double) / greatest(octet_length(q_name), octet_length(i_name))
    + IF(i_n IS NULL, coalesce(q_n, 0), 0) * {DIFFERENT}D
  ELSE {DIFFERENT}D END"""
_CORE_C = f"""CASE
  WHEN i_kind = 'arity' THEN IF(q_n = 0 AND i_n = 0, 1, abs(q_n - i_n))
  WHEN {_PLAIN} THEN 1
  WHEN i_kind = 'generic' THEN 0
  WHEN q_kind = 'tuple' AND i_kind = 'tuple' THEN 1 + abs(q_n - i_n)
  WHEN q_kind = 'path' AND i_kind = 'path' THEN 1 + IF(i_n IS NULL, coalesce(q_n, 0), 0)
  ELSE 1 END"""
# Steps of pointer difference: those met on the way in, and the query's left-over ones unless a
# generic takes the whole rest.
_STEPS = f"CASE WHEN {_PLAIN} THEN 0 WHEN i_kind = 'generic' THEN f.k ELSE f.k + size(f.rest) END"


def query_side(texts: DataFrame) -> DataFrame:
    """Node rows of parsed texts.

    ``q_args``, ``q_cores`` and ``q_steps`` describe the whole text: arguments (NULL = any), how many
    components it can have besides those of surplus arguments and pointers, and its pointers; ``limit`` is the
    text's own threshold where it has one.
    """
    limit = F.col("limit") if "limit" in texts.columns else F.lit(NO_LIMIT)
    whole = texts.select(
        "text_id", limit.alias("limit"), F.col("sig.n_args").alias("q_args"),
        F.expr("""size(filter(sig.nodes, n -> n.kind <> 'arity')) + size(filter(sig.args, a -> a.arg_name IS NOT NULL))
                  + IF(sig.name IS NULL, 0, 1)""").alias("q_cores"),
        F.expr("aggregate(sig.nodes, 0, (k, n) -> k + size(n.refs))").alias("q_steps"),
        F.explode("sig.nodes").alias("n"),
    )
    return whole.select(
        "text_id", "limit", "q_args", "q_cores", "q_steps", *[F.col(f"n.{c}").alias(c) for c in POSITION],
        F.col("n.refs").alias("q_refs"), F.col("n.chain").alias("q_chain"), F.col("n.kind").alias("q_kind"),
        F.col("n.name").alias("q_name"), F.col("n.n_children").alias("q_n"), F.col("n.canon").alias("q_canon"),
    )


def item_side(sigs: DataFrame) -> DataFrame:
    """Node rows of signatures; ``seq`` numbers them in visiting order.

    With a column ``text_id`` the rows are those of the signature for that text only.
    """
    key = ["sig_id", *[c for c in ("text_id",) if c in sigs.columns]]
    whole = sigs.select(
        *key, F.expr("nodes[0].n_children").alias("i_args"),
        F.expr("aggregate(nodes, 0, (k, n) -> k + size(n.refs))").alias("i_steps"),
        F.posexplode("nodes").alias("seq", "n"),
    )
    return whole.select(
        *key, "i_args", "i_steps", "seq", *[F.col(f"n.{c}").alias(c) for c in POSITION],
        F.col("n.ord").alias("ord"), F.col("n.refs").alias("i_refs"), F.col("n.hops").alias("i_hops"),
        F.col("n.kind").alias("i_kind"), F.col("n.name").alias("i_name"), F.col("n.n_children").alias("i_n"),
    )


def _meet(i_nodes: DataFrame, q_nodes: DataFrame, threshold: float) -> DataFrame:
    """Pairs of nodes at the same position; the texts are a piece that fits a broadcast.

    Surplus arguments cost 1 each.  At best all else is equal and every pointer on either side adds a
    quarter or nothing, whichever is better; a pair that is not below the threshold even so is left
    out inside the join.
    """
    met = i_nodes.join(F.broadcast(q_nodes), [*POSITION, *[c for c in ("text_id",) if c in i_nodes.columns]])
    if threshold >= NO_LIMIT:
        return met
    surplus = "abs(q_args - i_args)"
    best = f"least({surplus} / ({surplus} + q_cores), ({surplus} + {NEAR}D * (q_steps + i_steps)) / ({surplus} + q_cores + q_steps + i_steps))"
    # The margin keeps rounding on the safe side.
    return met.filter(F.expr(f"coalesce({surplus}, 0) = 0 OR {best} < least({threshold!r}D, limit) + 1e-6D"))


def _scored(rows: DataFrame) -> DataFrame:
    """Add s, c, generic and canon to rows that have the peeling result ``f``."""
    generic = F.expr("i_kind = 'generic' AND q_kind <> 'unit'")
    return rows.withColumn("_steps", F.expr(_STEPS)).withColumns({
        "s": F.expr(f"{_CORE_S} + _steps * {NEAR}D"),
        "c": F.expr(f"cast({_CORE_C} + _steps AS bigint)"),
        "generic": F.when(generic, F.col("i_name")),
        "canon": F.when(generic, F.expr(f"concat({as_text('f.rest')}, q_canon)")),
    })


def align(i_nodes: DataFrame, q_nodes: DataFrame, threshold: float = NO_LIMIT) -> DataFrame:
    """Rows of signatures without aliases."""
    met = _meet(i_nodes, q_nodes, threshold)
    return _scored(met.withColumn("f", F.expr(peel("q_refs", "i_refs")))).select(
        *PAIR, "slot", "path", "seq", "s", "c", "generic", "canon", "q_refs", "i_refs", F.col("f.rest").alias("rest"), F.col("f.k").alias("k"),
    )


# Readings of a chain with aliases.  Where an alias is met with n query pointers left, it is read as
# written (dropping all n), and expanded with 0, 1, .. n of them kept; ``br`` notes the choice (0 = as
# written, j + 1 = expanded with j kept) and takes its place in the visiting order.
_READING = (
    "struct<d:int,rest:array<string>,k:int,br:array<struct<alt:string,b:int>>,ord:array<int>>"
)


def _reading(d: str, rest: str, k: str, br: str, ord_: str) -> str:
    return f"cast(named_struct('d', {d}, 'rest', {rest}, 'k', {k}, 'br', {br}, 'ord', {ord_}) AS {_READING})"


_AT = _reading("h.d", "IF(h.d > r.d, q_chain[h.d], r.rest)", "IF(h.d > r.d, 0, r.k)", "r.br", "r.ord")
_STEP = f"""transform(array({_AT}), r -> CASE h.op
  WHEN 'W' THEN array({_reading('r.d', 'slice(r.rest, 1, 0)', 'r.k + size(r.rest)',
                                "array_append(r.br, named_struct('alt', h.alt, 'b', 0))", 'r.ord')})
  WHEN 'A' THEN transform(sequence(0, size(r.rest)), j -> {_reading(
      'r.d', 'slice(r.rest, size(r.rest) - j + 1, j)', 'r.k + size(r.rest) - j',
      "array_append(r.br, named_struct('alt', h.alt, 'b', j + 1))",
      "concat(slice(r.ord, 1, h.oi), array(j + 1), slice(r.ord, h.oi + 2, greatest(size(r.ord) - h.oi - 1, 0)))")})
  ELSE transform(array({peel_step('r', 'h.op')}), p -> {_reading('r.d', 'p.rest', 'p.k', 'r.br', 'r.ord')})
  END)[0]"""
_START = _reading("-1", "cast(array() AS array<string>)", "0", "cast(array() AS array<struct<alt:string,b:int>>)", "ord")
_READINGS = f"aggregate(i_hops, array({_START}), (rs, h) -> flatten(transform(rs, r -> {_STEP})))"
# A chain whose last steps lie further up starts afresh at the node itself.
_OWN = f"""transform({_READINGS}, r -> IF(r.d < size(q_chain) - 1,
  {_reading('size(q_chain) - 1', 'element_at(q_chain, -1)', '0', 'r.br', 'r.ord')}, r))"""


def align_aliased(i_nodes: DataFrame, q_nodes: DataFrame, threshold: float = NO_LIMIT) -> DataFrame:
    """Rows of signatures with aliases, one per reading; ``alts`` lists the readings taken."""
    met = _meet(i_nodes, q_nodes, threshold)
    plain = f"transform(array({peel('q_refs', 'i_refs')}), p -> {_reading('0', 'p.rest', 'p.k', 'NULL', 'ord')})"
    rows = met.withColumn("r", F.explode_outer(F.expr(f"IF(i_hops IS NULL, {plain}, {_OWN})")))
    rows = rows.withColumn("f", F.expr(f"cast(named_struct('rest', r.rest, 'k', r.k) AS {REST_TYPE})"))
    return _scored(rows).select(
        *PAIR, "slot", "path", F.col("r.ord").alias("ord"), "s", "c", "generic", "canon", "q_refs", "i_refs",
        F.col("f.rest").alias("rest"), F.col("f.k").alias("k"),
        F.coalesce(F.col("r.br"), F.expr("cast(array() AS array<struct<alt:string,b:int>>)")).alias("alts"),
    )
