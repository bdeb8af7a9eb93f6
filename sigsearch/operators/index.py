"""An inverted index of signatures: which can be below a threshold for a query text, without aligning them all.

A score is the mean of its components.  Seen from a threshold t, a component s gains t - s or loses s - t, and a pair is
below the threshold only if its gains exceed its losses.  Only parts that agree gain anything: equal primitives, near path
names, the same shape, a generic of the function; each at most t.  Every such agreement is a feature that both sides list:
(slot, position, enclosing kinds, kind and name), with one wildcard for generics.  A pointer step costs a quarter, so it gains
at most t - 1/4.

Whatever the function, each argument or result that a text names gives a component, and one that loses 1 - t (for a path
with a name not near: the least distance that is not near, less t) if its feature is not shared.  So if a pair shares none
of some features P of the text, its gains are at most t for each feature outside P and what names and pointers add, and
its losses at least those of the roots in P.  Where the former do not exceed the latter, all pairs below the threshold share a
feature of P.  The rarest features with that property are looked up (prefix filtering); signatures are listed by their
number of pointers, since these are part of the bound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigsearch.functions.names import letters, may_be_near, name_distance
from sigsearch.operators.align import NEAR, POSITION, query_side
from sigsearch.operators.joins import fits, split_hot_keys

MANY_STEPS = 4  # pointers of a signature from which they are not counted any more
ANY = "any"
ROUNDING = 1e-9  # far below what scores in single precision can tell apart

_OWN = """CASE {kind} WHEN 'prim' THEN concat('prim:', {name}) WHEN 'path' THEN concat('path:', {name})
  WHEN 'generic' THEN '*' WHEN 'arity' THEN 'none' ELSE {kind} END"""


def near_limit(threshold: float) -> float:
    """Distance up to which type names count as near: above the threshold, so that others lose something."""
    return (1 + min(threshold, 1.0)) / 2


def signature_features(sigs: DataFrame) -> DataFrame:
    """(sig_id, steps, feature): what each signature is listed under; ``steps`` are its pointers, or ``MANY_STEPS``.

    Every signature is listed under ``ANY`` as well.
    """
    good = "n -> n.kind IN ('prim', 'path', 'tuple', 'slice', 'generic', 'unit') OR (n.kind = 'arity' AND n.n_children = 0)"
    own = _OWN.format(kind="n.kind", name="n.name")
    feature = f"concat_ws('|', n.slot, n.path, n.spine, {own})"
    return sigs.select(
        "sig_id", F.expr(f"cast(least({MANY_STEPS}, aggregate(nodes, 0, (k, n) -> k + size(n.refs))) AS int)").alias("steps"),
        F.explode(F.expr(f"array_append(array_distinct(transform(filter(nodes, {good}), n -> {feature})), '{ANY}')")).alias("feature"))


def type_names(sigs: DataFrame) -> DataFrame:
    """(name, letters) of all path types."""
    names = sigs.select(F.explode(F.expr("transform(filter(nodes, n -> n.kind = 'path'), n -> n.name)")).alias("name"))
    return names.where("name IS NOT NULL").distinct().withColumn("letters", letters("name"))


def near_type_names(q_nodes: DataFrame, names: DataFrame, threshold: float) -> DataFrame:
    """(q_name, name): for every path type of the texts the type names that are near; both sides are vocabularies."""
    asked = q_nodes.where("q_kind = 'path'").select("q_name").distinct().withColumn("q_letters", letters("q_name"))
    limit = near_limit(threshold)
    length = F.char_length("name")
    # e edits change the length by e at most, and e < limit * the longer one's bytes (four a character at most)
    reach = names.agg(F.max(F.char_length("name"))).first()[0] or 0
    near = asked.withColumn("len", F.explode(F.sequence(F.lit(0), F.lit(reach))))
    pairs = names.withColumn("len", length).join(F.broadcast(near) if fits(near) else near, "len")
    return pairs.where(may_be_near("q_name", "name", "q_letters", "letters", limit)).where(
        name_distance("q_name", "name") < limit + 1e-6).select("q_name", "name")


def text_features(texts: DataFrame, near: DataFrame) -> DataFrame:
    """(text_id, limit, node, root, q_steps, names, kind, feature): what each node of a text can agree with.

    ``near`` has the near type names; ``limit`` is the threshold of the text.  A node without anything to agree with has
    its wildcard only.
    """
    nodes = query_side(texts).where("NOT (q_kind = 'arity' AND q_n <> 0)")
    wants = texts.select("text_id", F.expr("IF(sig.name IS NULL, 0, 1) + size(filter(sig.args, a -> a.arg_name IS NOT NULL))").alias("names"))
    nodes = nodes.join(wants, "text_id").select(
        "text_id", "limit", "q_steps", "names", *POSITION, "q_kind", "q_name", (F.col("path") == "").alias("root"),
        F.concat_ws("|", *POSITION).alias("node"))
    own = F.expr(_OWN.format(kind="q_kind", name="q_name"))
    kept = ["text_id", "limit", "q_steps", "names", "node", "root", F.col("q_kind").alias("kind")]
    at = lambda what: F.concat_ws("|", "node", what).alias("feature")
    plain = nodes.where("q_kind NOT IN ('path', 'generic', 'never')").select(*kept, at(own))
    paths = nodes.where("q_kind = 'path'").join(near, "q_name").select(*kept, at(F.concat(F.lit("path:"), "name")))
    wild = nodes.where("q_kind NOT IN ('unit', 'arity')").select(*kept, at(F.lit("*")))
    return plain.unionByName(paths).unionByName(wild)


def prefixes(features: DataFrame, counts: DataFrame, threshold: float) -> DataFrame:
    """What to look up: (text_id, steps, feature); ``ANY`` where nothing less is enough.

    ``counts`` has (feature, steps, n), the signatures listed under each feature.
    """
    classes = F.explode(F.array(*[F.lit(k) for k in range(MANY_STEPS + 1)]))
    asked = features.withColumn("steps", classes)
    known = counts.join(F.broadcast(features.select("feature").distinct()), "feature", "left_semi")
    key = ["text_id", "steps"]
    nodes = asked.join(known, ["feature", "steps"], "left").groupBy(*key, "limit", "q_steps", "names", "node", "root", "kind").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    loss = F.when(~F.col("root"), 0.0).otherwise(F.when(F.col("kind") == "path", near_limit(threshold)).otherwise(1.0) - F.col("limit"))
    order = Window.partitionBy(*key).orderBy("n", "node")
    whole = Window.partitionBy(*key)
    step = F.greatest(F.col("limit") - NEAR, F.lit(0.0)) * (F.col("q_steps") + F.col("steps"))
    top = F.col("limit") * (F.count(F.lit(1)).over(whole) + F.col("names")) + step
    # what a pair can still gain that shares none of the nodes up to this one
    left = top - F.sum(loss + F.col("limit")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    seen = nodes.withColumns({"left": left, "loss": loss, "last": F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("n"), F.desc("node"))) == 1})
    before = F.col("left") + F.col("loss") + F.col("limit")
    wanted = seen.where(before > ROUNDING).select(*key, "node")
    hopeless = seen.where(F.col("last") & ((F.col("left") > ROUNDING) | (F.col("steps") == MANY_STEPS))).select(*key)
    looked = asked.join(wanted, [*key, "node"]).join(hopeless, key, "left_anti").select(*key, "feature")
    return looked.unionByName(hopeless.withColumn("feature", F.lit(ANY)))


def named_only(texts: DataFrame, features: DataFrame) -> DataFrame:
    """(text_id, steps, feature) of texts that have names, and types without anything to look up."""
    named = texts.where("size(sig.nodes) > 0 AND (sig.name IS NOT NULL OR exists(sig.args, a -> a.arg_name IS NOT NULL))")
    lone = named.select("text_id").join(features.select("text_id").distinct(), "text_id", "left_anti")
    return lone.select("text_id", F.explode(F.array(*[F.lit(k) for k in range(MANY_STEPS + 1)])).alias("steps"), F.lit(ANY).alias("feature"))


def meet(postings: DataFrame, looked: DataFrame, tasks: int) -> DataFrame:
    """(sig_id, text_id): pairs that share a feature looked up, partitioned by signature."""
    found = postings.join(F.broadcast(looked), ["feature", "steps"]) if fits(looked) else split_hot_keys(
        postings, looked, ["feature", "steps"], "sig_id")
    return found.select("sig_id", "text_id").repartition(tasks, "sig_id").distinct()
