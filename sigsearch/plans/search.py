"""Search: a table of queries against a catalogue.

Scores are worked out once per distinct query text and distinct signature; functions come in only
afterwards, and only those that can still be among the results.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigsearch.functions import links
from sigsearch.functions.names import last_segment, letters, may_be_near, name_distance
from sigsearch.operators import align as al
from sigsearch.operators import index as ix
from sigsearch.operators import score as sc
from sigsearch.operators.joins import BROADCAST_BYTES, fits, pieces, settle, split_hot_keys, tasks_for
from sigsearch.operators.name_index import near_by_pieces
from sigsearch.operators.parse import parse_signatures
from sigsearch.operators.scope import Scoped, asked_packages, check_scopes, copied, scope_maps, shared_much
from sigsearch.operators.topk import TIE_BREAK, first_per
from sigsearch.plans.catalog import COMPARED as ITEM
from sigsearch.plans.catalog import FN_KEY, Catalog, Index

THRESHOLD = 0.4
LIMIT = 30
NO_LIMIT = al.NO_LIMIT
SIG_ID_BYTES = 32  # 16 and what a row adds

ASK = ["text_id", "scope"]


TEXTS_PER_TASK = 10_000
TEXT_ID = "unhex(md5(text))"


def prepare(asks: DataFrame) -> DataFrame:
    """Distinct texts, parsed: (text_id, text, sig)."""
    texts = asks.select("text").filter(F.col("text").isNotNull())
    # Parsing costs far more than its bytes suggest, so a long log is spread by rows.
    texts = texts.repartition(tasks_for(asks.sparkSession, asks.count(), TEXTS_PER_TASK), "text").distinct()
    return settle(parse_signatures(texts).withColumn("text_id", F.expr(TEXT_ID)))


def distinct_asks(queries: DataFrame) -> DataFrame:
    """(text_id, text, scope) without the repeats of the query log, which is read once for this."""
    return settle(queries.select("text", "scope").distinct().withColumn("text_id", F.expr(TEXT_ID)))


@dataclass
class Asked:
    """What is known of the queries before any function is looked at."""

    asks: DataFrame  # (text_id, text, scope)
    texts: DataFrame  # (text_id, text, sig)
    parts: list[DataFrame]  # the texts in parts that can be broadcast; nearly always one
    asks_small: bool
    n_texts: int
    plain: bool  # some texts have types but no names
    mixed: bool  # some texts have types and names
    bare: bool  # some texts have a name only


def look_at(queries: DataFrame) -> Asked:
    asks = distinct_asks(queries)
    texts = prepare(asks)
    about = texts.select(
        F.expr("size(sig.nodes) > 0 AND NOT sig.rejected").alias("typed"),
        F.expr("sig.name IS NULL AND NOT exists(sig.args, a -> a.arg_name IS NOT NULL)").alias("unnamed"),
    ).agg(
        F.count("*").alias("n"),
        *[F.coalesce(F.max(F.expr(e)), F.lit(False)).alias(n) for n, e in (
            ("plain", "typed AND unnamed"), ("mixed", "typed AND NOT unnamed"), ("bare", "NOT typed"))],
    ).first()
    return Asked(asks, texts, pieces(texts, "text_id"), fits(asks), about["n"], about["plain"], about["mixed"], about["bare"])


def rejected_queries(queries: DataFrame) -> DataFrame:
    """Queries whose text gives neither a name nor a declaration."""
    bad = parse_signatures(queries.select("text").distinct()).filter("sig.rejected").select("text")
    return queries.join(bad, "text", "left_semi")


def _wants(texts: DataFrame) -> DataFrame:
    """Per text: its name, its named arguments and whether its signature says anything."""
    return texts.filter("NOT sig.rejected").select(
        "text_id", F.col("sig.name").alias("q_name"),
        F.expr("filter(sig.args, a -> a.arg_name IS NOT NULL)").alias("q_args"),
        (F.size("sig.nodes") > 0).alias("typed"),
    )


def _below(s: str, c: str, threshold: float):
    # Single precision on both sides, so that a score of exactly the threshold is no hit.
    return F.expr(f"{c} > 0 AND cast(({s}) / ({c}) AS float) < cast({threshold!r} AS float)")


def signature_scores(
    texts: DataFrame, sigs: DataFrame, alias_depth: int, threshold: float = NO_LIMIT
) -> DataFrame:
    """(text_id, sig_id, s, c): components of the signature alone, for every text with types.

    ``sigs`` comes partitioned by sig_id, and everything up to the sums keeps to that.  Pairs whose
    argument counts alone put them at or above ``threshold`` are left out.  With a column ``text_id``,
    ``sigs`` are the pairs that are wanted.
    """
    nodes = al.query_side(texts)
    plain = sc.pair_sums(al.align(al.item_side(sigs.filter("NOT has_alias")), nodes, threshold))
    if not alias_depth:
        return plain
    aliased = al.align_aliased(al.item_side(sigs.filter("has_alias")), nodes, threshold)
    return plain.unionByName(sc.reading_sums(aliased, alias_depth))


def component_rows(
    texts: DataFrame, sigs: DataFrame, alias_depth: int, threshold: float = NO_LIMIT, only: DataFrame | None = None
) -> DataFrame:
    """Aligned rows of each pair with bindings and readings settled: the score taken apart.

    ``only`` holds the pairs (text_id, sig_id) that are wanted, if not all are.
    """
    rows = al.align_aliased(al.item_side(sigs), al.query_side(texts), threshold)
    if only is not None:
        rows = rows.join(F.broadcast(only) if fits(only) else only, al.PAIR, "left_semi")
    return sc.choose_readings(sc.bound_rows(rows, ["slot", "ord"]), alias_depth)


PAIRS_PER_TASK = 20_000_000


def signatures_of(fns: DataFrame, sigs: DataFrame, n_texts: int) -> DataFrame:
    """The signatures that these functions use, partitioned by sig_id."""
    used = settle(fns.select("sig_id").distinct())
    n_sigs = used.count()
    spark = sigs.sparkSession
    tasks = max(tasks_for(spark, n_sigs), tasks_for(spark, n_sigs * n_texts, PAIRS_PER_TASK))
    if n_sigs * SIG_ID_BYTES <= BROADCAST_BYTES:
        return sigs.join(F.broadcast(used), "sig_id", "left_semi").repartition(tasks, "sig_id")
    return sigs.repartition(tasks, "sig_id").join(used, "sig_id", "left_semi")


def near_names(texts: DataFrame, names: DataFrame, threshold: float, prefilter: bool = True) -> DataFrame:
    """(text_id, name, d): function names whose distance to a query's name is below the threshold.

    Joined on the name's length: a text is listed under every length its near names can have.  Names
    with other than single-byte characters have a length group of their own that every text sees.
    ``texts`` is a piece that fits a broadcast; the names stay in place.
    """
    asked = texts.select("text_id", "q_name").withColumn("q_letters", letters("q_name"))
    if not prefilter:
        lengths = F.array(F.lit(0))
        key = F.lit(0)
    else:
        longest = names.agg(F.max(F.char_length("name"))).first()[0] or 0
        same = 1 - threshold  # share of the longer name that must be left
        low = F.expr(f"greatest(cast(ceil(char_length(q_name) * {max(same, 0.0)!r}D) AS int) - 1, 0)")
        top = F.lit(longest) if same < 1e-3 else F.expr(
            f"least(cast(floor(char_length(q_name) / {same!r}D) AS int) + 1, {longest})")
        lengths = F.array_append(F.when(low <= top, F.sequence(low, top)).otherwise(F.expr("cast(array() AS array<int>)")), F.lit(-1))
        key = F.expr(f"IF(char_length({ITEM}) = octet_length({ITEM}), char_length({ITEM}), -1)")
    asked = asked.withColumn("len", F.explode(lengths))
    if not fits(asked):  # listed under many lengths: the names move as well
        pairs = split_hot_keys(names.withColumn("len", key), asked, ["len"], "name")
    else:
        pairs = names.withColumn("len", key).join(F.broadcast(asked), "len")
    if prefilter:
        pairs = pairs.filter(may_be_near("q_name", ITEM, "q_letters", "letters", threshold))
    return pairs.withColumn("d", name_distance("q_name", last_segment("name"))).filter(
        f"cast(d AS float) < cast({threshold!r} AS float)"
    ).select("text_id", "name", "d")


def _name_parts(pairs: DataFrame) -> DataFrame:
    """Add the components of the function's name and of its arguments' names to ``s`` and ``c``."""
    dist = "levenshtein({0}, {1}) / greatest(octet_length({0}), octet_length({1}))"
    own = dist.format("q_name", ITEM)
    arg = dist.format("a.arg_name", "substring_index(arg_names[a.slot], '::', -1)")
    return pairs.withColumn("_a", F.expr("filter(q_args, a -> a.slot < size(arg_names))")).withColumn(
        "s", F.expr(f"""s + coalesce({own}, 0D) + aggregate(_a, 0D, (n, a) -> n + {arg})""")
    ).withColumn("c", F.expr("c + IF(q_name IS NULL, 0, 1) + size(_a)"))


INDEX_PAIRS = 4_000_000  # pairs of texts and signatures from which looking them up is cheaper than aligning all
NAME_PAIRS = 50_000_000  # pairs of texts and names from which pieces are cheaper than comparing all of near length
PIECES_BELOW = 0.8  # threshold up to which pieces of names are long enough to tell them apart
FIRST_SHARE = 16  # one signature of so many is scored first, to bound what the others must reach


def _wanted(asked: Asked, texts: DataFrame, sigs: DataFrame, index: Index, threshold: float) -> DataFrame:
    """``sigs`` once per text that the index cannot rule out."""
    features = settle(ix.text_features(texts, ix.near_type_names(al.query_side(texts), index.type_names, threshold)))
    looked = settle(ix.prefixes(features, index.counts, threshold).unionByName(ix.named_only(texts, features)))
    tasks = tasks_for(sigs.sparkSession, asked.n_texts * index.n_sigs, PAIRS_PER_TASK)
    return sigs.join(ix.meet(index.postings, looked, tasks), "sig_id")


def typed_pairs(
    asked: Asked, fns: DataFrame, catalog: Catalog, threshold: float, index: Index | None = None, limits: DataFrame | None = None,
) -> DataFrame:
    """Pairs of text and signature that are below the threshold, or would be with equal names.

    With an ``index`` only pairs that it cannot rule out are aligned.  ``limits`` (text_id, limit) are
    thresholds of single texts, not above the common one.
    """
    sigs = signatures_of(fns, catalog.sigs, asked.n_texts)
    if len(asked.parts) > 1 or index is not None:
        sigs = settle(sigs)
    found = []
    for texts in asked.parts:
        if limits is not None:
            texts = texts.join(limits, "text_id", "left")
        elif index is not None:
            texts = texts.withColumn("limit", F.lit(threshold))
        if "limit" in texts.columns:
            texts = settle(texts.withColumn("limit", F.coalesce("limit", F.lit(threshold))))
        some = sigs if index is None else _wanted(asked, texts, sigs, index, threshold)
        pairs = signature_scores(texts, some, catalog.alias_depth, threshold)
        found.append(settle(pairs.join(F.broadcast(_wants(texts)), "text_id").filter(
            _below("s", "c + size(q_args) + IF(q_name IS NULL, 0, 1)", threshold)
        )))
    return reduce(DataFrame.unionByName, found)


def candidates(
    asked: Asked, catalog: Catalog, scopes: DataFrame, threshold: float = THRESHOLD,
    k: int | None = LIMIT, prefilter: bool = True, use_index: bool | None = None,
) -> DataFrame:
    """(text_id, scope, function key, s, c, score) of all pairs below the threshold.

    With ``k``, functions that cannot be among the first ``k`` of any query are left out.  Large searches look pairs up in
    the index of signatures and names in that of their pieces (``use_index`` decides otherwise); with ``k`` they score a share of the signatures first,
    and the k-th best of these bounds what the others must reach.  Where asked scopes share many functions, these are not
    copied per scope: scopes are bitmaps.
    """
    used = asked_packages(scopes, asked.asks)
    scoped = scope_maps(catalog.fns, used) if shared_much(catalog.fns, used) else None
    fns = copied(catalog.fns, used) if scoped is None else scoped.fns
    fns = fns.select(*FN_KEY, "name", "arg_names", "sig_id", "scope" if scoped is None else "number")
    typed = asked.plain or asked.mixed
    use_pieces = prefilter and asked.bare and threshold <= PIECES_BELOW and use_index is not False
    if use_index is None:
        use_pieces = use_pieces and asked.n_texts * catalog.names.count() >= NAME_PAIRS
        use_index = prefilter and typed and threshold < 1 and asked.n_texts * catalog.sigs.count() >= INDEX_PAIRS
    listed = catalog.name_pieces(threshold) if use_pieces else None
    if not (use_index and typed):
        return _candidates(asked, catalog, fns, threshold, k, prefilter, listed=listed, scoped=scoped)
    index = catalog.index()
    if k is None:
        return _candidates(asked, catalog, fns, threshold, k, prefilter, index, listed=listed, scoped=scoped)
    share = F.pmod(F.xxhash64("sig_id"), F.lit(FIRST_SHARE)) == 0
    typed_only = replace(asked, bare=False)
    found = _candidates(typed_only, catalog, fns.filter(share), threshold, k, prefilter, index, scoped=scoped)
    first = settle(first_per(found, ASK, ["score", *TIE_BREAK], k))
    rest = _candidates(
        asked, catalog, fns, threshold, k, prefilter, index, reached(asked, first, threshold, k), F.coalesce(~share, F.lit(True)), listed, scoped)
    return first.unionByName(rest)


def reached(asked: Asked, first: DataFrame, threshold: float, k: int) -> DataFrame:
    """(text_id, limit): per text the k-th best score in the scope where that is worst; the threshold where a scope has fewer.

    A little above the score itself, so that equal ones still count.
    """
    kth = first.groupBy(*ASK).agg(F.count(F.lit(1)).alias("n"), F.max("score").cast("double").alias("worst"))
    enough = F.when(F.col("n") >= k, F.least(F.col("worst") + 1e-6, F.lit(threshold)))
    return settle(asked.asks.select(*ASK).join(kth, ASK, "left").groupBy("text_id").agg(
        F.max(F.coalesce(enough, F.lit(threshold))).alias("limit")))


def _candidates(
    asked: Asked, catalog: Catalog, fns: DataFrame, threshold: float, k: int | None, prefilter: bool,
    index: Index | None = None, limits: DataFrame | None = None, rest: Column | None = None,
    listed: tuple[DataFrame, DataFrame] | None = None, scoped: Scoped | None = None,
) -> DataFrame:
    """``candidates`` of some functions; ``rest`` tells whose types still count, names count for all.

    ``fns`` has a row for each function and scope, or with ``scoped`` for each function.
    """
    out_cols = [*ASK, *FN_KEY, "s", "c"]
    unnamed = "q_name IS NULL AND size(q_args) = 0"
    by_types = fns if rest is None else fns.filter(rest)
    where = "scope" if scoped is None else "number"

    def per_scope(pairs: DataFrame) -> DataFrame:
        asks = asked.asks.select(*ASK)
        return pairs.join(F.broadcast(asks) if asked.asks_small else asks, "text_id")

    def placed(rows: DataFrame, key: str, pairs: DataFrame, k: int | None) -> DataFrame:
        """Functions with the scopes in which ``pairs`` ask for them; ``k`` of each key and scope."""
        wanted = settle(pairs.select(key, "scope").distinct())
        found = wanted.select(key).distinct()
        rows = rows.join(F.broadcast(found) if fits(found) else found, key, "left_semi")
        return scoped.first(rows, key, wanted, k)

    def alike(rows: DataFrame, key: str, pairs: DataFrame) -> DataFrame:
        """All functions with one key score alike, so ``k`` of them in each scope are enough for any query."""
        group = [key, "scope"]
        rows = rows.select(*FN_KEY, key, where)
        if scoped is not None:
            rows = placed(rows, key, pairs, k)
        if k is None:
            return split_hot_keys(rows, pairs, group, "item_id")
        if scoped is None:
            found = settle(pairs.select(key).distinct())
            if fits(found):
                rows = rows.join(F.broadcast(found), key, "left_semi")
            rows = first_per(rows, group, TIE_BREAK, k)
        return split_hot_keys(pairs, rows, group, "text_id")

    parts = []
    if asked.plain or asked.mixed:
        below = per_scope(typed_pairs(asked, by_types, catalog, threshold if prefilter else NO_LIMIT, index, limits))
        if asked.plain:
            parts.append(alike(by_types, "sig_id", below.filter(unnamed)))
        if asked.mixed:
            mixed = below.filter(f"NOT ({unnamed})")
            rows = by_types if scoped is None else placed(by_types, "sig_id", mixed, None)
            parts.append(_name_parts(split_hot_keys(rows, mixed, ["sig_id", "scope"], "item_id")))
    if asked.bare:
        bare = [_wants(texts).filter("NOT typed AND q_name IS NOT NULL") for texts in asked.parts]
        near = [settle(near_names(texts, catalog.names, threshold, prefilter) if listed is None
                       else near_by_pieces(texts, *listed, ITEM, threshold)) for texts in bare]
        near = per_scope(reduce(DataFrame.unionByName, near).withColumnRenamed("d", "s").withColumn("c", F.lit(1).cast("long")))
        parts.append(alike(fns, "name", near))
    if not parts:
        rows = asked.asks.limit(0).select(*ASK)
        parts = [rows.selectExpr("*", *[f"'' AS {c}" for c in FN_KEY], "0D AS s", "0L AS c")]
    result = reduce(DataFrame.unionByName, [p.select(*out_cols) for p in parts])
    return result.filter(_below("s", "c", threshold)).withColumn("score", sc.score())


def search(
    queries: DataFrame, catalog: Catalog, scopes: DataFrame, threshold: float = THRESHOLD,
    k: int | None = LIMIT, prefilter: bool = True, use_index: bool | None = None, strict: DataFrame | None = None,
) -> DataFrame:
    """Hits of every distinct (text, scope): text, scope, rank, score, name, path, link, docs and keys.

    ``queries`` has query_id, text and scope; ``answers`` joins the hits back to it.  Without ``k`` all hits come, in no
    order and with no rank.  With ``strict``, the table of packages that are there, a query whose scope is misspelt, unknown or
    names another package is refused, and so is one whose scope has entries in quarantine.
    """
    asked = look_at(queries)
    if strict is not None:
        wanted = asked.asks.select("scope").distinct()
        check_scopes(wanted.withColumn("query_id", F.col("scope")), scopes, strict)
        check_whole(catalog, scopes.join(wanted, "scope", "left_semi"))
    found = candidates(asked, catalog, scopes, threshold, k, prefilter, use_index)
    if k is None:  # no ranks: they would bring all hits of a query into one task
        best = found.withColumn("rank", F.lit(None).cast("int"))
    else:
        best = first_per(found, ASK, ["score", *TIE_BREAK], k, rank="rank")
    return with_details(best, catalog, asked)


def with_details(hits: DataFrame, catalog: Catalog, asked: Asked) -> DataFrame:
    """Look up names, docs, paths and links; done last, for hits only."""
    hits = settle(hits)
    known = catalog.fns.select(*FN_KEY, "kind", "name", "docs", "base_path", "page", "sig_id")
    texts = asked.texts.select("text_id", "text")
    # Hits are few beside the functions: where they can be sent around, the functions stay in place.
    return (
        known.join(F.broadcast(hits) if fits(hits) else hits, FN_KEY)
        .join(F.broadcast(texts) if len(asked.parts) == 1 else texts, "text_id")
        .select(
            "text", "scope", "rank", "score", "name", links.hit_path().alias("path"),
            links.hit_link().alias("link"), "docs", *FN_KEY, "kind", "text_id", "sig_id", "s", "c",
        )
    )


def answers(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits per row of the query log."""
    wanted = queries.select("query_id", "text", "scope")
    if fits(hits):
        return wanted.join(F.broadcast(hits), ["text", "scope"])
    return split_hot_keys(wanted, hits, ["text", "scope"], "query_id")


def hits_json(hits: DataFrame) -> DataFrame:
    """One JSON text per hit, with absent docs written as null."""
    return hits.select(
        "text", "scope", "rank",
        F.to_json(F.struct("name", "path", "link", "docs"), {"ignoreNullFields": "false"}).alias("hit"),
    )


def check_whole(catalog: Catalog, scopes: DataFrame) -> None:
    """Raise if a package of these scopes has functions that had to be left out of the catalogue."""
    lost = catalog.quarantine.join(scopes.select("crate").distinct(), "crate", "left_semi")
    first = lost.orderBy("crate", "item_id", "impl_id").first()
    if first is not None:
        raise ValueError(f"package {first.crate} has entries in quarantine, such as {first.asDict()}")
