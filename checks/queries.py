"""The registered queries: each runs one part of the search over data derived from the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigsearch.functions import links
from sigsearch.functions.names import last_segment, letters
from sigsearch.operators import align as al
from sigsearch.operators import score as sc
from sigsearch.operators.joins import settle, shared_folder, split_hot_keys, tasks_for
from sigsearch.operators.name_index import near_by_pieces
from sigsearch.operators.parse import ARITY_SLOT, parse_signatures, query_nodes
from sigsearch.operators.scope import list_scopes, scope_problems
from sigsearch.plans import search as se
from sigsearch.plans.catalog import build_catalog, generic_name, read_name_pieces
from sigsearch.sources.crate_files import bad_sets, file_lines, make_scopes, read_crate_files, read_sets, write_lines
from sigsearch.sources.parts import VOCABULARY_TEXT, part_catalog, part_entries, part_functions, part_sets

# --- fixed values: the texts that are searched for ---------------------------------------------------
TEXTS = (
    "(i32) -> bool",
    "(&str) -> String",
    "(T) -> Option<T>",
    "(Option<Result<T, E>>) -> Result<Option<T>, E>",
    "(Vec<T>, _) -> T",
    "(&mut Vec<u8>) -> ()",
    "(..) -> bool",
    "()",
    "((i32, bool)) -> i32",
    "([u8])",
    "fn blue_bolt",
    "fn red_ring(i32) -> i32",
    "fn (a0: i32, b: _) -> Option<i32>",
    "(&Result<i32, E>, &mut [u8])",
    "fn new_rod(x0: &str) -> String",
)
SCOPES = ("set:all", "set:odd", "crate:brand_12")
# ------------------------------------------------------------------------------------------------------


_BUILT: dict[tuple[str, str], tuple] = {}


def prepared(spark: SparkSession, sf_dir: str):
    """Source tables, catalogue and scopes; built once per application and directory, as an index is."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BUILT:
        tables = part_catalog(spark, sf_dir)
        catalog = build_catalog(tables["items"], tables["paths"])
        _BUILT[key] = tables, catalog, settle(make_scopes(tables["sets"], tables["crates"]))
    return _BUILT[key]


_FILES: dict[tuple[str, str], str] = {}


def _package_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder of package and set files derived from ``part``, some of which cannot be used; written once per directory."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FILES:
        fns = part_functions(spark.read.parquet(f"{sf_dir}/part.parquet"))
        entries = part_entries(fns).filter("source <> 'good'")
        crates = fns.select("crate").distinct().withColumn("num", F.expr("cast(split(crate, '_')[1] AS int)"))
        odd = crates.filter("num IN (24, 44)").selectExpr("crate", "'item' AS source", "'odd' AS id", """'{"name":"x"}' AS text""")
        folder = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
        lines = file_lines(entries.unionByName(odd)).join(F.broadcast(crates), "crate")  # a row per package
        cut = lines.filter("NOT (num % 10 = 5 AND num % 20 < 10 AND part = 5) AND NOT (num % 10 = 5 AND num % 20 >= 10 AND part IN (3, 4))")
        write_lines(cut.withColumn("crate", F.expr("IF(num IN (14, 34), concat('_', crate), crate)")).drop("num"), f"{folder}/crate")
        members = part_sets(crates.select("crate"))
        texts = members.groupBy("set").agg(F.to_json(F.sort_array(F.collect_list("crate"))).alias("line"))  # names of packages only
        broken = spark.sql("""SELECT * FROM VALUES ('holes', '["brand_12",null]'), ('words', 'brand_12'), ('none', '[]') AS t(set, line)""")
        write_lines(texts.unionByName(broken).selectExpr("set AS crate", "0 AS part", "0 AS nth", "line"), f"{folder}/set")
        _FILES[key] = folder
    return _FILES[key]


def file_items(spark, sf_dir):
    """What package files hold, read back from files."""
    tables = read_crate_files(spark, _package_files(spark, sf_dir))
    count = F.count("*").alias("n")
    return tables["items"].groupBy("crate", "kind").agg(count).withColumn("source", F.lit("item")).unionByName(
        tables["paths"].groupBy("crate", "kind").agg(count).withColumn("source", F.lit("path")))


def file_problems(spark, sf_dir):
    """Package and set files that cannot be used, or only in part, with the reason."""
    folder = _package_files(spark, sf_dir)
    return read_crate_files(spark, folder)["bad_files"].selectExpr("crate AS file", "reason").unionByName(
        bad_sets(spark, folder).selectExpr("set AS file", "reason"))


def file_scopes(spark, sf_dir):
    """Scopes made of set files and of the packages there are, usable or not."""
    folder = _package_files(spark, sf_dir)
    return make_scopes(read_sets(spark, folder), read_crate_files(spark, folder)["crates"])


def file_search(spark, sf_dir):
    """Hits in a catalogue that was built from files."""
    folder = _package_files(spark, sf_dir)
    tables = read_crate_files(spark, folder)
    scopes = settle(make_scopes(read_sets(spark, folder), tables["crates"]))
    return _shown(se.search(_texts(spark), build_catalog(tables["items"], tables["paths"]), scopes))


def _texts(spark: SparkSession, scope: str | None = "set:all") -> DataFrame:
    rows = [(i, t, scope or SCOPES[i % len(SCOPES)]) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "query_id int, text string, scope string")


def _score(col: str = "score"):
    return F.round(F.col(col).cast("double"), 6)


def _shown(hits: DataFrame) -> DataFrame:
    return hits.select(
        "text", "scope", "rank", _score().alias("score"), "name", F.concat_ws("/", "path").alias("path"),
        F.concat_ws("/", "link").alias("link"), "docs", "crate", "item_id",
    )


def search_topk(spark, sf_dir):
    _, catalog, scopes = prepared(spark, sf_dir)
    return _shown(se.search(_texts(spark), catalog, scopes))


def scoped_search_topk(spark, sf_dir):
    _, catalog, scopes = prepared(spark, sf_dir)
    return _shown(se.search(_texts(spark, None), catalog, scopes))


def search_all_hits(spark, sf_dir):
    _, catalog, scopes = prepared(spark, sf_dir)
    return se.search(_texts(spark), catalog, scopes, k=None).select("text", "crate", "item_id", _score().alias("score"))


def search_wide_threshold(spark, sf_dir):
    _, catalog, scopes = prepared(spark, sf_dir)
    return _shown(se.search(_texts(spark), catalog, scopes, threshold=0.6, k=5))


def hits_json(spark, sf_dir):
    _, catalog, scopes = prepared(spark, sf_dir)
    return se.hits_json(se.search(_texts(spark), catalog, scopes))


def query_log_answers(spark, sf_dir):
    """The event log read as a query log: most rows repeat a text that was asked before."""
    _, catalog, scopes = prepared(spark, sf_dir)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    texts = F.array(*[F.lit(t) for t in TEXTS])
    log = events.select(
        F.col("event_id").alias("query_id"),
        F.get(texts, (F.col("event_id") % len(TEXTS)).cast("int")).alias("text"),
        F.when(F.col("event_type") == "error", "set:odd").otherwise("set:all").alias("scope"),
    )
    hits = settle(se.search(log, catalog, scopes))
    return se.answers(log, hits).select(
        "query_id", "text", "scope", "rank", "name", "crate", "item_id", _score().alias("score")
    )


def name_search_topk(spark, sf_dir):
    """Every function name without its first letter, as a query."""
    _, catalog, scopes = prepared(spark, sf_dir)
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    asked = part_functions(part).select(F.concat(F.lit("fn "), F.expr("substring(name, 2)")).alias("text")).distinct()
    queries = asked.select(F.col("text").alias("query_id"), "text", F.lit("set:all").alias("scope"))
    return _shown(se.search(queries, catalog, scopes))


def _host_names(spark, sf_dir):
    """Host labels of pages as names of a catalogue and as texts of a search."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    host = F.replace(F.regexp_extract("url", r"//(.*)\.example\.", 1), F.lit("."), F.lit("::"))
    names = settle(pages.select(last_segment(host).alias("name")).distinct().withColumn("letters", letters("name")))
    return names, names.select(F.expr("unhex(md5(name))").alias("text_id"), F.col("name").alias("q_name"))


def _distances(near, texts):
    return near.join(texts, "text_id").select(
        F.col("q_name").alias("query"), "name", F.round("d", 6).alias("distance")
    )


def name_search_urls(spark, sf_dir):
    """Host labels of pages as names: which are near each other."""
    names, texts = _host_names(spark, sf_dir)
    return _distances(se.near_names(texts, names, se.THRESHOLD), texts)


def name_search_pieces(spark, sf_dir):
    """The same through the index of pieces, which is written and read back."""
    names, texts = _host_names(spark, sf_dir)
    listed, classes = read_name_pieces(names, f"{shared_folder(spark)}/pieces-{uuid.uuid4().hex}", se.THRESHOLD)
    return _distances(near_by_pieces(texts, listed, classes, "name", se.THRESHOLD), texts)


def scope_listing(spark, sf_dir):
    return list_scopes(prepared(spark, sf_dir)[2])


def scope_check(spark, sf_dir):
    """Scopes written by a query log: suppliers ask for packages, some misspelt or unknown."""
    tables, _, scopes = prepared(spark, sf_dir)
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    asked = supplier.selectExpr(
        "s_suppkey AS query_id",
        """CASE s_suppkey % 4 WHEN 0 THEN 'set:odd' WHEN 1 THEN concat('crate:brand_', s_nationkey + 5)
           WHEN 2 THEN concat('brand_', s_nationkey) ELSE 'crate:brand_1:x' END AS scope""")
    return scope_problems(asked, scopes, tables["crates"])


def kept_items(spark, sf_dir):
    items = prepared(spark, sf_dir)[0]["items"]
    paths = prepared(spark, sf_dir)[0]["paths"]
    return items.groupBy("crate", "kind").agg(F.count("*").alias("n")).withColumn("source", F.lit("item")).unionByName(
        paths.groupBy("crate", "kind").agg(F.count("*").alias("n")).withColumn("source", F.lit("path"))
    )


def catalog_by_kind(spark, sf_dir):
    fns = prepared(spark, sf_dir)[1].fns
    return fns.groupBy("crate", "kind").agg(
        F.count("*").alias("n"), F.count("docs").alias("n_docs"), F.countDistinct("sig_id", "generics").alias("n_signatures")
    )


def flattened_nodes(spark, sf_dir):
    """Type trees of all functions as rows, ``Self`` replaced and aliases in both readings."""
    catalog = prepared(spark, sf_dir)[1]
    fns = _per_function(spark, sf_dir, catalog.sigs)
    return fns.select("item_id", "generics", F.inline("nodes")).select(
        "item_id", "slot", "path", "spine", F.array_join("refs", " ").alias("refs"), "kind",
        F.expr(f"IF(kind = 'generic', {generic_name('name')}, name)").alias("name"), "n_children",
        F.coalesce(F.expr("filter(hops, h -> h.alt IS NOT NULL)[0].op"), F.lit("-")).alias("reading"),
    )


def hit_links(spark, sf_dir):
    fns = prepared(spark, sf_dir)[1].fns
    return fns.select(
        "crate", "item_id", F.concat_ws("/", links.hit_path()).alias("path"),
        F.concat_ws("/", links.hit_link()).alias("link"),
    )


def dangling_refs(spark, sf_dir):
    return prepared(spark, sf_dir)[1].quarantine


def _signature_texts(spark, sf_dir) -> DataFrame:
    """The declaration of every part's function, as text."""
    fns = part_functions(spark.read.parquet(f"{sf_dir}/part.parquet"))
    n = len(VOCABULARY_TEXT)
    words = "array({})".format(", ".join("'" + t.replace("'", "\\'") + "'" for t in VOCABULARY_TEXT))
    return fns.selectExpr("id AS item_id", f"""concat(
        CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'fn ' ELSE concat('fn ', name) END, '(',
        array_join(transform(filter(sequence(0, 2), k -> k < n_args), k -> concat(
           IF(is_method, concat('a', k, ': '), ''), get({words}, cast((arg0 + 5 * k) % {n} AS int)))), ', '),
        ')', coalesce(concat(' -> ', get({words}, cast(ret AS int))), '')) AS text""").repartition(
        tasks_for(spark, fns.count(), se.TEXTS_PER_TASK)
    )


def signature_nodes(spark, sf_dir):
    parsed = parse_signatures(_signature_texts(spark, sf_dir))
    return query_nodes(parsed, "item_id").select(
        "item_id", "slot", "path", "spine", F.array_join("refs", " ").alias("refs"), "kind", "name", "n_children",
        "canon",
    )


def signature_slots(spark, sf_dir):
    parsed = parse_signatures(_signature_texts(spark, sf_dir))
    return parsed.select(
        "item_id", "text", "sig.name", "sig.has_sig", "sig.n_args", "sig.ret", "sig.unparsed", "sig.rejected",
        F.array_join(F.transform("sig.args", lambda a: F.coalesce(a["arg_name"], F.lit("-"))), ",").alias("arg_names"),
    )


def _aligned(spark, sf_dir) -> DataFrame:
    """Aligned rows of all signatures; ``reading`` tells the readings of an alias apart, ``at`` is the visiting order."""
    _, catalog, _ = prepared(spark, sf_dir)
    texts = se.prepare(_texts(spark))
    nodes = al.query_side(texts)
    plain = al.align(al.item_side(catalog.sigs.filter("NOT has_alias")), nodes)
    aliased = al.align_aliased(al.item_side(catalog.sigs.filter("has_alias")), nodes)
    same = [*al.PAIR, "slot", "path", "s", "c", "generic", "canon", "q_refs", "i_refs", "rest", "k"]
    both = plain.select(*same, F.lit(0).alias("reading"), F.array("seq").alias("at")).unionByName(
        aliased.select(*same, F.coalesce(F.get("alts", F.lit(0))["b"], F.lit(0)).alias("reading"), F.col("ord").alias("at")))
    return both.join(F.broadcast(texts.select("text_id", "text")), "text_id")


def _per_function(spark, sf_dir, pairs: DataFrame) -> DataFrame:
    fns = prepared(spark, sf_dir)[1].fns.select("item_id", "sig_id", "generics")
    return split_hot_keys(fns, pairs, ["sig_id"], "item_id")


def arity_components(spark, sf_dir):
    rows = _aligned(spark, sf_dir).filter(f"slot = {ARITY_SLOT}")
    return _per_function(spark, sf_dir, rows).select("text", "item_id", "s", "c")


def node_components(spark, sf_dir):
    rows = _aligned(spark, sf_dir)
    return (
        _per_function(spark, sf_dir, rows)
        .groupBy("text", "slot", "path", "reading", F.round("s", 6).alias("s"), "c").agg(F.count("*").alias("n"))
    )


def generic_binding(spark, sf_dir):
    rows = _aligned(spark, sf_dir).filter("generic IS NOT NULL")
    bound = sc.bound_rows(rows.withColumn("s", F.lit(0.0)), ["slot", "at"])
    return _per_function(spark, sf_dir, bound).select(
        "text", "item_id", "slot", "path", "reading", F.expr(generic_name("generic")).alias("generic"), "canon", "s")


def ref_peel_cost(spark, sf_dir):
    return _per_function(spark, sf_dir, _aligned(spark, sf_dir)).groupBy(
        F.array_join("q_refs", " ").alias("q_refs"), F.array_join("i_refs", " ").alias("i_refs"),
        F.array_join("rest", " ").alias("rest"), F.col("k").alias("k"),
    ).agg(F.count("*").alias("n"))


def pair_scores(spark, sf_dir):
    _, catalog, _ = prepared(spark, sf_dir)
    texts = se.prepare(_texts(spark))
    pairs = se.signature_scores(texts, catalog.sigs.repartition("sig_id"), catalog.alias_depth)
    pairs = pairs.withColumn("score", sc.score()).join(F.broadcast(texts.select("text_id", "text")), "text_id")
    return _per_function(spark, sf_dir, pairs).select("text", "item_id", _score().alias("score"), "c")


def alias_choice(spark, sf_dir):
    """Which reading of an aliased argument or result was taken: 0 as written, 1 and up expanded."""
    catalog = prepared(spark, sf_dir)[1]
    texts = se.prepare(_texts(spark))
    chosen = se.component_rows(texts, catalog.sigs.filter("has_alias"), max(catalog.alias_depth, 1)).filter("size(alts) > 0")
    chosen = chosen.groupBy(*al.PAIR, "slot").agg(
        F.max(F.col("alts")[0]["b"]).alias("reading"), F.round(F.sum("s"), 6).alias("s"), F.sum("c").alias("c")
    ).join(F.broadcast(texts.select("text_id", "text")), "text_id")
    return _per_function(spark, sf_dir, chosen).select("text", "item_id", "slot", "reading", "s", "c")


def component_list(spark, sf_dir):
    """The scores of all hits taken apart: names first, then node by node in visiting order."""
    _, catalog, scopes = prepared(spark, sf_dir)
    texts = se.prepare(_texts(spark))
    hits = settle(se.search(_texts(spark), catalog, scopes))
    used = catalog.sigs.join(F.broadcast(hits.select("sig_id").distinct()), "sig_id", "left_semi")
    rows = se.component_rows(texts, used, max(catalog.alias_depth, 1), only=hits.select(*al.PAIR).distinct())
    # One list per hit; its length is that of the signature.
    lists = rows.groupBy(*al.PAIR).agg(F.sort_array(F.collect_list(F.struct(
        "slot", "ord", "path", F.round("s", 6).alias("s"), "c"))).alias("parts"))
    shown = F.expr("array_join(transform(parts, p -> concat_ws(':', p.slot, p.path, cast(cast(round(p.s * 1000000) AS bigint) AS string), p.c)), ' ')")
    args = prepared(spark, sf_dir)[1].fns.select(*se.FN_KEY, "arg_names")
    named = hits.select("text_id", "sig_id", "text", "name", "score", *se.FN_KEY).join(args, se.FN_KEY).join(
        F.broadcast(se._wants(texts)), "text_id")
    dist = "levenshtein({0}, {1}) / greatest(octet_length({0}), octet_length({1}))"
    entry = "concat({0}, cast(cast(round(({1}) * 1000000) AS bigint) AS string), ':1')"
    own = F.expr(entry.format("'name::'", dist.format("q_name", se.ITEM)))
    arg = dist.format("a.arg_name", "arg_names[a.slot]")
    arg_list = F.expr(f"""array_join(transform(array_sort(filter(q_args, a -> a.slot < size(arg_names))),
        a -> {entry.format("concat('arg', a.slot, '::')", arg)}), ' ')""")
    whole = F.concat_ws(" ", own, F.when(arg_list != "", arg_list), shown)
    return named.join(lists, al.PAIR, "left").select("text", "crate", "item_id", _score().alias("score"), whole.alias("parts"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        search_topk, scoped_search_topk, search_all_hits, search_wide_threshold, hits_json, query_log_answers,
        name_search_topk, name_search_urls, name_search_pieces, scope_listing, scope_check, file_items, file_problems, file_scopes, file_search,
        kept_items, catalog_by_kind,
        flattened_nodes, hit_links, dangling_refs, signature_nodes, signature_slots, arity_components,
        node_components, generic_binding, ref_peel_cost, pair_scores, alias_choice, component_list,
    )
}
