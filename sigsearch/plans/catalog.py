"""Building the searchable catalogue: one batch job from item texts to written tables."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigsearch.functions import links
from sigsearch.functions.names import last_segment, letters
from sigsearch.operators.flatten import NODE_TYPE, flatten_signature
from sigsearch.operators.index import signature_features, type_names
from sigsearch.operators.name_index import KEYS, classes_of, pieces_of
from sigsearch.operators.joins import by_key, fits, settle, shared_folder, split_hot_keys, tasks_for
from sigsearch.operators.scope import BUCKETS

FN_KEY = ["crate", "item_id", "impl_id"]
ID_IN_TEXT = r'"id":"((?:[^"\\]|\\.)*)"'
ID_SQL = ID_IN_TEXT.replace("\\", "\\\\")


FN_SCHEMA = (
    "crate string, item_id string, impl_id string, kind string, name string, docs string, arg_names array<string>, sig_id binary, generics array<string>,"
    " base_path array<string>, page string, reason string, path_id string, bucket int"
)
SIG_SCHEMA = f"sig_id binary, nodes array<{NODE_TYPE}>, alias_depth int, has_alias boolean"


def bucket(crate: str) -> Column:
    """The folder a package's functions are in."""
    return F.pmod(F.hash(crate), F.lit(BUCKETS))


@dataclass
class Index:
    """Written tables: ``postings`` (feature, steps, sig_id) in the order of features, ``counts`` (feature, steps, n),
    ``type_names`` (name, letters)."""

    postings: DataFrame
    counts: DataFrame
    type_names: DataFrame
    n_sigs: int


def read_index(sigs: DataFrame, directory: str) -> Index:
    """The index of a catalogue, built if it is not there."""
    spark = sigs.sparkSession
    try:
        spark.read.parquet(f"{directory}/type_names")  # written last
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        listed = signature_features(sigs)
        # A posting list may hold a third of all signatures: lists are cut into ranges of signatures.
        order = ["feature", "steps", "sig_id"]
        listed.repartitionByRange(tasks_for(spark, sigs.count(), 50_000), *order).sortWithinPartitions(*order).write.mode(
            "overwrite").parquet(f"{directory}/postings")
        spark.read.parquet(f"{directory}/postings").groupBy("feature", "steps").agg(F.count(F.lit(1)).alias("n")).write.mode(
            "overwrite").parquet(f"{directory}/counts")
        type_names(sigs).write.mode("overwrite").parquet(f"{directory}/type_names")
    tables = [spark.read.parquet(f"{directory}/{t}") for t in ("postings", "counts", "type_names")]
    return Index(*tables, sigs.count())


COMPARED = "substring_index(name, '::', -1)"  # what of a function's name is compared


def read_name_pieces(names: DataFrame, directory: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The names of a catalogue by their pieces, and the lengths there are, for one threshold; built if not there."""
    spark = names.sparkSession
    directory = f"{directory}/{threshold!r}"
    try:
        spark.read.parquet(f"{directory}/classes")  # written last
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        order = [*KEYS, "name"]  # a piece may be in a third of all names: its list is cut into ranges of names
        pieces_of(names, COMPARED, threshold).repartitionByRange(tasks_for(spark, names.count(), 50_000), *order).sortWithinPartitions(
            *order).write.mode("overwrite").parquet(f"{directory}/pieces")
        classes_of(spark.read.parquet(f"{directory}/pieces")).write.mode("overwrite").parquet(f"{directory}/classes")
    return spark.read.parquet(f"{directory}/pieces"), spark.read.parquet(f"{directory}/classes")


@dataclass
class Catalog:
    """Written tables.

    ``fns`` (crate, item_id, impl_id, kind, name, docs, arg_names, sig_id, generics, base_path, page, bucket),
    ``sigs`` (sig_id, nodes with numbered generics, has_alias, alias_depth), ``names`` (name, letters),
    ``quarantine`` (crate, item_id, impl_id, reason, missing_id).
    """

    fns: DataFrame
    sigs: DataFrame
    names: DataFrame
    quarantine: DataFrame
    alias_depth: int
    directory: str = ""
    _index: Index | None = None

    def index(self) -> Index:
        """The index of signatures; written when it is first asked for."""
        if self._index is None:
            self._index = read_index(self.sigs, f"{self.directory}/index")
        return self._index

    def name_pieces(self, threshold: float) -> tuple[DataFrame, DataFrame]:
        """The names by their pieces, and their lengths; written when they are first asked for with this threshold."""
        return read_name_pieces(self.names, f"{self.directory}/name_pieces", threshold)


def impls(items: DataFrame) -> DataFrame:
    """Inherent impls: (crate, impl_id, for_text, members)."""
    body = F.from_json("inner", "trait string, `for` string, items array<string>")
    return (
        items.filter(F.col("kind") == "impl")
        .select("crate", F.col("id").alias("impl_id"), body.alias("b"))
        .filter(F.col("b.trait").isNull())
        .select("crate", "impl_id", F.col("b.for").alias("for_text"), F.col("b.items").alias("members"))
    )


def located_impls(items: DataFrame, paths: DataFrame) -> DataFrame:
    """Impls with the path and the page of their receiver type.

    Looked up per impl, before the members come in: one type may have a large part of all methods.
    """
    body = F.from_json("inner", "name string, id string")
    found = (
        impls(items)
        .withColumn("_for", F.from_json("for_text", "kind string, inner string"))
        .withColumn("for_kind", F.col("_for.kind"))
        .withColumn("inner", F.col("_for.inner"))
        .withColumn("_ref", F.when(F.col("for_kind") == "resolved_path", body))
        .withColumn("for_name", F.when(F.col("for_kind") == "primitive", F.col("inner")).otherwise(F.col("_ref.name")))
        .withColumn("path_id", F.col("_ref.id"))
    )
    summary = paths.select("crate", F.col("id").alias("path_id"), "path", F.col("kind").alias("path_kind"))
    # Primitives, tuples and the like have no path to look up: their impls stay where they are.
    pathless = found.filter(F.col("path_id").isNull())
    for name, kind in (("path", "array<string>"), ("path_kind", "string")):
        pathless = pathless.withColumn(name, F.lit(None).cast(kind))
    looked_up = found.filter(F.col("path_id").isNotNull()).join(by_key(summary), ["crate", "path_id"], "left")
    return looked_up.unionByName(pathless).select(
        "crate", "impl_id", "for_text", "members", "path_id",
        links.receiver_path().alias("base_path"), links.receiver_page().alias("page"),
    )


def members(found_impls: DataFrame, items: DataFrame) -> DataFrame:
    """impl -> member items; ``kind`` is NULL where the member is not there."""
    wanted = found_impls.withColumn("id", F.explode_outer("members")).drop("members").filter("id IS NOT NULL")
    return wanted.join(by_key(items.select("crate", "id", "kind", "name", "docs", "inner")), ["crate", "id"], "left")


def callables(items: DataFrame, paths: DataFrame) -> DataFrame:
    """Free functions and inherent methods, one row each, with their place."""
    fields = ["crate", F.col("id").alias("item_id"), "kind", "name", "docs", "inner"]
    place = ["path_id", "base_path", "page"]
    none = F.lit(None).cast("string")
    own_path = paths.select("crate", "id", F.col("path").alias("base_path"))
    free = (
        items.filter(F.col("kind") == "function").join(by_key(own_path), ["crate", "id"], "left")
        .withColumn("path_id", F.col("id")).withColumn("page", none)
        .select(*fields, F.lit("").alias("impl_id"), none.alias("for_text"), *place)
    )
    methods = members(located_impls(items, paths), items).filter(F.col("kind") == "method")
    return free.unionByName(methods.select(*fields, "impl_id", "for_text", *place))


def _mentions(text: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(ID_IN_TEXT), F.lit(1)))


def alias_reach(items: DataFrame) -> DataFrame | None:
    """(crate, id, dep_id, text): every alias with all aliases its definition leads to, itself included.

    None if the catalogue has no aliases.
    """
    defs = items.filter(F.col("kind") == "typedef").select(
        "crate", "id", F.from_json("inner", "type string")["type"].alias("text")
    )
    defs = settle(defs)
    if defs.isEmpty():
        return None
    targets = defs.select("crate", F.col("id").alias("dep_id"))
    edges = settle(
        defs.select("crate", "id", F.explode(_mentions("text")).alias("dep_id"))
        .join(targets, ["crate", "dep_id"], "left_semi")
    )
    reach = defs.select("crate", "id", F.col("id").alias("dep_id"))
    if not edges.isEmpty():
        # Ways of up to 1, 2, 4, ... steps: a chain of n aliases takes about log n rounds.
        reach, size, before = settle(reach.unionByName(edges).distinct()), 0, -1
        while size != before:
            on = reach.select("crate", F.col("id").alias("dep_id"), F.col("dep_id").alias("next_id"))
            longer = reach.join(on, ["crate", "dep_id"]).select("crate", "id", F.col("next_id").alias("dep_id")).distinct()
            reach, before = settle(longer), size  # each alias reaches itself, so nothing is lost
            size = reach.count()
    return reach.join(defs.select("crate", F.col("id").alias("dep_id"), "text"), ["crate", "dep_id"])


def with_declaration(fns: DataFrame) -> DataFrame:
    """Add argument names, argument types, result type and, where it is named, the receiver's type."""
    decl = F.from_json("inner", "decl struct<inputs: array<array<string>>, output: string>")["decl"]
    return (
        fns.withColumn("_d", decl)
        .withColumns({
            "_inputs": F.coalesce(F.col("_d.inputs"), F.expr("cast(array() AS array<array<string>>)")),
            "_output": F.col("_d.output"),
            "declared": F.col("_d").isNotNull(),
        })
        .withColumns({
            "arg_names": F.expr("transform(_inputs, p -> p[0])"),
            "_types": F.expr("transform(_inputs, p -> p[1])"),
            "_names_self": F.expr("exists(_inputs, p -> contains(p[1], '\"Self\"')) OR coalesce(contains(_output, '\"Self\"'), false)"),
        })
        .withColumn("_self", F.when(F.col("_names_self"), F.col("for_text")))
        .drop("inner", "_d", "_inputs", "_names_self", "for_text")
    )


def with_aliases(fns: DataFrame, reach: DataFrame | None) -> DataFrame:
    """Add ``_aliases``: the definitions a signature can lead to, as sorted (id, text) pairs."""
    none = F.expr("cast(array() AS array<struct<dep_id:string,text:string>>)")
    if reach is None:
        return fns.withColumn("_aliases", none)
    text = F.concat_ws(" ", F.col("_types"), F.col("_output"), F.col("_self"))
    named = fns.select(*FN_KEY, text.alias("_text")).select(*FN_KEY, F.explode_outer(_mentions("_text")).alias("id"))
    key = ["crate", "id"]
    met = named.join(F.broadcast(reach), key) if fits(reach) else split_hot_keys(named, reach, key, "item_id")
    used = met.groupBy(*FN_KEY).agg(
        F.sort_array(F.collect_set(F.struct("dep_id", "text"))).alias("_aliases")
    )
    return fns.join(used, FN_KEY, "left").withColumn("_aliases", F.coalesce("_aliases", none))


RAW = ["_types", "_output", "_self", "_aliases"]


def with_raw_id(fns: DataFrame) -> DataFrame:
    """Add ``raw_id``: equal for functions whose types are spelt alike.

    Ids of types only matter where one of them is an alias; without aliases they are blanked, so that
    packages numbering their items differently still share signatures.
    """
    def blank(text: str) -> str:
        return f"regexp_replace({text}, '{ID_SQL}', '\"id\":\"\"')"

    plain = "size(_aliases) = 0"
    return fns.withColumns({
        "_types": F.expr(f"IF({plain}, transform(_types, t -> {blank('t')}), _types)"),
        "_output": F.expr(f"IF({plain}, {blank('_output')}, _output)"),
        "_self": F.expr(f"IF({plain}, {blank('_self')}, _self)"),
    }).withColumn("raw_id", F.expr(f"unhex(md5(to_json(struct({', '.join(RAW)}))))"))


def _kinds(text: str) -> str:
    return f"coalesce((length({text}) - length(replace({text}, '\"kind\"', ''))) div 6, 0)"


_GENERIC = "n.kind = 'generic' AND n.name IS NOT NULL AND n.name <> 'Self'"  # a ``Self`` that is left is a flaw, not a generic


def generic_name(name: str, generics: str = "generics") -> str:
    """SQL: the name that a function has for a numbered generic."""
    return f"get({generics}, cast(substring({name}, 2) AS int) - 1)"


def flatten_distinct(fns: DataFrame) -> DataFrame:
    """(raw_id, nodes, generics, sig_id): every distinct spelling taken apart once.

    Only which uses of a generic are the same one counts for a score, so the nodes have numbers for the names of generics, in the
    order of first use, and signatures that differ in these names share an id; ``generics`` has the names.
    """
    raw = settle(fns.select("raw_id", F.struct(*RAW).alias("r")).groupBy("raw_id").agg(F.first("r").alias("r")))
    tasks = tasks_for(raw.sparkSession, raw.count(), 20_000)
    texts = "concat(r._types, array(coalesce(r._output, ''), coalesce(r._self, '')), transform(r._aliases, a -> a.text))"
    return (
        raw.repartition(tasks)
        .withColumns({
            "_inputs": F.expr("transform(r._types, t -> try_parse_json(t))"),
            "_output": F.expr("try_parse_json(r._output)"),
            "_self": F.expr("try_parse_json(r._self)"),
            "_aliases": F.map_from_entries("r._aliases"),
            "_rounds": F.expr(f"1 + aggregate({texts}, 0L, (n, t) -> n + {_kinds('t')})"),
        })
        .select("raw_id", flatten_signature().alias("_spelt"))
        .withColumn("generics", F.expr(f"array_distinct(transform(filter(_spelt, n -> {_GENERIC}), n -> n.name))"))
        .withColumn("nodes", F.expr(f"""transform(_spelt, n -> IF({_GENERIC}, cast(named_struct(
            'slot', n.slot, 'ord', n.ord, 'path', n.path, 'spine', n.spine, 'refs', n.refs, 'hops', n.hops, 'kind', n.kind,
            'name', concat('$', array_position(generics, n.name)), 'n_children', n.n_children) AS {NODE_TYPE}), n))"""))
        .withColumn("sig_id", F.expr("unhex(md5(to_json(nodes)))")).drop("_spelt")
    )


# Why a function cannot be listed as a hit; NULL for all others.
_BROKEN = """CASE
  WHEN name IS NULL THEN 'unnamed'
  WHEN NOT declared THEN 'no declaration'
  WHEN flaw IS NOT NULL THEN flaw
  WHEN base_path IS NULL AND path_id IS NOT NULL THEN 'no path'
  WHEN base_path IS NULL THEN 'receiver without a page'
  WHEN kind = 'method' AND page IS NULL THEN 'receiver without a page' END"""
_FLAW = """CASE
  WHEN nodes IS NULL THEN 'alias loop'
  WHEN exists(nodes, n -> n.kind = 'generic' AND n.name = 'Self') THEN 'Self outside of an impl' END"""


def build_catalog(items: DataFrame, paths: DataFrame, directory: str | None = None) -> Catalog:
    """Write the catalogue tables and return them as read back.

    ``items`` and ``paths`` are the staged tables of ``sources.crate_files``.  Without a directory a
    new one in the shared checkpoint folder is used.
    """
    spark = items.sparkSession
    directory = directory or f"{shared_folder(spark)}/catalog-{uuid.uuid4().hex}"
    with_raw_id(with_aliases(with_declaration(callables(items, paths)), alias_reach(items))).write.parquet(
        f"{directory}/declared"
    )
    fns = spark.read.parquet(f"{directory}/declared")

    flatten_distinct(fns).write.parquet(f"{directory}/spellings")
    spellings = spark.read.parquet(f"{directory}/spellings")
    aliased = F.expr("exists(nodes, n -> n.hops IS NOT NULL)")
    depth = F.expr("array_max(transform(nodes, n -> size(filter(coalesce(n.hops, array()), h -> h.alt IS NOT NULL))))")
    (
        spellings.filter(F.col("nodes").isNotNull())
        .groupBy("sig_id").agg(F.first("nodes").alias("nodes"))
        .withColumn("has_alias", aliased).withColumn("alias_depth", depth)
        .write.partitionBy("has_alias").parquet(f"{directory}/sigs")
    )

    # A third of all functions may share one spelling; its row is small, the functions stay in place.
    known = spellings.select("raw_id", "sig_id", "generics", F.expr(_FLAW).alias("flaw"))
    own = fns.drop(*RAW)
    named = own.join(F.broadcast(known), "raw_id") if fits(known) else split_hot_keys(own, known, ["raw_id"], "item_id")
    # A folder per bucket of packages, so that a search reads those of its scope; ranges cut a huge package up.
    order = ["bucket", "crate", "item_id"]
    named.withColumn("reason", F.expr(_BROKEN)).withColumn("bucket", bucket("crate")).select(
        *FN_KEY, "kind", "name", "docs", "arg_names", "sig_id", "generics", "base_path", "page", "reason", "path_id", "bucket"
    ).repartitionByRange(tasks_for(spark, fns.count()), *order).sortWithinPartitions(*order).write.partitionBy(
        "bucket").parquet(f"{directory}/functions")

    functions = spark.read.schema(FN_SCHEMA).parquet(f"{directory}/functions")
    broken = functions.filter(F.col("reason").isNotNull()).select(
        *FN_KEY, "reason", F.when(F.col("reason") == "no path", F.col("path_id")).alias("missing_id")
    )
    lost = members(impls(items), items).filter(F.col("kind").isNull())
    broken.unionByName(
        lost.select("crate", F.lit(None).cast("string").alias("item_id"), "impl_id",
                    F.lit("no member").alias("reason"), F.col("id").alias("missing_id"))
    ).write.parquet(f"{directory}/quarantine")
    functions.filter(F.col("reason").isNull()).select("name").distinct().withColumn(
        "letters", letters(last_segment("name"))
    ).write.parquet(f"{directory}/names")
    return read_catalog(spark, directory)


def read_catalog(spark: SparkSession, directory: str) -> Catalog:
    """A catalogue that was written before."""
    sigs = spark.read.schema(SIG_SCHEMA).parquet(f"{directory}/sigs")
    depth = sigs.filter("has_alias").agg(F.max("alias_depth")).first()[0] or 0
    return Catalog(
        fns=spark.read.schema(FN_SCHEMA).parquet(f"{directory}/functions").filter(F.col("reason").isNull()).drop("reason", "path_id"),
        sigs=sigs,
        names=spark.read.parquet(f"{directory}/names"),
        quarantine=spark.read.parquet(f"{directory}/quarantine"),
        alias_depth=depth,
        directory=directory,
    )
