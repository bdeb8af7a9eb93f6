"""A catalogue derived from the ``part`` table: one function or method per part.

There are no documentation files among the given tables, so this derives item and path texts in the
documented spelling from ``part`` with integer arithmetic, and everything after that is the ordinary
catalogue build.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigsearch.sources.crate_files import stage


def _prim(name: str) -> str:
    return f'{{"kind":"primitive","inner":"{name}"}}'


def _generic(name: str) -> str:
    return f'{{"kind":"generic","inner":"{name}"}}'


def _path(name: str, *args: str, id: str | None = None) -> str:
    inner = ",".join(f'{{"type":{a}}}' if a.startswith('{"kind"') else a for a in args)
    angle = f'{{"angle_bracketed":{{"args":[{inner}],"bindings":[]}}}}' if args else "null"
    return f'{{"kind":"resolved_path","inner":{{"name":"{name}","id":"{id or "ty:" + name}","args":{angle},"param_names":[]}}}}'


def _ref(type_: str, mutable: bool = False) -> str:
    return f'{{"kind":"borrowed_ref","inner":{{"lifetime":null,"mutable":{str(mutable).lower()},"type":{type_}}}}}'


def _ptr(type_: str) -> str:
    return f'{{"kind":"raw_pointer","inner":{{"mutable":false,"type":{type_}}}}}'


def _tuple(*types: str) -> str:
    return f'{{"kind":"tuple","inner":[{",".join(types)}]}}'


def _slice(type_: str) -> str:
    return f'{{"kind":"slice","inner":{type_}}}'


def _array(type_: str) -> str:
    return f'{{"kind":"array","inner":{{"type":{type_},"len":"4"}}}}'


_T, _E = _generic("T"), _generic("E")
ALIAS_ID = "alias:io"
# Argument and return types by number.
VOCABULARY = (
    _prim("i32"),
    _ref(_prim("str")),
    _prim("bool"),
    _path("String"),
    _path("Vec", _T),
    _path("Option", _T),
    _path("Option", _prim("i32")),
    _path("Result", _T, _E),
    _path("Option", _path("Result", _T, _E)),
    _path("Result", _path("Option", _T), _E),
    _ref(_path("Vec", _prim("u8")), mutable=True),
    _ref(_slice(_prim("u8"))),
    _tuple(_prim("i32"), _prim("bool")),
    _T,
    _path("HashMap", _generic("K"), _generic("V")),
    _ptr(_prim("u8")),
    _path("io::Result", _T, id=ALIAS_ID),
    _ref(_path("io::Result", _T, id=ALIAS_ID)),
    _array(_prim("u8")),
    _path("Cow", '{"lifetime":"\'a"}', _prim("str")),
)
# The same types the way they are written in a declaration.
VOCABULARY_TEXT = (
    "i32", "&str", "bool", "String", "Vec<T>", "Option<T>", "Option<i32>", "Result<T, E>",
    "Option<Result<T, E>>", "Result<Option<T>, E>", "&mut Vec<u8>", "&[u8]", "(i32, bool)", "T",
    "HashMap<K, V>", "*const u8", "io::Result<T>", "&io::Result<T>", "[u8; 4]", "Cow<'a, str>",
)
ALIAS_TARGET = _path("Result", _T, _path("Error"))
# Receiver types of inherent impls by number; the three paths are a struct, an enum and a union.
RECEIVERS = (
    _path("Widget"),
    _path("Shape", _T),
    _path("Bits"),
    _prim("i32"),
    _tuple(_prim("i32"), _prim("bool")),
    _slice(_prim("u8")),
    _array(_prim("u8")),
    _ptr(_prim("u8")),
    _ref(_prim("str")),
)
SELF_TYPES = (_generic("Self"), _ref(_generic("Self")))


def _pick(texts: tuple[str, ...], number: str) -> str:
    return "get(array({}), cast({} AS int))".format(
        ", ".join("'" + t.replace("'", "\\'") + "'" for t in texts), number
    )


def part_functions(part: DataFrame) -> DataFrame:
    """The numbers each part stands for."""
    n = len(VOCABULARY)
    return part.selectExpr(
        "p_partkey",
        "cast(p_partkey AS string) AS id",
        "replace(lower(p_brand), '#', '_') AS crate",
        "replace(p_name, ' ', '_') AS name",
        "p_partkey % 5 = 0 AS is_method",
        "cast(p_size % 4 AS int) AS n_args",
        f"(p_partkey * 7 + p_size) % {n} AS arg0",
        f"CASE WHEN p_type <> 'PROMO' THEN (p_partkey * 3 + p_size) % {n} END AS ret",
        "CASE WHEN p_partkey % 3 <> 0 THEN p_type END AS docs",
        "p_partkey div 50 AS block",
    )


def _items(fns: DataFrame) -> DataFrame:
    n = len(VOCABULARY)
    arg = f"""IF(k = 0 AND is_method, {_pick(SELF_TYPES, 'p_partkey div 5 % 2')},
                 {_pick(VOCABULARY, f'(arg0 + 5 * k) % {n}')})"""
    item = f"""concat('{{"id":"', id, '","name":"', name, '","docs":', coalesce(concat('"', docs, '"'), 'null'),
      ',"kind":"', IF(is_method, 'method', 'function'), '","inner":{{"decl":{{"inputs":[',
      array_join(transform(filter(sequence(0, 2), k -> k < n_args), k -> concat('["a', k, '",', {arg}, ']')), ','),
      '],"output":', coalesce({_pick(VOCABULARY, 'ret')}, 'null'), ',"c_variadic":false}}}}}}')"""
    own = fns.selectExpr("crate", "id", f"{item} AS item")
    # Fifty neighbouring parts share an impl, so a member list has at most ten entries.
    blocks = fns.filter("is_method").groupBy("crate", "block").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    impl = f"""concat('{{"id":"impl:', block, '","name":null,"docs":null,"kind":"impl","inner":{{"trait":',
      IF(block % 10 = 9, '{_path("Display")}', 'null'), ',"for":',
      coalesce({_pick(RECEIVERS, 'block % 10')}, '{RECEIVERS[0]}'),
      ',"items":["', array_join(ids, '","'), IF(block % 11 = 0, concat('","gone:', block), ''), '"]}}}}')"""
    impls = blocks.selectExpr("crate", "concat('impl:', block) AS id", f"{impl} AS item")
    alias = f"""'{{"id":"{ALIAS_ID}","name":"Result","docs":null,"kind":"typedef","inner":{{"type":{ALIAS_TARGET}}}}}'"""
    aliases = fns.select("crate").distinct().selectExpr("crate", f"'{ALIAS_ID}' AS id", f"{alias} AS item")
    return own.unionByName(impls).unionByName(aliases)


def _paths(fns: DataFrame) -> DataFrame:
    # Every 97th function has a summary of a kind that is not kept.
    own = fns.filter("NOT is_method").selectExpr(
        "crate", "id",
        """concat('{"path":["', crate, '","', name, '"],"kind":"', IF(p_partkey % 97 = 0, 'macro', 'function'), '"}') AS summary""")
    types = fns.select("crate").distinct().selectExpr(
        "crate", "stack(3, 'Widget', 'struct', 'Shape', 'enum', 'Bits', 'union') AS (t, k)"
    ).selectExpr(
        "crate", "concat('ty:', t) AS id",
        """concat('{"path":["', crate, '","types","', t, '"],"kind":"', k, '"}') AS summary""")
    return own.unionByName(types)


def part_entries(fns: DataFrame) -> DataFrame:
    """Item and path texts, as they come out of documentation files."""
    items = _items(fns).selectExpr("crate", "'item' AS source", "id", "item AS text")
    paths = _paths(fns).selectExpr("crate", "'path' AS source", "id", "summary AS text")
    files = fns.select("crate").distinct().selectExpr(
        "crate", "'good' AS source", "cast(NULL AS string) AS id", "cast(NULL AS string) AS text")
    return items.unionByName(paths).unionByName(files)


def part_catalog(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Tables ``items``, ``paths``, ``bad_files``, ``crates`` and ``sets`` derived from ``part``."""
    fns = part_functions(spark.read.parquet(f"{sf_dir}/part.parquet"))
    tables = stage(part_entries(fns))
    return {**tables, "sets": part_sets(tables["crates"])}


def part_sets(crates: DataFrame) -> DataFrame:
    """(set, crate): all packages, and those of odd number; the latter also names a package that does not exist."""
    return crates.selectExpr("explode(array('all', 'odd')) AS set", "crate").filter(
        "set = 'all' OR cast(split(crate, '_')[1] AS int) % 2 = 1"
    ).unionByName(crates.agg(F.count("*").alias("n")).selectExpr("'odd' AS set", "concat('brand_', n + 75) AS crate"))
