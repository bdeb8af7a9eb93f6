"""Signature text -> query rows, as one expression per row (no shuffle, no Python).

``parse_signatures`` turns a column of texts such as ``fn f(&str, _) -> Option<T>`` into a struct
holding the name, the argument slots and the nodes of every type tree.  The text is cut into tokens
with a regular expression and the tokens are folded with ``aggregate``; the fold state keeps the open
brackets and the child position below each of them, so every type lands on the position that the
catalogue side uses for its join keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values -------------------------------------------------------------------------------
RET_SLOT = 1_000_000  # slot number of the return type; arguments are 0, 1, 2, ...
ARITY_SLOT = -1  # slot number of the argument-count row

PRIMITIVES = (
    "isize", "i8", "i16", "i32", "i64", "i128",
    "usize", "u8", "u16", "u32", "u64", "u128",
    "f32", "f64", "char", "bool", "str",
)

HEAD = r"^\s*(?:fn(?![A-Za-z0-9_]))?\s*([A-Za-z_][A-Za-z0-9_]*)?"
TOKEN = (
    r"(?s)->\s*\(\)|->|\.\.|\*mut|\*const|&mut|[A-Za-z_][A-Za-z0-9_]*|\s+|."
)
# ------------------------------------------------------------------------------------------------

ARGUMENTS = r"(?s)^.*?\)(?=\s*->)"

NODE_TYPE = (
    "struct<slot:int,path:string,spine:string,chain:array<array<string>>,"
    "kind:string,name:string,t0:int,t1:int,p1:int>"
)
CLOSE_TYPE = "struct<slot:int,path:string,n:int,t1:int>"
ARG_TYPE = "struct<slot:int,arg_name:string,wild:boolean>"


def _sql_text(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _tokens(text: str) -> str:
    """Token structs: text, class, next token's text."""
    prims = ", ".join(f"'{p}'" for p in PRIMITIVES)
    raw = f"regexp_extract_all({text}, {_sql_text(TOKEN)}, 0)"
    return f"""
    transform(array({raw}), ts -> transform(ts, (v, i) -> named_struct(
      'v', v,
      'nx', get(ts, i + 1),
      'c', CASE
        WHEN v IN ('(', ')', '[', ']', '<', '>', ',', ':', '!', '->', '..') THEN v
        WHEN v IN ('&', '&mut', '*const', '*mut') THEN 'ref'
        WHEN v IN ({prims}) THEN 'prim'
        WHEN v = '_' THEN '_'
        WHEN left(v, 1) BETWEEN 'A' AND 'Z' THEN CASE
            WHEN v RLIKE '^[A-Z]+$' THEN 'generic'
            WHEN v RLIKE '^[A-Z]+[0-9_]' THEN 'generic+'
            ELSE 'path' END
        WHEN left(v, 1) BETWEEN 'a' AND 'z' THEN 'path'
        WHEN left(v, 1) = '_' THEN '_x'
        WHEN left(v, 2) = '->' THEN '->()'
        WHEN v RLIKE '^[ \\t\\r\\n\\x0b\\f]' THEN 'blank'
        ELSE v END)))[0]
    """


# What a token means in the present state ``a``.  Modes: start, open (just after a bracket), elem
# (an element must follow), named (a colon must follow), typed (after the colon), ref (a type must
# follow), path (a path name was read), done (an element is complete), tail (after the arguments).
_ACTION = """
CASE
  WHEN a.m IN ('bad', 'end') THEN 'stop'
  WHEN a.m = 'start' THEN IF(t.c = '(', 'args', 'bad')
  WHEN a.m = 'tail' THEN CASE t.c
      WHEN 'blank' THEN 'keep' WHEN '->()' THEN 'unit' WHEN '->' THEN 'output' ELSE 'end' END
  WHEN a.m = 'named' THEN IF(t.c = ':', 'colon', 'bad')
  WHEN a.m = 'path' AND t.c = '<' THEN 'open<'
  WHEN a.m IN ('path', 'done') AND a.st = 'O' THEN 'end'
  WHEN a.m IN ('path', 'done') THEN CASE
      WHEN t.c = ',' AND right(a.st, 1) <> '[' THEN 'next'
      WHEN t.c = translate(right(a.st, 1), 'A([<', '))]>') THEN 'close'
      ELSE 'bad' END
  WHEN t.c = 'blank' THEN 'blank'
  WHEN a.m IN ('open', 'elem') AND a.st = 'A' AND t.nx = ':'
       AND t.c IN ('prim', 'generic', 'generic+', 'path', '_') THEN 'name'
  WHEN a.m IN ('open', 'elem') AND a.st = 'A' AND t.c = ':' THEN 'colon'
  WHEN a.m = 'open' AND a.st = 'A' AND t.c = '..' THEN IF(t.nx = ')', 'any', 'bad')
  WHEN t.c IN ('_', '_x') AND (a.m = 'ref' OR (a.m = 'elem' AND right(a.st, 1) = '[')) THEN 'path'
  WHEN t.c = '_' THEN 'wild'
  WHEN t.c IN ('prim', 'generic', '!') THEN 'leaf'
  WHEN t.c = 'generic+' THEN IF(a.st = 'O', 'leaf!', 'bad')
  WHEN t.c = 'path' THEN 'path'
  WHEN t.c = '(' THEN 'open('
  WHEN t.c = '[' THEN 'open['
  WHEN t.c = 'ref' THEN 'ref'
  WHEN a.m = 'typed' AND t.c = ',' THEN 'next'
  WHEN a.m = 'typed' AND t.c = ')' THEN 'close'
  WHEN a.m IN ('open', 'elem') AND right(a.st, 1) = '<' AND t.c = ',' THEN 'next_'
  WHEN a.m IN ('open', 'elem') AND right(a.st, 1) = '<' AND t.c = '>' THEN 'close_'
  WHEN a.m = 'open' AND right(a.st, 1) IN ('A', '(') AND t.c = ')' THEN 'close0'
  ELSE 'bad'
END
"""

_REF_CODE = "CASE t.v WHEN '&' THEN '&' WHEN '&mut' THEN '&m' WHEN '*const' THEN '*c' ELSE '*m' END"

_NEW_NODE = f"""cast(named_struct(
  'slot', a.ix[0],
  'path', array_join(slice(a.ix, 2, size(a.ix)), '.'),
  'spine', array_join(a.sp, '.'),
  'chain', array_append(a.rs, a.rf),
  'kind', CASE WHEN x IN ('leaf', 'leaf!') AND t.c <> 'prim' AND t.c <> '!' THEN 'generic'
               WHEN x = 'leaf' AND t.c = 'prim' THEN 'prim' WHEN x = 'leaf' THEN 'never'
               WHEN x = 'open(' THEN 'tuple' WHEN x = 'open[' THEN 'slice' ELSE 'path' END,
  'name', CASE WHEN x = 'leaf!' THEN regexp_extract(t.v, '^[A-Z]+', 0)
               WHEN x IN ('open(', 'open[') OR t.c = '!' THEN NULL ELSE t.v END,
  't0', length(a.txt),
  't1', CASE WHEN x = 'leaf!' THEN length(a.txt) + length(regexp_extract(t.v, '^[A-Z]+', 0))
             WHEN x IN ('leaf', 'path') THEN length(a.txt) + length(t.v) END,
  'p1', a.pos + length(t.v)) AS {NODE_TYPE})"""

_NEXT = f"""named_struct(
  'm', CASE
     WHEN x IN ('stop', 'keep') THEN a.m
     WHEN x IN ('bad', 'end') THEN x
     WHEN x IN ('args', 'open<', 'open(', 'open[') THEN 'open'
     WHEN x IN ('unit', 'leaf!') THEN 'end'
     WHEN x IN ('output', 'ref') THEN 'ref'
     WHEN x = 'blank' THEN IF(a.m = 'open', 'elem', a.m)
     WHEN x = 'name' THEN 'named'
     WHEN x = 'colon' THEN 'typed'
     WHEN x = 'path' THEN 'path'
     WHEN x IN ('next', 'next_') THEN 'elem'
     WHEN x IN ('close', 'close_', 'close0') AND a.st = 'A' THEN 'tail'
     ELSE 'done' END,
  'st', CASE
     WHEN x = 'args' THEN 'A'
     WHEN x = 'output' THEN 'O'
     WHEN x IN ('open<', 'open(', 'open[') THEN concat(a.st, right(x, 1))
     WHEN x IN ('close', 'close_', 'close0') THEN left(a.st, length(a.st) - 1)
     ELSE a.st END,
  'ix', CASE
     WHEN x = 'args' THEN array(0)
     WHEN x = 'output' THEN array({RET_SLOT})
     WHEN x IN ('open<', 'open(', 'open[') THEN array_append(a.ix, 0)
     WHEN x IN ('next', 'next_') THEN array_append(slice(a.ix, 1, size(a.ix) - 1), a.ix[size(a.ix) - 1] + 1)
     WHEN x IN ('close', 'close_', 'close0') THEN slice(a.ix, 1, size(a.ix) - 1)
     ELSE a.ix END,
  'rs', CASE
     WHEN x IN ('open(', 'open[') THEN array_append(a.rs, a.rf)
     WHEN x = 'open<' THEN element_at(a.nodes, -1).chain
     WHEN x IN ('close', 'close_', 'close0') AND a.st <> 'A' THEN slice(a.rs, 1, size(a.rs) - 1)
     ELSE a.rs END,
  'sp', CASE
     WHEN x = 'open(' THEN array_append(a.sp, 'tuple')
     WHEN x = 'open[' THEN array_append(a.sp, 'slice')
     WHEN x = 'open<' THEN array_append(a.sp, 'path')
     WHEN x IN ('close', 'close_', 'close0') AND a.st <> 'A' THEN slice(a.sp, 1, size(a.sp) - 1)
     ELSE a.sp END,
  'rf', CASE
     WHEN x = 'ref' THEN array_append(a.rf, {_REF_CODE})
     WHEN x IN ('leaf', 'leaf!', 'path', 'open(', 'open[', 'output') THEN cast(array() AS array<string>)
     ELSE a.rf END,
  'txt', CASE
     WHEN x = 'ref' THEN concat(a.txt, {_REF_CODE}, ' ')
     WHEN x IN ('leaf', 'leaf!', 'path', 'wild', 'open(', 'open[', 'open<', 'close', 'close0', 'next')
       THEN concat(a.txt, t.v)
     WHEN x IN ('close_', 'next_') THEN concat(a.txt, '_', t.v)
     ELSE a.txt END,
  'pos', IF(x IN ('stop', 'bad', 'end'), a.pos, a.pos + length(t.v)),
  'nodes', IF(x IN ('leaf', 'leaf!', 'path', 'open(', 'open['), array_append(a.nodes, {_NEW_NODE}), a.nodes),
  'closes', IF(x IN ('close', 'close_', 'close0'), array_append(a.closes, cast(named_struct(
       'slot', IF(a.st = 'A', {ARITY_SLOT}, a.ix[0]),
       'path', array_join(slice(a.ix, 2, greatest(size(a.ix) - 2, 0)), '.'),
       'n', IF(x = 'close0', 0, a.ix[size(a.ix) - 1] + 1),
       't1', length(a.txt) + IF(x = 'close_', 2, 1)) AS {CLOSE_TYPE})), a.closes),
  'args', IF(a.st = 'A' AND x IN ('next', 'close') AND NOT a.any_args, array_append(a.args, cast(named_struct(
       'slot', a.ix[0], 'arg_name', a.nm, 'wild', NOT a.has_type) AS {ARG_TYPE})), a.args),
  'nm', CASE WHEN x = 'name' AND t.c <> '_' THEN t.v WHEN a.st = 'A' AND x = 'next' THEN NULL ELSE a.nm END,
  'has_type', CASE WHEN a.st = 'A' AND x IN ('leaf', 'path', 'open(', 'open[') THEN true
                   WHEN a.st = 'A' AND x = 'next' THEN false ELSE a.has_type END,
  'any_args', a.any_args OR x = 'any',
  'unit', a.unit OR x = 'unit')"""

_START = f"""named_struct(
  'm', 'start', 'st', '', 'ix', cast(array() AS array<int>),
  'rs', cast(array() AS array<array<string>>), 'sp', cast(array() AS array<string>),
  'rf', cast(array() AS array<string>), 'txt', '', 'pos', 0,
  'nodes', cast(array() AS array<{NODE_TYPE}>), 'closes', cast(array() AS array<{CLOSE_TYPE}>),
  'args', cast(array() AS array<{ARG_TYPE}>), 'nm', cast(NULL AS string), 'has_type', false,
  'any_args', false, 'unit', false)"""


def _fold(tokens: str) -> str:
    return f"""aggregate({tokens}, {_START},
      (a, t) -> transform(array({_ACTION}), x -> {_NEXT})[0])"""


# One output node; ``n_children`` and ``canon`` come from the closing bracket where there is one.
_FINISH_NODE = """transform(f.nodes, n -> transform(
    array(get(filter(f.closes, c -> c.slot = n.slot AND c.path = n.path), 0)), c -> named_struct(
      'slot', n.slot, 'path', n.path, 'spine', n.spine,
      'refs', element_at(n.chain, -1), 'chain', n.chain,
      'kind', n.kind, 'name', n.name, 'n_children', c.n,
      'canon', substring(f.txt, n.t0 + 1, coalesce(c.t1, n.t1) - n.t0)))[0])"""

_PSEUDO = """named_struct('slot', {slot}, 'path', '', 'spine', '',
      'refs', cast(array() AS array<string>), 'chain', array(cast(array() AS array<string>)),
      'kind', '{kind}', 'name', cast(NULL AS string), 'n_children', {n}, 'canon', '')"""


# The arguments must be complete; an output type that breaks off inside the brackets of its outermost
# path still counts, without those brackets.
_ARITY = _PSEUDO.format(slot=ARITY_SLOT, kind="arity", n="s.n_args")
_UNIT = _PSEUDO.format(slot=RET_SLOT, kind="unit", n="cast(NULL AS int)")
_RESULT = f"""named_struct(
  'name', _name,
  'has_sig', s.ok,
  'any_args', f.any_args,
  'n_args', IF(s.ok AND NOT f.any_args, s.n_args, NULL),
  'args', IF(s.ok, f.args, slice(f.args, 1, 0)),
  'ret', IF(s.ok, IF(s.ret = 'cut', 'type', s.ret), NULL),
  'nodes', IF(s.ok, concat(
     IF(f.any_args, slice(array({_ARITY}), 1, 0), array({_ARITY})),
     CASE
       WHEN s.ret = 'type' THEN s.nodes
       WHEN s.ret = 'unit' THEN array_append(s.nodes, {_UNIT})
       WHEN s.ret = 'cut' THEN transform(
         filter(s.nodes, n -> n.slot <> {RET_SLOT} OR n.path = ''),
         n -> IF(n.slot = {RET_SLOT}, named_struct(
           'slot', n.slot, 'path', n.path, 'spine', n.spine, 'refs', n.refs, 'chain', n.chain,
           'kind', n.kind, 'name', n.name, 'n_children', cast(NULL AS int), 'canon', n.name), n))
       ELSE filter(s.nodes, n -> n.slot <> {RET_SLOT}) END),
     slice(array({_ARITY}), 1, 0)),
  'unparsed', substring(_decl, 1 + CASE
     WHEN NOT s.ok THEN 0
     WHEN s.ret = 'cut' THEN s.cut_at
     WHEN s.ret IS NULL AND left(f.st, 1) = 'O' THEN length(regexp_extract(_decl, {_sql_text(ARGUMENTS)}, 0))
     ELSE f.pos END),
  'rejected', _name IS NULL AND NOT s.ok)"""


def parse_signatures(df: DataFrame, text: str | Column = "text", into: str = "sig") -> DataFrame:
    """Add a struct column with the parsed query.

    Fields: ``name``, ``has_sig``, ``any_args``, ``n_args``, ``args`` (slot, arg_name, wild),
    ``ret`` ('type', 'unit' or NULL for no constraint), ``nodes`` and ``unparsed``.  A text that
    gives neither a name nor a declaration has ``rejected`` set.
    """
    raw = F.col(text) if isinstance(text, str) else text
    out = df.withColumn("_text", raw).withColumns({
        "_name": F.nullif(F.regexp_extract("_text", HEAD, 1), F.lit("")),
        "_decl": F.regexp_replace("_text", HEAD, ""),
    })
    # One expression with bound variables, so that no plan rewrite can make the fold run twice.
    state = f"""named_struct(
        'ok', f.m <> 'start' AND (f.m IN ('tail', 'end') OR left(f.st, 1) = 'O'),
        'ret', CASE
            WHEN f.unit OR f.m = 'tail' THEN 'unit'
            WHEN left(f.st, 1) <> 'O' THEN NULL
            WHEN f.m IN ('end', 'done', 'path') AND f.st = 'O' THEN 'type'
            WHEN left(f.st, 2) = 'O<' THEN 'cut'
            ELSE NULL END,
        'nodes', {_FINISH_NODE},
        'n_args', get(filter(f.closes, c -> c.slot = {ARITY_SLOT}), 0).n,
        'cut_at', get(filter(f.nodes, n -> n.slot = {RET_SLOT} AND n.path = ''), 0).p1)"""
    return out.withColumn(into, F.expr(f"""
        transform(array({_fold(_tokens('_decl'))}), f ->
          transform(array({state}), s -> {_RESULT})[0])[0]""")).drop("_text", "_name", "_decl")


def query_nodes(parsed: DataFrame, key: str, sig: str = "sig") -> DataFrame:
    """One row per type-tree node of each parsed text."""
    # The outer form keeps Spark from adding a filter that would work the parse out once more.
    return parsed.select(key, F.inline_outer(f"{sig}.nodes")).filter("slot IS NOT NULL")
