"""Recursive type documents -> node rows, one expression per function (no shuffle, no Python).

A signature is a small tree; Spark's schema cannot recurse, so each function keeps an array of nodes
with their position.  The tree is walked breadth-first with ``aggregate`` over a VARIANT frontier:
a round peels one pointer, opens one child level, puts the receiver type in place of ``Self``, or
splits an alias into its two readings.  The number of rounds is bounded by the number of type
documents in the text, so no depth limit is needed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sigsearch.operators.parse import ARITY_SLOT, RET_SLOT

HOP_TYPE = "struct<d:int,op:string,alt:string,oi:int>"
NODE_TYPE = (
    f"struct<slot:int,ord:array<int>,path:string,spine:string,refs:array<string>,"
    f"hops:array<{HOP_TYPE}>,kind:string,name:string,n_children:int>"
)
TODO_TYPE = (
    f"struct<slot:int,path:array<int>,spine:array<string>,ord:array<int>,refs:array<string>,"
    f"hops:array<{HOP_TYPE}>,alias:boolean,written:boolean,v:variant>"
)

# --- fixed values: spelling of the documents ------------------------------------------------------
KIND = "$.kind"
POINTER_KINDS = ("borrowed_ref", "raw_pointer")
P_INNER = "$.inner"
P_POINTEE = "$.inner.type"
P_MUTABLE = "$.inner.mutable"
P_NAME = "$.inner.name"
P_ID = "$.inner.id"
P_ARGS = "$.inner.args"
P_ANGLE = "$.inner.args.angle_bracketed.args"
P_ARG_TYPE = "$.type"
# --------------------------------------------------------------------------------------------------


def _get(v: str, path: str, type_: str = "string") -> str:
    return f"try_variant_get({v}, '{path}', '{type_}')"


_PTR = f"k IN {POINTER_KINDS}"
_SELF = f"k = 'generic' AND _self IS NOT NULL AND {_get('x.v', P_INNER)} = 'Self'"
_ALIAS = f"k = 'resolved_path' AND NOT x.written AND map_contains_key(_aliases, {_get('x.v', P_ID)})"

_REF_CODE = f"""concat(IF(k = 'borrowed_ref', '&', '*'), CASE WHEN coalesce({_get('x.v', P_MUTABLE, 'boolean')}, false)
  THEN 'm' WHEN k = 'raw_pointer' THEN 'c' ELSE '' END)"""


def _todo(**changes: str) -> str:
    fields = ("slot", "path", "spine", "ord", "refs", "hops", "alias", "written", "v")
    return "named_struct({})".format(
        ", ".join(f"'{f}', {changes.get(f, 'x.' + f)}" for f in fields)
    )


def _hop(op: str, alt: str = "cast(NULL AS string)", oi: str = "cast(NULL AS int)") -> str:
    return (
        f"array_append(x.hops, cast(named_struct('d', size(x.path), 'op', {op}, 'alt', {alt},"
        f" 'oi', {oi}) AS {HOP_TYPE}))"
    )


# An alias reading is told apart by the place where it stands, counting earlier aliases there.
_ALT = "concat_ws('/', x.slot, array_join(x.path, '.'), size(x.ord))"

_CHILDREN = f"""CASE k
  WHEN 'tuple' THEN coalesce({_get('x.v', P_INNER, 'array<variant>')}, cast(array() AS array<variant>))
  WHEN 'slice' THEN array({_get('x.v', P_INNER, 'variant')})
  WHEN 'resolved_path' THEN transform(
    coalesce({_get('x.v', P_ANGLE, 'array<variant>')}, cast(array() AS array<variant>)),
    a -> coalesce({_get('a', P_ARG_TYPE, 'variant')}, parse_json('{{"kind":"nontype"}}')))
  ELSE cast(array() AS array<variant>) END"""

_NODE_KIND = """CASE k WHEN 'resolved_path' THEN 'path' WHEN 'primitive' THEN 'prim' WHEN 'generic' THEN 'generic'
  WHEN 'tuple' THEN 'tuple' WHEN 'slice' THEN 'slice' WHEN 'nontype' THEN 'nontype' ELSE 'other' END"""

_NODE = f"""cast(named_struct(
  'slot', x.slot, 'ord', x.ord, 'path', array_join(x.path, '.'), 'spine', array_join(x.spine, '.'),
  'refs', x.refs, 'hops', IF(x.alias, x.hops, NULL), 'kind', {_NODE_KIND},
  'name', CASE WHEN k = 'resolved_path' THEN substring_index({_get('x.v', P_NAME)}, '::', -1)
               WHEN k IN ('primitive', 'generic') THEN {_get('x.v', P_INNER)} END,
  'n_children', CASE k
     WHEN 'tuple' THEN size(c) WHEN 'slice' THEN 1
     WHEN 'resolved_path' THEN CASE
        WHEN {_get('x.v', P_ARGS, 'variant')} IS NULL OR is_variant_null({_get('x.v', P_ARGS, 'variant')}) THEN NULL
        ELSE size(c) END
  END) AS {NODE_TYPE})"""

# One frontier entry gives new frontier entries and at most one finished node.
_EXPAND = f"""
CASE
  WHEN {_PTR} THEN named_struct('todo', array({_todo(refs=f"array_append(x.refs, {_REF_CODE})", hops=_hop(_REF_CODE), v=_get('x.v', P_POINTEE, 'variant'))}),
       'done', cast(array() AS array<{NODE_TYPE}>))
  WHEN {_SELF} THEN named_struct('todo', array({_todo(v='_self')}), 'done', cast(array() AS array<{NODE_TYPE}>))
  WHEN {_ALIAS} THEN named_struct('todo', array(
       {_todo(hops=_hop("'W'", _ALT, 'size(x.ord)'), ord='array_append(x.ord, 0)', alias='true', written='true')},
       {_todo(hops=_hop("'A'", _ALT, 'size(x.ord)'), ord='array_append(x.ord, 1)', alias='true',
              v=f"parse_json(_aliases[{_get('x.v', P_ID)}])")}),
       'done', cast(array() AS array<{NODE_TYPE}>))
  ELSE transform(array({_CHILDREN}), c -> named_struct(
       'todo', transform(c, (v, i) -> {_todo(path='array_append(x.path, i)', spine=f'array_append(x.spine, {_NODE_KIND})',
                                             ord='array_append(x.ord, i)', refs='cast(array() AS array<string>)',
                                             written='false', v='v')}),
       'done', array({_NODE})))[0]
END"""


def _pseudo(slot: int, kind: str, n: str) -> str:
    return f"""cast(named_struct('slot', {slot}, 'ord', array(0), 'path', '', 'spine', '',
      'refs', cast(array() AS array<string>), 'hops', NULL, 'kind', '{kind}', 'name', NULL, 'n_children', {n})
      AS {NODE_TYPE})"""


def flatten_signature() -> Column:
    """Nodes of one function, in visiting order; NULL where an alias refers back to itself.

    Reads the columns ``_inputs`` (ARRAY<VARIANT> of types), ``_output`` and ``_self`` (VARIANT or
    NULL), ``_aliases`` (MAP<id, type text>) and ``_rounds`` (an upper bound of the tree height).
    """
    texts = "cast(array() AS array<string>)"
    done = f"cast(array() AS array<{NODE_TYPE}>)"
    root = f"""cast(named_struct('slot', {{slot}}, 'path', cast(array() AS array<int>), 'spine', {texts},
       'ord', cast(array() AS array<int>), 'refs', {texts}, 'hops', cast(array() AS array<{HOP_TYPE}>),
       'alias', false, 'written', false, 'v', {{v}}) AS {TODO_TYPE})"""
    start = f"""concat(
      transform(_inputs, (v, i) -> {root.format(slot='i', v='v')}),
      filter(array({root.format(slot=RET_SLOT, v='_output')}), r -> r.v IS NOT NULL))"""
    expand = f"transform(s.todo, x -> transform(array({_get('x.v', KIND)}), k -> {_EXPAND})[0])"
    fold = f"""aggregate(sequence(1, _rounds), named_struct('todo', {start}, 'done', {done}),
      (s, n) -> transform(array({expand}), e -> named_struct(
        'todo', flatten(transform(e, y -> y.todo)),
        'done', concat(s.done, flatten(transform(e, y -> y.done)))))[0])"""
    arity = _pseudo(ARITY_SLOT, "arity", "size(_inputs)")
    unit = _pseudo(RET_SLOT, "unit", "NULL")
    return F.expr(f"""
      transform(array({fold}), s -> IF(size(s.todo) > 0, NULL, sort_array(concat(
        array({arity}), s.done, IF(_output IS NULL, array({unit}), {done})))))[0]""")
