"""Cost of differing pointers and references in front of two aligned types.

Codes are ``&``, ``&m``, ``*c`` and ``*m``, outermost first.  Going inwards through the item's codes,
an equal kind in front of the query is used up with it (one step of cost if only the mutability
differs); otherwise the item's code alone is dropped for one step.
"""

from __future__ import annotations

REST_TYPE = "struct<rest:array<string>,k:int>"


def peel_step(state: str, code: str) -> str:
    """SQL: next (rest, k) after one pointer or reference of the item."""
    return f"""CASE
      WHEN left(get({state}.rest, 0), 1) = left({code}, 1)
        THEN named_struct('rest', slice({state}.rest, 2, greatest(size({state}.rest) - 1, 0)),
                          'k', {state}.k + IF({state}.rest[0] = {code}, 0, 1))
      ELSE named_struct('rest', {state}.rest, 'k', {state}.k + 1) END"""


def peel(q_refs: str, i_refs: str) -> str:
    """SQL: what is left of the query's codes, and the number of quarter-point steps so far."""
    return f"""CASE
      WHEN size({i_refs}) = 0 THEN named_struct('rest', {q_refs}, 'k', 0)
      ELSE aggregate({i_refs}, named_struct('rest', {q_refs}, 'k', 0),
                     (s, r) -> {peel_step('s', 'r')}) END"""


def as_text(refs: str) -> str:
    """SQL: codes the way the parser writes them in front of a type text."""
    return f"array_join(transform({refs}, r -> concat(r, ' ')), '')"
