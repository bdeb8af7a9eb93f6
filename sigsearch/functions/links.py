"""Documentation path and link of a hit, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: receiver kinds without a path of their own ---------------------------------------
BUILTIN_RECEIVERS = {
    "tuple": "tuple",
    "slice": "slice",
    "array": "array",
    "raw_pointer": "pointer",
    "borrowed_ref": "reference",
}
LINKED_PATH_KINDS = ("union", "enum", "struct")
# ----------------------------------------------------------------------------------------------------


def receiver_path(for_kind: str = "for_kind", prim: str = "for_name", path: str = "path") -> Column:
    """Path of the type an inherent method belongs to; NULL if it cannot be linked."""
    out = F.when(F.col(for_kind) == "resolved_path", F.col(path)).when(
        F.col(for_kind) == "primitive", F.array(F.col(prim))
    )
    for kind, page in BUILTIN_RECEIVERS.items():
        out = out.when(F.col(for_kind) == kind, F.array(F.lit(page)))
    return out


def receiver_page(for_kind: str = "for_kind", name: str = "for_name", path_kind: str = "path_kind") -> Column:
    """File name of the receiver's page; NULL if it cannot be linked."""
    out = F.when(
        (F.col(for_kind) == "resolved_path") & F.col(path_kind).isin(*LINKED_PATH_KINDS),
        F.concat_ws(".", F.col(path_kind), F.col(name), F.lit("html")),
    ).when(F.col(for_kind) == "primitive", F.concat(F.lit("primitive."), F.col(name), F.lit(".html")))
    for kind, page in BUILTIN_RECEIVERS.items():
        out = out.when(F.col(for_kind) == kind, F.lit(f"primitive.{page}.html"))
    return out


def with_last(parts: str | Column, last: Column) -> Column:
    """The same array with another last element; an empty array stays empty."""
    col = F.col(parts) if isinstance(parts, str) else parts
    return F.when(F.size(col) == 0, col).otherwise(
        F.array_append(F.slice(col, F.lit(1), F.greatest(F.size(col) - 1, F.lit(0))), last)
    )


def hit_path(base: str = "base_path", kind: str = "kind", name: str = "name") -> Column:
    return F.when(F.col(kind) == "function", F.col(base)).otherwise(F.array_append(base, F.col(name)))


def hit_link(base: str = "base_path", kind: str = "kind", name: str = "name", page: str = "page") -> Column:
    fn_page = F.concat(F.lit("fn."), F.get(F.col(base), F.size(base) - 1), F.lit(".html"))
    method = F.concat(F.col(page), F.lit("#method."), F.col(name))
    return F.when(
        F.col(kind) == "function", F.when(F.size(base) == 0, F.col(base)).otherwise(with_last(base, fn_page))
    ).otherwise(with_last(base, method))
