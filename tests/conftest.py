import json
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[*]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


# --- writing documentation items ---------------------------------------------------------------------

def prim(name):
    return {"kind": "primitive", "inner": name}


def gen(name):
    return {"kind": "generic", "inner": name}


def path(name, *args, id=None, no_args=False):
    given = None if no_args or not args else {"angle_bracketed": {"args": [
        a if set(a) & {"lifetime", "const"} else {"type": a} for a in args], "bindings": []}}
    return {"kind": "resolved_path", "inner": {"name": name, "id": id or f"ty:{name}", "args": given, "param_names": []}}


def ref(t, mutable=False):
    return {"kind": "borrowed_ref", "inner": {"lifetime": None, "mutable": mutable, "type": t}}


def ptr(t, mutable=False):
    return {"kind": "raw_pointer", "inner": {"mutable": mutable, "type": t}}


def tup(*ts):
    return {"kind": "tuple", "inner": list(ts)}


def sli(t):
    return {"kind": "slice", "inner": t}


def arr(t):
    return {"kind": "array", "inner": {"type": t, "len": "4"}}


def item(id, name, kind, inner, docs=None):
    return {"id": id, "crate_id": 0, "name": name, "span": None, "visibility": "public", "docs": docs, "links": {},
            "attrs": [], "deprecation": None, "kind": kind, "inner": inner}


def fn(id, name, inputs, output=None, kind="function", docs=None):
    """``inputs`` are types, or (name, type)."""
    named = [[i[0], i[1]] if isinstance(i, tuple) else [f"a{n}", i] for n, i in enumerate(inputs)]
    body = {"decl": {"inputs": named, "output": output, "c_variadic": False},
            "generics": {"params": [], "where_predicates": []}, "header": [], "abi": "rust"}
    return item(id, name, kind, body, docs)


def impl(id, for_, members, trait=None):
    return item(id, None, "impl", {"is_unsafe": False, "generics": {"params": [], "where_predicates": []},
                                   "provided_trait_methods": [], "trait": trait, "for": for_, "items": members,
                                   "negative": False, "synthetic": False, "blanket_impl": None})


def alias(id, name, type_):
    return item(id, name, "typedef", {"type": type_, "generics": {"params": [], "where_predicates": []}})


def document(items, paths=None):
    index = {i["id"]: i for i in items}
    summaries = {k: {"crate_id": 0, "path": v[0], "kind": v[1]} for k, v in (paths or {}).items()}
    for i in items:
        if i["kind"] == "function":
            summaries.setdefault(i["id"], {"crate_id": 0, "path": ["pkg", i["name"]], "kind": "function"})
    return {"root": "0:0", "crate_version": "0.0.0", "includes_private": False, "index": index, "paths": summaries,
            "external_crates": {"1": {"name": "other"}}, "format_version": 0}


def write_index(directory, crates, sets=None):
    (directory / "crate").mkdir()
    for name, doc in crates.items():
        (directory / "crate" / f"{name}.json").write_text(doc if isinstance(doc, str) else json.dumps(doc))
    if sets is not None:
        (directory / "set").mkdir()
        for name, members in sets.items():
            (directory / "set" / f"{name}.json").write_text(members if isinstance(members, str) else json.dumps(members))
    return str(directory)


@pytest.fixture
def load(spark, tmp_path):
    """Write documentation files, read them back and build the catalogue."""
    from sigsearch.plans.catalog import build_catalog
    from sigsearch.sources.crate_files import make_scopes, read_crate_files, read_sets

    def go(crates, sets=None):
        directory = write_index(tmp_path, crates, sets)
        tables = read_crate_files(spark, directory)
        scopes = make_scopes(read_sets(spark, directory), tables["crates"])
        return tables, build_catalog(tables["items"], tables["paths"], str(tmp_path / "catalog")), scopes

    return go


@pytest.fixture
def asks(spark):
    def go(*texts, scope="crate:pkg"):
        return spark.createDataFrame(
            [(i, t, scope) for i, t in enumerate(texts)], "query_id int, text string, scope string"
        )

    return go
