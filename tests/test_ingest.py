import json

import pytest
from conftest import alias, arr, document, fn, gen, impl, path, prim, ptr, ref, sli, tup, write_index
from pyspark.sql import functions as F

from sigsearch.operators.scope import check_scopes, in_scope, scope_problems
from sigsearch.plans import search as se
from sigsearch.sources.crate_files import bad_sets, read_crate_files, read_sets

I32 = prim("i32")


def test_files_sets_and_scopes(load):
    good = document([fn("a", "one", [])])
    tables, catalog, scopes = load(
        {"good": good, "broken": '{"index": {', "other": "[1, 2]", "v1.2": document([fn("b", "two", [])])},
        {"all": ["good", "v1.2", "good"], "lost": ["good", "nowhere"], "odd": "{", "number": "3"},
    )
    assert {r.crate for r in tables["bad_files"].collect()} == {"broken", "other"}
    assert {(r.crate, r.name) for r in catalog.fns.collect()} == {("good", "one"), ("v1.2", "two")}
    got = {(r.scope, r.crate) for r in scopes.collect()}
    assert got == {
        ("set:all", "good"), ("set:all", "v1.2"), ("set:lost", "good"), ("set:lost", "nowhere"),
        ("crate:good", "good"), ("crate:broken", "broken"), ("crate:other", "other"), ("crate:v1.2", "v1.2"),
    }


def test_nothing_is_lost_in_silence(load, spark, tmp_path):
    bare = fn("b", "bare", [])
    del bare["inner"]["decl"]
    present = {"index": {"0": {"id": 0, "name": "f", "inner": {"function": {"sig": {"inputs": [], "output": None}}}}}, "paths": {}}
    tables, catalog, _ = load(
        {"pkg": document([bare, fn("a", "whole", [])]), "present": json.dumps(present), "_under": document([]), "half": '{"index": {}}', "cut": "{"},
        {"good": ["pkg"], "text": "3", "hole": '["pkg", null]'},
    )
    assert {(r.crate, r.reason) for r in tables["bad_files"].collect()} == {
        ("present", "unknown layout"), ("_under", "skipped by its name"), ("half", "no index or paths"), ("cut", "no JSON")}
    assert {(r.item_id, r.reason) for r in catalog.quarantine.collect()} == {("b", "no declaration")}
    assert [r.name for r in catalog.fns.collect()] == ["whole"]
    assert {(r.set, r.reason) for r in bad_sets(spark, str(tmp_path)).collect()} == {("text", "no list of names"), ("hole", "a name is null")}


def test_scopes_are_pruned_and_checked(load, asks):
    tables, catalog, scopes = load({f"p{i}": document([fn(f"f{i}", "go", [I32])]) for i in range(12)}, {"two": ["p1", "p2"], "lost": ["nowhere"]})
    asked = asks("(i32)", scope="set:two")
    plan = in_scope(catalog.fns, scopes, asked)._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan or "PartitionFilters: [isnotnull(bucket" in plan
    assert {r.crate for r in se.search(asked, catalog, scopes, k=None).collect()} == {"p1", "p2"}
    check_scopes(asked, scopes, tables["crates"])
    for wrong in ("set:none", "set:lost", "p1"):
        with pytest.raises(ValueError):
            check_scopes(asks("(i32)", scope=wrong), scopes, tables["crates"])


def test_scope_problems(load, spark):
    tables, _, scopes = load({"pkg": document([])}, {"lost": ["pkg", "nowhere"]})
    asked = spark.createDataFrame(
        [(0, "crate:pkg"), (1, "set:lost"), (2, "set:none"), (3, "pkg"), (4, "crate:pkg:x"), (5, None)],
        "query_id int, scope string",
    )
    got = {(r.query_id, r.crate, r.problem) for r in scope_problems(asked, scopes, tables["crates"]).collect()}
    assert got == {(1, "nowhere", "unknown crate"), (2, None, "unknown scope"), (3, None, "misspelt"),
                   (4, None, "misspelt"), (5, None, "misspelt")}


def test_no_set_directory(spark, tmp_path):
    assert read_sets(spark, write_index(tmp_path, {"pkg": document([])})).count() == 0


def test_only_wanted_kinds(spark, tmp_path):
    doc = document([fn("a", "one", []), {"id": "m", "name": "m", "kind": "module", "inner": {}, "docs": None}],
                   {"t": (["pkg", "T"], "struct"), "x": (["pkg", "X"], "macro")})
    tables = read_crate_files(spark, write_index(tmp_path, {"pkg": doc}))
    assert [r.id for r in tables["items"].collect()] == ["a"]
    assert {r.id for r in tables["paths"].collect()} == {"a", "t"}


RECEIVERS = {
    "struct": (path("Widget"), ["pkg", "w", "Widget"], ["pkg", "w", "struct.Widget.html#method.go"]),
    "enum": (path("Shape", gen("T")), ["pkg", "Shape"], ["pkg", "enum.Shape.html#method.go"]),
    "union": (path("Bits"), ["pkg", "Bits"], ["pkg", "union.Bits.html#method.go"]),
    "primitive": (I32, ["i32"], ["primitive.i32.html#method.go"]),
    "tuple": (tup(I32, I32), ["tuple"], ["primitive.tuple.html#method.go"]),
    "slice": (sli(gen("T")), ["slice"], ["primitive.slice.html#method.go"]),
    "array": (arr(I32), ["array"], ["primitive.array.html#method.go"]),
    "pointer": (ptr(gen("T")), ["pointer"], ["primitive.pointer.html#method.go"]),
    "reference": (ref(I32), ["reference"], ["primitive.reference.html#method.go"]),
}


def test_links(load, asks):
    items = [fn("free", "go", [])]
    for n, (for_, _, _) in RECEIVERS.items():
        items += [fn(f"m:{n}", "go", [gen("Self")], kind="method", docs=f"of {n}"), impl(f"i:{n}", for_, [f"m:{n}"])]
    items += [
        # not searched: methods of a trait's implementation, and methods in no impl
        fn("m:trait", "go", [], kind="method"), impl("i:trait", path("Widget"), ["m:trait"], trait=path("Trait")),
        fn("m:none", "go", [], kind="method"),
    ]
    paths = {"ty:Widget": (["pkg", "w", "Widget"], "struct"), "ty:Shape": (["pkg", "Shape"], "enum"), "ty:Bits": (["pkg", "Bits"], "union")}
    _, catalog, scopes = load({"pkg": document(items, paths)})
    hits = {r.item_id: r for r in se.search(asks("fn go"), catalog, scopes).collect()}
    assert hits.keys() == {"free", *(f"m:{n}" for n in RECEIVERS)}
    assert (hits["free"].path, hits["free"].link) == (["pkg", "go"], ["pkg", "fn.go.html"])
    for n, (_, base, link) in RECEIVERS.items():
        assert (hits[f"m:{n}"].path, hits[f"m:{n}"].link) == (base + ["go"], link)
    as_json = [json.loads(r.hit) for r in se.hits_json(se.search(asks("fn go"), catalog, scopes)).collect()]
    assert {"name": "go", "path": ["pkg", "go"], "link": ["pkg", "fn.go.html"], "docs": None} in as_json
    assert all(set(h) == {"name", "path", "link", "docs"} for h in as_json)


def test_quarantine(load, asks):
    lost = document([fn("b", "b", [])])
    del lost["paths"]["b"]
    items = [
        fn("ok", "ok", []), fn("self", "f", [gen("Self")]), fn("free", "g", [gen("Self")]),
        impl("i1", path("Gone"), ["m1", "missing"]), fn("m1", "m", [], kind="method"),
        impl("i2", path("Tr"), ["m2"]), fn("m2", "m", [], kind="method"),
        impl("i3", {"kind": "generic", "inner": "T"}, ["m3"]), fn("m3", "m", [], kind="method"),
        fn("loop", "l", [path("L", id="al")]), alias("al", "L", path("Vec", path("L", id="al"))),
    ]
    _, catalog, scopes = load({"pkg": document(items, {"ty:Tr": (["pkg", "Tr"], "trait")}), "lost": lost})
    got = {(r.crate, r.item_id, r.impl_id, r.reason, r.missing_id) for r in catalog.quarantine.collect()}
    assert got == {
        ("pkg", "self", "", "Self outside of an impl", None), ("pkg", "free", "", "Self outside of an impl", None),
        ("pkg", None, "i1", "no member", "missing"), ("pkg", "m1", "i1", "no path", "ty:Gone"),
        ("pkg", "m2", "i2", "receiver without a page", None), ("pkg", "m3", "i3", "receiver without a page", None),
        ("lost", "b", "", "no path", "b"), ("pkg", "loop", "", "alias loop", None),
    }
    assert [r.item_id for r in catalog.fns.collect()] == ["ok"]
    with pytest.raises(ValueError, match="quarantine"):
        se.check_whole(catalog, scopes.filter("scope = 'crate:lost'"))
    se.check_whole(catalog, scopes.filter(F.lit(False)))


def test_written_catalog_reads_back(load, spark, tmp_path, asks):
    from sigsearch.plans.catalog import read_catalog

    _, catalog, scopes = load({"pkg": document([fn("a", "one", [I32], docs="d")])})
    again = read_catalog(spark, str(tmp_path / "catalog"))
    rows = [se.search(asks("(i32)"), c, scopes).drop("text_id", "sig_id").collect() for c in (catalog, again)]
    assert rows[0] == rows[1] and rows[0][0].docs == "d"


def test_written_files_are_read_back(spark, tmp_path):
    from sigsearch.sources.crate_files import file_entries, file_lines, write_lines

    rows = [("a b", "item", 'odd "id"', '{"kind":"function"}'), ("a b", "path", "p", '{"kind":"struct"}'), ("a b", "item", "2", '{"kind":"x\\ny"}'),
            ("paths=only", "path", "p", '{"kind":"enum"}'), ("c", "item", "1", '{"kind":"impl"}')]
    entries = spark.createDataFrame(rows, "crate string, source string, id string, text string")
    write_lines(file_lines(entries), f"{tmp_path}/crate")
    assert sorted(p.name for p in (tmp_path / "crate").iterdir() if p.name[0] != ".") == ["a b.json", "c.json", "paths=only.json"]
    back = file_entries(spark, str(tmp_path)).filter("source IN ('item', 'path')").select("crate", "source", "id", "text")
    assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_alias_chains_take_logarithmic_rounds(spark, monkeypatch):
    import json

    from conftest import alias, path
    from sigsearch.plans import catalog

    n = 500
    items = [alias(f"al{k}", f"al{k}", path("X", id=f"al{k + 1}")) for k in range(n)]
    rows = [("pkg", i["id"], "typedef", json.dumps(i["inner"], separators=(",", ":"))) for i in items]
    rows += [("pkg", f"lo{k}", "typedef", json.dumps(alias("l", "l", path("X", id=f"lo{1 - k}"))["inner"], separators=(",", ":"))) for k in (0, 1)]
    rounds = []
    settle = catalog.settle
    monkeypatch.setattr(catalog, "settle", lambda df: rounds.append(1) or settle(df))
    reach = catalog.alias_reach(spark.createDataFrame(rows, "crate string, id string, kind string, inner string"))
    got = {}
    for r in reach.collect():
        got.setdefault(r.id, set()).add(r.dep_id)
    assert got["al0"] == {f"al{k}" for k in range(n)} and got["al490"] == {f"al{k}" for k in range(490, n)}
    assert got["lo0"] == got["lo1"] == {"lo0", "lo1"}
    assert len(rounds) <= 14  # two tables, and at most twelve rounds


def test_names_of_generics_do_not_part_signatures(load, asks):
    shapes = {
        "a": ([gen("T"), gen("U")], path("Vec", gen("U"))), "b": ([gen("U"), gen("T")], path("Vec", gen("T"))),
        "c": ([gen("K"), gen("V")], path("Vec", gen("V"))), "d": ([gen("K"), gen("V")], path("Vec", gen("K"))),
        "e": ([gen("T"), gen("T")], path("Vec", gen("T"))), "f": ([prim("T"), gen("T")], path("Vec", gen("T"))),
    }
    _, catalog, scopes = load({"pkg": document([fn(n, n, *s) for n, s in shapes.items()])})
    rows = {r.item_id: r for r in catalog.fns.collect()}
    assert rows["a"].sig_id == rows["b"].sig_id == rows["c"].sig_id
    assert len({bytes(r.sig_id) for r in rows.values()}) == catalog.sigs.count() == 4
    assert {n: r.generics for n, r in rows.items()} == {
        "a": ["T", "U"], "b": ["U", "T"], "c": ["K", "V"], "d": ["K", "V"], "e": ["T"], "f": ["T"]}
    hits = {r.item_id: round(r.score, 4) for r in se.search(asks("(A, B) -> Vec<B>"), catalog, scopes, threshold=2.0).collect()}
    assert hits["a"] == hits["b"] == hits["c"] and len(hits) == 6 and min(hits.values()) == hits["a"]
