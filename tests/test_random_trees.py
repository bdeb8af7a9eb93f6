"""Row form against a tree walk: every pair of many random queries and functions.

The walk below is written straight from the rules, recursively, and knows nothing of positions, orders
or joins.  It covers pointers, aliases of aliases, aliases inside arguments, and bindings shared by all
of a signature.
"""

import random
from functools import reduce

import pytest
from conftest import alias, arr, document, fn, gen, impl, path, prim, ptr, ref, sli, tup, write_index

from pyspark.sql import DataFrame

from sigsearch.operators.joins import pieces
from sigsearch.plans import search as se


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


class Walk:
    """Components of one pair; ``bound`` is what the function's generics stand for so far."""

    def __init__(self, aliases, self_type):
        self.aliases, self.self_type, self.bound = aliases, self_type, {}

    def types(self, q, i, fresh=True):
        kind, inner = i["kind"], i.get("inner")
        if kind == "generic":
            if inner == "Self":
                return self.types(q, self.self_type)
            if inner in self.bound:
                return [0.0 if self.bound[inner] == q else 1.0]
            self.bound[inner] = q
            return [0.25]
        if kind == "resolved_path" and fresh and inner["id"] in self.aliases:
            plain = self.types(q, i, fresh=False)
            expanded = self.types(q, self.aliases[inner["id"]])
            return expanded if sum(expanded) < sum(plain) else plain
        pointers = {"raw_pointer": "ptr", "borrowed_ref": "ref"}
        if kind in pointers:
            if q[0] == pointers[kind]:
                return self.types(q[2], inner["type"]) + ([] if q[1] == inner["mutable"] else [0.25])
            return self.types(q, inner["type"]) + [0.25]
        if q[0] in ("ref", "ptr"):
            return self.types(q[2], i) + [0.25]
        if (q[0], kind) == ("tuple", "tuple"):
            parts = [c for a, b in zip(q[1], inner) if a is not None for c in self.types(a, b)]
            return parts + [0.0] + [1.0] * abs(len(q[1]) - len(inner))
        if (q[0], kind) == ("slice", "slice"):
            return [0.0] + ([] if q[1] is None else self.types(q[1], inner))
        if (q[0], kind) == ("path", "resolved_path"):
            return self.paths(q, inner)
        return [0.0 if (q[0], kind) == ("prim", "primitive") and q[1] == inner else 1.0]

    def paths(self, q, inner):
        name = inner["name"].split("::")[-1]
        out = [distance(q[1], name) / max(len(q[1]), len(name))]
        if q[2] is not None and inner["args"] is None:
            return out + [1.0] * len(q[2])
        if q[2] is not None and "angle_bracketed" in inner["args"]:
            for a, b in zip(q[2], inner["args"]["angle_bracketed"]["args"]):
                if a is not None:
                    out += self.types(a, b["type"]) if "type" in b else [1.0]
        return out

    def signature(self, args, ret, inputs, output):
        out = [c for a, i in zip(args, inputs) if a is not None for c in self.types(a, i)]
        out += [1.0] * abs(len(args) - len(inputs)) or ([0.0] if not args else [])
        if ret is None or output is None:
            return out + [0.0 if ret is None and output is None else 1.0]
        return out + self.types(ret, output)


def spell(q):
    if q is None:
        return "_"
    head, *rest = q
    if head == "ref":
        return "&" + ("mut " if rest[0] else "") + spell(rest[1])
    if head == "ptr":
        return "*" + ("mut " if rest[0] else "const ") + spell(rest[1])
    if head == "tuple":
        return "(" + ", ".join(map(spell, rest[0])) + ")"
    if head == "slice":
        return "[" + spell(rest[0]) + "]"
    if head == "never":
        return "!"
    if head == "path" and rest[1] is not None:
        return rest[0] + "<" + ", ".join(map(spell, rest[1])) + ">"
    return rest[0]


NAMES = ["Foo", "Fob", "Result", "Option"]


def random_query(r, depth):
    pick = r.random()
    if depth == 0 or pick < 0.3:
        return r.choice([("prim", "i32"), ("prim", "u8"), ("gen", "T"), ("gen", "U"), ("path", "Foo", None), ("never",)])
    if pick < 0.5:
        return (r.choice(["ref", "ref", "ptr"]), r.random() < 0.4, random_query(r, depth - 1))
    some = [random_query(r, depth - 1) if r.random() < 0.85 else None for _ in range(r.randint(1, 2))]
    if pick < 0.6:
        return ("tuple", some)
    if pick < 0.7:
        return ("slice", some[0])
    return ("path", r.choice(NAMES), some)


def random_item(r, depth, aliases, self_ok):
    pick = r.random()
    if depth == 0 or pick < 0.3:
        leaves = [prim("i32"), prim("u8"), gen("T"), gen("U"), gen("T"), path("Foo"), arr(prim("u8"))]
        return r.choice(leaves + ([gen("Self")] * 2 if self_ok else []))
    if pick < 0.5:
        return r.choice([ref, ref, ptr])(random_item(r, depth - 1, aliases, self_ok), r.random() < 0.4)
    some = [random_item(r, depth - 1, aliases, self_ok) for _ in range(r.randint(1, 2))]
    if pick < 0.58:
        return tup(*some)
    if pick < 0.66:
        return sli(some[0])
    if pick < 0.85 and aliases:
        a = r.choice(aliases)
        return path("m::" + r.choice(NAMES), *some[: r.randint(0, 2)], id=a)
    if pick < 0.9:
        some[0] = {"lifetime": "'a"}
    return path(r.choice(NAMES), *some)


def test_every_pair(spark, tmp_path):
    from sigsearch.plans.catalog import build_catalog
    from sigsearch.sources.crate_files import read_crate_files

    r = random.Random(7)
    # Aliases may lead to those before them.
    aliases = {}
    for n in range(6):
        aliases[f"al{n}"] = random_item(r, 2, list(aliases), False)
    aliases["al6"] = ref(path("Result", gen("T"), path("Foo"), id="al2"))
    fns, receivers = {}, {}
    docs = [alias(k, k, v) for k, v in aliases.items()]
    for n in range(150):
        method = n % 3 == 0
        inputs = [random_item(r, 3, list(aliases), method) for _ in range(r.randint(0, 3))]
        output = None if r.random() < 0.2 else random_item(r, 3, list(aliases), method)
        fns[f"f{n}"] = (inputs, output)
        docs.append(fn(f"f{n}", f"f{n}", inputs, output, kind="method" if method else "function"))
        if method:
            receivers[f"f{n}"] = r.choice([sli(gen("T")), tup(prim("i32"), gen("T")), ref(prim("u8"))])
            docs.append(impl(f"impl{n}", receivers[f"f{n}"], [f"f{n}"]))
    queries = {}
    while len(queries) < 60:
        args = [random_query(r, 3) if r.random() < 0.9 else None for _ in range(r.randint(0, 3))]
        ret = None if r.random() < 0.2 else random_query(r, 3)
        queries["(" + ", ".join(map(spell, args)) + ")" + ("" if ret is None else " -> " + spell(ret))] = (args, ret)

    directory = write_index(tmp_path, {"pkg": document(docs)})
    tables = read_crate_files(spark, directory)
    catalog = build_catalog(tables["items"], tables["paths"], str(tmp_path / "catalog"))
    assert catalog.quarantine.count() == 0
    log = spark.createDataFrame([(t, "crate:pkg") for t in queries], "text string, scope string")
    texts = se.prepare(log)
    assert texts.filter("sig.rejected").count() == 0
    expected = {
        (t, f): Walk(aliases, receivers.get(f)).signature(*q, *i) for t, q in queries.items() for f, i in fns.items()
    }
    for texts_now in (texts, reduce(DataFrame.unionByName, pieces(texts, "text_id", 20_000))):
        pairs = se.signature_scores(texts_now, catalog.sigs.repartition(8, "sig_id"), catalog.alias_depth)
        got = {
            (x.text, x.item_id): (x.s, x.c)
            for x in catalog.fns.join(pairs, "sig_id").join(texts, "text_id").select("text", "item_id", "s", "c").collect()
        }
        assert got.keys() == expected.keys()
        wrong = {k: (v, expected[k]) for k, v in got.items()
                 if v[1] != len(expected[k]) or v[0] != pytest.approx(sum(expected[k]))}
        assert not wrong, f"{len(wrong)} of {len(got)}: {list(wrong.items())[:3]}"
    for threshold in (0.2, 0.4, 0.7):
        pairs = se.signature_scores(texts, catalog.sigs.repartition(8, "sig_id"), catalog.alias_depth, threshold)
        kept = {
            (x.text, x.item_id)
            for x in catalog.fns.join(pairs, "sig_id").join(texts, "text_id").select("text", "item_id").collect()
        }
        assert {k for k, v in expected.items() if sum(v) / len(v) < threshold} <= kept < expected.keys()


def test_grouping_equals_window(spark, tmp_path):
    """The grouped sums of signatures without aliases equal the window form."""
    from pyspark.sql import functions as F

    from sigsearch.operators import align as al
    from sigsearch.operators import score as sc
    from sigsearch.plans.catalog import build_catalog
    from sigsearch.sources.crate_files import read_crate_files

    r = random.Random(11)
    docs = [fn(f"f{n}", f"f{n}", [random_item(r, 3, [], False) for _ in range(3)]) for n in range(60)]
    tables = read_crate_files(spark, write_index(tmp_path, {"pkg": document(docs)}))
    catalog = build_catalog(tables["items"], tables["paths"], str(tmp_path / "catalog"))
    log = spark.createDataFrame([("(" + ", ".join(spell(random_query(r, 2)) for _ in range(3)) + ")",) for _ in range(30)], "text string")
    rows = al.align(al.item_side(catalog.sigs), al.query_side(se.prepare(log)))
    windowed = sc.bound_rows(rows, ["seq"]).groupBy(*al.PAIR).agg(F.sum("s").alias("s2"), F.sum("c").alias("c2"))
    both = sc.pair_sums(rows).join(windowed, al.PAIR, "full")
    assert both.filter("s IS NULL OR s2 IS NULL OR abs(s - s2) > 1e-9 OR c <> c2").count() == 0


def test_grouped_readings_equal_windows(spark, tmp_path):
    """The best readings of aliases by grouping equal the window form, without a window in the plan."""
    from pyspark.sql import functions as F

    from sigsearch.operators import align as al
    from sigsearch.operators import score as sc
    from sigsearch.plans.catalog import build_catalog
    from sigsearch.sources.crate_files import read_crate_files

    r = random.Random(13)
    aliases = {}
    for n in range(5):
        aliases[f"al{n}"] = random_item(r, 2, list(aliases), False)
    docs = [alias(k, k, v) for k, v in aliases.items()]
    docs += [fn(f"f{n}", f"f{n}", [random_item(r, 3, list(aliases), False) for _ in range(3)]) for n in range(60)]
    tables = read_crate_files(spark, write_index(tmp_path, {"pkg": document(docs)}))
    catalog = build_catalog(tables["items"], tables["paths"], str(tmp_path / "catalog"))
    assert catalog.alias_depth > 1
    log = spark.createDataFrame([("(" + ", ".join(spell(random_query(r, 2)) for _ in range(3)) + ")",) for _ in range(30)], "text string")
    rows = al.align_aliased(al.item_side(catalog.sigs.filter("has_alias").repartition(8, "sig_id")), al.query_side(se.prepare(log)))
    grouped = sc.reading_sums(rows, catalog.alias_depth)
    plan = grouped._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange hashpartitioning(text_id" not in plan
    windowed = sc.choose_readings(sc.bound_rows(rows, ["slot", "ord"]), catalog.alias_depth).groupBy(*al.PAIR).agg(
        F.sum("s").alias("s2"), F.sum("c").alias("c2"))
    both = grouped.join(windowed, al.PAIR, "full")
    assert both.count() > 500
    assert both.filter("s IS NULL OR s2 IS NULL OR abs(s - s2) > 1e-9 OR c <> c2").count() == 0
