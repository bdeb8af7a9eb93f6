"""The index of signatures and the bound from a first share: same rows, fewer pairs."""

import random

import pytest
from conftest import alias, arr, document, fn, gen, path, prim, ref, tup, write_index
from pyspark.sql import functions as F
from test_random_trees import random_item, random_query, spell

from sigsearch.operators import align as al
from sigsearch.operators import index as ix
from sigsearch.plans import search as se


@pytest.fixture(scope="module")
def trees(spark, tmp_path_factory):
    from sigsearch.plans.catalog import build_catalog
    from sigsearch.sources.crate_files import make_scopes, read_crate_files, read_sets

    folder = tmp_path_factory.mktemp("trees")
    r = random.Random(17)
    aliases = {f"al{n}": random_item(r, 2, [], False) for n in range(4)}
    docs = [alias(k, k, v) for k, v in aliases.items()]
    plain = [prim("i32"), prim("bool"), prim("u8"), path("Foo"), path("Fob", gen("T")), path("Option", gen("T")), gen("T"), arr(prim("u8")),
             ref(ref(ref(prim("u8")))), tup(prim("i32"), gen("T"))]
    for n in range(240):
        pick = (lambda: random_item(r, 2, list(aliases), False)) if n % 2 else (lambda: r.choice(plain))
        docs.append(fn(f"f{n}", r.choice(["get", "set", "gets", "push"]) + str(n % 7), [pick() for _ in range(r.randint(0, 3))], r.choice([None, pick()])))
    texts = set()
    while len(texts) < 30:
        args = [random_query(r, 2) if r.random() < 0.9 else None for _ in range(r.randint(0, 3))]
        ret = None if r.random() < 0.2 else random_query(r, 2)
        texts.add("(" + ", ".join(map(spell, args)) + ")" + ("" if ret is None else " -> " + spell(ret)))
    texts |= {"()", "(i32) -> bool", "(..) -> bool", "(_, _)", "(_) -> _", "fn get1(_) -> _", "fn get1(i32) -> bool", "(a0: _, b: u8)", "(Foo) -> Option<T>",
              "fn gets2", "(&&&&&u8, &&u8) -> &&&u8", "([u8]) -> !", "((i32, bool)) -> Fooo"}
    directory = write_index(folder, {"pkg": document(docs)})
    tables = read_crate_files(spark, directory)
    scopes = make_scopes(read_sets(spark, directory), tables["crates"])
    return (tables, build_catalog(tables["items"], tables["paths"], str(folder / "catalog")), scopes), sorted(texts)


def hits(rows, *cols):
    return sorted(tuple(r) for r in rows.select("text", "scope", "crate", "item_id", F.round("score", 6), *cols).collect())


@pytest.mark.parametrize("threshold", [0.4, 0.75])
def test_index_changes_nothing(trees, asks, threshold):
    (_, catalog, scopes), texts = trees
    queries = asks(*texts)
    plain = hits(se.search(queries, catalog, scopes, threshold, k=None, use_index=False))
    assert hits(se.search(queries, catalog, scopes, threshold, k=None, use_index=True)) == plain and plain
    for k in (12,) if threshold == 0.4 else ():
        best = hits(se.search(queries, catalog, scopes, threshold, k=k, use_index=False), "rank")
        assert hits(se.search(queries, catalog, scopes, threshold, k=k, use_index=True), "rank") == best


def counted(asked, catalog, threshold, limits=None):
    index = catalog.index()
    texts = asked.texts.withColumn("limit", F.lit(threshold)) if limits is None else asked.texts.join(limits, "text_id")
    features = ix.text_features(texts, ix.near_type_names(al.query_side(texts), index.type_names, threshold))
    return ix.meet(index.postings, ix.prefixes(features, index.counts, threshold).unionByName(ix.named_only(texts, features)), 4)


def test_pairs_are_fewer_and_hold_all_below(trees, asks):
    (_, catalog, scopes), texts = trees
    asked = se.look_at(asks(*texts))
    every = se.signature_scores(asked.texts, catalog.sigs.repartition(4, "sig_id"), catalog.alias_depth)
    n_every = every.count()
    for threshold in (0.2, 0.4):
        met = counted(asked, catalog, threshold)
        below = every.join(se._wants(asked.texts), "text_id").filter(se._below("s", "c + size(q_args) + IF(q_name IS NULL, 0, 1)", threshold))
        assert below.join(met, ["text_id", "sig_id"], "left_anti").count() == 0
        assert below.count() < met.count() < 0.6 * n_every, (threshold, below.count(), met.count(), n_every)


def test_bound_of_a_first_share(trees, asks, spark):
    (_, catalog, scopes), texts = trees
    asked = se.look_at(asks(*texts))
    first = spark.createDataFrame(
        [(r.text_id, r.scope, "pkg", str(n), "", 0.0, 1, 0.1 + n / 100) for r in asked.asks.collect() for n in range(3)],
        "text_id binary, scope string, crate string, item_id string, impl_id string, s double, c long, score float")
    limits = se.reached(asked, first, 0.4, 3)
    assert {round(r.limit, 3) for r in limits.collect()} == {0.12}
    assert {r.limit for r in se.reached(asked, first, 0.4, 4).collect()} == {0.4}
    assert counted(asked, catalog, 0.4, limits).count() < counted(asked, catalog, 0.4).count()


def test_the_bound_of_a_simple_text(trees, asks):
    """Two roots: the rarer one decides; a name lets a pair off one root more."""
    (_, catalog, _), _ = trees
    asked = se.look_at(asks("(u8) -> bool", "fn get1(u8) -> bool"))
    index = catalog.index()
    texts = asked.texts.withColumn("limit", F.lit(0.4))
    features = ix.text_features(texts, ix.near_type_names(al.query_side(texts), index.type_names, 0.4))
    looked = ix.prefixes(features, index.counts, 0.4)
    slots = {}
    for r in looked.join(asked.texts, "text_id").filter("steps = 0").select("text", "feature").collect():
        slots.setdefault(r.text, set()).add(r.feature.split("|")[0])
    assert len(slots["(u8) -> bool"]) == 1 and len(slots["fn get1(u8) -> bool"]) == 2
