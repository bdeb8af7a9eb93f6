import random

import pytest
from conftest import document, fn, gen, path, prim
from pyspark.sql import functions as F

from checks import queries as qu
from sigsearch.functions.names import letters
from sigsearch.operators import joins, scope
from sigsearch.operators.topk import first_per
from sigsearch.plans import search as se
from sigsearch.plans.catalog import callables, impls, members


@pytest.fixture
def many(load):
    r = random.Random(3)
    types = [prim("i32"), prim("bool"), gen("T"), path("Vec", gen("T"))]
    docs = {}
    for c in ("pkg", "two", "six"):
        # A third of all functions share one signature.
        docs[c] = document([
            fn(f"{c}{n}", r.choice(["get", "set", "got", "gets", "push"]),
               [] if n % 3 == 0 else [r.choice(types) for _ in range(r.randint(0, 2))], r.choice([None, None, prim("i32")]))
            for n in range(60)
        ])
    return load(docs, {"both": ["pkg", "two"]})


TEXTS = ["()", "(i32) -> i32", "(T)", "fn get", "fn gets(i32)", "(a0: i32)", "(..) -> i32", "fn nothing_like_it", "x y", "(i32 ,)"]


def rows(hits, *cols):
    return sorted(tuple(r) for r in hits.select("text", "scope", "crate", "item_id", F.round("score", 5), *cols).collect())


def test_limits_agree_with_all_hits(many, asks, spark):
    _, catalog, scopes = many
    queries = asks(*TEXTS, scope="set:both").unionByName(asks(*TEXTS, scope="crate:six"))
    every = rows(se.search(queries, catalog, scopes, k=100_000), "rank")
    assert rows(se.search(queries, catalog, scopes, k=None)) == sorted(r[:-1] for r in every)
    for k in (1, 7):
        assert rows(se.search(queries, catalog, scopes, k=k), "rank") == [r for r in every if r[-1] <= k]
    assert {r[2] for r in every if r[1] == "set:both"} == {"pkg", "two"}
    assert {r[2] for r in every if r[1] == "crate:six"} == {"six"}
    assert rows(se.search(queries, catalog, scopes, k=7, prefilter=False), "rank") == [r for r in every if r[-1] <= 7]


def test_splitting_and_slicing_change_nothing(many, asks, monkeypatch):
    _, catalog, scopes = many
    queries = asks(*TEXTS, scope="set:both")
    expected = rows(se.search(queries, catalog, scopes, k=None))
    limited = rows(se.search(queries, catalog, scopes))
    split = joins.split_hot_keys
    monkeypatch.setattr(se, "split_hot_keys", lambda l, r, on, by: split(l, r, on, by, rows_per_key=3))
    monkeypatch.setattr(se, "pieces", lambda df, key: joins.pieces(df, key, 3000))
    assert len(joins.pieces(se.prepare(queries), "text_id", 3000)) > 1
    monkeypatch.setattr(se, "fits", lambda df, limit=0: False)
    monkeypatch.setattr(scope, "fits", lambda df, limit=0: False)
    assert rows(se.search(queries, catalog, scopes, k=None)) == expected
    assert rows(se.search(queries, catalog, scopes)) == limited


@pytest.fixture
def overlapping(many, spark):
    """Scopes of the packages of ``many``, all of which share packages; some packages have no functions."""
    _, catalog, scopes = many
    rows = [(f"set:s{i}", c) for i in range(12) for n, c in enumerate(("pkg", "two", "six", "none")) if (i + 1) >> n & 1]
    return catalog, scopes.unionByName(spark.createDataFrame(rows, "scope string, crate string"))


def test_bitmaps_of_scopes_change_nothing(overlapping, asks, monkeypatch):
    catalog, scopes = overlapping
    texts = ["()", "(i32) -> i32", "fn gets(i32)", "fn get"]
    queries = asks(*texts, scope="set:both")
    for s in ["crate:six", "set:none", None, *[f"set:s{i}" for i in range(12)]]:
        queries = queries.unionByName(asks(*texts, scope=s))
    monkeypatch.setattr(se, "shared_much", lambda fns, used: False)
    every = rows(se.search(queries, catalog, scopes, k=100_000), "rank")
    assert len({r[1] for r in every}) == 14 - 1  # one set has only a package that is not there
    monkeypatch.setattr(se, "shared_much", lambda fns, used: True)
    assert rows(se.search(queries, catalog, scopes, k=None)) == sorted(r[:-1] for r in every)
    best = [r for r in every if r[-1] <= 4]
    assert rows(se.search(queries, catalog, scopes, k=4, use_index=True), "rank") == best
    # no bit is lost where packages lie in several bitmaps and a join is split
    monkeypatch.setattr(scope, "BITS", 2)
    split = joins.split_hot_keys
    monkeypatch.setattr(scope, "split_hot_keys", lambda l, r, on, by: split(l, r, on, by, rows_per_key=2))
    monkeypatch.setattr(scope, "fits", lambda df, limit=0: False)
    assert rows(se.search(queries, catalog, scopes, k=4), "rank") == best


def test_overlapping_scopes_copy_no_functions(overlapping, monkeypatch):
    catalog, scopes = overlapping
    sizes = {}
    for n in (2, 12):
        used = scope.asked_packages(scopes, scopes.filter(F.col("scope").isin([f"set:s{i}" for i in range(12 - n, 12)])))
        sizes[n] = scope.scope_maps(catalog.fns, used).fns.count(), scope.copied(catalog.fns, used).count()
    assert sizes[2][0] == sizes[12][0] == 180 and sizes[2][1] < sizes[12][1]
    maps = scope.scope_maps(catalog.fns, used).maps.collect()
    assert len(maps) == 12 and all(len(m.bits) == 1 for m in maps)
    assert scope.copies(catalog.fns, used) == (180, sizes[12][1])
    assert not scope.shared_much(catalog.fns, used)
    monkeypatch.setattr(scope, "COPIES", 361)
    assert scope.shared_much(catalog.fns, used)
    alone = used.filter("scope = 'set:s6'")
    assert not scope.shared_much(catalog.fns, alone)


def test_log_answers_and_rejects(many, asks):
    _, catalog, scopes = many
    log = asks("()", "()", "(i32 ,)", scope="crate:six")
    hits = se.search(log, catalog, scopes, k=2)
    got = sorted((r.query_id, r.rank) for r in se.answers(log, hits).collect())
    assert got == [(0, 1), (0, 2), (1, 1), (1, 2)]
    assert [r.query_id for r in se.rejected_queries(log).collect()] == [2]


def test_nothing_to_do(many, asks):
    _, catalog, scopes = many
    assert se.search(asks("(i32 ,)"), catalog, scopes).count() == 0


@pytest.mark.parametrize("threshold", [0.2, 0.4, 0.75, 1.0])
def test_near_names_is_whole(spark, threshold):
    r = random.Random(5)
    words = {"".join(r.choice("abcé_1Z") for _ in range(r.randint(1, 12))) for _ in range(300)}
    asked = sorted(w for w in words if w.isascii())[:80]
    names = spark.createDataFrame([(w,) for w in words], "name string").withColumn("letters", letters("name"))
    texts = spark.createDataFrame([(w, w) for w in asked], "text_id string, q_name string")
    got = [
        sorted((x.text_id, x.name, round(x.d, 6)) for x in se.near_names(texts, names, threshold, prefilter).collect())
        for prefilter in (True, False)
    ]
    assert got[0] == got[1]
    dist = names.crossJoin(texts).filter(
        F.expr(f"cast(levenshtein(q_name, name) / greatest(octet_length(q_name), octet_length(name)) AS float) < cast({threshold} AS float)"))
    assert len(got[0]) == dist.count() > 0


def test_first_per_is_limited_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 2 AS g", "id")
    best = first_per(df, ["g"], ["id"], 3)
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert sorted(r.id for r in best.collect()) == [0, 1, 2, 3, 4, 5]


def test_split_hot_keys(spark):
    left = spark.range(1000).selectExpr("if(id < 700, 0, id) AS k", "id")
    right = spark.range(0, 1000, 100).selectExpr("id AS k", "concat('v', id) AS v").union(spark.sql("SELECT 0L, 'w'"))
    got = joins.split_hot_keys(left, right, ["k"], "id", rows_per_key=50)
    assert sorted(got.collect()) == sorted(left.join(right, "k").collect())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_split_hot_keys_sends_no_side_around(many):
    """Files of these tables are small enough for Spark to broadcast them; rows in memory may not be."""
    _, catalog, _ = many
    fns, sigs = catalog.fns.select("crate", "item_id", "sig_id"), catalog.sigs.select("sig_id", "nodes")
    expected = sorted(map(str, fns.join(sigs, "sig_id").collect()))
    whole = joins.split_hot_keys(fns, sigs, ["sig_id"], "item_id")
    assert "Broadcast" not in plan_of(whole) and "SortMergeJoin [sig_id" in plan_of(whole)
    parts = joins.split_hot_keys(fns, sigs, ["sig_id"], "item_id", rows_per_key=5)
    assert "BroadcastHashJoin [sig_id" in plan_of(parts)  # the hot keys, which were measured
    assert plan_of(parts).count("BroadcastExchange") == 2 and "SortMergeJoin [sig_id" in plan_of(parts)
    assert sorted(map(str, whole.collect())) == sorted(map(str, parts.collect())) == expected


def test_catalogue_tables_are_not_sent_around(many):
    tables, _, _ = many
    items, paths = tables["items"], tables["paths"]
    for found in (callables(items, paths), members(impls(items), items)):
        assert "Broadcast" not in plan_of(found)


def test_bindings_per_function_move_by_signature(spark, tmp_path, monkeypatch):
    rows = [(i, "blue bolt", f"Brand#{i % 3}" if i % 17 else None, "PROMO" if i % 4 else "LARGE", 8 * (i % 5) + 1) for i in range(60)]
    part = spark.createDataFrame(rows + rows[:7], "p_partkey long, p_name string, p_brand string, p_type string, p_size int")
    part.write.parquet(f"{tmp_path}/part.parquet")
    for name in ("generic_binding", "flattened_nodes"):
        query = qu.QUERIES[name]
        with monkeypatch.context() as m:
            m.setattr(qu, "split_hot_keys", lambda l, r, on, by: l.join(r, on), raising=False)
            expected = sorted(map(str, query(spark, str(tmp_path)).collect()))
        found = query(spark, str(tmp_path))
        assert "SortMergeJoin [sig_id" in plan_of(found) and "BroadcastHashJoin [sig_id" not in plan_of(found)
        split = joins.split_hot_keys
        with monkeypatch.context() as m:
            m.setattr(qu, "split_hot_keys", lambda l, r, on, by: split(l, r, on, by, rows_per_key=1))
            parts = query(spark, str(tmp_path)).collect()
        assert expected and sorted(map(str, found.collect())) == sorted(map(str, parts)) == expected


def test_scores_stay_below_one_shuffle(many, asks):
    """From signatures to sums nothing is moved but the signatures themselves."""
    _, catalog, _ = many
    texts = se.prepare(asks(*TEXTS))
    pairs = se.signature_scores(texts, catalog.sigs.repartition(8, "sig_id"), 0)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "SortMergeJoin" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_strict_refuses(many, asks, spark):
    tables, catalog, scopes = many
    crates = tables["crates"]
    assert se.search(asks("()", scope="set:both"), catalog, scopes, strict=crates).count() > 0
    for scope_ in ("set:bth", "crate:none", "both", "crate:six:x", None):
        with pytest.raises(ValueError):
            se.search(asks("()", scope=scope_), catalog, scopes, strict=crates)
    more = scopes.unionByName(spark.createDataFrame([("set:more", "pkg"), ("set:more", "gone")], "scope string, crate string"))
    with pytest.raises(ValueError, match="unknown crate gone"):
        se.search(asks("()", scope="set:more"), catalog, more, strict=crates)


def test_strict_refuses_quarantined_packages(load, asks):
    bad = document([fn("f", "f", []), fn("g", "g", [])])
    del bad["paths"]["g"]
    tables, catalog, scopes = load({"pkg": bad, "good": document([fn("h", "h", [])])})
    assert se.search(asks("()", scope="crate:good"), catalog, scopes, strict=tables["crates"]).count() == 1
    with pytest.raises(ValueError, match="quarantine"):
        se.search(asks("()"), catalog, scopes, strict=tables["crates"])
    assert se.search(asks("()"), catalog, scopes).count() == 1
