import json
import random

from sigsearch.llm import tools

CALLS = "conv_id long, call_id string, turn long, name string, arguments string, after array<string>, level int"
RESULTS = "conv_id long, call_id string, turn long, content string"
SCHEMA = "name string, field string, type string, required boolean"


def depth(after, ids):
    level = {}
    while True:
        ready = [c for c in ids if c not in level and all(a in level for a in after[c] if a in ids)]
        if not ready:
            return level
        level |= {c: max((level[a] + 1 for a in after[c] if a in ids), default=0) for c in ready}


def test_levels_are_topological(spark):
    rng = random.Random(12)
    calls = [(1, f"c{i}", i, "t", "{}", [f"c{rng.randrange(i)}" for _ in range(rng.randrange(3))] if i else None, 9) for i in range(60)]
    calls += [(2, f"c{i}", i, "t", "{}", [f"c{i - 1}"], 9) for i in range(12)]  # a chain
    calls += [(3, "a", 1, "t", "{}", ["b"], 9), (3, "b", 2, "t", "{}", ["a"], 9), (3, "c", 3, "t", "{}", ["b", None], 9), (3, "d", 4, "t", "{}", ["zz"], 9)]
    found = {(r.conv_id, r.call_id): r.level for r in tools.levels(spark.createDataFrame(calls, CALLS)).collect()}
    want = {}
    for conv in (1, 2, 3):
        after = {c[1]: [a for a in c[5] or []] for c in calls if c[0] == conv}
        want |= {(conv, c): n for c, n in depth(after, set(after)).items()}
    assert found == want and (3, "a") not in found and (3, "d") in found


def test_long_chains_take_few_rounds(spark, monkeypatch):
    """A chain of 500 calls, one that starts in a ring, and one with calls that use several."""
    calls = [(1, f"c{i}", i, "t", "{}", [f"c{i - 1}"] * 2, 9) for i in range(500)]
    calls += [(2, f"c{i}", i, "t", "{}", [f"c{max(i - 1, 0)}"], 9) for i in range(40)]  # the first uses itself
    calls += [(3, f"c{i}", i, "t", "{}", [f"c{i - 1}", f"c{i - 30}"] if i % 20 == 0 else [f"c{i - 1}"], 9) for i in range(100)]
    calls += [(3, "x", 200, "t", "{}", ["c99", "y"], 9), (3, "y", 201, "t", "{}", ["z"], 9), (3, "z", 202, "t", "{}", ["y"], 9)]
    names = []
    whole = tools.written
    monkeypatch.setattr(tools, "written", lambda df, name: names.append(name) or whole(df, name))
    found = {(r.conv_id, r.call_id): r.level for r in tools.levels(spark.createDataFrame(calls, CALLS)).collect()}
    want = {}
    for conv in (1, 2, 3):
        after = {c[1]: c[5] for c in calls if c[0] == conv}
        want |= {(conv, c): n for c, n in depth(after, set(after)).items()}
    assert found == want and found[1, "c499"] == 499 and (2, "c5") not in found and (3, "x") not in found
    assert names.count("jumps") <= 12 and names.count("level") <= 7


def test_calls_are_linked_checked_and_canonical(spark):
    calls = [
        (1, "a", 1, "search", '{ "q" : "é\\n\\"x\\"", "n":3, "deep":{"b":[1, 2],"a":null} }', [], 0),
        (1, "b", 3, "search", '{"n":"many"}', ["a"], 0),
        (1, "c", 5, "search", "no json", ["a"], 0), (1, "d", 5, "unheard", "{}", None, 0), (1, "e", 6, "search", "[1]", [], 0),
        (1, "f", 7, None, None, [], 0), (1, "a", 9, "search", '{"q":"later"}', [], 0), (None, "a", 1, "search", '{"q":"x","n":1.5}', [], 0),
        (2, "g", 1, "search", '{"q":"x","n":2,"flag":1,"deep":null}', ["g2"], 0), (2, "g2", 1, "search", '{"q":"y"}', ["g"], 0),
    ]
    results = [(1, "a", 4, "second"), (1, "a", 2, "first"), (1, "zz", 5, None), (None, "a", 2, "no conversation"), (1, "b", 4, "late")]
    schemas = [("search", "q", "string", True), ("search", "n", "integer", False), ("search", "deep", "object", False), ("other", "x", "string", True)]
    rows = tools.format_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), spark.createDataFrame(schemas, SCHEMA)).collect()
    found = {(r.conv_id, r.call_id, r.turn): r for r in rows}
    assert {k: (r.level, r.status, r.valid, r.errors) for k, r in found.items()} == {
        (1, "a", 1): (0, "linked", True, ""), (1, "b", 3): (1, "linked", False, "missing q; type n"),
        (1, "c", 5): (1, "unanswered", False, "not an object"), (1, "d", 5): (0, "unanswered", False, "no tool unheard"),
        (1, "e", 6): (0, "unanswered", False, "not an object"), (1, "f", 7): (0, "unanswered", False, "no tool "),
        (1, "zz", None): (None, "stray", True, ""), (None, "a", 1): (None, "unanswered", False, "type n"), (None, "a", None): (None, "stray", True, ""),
        (2, "g", 1): (None, "cycle", False, "type deep; unknown flag"), (2, "g2", 1): (None, "cycle", True, "")}
    for r in rows:
        line = json.loads(r.line)
        assert r.line == json.dumps(line, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    first = json.loads(found[1, "a", 1].line)
    assert first["arguments"] == {"q": 'é\n"x"', "n": 3, "deep": {"b": [1, 2], "a": None}} and first["result"] == "first"
    assert json.loads(found[1, "c", 5].line)["arguments"] == "no json"


def test_rows_with_null_keys_each_give_a_row(spark):
    keys = [(1, None), (1, None), (1, None), (None, "a"), (None, "a"), (None, None), (None, None)]
    calls = [(*k, n // 2, "search", "{}", None, 0) for n, k in enumerate(keys)] + [(1, "a", 1, "search", "{}", None, 0)]
    results = [(*k, n // 2, "text") for n, k in enumerate(keys)] + [(1, "a", 2, "text")]
    rows = tools.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS)).collect()
    found = sorted(((r.conv_id, r.call_id, r.turn, r.result_turn, r.status) for r in rows), key=str)
    want = [(*k, n // 2, None, "unanswered") for n, k in enumerate(keys)] + [(*k, None, n // 2, "stray") for n, k in enumerate(keys)]
    assert found == sorted([*want, (1, "a", 1, 2, "linked")], key=str)


def test_empty_tables(spark):
    empty = tools.format_calls(spark.createDataFrame([], CALLS), spark.createDataFrame([], RESULTS), spark.createDataFrame([], SCHEMA))
    assert empty.collect() == []
