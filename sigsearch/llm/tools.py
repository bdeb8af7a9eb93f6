"""Tool calls of conversations, linked to their results, ordered, checked and written as canonical JSON.

Calls and results meet in a hash join on conversation and identifier.  Calls that use other calls' results come
after these: chains are passed over by doubled pointers, what is left is placed round by round, over a table of open
dependencies, so that a conversation may be of any length.  All of it is DataFrame expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigsearch.llm.common import written

KEY = ["conv_id", "call_id"]


def link(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Calls with their results, one row for each call and for each result without one.

    ``calls``: conv_id, call_id, turn, name, arguments (JSON text), after (ids of the calls it uses); ``results``:
    conv_id, call_id, turn, content.  ``status`` is ``linked``, ``unanswered`` or ``stray``.  Of several results
    of a call the first by (turn, content) counts; of several calls with one id the first by (turn, name,
    arguments) does.  Rows with a null conversation or id link to nothing, and each of
    them gives a row.
    """
    named = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    # the rows that count are found by an aggregate, which is partial before the exchange: no sorted groups
    first_call = calls.where(named).groupBy(*KEY).agg(F.min(F.struct("turn", "name", "arguments", "after")).alias("c")).select(
        *KEY, F.lit(True).alias("_called"), "c.*")
    first_result = results.where(named).groupBy(*KEY).agg(F.min(F.struct("turn", "content")).alias("r")).select(
        F.col("conv_id").alias("_conv"), F.col("call_id").alias("_call"), F.lit(True).alias("_answered"),
        F.col("r.turn").alias("result_turn"), F.col("r.content").alias("content"))
    on = (F.col("conv_id") == F.col("_conv")) & (F.col("call_id") == F.col("_call"))
    both = first_call.join(first_result.hint("shuffle_hash"), on, "full_outer")
    status = F.when(F.col("_called") & F.col("_answered"), "linked").when(F.col("_called"), "unanswered").otherwise("stray")
    met = both.select(
        F.coalesce("conv_id", "_conv").alias("conv_id"), F.coalesce("call_id", "_call").alias("call_id"), "turn", "name",
        "arguments", "after", "result_turn", "content", status.alias("status"))
    # a null names nothing: each row without a whole key stands for itself
    loose = calls.where(~named).select(*KEY, "turn", "name", "arguments", "after", F.lit("unanswered").alias("status"))
    strays = results.where(~named).select(*KEY, F.col("turn").alias("result_turn"), "content", F.lit("stray").alias("status"))
    return met.unionByName(loose.unionByName(strays, allowMissingColumns=True), allowMissingColumns=True)


def chains(uses: DataFrame) -> DataFrame:
    """(conv_id, call_id, to, steps): calls that use a single one, with the call at the start of their chain and its distance.

    ``uses``: conv_id, call_id, used.  Pointers are doubled: each round looks twice as far, so a chain of n calls takes about
    log n rounds, and every call keeps one row.  Calls whose chain is a ring have no row.
    """
    single = uses.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.min("used").alias("to")).where("n = 1").select(*KEY, "to")
    ids = single.select("conv_id", F.col("call_id").alias("to"), F.lit(False).alias("done"))
    ends = F.coalesce("done", F.lit(True))  # a call that uses none or several is where a chain starts
    jumps = written(single.join(ids, ["conv_id", "to"], "left").select(*KEY, "to", F.lit(1).alias("steps"), ends.alias("done")), "jumps")
    n_done, before = jumps.where("done").count(), -1
    # while calls are on their way, some of them arrive in each round; the others go round in rings
    while n_done != before and not jumps.where("NOT done").isEmpty():
        on = jumps.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("_to"), F.col("steps").alias("_steps"), F.col("done").alias("_done"))
        far = jumps.where("NOT done").join(on, ["conv_id", "to"]).select(
            *KEY, F.col("_to").alias("to"), (F.col("steps") + F.col("_steps")).alias("steps"), F.col("_done").alias("done"))
        jumps = written(jumps.where("done").unionByName(far), "jumps")
        n_done, before = jumps.where("done").count(), n_done
    return jumps.where("done").drop("done")


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): one more than the highest level of the calls it uses, 0 without any.

    Ids in ``after`` that name no call of the conversation, nulls and repeats are left out; calls on a cycle, or
    behind one, have no row.  Chains of calls that use a single one are passed over by doubled pointers; the further rounds
    are as many as calls that use several others lie behind each other.
    """
    calls = calls.where(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull())
    uses = calls.select(*KEY, F.explode(F.array_distinct(F.coalesce("after", F.array().cast("array<string>")))).alias("used"))
    ids = calls.select("conv_id", F.col("call_id").alias("used"))
    uses = written(uses.join(ids, ["conv_id", "used"], "left_semi").select(*KEY, "used").distinct(), "uses")
    passed = written(chains(uses), "chains")
    found = [written(calls.select(*KEY).join(uses, KEY, "left_anti").distinct().withColumn("level", F.lit(0)), "level")]
    # what calls that use several wait for: starts of chains, or calls on rings, which are never found
    several = uses.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*KEY)
    rings = uses.join(several, KEY, "left_anti").join(passed, KEY, "left_anti").select("conv_id", F.col("call_id").alias("used"), F.lit(True).alias("ring"))
    behind = passed.select("conv_id", F.col("call_id").alias("used"), "to", "steps")
    waits = uses.join(several, KEY, "left_semi").join(behind, ["conv_id", "used"], "left").join(rings, ["conv_id", "used"], "left")
    waits = written(waits.select(
        *KEY, F.when(F.col("ring").isNull(), F.coalesce("to", "used")).alias("to"), (F.coalesce("steps", F.lit(0)) + 1).alias("steps"),
        F.lit(None).cast("int").alias("level")), "waits")
    while not waits.isEmpty():
        new = found[-1].select("conv_id", F.col("call_id").alias("to"), F.col("level").alias("_new"))
        waits = waits.join(new, ["conv_id", "to"], "left").select(
            *KEY, "to", "steps", F.coalesce("level", F.col("_new") + F.col("steps")).alias("level"))
        rated = waits.groupBy(*KEY).agg(F.max("level").alias("level"), F.count_if(F.col("level").isNull()).alias("waiting"))
        ready = written(rated.where("waiting = 0").select(*KEY, F.col("level").cast("int").alias("level")), "level")
        if ready.isEmpty():
            break
        found.append(ready)
        waits = written(waits.join(ready, KEY, "left_anti"), "waits")
    starts = reduce(DataFrame.unionByName, found)
    on_chains = passed.join(starts.select("conv_id", F.col("call_id").alias("to"), "level"), ["conv_id", "to"]).select(
        *KEY, (F.col("level") + F.col("steps")).cast("int").alias("level"))
    return starts.unionByName(on_chains)


def json_string(text: Column) -> Column:
    """A text as a JSON string."""
    one = F.to_json(F.array(text))
    return F.substring(one, F.lit(2), F.length(one) - 2)


def kind_of(value: Column) -> Column:
    """JSON Schema's name for the type of a variant."""
    name = F.schema_of_variant(value)
    return (F.when(name == "BIGINT", "integer").when(name.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "number").when(name == "STRING", "string")
            .when(name == "BOOLEAN", "boolean").when(name.startswith("ARRAY"), "array").when(name.startswith("OBJECT"), "object").otherwise("null"))


def validate(linked: DataFrame, schemas: DataFrame) -> DataFrame:
    """Add ``parsed`` (arguments as a variant) and ``errors``, a sorted list of texts, empty for valid arguments.

    ``schemas``: name, field, type, required.  Errors: ``not an object``, ``no tool NAME``, ``missing FIELD``, ``type
    FIELD``, ``unknown FIELD``.  An integer is a number too.  Strays have no errors.
    """
    spec = schemas.groupBy("name").agg(  # a tool's fields: as many as its schema lists
        F.collect_list(F.struct("field", "type", "required")).alias("_spec")).withColumnRenamed("name", "_tool")
    rows = linked.withColumn("parsed", F.try_parse_json("arguments"))
    rows = rows.join(spec, F.col("name") == F.col("_tool"), "left")
    is_object = kind_of(F.col("parsed")) == "object"
    fields = F.when(is_object, F.col("parsed").try_cast("map<string,variant>"))
    rows = rows.withColumn("_kinds", F.transform_values(fields, lambda _, v: kind_of(v)))
    missing = F.transform(F.filter("_spec", lambda s: s["required"] & ~F.map_contains_key("_kinds", s["field"])),
                          lambda s: F.concat(F.lit("missing "), s["field"]))
    wrong = F.transform(F.filter("_spec", lambda s: ~F.coalesce(
        (F.col("_kinds")[s["field"]] == s["type"]) | ((F.col("_kinds")[s["field"]] == "integer") & (s["type"] == "number")), F.lit(True))),
        lambda s: F.concat(F.lit("type "), s["field"]))
    names = F.transform("_spec", lambda s: s["field"])
    unknown = F.transform(F.filter(F.map_keys("_kinds"), lambda k: ~F.array_contains(names, k)), lambda k: F.concat(F.lit("unknown "), k))
    errors = F.when(F.col("status") == "stray", F.array().cast("array<string>")).when(
        F.col("_tool").isNull(), F.array(F.concat(F.lit("no tool "), F.coalesce("name", F.lit(""))))).when(
        ~F.coalesce(is_object, F.lit(False)), F.array(F.lit("not an object"))).otherwise(F.array_sort(F.concat(missing, wrong, unknown)))
    return rows.withColumn("errors", errors).drop("_tool", "_spec", "_kinds")


def canonical(rows: DataFrame) -> Column:
    """One call as JSON with sorted keys, without blanks; arguments that are no JSON stand as a string."""
    fields = {
        "arguments": F.coalesce(F.to_json("parsed"), json_string(F.col("arguments"))),
        "call": json_string(F.col("call_id")), "conversation": F.col("conv_id").cast("string"), "errors": F.to_json("errors"),
        "level": F.col("level").cast("string"), "name": json_string(F.col("name")), "result": json_string(F.col("content")),
        "status": json_string(F.col("status")),
    }
    parts = [F.concat(F.lit(f'"{k}":'), F.coalesce(v, F.lit("null"))) for k, v in sorted(fields.items())]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def format_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row for each call and each stray result: (conv_id, call_id, turn, level, status, valid, errors, line).

    Within a conversation the order by (level, turn, call_id) is topological; calls on or behind a cycle have no
    level and the status ``cycle``.  Empty tables give no rows; other columns are not read.
    """
    linked = written(link(calls, results), "linked")
    placed = levels(linked.where("status <> 'stray'")).select(
        F.col("conv_id").alias("_conv"), F.col("call_id").alias("_call"), "level")
    rows = validate(linked, schemas).join(
        placed, (F.col("conv_id") == F.col("_conv")) & (F.col("call_id") == F.col("_call")), "left")
    named = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    status = F.when((F.col("status") != "stray") & F.col("level").isNull() & named, "cycle").otherwise(F.col("status"))
    rows = rows.withColumn("status", status)
    return rows.select(
        "conv_id", "call_id", "turn", "level", "status", (F.size("errors") == 0).alias("valid"),
        F.array_join("errors", "; ").alias("errors"), canonical(rows).alias("line"))


# --- calls derived from plain conversations -------------------------------------------------------------
SCHEMAS = (
    ("search", "query", "string", True), ("search", "limit", "integer", True), ("lookup", "query", "string", True),
    ("lookup", "limit", "number", False), ("note", "query", "string", True), ("note", "done", "boolean", True),
)


def derived_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls from the turns of the assistant, results from the turns of users.

    A call asks for its turn's whole text, uses the call of half its turn's number, and is answered by the turn behind
    it.  By turn and conversation some arguments lack a field, have a wrong type or an unknown field.
    """
    turn, conv = F.col("turn"), F.col("conv_id")
    name = F.element_at(F.array(*map(F.lit, ("search", "lookup", "note", "erase"))), ((conv + turn) % 4 + 1).cast("int"))
    limit = F.when(turn % 5 == 4, F.lit("")).when(conv % 7 == 3, F.lit(', "limit": "many"')).otherwise(
        F.concat(F.lit(', "limit": '), (conv % 50).cast("string")))
    extra = F.when(conv % 11 == 5, F.lit(' "color": "red", ')).otherwise(F.lit(""))
    done = F.when(conv % 2 == 0, F.lit(', "done": true')).otherwise(F.lit(""))
    arguments = F.concat(F.lit("{ "), extra, F.lit('"query": '), json_string(F.coalesce("text", F.lit(""))), limit, done, F.lit(" }"))
    calls = conversations.where("role = 'assistant'").select(
        conv, F.concat(F.lit("c"), turn.cast("string")).alias("call_id"), turn, name.alias("name"), arguments.alias("arguments"),
        F.array(F.concat(F.lit("c"), F.floor(turn / 2).cast("string"))).alias("after"))
    calls = calls.withColumn("after", F.filter("after", lambda a: a != F.col("call_id")))
    results = conversations.where("role = 'user' and turn > 0").select(
        conv, F.concat(F.lit("c"), (turn - 1).cast("string")).alias("call_id"), turn, F.col("text").alias("content"))
    return calls, results
