"""Chat formatting with DataFrame functions only: tool calls are linked to results, ordered, validated and written as canonical JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrivane.llm.common import materialise, tidy

#: Tools by name: each argument's (name, JSON type, required).
SCHEMAS = {"reply": (("prompt", "string", True), ("turn", "integer", True))}
# How the JSON types appear in the schema of a parsed value.
TYPES = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|DECIMAL.*", "boolean": "BOOLEAN", "object": "OBJECT.*", "array": "ARRAY.*"}


def depths(calls: DataFrame) -> DataFrame:
    """(conv, call, depth): the most calls that stand in a row before each, along (conv, call, after); null on and behind cycles.

    A call after one that doesn't exist, or after none, is a root. Calls with one predecessor are followed by pointers whose
    stretch each round doubles, up to a root or a call with several predecessors; so rounds grow with the logarithm of the
    longest chain. Only calls with several predecessors are then taken in order, in as many rounds as stand in a row.
    """
    with tidy(calls.sparkSession):
        return materialise(_depths(calls), "depths", lasting=True)


def _depths(calls: DataFrame) -> DataFrame:
    key = ["conv", "call"]
    nodes = calls.select(*key).distinct()
    edges = calls.where(F.col("after").isNotNull()).select(*key, "after").distinct()
    edges = materialise(edges.join(nodes.withColumnRenamed("call", "after"), ["conv", "after"], "left_semi").select(*key, "after"), "edges")
    before = edges.groupBy(*key).agg(F.count("*").alias("n"), F.min("after").alias("after"))
    single = F.col("n") == 1
    now = nodes.join(before, key, "left").select(*key, F.when(single, F.col("after")).otherwise(F.col("call")).alias("at"), F.when(single, 1).otherwise(0).cast("long").alias("far"), F.coalesce(~single, F.lit(True)).alias("ends"), F.coalesce("n", F.lit(0)).alias("n"))
    now = materialise(now, "depths")
    n, left = now.agg(F.count("*"), F.count_if(~F.col("ends"))).first()
    # After so many rounds a pointer spans more calls than there are; what hasn't ended then is on a cycle or behind one.
    for _ in range(n.bit_length()):
        if not left:
            break
        further = now.select("conv", F.col("call").alias("at"), F.col("at").alias("next"), F.col("far").alias("more"), F.col("ends").alias("done"))
        step = now.join(further, ["conv", "at"]).select(*key, F.col("next").alias("at"), (F.col("far") + F.col("more")).alias("far"), F.col("done").alias("ends"), "n")
        now = materialise(step, "depths")
        left = now.agg(F.count_if(~F.col("ends"))).first()[0]
    found = now.where("call = at and n = 0").select(*key, F.lit(0).cast("long").alias("depth"))
    joins = materialise(now.where("n > 1").select(*key), "joins")
    waiting, left = joins, joins.count()
    found = materialise(found, "found") if left else found
    of = now.where("ends").select("conv", F.col("call").alias("after"), "at", (F.col("far") + 1).alias("far"))
    ways = materialise(edges.join(joins, key, "left_semi").join(of, ["conv", "after"], "left").select(*key, "at", "far"), "ways") if left else None
    while left:  # a call's turn comes when all calls that it waits for are known
        known = found.select("conv", F.col("call").alias("at"), "depth")
        ready = ways.join(waiting, key, "left_semi").join(known, ["conv", "at"], "left").groupBy(*key).agg(F.bool_and(F.col("depth").isNotNull()).alias("all"), F.max(F.col("depth") + F.col("far")).alias("depth"))
        ready = materialise(ready.where("all").select(*key, "depth"), "ready")
        more = ready.count()
        if not more:
            break
        found, left = materialise(found.unionByName(ready), "found"), left - more
        waiting = materialise(waiting.join(ready, key, "left_anti"), "waiting")
    ends = found.select("conv", F.col("call").alias("at"), "depth")
    return now.join(ends, ["conv", "at"], "left").select(*key, F.when(F.col("ends"), F.col("depth") + F.col("far")).alias("depth"))


def faults(name: Column, arguments: Column, parsed: Column, schemas: dict) -> Column:
    """What is wrong with a call's arguments, as sorted texts; empty if nothing is."""
    kinds = F.schema_of_variant(parsed)
    found = [F.when(parsed.isNull() | ~F.startswith(kinds, F.lit("OBJECT")), F.array(F.lit("arguments: not an object")))]
    for tool, fields in schemas.items():
        own = []
        for field, kind, required in fields:
            value = F.try_variant_get(parsed, f"$.{field}", "variant")
            is_null = value.isNull() | (F.schema_of_variant(value) == "VOID")
            wrong = ~F.schema_of_variant(value).rlike(f"^(?:{TYPES[kind]})$")
            own.append(F.when(is_null, F.lit(f"{field}: missing") if required else F.lit(None)).when(wrong, F.lit(f"{field}: not {kind}")))
        extra = F.array_except(F.coalesce(F.json_object_keys(arguments), F.array().cast("array<string>")), F.array(*(F.lit(f[0]) for f in fields)))
        own_faults = F.array_compact(F.array(*own))
        found.append(F.when(name == tool, F.array_sort(F.concat(own_faults, F.transform(extra, lambda k: F.concat(k, F.lit(": unknown")))))))
    return F.coalesce(*found, F.array(F.lit("name: unknown")))


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """(conv_id, call_id, position, name, status, faults, json): one row for each call and result that belong together, and for
    each of either that stands alone. Nothing is lost.

    calls: conv_id, call_id, name, arguments (JSON text), after (the call_id that must come first, an array of them, or
    null). results: conv_id, call_id, content. Both are hash-joined by conversation and identifier. Equal rows of one
    identifier are one, counted by n_calls and n_results in the JSON, which count all of the identifier. Of several calls the
    smallest gets the results, one row for each; the others have the status repeated. position is the call's
    place in a topological order of its conversation, null on cycles and for results without a call; calls of equal position
    are free of each other. status: ok, invalid (faults say why), pending (valid without a result), repeated, or
    orphan. json has sorted keys and no white space.

    Null identifiers link to nothing: such calls are pending or invalid, such results orphans, and they are kept row by
    row. Very long contents are written whole. Empty tables give an empty result; other columns are ignored, whatever their names.
    """
    key = ["conv", "call"]
    many = isinstance(calls.schema["after"].dataType, T.ArrayType)
    calls = calls.select(F.col("conv_id").alias("conv"), F.col("call_id").alias("call"), "name", "arguments", "after")
    results = results.select(F.col("conv_id").alias("conv"), F.col("call_id").alias("call"), "content")
    named = F.col("conv").isNotNull() & F.col("call").isNotNull()
    each = calls.where(named).groupBy(*key, "name", "arguments").agg(F.count("*").alias("m"))
    firsts = each.groupBy(*key).agg(F.min(F.struct("name", "arguments")).alias("v"), F.sum("m").alias("n_calls"), F.count("*").alias("kinds"))
    contents = results.where(named).groupBy(*key, "content").agg(F.count("*").alias("m"))
    sums = contents.groupBy(*key).agg(F.sum("m").alias("n_results"))
    before = calls.where(named).select(*key, F.explode_outer("after").alias("after") if many else "after")
    c = materialise(firsts.join(sums, key, "left").join(depths(before), key), "calls")
    head = [*key, F.col("v.name").alias("name"), F.col("v.arguments").alias("arguments"), "n_calls"]
    none = lambda kind: F.lit(None).cast(kind)
    linked = c.where("n_results is not null").join(contents, key).select(*head, "content", "n_results", "depth", F.lit(False).alias("again"))
    alone = c.where("n_results is null").select(*head, none("string").alias("content"), "n_results", "depth", F.lit(False).alias("again"))
    others = each.join(c.where("kinds > 1").select(*key, "v", "n_calls", "depth"), key).where(~(F.struct("name", "arguments").eqNullSafe(F.col("v"))))
    others = others.select(*key, "name", "arguments", "n_calls", none("string").alias("content"), none("long").alias("n_results"), "depth", F.lit(True).alias("again"))
    orphans = contents.join(c.select(*key), key, "left_anti").join(sums, key)
    orphans = orphans.select(*key, none("string").alias("name"), none("string").alias("arguments"), none("long").alias("n_calls"), "content", "n_results", none("long").alias("depth"), F.lit(False).alias("again"))
    lone_calls = calls.where(~named).select(*key, "name", "arguments", F.lit(1).cast("long").alias("n_calls"), none("string").alias("content"), none("long").alias("n_results"), F.lit(0).cast("long").alias("depth"), F.lit(False).alias("again"))
    lone_results = results.where(~named).select(*key, none("string").alias("name"), none("string").alias("arguments"), none("long").alias("n_calls"), "content", F.lit(1).cast("long").alias("n_results"), none("long").alias("depth"), F.lit(False).alias("again"))
    both = linked.unionByName(alone).unionByName(others).unionByName(orphans)
    rows = both.unionByName(lone_calls).unionByName(lone_results).withColumn("parsed", F.try_parse_json("arguments"))
    rows = rows.withColumn("faults", F.when(F.col("n_calls").isNotNull(), faults(F.col("name"), F.col("arguments"), F.col("parsed"), schemas)))
    status = F.when(F.col("n_calls").isNull(), "orphan").when(F.col("again"), "repeated").when(F.size("faults") > 0, "invalid").when(F.col("n_results").isNull(), "pending").otherwise("ok")
    # A parsed object keeps its keys sorted; to_json leaves out what is null.
    body = F.to_json(F.struct(F.coalesce("parsed", F.try_parse_json(F.to_json(F.col("arguments").cast("variant")))).alias("arguments"), F.col("call").alias("call_id"), F.col("content"), "faults", "n_calls", "n_results", "name", F.col("depth").alias("position"), "status"))
    return rows.withColumn("status", status).select(F.col("conv").alias("conv_id"), F.col("call").alias("call_id"), F.col("depth").alias("position"), "name", "status", "faults", body.alias("json"))


def turns_as_calls(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A conversation's turns as calls and results: a user's turn calls reply, an assistant's answers the turn before it.

    The identifier is the user's turn number; a call comes after the user's turn two before. Turns of other roles are
    neither; messages() writes them.
    """
    turn = F.col("turn").cast("long")
    role = F.lower("role")
    arguments = F.to_json(F.struct(F.col("text").alias("prompt"), turn.alias("turn")))
    calls = df.where(role == "user").select("conv_id", turn.cast("string").alias("call_id"), F.lit("reply").alias("name"), arguments.alias("arguments"), (turn - 2).cast("string").alias("after"))
    results = df.where(role == "assistant").select("conv_id", (turn - 1).cast("string").alias("call_id"), F.col("text").alias("content"))
    return calls, results


def messages(df: DataFrame) -> DataFrame:
    """The turns that are neither a user's nor an assistant's, as rows like link_calls' with status message."""
    body = F.to_json(F.struct(F.col("text").alias("content"), "role", F.lit("message").alias("status"), "turn"))
    none = F.lit(None)
    return df.where(F.coalesce(~F.lower("role").isin("user", "assistant"), F.lit(True))).select(
        "conv_id", F.col("turn").cast("string").alias("call_id"), none.cast("long").alias("position"), none.cast("string").alias("name"), F.lit("message").alias("status"), none.cast("array<string>").alias("faults"), body.alias("json")
    )
