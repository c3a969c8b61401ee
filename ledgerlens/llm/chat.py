"""Chat formatting: tool calls linked to their results.

Input are messages (conv_id, turn, role, text) whose assistant rows may carry
calls: call_id, tool, arguments (JSON text) and depends_on (ids of calls whose
results they use); tool rows carry result_id, the id of the call they answer.

Calls and results meet in a hash join by (conv_id, call id).  Calls are
ordered topologically: level 0 are those that depend on no call, every round
places the calls whose parents all are placed, one level above the highest;
one round a level, each written to the shared folder, counts only.  Arguments
are checked against the tool's schema and written as canonical JSON (keys
sorted, no white space, numbers in one form) by the VARIANT functions.  One
row a call: (topo_level, turn, call_id) orders a conversation, so a very long
conversation is never gathered.

Cases: calls without a result have none (null) and are marked; of several
results the one of the smallest turn (then text) counts; results without a
call and further results of a call are rows of ``unlinked``, each with its
error; a parent that is not a call of the conversation is ignored;
calls on a cycle, or behind one, have no level and are marked; arguments that
are null or no JSON object are errors, with canonical text null; null call
ids are no calls; calls with the same id in a conversation: the one of the
smallest turn counts; further columns, whatever their names, take no part; an
empty table gives no rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: A schema: argument -> (type, required, least, most); least and most bound a
#: number's value or a text's length and may be None.
Schema = dict[str, tuple[str, bool, float | None, float | None]]
KINDS = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DOUBLE", "DECIMAL", "FLOAT"),
         "boolean": ("BOOLEAN",), "array": ("ARRAY",), "object": ("OBJECT",)}


def errors(tool: Column, parsed: Column, schemas: dict[str, Schema]) -> Column:
    """Sorted array of what is wrong with a call's arguments."""
    found = F.array(F.lit("unknown tool"))
    for name, schema in schemas.items():
        tests = [F.lit(None).cast("string")]
        for arg, (kind, required, least, most) in schema.items():
            value = F.try_variant_get(parsed, f"$.{arg}", "variant")
            type_ = F.coalesce(F.schema_of_variant(value), F.lit("VOID"))
            absent = value.isNull() | (type_ == "VOID")
            right = F.lit(False)
            for prefix in KINDS[kind]:
                right = right | type_.startswith(prefix)
            tests.append(F.when(absent, F.lit(f"{arg}: missing") if required else None).when(~right, f"{arg}: not {kind}"))
            size = (F.char_length(F.try_variant_get(parsed, f"$.{arg}", "string")) if kind == "string"
                    else F.try_variant_get(parsed, f"$.{arg}", "double"))
            if least is not None:
                tests.append(F.when(~absent & right & (size < least), f"{arg}: below {least}"))
            if most is not None:
                tests.append(F.when(~absent & right & (size > most), f"{arg}: above {most}"))
        found = F.when(tool == name, F.array_sort(F.array_compact(F.array(*tests)))).otherwise(found)
    return (F.when(parsed.isNull(), F.array(F.lit("not JSON")))
            .when(~F.schema_of_variant(parsed).startswith("OBJECT"), F.array(F.lit("not an object"))).otherwise(found))


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, topo_level) from (conv_id, call_id, depends_on)."""
    own = calls.select("conv_id", "call_id")
    edges = (calls.select("conv_id", "call_id", F.explode(F.array_distinct("depends_on")).alias("parent"))
             .join(own.withColumnRenamed("call_id", "parent"), ["conv_id", "parent"], "left_semi"))
    edges = written(edges.select("conv_id", "call_id", "parent"), "call-edges")
    placed = written(own.join(edges, ["conv_id", "call_id"], "left_anti").withColumn("topo_level", F.lit(0)), "call-level")
    all_placed, level = placed, 0
    while True:
        level += 1
        # calls with a parent in the last level, all of whose parents are placed
        near = edges.join(placed.select("conv_id", F.col("call_id").alias("parent")), ["conv_id", "parent"], "left_semi")
        near = edges.join(near.select("conv_id", "call_id").distinct(), ["conv_id", "call_id"], "left_semi")
        known = all_placed.select("conv_id", F.col("call_id").alias("parent"), F.lit(1).alias("known"))
        ready = (near.join(known, ["conv_id", "parent"], "left").groupBy("conv_id", "call_id")
                 .agg(F.count("*").alias("parents"), F.count("known").alias("done")).where("parents = done"))
        placed = written(ready.select("conv_id", "call_id", F.lit(level).alias("topo_level")), "call-level")
        if placed.isEmpty():
            return own.join(all_placed, ["conv_id", "call_id"], "left")
        all_placed = all_placed.union(placed)


def link(messages: DataFrame, schemas: dict[str, Schema]) -> DataFrame:
    """One row a call: conv_id, turn, call_id, tool, topo_level (null: on or
    behind a cycle), arguments (canonical), errors, result, result_turn,
    call_json (all of it as canonical JSON)."""
    calls = messages.where("role = 'assistant' and call_id is not null and conv_id is not null")
    calls = calls.groupBy("conv_id", "call_id").agg(
        F.min(F.struct("turn", "tool", "arguments", "depends_on")).alias("c")).select("conv_id", "call_id", "c.*")
    results = messages.where("role = 'tool' and result_id is not null and conv_id is not null").groupBy(
        "conv_id", F.col("result_id").alias("call_id")).agg(F.min(F.struct("turn", "text")).alias("r"))
    results = results.select("conv_id", "call_id", F.col("r.turn").alias("result_turn"), F.col("r.text").alias("result"))
    parsed = calls.withColumn("_parsed", F.try_parse_json("arguments"))
    whole_object = F.schema_of_variant("_parsed").startswith("OBJECT")
    checked = parsed.select("conv_id", "turn", "call_id", "tool",
                            F.when(whole_object, F.to_json("_parsed")).alias("arguments"),
                            F.when(whole_object, F.col("_parsed")).alias("arguments_"),
                            errors(F.col("tool"), F.col("_parsed"), schemas).alias("errors"))
    ordered = checked.join(levels(calls.select("conv_id", "call_id", "depends_on")), ["conv_id", "call_id"])
    linked = ordered.join(results.hint("shuffle_hash"), ["conv_id", "call_id"], "left")
    whole = F.to_json(F.struct("arguments_", F.col("call_id").alias("id"), F.col("tool").alias("name"), "result")
                      .cast("struct<arguments:variant,id:string,name:string,result:string>"), {"ignoreNullFields": "false"})
    return linked.select("conv_id", "turn", "call_id", "tool", "topo_level", "arguments", "errors", "result_turn", "result",
                         whole.alias("call_json"))


def unlinked(messages: DataFrame) -> DataFrame:
    """The tool rows that no row of ``link`` holds: conv_id, turn, result_id,
    text, error (no call id, unknown call, further result); repeated rows are
    rows of their own."""
    calls = messages.where("role = 'assistant' and call_id is not null and conv_id is not null").select(
        "conv_id", F.col("call_id").alias("result_id"), F.lit(True).alias("called")).distinct()
    place = ["conv_id", "result_id"]
    results = messages.where("role = 'tool'").groupBy(*place, "turn", "text").agg(F.count("*").cast("int").alias("n"))
    first = results.groupBy(*place).agg(F.min(F.struct("turn", "text")).alias("first"))
    joined = results.join(first, place, "left").join(calls, place, "left")
    used = F.col("called").isNotNull() & F.struct("turn", "text").eqNullSafe(F.col("first"))
    error = (F.when(F.col("result_id").isNull(), "no call id").when(F.col("called").isNull(), "unknown call")
             .otherwise("further result"))
    return joined.select(*place, "turn", "text", error.alias("error"),
                         F.explode(F.array_repeat(F.lit(0), F.col("n") - used.cast("int")))).select(
        "conv_id", "turn", "result_id", "text", "error")
