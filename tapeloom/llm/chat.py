"""Tool-call linking for chat data, by DataFrame operations alone.

Calls and results are hash-joined by identifier; calls are ordered topologically by what they depend on
(depth by pointer doubling, so a chain of n calls takes log n joins); arguments are validated against
schemas; each call becomes one line of canonical JSON (sorted keys, no blanks).

Defined results: of repeated identifiers the smallest row counts (``repeats`` says how many more there
were); null identifiers never link (their results are orphans); arguments that aren't a JSON object are
invalid; a call whose parent is missing starts a chain; calls on or behind a cycle have no depth and the
status "cycle"; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import cut, drop

#: Names of JSON kinds, and what schema_of_variant calls them.
KINDS = {"string": "STRING", "integer": "BIGINT", "number": "(BIGINT|DOUBLE|FLOAT|DECIMAL.*)", "boolean": "BOOLEAN", "object": "OBJECT.*", "array": "ARRAY.*", "null": "VOID"}


def depths(calls: DataFrame) -> DataFrame:
    """calls(call_id, parent_id), call_id unique -> (call_id, depth): calls before it in its chain; null on a cycle."""
    known = calls.select(F.col("call_id").alias("parent_id"), F.lit(True).alias("there"))
    now = calls.join(known, "parent_id", "left").select("call_id", F.when(F.col("there"), F.col("parent_id")).alias("up"))
    now = cut(now.withColumn("depth", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long")))
    open_ = now.filter("up IS NOT NULL").count()
    while open_:
        above = now.select(F.col("call_id").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("d2"))
        going = now.filter("up IS NOT NULL").join(above, "up").select("call_id", F.col("up2").alias("up"), (F.col("depth") + F.col("d2")).alias("depth"))
        was, now = now, cut(now.filter("up IS NULL").union(going))
        drop(was)
        left = now.filter("up IS NOT NULL").count()
        if left == open_:
            break
        open_ = left
    return now.select("call_id", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))


def violations(name: Column, arguments: Column, schemas: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """Sorted names of the rules that JSON ``arguments`` break; schemas: {name: {field: (kind, required)}}."""
    parsed = F.try_parse_json(arguments)
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    cases = F.when(F.lit(False), F.array().cast("array<string>"))
    for tool, fields in schemas.items():
        rules = []
        for field, (kind, required) in fields.items():
            value = F.try_variant_get(parsed, f"$['{field}']", "variant")
            missing = ~F.coalesce(F.array_contains(F.json_object_keys(arguments), field), F.lit(False))
            wrong = ~F.coalesce(F.schema_of_variant(value).rlike(f"^{KINDS[kind]}$"), F.lit(False))
            rules.append(F.when(missing, F.lit(f"missing:{field}") if required else F.lit(None)).when(wrong, F.lit(f"kind:{field}")))
        unknown = F.transform(F.array_except(F.coalesce(F.json_object_keys(arguments), F.array().cast("array<string>")), F.array(*map(F.lit, fields)).cast("array<string>")), lambda k: F.concat(F.lit("unknown:"), k))
        cases = cases.when(name == tool, F.array_sort(F.concat(F.array_compact(F.array(*rules).cast("array<string>")), unknown)))
    return F.when(~is_object, F.array(F.lit("not an object"))).otherwise(F.coalesce(cases, F.array(F.lit("unknown tool"))))


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict[str, tuple[str, bool]]]) -> DataFrame:
    """calls(call_id, parent_id, name, arguments JSON), results(call_id, content) -> one row per distinct call
    and per distinct result without one: call_id, depth, status, repeats, line."""
    one = F.min(F.struct("parent_id", "name", "arguments")).alias("c")
    unique = cut(calls.filter("call_id IS NOT NULL").groupBy("call_id").agg(one, (F.count("*") - 1).alias("repeats")).select("call_id", "c.*", "repeats"))
    answers = results.groupBy("call_id").agg(F.min("content").alias("content"), F.count("*").alias("answers"))
    placed = depths(unique.select("call_id", "parent_id"))
    known = unique.join(placed, "call_id").withColumn("called", F.lit(True))
    both = known.join(answers, "call_id", "full_outer")
    errors = F.when(F.col("called"), violations(F.col("name"), F.col("arguments"), schemas)).otherwise(F.array().cast("array<string>"))
    rows = both.withColumn("errors", errors)
    status = (
        F.when(F.col("called").isNull(), "orphan")
        .when(F.col("depth").isNull(), "cycle")
        .when(F.size("errors") > 0, "invalid")
        .when(F.col("answers").isNull(), "unanswered")
        .otherwise("ok")
    )
    text = lambda c: F.coalesce(F.to_json(F.col(c).cast("variant")), F.lit("null"))
    rows = rows.withColumn("status", status)
    fields = [
        ("arguments", F.coalesce(F.to_json(F.try_parse_json("arguments")), F.lit("null"))),
        ("call_id", text("call_id")),
        ("depth", text("depth")),
        ("errors", F.concat(F.lit("["), F.array_join(F.transform("errors", lambda e: F.to_json(e.cast("variant"))), ","), F.lit("]"))),
        ("name", text("name")),
        ("result", text("content")),
        ("status", text("status")),
    ]
    line = F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{k}":'), v) for k, v in fields)), F.lit("}"))
    return rows.select("call_id", "depth", "status", F.coalesce("repeats", F.lit(0)).alias("repeats"), line.alias("line"))
