"""Recorded agent runs: nested JSON to flat rows, then actions, rounds and file recall."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grading import action_metrics, outcome
from ..functions.text import ratio

# Node types of calls, of their results, and of commands.
CALLS = ("function_call", "tool_call", "tool_use", "mcp_tool_call")
RESULTS = ("function_call_output", "tool_result", "tool_output")
COMMANDS = ("command_execution", "local_shell_call", "shell_call")


def walk(value):
    """(kind, value) of every object and string below value, in the order of the document."""
    todo = [value]
    while todo:
        at = todo.pop()
        if isinstance(at, str):
            yield "string", at
        elif isinstance(at, dict):
            yield "object", at
            todo += reversed(at.values())
        elif isinstance(at, list):
            todo += reversed(at)


def nodes(docs: DataFrame, key: str, document: str) -> DataFrame:
    """(key, n, kind, value): all objects, as JSON, and strings of each document of any depth.

    What is no JSON, and null, has no rows. Python walks, in Arrow batches, as the depth is free.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            keys, ns, kinds, values = [], [], [], []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    found = list(walk(json.loads(text))) if text else []
                except ValueError:
                    found = []
                keys += [k] * len(found)
                ns += range(len(found))
                kinds += [x for x, _ in found]
                values += [v if x == "string" else json.dumps(v, ensure_ascii=False, sort_keys=True) for x, v in found]
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(ns, pa.int64()), pa.array(kinds, pa.string()), pa.array(values, pa.string())], names=[key, "n", "kind", "value"])

    return docs.select(key, document).mapInArrow(run, f"{key} {kind}, n long, kind string, value string")


def _field(value: Column, name: str) -> Column:
    return F.get_json_object(value, f"$.{name}")


def _filled(value: Column, *names: str) -> Column:
    """The first field that is not null, empty, false, [] or {}."""
    return F.coalesce(*(F.when(~_field(value, n).isin("", "false", "[]", "{}"), _field(value, n)) for n in names))


def actions(found: DataFrame, by: list[str], order: str = "n") -> DataFrame:
    """(by, n, type, action_id, tool, signature, success, detail) of the objects that are actions.

    found: rows of nodes(). A call and the result with its id are one action: it stands where it
    began, and what the last of them says of the outcome holds.
    """
    v = F.col("value")
    kind = F.lower(F.btrim(F.coalesce(_field(v, "type"), F.lit(""))))
    boolean = lambda name: F.when(_field(v, name).isin("true", "false"), _field(v, name) == "true")
    tool = F.coalesce(_filled(v, "name", "tool", "tool_name"), F.when(kind.isin(*COMMANDS), "shell_command").otherwise("unknown_tool"))
    arguments = F.coalesce(*(_field(v, n) for n in ("arguments", "input", "command")))
    detail = F.left(F.coalesce(*(F.nullif(_field(v, n), F.lit("")) for n in ("error", "aggregated_output", "output", "result", "command")), F.lit("")), F.lit(500))
    rows = found.where("kind = 'object'").select(
        *by, order, kind.alias("type"), _filled(v, "call_id", "tool_call_id", "id").alias("action_id"), tool.alias("tool"),
        F.coalesce(F.concat(tool, F.lit(":"), F.btrim(arguments)), tool).alias("signature"),
        outcome(boolean("success"), boolean("is_error"), _field(v, "exit_code").try_cast("int"), _field(v, "status"), F.when(_field(v, "error") != "false", _field(v, "error"))).alias("success"), detail.alias("detail"),
    )
    rows = rows.where(F.col("type").isin(*CALLS, *RESULTS, *COMMANDS))
    one = F.coalesce("action_id", F.concat(F.lit("\x00"), F.col(order).cast("string")))
    first = lambda c: F.min_by(c, order).alias(c)
    last = F.max_by("success", F.when(F.col("success").isNotNull(), F.col(order))).alias("success")
    return rows.groupBy(*by, one.alias("__one")).agg(F.min(order).alias("n"), *(first(c) for c in ("type", "action_id", "tool", "signature")), last, F.max_by("detail", order).alias("detail")).drop("__one")


def expected_files(metadata: Column) -> Column:
    """struct(all, critical, references): paths named by a task's metadata, slashes forward, each once."""
    path = lambda p: F.get_json_object(metadata, p)
    listed = lambda p: F.coalesce(F.from_json(path(p), "array<string>"), F.array().cast("array<string>"))
    clean = lambda xs: F.array_distinct(F.transform(F.filter(xs, lambda x: x.isNotNull() & (x != "")), lambda x: F.replace(x, F.lit("\\"), F.lit("/"))))
    critical = clean(F.array(path("$.target.abstract_node.path"), path("$.mask.path")))
    references, affected = clean(listed("$.reference_implementation_files")), clean(listed("$.affected_modules"))
    return F.struct(F.array_distinct(F.concat(critical, references, affected)).alias("all"), critical.alias("critical"), references.alias("references"))


def file_recall(tracks: DataFrame, found: DataFrame, key: str, metadata: str) -> DataFrame:
    """(key, expected, recalled, recall, critical_recall): expected paths that stand in any string of
    the responses, whatever the case; a rate without expected paths is null.

    Each expected path meets the strings of its own track only, and rows of a path are combined
    before they are shuffled.
    """
    e = tracks.select(key, expected_files(F.col(metadata)).alias("e"))
    paths = e.select(key, F.explode("e.all").alias("path"), F.col("e.critical").alias("critical"))
    said = found.where("kind = 'string'").select(key, F.lower(F.replace("value", F.lit("\\"), F.lit("/"))).alias("said"))
    hit = paths.join(said, key).where(F.contains("said", F.lower("path"))).select(key, "path").distinct().withColumn("hit", F.lit(True))
    marked = paths.join(hit, [key, "path"], "left").withColumn("hit", F.coalesce("hit", F.lit(False))).withColumn("main", F.array_contains("critical", F.col("path")))
    per = marked.groupBy(key).agg(F.count(F.lit(1)).alias("expected"), F.count_if("hit").alias("recalled"), F.count_if("main").alias("m"), F.count_if(F.col("main") & F.col("hit")).alias("h"))
    out = e.select(key).join(per, key, "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select(key, zero("expected").alias("expected"), zero("recalled").alias("recalled"), ratio(zero("recalled"), zero("expected")).alias("recall"), ratio(zero("h"), zero("m")).alias("critical_recall"))


def evaluate(tracks: DataFrame, key: str = "track_id", responses: str = "responses", metadata: str = "task_metadata") -> DataFrame:
    """One row a track: its actions' totals and success rate, its responses, and its file recall.

    responses: a JSON array of objects with `response`; metadata: a JSON object. Null is empty.
    """
    found = nodes(tracks, key, responses)
    per = action_metrics(actions(found, [key]), [key])
    rounds = tracks.select(key, F.coalesce(F.size(F.from_json(responses, "array<string>")), F.lit(0)).alias("rounds"))
    return rounds.join(per, key, "left").join(file_recall(tracks, found, key, metadata), key)


def closed_runs(entries: DataFrame, by: list[str], order: str, state: str) -> DataFrame:
    """Entries of append-only runs with accepted: false for what comes after a run's first closing state."""
    from pyspark.sql import Window

    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    closed = F.max(F.col(state).isin("completed", "failed", "cancelled")).over(before)
    return entries.withColumn("accepted", ~F.coalesce(closed, F.lit(False)))
