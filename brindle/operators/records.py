"""Record shapes: flattened repositories, instances, result rows, tool actions and qualifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import instance_id


def _or(value: Column, other: Column) -> Column:
    """value unless it is null or empty."""
    return F.when(value.isNull() | (value == ""), other).otherwise(value)


#: Columns that a repository record takes over as they are; those that the input lacks are null.
PLAIN = {
    "html_url": "string", "description": "string", "language": "string", "stargazers_count": "long", "forks_count": "long", "open_issues_count": "long",
    "created_at": "string", "updated_at": "string", "pushed_at": "string", "archived": "boolean", "fork": "boolean", "default_branch": "string", "size": "long",
}


def repository_record(repos: DataFrame, source_query: str = "", fetched_at: Column | None = None) -> DataFrame:
    """One flat record a repository: owner and name fall back on the parts of full_name, an absent
    or all-null license is null, absent topics are an empty list."""
    have = set(repos.columns)
    kinds = {f.name: f.dataType for f in repos.schema}
    full = F.coalesce(F.col("full_name"), F.lit(""))
    field = lambda c, name: F.col(c)[name] if c in have and name in kinds[c].fieldNames() else F.lit(None).cast("string")
    owner, rest = F.substring_index(full, "/", 1), F.when(full.contains("/"), F.regexp_replace(full, r"(?s)^[^/]*/", "")).otherwise("")
    license_ = F.struct(*(field("license", x).alias(x) for x in ("key", "spdx_id", "name")))
    known = F.coalesce(*(license_[x] for x in ("key", "spdx_id", "name"))).isNotNull()
    plain = {c: F.col(c) if c in have else F.lit(None).cast(kind) for c, kind in PLAIN.items()}
    topics = F.coalesce(F.col("topics"), F.array().cast("array<string>")) if "topics" in have else F.array().cast("array<string>")
    return repos.select(
        full.alias("full_name"), _or(field("owner", "login"), owner).alias("owner"), _or(F.col("name") if "name" in have else F.lit(None).cast("string"), rest).alias("repo"),
        *(x.alias(c) for c, x in plain.items()), F.when(known, license_).alias("license"), topics.alias("topics"),
        F.lit(source_query).alias("source_query"), (F.current_timestamp().cast("string") if fetched_at is None else fetched_at).alias("fetched_at"),
    )


def instances(pulls: DataFrame) -> DataFrame:
    """Task instances of pulls (full_name, number, resolved_issues, base_sha, patch, test_patch,
    problem_statement, hints_text, created_at)."""
    return pulls.select(
        F.col("full_name").alias("repo"), F.col("number").alias("pull_number"), instance_id(F.col("full_name"), F.col("number")).alias("instance_id"), F.col("resolved_issues").alias("issue_numbers"),
        F.col("base_sha").alias("base_commit"), "patch", "test_patch", "problem_statement", "hints_text", "created_at",
    )


def valid_pull(merged_at: Column, resolved: Column) -> Column:
    """Merged, and resolves an issue at least; null counts as neither."""
    return merged_at.isNotNull() & (F.coalesce(F.size(resolved), F.lit(0)) > 0)


def valid_instance(patch: Column, problem: Column) -> Column:
    """Has a patch and a problem statement; null counts as empty."""
    return (F.coalesce(patch, F.lit("")) != "") & (F.coalesce(problem, F.lit("")) != "")


def build_counts(pulls: DataFrame, valid: Column, complete: Column, tested: Column) -> DataFrame:
    """One row: all pulls, valid ones, instances complete, and those of them with tests, in one pass."""
    ok = lambda x: F.coalesce(x, F.lit(False))
    return pulls.agg(
        F.count(F.lit(1)).alias("pulls"), F.count_if(ok(valid)).alias("valid"), F.count_if(ok(valid & complete)).alias("complete"), F.count_if(ok(valid & complete & tested)).alias("tested")
    )


def replaced(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Columns added, or replaced where they are."""
    return df.withColumns(columns)


def projected(df: DataFrame, names: list[str]) -> DataFrame:
    """Exactly these columns as text, '' for null and for those that df lacks."""
    have = set(df.columns)
    return df.select(*((F.coalesce(F.col(n).cast("string"), F.lit("")) if n in have else F.lit("")).alias(n) for n in names))


def result_row(key: Column, stage: Column, message: Column, *values: Column) -> list[Column]:
    """A result's columns: key, status, error (stage and message) where there is a message, and the
    values, null in error."""
    failed = message.isNotNull()
    error = F.when(failed, F.struct(stage.alias("stage"), message.alias("message")))
    return [key, F.when(failed, "error").otherwise("ok").alias("status"), error.alias("error"), *(F.when(~failed, v) for v in values)]


def merged_maps(first: Column, second: Column) -> Column:
    """Both maps' entries; of a key in both, the second's. Null counts as empty."""
    empty = F.create_map().cast("map<string,string>")
    a, b = F.coalesce(first, empty), F.coalesce(second, empty)
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)


# The types that a tool action can have.
ACTION_TYPES = ("function_call", "tool_call", "tool_use", "command_execution", "function_call_output", "tool_result", "tool_output")


def tool_action(kind: Column, **fields: Column) -> Column:
    """An action as JSON: its lower-cased type, then the fields given, null ones and an empty error
    left out; null for a type that no action has."""
    given = {k: F.nullif(v, F.lit("")) if k == "error" else v for k, v in fields.items()}
    low = F.lower(F.btrim(kind))
    return F.when(low.isin(*ACTION_TYPES), F.to_json(F.struct(low.alias("type"), *(v.alias(k) for k, v in given.items()))))


def message_item(text: Column, role: Column) -> Column:
    """A message as JSON with one part of text."""
    part = F.struct(F.lit("output_text").alias("type"), text.alias("text"))
    return F.to_json(F.struct(F.lit("message").alias("type"), role.alias("role"), F.array(part).alias("content")))


# Where a search can look for its terms.
SEARCH_FIELDS = ("name", "description", "topics", "readme")


def in_qualifier(fields: Column) -> Column:
    """in:a,b of the distinct known fields, trimmed and lower-cased, in order; '' for none. An unknown field is an error."""
    clean = F.filter(F.transform(F.coalesce(fields, F.array().cast("array<string>")), lambda x: F.lower(F.btrim(x))), lambda x: x != "")
    known = F.array(*map(F.lit, SEARCH_FIELDS))
    checked = F.transform(clean, lambda x: F.when(F.array_contains(known, x), x).otherwise(F.raise_error(F.concat(F.lit("unknown search field: "), x)).cast("string")))
    return F.when(F.size(clean) == 0, "").otherwise(F.concat(F.lit("in:"), F.array_join(F.array_distinct(checked), ",")))


def date_boundary(text: Column, end: bool = False) -> Column:
    """The date of YYYY-MM (first day, or last where end) or of a longer text's first ten letters; null for anything else."""
    t = F.btrim(text)
    month = F.try_to_date(F.concat(t, F.lit("-01")), "yyyy-MM-dd") if hasattr(F, "try_to_date") else F.to_date(F.concat(t, F.lit("-01")), "yyyy-MM-dd")
    return F.when(t.rlike(r"^\d{4}-\d{2}$"), F.last_day(month) if end else month).when(F.length(t) >= 10, F.left(t, F.lit(10)).try_cast("date"))


def epoch_text(value: Column) -> Column:
    """Seconds since 1970 as an ISO time without zone; what is no whole number stays as it is."""
    n = value.try_cast("long")
    return F.when(n.isNotNull(), F.date_format(F.timestamp_seconds(n), "yyyy-MM-dd'T'HH:mm:ss")).otherwise(value)


def until_cutoff(pulls: DataFrame, created: str, order: list[Column], cutoff: str | None, most: int | None = None, by: list[str] | None = None) -> DataFrame:
    """Newest first: all rows to the first one before the cutoff (yyyymmdd), that one included, and
    at most `most` + 1; `by` splits the scan, one a repository."""
    from pyspark.sql import Window

    by = by or []
    w = Window.partitionBy(*by).orderBy(*order)
    out = pulls.withColumn("__rank", F.row_number().over(w))
    if cutoff is not None:
        past = F.col(created) < F.to_date(F.lit(cutoff), "yyyyMMdd").cast("timestamp_ntz")
        out = out.withColumn("__first", F.min(F.when(past, F.col("__rank"))).over(Window.partitionBy(*by))).where(F.col("__first").isNull() | (F.col("__rank") <= F.col("__first"))).drop("__first")
    if most is not None:
        out = out.where(F.col("__rank") <= most + 1)
    return out.drop("__rank")


def release_name(text: Column) -> Column:
    """struct(version, date) of a release's title: [1.2.3] - date, else a number like 1.2.3; the
    version without its last part, nulls where there is none."""
    plain = F.regexp_replace(text, "^SQLFluff ", "")
    full = plain.rlike(r"\[[\d.\w]*\] - \d*-\d*-\d*")
    parts = F.split(plain, " - ")
    number = F.regexp_extract(plain, r"\d\.\d\.[\d.]*", 0)
    short = lambda v: F.regexp_replace(v, r"\.[^.]*$", "")
    version = F.when(full, short(F.regexp_replace(parts[0], r"[\[\]]", ""))).when(number != "", short(number))
    return F.struct(version.alias("version"), F.when(full, F.get(parts, F.lit(1))).alias("date"))


def model_args(text: Column) -> Column:
    """map of key to typed JSON text of k=v, ...: numbers, booleans, null, [] and {} as such, all else a string."""
    pairs = F.filter(F.split(F.coalesce(text, F.lit("")), ","), lambda x: x.contains("="))

    def typed(v: Column) -> Column:
        quoted = F.regexp_extract(v, r"^(['\"])(.*)\1$", 2)
        own = F.when(v.rlike(r"^(['\"]).*\1$"), quoted).otherwise(v)
        return (
            F.when(v.isin("True", "False"), F.lower(v))
            .when(v.rlike(r"^\d+$|^\d+\.\d*$|^\.\d+$"), v)
            .when(v == "None", "null")
            .when(v.isin("[]", "{}"), v)
            .otherwise(F.concat(F.lit('"'), F.replace(F.replace(own, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')))
        )

    return F.map_from_entries(F.transform(pairs, lambda x: F.struct(F.get(F.split(x, "="), F.lit(0)).alias("key"), typed(F.get(F.split(x, "="), F.lit(1))).alias("value"))))


def environment_names(listing: Column) -> Column:
    """The first word of each line of a listing that is no comment and not the base."""
    lines = F.filter(F.split(listing, "\n"), lambda x: (F.btrim(x) != "") & ~x.startswith("#"))
    return F.filter(F.transform(lines, lambda x: F.get(F.split(F.btrim(x), r"\s+"), F.lit(0))), lambda x: x != "base")


def matches_schema(df: DataFrame, schema: T.StructType) -> bool:
    """Whether df has these columns of these types, in this order."""
    return [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in schema]
