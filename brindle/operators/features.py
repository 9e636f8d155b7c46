"""Benchmark instances from source trees: return mutations, implementers of abstract nodes, checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .source_tree import NAME, shuffled


def _any(*tests: Column) -> Column:
    return reduce(lambda a, b: a | b, tests)


def return_type(signature: Column) -> Column:
    """What a signature declares to return; '' if nothing."""
    return F.btrim(F.regexp_extract(signature, r"\)\s*:\s*([^={]+)", 1))


def wrong_value(signature: Column, expression: Column) -> Column:
    """A value of the expression's kind that it most likely does not have: by the declared type, else by its look."""
    declared, e = F.lower(return_type(signature)), F.regexp_replace(F.btrim(expression), ";+$", "")
    low = F.lower(e)
    boolean = _any(e.isin("true", "false"), e.startswith("!!"), e.contains(".every("), e.contains(".some("), e.rlike("[<>]|[=!]="), low.rlike("^(?:is|has|can|should)"))
    string = _any(e.rlike("^['\"`]"), e.rlike(r"\.(?:toString\(\)|message)$"), e.contains("Path"), low.contains("uri"))
    number = _any(e.rlike(r"^-?\d+(?:\.\d+)?$"), e.endswith(".length"))
    return (
        F.when(declared.contains("boolean") | boolean, F.when(e == "false", "true").otherwise("false"))
        .when(declared.contains("string") | string, '""')
        .when(declared.contains("number") | number, "0")
        .when(declared.contains("[]") | declared.contains("array<"), "[]")
        .otherwise("null")
    )


RETURN = r"^(\s*)return\s+(.*?)(;)?\s*$"


def return_mutations(functions: DataFrame, lines: DataFrame, masked: str = "masked") -> DataFrame:
    """(path, qualified, line, original, mutated): the last return of each function whose value can be made wrong.

    functions: (path, qualified, start, end, signature); lines: (path, line, text, masked).
    """
    inside = lines.join(functions.select("path", "qualified", "start", "end", "signature"), "path").where(F.col("line").between(F.col("start"), F.col("end")))
    hits = inside.where(F.btrim(F.col(masked)).rlike(r"^return\s+.+;?\s*$") & F.col("text").rlike(RETURN))
    hits = hits.withColumn("expression", F.btrim(F.regexp_extract("text", RETURN, 2)))
    hits = hits.withColumn("wrong", wrong_value(F.col("signature"), F.col("expression"))).where("expression <> wrong")
    mutated = F.concat(F.regexp_extract("text", RETURN, 1), F.lit("return "), F.col("wrong"), F.regexp_extract("text", RETURN, 3))
    last = hits.groupBy("path", "qualified").agg(F.max_by(F.struct("line", F.col("text").alias("original"), mutated.alias("mutated")), "line").alias("m"))
    return last.select("path", "qualified", "m.*")


def consumption(prefix: Column, rest: Column) -> Column:
    """How a call's value is used, by what stands before it on its line and after: assignment,
    condition, return, argument, promise_chain, or null for not at all."""
    bare = F.btrim(prefix)
    return (
        F.when(prefix.rlike(rf"\b(?:const|let|var)\s+{NAME}(?:\s*:\s*[^=]+)?\s*=\s*(?:await\s+)?$"), "assignment")
        .when(prefix.rlike(r"\b(?:if|while|for)\s*\([^)]*(?:await\s+)?$"), "condition")
        .when(bare.isin("return", "return await"), "return")
        .when(bare.rlike(r"[(,]$"), "argument")
        .when(rest.contains(".then"), "promise_chain")
    )


def assigned_name(prefix: Column) -> Column:
    """The variable that takes the value; '' if none does."""
    return F.regexp_extract(prefix, rf"\b(?:const|let|var)\s+({NAME})(?:\s*:\s*[^=]+)?\s*=\s*(?:await\s+)?$", 1)


def used_consumers(hits: DataFrame, lines: DataFrame) -> DataFrame:
    """hits (path, line, end, prefix, rest, ...) with use, without those whose value goes nowhere.

    An assignment counts if its variable stands in a later line of the function, which ends at
    `end`; at file level, where end is null, it counts as it is.
    """
    h = hits.withColumns({"use": consumption(F.col("prefix"), F.col("rest")), "name": assigned_name(F.col("prefix"))})
    later = lines.select(F.col("path").alias("p"), F.col("line").alias("at"), "text")
    words = F.array_contains(F.regexp_extract_all("text", F.lit(NAME), F.lit(0)), F.col("name"))
    seen = h.where("use = 'assignment' and end is not null").join(later, (F.col("path") == F.col("p")) & (F.col("at") > F.col("line")) & (F.col("at") <= F.col("end"))).where(words)
    seen = seen.select("path", "line", "prefix").distinct().withColumn("seen", F.lit(True))
    out = h.join(seen, ["path", "line", "prefix"], "left")
    return out.where(F.col("use").isNotNull() & ((F.col("use") != "assignment") | F.col("end").isNull() | F.col("seen"))).drop("seen", "name")


def abstract_nodes(nodes: DataFrame) -> DataFrame:
    """Interfaces, and classes that are abstract: (path, type, name, qualified, start, modifiers)."""
    return nodes.where((F.col("type") == "interface") | ((F.col("type") == "class") & F.array_contains("modifiers", "abstract"))).select("path", "type", "name", "qualified", "start", "modifiers")


def declarations(nodes: DataFrame) -> DataFrame:
    """(path, names): the classes and structs that each file declares, sorted."""
    return nodes.where(F.col("type").isin("class", "struct")).groupBy("path").agg(F.sort_array(F.collect_set("name")).alias("names"))


def implementers(abstract: DataFrame, bindings: DataFrame, files: DataFrame, structural: bool = True) -> DataFrame:
    """(target, name, path, relation, local): files that import an abstract node and inherit from it
    or, for interfaces, use it twice or more.

    bindings: (path, target, kind, imported, local), imports resolved to files; files: (path,
    masked). A file meets only the nodes that it imports; of both relations the explicit one holds.
    """
    a = abstract.select(F.col("path").alias("target"), "name", "type", F.array_contains("modifiers", "default").alias("is_default"))
    by_name = (F.col("kind") == "named") & (F.col("imported") == F.col("name"))
    met = bindings.where("target is not null").join(shuffled(a), "target").where((by_name | ((F.col("kind") == "default") & F.col("is_default"))) & (F.col("path") != F.col("target")))
    met = met.select("target", "name", "type", "path", "local").distinct().join(shuffled(files), "path")
    heads = F.regexp_extract_all("masked", F.lit(rf"\b(?:class|struct)\s+{NAME}[^{{\n]*?\b(?:implements|extends)\s+([^{{\n]*)"), F.lit(1))
    names = lambda x: F.regexp_extract_all(x, F.lit(NAME), F.lit(0))
    explicit = F.exists(heads, lambda x: F.array_contains(names(x), F.col("local")))
    uses = F.size(F.filter(names(F.col("masked")), lambda x: x == F.col("local")))
    relation = F.when(explicit, "explicit_inheritance")
    if structural:
        relation = relation.when((F.col("type") == "interface") & (uses >= 2), "structural_usage")
    return met.withColumn("relation", relation).where("relation is not null").select("target", "name", "path", "relation", "local")


def feature_candidates(found: DataFrame, abstract: DataFrame, least: int = 2) -> DataFrame:
    """Abstract nodes by how many files implement them, most first, then by path and line."""
    n = found.groupBy("target", "name").agg(F.count_distinct("path").alias("implementations"), F.sort_array(F.collect_set("path")).alias("paths"))
    a = abstract.select(F.col("path").alias("target"), "name", "type", "start")
    return n.join(shuffled(a), ["target", "name"]).where(F.col("implementations") >= least).orderBy(F.desc("implementations"), "target", "start")


def verify(instances: DataFrame, abstract: DataFrame, found: DataFrame, declared: DataFrame, files: DataFrame) -> DataFrame:
    """instances with five checks, passed (all of them) and matches_gold.

    instances: (instance_id, target, node_type, name, masked_path, declarations, masked_sha256,
    original_sha256); files: (path, source) as they are now.
    """
    have = lambda df, on, name: shuffled(df.select(*(F.col(a).alias(b) for a, b in on.items())).distinct().withColumn(name, F.lit(True)))
    out = instances.join(have(abstract, {"path": "target", "type": "node_type", "name": "name"}, "abstract_node_exists"), ["target", "node_type", "name"], "left")
    out = out.join(have(found, {"target": "target", "name": "name", "path": "masked_path"}, "implementation_relation_restored"), ["target", "name", "masked_path"], "left")
    out = out.join(shuffled(declared.select(F.col("path").alias("masked_path"), "names")), "masked_path", "left")
    out = out.join(shuffled(files.select(F.col("path").alias("masked_path"), F.sha2("source", 256).alias("sha"), F.lit(True).alias("masked_file_exists"))), "masked_path", "left")
    no = F.array().cast("array<string>")
    false = lambda x: F.coalesce(x, F.lit(False))
    out = out.withColumns({
        "abstract_node_exists": false("abstract_node_exists"), "masked_file_exists": false("masked_file_exists"), "masked_file_changed": false(F.col("sha") != F.col("masked_sha256")),
        "implementation_relation_restored": false("implementation_relation_restored"),
        "expected_declarations_restored": F.size(F.array_except(F.coalesce("declarations", no), F.coalesce("names", no))) == 0, "matches_gold": false(F.col("sha") == F.col("original_sha256")),
    })
    checks = ["abstract_node_exists", "masked_file_exists", "masked_file_changed", "implementation_relation_restored", "expected_declarations_restored"]
    return out.select("instance_id", *checks, F.forall(F.array(*checks), lambda x: x).alias("passed"), "matches_gold")


def verify_lines(expected: DataFrame, rejected: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """(key, passed): each expected line stands exactly once, and no rejected one does."""
    counts = lines.groupBy(key, "text").count()
    once = expected.select(key, "text").distinct().join(counts, [key, "text"], "left").groupBy(key).agg(F.bool_and(F.coalesce(F.col("count") == 1, F.lit(False))).alias("once"))
    bad = rejected.select(key, "text").join(counts, [key, "text"], "left_semi").select(key).distinct().withColumn("bad", F.lit(True))
    return once.join(bad, key, "left").select(key, (F.col("once") & F.col("bad").isNull()).alias("passed"))
