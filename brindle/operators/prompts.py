"""Texts for models: document encodings for retrieval, and code context of an instance by source of files."""

from __future__ import annotations

import ast

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import number_lines


def path_and_contents(path: Column, text: Column) -> Column:
    """The path on a line of its own, then the text; a null text is empty."""
    return F.concat(path, F.lit("\n"), F.coalesce(text, F.lit("")))


def docstrings(source: str) -> str:
    """A module's docstring, then the name and docstring of each function and class that has one."""
    tree = ast.parse(source)
    parts = [ast.get_docstring(tree) or ""]
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) and (said := ast.get_docstring(node)):
            parts.append(f"\n\n{node.name}\n{said}")
    return "".join(parts)


def path_and_documentation(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, encoded): the path and the docstrings; a file that does not parse, and so has none, goes whole."""

    def run(batches):
        for batch in batches:
            out = []
            for p, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    said = docstrings(source or "")
                except (SyntaxError, ValueError, RecursionError):
                    said = source or ""
                out.append(f"{p}\n{said}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["path", "encoded"])

    return files.select(F.col(path).alias("path"), F.col(text).alias("text")).mapInArrow(run, "path string, encoded string")


def file_block(path: Column, text: Column, numbered: bool = False) -> Column:
    """A file between its start and end marks, its lines numbered if asked for."""
    body = number_lines(text) if numbered else text
    return F.concat(F.lit("[start of "), path, F.lit("]\n"), body, F.lit("\n[end of "), path, F.lit("]"))


def wanted_files(instances: DataFrame, source: str, files: DataFrame, hits: DataFrame | None = None, most: int | None = None, key: str = "instance_id") -> DataFrame:
    """(key, path, place): the files that a source of context names for each instance.

    oracle: those that the gold patch touches; bm25: the hits (key, path, rank), `most` of them;
    all: every file of the instance's repository and commit; none: no file.
    """
    if source == "oracle":
        touched = F.regexp_extract_all(F.coalesce("patch", F.lit("")), F.lit(r"(?m)^diff --git a/(\S+) b/"), F.lit(1))
        return instances.select(key, F.posexplode(F.array_distinct(touched)).alias("place", "path")).select(key, "path", "place")
    if source == "bm25":
        df = hits.select(key, "path", F.col("rank").cast("int").alias("place"))
        return df if most is None else df.where(F.col("place") <= most)
    if source == "all":
        return instances.select(key, "repo", "commit").join(files.select("repo", "commit", "path"), ["repo", "commit"]).select(key, "path", F.lit(0).alias("place"))
    if source == "none":
        return instances.select(key, F.lit("").alias("path"), F.lit(0).alias("place")).limit(0)
    raise ValueError(f"no source of files: {source}")


def text_inputs(instances: DataFrame, source: str, files: DataFrame, hits: DataFrame | None = None, most: int | None = None, numbered: bool = False, key: str = "instance_id") -> DataFrame:
    """(key, n_files, context): the blocks of an instance's files, in order of place and path.

    instances: (key, repo, commit, patch); files: (repo, commit, path, text). An instance of which
    a file is missing has a null context, as a failed one; one without files an empty one.
    """
    wanted = wanted_files(instances, source, files, hits, most, key).join(instances.select(key, "repo", "commit"), key)
    found = wanted.join(files, ["repo", "commit", "path"], "left")
    block = F.struct("place", "path", file_block(F.col("path"), F.col("text"), numbered).alias("block"))
    per = found.groupBy(key).agg(F.array_sort(F.collect_list(block)).alias("bs"), F.count(F.lit(1)).alias("n_files"), F.bool_and(F.col("text").isNotNull()).alias("whole"))
    out = instances.select(key).join(per, key, "left")
    context = F.when(F.coalesce("whole", F.lit(True)), F.array_join(F.transform(F.coalesce("bs", F.array().cast(per.schema["bs"].dataType)), lambda b: b["block"]), "\n"))
    return out.select(key, F.coalesce("n_files", F.lit(0)).alias("n_files"), context.alias("context"))


def n_tokens(text: Column, pattern: str = r"\w+|[^\w\s]") -> Column:
    """How many tokens a plain tokenizer of words and signs makes of a text."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(pattern))
