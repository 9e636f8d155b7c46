"""Unified diffs: parsing into rows, splitting, repair, making and inspection."""

from __future__ import annotations

import difflib
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")
ROW = "file int, source string, target string, kind string, hunk int, src_start int, src_len int, dst_start int, dst_len int, added int, removed int, context int"
TESTS = ("test", "tests", "e2e", "testing")


def parse_hunks(text: str) -> list[dict]:
    """A row a hunk; a hunk ends with the line counts in its head, so '---' lines inside it are text."""
    rows, source, target, file, hunk, left = [], None, None, -1, 0, [0, 0]
    for line in (text or "").split("\n"):
        if left[0] > 0 or left[1] > 0:
            mark = line[:1]
            if mark == "+":
                rows[-1]["added"] += 1
                left[1] -= 1
            elif mark == "-":
                rows[-1]["removed"] += 1
                left[0] -= 1
            elif mark != "\\":
                rows[-1]["context"] += 1
                left[0] -= 1
                left[1] -= 1
        elif line.startswith("--- "):
            source = line[4:].split("\t")[0]
        elif line.startswith("+++ "):
            target, file, hunk = line[4:].split("\t")[0], file + 1, 0
        elif m := HUNK.match(line):
            a, n, b, k = int(m[1]), int(m[2] or 1), int(m[3]), int(m[4] or 1)
            kind = "added" if source == "/dev/null" else "removed" if target == "/dev/null" else "modified"
            rows.append({"file": file, "source": source, "target": target, "kind": kind, "hunk": hunk, "src_start": a, "src_len": n, "dst_start": b, "dst_len": k, "added": 0, "removed": 0, "context": 0})
            hunk, left = hunk + 1, [n, k]
    return rows


def hunks(df: DataFrame, key: str, patch: str) -> DataFrame:
    """(key, hunk columns): each hunk of each patch."""
    kind = df.schema[key].dataType.simpleString()
    names = [x.split()[0] for x in ROW.split(", ")]

    def run(batches):
        for batch in batches:
            keys, rows = [], []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = parse_hunks(text)
                keys += [k] * len(found)
                rows += found
            types = [pa.int32() if x.endswith(" int") else pa.string() for x in ROW.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), *(pa.array([r[n] for r in rows], t) for n, t in zip(names, types))], names=[key, *names])

    return df.select(key, patch).mapInArrow(run, f"{key} {kind}, {ROW}")


def file_parts(patch: Column) -> Column:
    """The patch cut before each 'diff --git' line."""
    return F.filter(F.split(patch, r"(?m)(?=^diff --git )"), lambda x: x.startswith("diff --git "))


def split_tests(patch: Column) -> Column:
    """struct(fix, test): parts whose path holds a testing word go to test; 'latest' holds one too."""

    def is_test(part: Column) -> Column:
        path = F.regexp_extract(part, r"^diff --git a/(\S+)", 1)
        return F.exists(F.array(*map(F.lit, TESTS)), lambda w: F.contains(path, w))

    parts = file_parts(patch)
    return F.struct(F.array_join(F.filter(parts, lambda p: ~is_test(p)), "").alias("fix"), F.array_join(F.filter(parts, is_test), "").alias("test"))


def touched(patch: Column) -> Column:
    """Paths before the change of all files that had one."""
    return F.regexp_extract_all(patch, F.lit(r"(?m)^--- a/(.+)$"), F.lit(1))


def created(patch: Column) -> Column:
    return F.regexp_extract_all(patch, F.lit(r"(?m)^--- /dev/null\n\+\+\+ b/(.+)$"), F.lit(1))


def _bodies(text: str):
    """(lines before a hunk or file, [hunk lines]) in turn."""
    head, body = [], []
    lines = (text or "").split("\n")
    # a removed line may look like a file's head; a head has its other half below it
    heads = {j for i, x in enumerate(lines[:-1]) if x.startswith("--- ") and lines[i + 1].startswith("+++ ") for j in (i, i + 1)}
    for i, line in enumerate(lines):
        if HUNK.match(line):
            if body:
                yield head, body
                head = []
            body = [line]
        elif body and line[:1] in (" ", "+", "-", "\\") and i not in heads:
            body.append(line)
        elif body:
            yield head, body
            head, body = [line], []
        else:
            head.append(line)
    yield head, body


def repair(text: str) -> str:
    """Hunk heads recomputed from the hunks' lines and the shift of those before in the file."""
    out, shift = [], 0
    for head, body in _bodies(text):
        if any(x.startswith("--- ") for x in head):
            shift = 0
        out += head
        if body:
            src = sum(x[:1] in (" ", "-") for x in body[1:])
            dst = sum(x[:1] in (" ", "+") for x in body[1:])
            start = int(HUNK.match(body[0])[1])
            out.append(f"@@ -{start},{src} +{start + shift},{dst} @@" + body[0].split("@@", 2)[2])
            out += body[1:]
            shift += dst - src
    return "\n".join(out)


def minimal(text: str) -> str:
    """Hunks without the context at their ends, heads to match; hunks without a change go."""
    out, shift, pending = [], 0, []
    for head, body in _bodies(text):
        if any(x.startswith("--- ") for x in head):
            shift, pending = 0, [x for x in head if x.startswith(("--- ", "+++ "))]
        lines = [x for x in body[1:] if x[:1] != "\\"]
        changed = [i for i, x in enumerate(lines) if x[:1] in ("+", "-")]
        if not changed:
            continue
        a, b = changed[0], changed[-1] + 1
        kept = lines[a:b]
        src, dst = sum(x[:1] != "+" for x in kept), sum(x[:1] != "-" for x in kept)
        start = int(HUNK.match(body[0])[1]) + a
        out += pending + [f"@@ -{start},{src} +{start + shift},{dst} @@", *kept]
        pending, shift = [], shift + dst - src
    return "\n".join(out) + ("\n" if out else "")


def make(path: str, before: str, after: str, context: int = 3) -> str:
    """A unified diff of two texts; a missing newline at the end is marked."""
    def marked(text: str) -> list[str]:
        lines = text.splitlines(keepends=True)
        return lines if not lines or lines[-1].endswith("\n") else [*lines[:-1], lines[-1] + "\n\\ No newline at end of file\n"]

    return "".join(difflib.unified_diff(marked(before), marked(after), f"a/{path}", f"b/{path}", n=context))


def _scalar(f):
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else f(t))

    return run


def repaired(patch: Column) -> Column:
    return _scalar(repair)(patch)


def minimized(patch: Column) -> Column:
    return _scalar(minimal)(patch)
