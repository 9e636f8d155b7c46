"""Source files to flat tables: masked text, nodes, imports, calls, and joins over them.

Parsing is by file and needs a state machine, so it runs in Python over Arrow batches and gives
flat rows; all that follows (scopes, resolution, consumers, ranking) is joins and aggregates.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate, takewhile

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the language: words that only look like methods, words that declare and what
# may stand before them, and what may stand before a member.
CONTROL = ("if", "for", "while", "switch", "catch", "else", "do", "try")
DECLARING = {"struct": (), "class": ("abstract",), "interface": (), "enum": (), "function": ("async",)}
EXPORTING = ("export", "default")
ON_MEMBERS = ("public", "private", "protected", "static", "readonly", "async", "override")
NAME = r"[A-Za-z_$][\w$]*"
#: One token: a name, a number, or a sign.
TOKEN = re.compile(rf"(?P<name>{NAME})|\d[\w$]*|\?\.|=>|\S")
IMPORT = re.compile(r"^\s*import\s+(?P<body>.+?)(?:;)?\s*$", re.M)
MASKED = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|(?P<q>['\"`])(?:\\.|(?!(?P=q)).)*?(?:(?P=q)|\Z)", re.S)


def mask(source: str) -> str:
    """Comments and strings as blanks; length and line ends stay. What is not closed masks the rest."""
    return MASKED.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)


def imports(source: str) -> list[dict]:
    out = []
    for m in IMPORT.finditer(source):
        body = m["body"]
        named = re.search(r"\bfrom\s+['\"]([^'\"]+)['\"]", body)
        bare = re.match(r"['\"]([^'\"]+)['\"]", body.strip())
        origin = named or bare
        out.append({"line": source.count("\n", 0, m.start()) + 1, "source": origin[1] if origin else "", "clause": (body[: named.start()] if named else body).strip()})
    return out


def calls(masked: str) -> list[dict]:
    """Calls of names and dotted chains, by one walk over the tokens."""
    out: list[dict] = []
    chain: list[str] = []
    begun, joined = 0, False
    ends = [i for i, c in enumerate(masked) if c == "\n"]
    for m in TOKEN.finditer(masked):
        token = m[0]
        if m["name"]:
            if not joined:
                chain, begun = [], m.start()
            chain.append(token)
        elif token == "(" and chain and not joined:
            line = bisect_left(ends, begun)
            out.append({"line": line + 1, "column": begun - (ends[line - 1] if line else -1), "callee": ".".join(chain)})
        joined = token in (".", "?.") and bool(chain)
        if not m["name"] and not joined:
            chain = []
    return out


def _leading_decorators(tokens: list[re.Match]) -> list[tuple[int, int]]:
    """(start, end) places of the decorators that a line begins with; arguments end with their bracket."""
    found, i = [], 0
    text = lambda k: tokens[k][0] if k < len(tokens) else ""
    while text(i) == "@" and i + 1 < len(tokens) and tokens[i + 1]["name"]:
        start, i = tokens[i].start(), i + 2
        if text(i) == "." and i + 1 < len(tokens) and tokens[i + 1]["name"]:
            i += 2
        if text(i) == "(":
            open_ = 0
            for k in range(i, len(tokens)):
                open_ += (text(k) == "(") - (text(k) == ")")
                if not open_:
                    i = k + 1
                    break
        found.append((start, tokens[i - 1].end()))
    return found


def _declared(tokens: list[re.Match]) -> tuple[str, str, list[str]] | None:
    """(type, name, modifiers) that the tokens of a line declare."""
    words = [t[0] for t in tokens]
    is_name = [bool(t["name"]) for t in tokens] + [False, False]
    if not words or words[0] == "import" and is_name[1] | (words[1:2] not in ([], ["("])):
        return None
    for i, word in enumerate(words):
        if word in DECLARING and is_name[i + 1]:
            before = list(takewhile(lambda w: w in EXPORTING + DECLARING[word], reversed(words[:i])))
            return word, words[i + 1], before[::-1]
    # a member: modifiers, each before another name, then the name and the sign that tells its kind
    at = 0
    while words[at] in ON_MEMBERS and is_name[at + 1]:
        at += 1
    opens, sign = "{" in words, words[at + 1] if at + 1 < len(words) else ""
    if is_name[at] and sign in (":", "=") and not opens and "(" not in words:
        return "property", words[at], words[:at]
    if is_name[at] and sign == "(" and opens:
        if at == 0 and words[0][0].isupper():
            return "ui_component", words[0], []
        if words[at] not in CONTROL:
            return "method", words[at], words[:at]
    return ("callback", "anonymous", []) if opens and "=>" in words else None


OWNERS = ("class", "struct", "interface")


def nodes(source: str, masked: str | None = None) -> list[dict]:
    """Flat nodes in order: id, parent, depth, type, name, qualified, owner, lines, decorators, modifiers, signature.

    One node a line at most; a node whose line opens a brace lasts to the line that closes it,
    or to the end of the file.
    """
    originals, lines = source.splitlines(), (mask(source) if masked is None else masked).splitlines()
    after = list(accumulate(line.count("{") - line.count("}") for line in lines))
    closes = _closing_lines(after)
    out: list[dict] = []
    waiting: list[str] = []
    open_: list[dict] = []
    for n, (original, line) in enumerate(zip(originals, lines), 1):
        tokens = list(TOKEN.finditer(line))
        marks = _leading_decorators(tokens)
        waiting += [original[x:y] for x, y in marks]
        rest = [t for t in tokens if not marks or t.start() >= marks[-1][1]]
        found = _declared(rest)
        if found is None:
            continue
        kind, name, modifiers = found
        open_ = [x for x in open_ if x["end"] >= n]
        parent = open_[-1] if open_ else None
        shown = f"anonymous@{n}" if name == "anonymous" else name
        opens = any(t[0] == "{" for t in rest)
        node = {
            "id": len(out), "parent": parent and parent["id"], "depth": len(open_) + 1, "type": kind, "name": name,
            "qualified": ".".join([*([parent["qualified"]] if parent else []), shown]),
            "owner": parent and (parent["name"] if parent["type"] in OWNERS else parent["owner"]),
            "start": n, "end": closes(n, after[n - 2] if n > 1 else 0) if opens else n,
            "decorators": [] if kind in ("ui_component", "callback") else waiting, "modifiers": modifiers, "signature": original.strip(),
        }
        out.append(node)
        open_ += [node] if opens else []
        waiting = []
    return out


def _closing_lines(after: list[int]):
    """f(n, depth): the first line from n on that ends at the depth or less; the last one without any."""
    # of all lines from n on, those that end lower than every line between n and them, last first
    lower: list[list[int]] = [[] for _ in after]
    best: dict[int, int] = {}
    for i in range(len(after) - 1, -1, -1):
        best = {d: k for d, k in best.items() if d < after[i]} | {after[i]: i + 1}
        lower[i] = best

    def first(n: int, depth: int) -> int:
        at = [k for d, k in lower[n - 1].items() if d <= depth]
        return min(at, default=len(after))

    return first


NODE = "id int, parent int, depth int, type string, name string, qualified string, owner string, start int, end int, decorators array<string>, modifiers array<string>, signature string"
SHAPES = {"nodes": NODE, "imports": "line int, source string, clause string", "calls": "line int, column int, callee string"}


def parse(files: DataFrame, part: str, path: str = "path", source: str = "source") -> DataFrame:
    """(path, columns of part): nodes, imports or calls of every file."""
    shape = SHAPES[part]
    names = [x.split()[0] for x in shape.split(", ")]
    kinds = {"int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
    types = [kinds[x.split()[1]] for x in shape.split(", ")]
    read = {"nodes": nodes, "imports": imports, "calls": lambda text: calls(mask(text))}[part]

    def run(batches):
        for batch in batches:
            paths, rows = [], []
            for p, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = read(text or "")
                paths += [p] * len(found)
                rows += found
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), *(pa.array([r[n] for r in rows], t) for n, t in zip(names, types))], names=["path", *names])

    return files.select(F.col(path).alias("path"), F.col(source).alias("source")).mapInArrow(run, f"path string, {shape}")


def shuffled(df: DataFrame) -> DataFrame:
    """df for a join that shuffles and sorts it, whatever its size is thought to be.

    Rows that a parser or a generator makes of few columns are many times what the planner expects
    of them; broadcast, all of them would pass through the driver.
    """
    return df.hint("merge")


def language(path: Column) -> Column:
    return F.when(F.lower(path).endswith(".ets"), "ArkTS").when(F.lower(path).endswith(".ts"), "TypeScript").otherwise(F.regexp_extract(path, r"\.([^./]+)$", 1))


SKIPPED = (".git", ".hvigor", ".idea", ".preview", ".vscode", "build", "node_modules", "oh_modules")


def source_files(spark, root: str, extensions=(".ets", ".ts")) -> DataFrame:
    """(path, source) below root: bytes as UTF-8 with replacement, no skipped directories."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    parts = F.split(F.col("path"), "/")
    ok = F.exists(F.array(*map(F.lit, extensions)), lambda e: F.endswith(F.lower("path"), e)) & ~F.arrays_overlap(parts, F.array(*map(F.lit, SKIPPED)))
    return df.where(ok).select("path", F.decode("content", "UTF-8").alias("source"))


def summary(node_rows: DataFrame, import_rows: DataFrame, call_rows: DataFrame, files: DataFrame) -> DataFrame:
    """One row: files, imports, calls, nodes, max_depth and node_types, its keys sorted."""
    types = node_rows.groupBy("type").count().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "count")))).alias("node_types"))
    n = node_rows.agg(F.count(F.lit(1)).alias("nodes"), F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"))
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    # one row on each side
    return one(files, "files").crossJoin(one(import_rows, "imports")).crossJoin(one(call_rows, "calls")).crossJoin(n).crossJoin(types)


def scopes(call_rows: DataFrame, node_rows: DataFrame) -> DataFrame:
    """Each call with the qualified name of the innermost node around it; null at file level."""
    n = node_rows.select("path", "qualified", "start", "end", "depth")
    inside = call_rows.join(n, "path").where(F.col("line").between(F.col("start"), F.col("end")))
    best = inside.groupBy("path", "line", "column", "callee").agg(F.max_by("qualified", F.struct("depth", "start")).alias("scope"))
    return call_rows.join(best, ["path", "line", "column", "callee"], "left")


def prefixed_calls(call_rows: DataFrame, node_rows: DataFrame, prefixes: list[str]) -> DataFrame:
    """Calls whose callee starts with a prefix, with their scopes."""
    hit = F.exists(F.array(*map(F.lit, prefixes)), lambda p: F.startswith(F.col("callee"), p))
    return scopes(call_rows.where(hit), node_rows)


def bindings(import_rows: DataFrame) -> DataFrame:
    """(path, source, kind, imported, local): default, namespace and named imports, aliases kept.

    Resolved imports keep their target.
    """
    clause = F.regexp_replace("clause", r"^type\s+", "")
    star = F.regexp_extract(clause, rf"\*\s+as\s+({NAME})", 1)
    first = F.regexp_extract(clause, rf"^({NAME})", 1)
    inner = F.filter(F.transform(F.split(F.regexp_extract(clause, r"\{([^}]*)\}", 1), ","), lambda x: F.btrim(F.regexp_replace(x, r"^\s*type\s+", ""))), lambda x: x != "")
    named = F.transform(inner, lambda x: F.struct(F.lit("named").alias("kind"), F.get(F.split(x, r"\s+as\s+"), F.lit(0)).alias("imported"), F.element_at(F.split(x, r"\s+as\s+"), -1).alias("local")))
    extra = F.array_compact(F.array(
        F.when(star != "", F.struct(F.lit("namespace").alias("kind"), F.lit("*").alias("imported"), star.alias("local"))),
        F.when(first != "", F.struct(F.lit("default").alias("kind"), F.lit("default").alias("imported"), first.alias("local"))),
    ))
    target = [c for c in import_rows.columns if c == "target"]
    return import_rows.where("source <> ''").select("path", F.col("source"), *target, F.inline(F.concat(named, extra)))


def resolve(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Adds target: the first of base, .ets, .ts, /index.ets, /index.ts that is a file, for relative sources."""
    folder = F.when(F.col("path").contains("/"), F.regexp_replace("path", r"/[^/]*$", "")).otherwise("")
    joined = F.concat(folder, F.lit("/"), F.col("source"))
    segments = F.filter(F.split(joined, "/"), lambda s: (s != "") & (s != "."))
    none = F.array().cast("array<string>")
    step = lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s)))
    base = F.array_join(F.aggregate(segments, none, step), "/")
    tried = F.transform(F.array(*map(F.lit, ("", ".ets", ".ts", "/index.ets", "/index.ts"))), lambda x: F.concat(base, x))
    numbered = edges.where(F.col("source").startswith(".")).select("path", "source", F.posexplode(tried).alias("rank", "target")).distinct()
    found = numbered.join(shuffled(files.select(F.col("path").alias("target"))), "target").groupBy("path", "source").agg(F.min_by("target", "rank").alias("target"))
    return edges.join(shuffled(found), ["path", "source"], "left")


def consumers(edges: DataFrame, node_rows: DataFrame, call_rows: DataFrame) -> DataFrame:
    """(target, name, path, scope, line): calls, in other files, of functions and methods that they import."""
    used = edges.where("target is not null").select("path", "target", "kind", "imported", "local")
    head, last = F.substring_index("callee", ".", 1), F.element_at(F.split("callee", r"\."), -1)
    hit = call_rows.select("path", "line", "column", "callee", head.alias("local"), last.alias("last")).join(used, ["path", "local"])
    name = F.when((F.col("kind") == "named") & (F.col("callee") == F.col("local")), F.col("imported")).otherwise(F.col("last"))
    hit = hit.withColumn("name", name)
    functions = node_rows.where(F.col("type").isin("function", "method")).select(F.col("path").alias("target"), "name").distinct()
    hit = hit.join(functions, ["target", "name"])
    found = scopes(hit.select("path", "line", "column", "callee", "target", "name"), node_rows)
    return found.select("target", "name", "path", "scope", "line").distinct()


def candidates(node_rows: DataFrame, call_rows: DataFrame, used: DataFrame, least_out: int = 3, least_down: int = 2) -> DataFrame:
    """Functions ranked by how many distinct scopes use them, then by distinct callees, path and line."""
    f = node_rows.where(F.col("type").isin("function", "method")).select("path", "name", "qualified", "start", "end")
    inside = f.join(call_rows.select("path", "line", "callee"), "path").where(F.col("line").between(F.col("start"), F.col("end")))
    plain = ~F.col("callee").isin(*CONTROL, "function", "return") & (F.col("callee") != F.col("name")) & ~F.col("callee").endswith("." )
    out = inside.where(plain).groupBy("path", "qualified").agg(F.count_distinct("callee").alias("out_degree"))
    down = used.groupBy(F.col("target").alias("path"), "name").agg(F.count_distinct(F.struct("path", "scope")).alias("downstream"))
    ranked = f.join(out, ["path", "qualified"]).join(down, ["path", "name"])
    return ranked.where((F.col("out_degree") >= least_out) & (F.col("downstream") >= least_down)).orderBy(F.desc("downstream"), F.desc("out_degree"), "path", "start")
