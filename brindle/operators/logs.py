"""Test logs to test statuses: one table of line rules, ordered computations, and documents.

Line formats are rules in a table; a log is split once, each line is matched by its parser's
rules in the JVM, and the last status of a name wins. Formats that carry a name to a later line
are window computations over the same lines. Only nested reports go through Python.
"""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ("FAILED", "PASSED", "SKIPPED", "ERROR", "XFAIL")

# Line patterns of the test runners. parser: (pattern, group of the name, group of
# the outcome, outcomes), tried in order; the first that matches a line decides.
RULES: dict[str, list[tuple[str, int, int, dict[str, str]]]] = {
    "redis": [
        (r"^\[(err)\]:\s(.+?)(?:\s+in\s+\S+)?(?:\s\((\d+\s*m?s)\))?$", 2, 1, {"err": "FAILED"}),
        (r"^\[(ok|skip|ignore)\]:\s(.+?)(?:\s\((\d+\s*m?s)\))?$", 2, 1, {"ok": "PASSED", "skip": "SKIPPED", "ignore": "SKIPPED"}),
    ],
    "jq": [(r"^\s*(PASS|FAIL):\s(.+)$", 2, 1, {"PASS": "PASSED", "FAIL": "FAILED"})],
    "micropython": [(r"^(pass|FAIL|skip)\s+(.+)$", 2, 1, {"pass": "PASSED", "FAIL": "FAILED", "skip": "SKIPPED"})],
    "googletest": [(r"^.*\[\s*(OK|FAILED)\s*\]\s(.*)\s\(.*\)$", 2, 1, {"OK": "PASSED", "FAILED": "FAILED"})],
    "gotest": [(r"^--- (PASS|FAIL|SKIP): (.+) \((.+)\)$", 2, 1, {"PASS": "PASSED", "FAIL": "FAILED", "SKIP": "SKIPPED"})],
    "ant": [(r"^\s*\[junit\]\s+\[(PASS|FAIL|ERR)\]\s+(.*)$", 2, 1, {"PASS": "PASSED", "FAIL": "FAILED", "ERR": "FAILED"})],
    "jest": [(r"^\s*(✓|✕|○)\s(.+?)(?:\s\((\d+\s*m?s)\))?$", 2, 1, {"✓": "PASSED", "✕": "FAILED", "○": "SKIPPED"})],
    "jest_json": [(r"^\[(PASSED|FAILED)\]\s(.+)$", 2, 1, {"PASSED": "PASSED", "FAILED": "FAILED"})],
    "vitest": [(r"^\s*(✓|×|↓)\s(.+?)(?:\s(\d+\s*m?s?|\[skipped\]))?$", 2, 1, {"✓": "PASSED", "×": "FAILED", "↓": "SKIPPED"})],
    "tap": [(r"^(ok|not ok) (\d+) (.+)$", 3, 1, {"ok": "PASSED", "not ok": "FAILED"})],
    "react_pdf": [(rf"^({w})\s(.*){tail}", 2, 1, {w: s}) for w, s in (("PASS", "PASSED"), ("FAIL", "FAILED")) for tail in (r"\s\([\d.]+ms\)", r"\s\([\d.]+\ss\)", r"\s\([\d.]+s\)", "")],
    "minitest": [(r"^(.+)\. .*=.*(\.|F|E).*$", 1, 2, {".": "PASSED", "F": "FAILED", "E": "FAILED"})],
    "cucumber": [(r"^(.*) \.+(\.|F)", 1, 2, {".": "PASSED", "F": "FAILED"})],
    "ruby_unit": [(r"^\s*(?:test: )?(.+):\s+(\.|E\b|F\b|O\b)", 1, 2, {".": "PASSED", "E": "FAILED", "F": "FAILED", "O": "SKIPPED"})],
    "rspec": [(r"^(.+) - (passed|failed)", 1, 2, {"passed": "PASSED", "failed": "FAILED"})],
    "cargo": [(r"^test\s+(\S+)\s+\.\.\.\s+(\w+)$", 1, 2, {"ok": "PASSED", "FAILED": "FAILED"})],
    "marked": [(r"^(\d+\))\s(.*)$", 2, 1, {"": "FAILED"})],
}

#: Parsers whose rules see the line as it is; the others see it trimmed.
RAW = ("react_pdf", "marked")


def lines(logs: DataFrame, key: str, log: str) -> DataFrame:
    """(key, n, line)."""
    return logs.select(key, F.posexplode(F.split(F.coalesce(F.col(log), F.lit("")), "\n")).alias("n", "line"))


def _trim(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\r\n\x0b\x0c"))


def last_status(found: DataFrame, key: str) -> DataFrame:
    """(key, test, status): the status on the last line that names a test."""
    return found.groupBy(key, "test").agg(F.max_by("status", "n").alias("status"))


def _rule_match(parser: str, line: Column) -> Column:
    """struct(test, status) of a line, or null."""
    out = None
    for pattern, name, outcome, mapping in RULES[parser]:
        word = F.regexp_extract(line, pattern, outcome)
        status = F.lit(next(iter(mapping.values()))) if "" in mapping else F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv))[word]
        test = F.regexp_extract(line, pattern, name)
        hit = F.struct((_trim(test) if parser == "marked" else test).alias("test"), status.alias("status"))
        out = F.when(line.rlike(pattern), hit) if out is None else out.when(line.rlike(pattern), hit)
    return out


def by_rules(logs: DataFrame, parser: str, key: str = "instance_id", log: str = "log") -> DataFrame:
    """Statuses by the line rules of one parser."""
    line = F.col("line") if parser in RAW else _trim(F.col("line"))
    found = lines(logs, key, log).select(key, "n", _rule_match(parser, line).alias("m")).where("m.status is not null")
    return last_status(found.select(key, "n", "m.test", "m.status"), key)


def _starts(line: Column, words=STATUSES) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.startswith(line, w))


def _fields(line: Column) -> Column:
    return F.filter(F.split(line, r"[ \t\r\n\x0b\x0c]+"), lambda w: w != "")


def pytest_lines(logs: DataFrame, variant: str = "plain", key: str = "instance_id", log: str = "log") -> DataFrame:
    """Lines that start with a status word; the name is the second word.

    options: an absolute path in name[option] is cut to its last part. loose: colours and
    control characters go first, and the status may end the line. enums: two enum names read
    as their numbers. numeric words after the status of a failure lose ' - '.
    """
    line = F.col("line")
    if variant == "loose":
        line = F.regexp_replace(F.regexp_replace(line, r"\[(\d+)m", ""), "[\x01-\x1f]", "")
    if variant == "enums":
        line = F.replace(F.replace(line, F.lit("MouseButton.LEFT"), F.lit("1")), F.lit("MouseButton.RIGHT"), F.lit("3"))
    df = lines(logs, key, log).withColumn("line", line)
    line = F.col("line")
    plain = F.when(line.startswith("FAILED"), F.replace(line, F.lit(" - "), F.lit(" "))).otherwise(line)
    df = df.withColumn("w", _fields(F.when(_starts(line), plain).otherwise(line)))
    ends = F.exists(F.array(*map(F.lit, STATUSES)), lambda w: F.endswith(line, w))
    first, second = F.get("w", F.lit(0)), F.get("w", F.lit(1))
    test = second
    if variant == "options":
        option = F.regexp_extract(second, r"^(.*?)\[(.*)\]", 2)
        cut = option.startswith("/") & ~option.startswith("//") & ~option.contains("*")
        name = F.concat(F.regexp_extract(second, r"^(.*?)\[(.*)\]", 1), F.lit("["), F.when(cut, F.concat(F.lit("/"), F.element_at(F.split(option, "/"), -1))).otherwise(option), F.lit("]"))
        test = F.when(second.rlike(r"\[.*\]"), name).otherwise(second)
    hit = F.when(_starts(line), F.struct(test.alias("test"), first.alias("status")))
    if variant == "loose":
        hit = hit.when(ends, F.struct(first.alias("test"), second.alias("status")))
    found = df.where(F.size("w") >= 2).select(key, "n", hit.alias("m")).where("m is not null")
    return last_status(found.select(key, "n", "m.test", "m.status"), key)


def seaborn(logs: DataFrame, key: str = "instance_id", log: str = "log") -> DataFrame:
    """FAILED first: the second word; ' PASSED ' as the second word: the first; PASSED first: the second."""
    df = lines(logs, key, log).withColumn("w", _fields(F.col("line")))
    line, first, second = F.col("line"), F.get("w", F.lit(0)), F.get("w", F.lit(1))
    row = lambda t, s: F.struct(t.alias("test"), F.lit(s).alias("status"))
    hit = F.when(line.startswith("FAILED"), row(second, "FAILED")).when(line.contains(" PASSED "), F.when(second == "PASSED", row(first, "PASSED"))).when(line.startswith("PASSED"), row(second, "PASSED"))
    found = df.select(key, "n", hit.alias("m")).where("m.test is not null")
    return last_status(found.select(key, "n", "m.test", "m.status"), key)


def sympy(logs: DataFrame, key: str = "instance_id", log: str = "log") -> DataFrame:
    """Headings of failures anywhere in the log come first; result lines override them."""
    pattern = F.lit(r"(_*) (.*)\.py:(.*) (_*)")
    heads = F.arrays_zip(F.regexp_extract_all(log, pattern, F.lit(2)).alias("a"), F.regexp_extract_all(log, pattern, F.lit(3)).alias("b"))
    failed = logs.select(key, F.explode(heads).alias("h")).select(key, F.lit(-1).alias("n"), F.concat("h.a", F.lit(".py:"), "h.b").alias("test"), F.lit("FAILED").alias("status"))
    line = _trim(F.col("line"))
    status = F.when(line.endswith(" E"), "ERROR").when(line.endswith(" F"), "FAILED").when(line.endswith(" ok"), "PASSED")
    found = lines(logs, key, log).where(line.startswith("test_")).select(key, "n", F.get(_fields(line), F.lit(0)).alias("test"), status.alias("status"))
    return last_status(failed.unionByName(found.where("status is not null")), key)


def phpunit(logs: DataFrame, key: str = "instance_id", log: str = "log") -> DataFrame:
    """Marked lines under the latest suite heading; before any heading the suite reads None."""
    line, mark = F.col("line"), r"^\s*([✔✘↩])\s*(.*)$"
    heading = r"^(\w.+) \(.+\)$"
    w = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = lines(logs, key, log).withColumn("suite", F.last(F.when(line.rlike(heading), F.regexp_extract(line, heading, 1)), ignorenulls=True).over(w))
    status = F.create_map(F.lit("✔"), F.lit("PASSED"), F.lit("✘"), F.lit("FAILED"), F.lit("↩"), F.lit("SKIPPED"))[F.regexp_extract(line, mark, 1)]
    test = F.concat(F.coalesce("suite", F.lit("None")), F.lit(" > "), F.regexp_extract(line, mark, 2))
    return last_status(df.where(~line.rlike(heading) & line.rlike(mark)).select(key, "n", test.alias("test"), status.alias("status")), key)


def gradle(logs: DataFrame, key: str = "instance_id", log: str = "log") -> DataFrame:
    """name and status on one line, or a name line and later a bare status line."""
    line = _trim(F.col("line"))
    full, name, bare = r"^([^>].+)\s+(PASSED|FAILED)$", r"^([^>]\S*\s+>\s+\S+)$", r"^(PASSED|FAILED)$"
    kind = F.when(line.rlike(full), "full").when(line.rlike(name), "name").when(line.rlike(bare), "bare")
    df = lines(logs, key, log).select(key, "n", line.alias("line"), kind.alias("kind")).where("kind is not null")
    w = Window.partitionBy(key).orderBy("n")
    before = F.when(F.lag("kind").over(w) == "name", F.lag("line").over(w))
    df = df.withColumn("test", F.when(F.col("kind") == "full", F.regexp_extract("line", full, 1)).when(F.col("kind") == "bare", before))
    status = F.when(F.col("kind") == "full", F.regexp_extract("line", full, 2)).otherwise(F.col("line"))
    return last_status(df.where("kind <> 'name' and test is not null").select(key, "n", "test", status.alias("status")), key)


def maven(logs: DataFrame, key: str = "instance_id", log: str = "log") -> DataFrame:
    """Tests and build results in the order in which a queue pairs them.

    A result takes the oldest waiting test; a result that finds none waits itself and is paired
    at the end. With T tests and R results so far, the results that found no test number
    E = max(0, the largest R - T so far), so all of it is running counts: a result that takes
    E up is early, any other is number R - E of the rest, and early ones follow after those.
    """
    line = _trim(F.col("line"))
    test, result = r"^.*-Dtest=(\S+).*$", r"^.*BUILD (SUCCESS|FAILURE)$"
    events = F.array_compact(F.array(F.when(line.rlike(test), F.struct(F.lit(0).alias("r"), F.regexp_extract(line, test, 1).alias("v"))), F.when(line.rlike(result), F.struct(F.lit(1).alias("r"), F.regexp_extract(line, result, 1).alias("v")))))
    df = lines(logs, key, log).select(key, "n", F.inline(events))
    order = Window.partitionBy(key).orderBy("n", "r")
    w = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("rs", F.sum("r").over(w)).withColumn("ts", F.sum(1 - F.col("r")).over(w))
    df = df.withColumn("e", F.greatest(F.lit(0), F.max(F.col("rs") - F.col("ts")).over(w)))
    df = df.withColumn("early", (F.col("r") == 1) & (F.col("e") > F.coalesce(F.lag("e").over(order), F.lit(0))))
    ready = F.sum(F.when((F.col("r") == 1) & ~F.col("early"), 1).otherwise(0)).over(Window.partitionBy(key))
    df = df.withColumn("i", F.when(F.col("early"), ready + F.col("e")).otherwise(F.col("rs") - F.col("e")))
    tests = df.where("r = 0").select(key, F.col("ts").alias("i"), F.col("v").alias("test"))
    results = df.where("r = 1").select(key, "i", F.when(F.col("v") == "SUCCESS", "PASSED").otherwise("FAILED").alias("status"))
    return last_status(tests.join(results, [key, "i"]).select(key, F.col("i").alias("n"), "test", "status"), key)


def django(logs: DataFrame, key: str = "instance_id", log: str = "log") -> DataFrame:
    """Result suffixes and prefixes by line, a carried name for a late ok, and three interrupted forms."""
    line = _trim(F.col("line"))
    df = lines(logs, key, log).select(key, "n", line.alias("line"))
    line = F.col("line")
    w = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("prev", F.last(F.when(line.contains(" ... "), F.substring_index(line, " ... ", 1)), ignorenulls=True).over(w))
    row = lambda i, t, s: F.struct(F.lit(i).alias("i"), t.alias("test"), F.lit(s).alias("status"))
    # one known line runs into the line before it
    own = F.when(line.startswith("Applying sites.0002_alter_domain_unique...test_no_migrations"), _trim(F.regexp_replace(line, r"^.*?\.\.\.", ""))).otherwise(line)
    ok = r"(?: \.\.\. ok| \.\.\. OK| \.\.\.  OK)$"
    second = F.get(_fields(line), F.lit(1))
    hits = F.array(
        F.when(line.contains("--version is equivalent to version"), row(0, F.lit("--version is equivalent to version"), "PASSED")),
        F.when(line.rlike(ok), row(1, F.regexp_replace(own, ok, ""), "PASSED")),
        F.when(line.contains(" ... skipped"), row(2, F.substring_index(line, " ... skipped", 1), "SKIPPED")),
        F.when(line.endswith(" ... FAIL"), row(3, F.substring_index(line, " ... FAIL", 1), "FAILED")),
        F.when(line.startswith("FAIL:"), row(4, second, "FAILED")),
        F.when(line.endswith(" ... ERROR"), row(5, F.substring_index(line, " ... ERROR", 1), "ERROR")),
        F.when(line.startswith("ERROR:"), row(6, second, "ERROR")),
        F.when(line.startswith("ok") & F.col("prev").isNotNull(), row(7, F.col("prev"), "PASSED")),
    )
    found = df.select(key, "n", F.inline(F.array_compact(hits))).select(key, F.struct("n", "i").alias("n"), "test", "status")
    forms = [
        r"(?m)^(.*?)\s\.\.\.\sTesting against Django installed in (?s:.*?) silenced\)\.\nok$",
        r"(?m)^(.*?)\s\.\.\.\sInternal Server Error: /.*/\nok$",
        r"(?m)^(.*?)\s\.\.\.\sSystem check identified no issues \(0 silenced\)\nok$",
    ]
    late = [logs.select(key, F.explode(F.regexp_extract_all(log, F.lit(p), F.lit(1))).alias("test")).select(key, F.struct(F.lit(1 << 30).alias("n"), F.lit(i).alias("i")).alias("n"), "test", F.lit("PASSED").alias("status")) for i, p in enumerate(forms)]
    for part in late:
        found = found.unionByName(part)
    return last_status(found.where("test is not null"), key)


# nested reports ------------------------------------------------------------------------------


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip())


def _outline(rows, sibling_replaces: bool):
    """(names of the open headings, mark, name) of each marked row of an indented report.

    rows: (indent, mark, name); a row without a mark is a heading. Where siblings replace, a
    heading closes those of its own depth and deeper. Else a heading opens a level if it is deeper
    than the heading before, closes one if it is shallower, and names nothing if it is neither.
    """
    names: dict[int, str] = {}
    level, before = 0, -1
    for indent, mark, name in rows:
        if mark:
            yield [names[k] for k in sorted(names) if sibling_replaces or k <= level], mark, name
        elif indent and sibling_replaces:
            names = {k: v for k, v in names.items() if k < indent} | {indent: name}
        elif indent:
            level += (indent > before) - (indent < before)
            if indent > before:
                names[level] = name
            before = indent


JEST_ROW = re.compile(r"(?P<indent>[^\S\n]*)(?:(?P<mark>[✓✕])\s)?(?P<name>.*?)(?P<time>\s*\(\d+ms\))?\s*$")
BROWSER_ROW = re.compile(r"(?P<indent>\s*)(?P<mark>[✔✖]?)\s(?P<name>.*)$")


def _rows(pattern: re.Pattern, text: list[str]):
    for line in text:
        if m := pattern.match(line):
            yield len(m["indent"] or ""), m["mark"], m["name"]


def _nested_jest(log: str) -> dict[str, str]:
    """Headings by indentation over checked and crossed tests, in each run up to its summary."""
    out = {}
    for run in log.split(" ./node_modules/.bin/jest ")[1:]:
        body = re.split(r"(?m)^(?:Test Suites|  ● )", run, maxsplit=1)[0]
        rows = [r for r in _rows(JEST_ROW, body.split("\n")) if r[0]]
        out.update({" - ".join([*path, name]): "PASSED" if mark == "✓" else "FAILED" for path, mark, name in _outline(rows, True)})
    return out


def _browser_tree(log: str) -> dict[str, str]:
    """The outline between the start of the browser and the summary."""
    body = re.split(r"(?m)^SUMMARY:", log, maxsplit=1)[0].split("\n")
    first = next((i for i, line in enumerate(body) if "Starting browser" in line), len(body))
    rows = _rows(BROWSER_ROW, [line for line in body[first + 1 :] if "Starting browser" not in line])
    return {" > ".join([*path, name]): "PASSED" if mark == "✔" else "FAILED" for path, mark, name in _outline(rows, False)}


ANSI = re.compile(r"\x1b\[[0-9;]*[A-Za-z]")


def _browser_failures(log: str) -> dict[str, str]:
    return {m: "FAILED" for m in re.findall(r"(?m)Chrome\s[\d.]+[^\S\r\n]\(.+?\)[^\S\r\n](.*)FAILED$", ANSI.sub("", log))}


#: A dumped object or list: from a line that ends in its opening to the line that is its closing
#: alone, or to the end; or a line that is one whole.
DUMP = re.compile(r"^(?:[^\n]*\{[^\S\n]*$.*?(?:^\}[^\S\n]*$|\Z)|[^\n]*\[[^\S\n]*$.*?(?:^\][^\S\n]*$|\Z)|\{[^\n]*\}[^\S\n]*$|\[[^\n]*\][^\S\n]*$)\n?", re.M | re.S)
TAG = re.compile(r"<(/?)(\w+)>")


def _without_elements(text: str) -> str:
    """The text without its balanced <x>...</x> elements."""
    opened: dict[str, list[int]] = {}
    spans: list[tuple[int, int]] = []
    for m in TAG.finditer(text):
        if not m[1]:
            opened.setdefault(m[2], []).append(m.start())
        elif opened.get(m[2]):
            start = opened[m[2]].pop()
            spans = [x for x in spans if x[0] < start] + [(start, m.end())]
            # what opened inside the element goes with it
            opened = {k: [x for x in v if x < start] for k, v in opened.items()}
    kept, at = [], 0
    for start, end in spans:
        kept.append(text[at:start])
        at = end
    return "".join([*kept, text[at:]])


def _numbered_failures(log: str) -> dict[str, str]:
    """Numbered blocks: titles each deeper than the one before, up to the first colon."""
    body = _without_elements(DUMP.sub("", ANSI.sub("", log))).split("\n")
    out = {}
    for i, line in enumerate(body):
        head = re.match(r"\s*\d+\)(?=\s)", line)
        titles, depth = [], 0
        for title in [line[head.end() :], *body[i + 1 :]] if head else []:
            if _indent(title) <= depth:
                break
            depth = _indent(title)
            titles.append(title.split(":", 1)[0].strip())
            if ":" in title:
                out[":".join(titles)] = "FAILED"
                break
    return out


def _xml_report(log: str) -> dict[str, str]:
    """A sub-case fails with any expression inside it that did not succeed."""
    import io
    import xml.etree.ElementTree as ET

    found = re.search(r"<doctest.*?</doctest>", log, re.S)
    out: dict[str, str] = {}
    cases, subs = [], []
    for event, e in ET.iterparse(io.StringIO(found[0]), ("start", "end")) if found else ():
        around = {"TestCase": cases, "SubCase": subs}.get(e.tag)
        if around is not None and event == "end":
            around.pop()
        elif around is cases:
            cases.append(e.get("name"))
        elif around is subs:
            subs.append(f"{cases[-1] if cases else None} > {e.get('name')}")
            out[subs[-1]] = "PASSED"
        elif e.tag == "Expression" and event == "start" and e.get("success") != "true":
            out.update(dict.fromkeys(subs, "FAILED"))
    return out


DOCUMENTS = {"calypso": _nested_jest, "karma": _browser_tree, "chart_js": _browser_failures, "p5js": _numbered_failures, "doctest": _xml_report}


def by_document(logs: DataFrame, parser: str, key: str = "instance_id", log: str = "log") -> DataFrame:
    """Statuses of formats that need the whole log at once, in Arrow batches."""
    parse = DOCUMENTS[parser]
    kind = logs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = [(k, t, s) for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for t, s in parse(text or "").items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], batch.schema.field(0).type), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], names=[key, "test", "status"])

    return logs.select(key, log).mapInArrow(run, f"{key} {kind}, test string, status string")


ALIASES = {
    **dict.fromkeys(("astroid", "flask", "marshmallow", "pvlib", "pyvista", "sqlfluff", "xarray"), "pytest"),
    **dict.fromkeys(("pydicom", "requests", "pylint"), "pytest_options"),
    **dict.fromkeys(("astropy", "scikit", "sphinx"), "pytest_v2"),
}

PARSERS = {
    **{p: (lambda logs, p=p, **k: by_rules(logs, p, **k)) for p in RULES},
    **{p: (lambda logs, p=p, **k: by_document(logs, p, **k)) for p in DOCUMENTS},
    "pytest": lambda logs, **k: pytest_lines(logs, "plain", **k),
    "pytest_options": lambda logs, **k: pytest_lines(logs, "options", **k),
    "pytest_v2": lambda logs, **k: pytest_lines(logs, "loose", **k),
    "matplotlib": lambda logs, **k: pytest_lines(logs, "enums", **k),
    "seaborn": seaborn, "sympy": sympy, "phpunit": phpunit, "gradle": gradle, "maven": maven, "django": django,
}

# Pull requests of two projects whose runs used one parser or another.
BY_REQUEST = {
    "immutable_js": {"2006": "jest", "2005": "jest_json"},
    "jekyll": {"9141": "minitest", "8047": "minitest", "8167": "minitest", "8761": "cucumber", "8771": "cucumber"},
}


def parser_for(name: str, instance_id: str = "") -> str:
    """The parser behind a name: itself, an alias, or by the instance's request number."""
    if name in BY_REQUEST:
        number = instance_id.rsplit("-", 1)[-1]
        if number not in BY_REQUEST[name]:
            raise ValueError(f"no parser for {instance_id}")
        return BY_REQUEST[name][number]
    return ALIASES.get(name, name)


def parse(logs: DataFrame, parser: str, key: str = "instance_id", log: str = "log") -> DataFrame:
    """(key, test, status) of logs of one format."""
    return PARSERS[parser_for(parser)](logs, key=key, log=log)


def section(log: Column, start: str, end: str) -> Column:
    """What stands between the first start mark and the next end mark; null without both."""
    after = F.split(log, F.lit(re.escape(start)), 2)
    return F.when(log.contains(start) & F.get(after, F.lit(1)).contains(end), F.substring_index(F.get(after, F.lit(1)), end, 1))


# Marks of a run that cannot be graded, and those around the tests' own output.
BAD_CODES = (">>>>> Patch Apply Failed", ">>>>> Reset Failed", ">>>>> Tests Errored", ">>>>> Tests Timed Out")
START, END = ">>>>> Start Test Output", ">>>>> End Test Output"


def gradable(logs: DataFrame, log: str = "log") -> DataFrame:
    """Adds applied (no bad code, and both marks stand in the log) and tests, the part to parse.

    The part is what stands between the marks; a log without both has none. A null log is not applied.
    """
    text = F.coalesce(F.col(log), F.lit(""))
    bad = reduce(lambda x, y: x | y, (text.contains(code) for code in BAD_CODES))
    return logs.withColumns({"applied": ~bad & text.contains(START) & text.contains(END), "tests": F.when(~bad, section(text, START, END))})


def parse_evaluations(logs: DataFrame, parser: str, key: str = "instance_id", log: str = "log") -> DataFrame:
    """(key, test, status) of gradable logs: of the part between the marks, or of the whole log
    where that part holds no status."""
    fit = gradable(logs.select(key, log), log).where("applied")
    inner = parse(fit.select(key, F.col("tests").alias(log)), parser, key, log)
    rest = parse(fit.select(key, log).join(inner.select(key).distinct(), key, "left_anti"), parser, key, log)
    return inner.unionByName(rest)


def parse_mixed(logs: DataFrame, project: str = "project", key: str = "instance_id", log: str = "log", projects: list[str] | None = None) -> DataFrame:
    """(key, test, status) of logs of many projects, each by its own format.

    projects bounds the formats that are planned; by default the distinct ones are asked for. A
    log is read once by its own format only, since each branch filters on the project.
    """
    if projects is None:
        projects = sorted(r[0] for r in logs.select(project).distinct().collect() if r[0] is not None)
    parts = [parse(logs.where(F.col(project) == p), p, key, log) for p in projects]
    return reduce(DataFrame.unionByName, parts)
