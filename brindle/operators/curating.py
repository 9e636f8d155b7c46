"""Filters of benchmark curation: what a statement, a patch and its tests may hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filtering import staged, words

# Words that close an issue, and calls whose messages a test may check.
CLOSING = ("close", "closes", "closed", "fix", "fixes", "fixed", "resolve", "resolves", "resolved")
RAISING = ("pytest.raises", "pytest.warns", "pytest.deprecated_call")
ASSERTING = ("assertOutput", "assertRaises", "checks.Error")
MEDIA = r"(?i)!\[.*?\]\(.*?\.(?:png|jpg|jpeg|gif|svg|webp|mp4|webm|mov)\)|<img\b|\.(?:png|jpg|jpeg|gif|svg|webp|mp4|webm|mov)\b"


def _held(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def names_issue(text: Column) -> Column:
    """A closing word before #n, or a link to issues on the other forge."""
    pairs = F.regexp_extract_all(_held(text), F.lit(r"(\w+)\s+#\d+"), F.lit(1))
    closing = F.exists(pairs, lambda w: F.lower(w).isin(*CLOSING))
    return closing | _held(text).rlike(r"https?://gitlab.com/.*/issues")


def issue_references(df: DataFrame, key: str, repo: str, text: str, issues: DataFrame) -> DataFrame:
    """df with refers: the text names an issue by words, or any #n of it is in issues (repo, number).

    The numbers of all texts are looked up by one semi-join, in place of a request each.
    """
    numbers = F.array_distinct(F.regexp_extract_all(_held(F.col(text)), F.lit(r"#(\d+)"), F.lit(1)))
    asked = df.select(key, F.col(repo).alias("repo"), F.explode(numbers).alias("number")).withColumn("number", F.col("number").try_cast("long"))
    real = asked.join(issues.select("repo", F.col("number").cast("long").alias("number")), ["repo", "number"], "left_semi").select(key).distinct().withColumn("__real", F.lit(True))
    return df.join(real, key, "left").withColumn("refers", names_issue(F.col(text)) | F.coalesce("__real", F.lit(False))).drop("__real")


def changes_file_set(patch: Column) -> Column:
    """The patch adds or removes a file."""
    return _held(patch).rlike(r"(?m)^(?:new file mode|deleted file mode|--- /dev/null|\+\+\+ /dev/null)")


def checks_messages(tests: Column) -> Column:
    """The test patch checks an error's message: a raising call and `match`, or an asserting call."""
    any_of = lambda names: F.exists(F.array(*map(F.lit, names)), lambda x: F.contains(_held(tests), x))
    return F.when(any_of(RAISING), _held(tests).contains("match")).otherwise(any_of(ASSERTING))


def foreign_links(text: Column, repo: Column) -> Column:
    """A link to anywhere but the repository itself."""
    urls = F.regexp_extract_all(_held(text), F.lit(r"https?://[^\s)\]>]+"), F.lit(0))
    return F.exists(urls, lambda u: ~F.contains(u, repo))


def commit_named(text: Column) -> Column:
    """A word of 7 to 40 hexadecimal digits with a digit and a letter among them."""
    return F.exists(F.regexp_extract_all(_held(text), F.lit(r"\b[0-9a-f]{7,40}\b"), F.lit(0)), lambda w: w.rlike("[0-9]") & w.rlike("[a-f]"))


def media_named(text: Column) -> Column:
    return _held(text).rlike(MEDIA)


def patch_size(patch: Column) -> Column:
    """struct(files, hunks) of a unified patch."""
    n = lambda p: F.regexp_count(_held(patch), F.lit(p))
    return F.struct(n(r"(?m)^diff --git ").alias("files"), n(r"(?m)^@@ ").alias("hunks"))


def lite_stages(statement: Column, repo: Column, refers: Column, patch: Column, tests: Column, least_words: int = 40, most_files: int = 1, most_hunks: int = 3) -> list[tuple[str, Column]]:
    """The stages of a light subset: statement, patch, tests."""
    bad = (F.size(words(statement)) <= least_words) | foreign_links(statement, repo) | refers | commit_named(statement) | media_named(statement)
    size = patch_size(patch)
    return [
        ("problem_statement", ~bad),
        ("patch", ~changes_file_set(patch) & (size["files"] <= most_files) & (size["hunks"] <= most_hunks)),
        ("patch_test", ~checks_messages(tests)),
    ]


def light_subset(df: DataFrame, stages: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """(what passes all stages, rows in and out of each stage)."""
    return staged(df, stages)


# requirement and environment files ------------------------------------------------------------

_SPECIFIER = r"(?:[<>=!~]=?[^\n]*|$)"


def _quoted(name: str) -> str:
    import re

    return re.escape(name)


def clean_requirements(text: Column, replacements: list[tuple[str, str | None]]) -> Column:
    """Lines of a package, whatever its version, give way to the replacement, or go where that is None."""
    for name, other in replacements:
        head = rf"(?m)^{_quoted(name)}{_SPECIFIER}"
        text = F.regexp_replace(text, head + (r"\n?" if other is None else ""), other or "")
    return text


def clean_environment(text: Column, replacements: list[tuple[str, str | None]]) -> Column:
    """The same inside the pip section of an environment file, and only there.

    The section follows the line `- pip:` up to the next line that is indented no deeper.
    """
    opener = F.regexp_extract(text, r"(?m)^(\s*-\s*pip\s*:\s*\n)", 1)
    at = F.position(opener, text)
    before = F.left(text, at - 1 + F.length(opener))
    rest = F.substring(text, at + F.length(opener), F.length(text))
    indent = F.length(opener) - F.length(F.ltrim(F.regexp_replace(opener, r"^\s+", "")))
    lines = F.split(rest, "\n")
    # the section ends with the first line that holds something and is indented no deeper
    ends = F.transform(lines, lambda x, i: F.when((F.btrim(x) != "") & (F.length(x) - F.length(F.regexp_replace(x, r"^\s+", "")) <= indent), i))
    end = F.coalesce(F.array_min(F.array_compact(ends)), F.size(lines))
    section, after = F.slice(lines, F.lit(1), end), F.slice(lines, end + 1, F.greatest(F.size(lines) - end, F.lit(0)))
    inner = F.concat(F.array_join(section, "\n"), F.when((F.size(section) > 0) & (F.size(after) > 0), "\n").otherwise(""))
    for name, other in replacements:
        # a package that goes may keep one whose version is excluded, as it always did
        head = rf"(?m)^(\s*-\s*){_quoted(name)}" + (r"(?:[<>~]=?[^\n]*|$)\n?" if other is None else _SPECIFIER)
        inner = F.regexp_replace(inner, head, "" if other is None else f"$1{other}")
    return F.when(opener == "", text).otherwise(F.concat(before, inner, F.array_join(after, "\n")))


def rename_environment(text: Column, name: Column) -> Column:
    """The name line of an environment file set to name."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda x: F.when(x.startswith("name:"), F.concat(F.lit("name: "), name)).otherwise(x)), "\n")


def requirement_texts(files: DataFrame, key: str = "key", path: str = "path", text: str = "text") -> DataFrame:
    """(key, path, text) of requirement files with the files named by -r, of the same key and folder,
    put first in order; editable, comment and extra lines go."""
    rows = files.select(key, path, F.posexplode(F.split(text, "\n")).alias("n", "line"))
    line = F.col("line")
    dropped = F.ltrim(line).startswith("-e .") | F.ltrim(line).startswith("#") | F.ltrim(line).startswith(".[test")
    asks = F.ltrim(line).startswith("-r")
    folder = F.when(F.col(path).contains("/"), F.regexp_replace(F.col(path), r"[^/]*$", "")).otherwise("")
    asked = rows.where(asks).select(key, F.col(path).alias("root"), "n", F.concat(folder, F.btrim(F.substring(line, 3, 1 << 20))).alias("target"))
    kept = rows.where(~asks & ~dropped)
    own = kept.select(key, F.col(path).alias("root"), F.struct(F.lit(1).alias("own"), F.lit(0).alias("at"), "n").alias("o"), "line")
    extra = kept.withColumnRenamed("n", "m").join(asked, (kept[key] == asked[key]) & (kept[path] == asked["target"])).select(kept[key], "root", F.struct(F.lit(0).alias("own"), F.col("n").alias("at"), F.col("m").alias("n")).alias("o"), "line")
    ordered = own.unionByName(extra).groupBy(key, F.col("root").alias(path)).agg(F.array_sort(F.collect_list(F.struct("o", "line"))).alias("ls"))
    return ordered.select(key, path, F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("text"))
