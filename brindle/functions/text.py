"""Text and date helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quote_term(term: Column) -> Column:
    """A search term, in quotes if it holds white space and has none yet."""
    bare = F.btrim(term)
    return F.when(bare.rlike(r"\s") & ~bare.startswith('"'), F.concat(F.lit('"'), bare, F.lit('"'))).otherwise(bare)


def range_qualifier(field: str, low: Column, high: Column) -> Column:
    """field:low..high, or one-sided, or null."""
    name = F.lit(field + ":")
    a, b = low.cast("string"), high.cast("string")
    return (
        F.when(a.isNotNull() & b.isNotNull(), F.concat(name, a, F.lit(".."), b))
        .when(a.isNotNull(), F.concat(name, F.lit(">="), a))
        .when(b.isNotNull(), F.concat(name, F.lit("<="), b))
    )


def search_query(*parts: Column) -> Column:
    """The parts that are set, joined by spaces."""
    return F.concat_ws(" ", *parts)


def month_slices(start: Column, end: Column) -> Column:
    """array<struct<lo,hi>>: calendar months from start to end, cut to those two."""
    months = F.sequence(F.trunc(start, "MM").cast("date"), end, F.expr("interval 1 month"))
    return F.transform(months, lambda m: F.struct(F.greatest(m, start).alias("lo"), F.least(F.last_day(m), end).alias("hi")))


def date_slices(start: Column, end: Column, unit: str) -> Column:
    """array<struct<lo,hi>>: days, calendar months or calendar years from start to end, cut to those two."""
    if unit == "month":
        return month_slices(start, end)
    first, step = {"day": (start, "1 day"), "year": (F.trunc(start, "YEAR").cast("date"), "1 year")}[unit]
    last = (lambda d: d) if unit == "day" else (lambda d: F.make_date(F.year(d), F.lit(12), F.lit(31)))
    return F.transform(F.sequence(first, end, F.expr(f"interval {step}")), lambda d: F.struct(F.greatest(d, start).alias("lo"), F.least(last(d), end).alias("hi")))


def instance_id(repo: Column, number: Column) -> Column:
    """owner__name-number."""
    return F.replace(F.concat_ws("-", repo, number.cast("string")), F.lit("/"), F.lit("__"))


def major_minor(version: Column) -> Column:
    return F.concat_ws(".", F.slice(F.split(version, r"\."), 1, 2))


#: The words that, before an issue number, say that the issue is resolved.
RESOLVING = ("close", "closes", "closed", "fix", "fixes", "fixed", "resolve", "resolves", "resolved")


def resolved_issues(text: Column) -> Column:
    """Numbers behind a resolving word and #, distinct, sorted as text; comments in <!-- --> don't count."""
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)<!--.*?-->", "")
    pattern = F.lit(r"(\w+)\s+#(\d+)")
    pairs = F.arrays_zip(F.regexp_extract_all(clean, pattern, F.lit(1)).alias("word"), F.regexp_extract_all(clean, pattern, F.lit(2)).alias("n"))
    named = F.filter(pairs, lambda p: F.lower(p["word"]).isin(*RESOLVING))
    return F.array_sort(F.array_distinct(F.transform(named, lambda p: p["n"])))


def strip_ansi(text: Column) -> Column:
    """Text without terminal escape sequences."""
    return F.regexp_replace(text, "\x1b\\[[0-9;]*[A-Za-z]", "")


def number_lines(text: Column) -> Column:
    """Each line behind its number."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda line, i: F.concat((i + 1).cast("string"), F.lit(" "), line)), "\n")


def first_diff(text: Column) -> Column:
    """The first <diff> or <patch> block or fenced diff; else another fenced block; else what stands before </s>."""
    tagged = F.regexp_extract(text, r"(?s)<(diff|patch)>(.*?)</\1>", 2)
    fenced = F.regexp_extract(text, r"(?s)```(?:diff|patch)\n(.*?)```", 1)
    other = F.regexp_extract(text, r"(?s)```[a-zA-Z]*\n(.*?)```", 1)
    plain = F.get(F.split(text, "</s>"), F.lit(0))
    return F.coalesce(F.nullif(tagged, F.lit("")), F.nullif(fenced, F.lit("")), F.nullif(other, F.lit("")), plain)


def parse_time(text: Column) -> Column:
    """ISO text as UTC time: a date is midnight, a time without a zone is UTC; bad text raises."""
    return F.to_timestamp(text)


def date_prefix(text: Column) -> Column:
    return F.substring_index(text, "T", 1)


def any_format(text: Column, *formats: str) -> Column:
    """The first format that fits."""
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in formats))


def ratio(part: Column, whole: Column, empty=None) -> Column:
    """part / whole; `empty`, or null, where whole is 0."""
    value = F.try_divide(part.cast("double"), whole.cast("double"))
    return value if empty is None else F.coalesce(value, F.lit(empty))


def short_key(*parts: Column, length: int = 10) -> Column:
    """The first hex digits of a SHA-256."""
    return F.substring(F.sha2(F.concat_ws("\n", *parts), 256), 1, length)


def pack_fold(items: Column, size, most: Column | int) -> Column:
    """In order, the items that still fit: an item that does not is passed over and later ones go on.

    items: an array of structs; size(item) its length. A fold, as no running total can say this.
    """
    kind = F.lit(0).cast("long")
    zero = F.struct(kind.alias("used"), F.filter(items, lambda _: F.lit(False)).alias("kept"))

    def step(acc: Column, item: Column) -> Column:
        total = acc["used"] + size(item).cast("long")
        return F.when(total < most, F.struct(total.alias("used"), F.concat(acc["kept"], F.array(item)).alias("kept"))).otherwise(acc)

    return F.aggregate(items, zero, step)
