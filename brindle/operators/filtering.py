"""Explainable filters, staged filters and rule classifiers as column expressions.

Everything here is declarative: reasons are one projection, so a filter on them is pushed
through like any other and no row is read twice.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: All white space that a strip() drops in ASCII text.
WHITE = " \t\r\n\x0b\x0c"


@dataclass(frozen=True)
class Rule:
    """A row that meets `fails` is rejected for `reason`; a null condition does not reject."""

    reason: str
    fails: Column


def reasons(rules: list[Rule]) -> Column:
    """Every rule's reason that applies, in order; rules may share a reason, which then repeats."""
    if not rules:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*(F.when(r.fails, F.lit(r.reason)) for r in rules)))


def with_reasons(df: DataFrame, rules: list[Rule], name: str = "reasons") -> DataFrame:
    return df.withColumn(name, reasons(rules))


def keep(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Rows that no rule rejects. Conditions stay plain predicates, so they reach the scan."""
    for rule in rules:
        df = df.where(~F.coalesce(rule.fails, F.lit(False)))
    return df


def reject_counts(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """(reason, n) over all rejected rows; a reason counts as often as it applies."""
    return df.select(F.explode(reasons(rules)).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def bounds(value: Column, reason_low: str, reason_high: str, low=None, high=None) -> list[Rule]:
    """Inclusive bounds of a count; null counts as 0."""
    v = F.coalesce(value, F.lit(0))
    out = []
    if low is not None:
        out.append(Rule(reason_low, v < F.lit(low)))
    if high is not None:
        out.append(Rule(reason_high, v > F.lit(high)))
    return out


def date_bounds(value: Column, reason: str, after: str | None = None, before: str | None = None) -> list[Rule]:
    """Inclusive bounds of a time; a null time fails each bound that is set."""
    out = []
    if after is not None:
        out.append(Rule(reason, value.isNull() | (value < F.to_timestamp(F.lit(after)).cast("timestamp_ntz"))))
    if before is not None:
        out.append(Rule(reason, value.isNull() | (value > F.to_timestamp(F.lit(before)).cast("timestamp_ntz"))))
    return out


def fold(value: Column) -> Column:
    """Trimmed and lower-cased text, null as empty."""
    return F.lower(F.btrim(F.coalesce(value, F.lit("")), F.lit(WHITE)))


def member(value: Column, allowed: list[str], reason: str) -> list[Rule]:
    """The folded value must be among the folded allowed ones; an empty list allows all."""
    names = sorted({a.strip().lower() for a in allowed})
    return [Rule(reason, ~fold(value).isin(*names))] if names else []


def requires_all(values: Column, needed: list[str], reason: str) -> list[Rule]:
    """All needed values must be in the folded array."""
    names = F.array(*(F.lit(n.strip().lower()) for n in needed))
    have = F.transform(F.coalesce(values, F.array().cast("array<string>")), fold)
    return [Rule(reason, F.size(F.array_except(names, have)) > 0)] if needed else []


def first_filled(*values: Column) -> Column:
    """The first value that is neither null nor empty, else ''."""
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values), F.lit(""))


def staged(df: DataFrame, stages: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """(survivors of all stages, (position, stage, n_in, n_out)): counts come from one pass."""
    passed, counts, so_far = df, [F.count(F.lit(1)).alias("c0")], F.lit(True)
    for i, (_, condition) in enumerate(stages, 1):
        passed = passed.where(condition)
        so_far = so_far & F.coalesce(condition, F.lit(False))
        counts.append(F.count_if(so_far).alias(f"c{i}"))
    rows = F.array(*(F.struct(F.lit(i).cast("long").alias("position"), F.lit(n).alias("stage"), F.col(f"c{i}").alias("n_in"), F.col(f"c{i + 1}").alias("n_out")) for i, (n, _) in enumerate(stages)))
    return passed, df.agg(*counts).select(F.inline(rows))


def confidence(main: Column, markers: Column, keyword: Column) -> Column:
    """Evidence in four levels: high, medium, low, none.

    main: the decisive evidence is there; markers: how many markers are; keyword: any keyword is.
    """
    return (
        F.when(main & (markers >= 2), "high")
        .when((main & (markers >= 1) & keyword) | ((markers >= 3) & keyword), "medium")
        .when(main & keyword, "low")
        .otherwise("none")
    )


LEVELS = ("none", "low", "medium", "high")


def level_rank(level: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, LEVELS)), level) - 1


def keywords_in(text: Column, keywords: list[str]) -> Column:
    """The keywords that a text holds, whatever the case, in the given order."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(low, k))


def path_is(path: Column, name: str) -> Column:
    """The path is name or ends in /name."""
    return (path == name) | path.endswith("/" + name)


def has_tokens(name: Column, tokens: list[str], separators: str = r"[ _/.]+") -> Column:
    """Any of the tokens is a whole token of the lower-cased name."""
    return F.arrays_overlap(F.split(F.lower(name), separators), F.array(*map(F.lit, tokens)))


def words(text: Column) -> Column:
    """Words between white space; none in a null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t\r\n\x0b\x0c]+"), lambda w: w != "")


def at_most(n: Column, most: int, least: int = 0) -> Column:
    return n.between(least, most)


def line_holds_all(text: Column, *parts: str) -> Column:
    """Some line holds all parts, whatever the case."""

    def test(line: Column) -> Column:
        out = F.lit(True)
        for p in parts:
            out = out & F.contains(line, F.lit(p.lower()))
        return out

    return F.exists(F.split(F.lower(F.coalesce(text, F.lit(""))), "\n"), test)
