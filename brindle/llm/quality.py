"""Quality rules at host level: shrunken failure rates decide beside a document's own counts.

Main path: DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, SPACE, let, materialize


@dataclass(frozen=True)
class Rules:
    """Documented limits; rates are whole per cents so that no rounding enters."""

    min_words: int = 50
    max_repeat_pct: int = 50
    max_symbol_pct: int = 10  # of the characters in words
    max_dup_line_pct: int = 30  # of the lines that hold a word
    min_mean_chars: int = 3  # characters a word
    max_mean_chars: int = 12
    watch_rate: float = 0.3  # a host at or over this has its documents held to one soft rule
    block_rate: float = 0.6  # a host at or over this loses all its documents
    least_strength: float = 1.0
    most_strength: float = 1000.0


def _repeat_words(words: Column) -> Column:
    """Words that lie in 3-word windows found twice or more. Sorted window hashes: n log n."""
    # The windows are told apart by a chained 64-bit hash; within one text a clash is out of reach.
    n = F.size(words)
    grams = F.when(
        n >= 3,
        F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(starts: Column) -> Column:
        gaps = F.transform(starts, lambda p, i: F.coalesce(F.least(F.lit(3), F.get(starts, i + 1) - p), F.lit(3)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda total, x: total + x)

    def repeated(pairs: Column) -> Column:
        same = lambda x, y: F.coalesce(F.get(pairs, x)["h"] == y["h"], F.lit(False))
        return F.transform(F.filter(pairs, lambda y, i: same(i - 1, y) | same(i + 1, y)), lambda y: y["i"])

    def count(gs: Column) -> Column:
        pairs = F.sort_array(F.transform(gs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        # get() treats a negative index as out of range, so the first pair has no predecessor
        return F.when(F.size(F.array_distinct(gs)) == F.size(gs), F.lit(0).cast("long")).otherwise(
            let(pairs, lambda ps: let(F.sort_array(repeated(ps)), covered))
        )

    return let(grams, count)


def rule_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", rules: Rules = Rules()) -> DataFrame:
    """One row a document: its id, host and counts. A null text has no words; a null host is ''."""
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    df = df.select(
        "doc_id",
        "host",
        F.filter(F.split("t", SPACE + "+"), lambda w: w != "").alias("words"),
        F.length(F.regexp_replace("t", SPACE + "+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.filter(F.split("t", "\n"), lambda line: line.rlike(NOT_SPACE)).alias("lines"),
    )
    df = df.select(
        "doc_id",
        "host",
        F.size("words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        _repeat_words(F.col("words")).alias("n_repeat_words"),
    )
    n = F.col("n_words")
    soft = [
        F.col("n_symbols") * 100 > F.col("word_chars") * rules.max_symbol_pct,
        F.col("n_dup_lines") * 100 > F.col("n_lines") * rules.max_dup_line_pct,
        (F.col("word_chars") < n * rules.min_mean_chars) | (F.col("word_chars") > n * rules.max_mean_chars),
    ]
    return df.withColumns(
        {
            "base_failed": (n < rules.min_words) | (F.col("n_repeat_words") * 100 > n * rules.max_repeat_pct),
            "n_soft": sum((F.when(x, 1).otherwise(0) for x in soft[1:]), F.when(soft[0], 1).otherwise(0)),
        }
    )


def host_rates(counts: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(host, n_docs, n_failed, host_rate): failure rates shrunk towards all hosts' mean.

    The beta prior has its mean from all documents and its strength by the method of moments
    from the spread of the hosts' rates, weighted by their documents. Two numbers reach the driver.
    """
    failed = F.col("base_failed") | (F.col("n_soft") > 0)
    hosts = materialize(counts.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(failed).alias("n_failed")), "hosts")
    f, n = F.col("n_failed"), F.col("n_docs")
    total, bad, squares = hosts.agg(F.sum(n), F.sum(f), F.sum(f * f / n)).first()
    if not total:
        return hosts.withColumn("host_rate", F.lit(0.0))
    mean = bad / total
    spread = squares / total - mean * mean
    strength = rules.most_strength if spread <= 0 else min(max(mean * (1 - mean) / spread - 1, rules.least_strength), rules.most_strength)
    return hosts.withColumn("host_rate", (f + F.lit(mean * strength)) / (n + F.lit(strength)))


def quality_verdicts(docs: DataFrame, rules: Rules = Rules(), **columns: str) -> DataFrame:
    """Counts of every document with its host's verdict joined back.

    A document is kept unless it fails a base rule, its host is blocked, or it fails more soft
    rules than its host's standing allows (one at a host in good standing, none at a watched
    one). The counts are written once; a hot host's rows meet only in pre-aggregated counts,
    and the small host table is joined by the size that the planner sees (skewed hosts are
    split by adaptive execution otherwise).
    """
    counts = materialize(rule_counts(docs, rules=rules, **columns), "counts")
    rated = counts.join(host_rates(counts, rules).select("host", "host_rate"), "host", "left")
    rate = F.col("host_rate")
    verdict = (rate < rules.block_rate) & (F.col("n_soft") <= F.when(rate < rules.watch_rate, 1).otherwise(0))
    return rated.withColumn("kept", ~F.col("base_failed") & verdict)
