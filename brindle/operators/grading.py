"""Grading of test runs, run reports, action metrics and retrieval recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ratio

PASSED = ("PASSED", "XFAIL")


def grade(expected: DataFrame, statuses: DataFrame, on: list[str], category: str = "category", status: str = "status") -> DataFrame:
    """(keys without the test, category, success, failure): an expected test that is missing has failed.

    expected: keys, test and category; statuses: keys, test and status. on ends in the test's column.
    """
    marked = expected.join(statuses, on, "left").withColumn("ok", F.coalesce(F.col(status).isin(*PASSED), F.lit(False)))
    listed = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col(on[-1]))))
    return marked.groupBy(*on[:-1], category).agg(listed(F.col("ok")).alias("success"), listed(~F.col("ok")).alias("failure"))


def share(success: Column, failure: Column) -> Column:
    """Share of successes; 1 where nothing was expected."""
    return ratio(success, success + failure, 1.0)


def resolution(f2p: Column, p2p: Column) -> Column:
    """FULL: all fixed and none broken; PARTIAL: some fixed and none broken; NO otherwise."""
    return F.when((f2p == 1) & (p2p == 1), "FULL").when((f2p > 0) & (f2p < 1) & (p2p == 1), "PARTIAL").otherwise("NO")


def run_outcomes(dataset: DataFrame, predictions: DataFrame, reports: DataFrame, key: str = "instance_id") -> DataFrame:
    """(key, outcome) of every instance: incomplete, empty_patch, error, resolved or unresolved.

    predictions: key, patch; reports: key, resolved (null where the run ended in an error). A
    prediction for an id outside the dataset doesn't count. These are the id lists of a run, as
    rows: no list grows with the dataset.
    """
    p = predictions.withColumn("submitted", F.lit(True))
    j = dataset.select(key).join(p, key, "left").join(reports.select(key, "resolved"), key, "left")
    outcome = (
        F.when(F.col("submitted").isNull(), "incomplete")
        .when(F.coalesce(F.col("patch"), F.lit("")) == "", "empty_patch")
        .when(F.col("resolved").isNull(), "error")
        .when(F.col("resolved"), "resolved")
        .otherwise("unresolved")
    )
    return j.select(key, outcome.alias("outcome"))


def run_report(outcomes: DataFrame) -> DataFrame:
    """One row of counts over run_outcomes: all, submitted, completed and each outcome."""
    is_ = lambda *names: F.count_if(F.col("outcome").isin(*names))
    return outcomes.agg(
        F.count(F.lit(1)).alias("total_instances"),
        F.count_if(F.col("outcome") != "incomplete").alias("submitted_instances"),
        is_("resolved", "unresolved").alias("completed_instances"),
        *(is_(name).alias(f"{name}_instances") for name in ("resolved", "unresolved", "empty_patch", "error", "incomplete")),
        F.lit(2).cast("long").alias("schema_version"),
    )


def action_metrics(actions: DataFrame, by: list[str], outcome: str = "success") -> DataFrame:
    """Totals, known outcomes, coverage and success rate; rates are null without a denominator."""
    ok, bad = F.count_if(F.col(outcome)), F.count_if(~F.col(outcome))
    known = F.count(outcome)
    total = F.count(F.lit(1))
    return actions.groupBy(*by).agg(
        total.alias("total"), known.alias("known"), ok.alias("succeeded"), bad.alias("failed"), ratio(known, total).alias("coverage"), ratio(ok, known).alias("success_rate")
    )


#: Words that say how an action ended.
GOOD = ("ok", "success", "succeeded", "completed", "passed")
BAD = ("error", "failed", "failure", "cancelled", "timeout")


def outcome(success: Column, is_error: Column, exit_code: Column, status: Column, error: Column) -> Column:
    """Three-valued outcome; the first field that says something decides."""
    s = F.lower(status)
    return (
        F.when(success.isNotNull(), success)
        .when(is_error.isNotNull(), ~is_error)
        .when(exit_code.isNotNull(), exit_code == 0)
        .when(s.isin(*GOOD), True)
        .when(s.isin(*BAD), False)
        .when(error.isNotNull() & (error != ""), False)
    )


def recall(found: Column, gold: Column) -> Column:
    """Share of the gold items that were found; null without gold."""
    return ratio(F.size(F.array_intersect(found, gold)), F.size(F.array_distinct(gold)))


def merge_counts(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """Sums of maps of counts, key by key: (by, key, n). Combined before the shuffle."""
    by = by or []
    return df.select(*by, F.explode(column).alias("key", "n")).groupBy(*by, "key").agg(F.sum("n").alias("n"))
