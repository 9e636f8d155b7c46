"""Line dedup by the number of distinct sites that show a line.

Main path: DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, column, materialize

TRIM = " \t\r\x0b\x0c"


@dataclass(frozen=True)
class Spread:
    """min_sites: sites from which a line counts as boilerplate. A sketch's relative
    standard error is 1.04 / sqrt(2 ** lg_k); within band standard errors of min_sites
    the exact count decides."""

    min_sites: int = 5
    lg_k: int = 11
    band: float = 4.0

    @property
    def margin(self) -> float:
        return self.band * 1.04 / 2 ** (self.lg_k / 2)


def line_rows(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """(id, key, site, pos, h, c) of every line with a word; h and c are 96 bits of its hash."""
    df = docs.select(column(id_col).alias("id"), F.xxhash64(column(text_col)).alias("key"), column(site_col).cast("string").alias("site"), F.posexplode(F.split(column(text_col), "\n")).alias("pos", "line"))
    df = df.where(F.col("line").rlike(NOT_SPACE)).withColumn("line", F.btrim("line", F.lit(TRIM)))
    return df.select("id", "key", "site", "pos", F.xxhash64("line").alias("h"), F.hash("line").alias("c"))


def boilerplate(rows: DataFrame, spread: Spread = Spread()) -> DataFrame:
    """(h, c, first) of lines on min_sites sites or more; first is the smallest id that has the line.

    HyperLogLog sketches of the sites merge by aggregation, combined before the shuffle, so a
    line in a third of all rows sends one sketch a task. Lines whose estimate is near the
    threshold, and only those, get an exact distinct count.
    """
    sketched = rows.groupBy("h", "c").agg(F.hll_sketch_agg("site", spread.lg_k).alias("s"), F.min("id").alias("first"))
    sketched = sketched.select("h", "c", "first", F.hll_sketch_estimate("s").alias("sites"))
    low, high = spread.min_sites * (1 - spread.margin) - 1, spread.min_sites * (1 + spread.margin) + 1
    found = materialize(sketched.where(F.col("sites") >= low), "lines-found")
    near = found.where(F.col("sites") <= high)
    exact = rows.join(near.select("h", "c"), ["h", "c"], "left_semi").groupBy("h", "c").agg(F.count_distinct("site").alias("n"))
    exact = near.join(exact.where(F.col("n") >= spread.min_sites), ["h", "c"], "left_semi")
    return materialize(found.where(F.col("sites") > high).unionAll(exact).select("h", "c", "first"), "boilerplate")


def drop_boilerplate(docs: DataFrame, spread: Spread = Spread(), id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """docs with cross-site boilerplate lines cut from their texts, and __lines and __cut counted.

    A boilerplate line stays in the document with the smallest id that has it and goes
    everywhere else; all rows stay, in their columns. Lines are compared without white space
    at their ends; lines without a word always stay. Null sites count as no site; a null text
    stays null; a null id is never first unless only null ids have the line, and then all of
    them keep it. Repeated rows are cut alike.
    """
    rows = materialize(line_rows(docs, id_col, text_col, site_col), "lines")
    hits = rows.join(boilerplate(rows, spread), ["h", "c"]).where(~F.col("id").eqNullSafe(F.col("first")))
    cuts = hits.groupBy(F.col("id").alias("__brindle_id"), F.col("key").alias("__brindle_key")).agg(F.collect_list("pos").alias("__brindle_pos"))
    keyed = docs.withColumn("__brindle_h", F.xxhash64(column(text_col)))
    joined = keyed.join(cuts, column(id_col).eqNullSafe(F.col("__brindle_id")) & (F.col("__brindle_h") == F.col("__brindle_key")), "left")
    lines = F.split(column(text_col), "\n")
    joined = joined.withColumn("__brindle_ls", lines)
    kept = F.array_except(F.sequence(F.lit(0), F.size("__brindle_ls") - 1), F.col("__brindle_pos"))
    text = F.when(F.col("__brindle_pos").isNull(), column(text_col)).otherwise(F.array_join(F.transform(kept, lambda i: F.get(F.col("__brindle_ls"), i)), "\n"))
    counted = joined.withColumn("__brindle_cut", F.when(F.col("__brindle_pos").isNull(), 0).otherwise(F.size("__brindle_ls") - F.size(kept)).cast("long"))
    counted = counted.withColumn("__brindle_lines", F.when(column(text_col).isNull(), 0).otherwise(F.size("__brindle_ls")).cast("long"))
    return counted.select(*(text.alias(c) if c == text_col else column(c) for c in docs.columns), "__brindle_lines", "__brindle_cut")
