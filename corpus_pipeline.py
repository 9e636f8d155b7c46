"""A corpus pipeline over documents: each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import lines, packing, pii, simhash, toxicity
from brindle.llm.common import materialize, read, release, written
from brindle.llm.queries import learnable_labels

#: Near copies: their sets of five-word shingles are alike by so much; fingerprints of word pairs,
#: which an edit moves less, find them by at most so many differing bits.
SHINGLE, SIMILARITY, FEATURE, RADIUS = 5, 0.8, 2, 8


def _measured(docs: DataFrame, before: DataFrame) -> DataFrame:
    """docs in the columns of before, with n_chars in step with the text."""
    kind = dict(before.dtypes).get("n_chars")
    if kind in ("bigint", "int"):
        docs = docs.withColumn("n_chars", F.length("text").cast(kind))
    return docs.select(*(F.col("`" + c.replace("`", "``") + "`") for c in before.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; the model learns from the labels' learnable rows."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, learnable_labels(read(spark, sf_dir, "labels"))))


def cut_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on many sites go from all documents but the first that has them; documents stay."""
    return _measured(lines.drop_boilerplate(docs), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.keep_one(docs, RADIUS, FEATURE, SHINGLE, SIMILARITY)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to their kinds in angle brackets."""
    return _measured(pii.redact(docs), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents become pieces of full token sequences, related ones together."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", cut_boilerplate),
    ("simhash_dedup", drop_near_copies),
    ("pii", redact_personal_data),
    ("packing", pack),
]

#: No SQL: learned scores, fingerprint components and packing are beyond it. Tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written as Parquet and read again.

    What a stage wrote on its way, and the result before it, are deleted once its own is written.
    """
    docs, mark = read(spark, sf_dir, "documents"), written(spark)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        release(spark, mark, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
