"""BM25 retrieval over a postings table, and its evaluation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joining import settle


#: Rows of (query, term, weight) that are sent to all tasks, some 60 bytes each.
MOST_TERMS = 300_000


@dataclass(frozen=True)
class Bm25:
    k1: float = 0.9
    b: float = 0.4


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits of ASCII."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")


def counted(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, ts, len): words with an empty one at either end where the text has none, and their number."""
    df = docs.select(key, F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+").alias("ts"))
    first, last = (F.get("ts", F.lit(0)) == "").cast("int"), (F.element_at("ts", -1) == "").cast("int")
    return df.withColumn("len", F.size("ts") - F.when(F.size("ts") == 1, first).otherwise(first + last))


def postings(docs: DataFrame, key: str, text: Column, terms: DataFrame | None = None) -> DataFrame:
    """(key, term, tf, len): one row a document and term, counted before the shuffle; of terms only, if given."""
    df = counted(docs, key, text).select(key, "len", F.explode("ts").alias("term")).where("term <> ''")
    if terms is not None:
        df = df.join(terms, "term", "left_semi")
    return df.groupBy(key, "term", "len").agg(F.count(F.lit(1)).alias("tf"))


def search(queries: DataFrame, docs: DataFrame, query_key: str, query_text: Column, key: str, text: Column, k: int = 20, settings: Bm25 = Bm25()) -> DataFrame:
    """(query_key, key, score, rank): the k best documents of each query, ties by key.

    The postings are cut to the queries' terms, written once, and dealt by document, so that a
    document's scores add up where it stands and only the best of each task move on. Up to
    MOST_TERMS terms of queries, counted, go to all tasks; more are joined by shuffling. Document
    counts and lengths cover all documents. Scores are rounded to six places so that order is
    stable.
    """
    asked = queries.select(query_key, F.explode(F.array_distinct(tokens(query_text))).alias("term"))
    length = F.regexp_count(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"))
    total, mean = docs.agg(F.count(F.lit(1)), F.avg(length)).first()
    if not total:
        return asked.select(query_key, F.lit(None).alias(key), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("rank")).limit(0)
    terms = asked.select("term").distinct()
    post = settle(postings(docs, key, text, terms))
    df = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.lit(float(total)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = settle(asked.join(df.select("term", idf.alias("idf")), "term"))
    small = weighed.count() <= MOST_TERMS
    tf = F.col("tf") * (settings.k1 + 1) / (F.col("tf") + settings.k1 * (1 - settings.b + settings.b * F.col("len") / F.lit(float(mean or 1))))
    met = post.repartition(key).join(F.broadcast(weighed) if small else weighed, "term")
    scored = met.groupBy(query_key, key).agg(F.round(F.sum(F.col("idf") * tf), 6).alias("score"))
    w = Window.partitionBy(query_key).orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def recall_report(hits: DataFrame, gold: DataFrame, key: str, item: str) -> DataFrame:
    """(n, avg_recall, all_recall, any_recall) in per cent over keys with gold items."""
    found = gold.distinct().join(hits.select(key, item).distinct().withColumn("hit", F.lit(1)), [key, item], "left")
    each = found.groupBy(key).agg((F.count("hit") / F.count(F.lit(1))).alias("r"))
    pct = lambda x: F.round(F.avg(x) * 100, 6)
    return each.agg(F.count(F.lit(1)).alias("n"), pct(F.col("r")).alias("avg_recall"), pct((F.col("r") == 1).cast("int")).alias("all_recall"), pct((F.col("r") > 0).cast("int")).alias("any_recall"))


def repeating(ids: Column, window: int = 100, distinct: int = 10) -> Column:
    """Whether the last ids hold few distinct ones."""
    return (F.size(ids) >= window) & (F.size(F.array_distinct(F.slice(ids, -window, window))) <= distinct)
