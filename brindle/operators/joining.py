"""Joins that are more than an equality: as-of, interval, ordered candidates, positional, closure."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def missing(wanted: DataFrame, have: DataFrame, on: list[str]) -> DataFrame:
    """Keys that are asked for but absent."""
    return wanted.select(*on).distinct().join(have, on, "left_anti")


def pending(items: DataFrame, results: DataFrame, on: list[str], done: Column) -> DataFrame:
    """Items without a finished result: a resume point. Only results that meet done count."""
    return items.join(results.where(done).select(*on).distinct(), on, "left_anti")


def asof(left: DataFrame, right: DataFrame, left_time: str, right_time: str, by: list[str], take: dict[str, str], strict: bool = True) -> DataFrame:
    """Adds to each left row the columns of the latest right row before its time, by key.

    One sort-merge pass: both sides are laid end to end, dealt by key, and the last right row
    is carried forward, so nothing is joined pairwise. strict leaves out equal times. take maps
    right columns to new names; rows without a match get nulls.
    """
    carried = F.struct(*(F.col(c).alias(n) for c, n in take.items()))
    shape = F.lit(None).cast(right.select(carried).schema[0].dataType)
    # at equal times right rows come after left ones if strict, before them otherwise
    a = left.select(*by, F.col(left_time).alias("__t"), F.lit(1).alias("__o"), F.struct(*left.columns).alias("__row"), shape.alias("__take"))
    b = right.select(*by, F.col(right_time).alias("__t"), F.lit(2 if strict else 0).alias("__o"), F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), carried.alias("__take"))
    w = Window.partitionBy(*by).orderBy("__t", "__o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = a.unionByName(b).withColumn("__take", F.last("__take", ignorenulls=True).over(w)).where("__row is not null")
    return out.select("__row.*", *(F.col(f"__take.{n}").alias(n) for n in take.values()))


def innermost(points: DataFrame, intervals: DataFrame, on: list[str], at: str, start: str, end: str, keep: list[str]) -> DataFrame:
    """Adds to each point the interval with its key that contains it: the shortest, of ties the latest start.

    A hash join on the key with a range condition; points without an interval get nulls.
    points must have unique rows under (on, at) as far as they are told apart.
    """
    span = (F.col(end) - F.col(start)).alias("span")
    rank = F.struct(span, (-F.col(start)).alias("neg"))
    inside = points.join(intervals, on, "left").where(F.col(start).isNull() | F.col(at).between(F.col(start), F.col(end)))
    best = inside.groupBy(*on, at).agg(F.min_by(F.struct(*keep), rank).alias("best"))
    out = points.join(best, [*on, at], "left")
    return out.select(*points.columns, *(F.col(f"best.{c}").alias(c) for c in keep))


def first_candidate(items: DataFrame, targets: DataFrame, candidates: Column, target: str, key: list[str]) -> DataFrame:
    """(key, target): the first of each item's candidates that is among the targets.

    Candidates are exploded with their rank, joined by equality and reduced by rank.
    """
    tried = items.select(*key, F.posexplode(candidates).alias("rank", target))
    return tried.join(targets.select(target).distinct(), target).groupBy(*key).agg(F.min_by(target, "rank").alias(target))


def closure(edges: DataFrame, a: str, b: str, start: DataFrame) -> DataFrame:
    """(root, node, depth): all that is reachable from the start nodes, with the fewest steps.

    Breadth first, one join a step; what was seen is not visited again. The frontier and the
    result stay distributed, and each step is checkpointed so that the plan does not grow.
    """
    step = edges.select(F.col(a).alias("node"), F.col(b).alias("next")).distinct()
    seen = start.select(F.col(start.columns[0]).alias("root"), F.col(start.columns[0]).alias("node")).distinct().withColumn("depth", F.lit(0).cast("long"))
    front = seen
    for depth in count(1):
        found = front.join(step, "node").select("root", F.col("next").alias("node")).distinct()
        front = found.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(depth).cast("long"))
        front = settle(front)
        if front.isEmpty():
            break
        seen = settle(seen.unionByName(front))
    return seen


def settle(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder that the session names; in local mode a folder of our own."""
    import tempfile

    spark = df.sparkSession
    context = spark.sparkContext
    if spark.conf.get("spark.checkpoint.dir", None) is None and context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="brindle-"))
    elif context.getCheckpointDir() is None:
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    return df.checkpoint()


def positional(left: DataFrame, right: DataFrame, by: list[str], left_order: list[str], right_order: list[str]) -> DataFrame:
    """First with first, second with second, by key."""
    a = left.withColumn("pos", F.row_number().over(Window.partitionBy(*by).orderBy(*left_order)))
    b = right.withColumn("pos", F.row_number().over(Window.partitionBy(*by).orderBy(*right_order)))
    return a.join(b, [*by, "pos"])


def top_hits(items: DataFrame, hits: DataFrame, on: str, k: int, hit: Column, order: list[Column]) -> DataFrame:
    """items with their first k hits as an array; none gives an empty array."""
    n = F.row_number().over(Window.partitionBy(on).orderBy(*order))
    best = hits.select(on, F.struct(n.alias("n"), hit.alias("hit")).alias("x")).where(F.col("x.n") <= k)
    lists = best.groupBy(on).agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["hit"]).alias("hits"))
    return items.join(lists, on, "left").withColumn("hits", F.coalesce("hits", F.array().cast(lists.schema["hits"].dataType)))


def take_while(df: DataFrame, by: list[str], order: list[str], holds: Column) -> DataFrame:
    """By key, the rows before the first that does not hold."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("__stop", F.max(F.when(holds, 0).otherwise(1)).over(w)).where("__stop = 0").drop("__stop")


def pair_starts(events: DataFrame, by: list[str], order: str, is_start: Column, is_end: Column) -> DataFrame:
    """Each end with the latest start of its key before it: (by, start, end); unmatched ends have a null start."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    marked = events.withColumn("start", F.last(F.when(is_start, F.col(order)), ignorenulls=True).over(w))
    return marked.where(is_end).select(*by, "start", F.col(order).alias("end"))


def contains_any(texts: DataFrame, needles: DataFrame, key: str, text: str, needle_key: str, needle: str) -> DataFrame:
    """(key, needle_key) where a text holds a needle, whatever the case.

    There is no equality to join on. Each needle is filed under one of its own words, and only
    texts with that word are tried: a hash join on words instead of all pairs.
    """
    # words at a needle's ends may be parts of longer words in a text, so an inner word is taken,
    # the longest; a needle without one has to be tried on every text
    inner = F.filter(F.split(F.regexp_extract(F.lower(needle), r"(?s)^\S*\s(.*)\s\S*$", 1), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    longest = F.array_sort(inner, lambda x, y: F.length(y) - F.length(x))
    filed = needles.select(needle_key, F.lower(needle).alias("__needle"), F.get(longest, F.lit(0)).alias("__word"))
    short = filed.where("__word is null").select(needle_key, "__needle")
    filed = filed.where("__word is not null")
    # words travel with the key alone; the few texts that have a needle's word are fetched after that
    bags = texts.select(key, F.explode(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+"))).alias("__word"))
    tried = bags.join(filed, "__word").select(key, needle_key, "__needle")
    found = tried.join(texts.select(key, F.lower(text).alias("__text")), key).where(F.contains("__text", "__needle")).select(key, needle_key)
    rest = texts.select(key, F.lower(text).alias("__text")).join(short, F.contains("__text", "__needle")).select(key, needle_key)
    return found.unionByName(rest).distinct()
