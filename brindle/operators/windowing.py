"""Ordered computations: chunks, running totals with a stop, offsets, carried values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joining import settle


def numbered(df: DataFrame, by: list[str], order: list[str], rank: str = "__rank", total: str = "__total") -> DataFrame:
    """Adds each row's place (from 0) in its key's order, and the key's number of rows.

    Rows are dealt by ranges of key and order, so a key with any share of the rows spreads over
    many tasks: places within a range are counted there, and what ranges hold before it is added
    from a table of one row a range and key. Ties are told apart in no stated way.
    """
    dealt = settle(df.repartitionByRange(*by, *order).withColumn("__part", F.spark_partition_id()))
    counts = dealt.groupBy("__part", *by).agg(F.count(F.lit(1)).alias("__n"))
    key = Window.partitionBy(*by)
    before = F.coalesce(F.sum("__n").over(key.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("__part").alias("__p"), *(F.col(c).alias(f"__k{i}") for i, c in enumerate(by)), before.alias("__before"), F.sum("__n").over(key).alias(total))
    on = F.col("__part") == F.col("__p")
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    local = F.row_number().over(Window.partitionBy("__part", *by).orderBy(*order)) - 1
    out = dealt.withColumn("__local", local).join(counts, on)
    return out.select(*df.columns, (F.col("__local") + F.col("__before")).alias(rank), total)


def chunks(df: DataFrame, by: list[str], order: list[str], n: int, name: str = "chunk") -> DataFrame:
    """Contiguous near-equal chunks 1..n of each key's rows; the first chunks take the remainder."""
    rows, at = F.col("__total"), F.col("__rank")
    size, more = F.floor(rows / n), rows % n
    large = more * (size + 1)
    chunk = F.when(at < large, F.floor(at / (size + 1))).otherwise(more + F.floor((at - large) / F.greatest(size, F.lit(1)))) + 1
    return numbered(df, by, order).withColumn(name, chunk.cast("long")).drop("__rank", "__total")


def strided(df: DataFrame, by: list[str], order: list[str], n: int, name: str = "shard") -> DataFrame:
    """Shard i takes rows i, i + n, i + 2n, ... of each key."""
    return numbered(df, by, order).withColumn(name, (F.col("__rank") % n).cast("long")).drop("__rank", "__total")


def quantiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """By key, exact quantiles of value, interpolated; nulls are left out.

    Only the two rows beside each quantile leave their places in the order.
    """
    ranked = numbered(df.select(*by, value).where(F.col(value).isNotNull()), by, [value])
    place = lambda p: (F.col("__total") - 1) * F.lit(p)
    sides = [(name, p, side) for name, p in shares.items() for side in (F.floor, F.ceil)]
    near = reduce(lambda x, y: x | y, (F.col("__rank") == side(place(p)) for _, p, side in sides))
    def at(p, side):
        return F.max(F.when(F.col("__rank") == side(place(p)), F.col(value)))

    part = lambda p: F.max(place(p) - F.floor(place(p)))
    return ranked.where(near).groupBy(*by).agg(*((at(p, F.floor) + (at(p, F.ceil) - at(p, F.floor)) * part(p)).alias(name) for name, p in shares.items()))


def until_spent(df: DataFrame, by: list[str], order: list[str], cost: Column, most: float, name: str = "spent") -> DataFrame:
    """By key, rows up to and with the one whose cost takes the running total to most or over."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = df.withColumn(name, F.sum(cost).over(w))
    return out.where(F.col(name) - cost < F.lit(most))


def offsets(df: DataFrame, by: list[str], order: list[str], delta: Column, name: str = "offset") -> DataFrame:
    """By key, the total of delta over the rows before each."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(delta).over(w), F.lit(0)))


def carry(df: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """By key, the latest value that is not null so far."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def after_marker(df: DataFrame, by: list[str], order: list[str], is_marker: Column, is_result: Column, value: Column, name: str) -> DataFrame:
    """Results whose nearest earlier marker or result is a marker get the marker's value; others none."""
    w = Window.partitionBy(*by).orderBy(*order)
    events = df.where(is_marker | is_result)
    kind = F.lag(F.when(is_marker, 1).otherwise(0)).over(w)
    return events.withColumn(name, F.when(kind == 1, F.lag(value).over(w))).where(is_result & F.col(name).isNotNull())


def sequence(df: DataFrame, by: list[str], order: list[str], name: str = "seq", start: int = 1) -> DataFrame:
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) + (start - 1)).cast("long"))


def latest_in_first_place(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: the last one's values in the first one's place; rows without a key all stay.

    (place, row...) with place the order of the key's first row. One aggregation, combined
    before the shuffle; no window.
    """
    rest = [c for c in df.columns if c not in (key, order)]
    keyed = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("place"), F.max_by(F.struct(order, *rest), order).alias("r"))
    keyed = keyed.select("place", key, *(F.col(f"r.{c}").alias(c) for c in (order, *rest)))
    loose = df.where(F.col(key).isNull()).select(F.col(order).alias("place"), key, order, *rest)
    return keyed.unionByName(loose)


def depth(df: DataFrame, by: list[str], order: list[str], opens: Column, closes: Column, name: str = "depth") -> DataFrame:
    """By key, the running total of openings less closings through each row."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.sum(opens - closes).over(w).cast("long"))


def top(df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each key; the planner keeps only k a task before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col(name) <= k)


def unit_hash(*keys: Column) -> Column:
    """A number in [0, 1) that depends on the keys alone: splits and samples that never move."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11) / F.lit(float(1 << 53))


def sample_first(df: DataFrame, n: int, *keys: Column) -> DataFrame:
    """n rows in the order of a hash of the keys."""
    return df.orderBy(F.xxhash64(*keys), *keys).limit(n)


def split(df: DataFrame, share: float, *keys: Column) -> DataFrame:
    """Adds split: test for about share of the rows, train for the rest."""
    return df.withColumn("split", F.when(unit_hash(*keys) < share, "test").otherwise("train"))
