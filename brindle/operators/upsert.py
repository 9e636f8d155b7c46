"""Keyed upsert and canonical JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def upsert(old: DataFrame, new: DataFrame, key: str, place: str = "place") -> DataFrame:
    """old with new rows laid over it: a known key keeps its place and takes the new values.

    old has a column place; new rows come after all old ones, in the order of their own place
    column, and of several with a key the last counts. Rows without a key are all added.
    """
    last = old.agg(F.coalesce(F.max(place) + 1, F.lit(0)).alias("base"))
    base = last.first()["base"]
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn(place, F.col(place) + F.lit(base)).withColumn("__new", F.lit(1)))
    rest = [c for c in old.columns if c not in (key, place)]
    keyed = both.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(place).alias(place), F.max_by(F.struct(*rest) if rest else F.lit(1), place).alias("__row"))
    keyed = keyed.select(key, place, *(F.col(f"__row.{c}").alias(c) for c in rest))
    loose = both.where(F.col(key).isNull()).select(key, place, *rest)
    return keyed.unionByName(loose).select(*old.columns)


def upsert_counts(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(inserted, updated, total) of an upsert, in one pass over the keys."""
    tagged = old.select(key, F.lit(1).alias("o"), F.lit(0).alias("n")).unionAll(new.select(key, F.lit(0), F.lit(1)))
    keyed = tagged.where(F.col(key).isNotNull()).groupBy(key).agg(F.max("o").alias("o"), F.sum("n").alias("n"))
    counts = keyed.agg(F.count_if((F.col("o") == 0) & (F.col("n") > 0)).alias("i"), F.coalesce(F.sum(F.when(F.col("o") == 1, F.col("n")).otherwise(F.greatest(F.col("n") - 1, F.lit(0)))), F.lit(0)).alias("u"), F.count(F.lit(1)).alias("t"))
    loose = tagged.where(F.col(key).isNull()).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("ln"), F.count(F.lit(1)).alias("lt"))
    # one row on each side
    return counts.crossJoin(loose).select((F.col("i") + F.col("ln")).alias("inserted"), F.col("u").alias("updated"), (F.col("t") + F.col("lt")).alias("total"))


def sorted_fields(value: Column, kind: T.DataType) -> Column:
    """A struct with its fields in the order of their names, all the way down."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        inner = F.struct(*(sorted_fields(value[f.name], f.dataType).alias(f.name) for f in fields))
        return F.when(value.isNotNull(), inner)
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.ArrayType)):
        return F.transform(value, lambda x: sorted_fields(x, kind.elementType))
    return value


def canonical_json(df: DataFrame) -> Column:
    """Each row as compact JSON with sorted keys; nulls are kept."""
    fields = sorted(df.schema.fields, key=lambda f: f.name)
    return F.to_json(F.struct(*(sorted_fields(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in fields)), {"ignoreNullFields": "false"})
