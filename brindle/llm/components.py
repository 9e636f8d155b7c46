"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, written

#: So many edges, 16 bytes each, are united by one task; rounds of stars take any number.
FEW = 100_000


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())


def _unite(batches):
    """(node, root) of all the edges of a task, by union and find."""
    ends = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], 1) for b in batches if b.num_rows]
    if not ends:
        return
    nodes, at = np.unique(np.concatenate(ends), return_inverse=True)
    parent = list(range(len(nodes)))
    for x, y in at.reshape(-1, 2).tolist():
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        # the smaller of two roots stays, so a root is its component's smallest node
        parent[max(x, y)] = min(x, y)
    root = np.array(parent)
    while not np.array_equal(up := root[root], root):
        root = up
    yield pa.RecordBatch.from_pydict({"node": pa.array(nodes), "root": pa.array(nodes[root])})


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node of its component.

    Alternates the large-star and small-star steps (Kiveris et al., 2014) until the edge
    set stands still, which it does once every component is a star around its smallest
    node. Only edges to smaller nodes are kept, so no step holds more rows than the input
    has, and a node's neighbours meet only in a minimum that is combined map-side. Each
    round is written to the shared folder. A set of FEW edges or less is united by one task
    instead, with the same rows. Self-links and null ends are ignored; an empty input gives
    no rows.
    """
    spark, mark = edges.sparkSession, written(edges.sparkSession)
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    e = materialize(e.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct(), "edges")
    if e.count() <= FEW:
        return e.coalesce(1).mapInArrow(_unite, "node long, root long")
    before = _mark(e)
    while before[0]:
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large")
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        joined = large.join(low, "u")
        small = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionAll(low.select("u", F.col("m").alias("v"))).distinct()
        e = materialize(small, "edges")
        release(spark, mark, keep=1)
        after = _mark(e)
        if after == before:
            break
        before = after
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)
