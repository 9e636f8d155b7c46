"""Shared pieces of the training-data operators."""

from __future__ import annotations

import tempfile
import threading
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words, as a regex class for Java, RE2 and Python alike.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"

_own_scratch: dict[str, str] = {}
_written: dict[tuple[str, int], list[str]] = {}


def _tables(spark: SparkSession) -> list[str]:
    """The tables that materialize has written in this application and thread, in order."""
    return _written.setdefault((spark.sparkContext.applicationId, threading.get_ident()), [])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir of the session.

    Only where that is unset, and only in local mode, a temporary folder stands in.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _own_scratch:
        _own_scratch[context.applicationId] = tempfile.mkdtemp(prefix="brindle-")
    return _own_scratch[context.applicationId]


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    This cuts the lineage with a copy that survives a lost executor, computes an
    expensive input once for several readers, and gives the planner its true size.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _tables(spark).append(path)
    return spark.read.schema(df.schema).parquet(path)


def written(spark: SparkSession) -> int:
    """How many tables materialize has written and release has not deleted."""
    return len(_tables(spark))


def release(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Deletes the tables that materialize wrote after the first `since`, but for the last `keep`.

    For what no plan reads any more: a result that was written itself needs none of the tables
    that it was made from. Tables are deleted by Hadoop's file system, wherever they lie.
    """
    tables = _tables(spark)
    gone = tables[since : len(tables) - keep]
    for path in gone:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    tables[since : len(tables) - keep] = []


def bounded_batches(spark: SparkSession, size: str = "8m") -> None:
    """Bounds the Arrow batches that go to Python, on both sides, where the session has the default.

    A batch of long texts is held by the JVM outside its heap and by the worker; the default of
    64 MB and its copies are too much for executors of a few gigabytes.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("67108864b", "67108864", "64m", "64MB"):
        spark.conf.set(key, size)


def column(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def let(value: Column, body) -> Column:
    """body(x) with x bound to value, which is then evaluated once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, start: Column, step, block: int = 128) -> Column:
    """Exclusive running fold of an array: result[i] = step over start and values[0..i-1].

    step must be associative with start as its identity (plus and 0, greatest and 0). Two
    levels of blocks keep the work at about block/2 + n/block steps an element.
    """
    fold_all = lambda xs: F.aggregate(xs, start, step)

    def blocks(xs: Column) -> Column:
        n = F.size(xs)
        return F.when(n == 0, F.array().cast("array<array<bigint>>")).otherwise(
            F.transform(F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int")), lambda b: F.slice(xs, b * block + 1, block))
        )

    def within(xs: Column, base: Column) -> Column:
        return F.transform(xs, lambda _, i: step(base, F.when(i == 0, start).otherwise(fold_all(F.slice(xs, F.lit(1), i)))))

    def all_blocks(bs: Column) -> Column:
        return let(
            F.transform(bs, fold_all),
            lambda totals: F.flatten(F.transform(bs, lambda b, i: let(F.when(i == 0, start).otherwise(fold_all(F.slice(totals, F.lit(1), i))), lambda base: within(b, base)))),
        )

    return let(values, lambda xs: let(blocks(xs), all_blocks))


def worker_cache(name: str, make):
    """An object that lives in the Python worker process until tidy drops it, so that tasks share it."""
    import sys
    import types

    home = sys.modules.setdefault("_brindle_worker_cache", types.ModuleType("_brindle_worker_cache"))
    if not hasattr(home, name):
        setattr(home, name, make())
    return getattr(home, name)


def tidy(keep: str | None = None) -> None:
    """Gives back what a worker holds for nothing: shared objects but those named keep..., and free memory.

    Workers outlive their tasks, so what one operator's tasks leave would add to the memory of all
    operators after it. Allocators keep freed memory as well, mostly that below some last live piece.
    """
    import ctypes
    import sys

    home = vars(sys.modules.get("_brindle_worker_cache", object))
    for name in [n for n in home if not n.startswith("__") and not (keep and n.startswith(keep))]:
        del home[name]
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim:
        trim(0)


def slices(batches, position: int, size: int = 4_000_000, keep: str | None = None):
    """Arrow batches cut so that the texts in one column hold about size bytes; a longer text is alone.

    Before each batch and behind the last the worker is tidied; keep names the task's own shared objects.
    """
    import numpy as np
    import pyarrow.compute as pc

    tidy(keep)
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(position)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        i = 0
        while i < batch.num_rows:
            before = ends[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(ends, before + size, "right")))
            yield batch.slice(i, j - i)
            i = j
        del batch
        tidy(keep)


def map_arrow(docs: DataFrame, run, extra: dict[str, str] | None = None) -> DataFrame:
    """docs.mapInArrow(run) with all columns kept and extra ones appended, whatever their names.

    run sees the columns as c0, c1, ... by position and must name what it yields so, extra
    columns by their own names. A column of docs with the name of an extra one gives way to it.
    """
    extra = extra or {}
    bounded_batches(docs.sparkSession)
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema), *(f"{k} {v}" for k, v in extra.items())])
    out = plain.mapInArrow(run, schema)
    stay = [i for i, c in enumerate(docs.columns) if c not in extra]
    return out.select(*(F.col(f"c{i}") for i in stay), *extra).toDF(*(docs.columns[i] for i in stay), *extra)
