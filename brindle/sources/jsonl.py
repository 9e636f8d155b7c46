"""JSON Lines, JSON documents and predictions as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.upsert import canonical_json, upsert


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, strict: bool = True) -> DataFrame:
    """One row a line. A missing file is empty and blank lines are skipped; strict raises at a line
    that is no object, else it is left out."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line): lines that hold no JSON object, for a message behind a failed strict read."""
    df = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    return df.where((F.btrim("line") != "") & (F.try_parse_json("line").isNull() | ~F.btrim("line").startswith("{")))


def read_instances(spark: SparkSession, paths: list[str], schema: T.StructType) -> DataFrame:
    """.jsonl and .jsonl.all as lines, .json as an array, .parquet as it is; all in one table."""
    out = None
    for path in paths:
        if path.endswith((".jsonl", ".jsonl.all")):
            df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
        elif path.endswith(".json"):
            df = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
        else:
            df = spark.read.parquet(path).select(*(F.col(f.name).cast(f.dataType) for f in schema))
        out = df if out is None else out.unionByName(df)
    return out if out is not None else spark.createDataFrame([], schema)


PREDICTION = T.StructType([T.StructField(n, T.StringType()) for n in ("instance_id", "model_name_or_path", "model_patch")])


def read_predictions(spark: SparkSession, path: str, dataset: DataFrame | None = None) -> DataFrame:
    """Predictions from lines, a list, or an object of them by id; "gold" makes them of the
    dataset's own patches. Rows without an id or a model name raise."""
    if path == "gold":
        return dataset.select("instance_id", F.lit("gold").alias("model_name_or_path"), F.col("patch").alias("model_patch"))
    if path.endswith(".jsonl"):
        df = spark.read.schema(PREDICTION).option("mode", "FAILFAST").json(path)
    else:
        text = spark.read.text(path, wholetext=True)
        many = F.when(F.btrim("value").startswith("["), F.from_json("value", T.ArrayType(PREDICTION))).otherwise(F.map_values(F.from_json("value", T.MapType(T.StringType(), PREDICTION))))
        df = text.select(F.inline(many))
    need = F.when(F.col("instance_id").isNull() | F.col("model_name_or_path").isNull(), F.raise_error(F.lit("a prediction lacks its id or model name")))
    return df.where(need.isNull())


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Canonical JSON, one row a line."""
    df.select(canonical_json(df).alias("value")).write.mode(mode).text(path)


def upsert_table(spark: SparkSession, path: str, new: DataFrame, key: str) -> DataFrame:
    """Lays new rows, in the order of their place column, over the table at path.

    A new version is written beside the old one and a pointer file names the current one, so
    that a reader sees one or the other whole.
    """
    current = current_version(spark, path)
    old = spark.read.parquet(f"{path}/v{current}") if current >= 0 else spark.createDataFrame([], new.schema)
    target = f"{path}/v{current + 1}"
    upsert(old, new, key).write.mode("overwrite").parquet(target)
    spark.createDataFrame([(current + 1,)], "v int").write.mode("overwrite").parquet(f"{path}/pointer-{current + 1:06d}")
    return spark.read.parquet(target)


def current_version(spark: SparkSession, path: str) -> int:
    """Number of the newest whole version, or -1."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return -1
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    done = [int(n.removeprefix("pointer-")) for n in names if n.startswith("pointer-") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return max(done, default=-1)


def fan_out(df: DataFrame, valid, with_tests, all_path: str, tests_path: str) -> None:
    """Valid rows to one sink, those of them with tests to another."""
    kept = df.where(valid)
    kept.write.mode("append").json(all_path)
    kept.where(with_tests).write.mode("append").json(tests_path)


def suffixed(path: str, suffix: str) -> str:
    """a/b.jsonl with -suffix before its extension."""
    head, dot, tail = path.rpartition(".")
    return f"{head}-{suffix}.{tail}" if dot and "/" not in tail else f"{path}-{suffix}"


def merge_shards(spark: SparkSession, pattern: str, target: str, expected: int | None = None) -> int:
    """All lines of the files that match, as one table of text lines at target; how many there are.

    With expected, another number is an error, raised before anything is written.
    """
    rows = spark.read.text(pattern)
    n = rows.count()
    if expected is not None and n != expected:
        raise ValueError(f"expected {expected} lines, found {n}")
    rows.write.mode("overwrite").text(target)
    return n
