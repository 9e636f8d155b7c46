"""Session builder with the settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Semantics the operators rely on; sizes (memory, partitions) stay with the deployment.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "brindle", **extra: str) -> SparkSession:
    """A session with the engine's settings; extra settings use __ for a dot."""
    builder = SparkSession.builder.appName(app).config(map=SETTINGS)
    if extra:
        builder = builder.config(map={k.replace("__", "."): v for k, v in extra.items()})
    return builder.getOrCreate()
