"""JSON settings laid over defaults."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


def merged(base: dict, over: dict) -> dict:
    """A new dict: over's values on base's, dicts in both merged in turn. Neither is changed."""
    both = {k: merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}
    return {**base, **both}


def listed(value) -> list:
    """value as a list: none for null or '', its items for a list or tuple, else itself alone."""
    if value is None or value == "":
        return []
    return list(value) if isinstance(value, (list, tuple)) else [value]


def load(spark: SparkSession, path: str | None, defaults: dict) -> dict:
    """defaults with the JSON object at path laid over them; any path that Spark reads."""
    if path is None:
        return merged(defaults, {})
    own = json.loads("\n".join(r[0] for r in spark.read.option("wholetext", True).text(path).collect()))
    if not isinstance(own, dict):
        raise ValueError(f"settings must be a JSON object: {path}")
    return merged(defaults, own)
