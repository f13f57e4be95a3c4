"""Query registry: name -> (Spark builder, DuckDB oracle SQL or None).

Every builder takes (spark, sf_dir) and reads the driver's tables (or the
synthetic sites Spark derives from ``customer``), over whole tables and
whole texts. Column names are aliased identically on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco
