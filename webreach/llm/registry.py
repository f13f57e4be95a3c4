"""Queries of the training-data operators: name -> builder, and DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from webreach.llm.common import narrow_batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = narrow_batches(fn)
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco
