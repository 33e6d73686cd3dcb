"""Registry of named queries (Spark callables) and their oracle SQL."""

from __future__ import annotations

import importlib
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pitwall.plans.context import RaceContext

Query = Callable[[SparkSession, str], DataFrame]

_CTX: dict[tuple[str, str], RaceContext] = {}
_CTX_LOCK = threading.Lock()


def ctx(spark: SparkSession, sf_dir: str) -> RaceContext:
    """One race context per (Spark application, data folder)."""
    key = (spark.sparkContext.applicationId, sf_dir)
    with _CTX_LOCK:
        if key not in _CTX:
            _CTX[key] = RaceContext(spark, sf_dir)
        return _CTX[key]


def forget(spark: SparkSession, sf_dir: str | None = None) -> None:
    """Drop the stored context of a data folder (or all), so that changed input is read anew."""
    with _CTX_LOCK:
        for key in [k for k in _CTX if k[0] == spark.sparkContext.applicationId and sf_dir in (None, k[1])]:
            del _CTX[key]


def _model_query(name: str) -> Query:
    return lambda spark, sf_dir: ctx(spark, sf_dir).table(name)


def registered_queries() -> dict[str, Query]:
    from pitwall.plans import generic, queries
    from pitwall.plans.marts import Marts
    from pitwall.plans.staging import MODELS
    out: dict[str, Query] = {}
    for n in MODELS:
        out[n] = _model_query(n)
    for n in Marts.NAMES:
        out[n] = _model_query(n)
    out.update(queries.registry())
    out.update(generic.registry())
    return out


def oracle_sql() -> dict[str, str]:
    oracle = importlib.import_module("oracle.all")
    return oracle.oracle_sql()
