"""Driver-provided parquet tables."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


class Tables:
    """Lazy accessor: ``Tables(spark, dir).lineitem``.

    ``derived(name, build)`` memoises a table derived from the driver tables;
    with a ``materializer`` it is written once (shared checkpoint folder) and
    every later use reads the files instead of recomputing the lineage.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, materializer=None):
        self.spark, self.sf_dir = spark, sf_dir
        self._memo: dict[str, DataFrame] = {}
        self._materializer = materializer
        self._lock = threading.RLock()

    def derived(self, name: str, build) -> DataFrame:
        with self._lock:
            if name not in self._memo:
                df = build()
                self._memo[name] = self._materializer(df, name) if self._materializer else df
        return self._memo[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in TABLES:
            raise AttributeError(name)
        return read_table(self.spark, self.sf_dir, name)
