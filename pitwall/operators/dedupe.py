"""Latest-per-key and keep-first deduplication.

Both are ``row_number() = 1`` over a window. Spark plans that filter as a
partial ``WindowGroupLimit`` before the shuffle and a final one after it, so
each map task forwards at most one row per key: a key holding a third of
all rows still ships only one row per map task across the network.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import VariantType

ColumnLike = str | Column


def _col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def row_hash(df: DataFrame, exclude: Sequence[str] = ()) -> Column:
    """64-bit hash of every column: a deterministic last-resort tiebreak."""
    parts = []
    for f in df.schema.fields:
        if f.name in exclude:
            continue
        c = F.col(f.name)
        parts.append(F.to_json(c) if isinstance(f.dataType, VariantType) else c)
    return F.xxhash64(*parts)


def keep_first(df: DataFrame, keys: Sequence[ColumnLike], order: Sequence[Column]) -> DataFrame:
    """Keep the first row per key under ``order`` (caller supplies a total order)."""
    w = Window.partitionBy(*[_col(k) for k in keys]).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def latest_per_key(df: DataFrame, keys: Sequence[ColumnLike],
                   order: Sequence[Column] | None = None,
                   tiebreak: Sequence[Column] | None = None) -> DataFrame:
    """Newest record per key.

    ``order`` defaults to ``loaded_at DESC NULLS FIRST`` (the warehouse's
    default null placement for DESC). Ties on the order are broken by a hash
    of the whole row so reruns and recomputed partitions pick the same row.
    """
    if order is None:
        order = [F.col("loaded_at").desc_nulls_first()]
    if tiebreak is None:
        tiebreak = [row_hash(df).desc()]
    return keep_first(df, keys, [*order, *tiebreak])
