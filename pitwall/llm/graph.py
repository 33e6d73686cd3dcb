"""Connected components and link compression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitwall.llm.common import store


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a[i], b[i]) as at most one link per node: (node, smallest node of its local component)."""
    if len(a) == 0:
        return a, b
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[:len(a)], ends[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        for side in (x, y, label[x], label[y]):
            np.minimum.at(new, side, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


def connected_components(edges: DataFrame, name: str, max_rounds: int = 100) -> DataFrame:
    """(node, root): every node of ``edges`` (a, b; both long) with the smallest node it reaches.

    Alternating large-star and small-star rounds: each is a partial-aggregated
    minimum per node and a join back, so a hub with a third of all links is
    split by the skew join. Every round is written to the shared folder; the
    loop ends when a round leaves the links unchanged. Self links and nulls
    are ignored; an empty input gives an empty result.
    """
    def digest(e: DataFrame):
        r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        return r["n"], r["h"]

    e = (edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    e = store(e, f"{name}-links")
    seen = digest(e)
    for i in range(max_rounds):
        if seen[0] == 0:
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .filter("a <> b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
                 .unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        e = store(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
                  f"{name}-round{i}")
        now = digest(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components of {name} did not settle in {max_rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
