"""Mixing sources to target weights by subset-sum budget fitting (operator 3).

Documents are counted by exact word length per source. A source's target is
filled with whole copies of everything, then with a proportional share of
every length, and a bounded knapsack over the lengths left for what remains. The chosen number
of documents per length is taken in seeded order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitwall.llm.common import WORD, importable, store, text_hash

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
KNAPSACK_WORDS = 1 << 15    # largest remainder handed to the dynamic program
GROUP = 1024                # rows of one length ranked in one window partition


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Sources by code point, null last, weigh ``weights`` in turn. The level
    (target per unit of weight) is found by adding sources in the order of
    their limit per weight: a source stops at its limit when the level over
    all later ones would exceed it.
    """
    order = F.asc_nulls_last("source")
    place = F.row_number().over(Window.orderBy(order)) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (place % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * max_copies
    by_limit = Window.orderBy(F.col("cap") / F.col("w"), order)
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    t = (sizes.withColumn("w", w).withColumn("cap", cap.cast("double"))
         .withColumn("total", F.sum("source_size").over(every)).withColumn("all_w", F.sum("w").over(every))
         .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
         .withColumn("w_before", F.coalesce(F.sum("w").over(before), F.lit(0.0)))
         .withColumn("level", (F.col("total") - F.col("cap_before")) / (F.col("all_w") - F.col("w_before")))
         .withColumn("free", F.col("level") * F.col("w") <= F.col("cap"))
         .withColumn("final", F.min(F.when(F.col("free"), F.struct("cap_before", "level"))).over(every)["level"]))
    return t.select("source", "source_size",
                    F.when(F.col("final").isNull() | (F.col("final") * F.col("w") > F.col("cap")), F.col("cap"))
                    .otherwise(F.col("final") * F.col("w")).alias("target"))


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their words come nearest to ``budget``.

    A proportional share of every length for most of the budget, then one
    more of each length from the longest down until the rest is small, then a
    bounded knapsack on the documents left. If that misses, more of the
    budget is left to the knapsack, as far as its size allows.
    """
    total = int(lengths @ counts)
    if budget >= total:
        return counts.copy()
    best, gap, hold = counts * 0, budget, min(budget, KNAPSACK_WORDS // 8)
    while gap:
        take = (counts.astype(object) * (budget - hold) // total).astype(np.int64)
        rest = budget - int(lengths @ take)
        for i in np.argsort(-lengths, kind="stable"):
            more = min(int(counts[i] - take[i]), max(0, rest - KNAPSACK_WORDS) // max(1, int(lengths[i])))
            take[i] += more
            rest -= more * int(lengths[i])
        reached, add = _knapsack(lengths, counts - take, rest)
        if abs(reached - rest) < gap:
            best, gap = take + add, abs(reached - rest)
        if hold >= min(budget, KNAPSACK_WORDS):
            break
        hold = min(budget, KNAPSACK_WORDS, hold * 4)
    return best


def _knapsack(lengths: np.ndarray, left: np.ndarray, budget: int) -> tuple[int, np.ndarray]:
    """Sum nearest to ``budget`` (of two the smaller) and the counts that reach it; 0/1 items by binary splitting."""
    add = np.zeros(len(lengths), np.int64)
    top = 2 * budget
    reach = np.zeros(top + 1, bool)
    reach[0] = True
    item = np.full(top + 1, -1, np.int32)
    items: list[tuple[int, int]] = []
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        if size == 0 or reach[budget]:
            continue
        n, k = int(min(left[i], top // size)), 1
        while n > 0 and not reach[budget]:
            step = size * min(k, n)
            if step > top:
                break
            new = np.zeros(top + 1, bool)
            new[step:] = reach[:top + 1 - step]
            new &= ~reach
            item[new] = len(items)
            reach |= new
            items.append((i, min(k, n)))
            n -= min(k, n)
            k *= 2
    sums = np.flatnonzero(reach)
    best = at = int(sums[np.argmin(np.abs(sums - budget))])
    while at:
        i, k = items[item[at]]
        add[i] += k
        at -= int(lengths[i]) * k
    return best, add


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights=WEIGHTS, max_copies: int = MAX_COPIES, seed: int = 3) -> DataFrame:
    """(id, hash, source, size, source_size, target, copies): one row per input row.

    ``copies`` (0 to ``max_copies``) says how often the mix takes the
    document. Null texts have no words and are never taken; a null source is
    a source of its own, last in order. Repeated rows count and are chosen
    one by one. Ties of the seeded order are broken by id and text hash. An
    empty table gives no rows.
    """
    importable(docs.sparkSession)
    rows = store(docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        text_hash(F.col(text_col)).alias("hash")), "sizes")
    hist = rows.groupBy("source", "size").agg(F.count("*").alias("n"))
    per_source = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = store(source_targets(per_source, weights, max_copies), "targets")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        lengths, counts = pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
        total = int(lengths @ counts)
        goal = int(np.floor(pdf["target"].iloc[0] + 0.5))
        base = min(max_copies, goal // total) if total else 0
        extra = fit_counts(lengths, counts, goal - base * total) if base < max_copies and total else counts * 0
        return pd.DataFrame({"source": pdf["source"], "size": lengths, "n": counts,
                             "source_size": pdf["source_size"], "target": pdf["target"], "base": base, "extra": extra})

    same_source = hist["source"].eqNullSafe(targets["source"])
    quotas = store(
        hist.join(targets, same_source).select(hist["source"], "size", "n", "source_size", "target")
        .groupBy("source").applyInPandas(
            fit, "source string, size long, n long, source_size long, target double, base long, extra long"), "quotas")
    # A seeded number in [0, parts) splits rows of one source and length into groups of bounded size.
    r = F.pmod(F.xxhash64(F.lit(seed), F.col("id"), F.col("hash")), F.lit(1 << 40))
    q = quotas.withColumnRenamed("source", "q_source").withColumnRenamed("size", "q_size")
    ranked = (rows.withColumn("r", r)
              .join(q, F.col("source").eqNullSafe(F.col("q_source")) & (F.col("size") == F.col("q_size")))
              .withColumn("part", F.floor(F.col("r") * F.ceil(F.col("n") / GROUP) / (1 << 40)).cast("int"))
              .drop("q_source", "q_size"))
    ranked = store(ranked, "ranked")
    cut = ranked.filter((F.col("extra") > 0) & (F.col("extra") < F.col("n")))
    parts = cut.groupBy("source", "size", "part").agg(F.count("*").alias("rows"), F.first("extra").alias("extra"))
    below = F.coalesce(F.sum("rows").over(Window.partitionBy("source", "size").orderBy("part")
                                          .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # the one part of each length in which the quota ends
    edge = (parts.withColumn("below", below)
            .filter((F.col("below") <= F.col("extra")) & (F.col("extra") < F.col("below") + F.col("rows")))
            .select(F.col("source").alias("e_source"), F.col("size").alias("e_size"), F.col("part").alias("e_part"),
                    (F.col("extra") - F.col("below")).alias("quota")))
    placed = ranked.join(edge, F.col("source").eqNullSafe(F.col("e_source")) & (F.col("size") == F.col("e_size")),
                         "left")
    inside = placed.filter(F.col("part") == F.col("e_part"))
    order = Window.partitionBy("source", "size").orderBy("r", "id", "hash")
    inside = inside.withColumn("more", (F.row_number().over(order) <= F.col("quota")).cast("long"))
    outside = placed.filter("e_part IS NULL OR part <> e_part").withColumn(
        "more", F.when(F.col("e_part").isNull(), F.col("extra") >= F.col("n"))
        .otherwise(F.col("part") < F.col("e_part")).cast("long"))
    return inside.unionByName(outside).select(
        "id", "hash", "source", "size", "source_size", "target",
        F.when(F.col("size") == 0, F.lit(0).cast("long")).otherwise(F.col("base") + F.col("more")).alias("copies"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    **options) -> DataFrame:
    """The rows of ``docs``, each as often as ``mix`` takes it (columns unchanged).

    Repeated rows share their copies: the n-th of equal rows cannot be told
    apart, so their copies are summed and dealt evenly.
    """
    chosen = mix(docs, id_col, text_col, source_col, **options)
    per_row = chosen.groupBy("id", "hash", "source").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    per_row = per_row.select(F.col("id").alias("_m_id"), F.col("hash").alias("_m_hash"),
                             F.col("source").alias("_m_source"), F.col("copies").alias("_m_copies"),
                             F.col("rows").alias("_m_rows"))
    d = docs.withColumn("_m_text_hash", text_hash(F.col(text_col)))
    joined = d.join(per_row, F.col(id_col).eqNullSafe(F.col("_m_id")) & (F.col("_m_text_hash") == F.col("_m_hash"))
                    & F.col(source_col).cast("string").eqNullSafe(F.col("_m_source")))
    nth = F.when(F.col("_m_rows") == 1, F.lit(1)).otherwise(F.row_number().over(
        Window.partitionBy("_m_id", "_m_hash", "_m_source").orderBy(F.lit(0))))
    times = F.floor(F.col("_m_copies") / F.col("_m_rows")) + (
        F.col("_m_nth") <= F.col("_m_copies") % F.col("_m_rows")).cast("long")
    single = joined.filter("_m_rows = 1 AND _m_copies > 0").withColumn("_m_times", F.col("_m_copies"))
    several = (joined.filter("_m_rows > 1 AND _m_copies > 0").withColumn("_m_nth", nth)
               .withColumn("_m_times", times).filter("_m_times > 0").drop("_m_nth"))
    out = single.unionByName(several)
    return out.withColumn("_m_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_m_times")))).select(
        *[F.col(f"`{c}`") for c in docs.columns])
