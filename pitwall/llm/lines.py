"""Line dedup by pairwise alignment (operator 5).

Documents overlap if they share a line. Each shared line, however common,
pairs the document with the earliest document that has the line. Pairs are
aligned with patience diff over line hashes, and the blocks of lines they
have in common in the same order are deleted from the later document.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitwall.llm.common import importable, store, text_hash

BLANK = 0       # hash of lines without a word


def common_order(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places (in ``a``, in ``b``) of a longest common subsequence; blank lines are left out.

    Bit-parallel over ``a``: bit i of a row is 0 where line i lengthens the
    subsequence. Only every ``step``-th row is held, the others are made
    again on the way back.
    """
    both = (set(a) & set(b)) - {BLANK}
    at_a = [i for i, x in enumerate(a) if x in both]
    at_b = [j for j, x in enumerate(b) if x in both]
    where: dict[int, int] = {}
    for k, i in enumerate(at_a):
        where[a[i]] = where.get(a[i], 0) | 1 << k
    full = (1 << len(at_a)) - 1
    step = isqrt(len(at_b)) + 1

    def following(row: int, j: int) -> int:
        u = row & where[b[at_b[j]]]
        return ((row + u) | (row - u)) & full

    held, row = [], full
    for j in range(len(at_b)):
        if j % step == 0:
            held.append(row)
        row = following(row, j)
    out, i = [], len(at_a)
    for s in range(len(held) - 1, -1, -1):
        rows = [held[s]]                # rows before each line of this stretch, and after the last
        for j in range(s * step, min(len(at_b), (s + 1) * step)):
            rows.append(following(rows[-1], j))
        for k in range(len(rows) - 1, 0, -1):
            while i and rows[k] >> (i - 1) & 1:
                i -= 1
            if i and rows[k - 1] >> (i - 1) & 1:        # the line lengthens it here first
                i -= 1
                out.append((at_a[i], at_b[s * step + k - 1]))
    return out[::-1]


def patience_blocks(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Intervals of ``b`` aligned with ``a``: anchors are lines unique in both, in longest common order.

    Equal lines next to the ends of a stretch are matched first, then the
    stretch is split at its anchors; without any, at a longest common
    subsequence of its lines. Blank lines are matched next to other matches,
    never as anchors.
    """
    taken: list[int] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        s, e, t, u = todo.pop()
        while s < e and t < u and a[s] == b[t]:
            taken.append(t)
            s, t = s + 1, t + 1
        while s < e and t < u and a[e - 1] == b[u - 1]:
            e, u = e - 1, u - 1
            taken.append(u)
        if s >= e or t >= u:
            continue
        once_a, once_b = Counter(a[s:e]), Counter(b[t:u])
        where = {x: i for i, x in enumerate(a[s:e], s) if once_a[x] == 1 and x != BLANK}
        common = [(where[x], j) for j, x in enumerate(b[t:u], t) if once_b[x] == 1 and x in where]
        if common:
            tops: list[int] = []        # longest increasing subsequence of positions in a
            last: list[int] = []
            back = [-1] * len(common)
            for k, (i, _) in enumerate(common):
                pile = bisect_left(tops, i)
                back[k] = last[pile - 1] if pile else -1
                tops[pile:pile + 1] = [i]
                last[pile:pile + 1] = [k]
            chain, k = [], last[-1]
            while k >= 0:
                chain.append(common[k])
                k = back[k]
            chain.reverse()
        else:
            chain = [(s + i, t + j) for i, j in common_order(a[s:e], b[t:u])]
            if not chain:
                continue
        s0, t0 = s, t
        for i, j in chain:
            taken.append(j)
            todo.append((s0, i, t0, j))
            s0, t0 = i + 1, j + 1
        todo.append((s0, e, t0, u))
    out: list[tuple[int, int]] = []
    for j in sorted(taken):
        if out and out[-1][1] == j:
            out[-1] = (out[-1][0], j + 1)
        else:
            out.append((j, j + 1))
    # a block must have a line with words
    return [(s, e) for s, e in out if any(b[j] != BLANK for j in range(s, e))]


def drop_common_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_lines, n_removed, removed, kept), one row per input row.

    ``removed`` lists intervals (from, to) of line numbers, ``kept`` the other
    lines joined by line feeds. Earlier is the smaller id (null last), then
    the smaller text hash. Of equal texts the first row's stays and the
    others lose every line if they have a word; rows that also have the same
    id all count as first. Null and empty texts have no lines. An empty table
    gives no rows.
    """
    importable(docs.sparkSession)
    lines = F.transform(F.split("text", "\n"), lambda x: F.when(F.trim(F.translate(x, "\t\r\x0b\x0c", "    ")) == "",
                                                                F.lit(BLANK).cast("long")).otherwise(F.xxhash64(x)))
    order = F.struct(F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("hash").alias("hash"))
    rows = docs.select(F.col(id_col).alias("id"), text_hash(F.col(text_col)).alias("hash"),
                       F.col(text_col).cast("string").alias("text"))
    texts = store(rows.filter("text <> ''").select("hash", order.alias("key"), lines.alias("lines"))
                  .groupBy("hash").agg(F.min("key").alias("key"), F.first("lines").alias("lines")), "line-hashes")
    held = (texts.select("hash", "key", F.explode(F.array_distinct("lines")).alias("line"))
            .filter(F.col("line") != BLANK))
    # written, so that the join below deals its rows anew and a very common line can be split
    known = store(held.groupBy("line").agg(F.count("*").alias("docs"), F.min("key").alias("first"))
                  .filter("docs > 1").drop("docs"), "known-lines")
    pairs = store(held.join(known, "line").filter("first <> key")
                  .select("hash", F.col("first.hash").alias("earlier")).distinct(), "pairs")
    left = texts.select(F.col("hash").alias("earlier"), F.col("lines").alias("a"))
    right = texts.select("hash", F.col("lines").alias("b"))

    def align(batches):
        kind = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))
        for b in batches:
            out = [[{"from": s, "to": e} for s, e in patience_blocks(x, y)]
                   for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, kind)], ["hash", "blocks"])

    blocks = (pairs.join(left, "earlier").join(right, "hash").select("hash", "a", "b")
              .mapInArrow(align, "hash long, blocks array<struct<`from`: int, `to`: int>>"))
    removal = (blocks.groupBy("hash").agg(F.flatten(F.collect_list("blocks")).alias("blocks")))
    removal = texts.select("hash", "key").join(removal, "hash", "left")
    joined = rows.join(removal, "hash", "left")
    whole = F.array(F.struct(F.lit(0).alias("from"), F.size(F.split("text", "\n")).alias("to")))
    copy = ~F.col("id").eqNullSafe(F.col("key.id"))
    none = F.array().cast("array<struct<`from`: int, `to`: int>>")
    has_words = F.exists(F.split("text", "\n"), lambda x: F.trim(F.translate(x, "\t\r\x0b\x0c", "    ")) != "")
    gone = (F.when(F.col("key").isNull(), none).when(copy & has_words, whole)
            .otherwise(F.coalesce(F.col("blocks"), none)))
    parts = F.when(F.coalesce(F.col("text"), F.lit("")) == "", F.array().cast("array<string>")).otherwise(
        F.split("text", "\n"))
    kept = F.filter("parts", lambda x, i: ~F.exists("gone", lambda g: (g["from"] <= i) & (i < g["to"])))
    # overlapping blocks of several pairs become one interval
    at = F.filter(F.transform("parts", lambda x, i: F.when(F.exists("gone", lambda g: (g["from"] <= i) & (i < g["to"])),
                                                           i)), lambda i: i.isNotNull())
    interval = "struct<`from`: int, `to`: int>"
    merged = F.aggregate(at, F.array().cast(f"array<{interval}>"), lambda acc, i: F.when(
        (F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["to"] == i),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
            F.get(acc, F.size(acc) - 1)["from"].alias("from"), (i + 1).alias("to")).cast(interval))))
        .otherwise(F.concat(acc, F.array(F.struct(i.alias("from"), (i + 1).alias("to")).cast(interval)))))
    return (joined.withColumn("gone", gone).withColumn("parts", parts)
            .withColumn("left", kept)
            .select(F.col("id").alias(id_col), F.size("parts").cast("long").alias("n_lines"),
                    (F.size("parts") - F.size("left")).cast("long").alias("n_removed"),
                    merged.alias("removed"), F.array_join("left", "\n").alias("kept")))
