"""Embedding near-duplicates by sorted projection passes (operator 2).

First passes concatenate random hyperplane signs to one hash per vector, sort
all vectors by it across partitions, and compare every vector with a window
of neighbours in that order (its tile and the next). That unites large
groups of near copies, which need no further comparing among themselves.

Bucket passes then compare all vectors that share the first ``depth`` signs,
however many they are. Two vectors share them with a chance that depends on
their angle only, so the number of passes for a depth holds for every set of
vectors, also for clustered ones; the depth is the cheapest for a sample.
Verified links (cosine >= threshold, double precision) of all passes are
united to components, and direct links are counted inside components.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitwall.llm.common import importable, store, tasks_for
from pitwall.llm.graph import connected_components, forest

WINDOW = 256
BITS = 62
FIRST_PASSES = 4
MISSED = 1e-3       # chance that a link exactly at the threshold is in no bucket pass
CHUNK = 512
PASSES_AT_ONCE = 2  # a pass shuffles every vector twice
SAMPLE = 1024       # vectors from which the cost of a depth is estimated
ROW_COST = 600      # moving a vector, in comparisons


def passes_for(depth: int, threshold: float) -> int:
    """Bucket passes so that a pair at ``threshold`` shares its first ``depth`` signs in one of them."""
    p = (1 - math.acos(threshold) / math.pi) ** depth
    return 1 if p >= 1 else max(1, math.ceil(math.log(MISSED) / math.log1p(-p)))


def depth_for(sample: list, n: int, threshold: float) -> int:
    """Cheapest depth for ``n`` vectors like the sample's; any depth finds as much, with its own passes."""
    same = np.zeros((len(sample), len(sample)))     # chance that two vectors share a sign
    size = np.array([len(v) for v in sample])
    for dim in np.unique(size):
        own = np.flatnonzero(size == dim)
        x = matrix(pa.array([sample[i] for i in own], pa.list_(pa.float64())))
        cosine = np.clip(x @ x.T, -1, 1)
        # first passes leave few links open
        same[np.ix_(own, own)] = np.where(cosine >= threshold, 0, 1 - np.arccos(cosine) / math.pi)
    costs = []
    for depth in range(BITS + 1):
        pairs = n * n / 2 * float(np.mean(same ** depth)) if len(sample) else 0.0
        costs.append(passes_for(depth, threshold) * (ROW_COST * n * (1 + 2 * pairs / max(1, n) / CHUNK) + pairs))
    return int(np.argmin(costs))


def matrix(column) -> np.ndarray:
    """List column of a batch as unit rows in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def same_length(batches, column: int):
    """Batches cut so that all vectors of a piece have one length: (length, piece)."""
    for b in batches:
        if not b.num_rows:
            continue
        lengths = b.column(column).value_lengths().to_numpy(zero_copy_only=False)
        for dim in np.unique(lengths):
            yield int(dim), b if (lengths == dim).all() else b.filter(pa.array(lengths == dim))


def plain(batch: pa.RecordBatch, n: int) -> list[np.ndarray]:
    return [batch.column(i).to_numpy(zero_copy_only=False) for i in range(n)]


def places(nodes: DataFrame, passes: int, seed: int, window: int) -> DataFrame:
    """(pass, tile, node): where each vector stands in the order of each pass, as tiles of ``window`` places.

    Only hashes and node numbers are sorted, all passes in one go; the
    vectors stay where they are. Vectors of different lengths stand apart.
    """
    spark = nodes.sparkSession

    def keyed(batches):
        for dim, b in same_length(batches, 1):
            x, node = matrix(b.column(1)), b.column(0)
            for p in range(passes):
                planes = np.random.default_rng([seed, p, dim]).standard_normal((dim, BITS))
                keys = ((x @ planes > 0).astype(np.int64) << np.arange(BITS)[::-1]).sum(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(node), p, np.int32)), pa.array(np.full(len(node), dim, np.int32)),
                     pa.array(keys), node], ["pass", "dim", "key", "node"])

    def numbered(batches):
        part, n = TaskContext.get().partitionId(), 0
        for b in batches:
            at = np.arange(n, n + b.num_rows)
            n += b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, part)), pa.array(at), b.column(0),
                                              b.column(3)], ["part", "at", "pass", "node"])

    order = ["pass", "dim", "key", "node"]
    ordered = store(nodes.select("node", "vec").mapInArrow(keyed, "pass int, dim int, key long, node long")
                    .repartitionByRange(tasks_for(spark), *order).sortWithinPartitions(*order)
                    .mapInArrow(numbered, "part long, at long, pass int, node long"), "order")
    rows = {r["part"]: r["count"] for r in ordered.groupBy("part").count().collect()}   # one number per partition
    ends, total = {}, 0
    for p in sorted(rows):
        ends[p] = total
        total += rows[p]
    shared = spark.sparkContext.broadcast(ends)

    def tiled(batches):
        for b in batches:
            start = np.array([shared.value[p] for p in b.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array((start + b.column(1).to_numpy()) // window),
                                              b.column(3)], ["pass", "tile", "node"])

    return ordered.mapInArrow(tiled, "pass int, tile long, node long")


def neighbour_links(nodes: DataFrame, placed: DataFrame, threshold: float) -> DataFrame:
    """(a, b): verified links between vectors of the same tile or of neighbouring tiles."""
    # each vector goes to its own tile, and as a neighbour to the next one
    roles = F.explode(F.array(F.struct(F.col("tile").alias("tile"), F.lit(False).alias("neighbour")),
                              F.struct((F.col("tile") + 1).alias("tile"), F.lit(True).alias("neighbour"))))
    rows = (placed.join(nodes.select("node", "vec"), "node").select("node", "vec", roles.alias("r"))
            .select("r.tile", "r.neighbour", "node", "vec"))

    def compare(batches):
        held: dict[int, tuple] = {}
        for dim, b in same_length(batches, 3):
            tile, near, node = plain(b, 3)
            x = matrix(b.column(3))
            current, own_node, own = held.get(dim, (-1, node[:0], x[:0]))
            a, c = [], []
            cuts = np.flatnonzero(np.diff(tile)) + 1
            for s, e in zip([0, *cuts], [*cuts, len(tile)]):
                if tile[s] != current:
                    current, own_node, own = tile[s], node[:0], x[:0]
                m = s + int(np.searchsorted(near[s:e], True))
                fresh = len(own)
                own_node, own = np.concatenate([own_node, node[s:m]]), np.concatenate([own, x[s:m]])
                if fresh < len(own):
                    i, j = np.nonzero(own @ own[fresh:].T >= threshold)
                    a.append(own_node[i[i < j + fresh]])
                    c.append(own_node[j[i < j + fresh] + fresh])
                if m < e and len(own):
                    i, j = np.nonzero(own @ x[m:e].T >= threshold)
                    a.append(own_node[i])
                    c.append(node[m:e][j])
            held[dim] = (current, own_node, own)
            if a:
                a, c = forest(np.concatenate(a), np.concatenate(c))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c)], ["a", "b"])

    return (rows.repartition(tasks_for(nodes.sparkSession), "tile").sortWithinPartitions("tile", "neighbour")
            .mapInArrow(compare, "a long, b long"))


def buckets(nodes: DataFrame, depth: int, passes: int, seed: int) -> DataFrame:
    """(pass, bucket, node): vectors of one length that share their first ``depth`` signs in a pass."""
    def keyed(batches):
        for dim, b in same_length(batches, 1):
            x, node = matrix(b.column(1)), b.column(0)
            for p in range(passes):
                planes = np.random.default_rng([seed, 1, p, dim]).standard_normal((dim, depth))
                keys = ((x @ planes > 0).astype(np.int64) << np.arange(depth)).sum(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(node), p, np.int32)), pa.array(np.full(len(node), dim, np.int32)),
                     pa.array(keys), node], ["pass", "dim", "key", "node"])

    return (nodes.select("node", "vec").mapInArrow(keyed, "pass int, dim int, key long, node long")
            .select("pass", F.xxhash64("pass", "dim", "key").alias("bucket"), "node"))


def bucket_links(nodes: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """(a, b): verified links between vectors of one bucket, in units of CHUNK x CHUNK vectors.

    ``members`` has (bucket, node, root), the root from the first passes.
    Vectors of the root that has most of a bucket are not compared with each
    other, the others with every vector of the bucket.
    """
    spark = nodes.sparkSession
    per_root = members.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    sums = (per_root.groupBy("bucket").agg(F.sum("n").alias("size"), F.max(F.struct("n", "root")).alias("most"))
            .select("bucket", "size", (F.col("size") - F.col("most.n")).alias("outer"), F.col("most.root").alias("main"))
            .filter("outer > 0"))
    chunk = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    out_chunk = F.pmod(F.xxhash64(F.lit(1), "node"), F.col("out_chunks")).cast("int")
    open_ = (members.join(sums, "bucket").withColumn("inner", F.col("root") == F.col("main"))
             .withColumn("chunks", F.ceil(F.col("size") / CHUNK).cast("int"))
             .withColumn("out_chunks", F.ceil(F.col("outer") / CHUNK).cast("int")))
    # side 0: outer vectors, once per chunk of the bucket; side 1: all vectors, once per chunk of outer vectors
    every = F.transform(F.sequence(F.lit(0), F.col("out_chunks") - 1), lambda i: F.struct(
        i.alias("i"), chunk.alias("j"), F.lit(1).alias("side")))
    outer = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.struct(
        out_chunk.alias("i"), j.alias("j"), F.lit(0).alias("side")))
    roles = F.explode(F.when(F.col("inner"), every).otherwise(F.concat(every, outer)))
    rows = (open_.join(nodes.select("node", "vec"), "node").select("bucket", "node", "vec", roles.alias("r"))
            .select("bucket", "r.i", "r.j", "r.side", "node", "vec"))

    def compare(batches):
        open_units: dict[int, tuple] = {}
        for dim, b in same_length(batches, 5):
            bucket, i, j, side, node = plain(b, 5)
            x = matrix(b.column(5))
            unit, own_node, own = open_units.get(dim, (None, node[:0], x[:0]))
            cuts = np.flatnonzero((np.diff(bucket) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
            a, c = [], []
            for s, e in zip([0, *cuts], [*cuts, len(bucket)]):
                if unit != (bucket[s], i[s], j[s]):
                    unit, own_node, own = (bucket[s], i[s], j[s]), node[:0], x[:0]
                m = s + int(np.searchsorted(side[s:e], 1))
                own_node, own = np.concatenate([own_node, node[s:m]]), np.concatenate([own, x[s:m]])
                if m < e and len(own):
                    k, q = np.nonzero((own @ x[m:e].T >= threshold) & (own_node[:, None] != node[None, m:e]))
                    a.append(own_node[k])
                    c.append(node[m:e][q])
            open_units[dim] = (unit, own_node, own)
            if a:
                a, c = forest(np.concatenate(a), np.concatenate(c))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c)], ["a", "b"])

    return (rows.repartition(tasks_for(spark), "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "side")
            .mapInArrow(compare, "a long, b long"))


def count_links(members: DataFrame, threshold: float) -> DataFrame:
    """(node, linked): rows whose vectors are linked to the node's, its own rows left out.

    ``members`` has (root, node, n, vec). Members within half the threshold
    angle of the root's vector are all linked to each other: their rows are
    only summed. The others are compared with every member of their
    component, in units of CHUNK x CHUNK vectors.
    """
    spark = members.sparkSession
    half = math.acos(threshold) / 2 - 1e-9
    pivots = members.filter("node = root").select("root", F.col("vec").alias("pivot"))

    def angle(batches):
        for _, b in same_length(batches, 3):
            near = (matrix(b.column(3)) * matrix(b.column(4))).sum(axis=1)
            inner = np.arccos(np.clip(near, -1, 1)) <= half
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(inner), b.column(3)],
                                             ["root", "node", "n", "inner", "vec"])

    vec = members.schema["vec"].dataType.simpleString()
    told = store(members.join(pivots, "root").select("root", "node", "n", "vec", "pivot").mapInArrow(
        angle, f"root long, node long, n long, inner boolean, vec {vec}"), "angles")
    sums = told.groupBy("root").agg(F.sum(F.when(F.col("inner"), F.col("n")).otherwise(0)).alias("inner_rows"),
                                    F.count("*").alias("size"), F.sum((~F.col("inner")).cast("long")).alias("outer"))
    certain = told.filter("inner").join(sums, "root").select("node", (F.col("inner_rows") - F.col("n")).alias("linked"))
    chunk = F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / CHUNK)).cast("int")
    open_ = (told.join(sums.filter("outer > 0"), "root")
             .withColumn("chunk", chunk)
             .withColumn("chunks", F.ceil(F.col("size") / CHUNK).cast("int"))
             .withColumn("out_chunks", F.ceil(F.col("outer") / CHUNK).cast("int")))
    out_chunk = F.pmod(F.xxhash64(F.lit(1), "node"), F.col("out_chunks")).cast("int")
    # left: outer members, once per chunk of members; right: all members, once per chunk of outer members
    left = open_.filter("NOT inner").select(
        "root", out_chunk.alias("i"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("j"),
        F.lit(0).alias("side"), "node", "n", "inner", "vec")
    right = open_.select(
        "root", F.explode(F.sequence(F.lit(0), F.col("out_chunks") - 1)).alias("i"), F.col("chunk").alias("j"),
        F.lit(1).alias("side"), "node", "n", "inner", "vec")

    def block(batches):
        open_units: dict[int, tuple] = {}
        for dim, b in same_length(batches, 7):
            root, i, j, side, node, n, inner = plain(b, 7)
            x = matrix(b.column(7))
            unit, own = open_units.get(dim, (None, None))
            cuts = np.flatnonzero((np.diff(root) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
            nodes_out, linked_out = [], []
            for s, e in zip([0, *cuts], [*cuts, len(root)]):
                if unit != (root[s], i[s], j[s]):
                    unit, own = (root[s], i[s], j[s]), (node[:0], n[:0], x[:0])
                m = s + int(np.searchsorted(side[s:e], 1))
                own = tuple(np.concatenate([o, v[s:m]]) for o, v in zip(own, (node, n, x)))
                if m < e and len(own[0]):
                    hit = (own[2] @ x[m:e].T >= threshold) & (own[0][:, None] != node[None, m:e])
                    nodes_out.append(own[0])
                    linked_out.append(hit @ n[m:e])
                    back = (own[1] @ hit) * inner[m:e]      # an outer right row has its own turn as left row
                    nodes_out.append(node[m:e][back > 0])
                    linked_out.append(back[back > 0])
            open_units[dim] = (unit, own)
            if nodes_out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes_out)),
                                                  pa.array(np.concatenate(linked_out).astype(np.int64))],
                                                 ["node", "linked"])

    compared = (left.unionByName(right).repartition(tasks_for(spark), "root", "i", "j")
                .sortWithinPartitions("root", "i", "j", "side")
                .mapInArrow(block, "node long, linked long"))
    return certain.unionByName(compared).groupBy("node").agg(F.sum("linked").alias("linked"))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95,
                    seed: int = 2, window: int = WINDOW) -> DataFrame:
    """(id_col, n_links, component_id, kept), one row per input row.

    Vectors that are null, empty, zero or hold null or non-finite components
    have no links. Equal vectors are compared once and count with their
    rows; vectors of different lengths never link. A row with a null id
    takes part; it names a component only if all its ids are null. Repeated
    ids are rows of their own, and are never kept twice apart from equal
    ids. Other columns are not looked at; an empty table gives no rows.
    """
    importable(vectors.sparkSession)
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    vec = F.col("vec")
    usable = (F.coalesce(F.size(vec) > 0, F.lit(False)) & F.forall(vec, finite) & F.exists(vec, lambda v: v != 0))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    rows = rows.select("id", F.when(usable, F.transform("vec", lambda v: v + F.lit(0.0).cast("float"))).alias("vec"))
    keyed = rows.withColumn("node", F.when(F.col("vec").isNotNull(), F.xxhash64("vec")))
    nodes = store(keyed.filter("node IS NOT NULL").groupBy("node", "vec")
                  .agg(F.count("*").alias("n"), F.min("id").alias("low")), "distinct-vectors")
    count = nodes.count()
    placed = store(places(nodes, FIRST_PASSES, seed, window), "places")
    links = None
    for p in range(0, FIRST_PASSES, PASSES_AT_ONCE):    # vectors are moved for a few passes at a time
        some = placed.filter(F.col("pass").between(p, p + PASSES_AT_ONCE - 1))
        found = store(neighbour_links(nodes, some, threshold), f"first-pass{p}")
        links = found if links is None else links.unionByName(found)
    near = connected_components(links, "near")
    # nodes are hashes: the smallest are a random sample
    depth = depth_for([r["vec"] for r in nodes.select("node", "vec").orderBy("node").limit(SAMPLE).collect()],
                      count, threshold)
    passes = passes_for(depth, threshold)
    members = store(buckets(nodes, depth, passes, seed).join(near, "node", "left").select(
        "pass", "bucket", "node", F.coalesce("root", "node").alias("root")), "buckets")
    for p in range(0, passes, PASSES_AT_ONCE):
        some = members.filter(F.col("pass").between(p, p + PASSES_AT_ONCE - 1)).drop("pass")
        links = links.unionByName(store(bucket_links(nodes, some, threshold), f"pass{p}"))
    comp = connected_components(links, "embeddings")
    in_group = nodes.join(comp, "node")
    linked = count_links(in_group.select("root", "node", "n", "vec"), threshold)
    lows = in_group.groupBy("root").agg(F.min("low").alias("component"))
    named = comp.join(lows, "root").select("node", "component")
    per_node = (nodes.select("node", "n", "low").join(named, "node", "left").join(linked, "node", "left")
                .select("node", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                        F.coalesce("component", "low").alias("component_id")))
    return keyed.select("id", "node").join(per_node, "node", "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(F.col("node").isNull(), F.col("id").isNotNull())
        .otherwise(F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))).alias("kept"))
