"""SimHash near-duplicates by tiled exact comparison (operator 8).

Fingerprints are collapsed to distinct values, then tiled by the population
counts of their four 16-bit words. Two fingerprints within ``radius`` bits
have word counts whose differences sum to at most ``radius``, so tile pairs
beyond that are skipped without looking at a row; the remaining tile pairs
are compared exactly with exclusive-or and bit counts. The skip never loses
a pair. A tile above ``TILE_ROWS`` is cut into chunks, each of which meets
all its neighbours in a separate unit of work.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitwall.llm.common import as_bytes, importable, store, tasks_for, text_hash
from pitwall.llm.graph import connected_components, forest

SEED = 42
TILE_ROWS = 512
WORDS = 4                       # 16 bits each
BASE = 64 // WORDS + 1          # population counts 0..16
BIT_TABLE = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    """XXH64 of every run of ``k`` words (fewer words: of the whole sequence)."""
    words = text.lower().split()   # bytes.lower() changes A-Z only
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(joined[s:e], SEED) for s, e in zip(starts[:len(words) - k + 1].tolist(),
                                                             ends[k - 1:].tolist())),
                       np.uint64, len(words) - k + 1)


def fingerprint(text: bytes | None, k: int) -> int:
    """64 bits: bit i is 1 if set in over half of the shingle hashes; 0 without words."""
    h = shingle_hashes(text or b"", k)
    if not len(h):
        return 0
    parts = h.view(np.uint8).reshape(-1, 8).astype(np.int64) + 256 * np.arange(8)
    counts = np.bincount(parts.ravel(), minlength=2048).reshape(8, 256) @ BIT_TABLE
    bits = (counts.ravel() * 2 > len(h)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, hash, fp): one row per input row, ``fp`` the fingerprint as a signed long, ``hash`` the text's hash."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), text_hash(F.col(text_col)).alias("hash"),
                      F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for b in batches:
            fps = [fingerprint(t, shingle) for t in as_bytes(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.int64())], ["id", "hash", "fp"])

    return src.mapInArrow(run, "id long, hash long, fp long")


def neighbour_offsets(radius: int) -> list[tuple[int, ...]]:
    """Count differences per word that a pair within ``radius`` bits can have."""
    return [o for o in itertools.product(range(-radius, radius + 1), repeat=WORDS)
            if sum(map(abs, o)) <= radius]


def close_links(nodes: DataFrame, radius: int, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(a, b): links that join all distinct fingerprints ``fp`` within ``radius`` bits.

    Links are a spanning forest per unit of work, never all pairs of a group.
    Shared with the tasks: rows per population-count class, at most 17**4 of
    them at any input size.
    """
    spark = nodes.sparkSession
    width = 64 // WORDS
    cls = sum((F.bit_count(F.shiftrightunsigned(F.col("fp"), width * i).bitwiseAND((1 << width) - 1))
               * BASE ** i for i in range(WORDS)), F.lit(0)).cast("int")
    nodes = nodes.select("fp", cls.alias("cls"))
    sizes = np.zeros(BASE ** WORDS, np.int64)
    for r in nodes.groupBy("cls").count().collect():   # at most 17**4 rows
        sizes[r["cls"]] = r["count"]
    chunks = -(-sizes // tile_rows)
    first = np.cumsum(chunks) - chunks                 # tile number of chunk 0 of each class
    shared = spark.sparkContext.broadcast((chunks.astype(np.int32), first))
    offsets = neighbour_offsets(radius)

    def deal(batches):
        """Each row to its own tile, and as a visitor to every earlier neighbour tile."""
        n_chunks, start = shared.value
        for b in batches:
            fp, own = b.column(0).to_numpy(), b.column(1).to_numpy().astype(np.int64)
            mix = (fp.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            chunk = (mix % n_chunks[own].astype(np.uint64)).astype(np.int64)
            digits = [(own // BASE ** i) % BASE for i in range(WORDS)]
            tile, rows, visitor = [start[own] + chunk], [np.arange(len(fp))], [np.zeros(len(fp), bool)]
            for off in offsets:
                moved = [d + o for d, o in zip(digits, off)]
                ok = np.logical_and.reduce([(m >= 0) & (m < BASE) for m in moved])
                other = sum(m * BASE ** i for i, m in enumerate(moved))
                ok &= other <= own
                idx = np.flatnonzero(ok)
                other = other[idx]
                count = np.where(other < own[idx], n_chunks[other], chunk[idx])
                idx, other, count = idx[count > 0], other[count > 0], count[count > 0]
                if len(idx):
                    within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                    tile.append(np.repeat(start[other], count) + within)
                    rows.append(np.repeat(idx, count))
                    visitor.append(np.ones(count.sum(), bool))
            rows = np.concatenate(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(tile)), pa.array(np.concatenate(visitor)), pa.array(fp[rows])],
                ["tile", "visitor", "fp"])

    def linked(home, other, same):
        home, other = home.view(np.uint64), other.view(np.uint64)   # bits of signed numbers count as of their size
        step = max(1, (1 << 19) // max(1, len(home)))
        a, b = [], []
        for s in range(0, len(other), step):
            i, j = np.nonzero(np.bitwise_count(home[:, None] ^ other[None, s:s + step]) <= radius)
            if same:
                i, j = i[i < j + s], j[i < j + s]
            a.append(home[i])
            b.append(other[s:s + step][j])
        none = np.empty(0, np.int64)
        return forest(np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)) if a else (none, none)

    def compare(batches):
        """Rows come sorted by tile, the tile's own rows first; visitors are streamed past them."""
        current, home, open_home = -1, np.empty(0, np.int64), False
        for b in batches:
            tile, visit, fp = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cuts = np.flatnonzero(np.diff(tile)) + 1
            out = []
            for s, e in zip([0, *cuts], [*cuts, len(tile)]):
                if s == e:
                    continue
                if tile[s] != current:
                    current, home = tile[s], np.empty(0, np.int64)
                n_own = int(np.searchsorted(visit[s:e], True))
                if n_own:
                    new = fp[s:s + n_own]
                    out.append(linked(new, new, True))
                    if len(home):
                        out.append(linked(home, new, False))
                    home = np.concatenate([home, new])
                if s + n_own < e and len(home):
                    out.append(linked(home, fp[s + n_own:e], False))
            a = np.concatenate([x[0] for x in out]) if out else np.empty(0, np.int64)
            c = np.concatenate([x[1] for x in out]) if out else np.empty(0, np.int64)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c)], ["a", "b"])

    dealt = (nodes.mapInArrow(deal, "tile long, visitor boolean, fp long")
             .repartition(tasks_for(spark), "tile").sortWithinPartitions("tile", "visitor"))
    return dealt.mapInArrow(compare, "a long, b long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                   radius: int = 2) -> DataFrame:
    """(id_col, fingerprint, component_id, component_root, text_hash), one row per input row.

    ``component_id`` is the smallest id reachable by links, ``component_root``
    the smallest fingerprint, a name that components without ids have too.
    Null and wordless texts have fingerprint zero and link like any other.
    Repeated rows and equal texts share one fingerprint, compared once. A
    null id is never a component's name unless all its ids are null. Other
    columns of ``docs`` are not looked at; an empty table gives no rows.
    """
    importable(docs.sparkSession)
    rows = store(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = store(rows.groupBy("fp").agg(F.min("id").alias("low")), "distinct-fingerprints")
    comp = connected_components(close_links(nodes, radius), "simhash")
    named = nodes.join(comp, nodes.fp == comp.node, "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("low").alias("component_id"))
    names = named.join(least, "root").select("fp", "root", "component_id")
    return rows.join(names, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id",
        F.col("root").alias("component_root"), F.col("hash").alias("text_hash"))
