"""Substring dedup with an FM-index per shard (operator 4).

Every text is cut into segments: runs of consecutive windows that share the
smallest hash of their inner word groups. Equal windows have the same
smallest hash, so they meet in the shard of that hash. Segments whose hash
occurs in one document only cannot repeat across documents. All others,
equal ones once, are indexed per shard in a compressed FM-index: the
Burrows-Wheeler transform of their words in a bit-packed wavelet matrix.
Streaming the segments through it by backward search gives for every window
the interval of its occurrences, and from it the smallest document.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitwall.llm.common import (as_bytes, importable, mixed, pieces, range_hashes, store, tasks_for, text_hash,
                                word_hashes)

WINDOW = 50
GROUP, FINE_GROUP = 12, 40      # words per hashed group; the second for shards of very many segments
WIDE = 4096                     # segments of one hash from which the finer cut is used
INDEX_WORDS = 1 << 19           # words per index, unless one hash has more
LANE = 128                      # windows per search lane


@cache
def multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def segments(h: np.ndarray, size: np.ndarray, window: int, group: int):
    """Segments of word hashes ``h`` (texts of ``size`` words laid end to end).

    (text, first word in the text, windows, smallest hash, hash of all words), each an array.
    """
    none = np.empty(0, np.int64)
    if len(h) < window:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    g = np.zeros(len(h) - group + 1, np.uint64)
    for j, m in enumerate(multipliers(group)):
        g += h[j:j + len(g)] * m
    g = mixed(g)
    span, have = window - group + 1, 1
    while have < span:                      # sliding minimum by doubling
        step = min(have, span - have)
        g = np.minimum(g[:-step], g[step:])
        have += step
    text = np.repeat(np.arange(len(size)), size)
    first = np.cumsum(size) - size
    at = np.arange(len(g))
    whole = text[:len(g)] == text[window - 1:window - 1 + len(g)]
    at, g = at[whole], g[whole]
    if not len(at):
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    new = np.concatenate([[True], (np.diff(at) != 1) | (g[1:] != g[:-1]) | (text[at[1:]] != text[at[:-1]])])
    s = np.flatnonzero(new)
    runs = np.diff(np.append(s, len(at)))
    start = at[s]
    return text[start], start - first[text[start]], runs, g[s], range_hashes(h, start, start + runs + window - 1)


def document_segments(docs: DataFrame, window: int) -> DataFrame:
    """(low, whole, id, hash, start, windows): the segments of all documents with an id."""
    def run(batches):
        for b in batches:
            ids, hashes = b.column(0).to_numpy(), b.column(1).to_numpy()
            for s, texts in pieces(b.column(2)):
                h, size = word_hashes(texts)
                text, start, runs, low, whole = segments(h, size, window, GROUP)
                if len(text):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(low.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(ids[s + text]),
                         pa.array(hashes[s + text]), pa.array(start.astype(np.int32)),
                         pa.array(runs.astype(np.int32))], ["low", "whole", "id", "hash", "start", "windows"])

    return (docs.filter("id IS NOT NULL AND text IS NOT NULL").select("id", "hash", "text")
            .mapInArrow(run, "low long, whole long, id long, hash long, start int, windows int"))


def shared_segments(segs: DataFrame) -> DataFrame:
    """(low, whole, rep, wide): distinct segments whose smallest hash occurs in two documents or more."""
    distinct = segs.groupBy("low", "whole").agg(F.min(F.struct("id", "hash", "start", "windows")).alias("rep"),
                                                F.max("id").alias("high"))
    distinct = store(distinct, "distinct-segments")
    per_hash = (distinct.groupBy("low").agg(F.min("rep.id").alias("a"), F.max("high").alias("z"),
                                            F.count("*").alias("segments"))
                .filter("a < z").select("low", (F.col("segments") > WIDE).alias("wide")))
    return distinct.join(per_hash, "low").select("low", "whole", "rep", "wide")


def segment_words(docs: DataFrame, shared: DataFrame, window: int) -> DataFrame:
    """(shard, low, whole, off, id, words): the words of shared segments, cut finer where a hash is wide."""
    wanted = (shared.groupBy(F.col("rep.id").alias("id"), F.col("rep.hash").alias("hash"))
              .agg(F.collect_list(F.struct("rep.start", "rep.windows", "low", "whole", "wide")).alias("cuts")))

    def run(batches):
        for b in batches:
            rows = []
            for i, text, cuts in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), b.column(2).to_pylist()):
                w = text.split()
                for c in cuts:
                    part = w[c["start"]:c["start"] + c["windows"] + window - 1]
                    if not c["wide"]:
                        rows.append((c["low"], c["low"], c["whole"], 0, i, b" ".join(part)))
                        continue
                    _, start, runs, low, _ = segments(*word_hashes([b" ".join(part)]), window, FINE_GROUP)
                    for s, n, x in zip(start.tolist(), runs.tolist(), low.view(np.int64).tolist()):
                        rows.append((c["low"] ^ x, c["low"], c["whole"], s, i, b" ".join(part[s:s + n + window - 1])))
            for s in range(0, len(rows), 20000):
                col = list(zip(*rows[s:s + 20000]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(col[0], pa.int64()), pa.array(col[1], pa.int64()), pa.array(col[2], pa.int64()),
                     pa.array(col[3], pa.int32()), pa.array(col[4], pa.int64()),
                     pa.array(col[5], pa.binary()).cast(pa.string())],
                    ["shard", "low", "whole", "off", "id", "words"])

    # of rows equal in id and text, one stands for all in the index
    return (docs.select("id", "hash", "text").join(wanted, ["id", "hash"]).dropDuplicates(["id", "hash"])
            .select("id", "text", "cuts")
            .mapInArrow(run, "shard long, low long, whole long, off int, id long, words string"))


class FMIndex:
    """Backward search over sequences of word codes, exact for patterns of up to ``depth`` words."""

    def __init__(self, seqs: list[np.ndarray], docs: np.ndarray, depth: int):
        size = np.array([len(s) + 1 for s in seqs])
        text = np.zeros(int(size.sum()), np.int64)          # code 0 ends each sequence
        first = np.cumsum(size) - size
        for s, f in zip(seqs, first.tolist()):
            text[f:f + len(s)] = s
        n = self.n = len(text)
        rank, length = text, 1
        while length * 2 <= depth:                          # prefix doubling up to half the depth or more
            rank, length = self._pairs(rank, length), length * 2
        exact = lambda k: self._pairs(rank, k - length)     # noqa: E731  order by the first k words
        order = np.argsort(exact(2 * length), kind="stable")
        self.order = order
        self.bwt(text[order - 1])
        self.start = np.zeros(self.sigma + 1, np.int64)
        np.cumsum(np.bincount(text, minlength=self.sigma), out=self.start[1:])
        shorter = exact(depth - 1)[order]
        cut = np.flatnonzero(np.diff(shorter)) + 1
        lo = np.concatenate([[0], cut])
        group = np.repeat(np.arange(len(lo)), np.diff(np.append(lo, n)))
        self.lo, self.hi = lo[group], np.append(cut, n)[group]      # interval of all but the last word
        same = exact(depth)[order]
        runs = np.concatenate([[0], np.flatnonzero(np.diff(same)) + 1])
        self.run = np.repeat(np.arange(len(runs)), np.diff(np.append(runs, n)))
        self.least = np.minimum.reduceat(np.repeat(docs, size)[order], runs)

    @staticmethod
    def _pairs(rank: np.ndarray, shift: int) -> np.ndarray:
        key = rank * (int(rank.max()) + 2)
        if shift < len(rank):
            key[:-shift] += rank[shift:] + 1
        return np.unique(key, return_inverse=True)[1]

    def bwt(self, codes: np.ndarray) -> None:
        """Wavelet matrix: per bit of the code a packed bit vector with counts per 64 bits."""
        self.sigma = int(codes.max()) + 1
        self.levels = []
        for shift in range(max(1, (self.sigma - 1).bit_length()) - 1, -1, -1):
            bit = ((codes >> shift) & 1).astype(np.uint8)
            packed = np.packbits(np.append(bit, np.zeros(64 + -len(bit) % 64, np.uint8)), bitorder="little").view(np.uint64)
            ones = np.zeros(len(packed) + 1, np.int64)
            np.cumsum(np.bitwise_count(packed), out=ones[1:])
            self.levels.append((shift, packed, ones, int(len(bit) - bit.sum())))
            codes = np.concatenate([codes[bit == 0], codes[bit == 1]])
        every = np.arange(self.sigma)
        self.zero = self._descend(every, np.zeros(self.sigma, np.int64))

    def _descend(self, c: np.ndarray, pos: np.ndarray) -> np.ndarray:
        for shift, packed, ones, zeros in self.levels:
            w, r = pos >> 6, (pos & 63).astype(np.uint64)
            rank = ones[w] + np.bitwise_count(packed[w] & ((np.uint64(1) << r) - np.uint64(1)))
            pos = np.where((c >> shift) & 1, zeros + rank, pos - rank)
        return pos

    def extend(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        """Intervals of the patterns with word ``c`` put before them."""
        both = self._descend(np.concatenate([c, c]), np.concatenate([lo, hi]))
        base = self.start[c] - self.zero[c]
        return both[:len(c)] + base, both[len(c):] + base

    def least_documents(self, seqs: list[np.ndarray], depth: int) -> list[np.ndarray]:
        """For every window of the indexed sequences, the smallest document that has it."""
        out = [np.empty(len(s) - depth + 1, np.int64) for s in seqs]
        lanes = [(len(s[f:f + LANE + depth - 1]), k, f) for k, s in enumerate(seqs) for f in range(0, len(out[k]), LANE)]
        lanes.sort(reverse=True)
        size = np.array([x[0] for x in lanes])
        flat = np.concatenate([seqs[k][f:f + m] for m, k, f in lanes])
        end = np.cumsum(size)
        low = np.empty(len(flat), np.int64)
        lo, hi = np.zeros(len(lanes), np.int64), np.full(len(lanes), self.n)
        for t in range(int(size[0])):
            live = int(np.searchsorted(-size, -t, side="left"))     # lanes longer than t
            lo, hi = lo[:live], hi[:live]
            if t >= depth:
                lo, hi = self.lo[lo], self.hi[lo]
            at = end[:live] - 1 - t
            lo, hi = self.extend(flat[at], lo, hi)
            if t >= depth - 1:
                low[at] = self.least[self.run[lo]]
        assert (hi > lo).all(), "an indexed sequence was not found"
        for (m, k, f), e in zip(lanes, end.tolist()):
            out[k][f:f + m - depth + 1] = low[e - m:e - depth + 1]
        return out


def window_sources(words: DataFrame, window: int) -> DataFrame:
    """(low, whole, from, to, source): windows of each segment with the smallest document that has them."""
    def search(rows):
        code: dict[bytes, int] = {}
        seqs = [np.array([code.setdefault(x, len(code) + 1) for x in r[4].split()], np.int64) for r in rows]
        index = FMIndex(seqs, np.array([r[3] for r in rows]), window)
        out = []
        for r, least in zip(rows, index.least_documents(seqs, window)):
            cut = np.concatenate([[0], np.flatnonzero(np.diff(least)) + 1, [len(least)]])
            out += [(r[0], r[1], r[2] + int(a), r[2] + int(b), int(least[a])) for a, b in zip(cut[:-1], cut[1:])]
        col = list(zip(*out))
        return pa.RecordBatch.from_arrays(
            [pa.array(col[0], pa.int64()), pa.array(col[1], pa.int64()), pa.array(col[2], pa.int32()),
             pa.array(col[3], pa.int32()), pa.array(col[4], pa.int64())], ["low", "whole", "from", "to", "source"])

    def run(batches):
        rows, n, last = [], 0, None
        for b in batches:
            for shard, *r, w in zip(*(b.column(i).to_pylist() for i in range(5)), as_bytes(b.column(5))):
                if shard != last and n >= INDEX_WORDS:
                    yield search(rows)
                    rows, n = [], 0
                last = shard
                rows.append((*r, w))
                n += w.count(b" ") + 1
        if rows:
            yield search(rows)

    return (words.repartition(tasks_for(words.sparkSession), "shard").sortWithinPartitions("shard")
            .mapInArrow(run, "low long, whole long, `from` int, `to` int, source long"))


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id_col, n_words, n_removed, removed, kept), one row per input row.

    ``removed`` lists the word intervals (from, to) that are covered by a
    window which also starts in a document with a smaller id; ``kept`` is the
    rest, words joined by one space. Rows with the same id are one document
    in that respect: they don't remove from each other. Null texts have no
    words and stay null-free (kept is empty); rows with a null id neither
    remove nor lose anything. Texts shorter than the window stay as they
    are. Other columns are not looked at; an empty table gives no rows.
    """
    importable(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_hash(F.col(text_col)).alias("hash"),
                       F.col(text_col).cast("string").alias("text"))
    segs = store(document_segments(rows, window), "segments")
    shared = store(shared_segments(segs), "shared-segments")
    found = store(window_sources(segment_words(rows, shared, window), window), "window-sources")
    hits = (segs.join(found, ["low", "whole"]).filter("source < id")
            .select("id", "hash", (F.col("start") + F.col("from")).alias("from"),
                    (F.col("start") + F.col("to") - 1 + window).alias("to")))
    gone = hits.groupBy("id", "hash").agg(F.collect_set(F.struct("from", "to")).alias("gone"))
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches):
        for b in batches:
            n_words, n_removed, removed, kept = [], [], [], []
            for t, g in zip(as_bytes(b.column(1)), b.column(2).to_pylist()):
                w = (t or b"").split()
                merged: list[list[int]] = []
                for x in sorted((x["from"], x["to"]) for x in g or ()):
                    if merged and x[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], x[1])
                    else:
                        merged.append(list(x))
                rest, at = [], 0
                for s, e in merged:
                    rest += w[at:s]
                    at = e
                rest += w[at:]
                n_words.append(len(w))
                n_removed.append(len(w) - len(rest))
                removed.append([{"from": s, "to": e} for s, e in merged])
                kept.append(b" ".join(rest))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array(removed, pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))),
                 pa.array(kept, pa.binary()).cast(pa.string())], ["id", "n_words", "n_removed", "removed", "kept"])

    return (rows.join(gone, ["id", "hash"], "left").select(F.col("id").cast(kind).alias("id"), "text", "gone")
            .mapInArrow(cut, f"id {kind}, n_words long, n_removed long, "
                             "removed array<struct<`from`: int, `to`: int>>, kept string")
            .withColumnRenamed("id", id_col))
