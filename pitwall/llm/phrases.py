"""Phrase collocation mining by set-oriented relations (operator 13, SETM).

The occurrence relation (group, piece, position) of one-word groups is written
once, sorted by place. Level by level it is merge-joined with itself by piece
and adjacent position, the groups found are counted, and only occurrences of
frequent groups (a semi-join) are extended to the next length.

The relation is stored in blocks of about BLOCK words, each one row with
sorted arrays, so that a merge-join is a join of two sorted arrays inside a
task. What crosses the network are the distinct groups of a block with their
counts, packed per target partition: a group holds at most one entry per
block, however frequent it is, so no key is hot. A place is a word's number in
its block plus one for each piece before it: neighbours in a piece, and only
those, differ by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitwall.llm.common import byte_tables, as_bytes, importable, mixed, range_hashes, store, tasks_for

BLANKS = b"\x20\x09"
ENDS = b".,;:!?\x0a\x0b\x0c\x0d"    # between pieces
BLOCK = 1 << 20                     # words of a block, from which it is closed
TEXT_BYTES = 1 << 22                # longer texts are read in parts, cut between pieces
CODE_BITS = 24                      # groups of a block; block numbers are above
SHARE = 1 << 20                     # words a partition of a count is sized for
RANK_SHARES = 64                    # shares of a language's phrases that are ranked apart first
UNKNOWN = "und"

BLOCKS = pa.schema([("block", pa.int64()), ("at", pa.binary()), ("codes", pa.binary()),
                    ("langs", pa.list_(pa.string())), ("words", pa.list_(pa.binary())), ("counts", pa.list_(pa.int64()))])


def pack(values: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane (high bytes are mostly alike), compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T
    return zstandard.compress(np.ascontiguousarray(planes), 1)


def unpack(data: bytes, dtype) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(dtype).reshape(-1)


def pack_places(at: np.ndarray) -> bytes:
    """Ascending places as their steps."""
    return pack(np.diff(at, prepend=-1).astype(np.int32))


def unpack_places(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.int32), dtype=np.int64) - 1


def text_parts(text: bytes) -> Iterator[bytes]:
    """A text in parts of about TEXT_BYTES, cut between pieces (a piece is never cut)."""
    ends, at = set(ENDS), 0
    while len(text) - at > TEXT_BYTES:
        cut = at + TEXT_BYTES
        while cut < len(text) and text[cut] not in ends:
            cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:]


class Block:
    """Words of many texts, waiting to be written as one row."""

    def __init__(self):
        self.texts, self.langs, self.size = [], {}, 0

    def add(self, lang: str, texts: list[bytes]) -> None:
        joined = b"\n".join(texts).lower() + b"\n"
        raw = np.frombuffer(joined, np.uint8)
        values, gap = byte_tables(BLANKS + ENDS)
        gap = gap[raw]
        starts = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
        if not len(starts):
            return
        ends = np.flatnonzero(gap & np.concatenate([[False], ~gap[:-1]]))
        piece = np.cumsum(byte_tables(ENDS)[1][raw])[starts]
        step = 1 + (np.diff(piece, prepend=piece[0] - 1) > 0)
        key = mixed(range_hashes(values[raw], starts, ends) + np.uint64(self.langs.setdefault(lang, len(self.langs))))
        self.texts.append((lang, joined, starts.astype(np.int32), ends.astype(np.int32), step.astype(np.int32), key))
        self.size += len(key)

    def row(self, number: int) -> pa.RecordBatch:
        """The block with its words numbered from the most frequent one."""
        keys, steps = (np.concatenate([t[k] for t in self.texts]) for k in (5, 4))
        _, first, inverse, count = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
        order = np.argsort(-count, kind="stable")
        code = np.empty(len(order), np.int32)
        code[order] = np.arange(len(order))
        place = np.cumsum([0, *(len(t[5]) for t in self.texts)])
        firsts = first[order]
        at, starts, ends = (x.tolist() for x in (np.searchsorted(place, firsts, "right") - 1, *(
            np.concatenate([t[k] for t in self.texts])[firsts] for k in (2, 3))))
        langs = [self.texts[t][0] for t in at]
        words = [self.texts[t][1][s:e] for t, s, e in zip(at, starts, ends)]
        return pa.RecordBatch.from_pydict({
            "block": [number], "at": [pack_places(np.cumsum(steps, dtype=np.int64))], "codes": [pack(code[inverse])],
            "langs": [langs], "words": [words], "counts": [count[order]]}, schema=BLOCKS)


def occurrence_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of the one-word relation from (lang, text) rows."""
    base, made, block = TaskContext.get().partitionId() << 20, 0, Block()
    for batch in batches:
        for s in range(0, batch.num_rows, 256):
            part = batch.slice(s, 256)
            waiting: dict[str, list[bytes]] = {}
            for lang, text in zip(part.column(0).to_pylist(), as_bytes(part.column(1))):
                for piece in text_parts(text or b""):
                    if len(piece) >= TEXT_BYTES:
                        block.add(lang, [piece])
                    else:
                        waiting.setdefault(lang, []).append(piece)
                    if block.size >= BLOCK:
                        yield block.row(base + made)
                        made, block = made + 1, Block()
            for lang, texts in waiting.items():
                block.add(lang, texts)
            if block.size >= BLOCK:
                yield block.row(base + made)
                made, block = made + 1, Block()
    if block.size:
        yield block.row(base + made)


RELATION = pa.schema([("block", pa.int64()), ("at", pa.binary()), ("groups", pa.binary())])


def keep_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Semi-join: a block's occurrences whose group is frequent, with the group's id.

    Rows are (block, at, codes, kept): ``kept`` has (code, id) parts of the block's frequent groups.
    """
    for batch in batches:
        for block, at, codes, kept in zip(*(c.to_pylist() for c in batch.columns)):
            codes = unpack(codes, np.int32)
            ids = np.full(int(codes.max(initial=-1)) + 1, -1, np.int64)
            for part in kept:
                ids[unpack(part["codes"], np.int32)] = unpack(part["ids"], np.int64)
            groups = ids[codes]
            stay = groups >= 0
            if stay.any():
                yield pa.RecordBatch.from_pydict({"block": [block], "at": [pack_places(unpack_places(at)[stay])],
                                                  "groups": [pack(groups[stay])]}, schema=RELATION)


PAIRS = pa.schema([("block", pa.int64()), ("at", pa.binary()), ("codes", pa.binary()), ("part", pa.int32()),
                   ("packed", pa.binary())])


def adjacent(at: np.ndarray, longer_at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge-join of sorted places: indexes (i, j) with ``at[j] == longer_at[i] + k``."""
    j = np.searchsorted(at, longer_at + k)
    i = np.flatnonzero(j < len(at))
    i = i[at[j[i]] == longer_at[i] + k]
    return i, j[i]


def extend(parts: int, k: int):
    """Each block's groups of k words, each followed by a frequent word, and their counts.

    Rows are (block, at, groups, word_at, words); the result has a row with the occurrences of the longer
    groups and a row per target partition with (left group, word, count, code) of the block's distinct ones.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, at, groups, word_at, words in zip(*(c.to_pylist() for c in batch.columns)):
                at, word_at = unpack_places(at), unpack_places(word_at)
                i, j = adjacent(word_at, at, k)
                if not len(i):
                    continue
                left, last = unpack(groups, np.int64)[i], unpack(words, np.int64)[j]
                order = np.lexsort((last, left))
                new = np.concatenate([[True], (np.diff(left[order]) != 0) | (np.diff(last[order]) != 0)])
                codes = np.empty(len(order), np.int32)
                codes[order] = np.cumsum(new) - 1
                starts = np.flatnonzero(new)
                left, last = left[order][starts], last[order][starts]
                count = np.diff(np.append(starts, len(order)))
                part = (mixed(mixed(left.astype(np.uint64)) + last.astype(np.uint64)) % np.uint64(parts)).astype(np.int32)
                by_part = np.argsort(part, kind="stable")
                cuts = np.searchsorted(part[by_part], np.arange(parts + 1))
                yield pa.RecordBatch.from_pydict({"block": [block], "at": [pack_places(at[i])], "codes": [pack(codes)],
                                                  "part": [-1], "packed": [None]}, schema=PAIRS)
                sent = [p for p in range(parts) if cuts[p] < cuts[p + 1]]
                chosen = [by_part[cuts[p]:cuts[p + 1]] for p in sent]
                yield pa.RecordBatch.from_pydict({
                    "block": [block] * len(sent), "at": [None] * len(sent), "codes": [None] * len(sent), "part": sent,
                    "packed": [pack(np.concatenate([np.diff(left[c], prepend=0), last[c], count[c], c])) for c in chosen]},
                    schema=PAIRS)
    return run


COUNTED = pa.schema([("block", pa.int64()), ("codes", pa.binary()), ("ids", pa.binary()), ("id", pa.int64()),
                     ("left", pa.int64()), ("last", pa.int64()), ("n", pa.int64())])


def count_groups(least: int):
    """Sums of the blocks' counts per group; rows that send frequent groups back, and the frequent groups.

    All entries of a group are in one partition. A group's id is its smallest (block, code).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[int, list] = {}       # by partition number of the count; a task can have several
        for batch in batches:
            for part, block, packed in zip(*(c.to_pylist() for c in batch.columns)):
                met.setdefault(part, []).append((block, packed))
        while met:
            _, rows = met.popitem()
            arrays = [unpack(p, np.int64).reshape(4, -1) for _, p in rows]
            blocks = np.repeat([b for b, _ in rows], [a.shape[1] for a in arrays])
            left = np.concatenate([np.cumsum(a[0]) for a in arrays])
            last, count, codes = (np.concatenate([a[r] for a in arrays]) for r in (1, 2, 3))
            del arrays, rows
            order = np.lexsort((last, left))
            new = np.concatenate([[True], (np.diff(left[order]) != 0) | (np.diff(last[order]) != 0)])
            starts = np.flatnonzero(new)
            n = np.add.reduceat(count[order], starts)
            ids = np.minimum.reduceat((blocks << CODE_BITS | codes)[order], starts)
            first, often = order[starts], n >= least
            if not often.any():
                continue
            k = int(often.sum())
            for s in range(0, k, 1 << 16):
                chosen = slice(s, min(k, s + (1 << 16)))
                size = chosen.stop - s
                yield pa.RecordBatch.from_pydict({
                    "block": [None] * size, "codes": [None] * size, "ids": [None] * size, "id": ids[often][chosen],
                    "left": left[first][often][chosen], "last": last[first][often][chosen], "n": n[often][chosen]},
                    schema=COUNTED)
            group = np.cumsum(new) - 1
            stay = order[often[group]]
            back_id = ids[group[often[group]]]
            by_block = np.argsort(blocks[stay], kind="stable")
            stay, back_id = stay[by_block], back_id[by_block]
            to, at = np.unique(blocks[stay], return_index=True)
            ends = np.append(at[1:], len(stay))
            none = [None] * len(to)
            yield pa.RecordBatch.from_pydict({
                "block": to, "codes": [pack(codes[stay[a:b]].astype(np.int32)) for a, b in zip(at, ends)],
                "ids": [pack(back_id[a:b]) for a, b in zip(at, ends)], "id": none, "left": none, "last": none,
                "n": none}, schema=COUNTED)
    return run


def sent_back(kept: DataFrame) -> DataFrame:
    return kept.groupBy("block").agg(F.collect_list(F.struct("codes", "ids")).alias("kept"))


def pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, codes, ids) from (block, [(code, id)])."""
    schema = pa.schema([("block", pa.int64()), ("codes", pa.binary()), ("ids", pa.binary())])
    for batch in batches:
        for i in range(batch.num_rows):
            flat = batch.column(1).slice(i, 1).flatten()
            yield pa.RecordBatch.from_pydict({
                "block": batch.column(0).slice(i, 1),
                "codes": [pack(flat.field(0).to_numpy(zero_copy_only=False).astype(np.int32))],
                "ids": [pack(flat.field(1).to_numpy(zero_copy_only=False))]}, schema=schema)


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most_words: int = 3,
                     least: int = 10) -> tuple[DataFrame, DataFrame]:
    """((lang, words, phrase, f) of phrases of up to ``most_words`` words that occur ``least`` times, (lang, n)).

    Texts are lower-cased in A-Z and split into pieces at ``[.,;:!?\\x0A-\\x0D]`` and into words at blanks and
    tabs. ``f`` counts all contiguous occurrences inside pieces, overlaps included; ``n`` all words of the
    language. A null text is empty, a null language ``und``; repeated rows count as often as they occur; an empty
    table gives no rows. Words are told apart inside a block by 64-bit hashes, across blocks by themselves.
    """
    spark = docs.sparkSession
    importable(spark)
    text = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"),
                       F.col(text_col).cast("string").alias("text"))
    ones = store(text.mapInArrow(occurrence_blocks, "block long, at binary, codes binary, langs array<string>, "
                                 "words array<binary>, counts array<long>"), "occurrences")
    local = ones.select("block", F.posexplode(F.arrays_zip("langs", "words", "counts")).alias("code", "w")).select(
        F.col("w.langs").alias("lang"), F.col("w.words").alias("word"), F.col("w.counts").alias("n"),
        (F.shiftleft("block", CODE_BITS) + F.col("code")).alias("at"))
    same = Window.partitionBy("lang", "word")
    often = store(local.withColumn("f", F.sum("n").over(same)).withColumn("id", F.min("at").over(same))
                  .filter(F.col("f") >= least).select(
                      "at", "id", "f", F.when(F.col("at") == F.col("id"), F.col("lang")).alias("lang"),
                      F.when(F.col("at") == F.col("id"), F.col("word")).alias("word")), "words")
    totals = local.groupBy("lang").agg(F.sum("n").alias("n"))
    block = F.shiftright("at", CODE_BITS)
    kept = (often.groupBy(block.alias("block")).agg(F.collect_list(F.struct(
        (F.col("at") - F.shiftleft(block, CODE_BITS)).alias("code"), "id")).alias("kept"))
        .mapInArrow(pack_rows, "block long, codes binary, ids binary"))
    words = store(ones.select("block", "at", "codes").join(sent_back(kept), "block")
                  .mapInArrow(keep_groups, "block long, at binary, groups binary"), "level1")
    one = often.filter("word IS NOT NULL").select("id", "lang", F.col("word").cast("string").alias("phrase"), "f")
    found = [store(one.withColumn("words", F.lit(1)), "phrases1")]
    parts = max(tasks_for(spark), int((totals.agg(F.sum("n")).first()[0] or 0) // SHARE) + 1)
    level = words
    second = words.select("block", F.col("at").alias("word_at"), F.col("groups").alias("words"))
    for k in range(1, most_words):
        both = level.select("block", "at", "groups", "at", "groups") if k == 1 else level.join(second, "block")
        made = store(both.mapInArrow(extend(parts, k), "block long, at binary, codes binary, part int, packed binary"),
                     f"groups{k + 1}")
        counted = store(made.filter("part >= 0").select("part", "block", "packed").repartition(parts, "part")
                        .mapInArrow(count_groups(least), "block long, codes binary, ids binary, id long, left long, "
                                    "last long, n long"), f"counted{k + 1}")
        groups = counted.filter("id IS NOT NULL")
        head = found[-1].select(F.col("id").alias("left"), "lang", F.col("phrase").alias("head"))
        tail = found[0].select(F.col("id").alias("last"), F.col("phrase").alias("tail"))
        found.append(store(groups.join(head, "left").join(tail, "last").select(
            "id", "lang", F.concat_ws(" ", "head", "tail").alias("phrase"), F.col("n").alias("f"),
            F.lit(k + 1).alias("words")), f"phrases{k + 1}"))
        if k + 1 < most_words:
            kept = counted.filter("id IS NULL").select("block", "codes", "ids")
            level = store(made.filter("part < 0").select("block", "at", "codes").join(sent_back(kept), "block")
                          .mapInArrow(keep_groups, "block long, at binary, groups binary"), f"level{k + 1}")
    phrases = found[0]
    for more in found[1:]:
        phrases = phrases.unionByName(more)
    return phrases.select("lang", "words", "phrase", "f"), totals


def cut_score(a: str, l: str, r: str):  # noqa: E741
    """floor(1000000 a a / (l r)) of three counts below 10 ** 16, in exact decimals."""
    return F.expr(f"(CAST({a} AS DECIMAL(16,0)) * CAST({a} AS DECIMAL(16,0)) * 1000000BD) div "
                  f"(CAST({l} AS DECIMAL(19,0)) * CAST({r} AS DECIMAL(19,0)))").cast("long")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most_words: int = 3, least: int = 10,
                 share: int = 50, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best ``top`` phrases of 2 to ``most_words`` words.

    Cutting a phrase of a = f(phrase) occurrences into two parts with l and r occurrences scores
    floor(1000000 a a / (l r)), in exact decimals; its lowest-scoring cut counts (ties: the shortest first part).
    A phrase goes if a longer one that contains it has at least ``share`` percent of its occurrences. Order is
    score descending, a descending, phrase ascending in bytes. Empty tables give no rows.
    """
    phrases, totals = frequent_phrases(docs, text_col, lang_col, most_words, least)
    several = phrases.filter("words > 1")
    word = F.split("phrase", " ")
    # every shorter phrase inside a longer one
    inner = several.filter("words > 2").select(
        "lang", F.col("f").alias("longer"), word.alias("w"), F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("k")
    ).select("lang", "longer", "w", "k", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("k") + 1)).alias("i")).select(
        "lang", "longer", F.array_join(F.slice("w", F.col("i"), F.col("k")), " ").alias("phrase"))
    covered = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    alone = several.join(covered, ["lang", "phrase"], "left").filter(
        F.coalesce(F.col("longer").cast("decimal(38,0)") * 100 < F.col("f").cast("decimal(38,0)") * share, F.lit(True))
    ).select("lang", "phrase", "words", F.col("f").alias("a"))
    cuts = alone.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", F.array_join(F.slice(word, F.lit(1), F.col("k")), " ").alias("head"),
        F.array_join(F.slice(word, F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("tail"))
    part = lambda name, n: phrases.select("lang", F.col("phrase").alias(name), F.col("f").alias(n))
    scored = cuts.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"]).withColumn(
        "score", cut_score("a", "l", "r"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("m")).select(
        "lang", "phrase", "a", "m.l", "m.r", "m.score")
    # each share of a language sends its own best ones, so that no task ranks a whole language
    by = [F.desc("score"), F.desc("a"), F.col("phrase")]
    share_of = best.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_SHARES)))
    firsts = share_of.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*by))).filter(
        F.col("rank") <= top)
    return (firsts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by))).filter(F.col("rank") <= top)
            .join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
