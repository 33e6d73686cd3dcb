"""Benchmark decontamination by latent semantic retrieval (operator 1).

Passages are TF-IDF vectors over hashed words. A distributed randomised SVD
of passages and benchmark items gives a latent space of RANK dimensions;
overlapping windows of every document are projected on it, and a window is a
candidate for an item if their cosine there reaches the item's threshold. The
threshold is measured: changed copies of the item are planted among words of
the corpus, in windows of the item's length, and all but MISSED of them reach
it. Candidates are decided by longest common subsequence and an answer check,
which let paraphrases through.

A low rank cannot promise every pair. A second path therefore takes windows
whose words of the item weigh as much as those that any accepted window must
share with it, by squared weights in whole steps; ``latent`` tells which pairs the latent space found. Items of a few
words are looked up word for word.

Document frequencies are counted over all documents, the basis is fitted on
all passages of all documents and all benchmark items, and every window of
every document is searched; nothing comes from a sample. The items weigh four
times the passages. The words of a document are hashed once for the counts and
the basis, which read their columns from the shared folder, and once for the
search. The words that surround planted copies follow the document
frequencies. The basis serves benchmarks of any size; the texts are searched
once for each ITEM_BLOCK items.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitwall.llm.common import importable, pieces, store, text_hash, word_hashes

COLUMN_BITS = 15
COLUMNS = 1 << COLUMN_BITS
ITEM_BLOCK = 232                # benchmark items searched for in one pass over the corpus
RANK, OVERSAMPLE = 64, 16
PASSAGE = 64
BASIS_PASSAGES = 4096           # multiplied at a time
TASK_PASSAGES = 1 << 17         # of one task at least, unless cores are idle: every task shuffles a sum of 10 MB
OFTEN, LEAST_OFTEN = 48, 8      # a column of more than one word for so many passages, and of more words than the
                                # least, is summed by a matrix product
TURNS = 2048                    # sums taken at a time, so that they stay in the processor's cache
PLANTED, MISSED = 32, 0.05      # changed copies per item that set its threshold, and the share left below it
FILLER_WORDS = 1 << 15          # words around them, as frequent as in the documents
VERBATIM, PARAPHRASE, ANSWER = 0.7, 0.55, 0.8
WINDOW_BLOCKS = 3               # half scales in a window; an occurrence lies in one window whole
SHORT_ITEM = 8                  # items of fewer words must occur word for word
LEAST_WINDOW = SHORT_ITEM
STEPS = 640                     # of the largest squared weight of a word
WINDOWS, CANDIDATES = 1024, 8192    # compared and counted at a time
COUNTED_WORDS = 1 << 18         # whose documents are counted at a time
CACHE_BYTES = 1 << 17           # of sums taken at a time
BUCKETS_PER_BLOCK = 256
ROWS_AT_ONCE = 4096             # widened to doubles at a time on the driver
PIECE_BYTES = 1 << 18
# ASCII punctuation, blanks and control characters separate words
SEPARATORS = bytes(i for i in range(128) if not chr(i).isalnum())


def words(text: str) -> np.ndarray:
    """64-bit ids of the lower-cased words of a text, punctuation left out."""
    return word_hashes([text.lower().encode("utf-8", "surrogatepass")], SEPARATORS)[0].view(np.int64)


def batch_words(column: pa.Array):
    """(first row, word ids, words per row) of a string column, in pieces; null is empty."""
    for at, texts in pieces(pc.utf8_lower(column), PIECE_BYTES):
        h, size = word_hashes(texts, SEPARATORS)
        yield at, h.view(np.int64), size


def columns(ids: np.ndarray) -> np.ndarray:
    return (ids & (COLUMNS - 1)).astype(np.int32)


def word_columns(texts: DataFrame) -> DataFrame:
    """(words, weight) of (text, weight): the columns of each text's words, two bytes each; wordless texts are left out."""
    def run(batches):
        for b in batches:
            for at, ids, size in batch_words(b.column(0)):
                some = size > 0
                ends = np.concatenate([[0], np.cumsum(2 * size[some])]).astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [
                    None, pa.py_buffer(ends), pa.py_buffer(columns(ids).astype("<i2"))])
                yield pa.RecordBatch.from_arrays([packed, b.column(1).slice(at, len(size)).filter(pa.array(some))],
                                                 ["words", "weight"])

    return texts.select(F.col("text").cast("string"), F.col("weight").cast("double")).mapInArrow(
        run, "words binary, weight double")


def unpacked(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(columns of all words, words per text) of packed columns."""
    if not len(words):
        return np.empty(0, "<i2"), np.empty(0, np.int64)
    kind = np.int64 if pa.types.is_large_binary(words.type) else np.int32
    ends = np.frombuffer(words.buffers()[1], kind)[words.offset:words.offset + len(words) + 1].astype(np.int64)
    return np.frombuffer(words.buffers()[2], np.uint8)[ends[0]:ends[-1]].view("<i2"), np.diff(ends) // 2


def document_frequencies(docs: DataFrame, text_col: str) -> tuple[int, int, np.ndarray]:
    """(documents with words, passages, documents per column), over all documents."""
    return column_frequencies(word_columns(docs.select(F.col(text_col).alias("text"), F.lit(1.0).alias("weight"))))


def column_frequencies(packed: DataFrame) -> tuple[int, int, np.ndarray]:
    """``document_frequencies`` of (words, weight)."""
    def count(batches):
        df, n, passages = np.zeros(COLUMNS, np.int64), 0, 0
        for b in batches:
            cols, size = unpacked(b.column(0))
            n, passages, ends = n + len(size), passages + int((-(-size // PASSAGE)).sum()), np.cumsum(size)
            doc = 0
            while doc < len(size):
                first = ends[doc] - size[doc]
                last = max(doc + 1, int(np.searchsorted(ends, first + COUNTED_WORDS, side="right")))
                # a column counts once per document: sort (document, column) pairs
                pair = np.repeat(np.arange(last - doc) * COLUMNS, size[doc:last]) + cols[first:ends[last - 1]]
                pair.sort()
                once = pair[np.flatnonzero(np.diff(pair, prepend=-1))]
                df += np.bincount(once & (COLUMNS - 1), minlength=COLUMNS)
                doc = last
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([*at.tolist(), -1, -2]), pa.array([*df[at].tolist(), n, passages])],
                                         ["col", "n"])

    got = (packed.select("words").mapInArrow(count, "col long, n long")
           .groupBy("col").agg(F.sum("n").alias("n")).collect())   # at most COLUMNS + 2 rows
    df, seen = np.zeros(COLUMNS, np.int64), {}
    for r in got:
        if r["col"] < 0:
            seen[r["col"]] = r["n"]
        else:
            df[r["col"]] = r["n"]
    return seen.get(-1, 0), seen.get(-2, 0), df


def cut_passages(size: np.ndarray) -> np.ndarray:
    """Words of each passage of texts laid end to end; the last passage of a text is as long as is left of it."""
    n = -(-size // PASSAGE)
    out = np.full(int(n.sum()), PASSAGE, np.int64)
    last = np.cumsum(n)[n > 0] - 1
    out[last] -= (n * PASSAGE - size)[n > 0]
    return out


class Grouped:
    """The words of a few passages by column: counts of frequent columns in a matrix, the others in groups."""

    def __init__(self, cols: np.ndarray, rows: np.ndarray, height: int):
        """Column and row of each word; rows are under ``height``."""
        cols = cols.astype(np.int16)                # stable sort of short numbers is by radix
        order = np.argsort(cols, kind="stable")
        cols, rows = cols[order], rows[order]
        first = np.flatnonzero(np.diff(cols, prepend=-1))
        col, n = cols[first].astype(np.int64), np.diff(first, append=len(cols))
        often = n > max(LEAST_OFTEN, height // OFTEN)
        of = np.repeat(often, n)
        cell = np.repeat((np.cumsum(often) - 1)[often] * height, n[often]) + rows[of]
        self.often, self.counts = col[often], np.zeros((int(often.sum()), height), np.float32)
        np.add.at(self.counts.reshape(-1), cell, np.float32(1))
        self.rare, self.n = col[~often], n[~often]
        self.first = np.cumsum(self.n) - self.n
        self.rare_cols, self.rare_rows = cols[~of], rows[~of]

    def forward(self, table: np.ndarray) -> np.ndarray:
        """The table's rows of the columns summed over each row's words."""
        out = self.counts.T @ np.take(table, self.often, axis=0)
        rows = self.rare_rows.astype(np.int16 if len(out) < 1 << 15 else np.int64)
        order, n = np.argsort(rows, kind="stable"), np.bincount(rows, minlength=len(out))
        for own, sums in sums_by_turns(table, self.rare_cols[order], np.cumsum(n) - n, n):
            out[own] += sums
        return out

    def add_to(self, total: np.ndarray, y: np.ndarray) -> None:
        """``total[column] += y[row]`` for every word."""
        total[self.often] += self.counts.astype(y.dtype, copy=False) @ y
        for own, sums in sums_by_turns(y, self.rare_rows, self.first, self.n):
            total[self.rare[own]] += sums


def sums_by_turns(table: np.ndarray, at: np.ndarray, first: np.ndarray, n: np.ndarray):
    """(groups, sums) of the table's rows ``at[first:first + n]`` of each group, TURNS groups at a time.

    The first row of each group, the second of each that has one, ...
    """
    by = np.argsort(-n, kind="stable")
    by = by[:np.count_nonzero(n)]
    for s in range(0, len(by), TURNS):
        own = by[s:s + TURNS]
        start, size = first[own], n[own]
        sums, taken = np.take(table, at[start], axis=0), np.empty((len(own), table.shape[1]), table.dtype)
        left = len(own) - np.searchsorted(size[::-1], np.arange(1, size[0]), side="right")
        for turn, k in enumerate(left.tolist(), 1):
            sums[:k] += np.take(table, at[start[:k] + turn], axis=0, out=taken[:k], mode="clip")
        yield own, sums


def add_by_column(total: np.ndarray, cols: np.ndarray, rows: np.ndarray, y: np.ndarray) -> None:
    """``total[col] += y[row]`` for every pair of a column and a row, repeats included."""
    Grouped(cols, rows, len(y)).add_to(total, y)


def gram_times(texts: DataFrame, basis: np.ndarray, idf: np.ndarray, passages: int = 0) -> np.ndarray:
    """A^T (A basis) over the unit TF-IDF rows A of all passages of (text, weight) or, packed, of (words, weight).

    COLUMNS rows at any input size. Each task shuffles the sum of its passages, so partitions are put together
    until a task has TASK_PASSAGES of about ``passages`` or every core has one.
    """
    spark = texts.sparkSession
    packed = texts if texts.columns[0] == "words" else word_columns(texts)
    packed = packed.coalesce(max(spark.sparkContext.defaultParallelism, passages // TASK_PASSAGES))
    width = basis.shape[1]
    shared = spark.sparkContext.broadcast(((idf[:, None] * basis).astype(np.float32), (idf ** 2).astype(np.float32)))

    def run(batches):
        table, squares = shared.value
        total = np.zeros((COLUMNS, width), np.float32)
        seen = np.zeros(COLUMNS, bool)
        for b in batches:
            cols, size = unpacked(b.column(0))
            weights = np.repeat(b.column(1).to_numpy(), -(-size // PASSAGE))
            size = cut_passages(size)
            ends = np.cumsum(size)
            for s in range(0, len(size), BASIS_PASSAGES):
                own = size[s:s + BASIS_PASSAGES]
                word = cols[ends[s] - own[0]:ends[s + len(own) - 1]]
                of = np.repeat(np.arange(len(own)), own)
                grouped = Grouped(word, of, len(own))
                # repeated words: tf-idf sums; their norm is close to that of the single terms
                norm = np.maximum(np.bincount(of, squares[word], minlength=len(own)), 1e-12)
                y = grouped.forward(table) * (weights[s:s + len(own)] ** 2 / norm)[:, None].astype(np.float32)
                grouped.add_to(total, y)
                seen[word] = True
        blocks = np.flatnonzero(seen.reshape(-1, BUCKETS_PER_BLOCK).any(axis=1)) * BUCKETS_PER_BLOCK
        if len(blocks):
            yield pa.RecordBatch.from_arrays(
                [pa.array(blocks), pa.array([total[s:s + BUCKETS_PER_BLOCK].tobytes() for s in blocks], pa.binary())],
                ["block", "part"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        s = sum(np.frombuffer(p, np.float32).astype(np.float64) for p in sorted(pdf["part"]))
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "part": [s.astype(np.float32).tobytes()]})

    out = np.zeros((COLUMNS, width), np.float32)
    for r in (packed.mapInArrow(run, "block long, part binary").groupBy("block")
              .applyInPandas(add, "block long, part binary").collect()):
        out[r["block"]:r["block"] + BUCKETS_PER_BLOCK] = np.frombuffer(r["part"], np.float32).reshape(-1, width)
    shared.destroy()
    return out * idf[:, None].astype(np.float32)


def latent_basis(texts: DataFrame, idf: np.ndarray, rank: int, seed: int = 1, passages: int = 0) -> np.ndarray:
    """COLUMNS x rank right singular vectors: randomised range finder, then Nystroem's approximation on that range.

    Both products are with all passages, so ``texts``, of (text, weight) or (words, weight), are read twice.
    """
    q = np.random.default_rng(seed).standard_normal((COLUMNS, rank + OVERSAMPLE), np.float32)
    g = gram_times(texts, q, idf, passages)
    q = g @ whitening(inner(g, g)).astype(np.float32)                   # orthonormal columns without a copy of g
    g = gram_times(texts, q, idf, passages)
    small = inner(q, g)
    half = g @ whitening((small + small.T) / 2).astype(np.float32)      # half @ half.T is near A^T A
    values, vectors = np.linalg.eigh(inner(half, half))
    top = np.argsort(-values)[:rank]
    return half @ (vectors[:, top] / np.sqrt(np.maximum(values[top], 1e-30))).astype(np.float32)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a.T @ b`` in double precision; only ROWS_AT_ONCE rows are widened at a time."""
    return sum(a[s:s + ROWS_AT_ONCE].T.astype(np.float64) @ b[s:s + ROWS_AT_ONCE] for s in range(0, len(a), ROWS_AT_ONCE))


def whitening(gram: np.ndarray) -> np.ndarray:
    """W with W.T @ gram @ W the identity, on the part of ``gram`` that is not zero."""
    values, vectors = np.linalg.eigh(gram)
    keep = values > max(values[-1], 1e-30) * 1e-10
    return vectors[:, keep] / np.sqrt(values[keep])


class Items:
    """Benchmark items prepared for search: latent vectors, thresholds, masks for the subsequence."""

    def __init__(self, rows: list[tuple[int, str]], basis: np.ndarray, idf: np.ndarray, filler: np.ndarray):
        """``basis`` and ``idf`` end with a zero row; ``filler`` are columns of words of the corpus."""
        self.ids, self.words, self.masks, self.answers = [], [], [], []
        latent, whole, scale, limit, threshold = [], [], [], [], []
        rng = np.random.default_rng(len(rows))
        steps = np.maximum(1, np.rint(idf ** 2 * (STEPS / np.max(idf ** 2)))).astype(np.int64)
        for item_id, text in rows:
            w = words(text)
            if not len(w):
                continue
            answer = words(answer_of(text))
            v = np.zeros(len(idf), np.float32)
            np.add.at(v, columns(w), idf[columns(w)])
            size = np.linalg.norm(v)
            z = v @ basis
            z /= max(np.linalg.norm(z), 1e-12)
            self.ids.append(item_id)
            self.words.append(w.tolist())
            self.masks.append(masks(self.words[-1]))
            self.answers.append(masks(answer.tolist()))
            scale.append(max(LEAST_WINDOW, 1 << (len(w) - 1).bit_length()))
            near = cosines(planted(columns(w), len(answer), 3 * (scale[-1] // 2), filler, rng), basis, idf, z[None])
            threshold.append(np.quantile(near, MISSED))
            latent.append(z)
            own = np.flatnonzero(v)
            whole.append((own, v[own] / size))
            limit.append(least_product(steps[columns(w)], steps[columns(answer)]))
        self.latent = np.array(latent, np.float32).reshape(len(latent), basis.shape[1])
        self.scale = np.array(scale, np.int64)
        self.limit, self.threshold = np.array(limit, np.int64), np.array(threshold)
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.verbatim = np.array([at_least(VERBATIM, n) for n in self.size.tolist()], np.int64)
        self.least = np.array([at_least(PARAPHRASE, n) for n in self.size.tolist()], np.int64)
        self.least_answer = np.array([at_least(ANSWER, n) for _, n in self.answers], np.int64)
        # tables of the items' words have a row for each of their columns, and a zero row for all others
        used = np.unique(np.concatenate([np.empty(0, np.int64), *[own for own, _ in whole]]))
        self.row = np.full(COLUMNS + 1, len(used), np.int32)
        self.row[used] = np.arange(len(used))
        self.steps = np.append(steps[used], 0)
        self.product = np.zeros((len(used) + 1, len(latent)), np.float32)
        for k, (own, share) in enumerate(whole):
            self.product[self.row[own], k] = share * idf[own]
        # 1 for a word of the item, 3 if also of its answer
        self.has = np.zeros((len(used) + 1, len(latent)), np.uint8)
        # number of the word in the item from 1, and how often the item and its answer have it
        self.nth = np.zeros(self.has.shape, np.int32)
        most = 1 + max(self.size.tolist(), default=0)
        self.in_item, self.in_answer = np.zeros((2, len(latent), most), np.int32)
        for k, (w, a) in enumerate(zip(self.words, self.answers)):
            self.has[self.row[columns(np.array(w))], k] = 1
            last = self.row[columns(np.array(list(a[0])))]
            self.has[last, k] = 3
            own, n = np.unique(self.row[columns(np.array(w))], return_counts=True)
            self.nth[own, k] = 1 + np.arange(len(own))
            self.in_item[k, 1:1 + len(own)] = n
            np.add.at(self.in_answer[k], self.nth[last, k], [m.bit_count() for m in a[0].values()])

    def enough(self, k: np.ndarray, n_words: np.ndarray, n_answer: np.ndarray) -> np.ndarray:
        """Whether windows with so many words of items ``k`` and of their answers may be accepted by ``judge``."""
        return (n_words >= self.verbatim[k]) | (n_words >= self.least[k]) & (n_answer >= self.least_answer[k])


def planted(item: np.ndarray, n_answer: int, width: int, filler: np.ndarray, rng) -> np.ndarray:
    """PLANTED windows of ``width`` columns: by turns VERBATIM of the item, or PARAPHRASE with ANSWER of its end."""
    out = np.empty((PLANTED, width), np.int64)
    for t in range(PLANTED):
        if t % 2:
            kept = rng.permutation(len(item))[:at_least(VERBATIM, len(item))]
        else:
            end = len(item) - 1 - rng.permutation(n_answer)[:at_least(ANSWER, n_answer)]
            rest = np.setdiff1d(np.arange(len(item)), end)
            kept = np.append(end, rng.permutation(rest)[:max(0, at_least(PARAPHRASE, len(item)) - len(end))])
        others = width - len(kept)
        out[t, :len(kept)] = item[kept]
        out[t, len(kept):] = np.take(filler, rng.integers(len(filler)) + np.arange(others), mode="wrap")
    return out


def cosines(windows: np.ndarray, basis: np.ndarray, idf: np.ndarray, latent: np.ndarray) -> np.ndarray:
    """Cosines in the latent space of windows, given by their columns, with unit vectors."""
    z = (basis[windows] * idf[windows][:, :, None]).sum(axis=1)
    return z @ latent.T / np.maximum(np.linalg.norm(z, axis=1), 1e-12)[:, None]


def at_least(share: float, n: int) -> int:
    """Words that make ``share`` of ``n`` words."""
    return int(np.ceil(share * n - 1e-9))


def least_product(squares: np.ndarray, answer: np.ndarray) -> int:
    """Least sum of squared weights shared with an item by a window that ``judge`` accepts, given those of its words."""
    item, last = np.sort(squares), np.sort(answer)
    verbatim = item[:at_least(VERBATIM, len(item))].sum()
    paraphrase = max(item[:at_least(PARAPHRASE, len(item))].sum(), last[:at_least(ANSWER, len(last))].sum())
    return int(min(verbatim, paraphrase))


def answer_of(text: str) -> str:
    """The item's last line or sentence that has a word."""
    parts = [p for p in re.split(r"[\n.!?]+", text) if len(words(p))]
    return parts[-1] if parts else text


def masks(w: list[int]) -> tuple[dict[int, int], int]:
    out: dict[int, int] = {}
    for i, x in enumerate(w):
        out[x] = out.get(x, 0) | 1 << i
    return out, len(w)


def common_subsequence(item: tuple[dict[int, int], int], seq: list[int], least: float = 0) -> int:
    """Length of the longest common subsequence, bit-parallel over the item's words.

    0 if fewer than ``least`` words of ``seq`` are in the item at all: no
    common subsequence is longer than that.
    """
    at, n = item
    present = list(filter(None, map(at.get, seq)))
    if len(present) < least:
        return 0
    full = v = (1 << n) - 1
    for m in present:
        u = v & m
        v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def contains(seq: list[int], part: list[int]) -> bool:
    return any(seq[i:i + len(part)] == part for i in range(len(seq) - len(part) + 1))


def judge(items: Items, k: int, seq: list[int]) -> tuple[bool, float, float]:
    """(contaminated, subsequence share, answer share) of item ``k`` in a window."""
    n = len(items.words[k])
    lcs = common_subsequence(items.masks[k], seq, PARAPHRASE * n) / n
    if n < SHORT_ITEM:
        return lcs == 1 and contains(seq, items.words[k]), lcs, lcs
    if lcs < PARAPHRASE:
        return False, lcs, 0.0
    answer = common_subsequence(items.answers[k], seq) / items.answers[k][1]
    return lcs >= VERBATIM or answer >= ANSWER, lcs, answer


def added(table: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """The table's rows summed over each row of columns; a zero row follows the last."""
    out = np.zeros((len(cols) + 1, table.shape[1]), table.dtype)
    rows = max(64, CACHE_BYTES // max(1, table.itemsize * table.shape[1]))
    taken = np.empty((min(rows, len(cols)), table.shape[1]), table.dtype)
    for s in range(0, len(cols), rows):
        part = np.ascontiguousarray(cols[s:s + rows].T, np.intp)
        own, one = out[s:s + part.shape[1]], taken[:part.shape[1]]
        for of in part:             # all are rows of the table; "clip" only spares a copy
            own += np.take(table, of, axis=0, out=one, mode="clip")
    return out


def paired(sums: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of blocks twice as wide, and blocks per text, from those of ``n`` blocks per text; a zero row ends both."""
    wide = -(-n // 2)
    nth = 2 * (np.arange(wide.sum()) - np.repeat(np.cumsum(wide) - wide, wide))
    left = np.repeat(np.cumsum(n) - n, wide) + nth
    out = np.zeros((len(left) + 1, sums.shape[1]), sums.dtype)
    out[:-1] = sums[left] + sums[np.where(nth + 1 < np.repeat(n, wide), left + 1, -1)]
    return out, wide


def window_sums(sums: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Sums of WINDOW_BLOCKS rows from each row on, or of ``length`` rows where that is less; missing rows are zero."""
    out = np.zeros((len(length), sums.shape[1]), sums.dtype)
    for r in range(WINDOW_BLOCKS):
        part = sums[r:r + len(out)]
        out[:len(part)] += part
    short = np.flatnonzero(length < WINDOW_BLOCKS)
    out[short] = sums[short]
    for r in range(1, WINDOW_BLOCKS - 1):
        own = short[length[short] > r]
        out[own] += sums[own + r]
    return out


def search(docs: DataFrame, items: Items, basis: np.ndarray, idf: np.ndarray, id_col: str,
           text_col: str) -> DataFrame:
    """(id, hash, item_id, lcs, answer, start, cosine, latent): the best window of each contaminated document and item.

    Of an item of a few words, ``start`` is its first place. ``basis`` and
    ``idf`` end with a zero row.
    """
    spark = docs.sparkSession
    # by scale: its items, and the weight of every word of theirs in those that have it
    tables = {}
    for scale in np.unique(items.scale).tolist():
        own = np.flatnonzero((items.scale == scale) & (items.size >= SHORT_ITEM))
        if len(own):
            kind = np.min_scalar_type(STEPS * WINDOW_BLOCKS * (scale // 2))     # holds the sum of a window
            tables[scale] = own, np.ascontiguousarray(np.where(items.product[:, own] > 0, items.steps[:, None], 0), kind)
    shared = spark.sparkContext.broadcast((items, tables, idf.astype(np.float32)[:, None] * basis))
    src = docs.select(F.col(id_col).alias("id"), text_hash(F.col(text_col)).alias("hash"),
                      F.col(text_col).cast("string").alias("text")).filter("text IS NOT NULL")

    def windows(it, tables, weighted, ids, size):
        """Candidate (document, item, first word, end, cosine) of texts laid end to end."""
        latent = None               # latent sums of blocks, each scale's from those of the one below
        cols = columns(ids)
        rows, nowhere = it.row[cols], len(it.has) - 1
        width = WINDOW_BLOCKS
        for scale, (own, table) in tables.items():
            block = scale // 2
            blocks = -(-size // block)
            first, n_blocks = np.cumsum(blocks) - blocks, int(blocks.sum())
            place = np.arange(len(ids)) + np.repeat(first * block - (np.cumsum(size) - size), size)
            words_of = np.full((n_blocks + width) * block, nowhere, np.int32)
            words_of[place] = rows
            if latent is None:
                flat = np.full(n_blocks * block, COLUMNS, np.int32)     # the row after the last is zero
                flat[place] = cols
                latent, per_text, wide = added(weighted, flat.reshape(-1, block)), blocks, block
            while wide < block:
                (latent, per_text), wide = paired(latent, per_text), 2 * wide
            # a window starts at each block with enough blocks of its text from there, or with all of them
            doc = np.repeat(np.arange(len(blocks)), blocks)
            nth = np.arange(n_blocks) - first[doc]
            length = np.minimum(blocks[doc] - nth, width)
            starts = (length == width) | (nth == 0)
            within = np.arange(width * block)
            from_word = np.lib.stride_tricks.sliding_window_view(words_of, width * block)
            towards, threshold = it.latent[own].T, it.threshold[own].astype(np.float32)
            limit = it.limit[own].astype(table.dtype)
            for s in range(0, n_blocks, WINDOWS):
                e = min(s + WINDOWS, n_blocks)
                z = window_sums(latent[s:e + width - 1], length[s:e])
                z /= np.maximum(np.sqrt(np.einsum("ij,ij->i", z, z)), 1e-12)[:, None]
                cosine = z @ towards
                x = added(table, words_of[s * block:min(e + width - 1, n_blocks) * block].reshape(-1, block))
                x = window_sums(x[:e + width - 1 - s], length[s:e])
                at = np.flatnonzero(((cosine >= threshold) | (x >= limit)) & starts[s:e, None])
                i, which = np.divmod(at, len(own))
                for q in range(0, len(at), CANDIDATES):
                    j, k = i[q:q + CANDIDATES], which[q:q + CANDIDATES]
                    near = cosine[j, k]
                    j, k = j + s, own[k]
                    inside = from_word[j * block]
                    short = np.flatnonzero(length[j] < width)
                    inside[short] = np.where(within < length[j[short], None] * block, inside[short], nowhere)
                    cell = inside * it.has.shape[1] + k[:, None]
                    has = np.take(it.has, cell)
                    kept = np.flatnonzero(it.enough(k, (has & 1).sum(axis=1), (has >> 1).sum(axis=1)))
                    # a word counts as often as the item has it, at most
                    number, whose = np.take(it.nth, cell[kept]), k[kept]
                    most = 1 + int(number.max(initial=0))
                    times = np.bincount((number + most * np.arange(len(kept))[:, None]).ravel(),
                                        minlength=most * len(kept)).reshape(-1, most)
                    kept = kept[it.enough(whose, np.minimum(times, it.in_item[whose, :most]).sum(axis=1),
                                          np.minimum(times, it.in_answer[whose, :most]).sum(axis=1))]
                    j, k = j[kept], k[kept]
                    yield from zip(doc[j].tolist(), k.tolist(), (nth[j] * block).tolist(),
                                   ((nth[j] + length[j]) * block).tolist(), near[kept].tolist())

    def verbatim(it, ids, size):
        """(document, item, first word) of the first place of each item of a few words."""
        last = np.cumsum(size)
        for k in np.flatnonzero(it.size < SHORT_ITEM).tolist():
            w = it.words[k]
            at = np.flatnonzero(ids[:len(ids) - len(w) + 1] == w[0]) if len(ids) >= len(w) else np.empty(0, np.int64)
            for j, x in enumerate(w[1:], 1):
                at = at[ids[at + j] == x]
            d = np.searchsorted(last, at, side="right")
            at, d = at[at + len(w) <= last[d]], d[at + len(w) <= last[d]]
            d, one = np.unique(d, return_index=True)
            yield from zip(d.tolist(), [k] * len(d), (at[one] - (last - size)[d]).tolist())

    def run(batches):
        it, tables, weighted = shared.value
        for b in batches:
            rows = []
            for at, ids, size in batch_words(b.column(2)):
                first = np.cumsum(size) - size
                best = {(d, k): (1.0, 1.0, -at_word) for d, k, at_word in verbatim(it, ids, size)}
                nearest: dict[tuple[int, int], float] = {}
                for d, k, lo, hi, cosine in windows(it, tables, weighted, ids, size):
                    seq = ids[first[d] + lo:first[d] + min(hi, size[d])].tolist()
                    hit, lcs, answer = judge(it, k, seq)
                    if hit:
                        nearest[d, k] = max(cosine, nearest.get((d, k), -1.0))
                        if (lcs, answer, -lo) > best.get((d, k), (-1.0, 0.0, 0)):
                            best[d, k] = (lcs, answer, -lo)
                rows += [(at + d, it.ids[k], v[0], v[1], -v[2], near := nearest.get((d, k)),
                          near is not None and near >= it.threshold[k]) for (d, k), v in sorted(best.items())]
            if rows:
                cols = list(zip(*rows))
                own = pa.array(cols[0])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(own), b.column(1).take(own), pa.array(cols[1], pa.int64()), pa.array(cols[2]),
                     pa.array(cols[3]), pa.array(cols[4], pa.int64()), pa.array(cols[5], pa.float64()),
                     pa.array([bool(x) for x in cols[6]])],
                    ["id", "hash", "item_id", "lcs", "answer", "start", "cosine", "latent"])

    return src.mapInArrow(run, found_schema(docs, id_col))


def found_schema(docs: DataFrame, id_col: str) -> str:
    kind = docs.schema[id_col].dataType.simpleString()
    return (f"id {kind}, hash long, item_id long, lcs double, answer double, start long, cosine double, "
            "latent boolean")


def latent_space(docs: DataFrame, named: DataFrame, n_items: int, passages: int, idf: np.ndarray, text_col: str,
                 rank: int = RANK, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(basis, columns of words as frequent as in the documents): the space of all passages and all items."""
    packed = word_columns(docs.select(F.col(text_col).alias("text"), F.lit(1.0).alias("weight")))
    return packed_space(packed, named, n_items, passages, idf, rank, seed)


def packed_space(packed: DataFrame, named: DataFrame, n_items: int, passages: int, idf: np.ndarray, rank: int = RANK,
                 seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """``latent_space`` of documents as (words, weight)."""
    weight = 2 * float(np.sqrt(max(1, passages) / n_items))     # items outweigh the words of single topics
    texts = packed.unionByName(word_columns(named.select("text", F.lit(weight).alias("weight"))))
    return latent_basis(texts, idf, rank, seed, passages), filler_words(idf, seed)


def filler_words(idf: np.ndarray, seed: int = 1) -> np.ndarray:
    """FILLER_WORDS columns in no order, each as often as its share of the document frequencies says."""
    share = np.cumsum(np.expm1(idf.max() - idf))        # in proportion to the frequency above the least
    if not share[-1] > 0:
        return np.array([COLUMNS], np.int64)
    at = np.searchsorted(share, (np.arange(FILLER_WORDS) + 0.5) / FILLER_WORDS * share[-1])
    return np.random.default_rng(seed).permutation(at)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text", rank: int = RANK,
                 seed: int = 1) -> DataFrame:
    """(id, hash, item_id, lcs, answer, start, cosine, latent): pairs of a document and a benchmark item found in it.

    ``hash`` is the text's 64-bit hash, which tells rows of a repeated id
    apart; repeated rows are reported one by one. ``cosine`` is the largest of
    the pair's accepted windows in the latent space (null if only looked up
    word for word), ``latent`` whether it reached the item's threshold. Null
    and wordless texts and items match nothing; a null id is reported as
    such. Equal items are reported each. Empty tables give no rows.
    """
    importable(docs.sparkSession)
    spark = docs.sparkSession
    named = benchmark.select(F.col(item_col).cast("long").alias("item_id"),
                             F.col(item_text_col).cast("string").alias("text")).filter("text IS NOT NULL")
    n_items = named.count()
    if not n_items:
        return spark.createDataFrame([], found_schema(docs, id_col))
    packed = store(word_columns(docs.select(F.col(text_col).alias("text"), F.lit(1.0).alias("weight"))), "words")
    n_docs, passages, df = column_frequencies(packed)
    idf = np.log((n_docs + 1) / (df + 1)) + 0.01
    basis, filler = packed_space(packed, named, n_items, passages, idf, rank, seed)
    basis, idf = np.vstack([basis, np.zeros_like(basis[:1])]), np.append(idf, 0.0)
    found = None
    parts = max(1, -(-n_items // ITEM_BLOCK))
    for k in range(parts):      # the benchmark is the stated query set; a part of it is held at a time
        rows = [(r["item_id"], r["text"]) for r in named.filter(
            F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).collect()]
        rows = sorted(rows, key=lambda r: (r[0] is None, r[0], r[1]))
        for s in range(0, len(rows), ITEM_BLOCK):
            hits = search(docs, Items(rows[s:s + ITEM_BLOCK], basis, idf, filler), basis, idf, id_col, text_col)
            hits = hits if parts == 1 else store(hits, f"found{k}-{s}")
            found = hits if found is None else found.unionByName(hits)
    return found
