"""Main-text extraction by a linear-chain conditional random field over DOM leaf blocks (operator 11).

A page is the sequence of its leaf blocks; each is labelled main text or not.
Weights of block features (ancestor tags, names in class, id and role, text
shape) and of transitions (by whether two blocks have the same parent) are
fitted by maximum likelihood on labelled pages; pages are decoded by Viterbi.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from pitwall.llm.common import importable, tasks_for
from pitwall.llm.html_blocks import Block, leaf_blocks
from pitwall.llm.labelled_pages import labelled_page

COLUMNS = 1 << 13       # hashed feature columns
MOST_PAGES = 800        # labelled pages that the weights are fitted on
ROUNDS = 90             # steps of gradient ascent
DECAY = 3e-6            # squared-weight penalty per block
END_MARKS = ".!?…。"


@dataclass
class Model:
    """Weights: per column and label, per (same parent, label, label), and of the first label."""

    block: np.ndarray       # COLUMNS x 2
    step: np.ndarray        # 2 x 2 x 2
    first: np.ndarray       # 2


def column(name: str) -> int:
    return zlib.crc32(name.encode()) % COLUMNS


def scale(n: float) -> int:
    """Size class of a count."""
    return min(12, int(math.log2(n + 1) * 1.5))


def shape(block: Block) -> list[str]:
    text, n = block.text, len(block.text)
    words = text.count(" ") + 1
    letters = sum(map(str.isalpha, text[:400])) / min(n, 400)
    return [f"len {scale(words)}", f"link {math.ceil(4 * min(1, block.linked / n))}", f"ends {text[-1] in END_MARKS}",
            f"stops {min(3, sum(text.count(c) for c in '.!?'))}", f"commas {min(2, text.count(','))}",
            f"letters {int(letters * 4)}", f"upper {text[:1].isupper()}", f"mark {text[0] in '©®™'}",
            f"bar {'|' in text or '»' in text or '·' in text}"]


def features(blocks: list[Block]) -> list[list[int]]:
    """Columns of each block's features."""
    shapes = [shape(b) for b in blocks]
    out = []
    for k, b in enumerate(blocks):
        names = {f"in {t}" for t, _ in b.path} | {f"name {w}" for _, words in b.path for w in words}
        outer = [(t, words) for t, words in b.path if t not in ("html", "body")]
        for back, (t, words) in enumerate(outer[::-1][:3]):
            names.add(f"up{back} {t}")
            names.update(f"up{back} name {w}" for w in words)
        names.add("path " + "/".join(t for t, _ in outer[-2:]))
        names.update(shapes[k])
        names.add(f"{shapes[k][0]} {shapes[k][1]} {shapes[k][2]}")
        for at in (k - 1, k + 1):
            near = shapes[at][:3] if 0 <= at < len(blocks) else ["none"]
            names.update(f"{at - k} {s}" for s in near)
        out.append(sorted({column(n) for n in names}))
    return out


def same_parent(blocks: list[Block]) -> np.ndarray:
    return np.array([0, *(int(a.owner == b.owner) for a, b in zip(blocks, blocks[1:]))])


def label_blocks(blocks: list[Block], main_text: str) -> np.ndarray:
    """1 for the blocks that make up ``main_text`` (joined by two line feeds), found in page order from the last."""
    there = {b.text for b in blocks}
    wanted = [t for t in main_text.split("\n\n") if t in there] if main_text else []
    out = np.zeros(len(blocks), int)
    for k in range(len(blocks) - 1, -1, -1):
        if wanted and blocks[k].text == wanted[-1]:
            out[k] = 1
            wanted.pop()
    return out


def log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis))


def forward_backward(scores: np.ndarray, same: np.ndarray, step: np.ndarray, first: np.ndarray):
    """(log of the sum over all labellings, block marginals n x 2, transition marginals n x 2 x 2)."""
    n = len(scores)
    ahead, back = np.zeros((n, 2)), np.zeros((n, 2))
    ahead[0] = first + scores[0]
    for k in range(1, n):
        ahead[k] = log_sum(ahead[k - 1][:, None] + step[same[k]], 0) + scores[k]
    for k in range(n - 2, -1, -1):
        back[k] = log_sum(step[same[k + 1]] + (scores[k + 1] + back[k + 1])[None], 1)
    total = log_sum(ahead[-1], 0)
    pairs = np.zeros((n, 2, 2))
    for k in range(1, n):
        pairs[k] = np.exp(ahead[k - 1][:, None] + step[same[k]] + (scores[k] + back[k])[None] - total)
    return total, np.exp(ahead + back - total), pairs


def viterbi(scores: np.ndarray, same: np.ndarray, step: np.ndarray, first: np.ndarray) -> list[int]:
    """The likeliest labelling (ties: label 0, not main)."""
    best, came = first + scores[0], []
    for k in range(1, len(scores)):
        ways = best[:, None] + step[same[k]]
        came.append(ways.argmax(0))
        best = ways.max(0) + scores[k]
    out = [int(best.argmax())]
    for c in reversed(came):
        out.append(int(c[out[-1]]))
    return out[::-1]


class Batch:
    """Labelled pages padded to one length, so that all move through time together."""

    def __init__(self, pages: list[tuple[list[list[int]], np.ndarray, np.ndarray]]):
        pages = sorted(pages, key=lambda p: len(p[1]))
        self.size = np.array([len(p[1]) for p in pages])
        self.most = int(self.size.max())
        self.live = np.arange(self.most)[None] < self.size[:, None]
        self.ended = (~self.live).sum(0)            # pages shorter than each place
        self.same = np.zeros((len(pages), self.most), int)
        self.label = np.zeros((len(pages), self.most), int)
        for i, (_, same, label) in enumerate(pages):
            self.same[i, :len(same)] = same
            self.label[i, :len(label)] = label
        rows = [c for p in pages for c in p[0]]
        self.columns = np.concatenate(rows)
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.rows = len(rows)

    def gradient(self, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the log likelihood: observed less expected counts."""
        n = len(self.size)
        flat = np.stack([np.bincount(self.row, model.block[self.columns, y], self.rows) for y in (0, 1)], 1)
        scores = np.zeros((n, self.most, 2))
        scores[self.live] = flat
        step = model.step[self.same]
        ahead, back = np.zeros((n, self.most, 2)), np.zeros((n, self.most, 2))
        ahead[:, 0] = model.first + scores[:, 0]
        for k in range(1, self.most):           # pages are in order of length: the first ones have ended
            on = self.ended[k]
            ahead[:on, k] = ahead[:on, k - 1]
            ways = ahead[on:, k - 1, :, None] + step[on:, k]
            ahead[on:, k] = np.logaddexp(ways[:, 0], ways[:, 1]) + scores[on:, k]
        for k in range(self.most - 2, -1, -1):
            on = self.ended[k + 1]
            ways = step[on:, k + 1] + (scores[on:, k + 1] + back[on:, k + 1])[:, None]
            back[on:, k] = np.logaddexp(ways[..., 0], ways[..., 1])
        total = log_sum(ahead[:, -1], 1)
        marginal = np.exp(ahead + back - total[:, None, None]) * self.live[..., None]
        observed = np.eye(2)[self.label] * self.live[..., None]
        over = (observed - marginal)[self.live]
        block = np.stack([np.bincount(self.columns, over[self.row, y], COLUMNS) for y in (0, 1)], 1)
        pairs = np.exp(ahead[:, :-1, :, None] + step[:, 1:] + (scores[:, 1:] + back[:, 1:])[:, :, None]
                       - total[:, None, None, None]) * self.live[:, 1:, None, None]
        seen = np.eye(2)[self.label[:, :-1]][..., None] * np.eye(2)[self.label[:, 1:]][:, :, None] * self.live[:, 1:, None, None]
        steps = np.stack([((seen - pairs) * (self.same[:, 1:, None, None] == s)).sum((0, 1)) for s in (0, 1)])
        return block, steps, (observed - marginal)[:, 0].sum(0)


def fit(pages: list[tuple[str, str]]) -> Model:
    """Weights of (html, main text) pages by gradient ascent with a step size per weight (Adam)."""
    seen = [(features(b), same_parent(b), label_blocks(b, text)) for b, text in
            ((leaf_blocks(page or ""), text or "") for page, text in pages) if b]
    model = Model(np.zeros((COLUMNS, 2)), np.zeros((2, 2, 2)), np.zeros(2))
    if not seen:
        return model
    batch = Batch(seen)
    weights = [model.block, model.step, model.first]
    mean, square = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for k in range(1, ROUNDS + 1):
        rate = 0.1 * min(1, 2 * (1 - k / (ROUNDS + 1)))
        for w, m, s, g in zip(weights, mean, square, batch.gradient(model)):
            g = g / batch.rows - DECAY * w
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            w += rate * (m / (1 - 0.9 ** k)) / (np.sqrt(s / (1 - 0.99 ** k)) + 1e-7)
    return model


def train(labelled: DataFrame, html_col: str = "html", text_col: str = "text", most_pages: int = MOST_PAGES) -> Model:
    """Fit on at most ``most_pages`` labelled pages (a bound on the driver's memory), the first by hash of their html."""
    rows = (labelled.select(F.col(html_col).alias("h"), F.col(text_col).alias("t"))
            .orderBy(F.xxhash64("h"), "h", "t").limit(most_pages).collect())
    return fit([(r["h"], r["t"]) for r in rows])


def made_pages(spark: SparkSession, n: int = MOST_PAGES) -> DataFrame:
    """(html, text): ``n`` seeded labelled pages of many layouts."""
    importable(spark)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = [labelled_page(seed) for seed in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"html": [p[0] for p in pages], "text": [p[1] for p in pages]})

    return spark.range(0, n, 1, tasks_for(spark)).mapInArrow(make, "html string, text string")


def main_text(page: str, model: Model) -> str:
    """The blocks labelled main text, in page order, joined by two line feeds (none: empty)."""
    blocks = leaf_blocks(page)
    if not blocks:
        return ""
    scores = np.stack([model.block[c].sum(0) for c in features(blocks)])
    labels = viterbi(scores, same_parent(blocks), model.step, model.first)
    return "\n\n".join(b.text for b, y in zip(blocks, labels) if y)


def extract(pages: DataFrame, model: Model, html_col: str = "html", out: str = "main_text") -> DataFrame:
    """``pages`` with the main text of each page's whole html as column ``out``.

    A null or empty html, and a page without text, give an empty text. All other columns pass through, whatever
    their names but ``out``; repeated rows stay. The model is a fixed number of weights sent with the tasks.
    """
    if out in pages.columns:
        raise ValueError(f"the input has a column {out}")
    spark = pages.sparkSession
    importable(spark)
    at = pages.columns.index(html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 64):
                part = batch.slice(s, 64)
                texts = [main_text(h or "", model) for h in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())],
                                                 names=[*part.schema.names, out])

    return pages.mapInArrow(run, StructType([*pages.schema.fields, StructField(out, StringType())]))
