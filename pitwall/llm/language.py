"""Language identification by a string kernel (operator 6).

The kernel of two texts is the cosine of their presence vectors over blended
character n-grams (orders 1 to 3 of the lower-cased letters, everything else
one blank), hashed to a fixed number of columns per order. One-versus-rest
kernel ridge regression is fitted on Nystroem landmarks; as the kernel is
linear in the presence vectors, landmarks and coefficients fold into one
matrix and a batch of texts is scored by one matrix product.

Only the fit uses a sample: at most SAMPLE labelled rows, equally many per
language at most, chosen by a seeded hash. Every text is scored, whole.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitwall.llm.common import importable

ORDERS = (1, 2, 3)
COLUMN_BITS = 14
COLUMNS = 1 << COLUMN_BITS
WIDTH = len(ORDERS) * COLUMNS
SAMPLE = 4000
LANDMARKS = 256
RIDGE = 1e-2
BATCH = 64
COLUMNS_AT_ONCE = 4096
UNKNOWN = "und"
HAS_LETTER = re.compile(r"[^\W\d_]")


@cache
def letters() -> np.ndarray:
    """For each code point, itself if a letter, else a blank."""
    return np.fromiter((i if chr(i).isalpha() else 32 for i in range(0x110000)), np.uint32, 0x110000)


def ngram_columns(text: str) -> np.ndarray:
    """Columns of all n-grams of a text, with repeats."""
    raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    c = letters()[raw]
    c = c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])] if len(c) else c
    c = c.astype(np.uint64)
    out, code = [], np.zeros(len(c), np.uint64)
    for k, n in enumerate(ORDERS):
        if len(c) < n:
            break
        code = (code[:len(c) - n + 1] << np.uint64(21)) | c[n - 1:]
        h = (code + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        out.append(((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - COLUMN_BITS)).astype(np.int64) + k * COLUMNS)
    return np.concatenate(out) if out else np.empty(0, np.int64)


def presence(texts: list[str]) -> np.ndarray:
    x = np.zeros((len(texts), WIDTH), np.float32)
    for i, t in enumerate(texts):
        x[i, ngram_columns(t)] = 1
    return x


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt(x.sum(axis=1, keepdims=True)), 1)   # presence vectors: squared norm = sum


def fit(packed: list[bytes], labels: list[str], landmarks: int, ridge: float) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, WIDTH x languages matrix, intercepts) from packed presence rows."""
    names = sorted(set(labels))
    y = np.where(np.array(labels)[:, None] == np.array(names), 1.0, -1.0)

    def rows(idx) -> np.ndarray:
        x = np.empty((len(idx), WIDTH), np.float32)
        for at, i in enumerate(idx):
            x[at] = np.unpackbits(np.frombuffer(packed[i], np.uint8))
            x[at] /= max(1.0, np.sqrt(x[at].sum()))
        return x

    share = max(1, landmarks // len(names))
    where = np.array(labels)
    marks = np.concatenate([np.flatnonzero(where == n)[:share] for n in names])
    z = rows(marks)
    values, vectors = np.linalg.eigh((z @ z.T).astype(np.float64))
    keep = values > values[-1] * 1e-8
    root = vectors[:, keep] / np.sqrt(values[keep])
    phi = np.concatenate([(rows(range(s, min(s + 64, len(labels)))) @ z.T) @ root for s in range(0, len(labels), 64)])
    mean, y_mean = phi.mean(axis=0), y.mean(axis=0)
    centred = phi - mean
    beta = np.linalg.solve(centred.T @ centred + ridge * len(labels) * np.eye(phi.shape[1]), centred.T @ (y - y_mean))
    alpha = root @ beta
    matrix = np.empty((WIDTH, len(names)), np.float32)
    for s in range(0, WIDTH, COLUMNS_AT_ONCE):      # widened to doubles by parts
        matrix[s:s + COLUMNS_AT_ONCE] = z[:, s:s + COLUMNS_AT_ONCE].T @ alpha
    return names, matrix, y_mean - mean @ beta


def held_out(id_col: str):
    """True for the fifth of documents that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, text_col: str, lang_col: str, may_learn, id_col: str = "doc_id", seed: int = 6,
          sample: int = SAMPLE, landmarks: int = LANDMARKS, ridge: float = RIDGE):
    """(languages, matrix, intercepts) learned from at most ``sample`` rows that ``may_learn`` allows.

    Rows are chosen by a seeded hash of id and text. The hash first thins each
    language to about twice its share, so that few texts are moved.
    """
    importable(docs.sparkSession)
    labelled = docs.filter(may_learn & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"),
        F.xxhash64(F.lit(seed), id_col, text_col).alias("h"))
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}   # one row per language
    if not counts:
        return [], np.zeros((WIDTH, 0), np.float32), np.zeros(0)
    each = max(1, sample // len(counts))
    shares = [x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, 2 * each / n)))]
    thinned = labelled.filter(F.pmod("h", F.lit(1 << 30)) < F.create_map(*shares)[F.col("lang")] * (1 << 30))
    order = Window.partitionBy("lang").orderBy("h", "text")
    chosen = (thinned.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= each)
              .select("lang", "text").limit(sample))

    def pack(batches):
        for b in batches:
            bits = [np.packbits(presence([t]).astype(bool)).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bits, pa.binary())], ["lang", "bits"])

    got = sorted((r["lang"], bytes(r["bits"])) for r in chosen.mapInArrow(pack, "lang string, bits binary").collect())
    rng = np.random.default_rng(seed).permutation(len(got))
    return fit([got[i][1] for i in rng], [got[i][0] for i in rng], landmarks, ridge)


def identify(docs: DataFrame, model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",),
             names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Columns ``keep`` plus the language and its score (0 to 1) as ``names``, one row per input row.

    A text that is null or has no letter is ``und`` with score 0, as is every
    text if there was nothing to learn from. Ties go to the first language by
    name. Long texts are scored whole; repeated rows one by one.
    """
    importable(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)],
                      F.col(text_col).cast("string").alias("text"))

    def run(batches):
        known, m, bias = shared.value
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            real = [i for i, t in enumerate(texts) if t is not None and known and HAS_LETTER.search(t)]
            pred, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            for s in range(0, len(real), BATCH):
                part = real[s:s + BATCH]
                x = presence([texts[i] for i in part])
                norm = np.maximum(np.sqrt(x.sum(axis=1, keepdims=True)), 1)
                y = (x @ m) / norm + bias
                best = y.argmax(axis=1)
                for i, k, v in zip(part, best, y.max(axis=1)):
                    pred[i], score[i] = known[k], (np.clip(v, -1, 1) + 1) / 2
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(pred, pa.string()), pa.array(score)],
                                             [*b.schema.names[:-1], "lang_pred", "score"])

    kept = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in src.schema.fields[:-1])
    return src.mapInArrow(run, f"{kept}lang_pred string, score double").toDF(*keep, *names)
