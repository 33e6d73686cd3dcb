"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import uuid
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitwall.session import checkpoint_dir

# ASCII blanks are the word separators everywhere in this package:
# bytes.split() splits on exactly this set.
WORD = r"[^\x20\x09-\x0D]+"


def importable(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package wherever the driver was started.

    On a cluster the package is installed or sent along (``--py-files``).
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as parquet in the shared checkpoint folder and read it back."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/llm-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks_for(spark: SparkSession, factor: int = 1) -> int:
    """Number of partitions for an explicit repartition (the session's own setting)."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) * factor)


def as_bytes(column: pa.Array) -> list:
    """String column as a list of UTF-8 ``bytes`` (None for null), without decoding."""
    if pa.types.is_string(column.type):
        return column.cast(pa.binary()).to_pylist()
    return column.cast(pa.large_binary()).to_pylist()


def text_hash(col):
    """64-bit content hash that tells repeated ids with different texts apart (null: 0)."""
    return F.coalesce(F.xxhash64(col), F.lit(0).cast("long"))


BLANKS = bytes([9, 10, 11, 12, 13, 32])
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
AT_ONCE = 1 << 14               # values summed at a time, so that they stay in the processor's cache


@cache
def powers(base: int, bits: int) -> np.ndarray:
    """base ** 0, 1, ... modulo 2 ** 64, for 2 ** bits places."""
    out = np.full(1 << bits, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of each number spread over all 64 (SplitMix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each stretch ``values[start:end]``, from one running sum over all values."""
    bits = max(16, int(len(values)).bit_length())
    total, power = np.zeros(len(values) + 1, np.uint64), powers(BASE, bits)[:len(values)]
    for s in range(0, len(values), AT_ONCE):
        part = values[s:s + AT_ONCE] * power[s:s + AT_ONCE]
        part[:1] += total[s]
        np.cumsum(part, out=total[s + 1:s + 1 + len(part)])
    return mixed((total[ends] - total[starts]) * powers(INVERSE, bits)[starts]
                 + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


@cache
def byte_tables(separators: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(random value of each byte, which bytes are separators)."""
    values = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
    apart = np.zeros(256, bool)
    apart[list(separators)] = True
    return values, apart


def word_hashes(texts: list[bytes], separators: bytes = BLANKS) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of all texts, words per text); a word is a run of bytes without separators."""
    text = b" ".join(texts) + b" "
    joined = np.frombuffer(text, np.uint8)
    values, apart = byte_tables(separators)
    gap = np.frombuffer(text.translate(apart.tobytes()), bool)
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if len(joined) and not gap[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[::2], edge[1::2]
    last = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    counts = np.diff(np.searchsorted(starts, last), prepend=0)
    return range_hashes(values[joined], starts, ends), counts


def pieces(column: pa.Array, most_bytes: int = 1 << 20):
    """(first row, texts as bytes) of a string column, in runs of about ``most_bytes``; null is empty."""
    at, size, part = 0, 0, []
    for s in range(0, len(column), 256):
        for t in as_bytes(column.slice(s, 256)):
            part.append(t or b"")
            size += len(part[-1])
            if size >= most_bytes:
                yield at, part
                at, size, part = at + len(part), 0, []
    if part:
        yield at, part
