"""Brute-force versions of the training-data operators (plain Python over small tables)."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest
import xxhash

SF_SMALL = "/root/testdata/sf0.001"

WORD = re.compile(r"[^\x20\x09-\x0D]+")


class Union(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self[max(a, b)] = min(a, b)


def words(text):
    return WORD.findall(text or "")


def simhash(text, k=3):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << i for i in range(64) if sum(x >> i & 1 for x in h) * 2 > len(h))


def repeated_words(docs, window=50):
    """{(row): removed word positions}; docs is a list of (id, text)."""
    least = {}
    for i, text in docs:
        w = words(text)
        for s in range(len(w) - window + 1):
            t = tuple(w[s:s + window])
            if i is not None:
                least[t] = min(least.get(t, i), i)
    out = []
    for i, text in docs:
        w, gone = words(text), set()
        for s in range(len(w) - window + 1):
            if i is not None and least[tuple(w[s:s + window])] < i:
                gone.update(range(s, s + window))
        out.append(gone)
    return out


def cosine_components(vectors, threshold=0.95):
    """[(links, component)] of (id, vector) rows; unusable vectors link with nothing."""
    ok = [i for i, (_, v) in enumerate(vectors) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    uf, links = Union(), Counter()
    for a in ok:
        for b in ok:
            x, y = np.array(vectors[a][1], float), np.array(vectors[b][1], float)
            if a < b and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                uf.join(a, b)
                links[a] += 1
                links[b] += 1
    group = {i: uf.find(i) if i in ok else i for i in range(len(vectors))}
    return [(links[i], min((vectors[j][0] for j in group if group[j] == group[i] and vectors[j][0] is not None),
                           default=None)) for i in range(len(vectors))]


def water_filling(sizes, weights=(5, 2, 1), cap=3):
    """Targets per source: shares by weight, stopped at ``cap`` times the size, the excess reshared."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    fixed, free, total = {}, set(order), sum(sizes.values())
    while free:
        level = (total - sum(fixed.values())) / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > cap * sizes[s]}
        if not over:
            return fixed | {s: level * w[s] for s in free}
        fixed |= {s: float(cap * sizes[s]) for s in over}
        free -= over
    return fixed


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.I | re.A)
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")


def base_spans(text):
    t = text or ""
    s = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    s += [(m.start(), 1, m.end()) for m in ACCESS.finditer(t) if len(m[0]) >= 20]
    s += [(m.start(), 2, m.end()) for m in HEX.finditer(t) if len(m[0]) >= 24]
    return [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(s)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, id long, hash string"
PASSAGE = " ".join(f"passage{i}" for i in range(60))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows and clashing column names."""
    long_text = " ".join(f"w{i % 997}" for i in range(60000)) + "\nlast line of it"
    rows = [
        (1, "alpha beta gamma", "en", "a", 16, "x", 7, "h"),
        (2, None, "en", "a", None, None, None, None),
        (3, "", None, None, 0, "", 0, ""),
        (4, "   \t\n \r\n", "de", "b", 8, "y", 1, "z"),
        (5, long_text, "en", "a", len(long_text), "x", 7, "h"),
        (6, long_text, "en", "c", len(long_text), "x", 7, "h"),
        (7, f"start {PASSAGE} end", "fr", "a", 1, "x", 7, "h"),
        (8, f"other\n{PASSAGE}\nmore words here", "fr", "b", 1, "x", 7, "h"),
        (8, f"other\n{PASSAGE}\nmore words here", "fr", "b", 1, "x", 7, "h"),
        (8, "same id and another text", "fr", "b", 1, "x", 7, "h"),
        (None, f"no id {PASSAGE}", None, None, None, None, None, None),
        (None, None, None, None, None, None, None, None),
        (9, "123 456 !!! ???", "es", "b", 1, "x", 7, "h"),
        (10, "ALPHA beta gamma", "en", "a", 16, "x", 7, "h"),
        (11, "été à la plage \U0001F600 token=abcdef123456", "fr", "d", 1, "x", 7, "h"),
    ]
    return rows


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
