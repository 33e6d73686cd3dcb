"""Shared lines that are common in the corpus are deleted like rare ones."""

from collections import Counter

import numpy as np
import pytest

from llm_helpers import SF_SMALL
from pitwall.llm import lines


def test_common_passage_names_its_holder(spark):
    """A licence of many documents goes also from a document that shares rarer lines with another one."""
    licence = [f"licence {k}" for k in range(5)]
    rare = [f"rare {k}" for k in range(10)]
    docs = [(1, "\n".join(["first", *licence])), (2, "\n".join(["second", *rare, "end"])),
            (3, "\n".join(["own a", *rare, "own b", *licence, "own c"]))]
    docs += [(i, "\n".join([f"text {i}", *licence, f"more {i}"])) for i in range(4, 30)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["kept"] for r in lines.drop_common_lines(df).collect()}
    assert got[1] == docs[0][1] and got[2] == docs[1][1]
    assert got[3] == "own a\nown b\nown c"
    assert all(got[i] == f"text {i}\nmore {i}" for i in range(4, 30))


def every_holder(docs):
    """What each text keeps if it is aligned with the earliest holder of each of its shared lines."""
    hold, shared, out = {}, Counter(), {}
    for i, t in docs:
        for x in set(filter(str.strip, t.split("\n"))):
            hold.setdefault(x, i)
            shared[x] += 1
    code = {x: k for k, x in enumerate(hold, 1)}
    text = dict(docs)
    enc = lambda t: [code.get(x, 0) for x in t.split("\n")]
    for i, t in docs:
        gone = set()
        for p in {hold[x] for x in filter(str.strip, t.split("\n")) if shared[x] > 1} - {i}:
            for a, b in lines.patience_blocks(enc(text[p]), enc(t)):
                gone.update(range(a, b))
        out[i] = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
    return out


def test_line_dedup_against_every_holder(spark):
    table = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    first = {}
    for r in sorted(table.filter("text <> ''").collect(), key=lambda r: r["doc_id"]):
        first.setdefault(r["text"], r["doc_id"])
    want = every_holder([(i, t) for t, i in first.items()])
    got = {r["doc_id"]: r["kept"] for r in lines.drop_common_lines(table).collect()}
    assert {i: got[i] for i in want} == want


def test_repeated_lines_without_anchors():
    """Lines that repeat inside a document are aligned too."""
    assert lines.patience_blocks([1, 5, 5, 2], [3, 5, 5, 4]) == [(1, 3)]
    assert lines.patience_blocks([1, 5, 6, 5, 6, 2], [3, 5, 6, 7, 5, 6, 4]) == [(1, 3), (4, 6)]
    assert lines.patience_blocks([1, 5, 0, 5, 2], [3, 5, 0, 5, 4]) == [(1, 4)]
    assert lines.patience_blocks([1, 0, 0, 2], [3, 0, 0, 4]) == []


@pytest.mark.parametrize("seed", range(30))
def test_common_order_is_longest(seed):
    rng = np.random.default_rng(seed)
    a, b = (rng.integers(0, 5, rng.integers(0, 40)).tolist() for _ in range(2))
    got = lines.common_order(a, b)
    assert all(a[i] == b[j] != lines.BLANK for i, j in got)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = (best[i][j] + 1 if x == y != lines.BLANK
                                  else max(best[i][j + 1], best[i + 1][j]))
    assert len(got) == best[-1][-1]
