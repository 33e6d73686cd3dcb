"""Phrase collocations against counting in plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from llm_helpers import SF_SMALL, edge_docs, edge_rows, no_docs  # noqa: F401
from pitwall.llm import phrases

NAMES = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def brute(docs, most=3, least=10, share=50, top=2000):
    """Collocations of (lang, text) rows."""
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, most + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    often = {key: c for key, c in f.items() if c >= least}
    covered = Counter()
    for (lang, w), c in often.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                covered[lang, w[i:i + k]] = max(covered[lang, w[i:i + k]], c)
    out = []
    for (lang, w), a in often.items():
        if len(w) > 1 and not (covered[lang, w] and 100 * covered[lang, w] >= share * a):
            score, k = min((10 ** 6 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
            out.append((lang, -score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    ranks, rows = Counter(), []
    for lang, score, a, phrase, left, right in sorted(out):
        ranks[lang] += 1
        if ranks[lang] <= top:
            rows.append((lang, ranks[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(rows)


def got(df, **options):
    return sorted(tuple(r[c] for c in NAMES) for r in phrases.collocations(df, **options).collect())


def test_collocations_of_documents(spark):
    table = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    want = brute([(r["lang"], r["text"]) for r in table.collect()])
    assert want and got(table) == want
    assert got(table.repartition(7)) == want                    # other blocks


@pytest.mark.parametrize("options", [{}, {"most_words": 4, "least": 3}, {"most_words": 2, "least": 2, "top": 5}])
def test_collocations_of_few_words(spark, options):
    """Few words give many ties, overlaps and nested phrases."""
    rng = random.Random(3)
    words = ["a", "b", "A", "c.", "d,", "é", "É", "\U0001F600", "\t", "x\ny", ";", "a a"]
    docs = [(rng.choice(["en", None, "und"]), " ".join(rng.choices(words, k=rng.randrange(60)))) for _ in range(300)]
    names = {"most_words": "most", "least": "least", "top": "top"}
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "lang string, text string, block string, at int")
    assert got(df.repartition(5), **options) == brute(docs, **{names[k]: v for k, v in options.items()})


def test_collocation_edges(spark, edge_docs, edge_rows, no_docs):
    assert got(no_docs) == []
    assert got(edge_docs) == brute([(r[2], r[1]) for r in edge_rows])
    blank = spark.createDataFrame([(None, None), ("en", ""), ("en", " \t.\n")], "lang string, text string")
    assert got(blank) == []
    repeated = [("en", "Same words again")] * 30
    assert got(spark.createDataFrame(repeated, "lang string, text string")) == brute(repeated)


def test_long_texts_are_cut_between_pieces():
    text = b"word " * 2_000_000 + b". tail of it, " * 100_000
    parts = list(phrases.text_parts(text))
    assert b"".join(parts) == text and len(parts) > 1
    assert all(p[:1] in (b".", b",") for p in parts[1:])        # the first piece is longer than a part
    assert list(phrases.text_parts(b"")) == [b""]


def test_places_and_merge_join():
    at = np.array([1, 2, 3, 6, 7, 9])
    assert phrases.unpack_places(phrases.pack_places(at)).tolist() == at.tolist()
    i, j = phrases.adjacent(at, at, 1)
    assert at[i].tolist() == [1, 2, 6] and at[j].tolist() == [2, 3, 7]
    i, j = phrases.adjacent(at, at, 2)
    assert at[i].tolist() == [1, 7] and at[j].tolist() == [3, 9]


def test_scores_are_exact(spark):
    """Products beyond 64 bits: the score of counts near 10 ** 12."""
    df = spark.createDataFrame([(10 ** 12 + 7, 10 ** 12 + 11, 10 ** 12 + 13)], "a long, l long, r long")
    assert df.select(phrases.cut_score("a", "l", "r")).first()[0] == 10 ** 6 * (10 ** 12 + 7) ** 2 // (
        (10 ** 12 + 11) * (10 ** 12 + 13))
