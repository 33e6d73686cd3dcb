"""Every pipeline stage by itself, on planted cases and edge rows."""

import os
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as P
import llm_helpers as H
from llm_helpers import SF_SMALL, edge_docs, edge_rows, no_docs  # noqa: F401  fixtures


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet")


def ids(df):
    return Counter(r["doc_id"] for r in df.select("doc_id").collect())


def test_names_and_order():
    assert len(P.STAGES) == 5 and all(callable(f) for _, f in P.STAGES) and P.ORACLE_SQL is None


def test_language_stage(spark, docs, edge_docs, edge_rows):
    assert ids(P.language_stage(spark, docs, SF_SMALL)) == ids(docs)
    got = P.language_stage(spark, edge_docs, SF_SMALL)
    assert got.columns == edge_docs.columns
    want = Counter(r[0] for r in edge_rows if r[1] and any(c.isalpha() for c in r[1]))
    assert ids(got) == want


def test_near_duplicate_stage(spark, docs, edge_docs, edge_rows):
    rows = [(r["doc_id"], H.simhash(r["text"])) for r in docs.collect()]
    uf = H.Union()
    for i, a in rows:
        for j, b in rows:
            if j < i and (a ^ b).bit_count() <= 2:
                uf.join(i, j)
    assert ids(P.near_duplicate_stage(spark, docs, SF_SMALL)) == Counter(i for i, _ in rows if uf.find(i) == i)
    got = P.near_duplicate_stage(spark, edge_docs, SF_SMALL)
    assert got.columns == edge_docs.columns
    fps = {H.simhash(r[1]) for r in edge_rows}
    assert got.count() == len(fps)          # no two fingerprints here are within two bits
    assert ids(got)[8] == 2 and ids(got)[6] == 0


def test_decontamination_stage(spark, docs):
    bad = docs.limit(3).select("doc_id").collect()
    item = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").orderBy("item_id").first()["text"]
    planted = docs.selectExpr("doc_id", f"IF(doc_id IN ({','.join(str(r[0]) for r in bad)}), "
                              "concat('words before. ', '" + item.replace("'", "\\'") + "', ' words after'), text) text",
                              "lang", "source", "n_chars")
    kept = ids(P.decontamination_stage(spark, planted, SF_SMALL))
    assert not any(kept[r[0]] for r in bad)
    assert set(kept) <= set(ids(docs)) and len(kept) > 0.8 * docs.count()


def test_mixing_and_sharding_stages(spark, docs, edge_docs, no_docs):
    mixed = P.mixing_stage(spark, docs, SF_SMALL)
    assert mixed.columns == docs.columns and max(ids(mixed).values()) <= 3
    out = P.sharding_stage(spark, mixed, SF_SMALL)
    assert ids(out) == ids(mixed) and out.columns == [*docs.columns, "shard", "slot"]
    for _, stage in P.STAGES:
        assert stage(spark, no_docs, SF_SMALL).count() == 0
    for _, stage in P.STAGES[:-1]:
        got = stage(spark, edge_docs, SF_SMALL)
        assert got.columns == edge_docs.columns and got.count() > 0


CLASHING = ["_lang_pred", "_lang_score", "_hash", "_kept_id", "_kept_hash", "_kept_rows", "_nth", "_bad_id", "_bad_hash",
            "_m_id", "_m_hash", "_m_source", "_m_copies", "_m_rows", "_m_nth", "_m_times", "_m_copy", "_HASH_", "id", "hash",
            "size", "copies", "component_id", "fingerprint", "extra0", "a.b", "held_out"]


def test_extra_columns_pass_through(spark, edge_docs):
    """Columns named like anything inside the stages keep their values."""
    rows = edge_docs.select("doc_id", "text", "lang", "source").where("doc_id IS NOT NULL AND length(text) < 1000")
    wide = rows.selectExpr("*", *[f"concat('{k}-', doc_id) AS `{c}`" for k, c in enumerate(CLASHING)])
    for _, stage in P.STAGES[:-1]:
        got = stage(spark, wide, SF_SMALL)
        assert got.columns == wide.columns
        for r in got.collect():
            assert [r[4 + k] for k in range(len(CLASHING))] == [f"{k}-{r[0]}" for k in range(len(CLASHING))]


def test_run_applies_the_stages(spark, docs, tmp_path):
    out = P.run(spark, SF_SMALL)
    n = Counter(r["shard"] for r in out.collect())
    assert n and max(n.values()) - min(n.values()) <= 1
    assert np.isin([r["doc_id"] for r in out.collect()], list(ids(docs))).all()
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"{SF_SMALL}/{t}.parquet").limit(0).write.parquet(os.path.join(tmp_path, f"{t}.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0
