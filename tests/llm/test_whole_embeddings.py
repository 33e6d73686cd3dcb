"""Near duplicates among clustered vectors, where a window of the sorted order holds few true neighbours."""

import numpy as np
import pytest

import llm_helpers as H
from pitwall.llm import embeddings


def clustered(n=2400, pairs=120, dim=32, mean=0.9):
    """Vectors at cosine ``mean`` or so to each other; the last ``pairs`` are each linked with one of the first."""
    rng = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    hot = unit(rng.standard_normal(dim))
    aside = lambda k: unit((r := rng.standard_normal((k, dim))) - np.outer(r @ hot, hot))
    x = np.sqrt(mean) * hot + np.sqrt(1 - mean) * aside(n)
    twin = unit(x[:pairs] + 0.28 * unit(rng.standard_normal((pairs, dim))))
    return np.concatenate([x, twin]).astype(np.float32)


def wanted(x, threshold=0.95):
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hit = y @ y.T >= threshold
    uf = H.Union()
    for a, b in zip(*np.nonzero(np.triu(hit, 1))):
        uf.join(int(a), int(b))
    low = {}
    for i in range(len(x)):
        low.setdefault(uf.find(i), i)
    return {i: (int(hit[i].sum()) - 1, low[uf.find(i)]) for i in range(len(x))}


@pytest.mark.parametrize("depth", [None, 5])
def test_clustered_vectors_lose_no_link(spark, monkeypatch, depth):
    if depth is not None:
        monkeypatch.setattr(embeddings, "depth_for", lambda *_: depth)
    x = clustered()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"])
           for r in embeddings.near_duplicates(df, window=16).collect()}
    want = wanted(x)
    assert sum(n for n, _ in want.values()) > 100
    lost = [i for i in want if got[i] != want[i]]
    assert len(lost) <= (0 if depth is None else 0.005 * len(x))      # a hashed pair may be missed with chance 0.001


def test_passes_do_not_depend_on_the_spread():
    rng = np.random.default_rng(0)
    spread, dense = rng.standard_normal((300, 32)), clustered(300, 0, mean=0.6)
    for x in (spread, dense):
        depth = embeddings.depth_for(x.tolist(), 10**6, 0.95)
        share = (1 - np.arccos(0.95) / np.pi) ** depth
        assert depth > 0 and (1 - share) ** embeddings.passes_for(depth, 0.95) <= embeddings.MISSED
    assert embeddings.passes_for(0, 0.95) == 1 and embeddings.depth_for([], 0, 0.95) >= 0
