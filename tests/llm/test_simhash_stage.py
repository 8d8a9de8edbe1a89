"""The pipeline's near-duplicate stage starts from fingerprints and their index."""

import random

from playtide.llm import simhash
from playtide.llm.similar import nodes

from .test_similar import brute_kept


def _texts(rng):
    """Long texts with few changed words, so that fingerprints are near, some equal in fingerprint but not in text, and short ones."""
    vocab = [f"w{i}" for i in range(500)]
    out = []
    for _ in range(12):
        w = rng.choices(vocab, k=400)
        out += [" ".join(w), " ".join([*w[:-1], "last"]), " ".join(w).upper(), " ".join(w[:390])]
    return [*out, "", None, "a b", "A b"]


def test_index_pairs_connect_what_is_near(spark):
    rows = nodes(spark.createDataFrame(list(enumerate(_texts(random.Random(4)))), "doc_id long, text string"))
    parent = {r.node: r.node for r in rows.select("node").distinct().collect()}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in simhash.near_pairs(rows).collect():
        parent[root(r.a)] = root(r.b)
    prints = {r.node: simhash.fingerprint((r.text or "").lower().encode().split(), 5) for r in rows.collect()}
    close = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    assert len(close) > 12 and any(prints[a] == prints[b] for a, b in close) and any(prints[a] != prints[b] for a, b in close)
    assert all(root(a) == root(b) for a, b in close)


def test_the_stage_asks_the_index_and_keeps_the_contract(spark, monkeypatch):
    texts = _texts(random.Random(4))
    asked = []
    real = simhash.near_pairs
    monkeypatch.setattr(simhash, "near_pairs", lambda rows, shingle: asked.append(shingle) or real(rows, shingle))
    kept = simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(brute_kept([(i, t or "") for i, t in enumerate(texts)]))
    assert asked == [5]
