import random

import numpy as np
import xxhash

from playtide.llm import simhash


def brute_fp(text):
    w = [x for x in (text or "").encode().lower().split()]
    if not w:
        return 0
    sh = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_classes(fps):
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def test_matches_brute_force(frame, corpus):
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(frame).collect()}
    fps = [brute_fp(t) for _, t in corpus]
    classes = brute_classes(fps)
    assert got == {i: (fps[i], classes[i]) for i, _ in corpus}


def test_index_search_and_stars():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    fps = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)) for _ in range(6)]))
    index = simhash.GrayIndex(fps)
    q, at = index.search(fps, 4)
    want = {(i, j) for i in range(len(fps)) for j in range(len(fps)) if (int(fps[i]) ^ int(fps[j])).bit_count() <= 4}
    where = {int(v): i for i, v in enumerate(fps)}
    assert {(a, where[int(index.values[b])]) for a, b in zip(q.tolist(), at.tolist(), strict=True)} == want


def test_links_survive_cut_groups(spark):
    rng = random.Random(1)
    fps = [rng.getrandbits(64) for _ in range(40)]
    fps += [f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for f in fps for _ in range(5)]
    fps = sorted(set(fps))
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    from playtide.llm.graph import connected_components

    for hot in (20000, 4):
        got = {r.node: r.component for r in connected_components(simhash.link_table(df, hot=hot)).collect()}
        classes = brute_classes(fps)
        sets = {}
        for f, c in zip(fps, classes, strict=True):
            sets.setdefault(c, set()).add(f - (1 << 64) if f >> 63 else f)
        for s in sets.values():
            assert {got.get(x, x) for x in s} == {min(s)} if len(s) > 1 else True


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0


def test_pipeline_stage_keeps_one(frame, corpus):
    kept = {r.doc_id for r in simhash.keep_one(frame).collect()}
    classes = brute_classes([brute_fp(t) for _, t in corpus])
    assert kept == set(classes)
