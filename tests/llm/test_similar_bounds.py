import random

import numpy as np

from playtide.llm import similar


def test_no_pair_alike_is_beyond_its_bound():
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(60):
        base = rng.integers(-(1 << 63), (1 << 63) - 1, rng.integers(5, 400))
        for cut in (0.0, 0.05, 0.1, 0.11, 0.3):
            k = int(len(base) * cut)
            sets.append(np.unique(np.concatenate((base[k:], rng.integers(-(1 << 63), (1 << 63) - 1, k)))))
    n = np.array([len(x) for x in sets])
    got = {(min(a, b), max(a, b)): m for i, j, c in similar._able([similar.bitmap(x) for x in sets], n) for a, b, m in zip(i.tolist(), j.tolist(), c.tolist(), strict=True)}
    alike = 0
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            common = len(np.intersect1d(sets[a], sets[b]))
            if 10 * common >= 8 * (n[a] + n[b] - common):
                alike += 1
                assert got[a, b] >= common
    assert alike > 100 and len(got) < 3 * alike


def test_dense_near_copies_that_miss_each_other_are_joined_by_those_between(spark):
    """A base and many copies with words replaced: copies are alike to the base, seldom to each other; a common line joins nothing."""
    rng = random.Random(6)
    vocab = [f"v{i}" for i in range(5000)]
    line = [f"line{i}" for i in range(30)]
    rows = []
    for g in range(3):
        base = line + rng.choices(vocab, k=200)
        rows.append(" ".join(base))
        for _ in range(60):
            w = list(base)
            at = rng.randrange(len(w) - 20)
            w[at : at + 20] = rng.choices(vocab, k=rng.randint(10, 24))
            rows.append(" ".join(w))
    rows += [" ".join(line + rng.choices(vocab, k=60)) for _ in range(40)]
    from .test_similar import brute_kept

    rows = list(enumerate(rows))
    rng.shuffle(rows)
    rows.sort()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in similar.similar_documents(df).collect()}
    assert {i for i, c in got.items() if i == c} == brute_kept(rows)


def test_pieces_of_a_large_group_all_meet(spark):
    rows = spark.createDataFrame([(1, i) for i in range(50)] + [(2, i) for i in range(3)], "key long, node long")
    met = similar._met(rows, 8).collect()
    groups = {}
    for r in met:
        groups.setdefault(r.key, set()).add(r.node)
    pairs = {(a, b) for g in groups.values() for a in g for b in g if a < b}
    assert {(a, b) for a in range(50) for b in range(a + 1, 50)} <= pairs and max(map(len, groups.values())) < 20
