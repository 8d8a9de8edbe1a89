import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from playtide.llm import suffix_lm as lm
from playtide.llm.common import bucket_of_id


def brute_base(train, texts):
    c = Counter(w for t in train for w in lm.tokens(t))
    n, v = sum(c.values()), len(c)
    return n, [(len(ts := lm.tokens(t)), sum(w in c for w in ts), sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ts)) for t in texts]


class BruteTree:
    """Dict counts, divergence test and smoothing, symbol by symbol."""

    def __init__(self, counts, depth, gain, prior=1.0):
        self.depth, self.prior, self.follow = depth, prior, {}
        for w, n in counts.items():
            s = b" " + w + b" "
            for i in range(1, len(s)):
                for d in range(0, min(depth, i) + 1):
                    self.follow.setdefault(s[i - d : i], Counter())[s[i]] += n
        self.kept = {b""}
        for u, c in self.follow.items():
            if u:
                q = self.follow[u[1:]]
                p, qn = sum(c.values()), sum(q.values())
                if sum(n * math.log((n / p) / (q[x] / qn)) for x, n in c.items()) >= gain:
                    self.kept.add(u)

    def p(self, u, x):
        while u not in self.kept:
            u = u[1:]
        c = self.follow.get(u, Counter())
        below = self.p(u[1:], x) if u else 1 / 256
        return (c[x] + self.prior * below) / (sum(c.values()) + self.prior)

    def log10(self, w):
        s = b" " + w + b" "
        return sum(math.log10(self.p(s[max(0, i - self.depth) : i], s[i])) for i in range(1, len(s)))


def test_scores_match_brute_force(frame, corpus):
    train = frame.filter(bucket_of_id(F.col("doc_id")) != 1)
    for head in (150_000, 5):
        got = {r.doc_id: r for r in lm.score(frame, train, depth=3, head=head).collect()}
        texts = [(t or "").encode() for _, t in corpus]
        learned = [t for (i, _), t in zip(corpus, texts, strict=True) if zlib.crc32(str(i).encode()) % 5 != 1]
        n, want = brute_base(learned, texts)
        tree = BruteTree(Counter(w for t in learned for w in lm.tokens(t)), 3, 12.0)
        assert len(tree.kept) > 20
        cache = {}
        for (i, _), t, (size, known, base) in zip(corpus, texts, want, strict=True):
            r = got[i]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (size, known, n)
            assert r.base_score == pytest.approx(base, rel=1e-9)
            total = sum(cache.setdefault(w, tree.log10(w)) for w in lm.tokens(t))
            assert r.score == pytest.approx(total, rel=1e-9)


def test_distributions_sum_to_one(spark):
    counts = spark.createDataFrame([(bytearray(b"abab"), 50), (bytearray(b"abc"), 30), (bytearray(b"\n"), 9), (bytearray(b"bca"), 70)], "word binary, n long")
    tree = lm.learn(counts, depth=3, gain=1.0)
    assert len(tree.states) > 3
    for s in range(len(tree.states)):
        assert tree.p(np.full(256, s), np.arange(256)).sum() == pytest.approx(1)


def test_bounded_states(spark):
    counts = spark.createDataFrame([(bytearray(f"w{i * 7919 % 1000}x{i}".encode()), i + 1) for i in range(300)], "word binary, n long")
    assert len(lm.learn(counts, depth=4, gain=0.5, max_states=10).states) <= 11


def test_every_context_that_passes_is_kept(spark):
    rng = random.Random(4)
    counts = {"".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)).encode(): rng.randint(50, 99) for _ in range(20_000)}
    want = BruteTree(counts, 5, 12.0).kept
    assert len(want) > 70_000
    tree = lm.learn(spark.createDataFrame([(bytearray(w), n) for w, n in counts.items()], "word binary, n long"))
    assert set(tree.states.tolist()) == {int.from_bytes(b"\x01" + u, "big") for u in want}


def test_nothing_to_learn_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, "ab c"), (1, "ab c"), (2, None), (None, "x")], "doc_id long, text string")
    rows = lm.score(df, df.limit(0)).collect()
    assert len(rows) == 4 and all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in rows)
    assert sorted(r.n_tokens for r in rows) == [1, 2, 3, 3]
    assert lm.score(df.limit(0), df).count() == 0
