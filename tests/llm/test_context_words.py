"""op9's tree with contexts of several words, against a model with dictionaries."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from playtide.llm import context_lm as lm

from .test_context_lm import Brute


class Longer(Brute):
    """Brute with contexts of up to `words` words, each a state by the same test against its longest suffix that is one."""

    def __init__(self, train, share, gain, depth, words):
        super().__init__(train, share, gain, depth)
        docs = [lm.tokens(t) for t in train]
        least = max(2.0, share * self.n)
        frequent = {(w,) for w, k in self.c.items() if k >= share * self.n}
        self.after, self.states, self.words = {}, set(), words
        for n in range(1, words + 1):
            for d in docs:
                for i in range(n, len(d)):
                    if (s := tuple(d[i - n : i])) in frequent:
                        self.after.setdefault(s, Counter())[d[i]] += 1
            found = {s: f for s, f in self.after.items() if len(s) == n}
            new = {s for s, f in found.items() if sum(k * (math.log(k / f.total()) - math.log(10) * self.given(s[1:], b)) for b, k in f.items()) >= gain}
            self.states |= new
            frequent = {(*s, b) for s, f in found.items() for b, k in f.items() if k >= least and b in self.c and self.c[b] >= share * self.n}

    def given(self, s, w):
        s = tuple(s)
        while s and s not in self.states:
            s = s[1:]
        if not s:
            return self.root(w)
        f = self.after[s]
        return math.log10((max(f[w] - 1, 0) + len(f) * 10 ** self.given(s[1:], w)) / f.total())

    def score(self, text):
        t = lm.tokens(text)
        return sum(self.given(t[max(0, i - self.words) : i], w) for i, w in enumerate(t))


def _texts(rng):
    """Words that depend on the two before, some rare ones, a hot pair, and short and empty texts."""
    vocab = [f"w{i}" for i in range(12)]
    after = {(a, b): rng.sample(vocab, 3) for a in vocab for b in vocab}
    out = []
    for _ in range(60):
        w = rng.choices(vocab, k=2)
        while len(w) < rng.randint(3, 120):
            w.append(rng.choice(after.get((w[-2], w[-1]), vocab)) if rng.random() > 0.1 else f"r{rng.randrange(90)}" if rng.random() > 0.5 else "w0")
        out.append(" ".join(w))
    return [*out, "", "w1", None, out[0], "new w3 w4 new"]


@pytest.mark.parametrize(("share", "parts", "held", "words"), [(1e-5, 3, 2_000_000, 3), (0.004, 5, 300, 3), (0.006, 4, 50, 2), (0.004, 2, 900, 5)])
def test_longer_contexts_match_brute_force(spark, share, parts, held, words):
    rows = list(enumerate(_texts(random.Random(9))))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in lm.score(df, df.filter("doc_id % 5 <> 1"), share=share, gain=4.0, depth=3, least_share=0.0, parts=parts, tokens_held=held, words=words).collect()}
    model = Longer([(t or "").encode() for i, t in rows if i % 5 != 1], share, 4.0, 3, words)
    assert any(len(s) > 1 for s in model.states)
    for i, t in rows:
        assert got[i] == pytest.approx(model.score((t or "").encode()), rel=1e-5)


def test_the_query_uses_them(spark, tmp_path):
    """What only the two words before can tell is scored far better than by the one before."""
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(20)]
    after = {(a, b): rng.choice(vocab) for a in vocab for b in vocab}
    texts = []
    for _ in range(400):
        w = rng.choices(vocab, k=2)
        while len(w) < 60:
            w.append(after[w[-2], w[-1]] if rng.random() > 0.1 else rng.choice(vocab))
        texts.append(" ".join(w))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    held = lm.op9_suffix_tree_lm(spark, str(tmp_path)).filter("held_out")
    train = docs.filter(~lm.bucket_of_id(F.col("doc_id")).eqNullSafe(1))
    one = lm.score(docs, train).select("doc_id", F.col("score").alias("one"))
    r = held.join(one, "doc_id").agg(F.sum("score").alias("s"), F.sum("one").alias("one")).first()
    assert r.s > 0.6 * r.one
