import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from playtide.llm import context_lm as lm
from playtide.llm.common import bucket_of_id

from .test_suffix_lm import BruteTree, brute_base


class Brute:
    """The model with dictionaries, token by token."""

    def __init__(self, train, share, gain, depth):
        docs = [lm.tokens(t) for t in train]
        self.c = Counter(w for d in docs for w in d)
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.spell = BruteTree(dict.fromkeys(self.c, 1), depth, gain)
        frequent = {w for w, k in self.c.items() if k >= share * self.n}
        self.after = {}
        for d in docs:
            for a, b in zip(d, d[1:]):
                if a in frequent:
                    self.after.setdefault(a, Counter())[b] += 1
        self.states = {a for a, f in self.after.items() if sum(k * (math.log(k / self.c[a]) - math.log(10) * self.root(b)) for b, k in f.items()) >= gain}

    def root(self, w):
        if not self.n:
            return self.spell.log10(w)
        if w in self.c:
            return math.log10(self.c[w] / (self.n + self.v))
        return math.log10(self.v / (self.n + self.v)) + self.spell.log10(w)

    def p(self, a, w):
        """log10 of the probability of w after a."""
        if a not in self.states:
            return self.root(w)
        f = self.after[a]
        return math.log10((max(f[w] - 1, 0) + len(f) * 10 ** self.root(w)) / self.c[a])

    def score(self, text):
        t = lm.tokens(text)
        return sum(self.p(a, w) for a, w in zip([None, *t], t))


@pytest.mark.parametrize(("share", "parts", "held"), [(0.002, 5, 300), (1e-5, 3, 2_000_000), (0.02, 4, 50)])
def test_scores_match_brute_force(frame, corpus, share, parts, held):
    train = frame.filter(bucket_of_id(F.col("doc_id")) != 1)
    got = {r.doc_id: r for r in lm.score(frame, train, share=share, gain=4.0, depth=3, least_share=0.0, parts=parts, tokens_held=held).collect()}
    texts = [(t or "").encode() for _, t in corpus]
    learned = [t for (i, _), t in zip(corpus, texts, strict=True) if zlib.crc32(str(i).encode()) % 5 != 1]
    n, want = brute_base(learned, texts)
    model = Brute(learned, share, 4.0, 3)
    assert model.states
    for (i, _), t, (size, known, base) in zip(corpus, texts, want, strict=True):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (size, known, n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score == pytest.approx(model.score(t), rel=1e-5)
    assert len(got) == len(corpus)


def test_what_follows_a_state_adds_up_to_one():
    rng = random.Random(3)
    train = [" ".join(rng.choices(["a", "b", "cc", "d"], [5, 3, 2, 1], k=40)).encode() for _ in range(20)]
    model = Brute(train, 0.01, 0.5, 2)
    assert model.states
    novel = model.v / (model.n + model.v)  # the root's mass for words that are spelled
    for a in model.states:
        weight = len(model.after[a]) / model.c[a]
        assert sum(10 ** model.p(a, w) for w in model.c) + weight * novel == pytest.approx(1)


def test_contexts_help_and_repeated_documents_stand_out(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    follow = {w: rng.sample(vocab, 4) for w in vocab}

    def text():
        w = [rng.choice(vocab)]
        while len(w) < 120:
            w.append(rng.choice(follow[w[-1]]))
        return " ".join(w)

    lone = [" ".join(rng.choices([f"x{i}" for i in range(30_000)], k=100)) for _ in range(40)]
    texts = [text() for _ in range(300)] + lone + lone[:10]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    train = df.filter("doc_id >= 50")
    got = {r.doc_id: r for r in lm.score(df, train, share=1e-4).collect()}
    held = [got[i] for i in range(50)]
    assert sum(r.score for r in held) > 0.7 * sum(r.base_score for r in held)
    twice = [got[300 + i].score for i in range(10)]
    once = [got[300 + i].score for i in range(10, 40)]
    assert min(twice) > max(once)


def test_nothing_to_learn_repeats_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, "ab c"), (1, "ab c"), (2, None), (None, "x"), (None, "x")], "doc_id long, text string")
    rows = lm.score(df, df.limit(0)).collect()
    assert len(rows) == 5 and all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in rows)
    assert sorted(r.n_tokens for r in rows) == [1, 2, 2, 3, 3] and sum(r.doc_id is None for r in rows) == 2
    rows = lm.score(df, df).collect()
    assert len(rows) == 5 and len({r.score for r in rows if r.doc_id == 1}) == 1
    assert lm.score(df.limit(0), df).count() == 0


def test_the_query(spark, tmp_path, corpus):
    rows = [(i, t, 1, "k") for i, t in corpus] + [(None, "a b", 0, None), (3, "other text", 0, "k")]
    spark.createDataFrame(rows, "doc_id long, text string, score int, batch string").write.parquet(f"{tmp_path}/documents.parquet")
    out = lm.op9_suffix_tree_lm(spark, str(tmp_path))
    assert [f.simpleString() for f in out.schema] == ["doc_id:bigint", "held_out:boolean", "n_tokens:bigint", "n_known:bigint", "train_tokens:bigint", "base_score:double", "score:double"]
    got = out.collect()
    assert len(got) == len(rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1) for r in got if r.doc_id is not None)
