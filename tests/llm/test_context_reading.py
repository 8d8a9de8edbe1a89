"""op9 reads texts in Arrow's kernels, and spells words only where they can be new."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from playtide.llm import context_lm as lm
from playtide.llm import suffix_lm

ODD = ["", " ", "\n", " a  B\tc\x0bd\x0ce\rf\n", "x", "Ä É\x85ß\xa0y z \x1c\x1d \x00 q", "  lead", "trail  ", "İ ı Σ AZ[`az{", "\U0001f600 á"]


def test_split_is_tokens():
    for column in (pa.array([*ODD, None]), pa.array(["zz z", *ODD, None])[1:], pa.array([], pa.string())):
        words, sizes = suffix_lm.split(column)
        want = [lm.tokens((t or "").encode())[:-1] for t in column.to_pylist()]
        assert words.to_pylist() == [w for t in want for w in t]
        assert sizes.tolist() == [len(t) for t in want]


class Spelling:
    """A tree that notes what it is asked."""

    def __init__(self):
        self.asked = []

    def log10(self, words):
        self.asked += words
        return np.array([-float(len(w)) for w in words])


@pytest.mark.parametrize("frequent", [[b"\n", b"a"], [b"a"], []])
def test_only_words_that_can_be_new_are_spelled(frequent):
    head = lm.Head(frequent, np.ones(len(frequent)), 10, 5)
    texts = [["a old old", None], ["a new old", "other a"]]
    tree = Spelling()
    reader = lm._Reader(head, tree)
    text, number, before, sizes = reader.read([pa.array(t) for t in texts])
    flat = [w for t in texts for x in t for w in lm.tokens((x or "").encode())]
    assert sizes.tolist() == [4, 1, 4, 3]
    assert number.tolist() == [frequent.index(w) if w in frequent else -1 for w in flat]
    rare = np.flatnonzero(number < 0)
    hashes, spelled = reader.others(rare, np.array([True, True, False, True]))
    assert hashes.tolist() == [lm.xxhash.xxh64_intdigest(flat[i], 42) for i in rare]
    assert {b"new", b"old"} <= set(tree.asked) and b"other" not in tree.asked
    assert len(tree.asked) == len(set(tree.asked))
    assert all(x == -len(flat[i]) for i, x in zip(rare, spelled, strict=True) if text[i] == 2)


def test_scores_are_those_of_texts_that_are_all_spelled(spark):
    """Also with bytes that are no UTF-8, and with an end that is rare."""
    rng = random.Random(7)
    texts = [*ODD, *(" ".join(rng.choices(["a", "b", "c", *(f"r{i}" for i in range(400))], [90, 60, 30, *[1] * 400], k=rng.randint(1, 90))) for _ in range(60)), "new a b unseen"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df = df.unionByName(spark.sql("SELECT 9000L AS doc_id, CAST(X'61FF2062C320FE41' AS STRING) AS text")).unionByName(spark.range(9001, 9003).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text")))
    held = F.col("doc_id") % 7 == 0
    every, some = (
        {r.doc_id: r for r in lm.score(df, df.filter(~held), share=0.03, gain=1.0, depth=3, least_share=0.0, parts=3, tokens_held=200, words=2, learned=c).collect()} for c in (None, ~held)
    )
    assert every == some and len(every) == len(texts) + 3
    learned = [t.encode() for i, t in enumerate(texts) if i % 7] + [b"a\xff b\xc3 \xfeA", b""]  # 9000 and 9001
    n = [len(lm.tokens(t)) for t in learned]
    assert len(n) < 0.03 * sum(n)  # ends
    assert (some[9000].n_tokens, some[9000].n_known, some[9000].train_tokens) == (4, 4, sum(n))
