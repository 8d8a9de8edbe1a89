import random

import pytest

from playtide.llm import substrings

from .test_substrings import brute


@pytest.mark.parametrize("budget", [6, 20, 50_000])
def test_a_passage_that_all_documents_share_fills_its_task_more_than_once(spark, budget):
    rng = random.Random(budget)
    vocab = [f"w{i}" for i in range(500)]
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(240):
        cut = passage[: rng.randint(36, 60)] if i % 3 else passage[rng.randint(0, 20) :]
        own = rng.choices(vocab, k=rng.randint(0, 30))
        rows.append((i, " ".join(own + cut + rng.choices(vocab, k=5))))
    rows.append((240, " ".join(f"q{i}" for i in range(50))))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(40)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeats(df, budget=budget).collect()}
    assert got == brute(rows, 35)
    assert sum(n for _, n, _ in got.values()) > 8_000
