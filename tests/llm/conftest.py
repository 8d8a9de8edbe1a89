import random

import pytest


@pytest.fixture(scope="session")
def corpus():
    """Documents with copies, near copies, shared passages, blanks, nulls, ties and a long text."""
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6))) for _ in range(400)]

    def words(n):
        return [rng.choice(vocab) for _ in range(n)]

    passage = words(60)
    rows = []
    for i in range(60):
        w = words(rng.randint(1, 150))
        if i % 5 == 0:
            w = w[:20] + passage[: rng.randint(30, 60)] + w[20:]
        rows.append(" ".join(w))
    rows += [rows[3], rows[3], rows[4] + " end", rows[4].upper(), None, None, "", " \n\t ", "One", "a\nb\nb\n\nb", " ".join(words(9000)), "##$$ %% &&", "日本 語 😀", "x\x0by\x1cz q"]
    return list(enumerate(rows))


@pytest.fixture(scope="session")
def frame(spark, corpus):
    """The same as a DataFrame, with extra columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, 1, "k") for i, t in corpus], "doc_id long, text string, n_words int, key string").repartition(3)
