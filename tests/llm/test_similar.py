import random

from playtide.llm import simhash, similar


def brute_kept(rows):
    """Smallest id of each component of pairs whose five-word shingles have a Jaccard similarity of 0.8 or more."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            same, both = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if both == 0 or 10 * same >= 8 * both:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {rows[i][0] for i in range(len(rows)) if find(i) == i}


def planted():
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(3000)]
    line = [f"common{i}" for i in range(25)]
    rows = []
    for i in range(40):
        n = rng.randint(30, 240)
        w = [rng.choice(vocab) for _ in range(n)]
        if i % 3 == 0:
            w = line + w
        rows.append(" ".join(w))
        for cut in (0.01, 0.02, 0.04, 0.06, 0.08, 0.2):  # one run replaced: alike from about 0.95 down to 0.6
            k = max(1, int(len(w) * cut))
            at = rng.randrange(len(w) - k)
            rows.append(" ".join(w[:at] + [rng.choice(vocab) for _ in range(k)] + w[at + k :]))
    rows += [" ".join(f"s{i}" for i in range(9)), " ".join(f"s{i}" for i in range(8)), None, "", "One", "one", "a b c d e f", "a b c d e"]
    return list(enumerate(rows))


def test_keeps_one_of_copies_from_point_eight_on(spark):
    rows = planted()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_kept(rows)
    assert 45 < len(want) < 200
    assert {r.doc_id for r in simhash.keep_one(df).collect()} == want


def test_components_and_empty(spark, frame, corpus):
    got = {r.doc_id: r.component_id for r in similar.similar_documents(frame).collect()}
    assert len(got) == len(corpus) and {i for i, c in got.items() if i == c} == brute_kept(corpus)
    assert similar.similar_documents(frame.limit(0)).count() == 0
