import hashlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from playtide.llm import substrings


def brute(corpus, width):
    docs = {i: (t or "").encode().split() for i, t in corpus}
    count = Counter(tuple(w[p : p + width]) for w in docs.values() for p in range(len(w) - width + 1))
    out = {}
    for i, w in docs.items():
        gone = set()
        for p in range(len(w) - width + 1):
            if count[tuple(w[p : p + width])] > 1:
                gone |= set(range(p, p + width))
        out[i] = (len(w), len(gone), " ".join(x.decode() for j, x in enumerate(w) if j not in gone))
    return out


@pytest.mark.parametrize(("width", "k", "budget"), [(35, 6, 50_000), (8, 3, 50_000), (8, 3, 2)])
def test_matches_brute_force(frame, corpus, width, k, budget):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeats(frame, width=width, k=k, budget=budget).collect()}
    assert got == brute(corpus, width)


def test_repeats_inside_one_document(spark):
    line = " ".join(f"w{i}" for i in range(40))
    rows = [(0, f"{line} x {line}"), (1, "a " * 100), (2, line.replace("w", "v"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeats(df).collect()}
    assert got == brute(rows, 35)
    assert got[0][1] == 80 and got[1][1] == 100 and got[2][1] == 0


def test_rolling():
    h = np.arange(1, 60, dtype=np.uint64)
    for width in (1, 2, 3, 6, 35):
        r = substrings.rolling(np.concatenate((h, h)), width)
        assert len(r) == 2 * len(h) - width + 1 and r[3] == r[3 + len(h)] and len(set(r[:20].tolist())) == 20


def test_sql_agrees(frame, corpus, tmp_path):
    frame.toPandas().to_parquet(tmp_path / "d.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d.parquet'")
    want = {r[0]: (r[1], r[2], r[3]) for r in con.sql(substrings.ORACLE).fetchall()}
    got = {i: (n, g, hashlib.sha256(k.encode()).hexdigest()) for i, (n, g, k) in brute(corpus, 35).items()}
    assert want == got


def test_empty_table(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_null_and_repeated_ids_with_different_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(None, f"{a} {b}"), (None, f"{c} x"), (None, "short"), (7, f"y {a}"), (7, "one two"), (7, " ".join(f"d{i}" for i in range(200)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(list(enumerate(t for _, t in rows)), 35)
    assert sum(g for _, g, _ in want.values()) == 120
    want = sorted(repr((rows[i][0], *w)) for i, w in want.items())
    got = substrings.remove_repeats(df).collect()
    assert sorted(repr((r.doc_id, r.n_words, r.n_removed, r.kept)) for r in got) == want
    left = substrings.rewrite(df).collect()
    assert sorted((repr(r.doc_id), r.text) for r in left) == sorted((repr(r.doc_id), r.kept) for r in got)
