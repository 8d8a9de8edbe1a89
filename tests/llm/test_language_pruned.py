import random

import numpy as np
import pytest

from playtide.llm import language_id as li

from .test_language_id import brute_bits, rows  # noqa: F401


def test_pruned_contexts_still_add_up_to_one(spark, rows):  # noqa: F811
    """Short contexts keep the mass of rare paths, and what a context loses goes to its escape."""
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    full, pruned = li.learn(df), li.learn(df, max_grams=200)
    for a, b in zip(full.trees, pruned.trees, strict=True):
        assert len(b.paths[3]) < len(a.paths[3])
        for d in range(4):
            assert len(b.paths[d]) <= 200
            shared = np.isin(a.contexts[d], b.contexts[d])
            assert a.total[d][shared].tolist() == b.total[d].tolist() and a.kinds[d][shared].tolist() == b.kinds[d].tolist()
            inside = np.bincount(np.searchsorted(b.contexts[d], b.paths[d] >> np.uint32(8)), weights=b.counts[d])
            assert inside + b.escape[d] == pytest.approx(b.total[d] + b.kinds[d])


def test_the_rule_is_the_same_at_every_size(spark, rows):  # noqa: F811
    """Ten copies of the corpus keep the same paths."""
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    ten = spark.createDataFrame(rows * 10, "doc_id long, text string, lang string")
    one, many = li.learn(df, max_grams=500), li.learn(ten, max_grams=500)
    for a, b in zip(one.trees, many.trees, strict=True):
        assert all((x == y).all() for x, y in zip(a.paths, b.paths, strict=True))


def test_the_query_on_nulls_repeats_and_long_texts(spark, tmp_path, rows):  # noqa: F811
    rng = random.Random(3)
    long = " ".join(rng.choice(["the", "ing", "re", "wh"]) for _ in range(200_000))
    more = [*[(*r, 0.5, "x") for r in rows], (None, rows[5][1], "aa", 0.5, "x"), (None, None, None, 0.5, "x"), (5, rows[5][1], rows[5][2], 0.5, "x"), (7000, long, None, 0.5, "x")]
    spark.createDataFrame(more, "doc_id long, text string, lang string, score double, lang_pred string").write.parquet(f"{tmp_path}/documents.parquet")
    got = li.op2_language_id(spark, str(tmp_path)).collect()
    assert len(got) == len(more) and sum(r.doc_id is None for r in got) == 2
    by = {r.doc_id: r for r in got}
    assert by[7000].lang_pred == "cc" and 0 <= by[7000].score <= 1
    assert [f.simpleString() for f in li.op2_language_id(spark, str(tmp_path)).schema] == ["doc_id:bigint", "held_out:boolean", "lang_pred:string", "score:double"]
    assert brute_bits([b"a"], b"a") > 0
