import random

import numpy as np
import pytest

from playtide.llm import quality_rules as qr


def test_cuts_lie_where_the_label_changes():
    bad = np.array([0, 0, 0, 50, 50, 50, 0, 0])
    good = np.array([40, 40, 40, 0, 0, 0, 60, 60])
    assert qr.cuts(bad, good) == [3, 6]
    assert qr.cuts(np.array([10, 11, 9, 10]), np.array([30, 31, 30, 29])) == []
    assert qr.cuts(np.array([5]), np.array([7])) == [] and qr.cuts(np.zeros(4), np.zeros(4)) == []


def test_thresholds_come_from_the_labelled_rows(spark):
    """Bad texts have seven marks in ten words or more, which no fixed threshold says; good ones up to four."""
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        rate = rng.uniform(0.7, 0.95) if bad else rng.uniform(0.0, 0.4)
        words = [f"w{rng.randrange(10_000)}" + ("#" if rng.random() < rate else "") for _ in range(200)]
        rows.append((i, " ".join(words)))
        labels.append((i, 0 if bad else 1))
    docs, table = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    out, rules = qr.judge(docs, table)
    assert len(rules) == 1 and rules[0][0].feature == "symbols_per_word" and 0.45 < rules[0][0].threshold < 0.75
    assert {r.doc_id for r in out.filter("kept").collect()} == {i for i in range(400) if i % 4}


def test_two_kinds_of_bad_texts_take_two_rules():
    rng = random.Random(4)
    cells = [{"x": 0, "y": 0, "bad": False, "held": h, "count": 100} for h in (True, False)]
    cells += [{"x": x, "y": y, "bad": True, "held": h, "count": rng.randint(5, 20)} for x, y in ((1, 0), (0, 1)) for h in (True, False)]
    cells += [{"x": 1, "y": 1, "bad": False, "held": h, "count": 60} for h in (True, False)]
    rules = qr.learn_rules(cells, {"x": (1.0,), "y": (1.0,)})
    assert sorted(" & ".join(sorted(map(str, r))) for r in rules) == ["x < 1 & y >= 1", "x >= 1 & y < 1"]


@pytest.mark.parametrize("rows", [[], [(None, None), (None, "a b"), (1, ""), (1, "x y z")]])
def test_the_query_on_nulls_repeats_and_no_rows(spark, tmp_path, rows):
    spark.createDataFrame([(*r, True, 1) for r in rows], "doc_id long, text string, kept boolean, row int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0), (1, 1), (None, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    out = qr.op1_quality_rules(spark, str(tmp_path))
    assert [f.simpleString() for f in out.schema] == ["doc_id:bigint", "n_words:bigint", "word_chars:bigint", "n_symbols:bigint", "n_dup_lines:bigint", "n_repeat_words:bigint", "base_failed:boolean", "kept:boolean"]
    got = out.collect()
    assert len(got) == len(rows) and all(r.base_failed and not r.kept for r in got)
