import math
import random

import pytest

from playtide.llm import language_id as li


def brute_bits(train, text):
    """Counts kept in dicts, the escape chain walked byte by byte."""
    follow = {}
    for t in train:
        s = b"\0\0\0" + t
        for i in range(3, len(s)):
            for d in range(4):
                c = follow.setdefault(s[i - d : i], {})
                c[s[i]] = c.get(s[i], 0) + 1
    s, out = b"\0\0\0" + text, 0.0
    for i in range(3, len(s)):
        for d in (3, 2, 1, 0):
            c = follow.get(s[i - d : i])
            if c is None:
                continue
            n, kinds = sum(c.values()), len(c)
            if s[i] in c:
                out -= math.log2(c[s[i]] / (n + kinds))
                break
            out -= math.log2(kinds / (n + kinds))
        else:
            out += 8
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    syl = {"aa": ["ka", "to", "mi", "ré"], "bb": ["sch", "ung", "ö", "ein"], "cc": ["the", "ing", "re", "wh"]}
    out = []
    for i in range(150):
        lang = rng.choice(sorted(syl))
        text = " ".join("".join(rng.choice(syl[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 60)))
        out.append((i, text, None if i % 17 == 0 else lang))
    return out + [(900, None, "aa"), (901, "12 34 !!", "bb"), (902, "", "cc"), (903, "ß", None), (904, out[3][1], "cc")]


def test_code_lengths(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = li.learn(df)
    assert model.langs == ["aa", "bb", "cc"]
    texts = [(t or "").encode() for _, t, _ in rows[:40]] + [b"zzz unseen \xff", b""]
    got = model.lengths(texts)
    for k, lang in enumerate(model.langs):
        train = [t.encode() for _, t, x in rows if x == lang and t]
        for row, t in zip(got, texts, strict=True):
            assert row[k] == pytest.approx(brute_bits(train, t), rel=1e-5, abs=1e-4)


def test_predictions(spark, rows):
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double")
    got = {r.doc_id: (r.lang_pred, r.score) for r in li.predict(df, li.learn(df)).collect()}
    assert got[900] == got[901] == got[902] == ("und", 0.0)
    named = [(i, x) for i, t, x in rows if x and t and i < 900 and len(t) > 12]
    assert sum(got[i][0] == x for i, x in named) / len(named) > 0.97
    assert all(0 <= s <= 1 for _, s in got.values())


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in li.predict(df, li.learn(df)).collect()] == [(1, "und", 0.0)]
    assert li.predict(df.limit(0), li.learn(df.limit(0))).count() == 0


def test_bounded_model(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = li.learn(df, max_grams=20)
    assert all(len(t.paths[3]) <= 20 for t in model.trees)
    assert {r.doc_id for r in li.keep_identified(df).collect()}.isdisjoint({900, 901, 902})
