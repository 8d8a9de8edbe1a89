import random

import pytest

import corpus_pipeline
from playtide.llm import language_id, packing, quality_rules

from .test_similar import brute_kept
from .test_substrings import brute


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(11)
    syl = {"de": ["sch", "ung", "ein", "keit"], "en": ["the", "ing", "re", "wh"]}
    rows, labels = [], []
    passage = " ".join(f"pass{i}age" for i in range(70))
    for i in range(90):
        lang = rng.choice(["de", "en"])
        w = ["".join(rng.choice(syl[lang]) for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(60, 160))]
        bad = i % 6 == 0
        if bad:
            w = [x + "###" for x in w]
        if i % 10 == 1:
            w = w[:30] + passage.split() + w[30:]
        rows.append((i, "\n".join([" ".join(w[:20]), " ".join(w[20:])]), lang, "s"))
        labels.append((i, 0 if bad else 1, 0))
    rows += [(100, rows[1][1], "de", "s"), (101, rows[2][1] + " one", "en", "s"), (102, None, None, None), (103, "", "en", "s"), (104, "12 34", None, "s"), (105, "kurz", "de", "s")]
    rows = [(*r, len(r[1] or "")) for r in rows]
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at), rows, labels


def test_stages_against_brute_force(spark, tables):
    at, rows, labels = tables
    docs = spark.read.parquet(f"{at}/documents.parquet")
    text = {r[0]: r[1] for r in rows}
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5

    good = stages["quality_rules"](spark, docs, at)
    assert good.columns == docs.columns
    kept = {r.doc_id for r in good.collect()}
    bad = {i for i, q, _ in labels if q == 0}
    assert kept == set(text) - bad - {102, 103}

    known = stages["language_id"](spark, good, at)
    assert {r.doc_id for r in known.collect()} == kept - {104}

    one = stages["simhash_near_dedup"](spark, known, at)
    alone = brute_kept([(i, text[i]) for i in sorted(kept - {104})])
    assert {r.doc_id for r in one.collect()} == alone and not alone & {100, 101}

    clean = stages["substring_dedup"](spark, one, at)
    want = brute([(i, text[i]) for i in sorted(alone)], 35)
    assert clean.columns == docs.columns and any(n for _, n, _ in want.values())
    for r in clean.collect():
        _, gone, left = want[r.doc_id]
        assert r.text == (left if gone else text[r.doc_id]) and r.n_chars == len(r.text)

    packed = stages["best_fit_packing"](spark, clean, at).collect()
    assert {r.doc_id for r in packed} == alone

    whole = sorted(map(tuple, corpus_pipeline.run(spark, at).select("doc_id", "piece", "start", "length", "ids_crc32").collect()))
    assert whole == sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed)


def test_empty_input(spark, tables):
    at, _, _ = tables
    docs = spark.read.parquet(f"{at}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, at).count() == 0
    assert language_id and packing and quality_rules
