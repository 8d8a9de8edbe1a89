"""Pipeline stages on rows without ids, ids that repeat, names that clash, long texts and no rows."""

import random

import pytest

import corpus_pipeline
from playtide.llm import language_id, quality_rules, simhash, substrings

from .test_similar import brute_kept
from .test_substrings import brute


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rng = random.Random(21)
    vocab = {"de": ["schulung", "einheit", "keiner", "sching"], "en": ["thing", "wherein", "rething", "thewh"]}

    def text(lang, n):
        return " ".join("".join(rng.choice(vocab[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))

    rows = [(i, text(lang := ("de", "en")[i % 2], rng.randint(60, 150)), lang) for i in range(40)]
    rows += [(None, text("de", 90), "de"), (None, text("en", 90), "en"), (3, text("en", 80), None), (3, "### $$$ " * 40, None), (4, rows[4][1], "de"), (None, rows[5][1], None), (50, None, None), (51, "", "en"), (52, " ".join("the" + "".join(rng.choices("whringe", k=7)) for _ in range(30_000)), "en")]
    at = tmp_path_factory.mktemp("rows")
    names = "doc_id long, text string, lang string, source string, n_chars long, __row int, __id string, __pos int, row string"
    spark.createDataFrame([(*r, "s", len(r[1] or ""), 7, "x", 1, "y") for r in rows], names).write.parquet(f"{at}/documents.parquet")
    labels = [(i, 1, 0) for i in range(40)] + [(None, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at), rows


def test_every_stage_knows_a_row_by_id_and_text(spark, table):
    at, rows = table
    docs = spark.read.parquet(f"{at}/documents.parquet")
    texts = lambda df: sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in df.collect())
    good = quality_rules.keep_good(docs, spark.read.parquet(f"{at}/labels.parquet"))
    assert good.columns == docs.columns
    want = sorted((i if i is not None else -1, t or "") for i, t, _ in rows if (t or "").strip() and not t.startswith("###"))
    assert texts(good) == want

    known = language_id.keep_identified(docs)
    assert known.columns == docs.columns
    assert texts(known) == want  # neither symbols nor nothing has a language

    one = simhash.keep_one(known)
    assert one.columns == docs.columns
    left = [(k, t) for k, (i, t) in enumerate(want)]
    ids = sorted(range(len(want)), key=lambda k: (want[k][0] == -1, want[k]))
    ranked = [(n, want[k][1]) for n, k in enumerate(ids)]
    assert texts(one) == sorted(want[ids[n]] for n in brute_kept(ranked)) and len(left) > one.count()

    clean = substrings.rewrite(docs, length_col="n_chars")
    assert clean.columns == docs.columns
    gone = brute([(k, t) for k, (_, t, _) in enumerate(rows)], 35)
    assert sorted(r.text or "" for r in clean.collect()) == sorted(gone[k][2] if gone[k][1] else (t or "") for k, (_, t, _) in enumerate(rows))


def test_the_pipeline_runs_on_them(spark, table):
    at, _ = table
    out = corpus_pipeline.run(spark, at).collect()
    assert sum(r.doc_id is None for r in out) >= 2 and any(r.doc_id == 52 and r.piece > 3 for r in out)
    assert len({(r.sequence_id, r.offset) for r in out}) == len(out)
