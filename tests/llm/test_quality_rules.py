import re
from collections import Counter

from playtide.llm import quality_rules as qr

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = Counter(tri)
    rep = {j for i, x in enumerate(tri) if c[x] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(rep)


def test_statistics(frame, corpus, spark):
    more = [(900, "a b c a b c a"), (901, "x x x x"), (902, "x x x"), (903, "l m\nl m\n l m\n\n\n"), (904, "😀😀 é <a>"), (905, "p q r s p q r t q r s")]
    df = frame.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in qr.document_statistics(df).collect()}
    assert got == {i: brute(t) for i, t in [*corpus, *more]}


def corpus_with_labels(spark):
    rows, labels = [], []
    for i in range(240):
        w = [f"wo{(i * 37 + j * j) % 211}rd{j}" for j in range(80)]
        bad = i % 3 == 0
        if bad:
            w = [x + "###" for x in w] if i % 2 else [x.upper() + "!!" for x in w]
        rows.append((i, " ".join(w)))
        if i % 4 != 3:
            labels.append((i, 0 if bad else 1))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_rules_are_learned_and_applied(spark):
    docs, labels = corpus_with_labels(spark)
    out, rules = qr.judge(docs, labels)
    assert rules and all(str(c) for r in rules for c in r)
    assert {r.doc_id for r in out.filter("kept").collect()} == {i for i in range(240) if i % 3}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    assert {r.doc_id for r in qr.keep_good(docs, labels).collect()} == {i for i in range(240) if i % 3}


def test_base_rules_and_no_labels(frame, corpus, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    out, rules = qr.judge(frame, none)
    assert rules == []
    for r in out.collect():
        n, rep = r.n_words, r.n_repeat_words
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n) and r.kept == (not r.base_failed)
    assert qr.judge(frame.limit(0), none)[0].count() == 0


def test_noise_is_not_learned():
    cells = [{f: 0 for f in qr.GRID} | {"held": h, "bad": b, "count": 10} for h in (True, False) for b in (True, False)]
    assert qr.learn_rules(cells) == []
