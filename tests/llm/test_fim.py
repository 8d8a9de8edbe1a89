import hashlib
import re

import pytest

from playtide.llm import fim


def brute(doc_id, text, rate=100, spm=50):
    t = text or ""
    u = re.findall(r"[^\n]*\n|[^\n]+", t)
    hexed = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hexed[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(u), "plain", None, None, t
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if h[3] % 100 < spm:
        return len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


HARD = [(200, "a\n\n\nb"), (201, "\n"), (202, "x<P>y\nz"), (203, "<\n<S\nP>\nM>\n<"), (204, "é😀\r\n日本\x0b\n" * 40), (205, "one line"), (206, "\n" * 500), (207, "<M"), (208, ("y" * 300_000 + "\n") * 3 + "z" * 400_000), (None, "p\nq\nr\n"), (None, "p\nq\nr\n"), (-5, "l\nm\n"), (205, "one line")]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize(("rate", "spm"), [(100, 50), (60, 10), (0, 50)])
def test_against_brute_force(spark, frame, corpus, rate, spm):
    rows = [*corpus, *HARD]
    df = frame.select("doc_id", "text").union(spark.createDataFrame(HARD, "doc_id long, text string"))
    out = fim.transform(df, rate=rate, spm=spm)
    got = out.withColumn("back", fim.restore(out.output, out.form)).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    seen = sorted(((r.doc_id, r.text, r.n, r.form, r.prefix and len(r.prefix) if r.prefix is None else len(r.prefix), None if r.middle is None else len(r.middle), r.output) for r in got), key=key)
    assert seen == sorted(((i, t or "", *brute(i, t, rate, spm)) for i, t in rows), key=key)
    assert all(r.back == r.text for r in got)


def test_query(spark, frame, corpus, tmp_path):
    frame.withColumnsRenamed({"key": "units"}).write.parquet(f"{tmp_path}/documents.parquet")
    out = fim.op11_fim(spark, str(tmp_path))
    assert dict(out.dtypes) == {"doc_id": "bigint", "n": "bigint", "form": "string", "prefix_chars": "bigint", "middle_chars": "bigint", "output_sha256": "string", "restored_sha256": "string"}
    want = {}
    for i, t in corpus:
        n, form, p, m, o = brute(i, t)
        want[i] = (n, form, p, m, sha(o), sha(t or ""))
    assert {r[0]: tuple(r[1:]) for r in out.collect()} == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)
    assert fim.transform(frame.limit(0)).count() == 0


def test_other_sentinels_and_units(spark):
    df = spark.createDataFrame([(i, "a b  c " * i) for i in range(20)], "doc_id long, text string")
    marks = ("[[pre|", "[[suf|", "[[mid|")
    out = fim.transform(df, unit=r"[^ ]* |[^ ]+", sentinels=marks)
    for r in out.withColumn("back", fim.restore(out.output, out.form, marks)).collect():
        assert r.back == r.text and (not r.text or r.output.startswith(marks[0 if r.form == "psm" else 1]))
