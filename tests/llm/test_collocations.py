import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from playtide.llm import collocations as co

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top=2000, share=100):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, count in f.items():
        cand = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        inside = {}
        for q, b in cand.items():
            for k in range(2, len(q)):
                for i in range(len(q) - k + 1):
                    inside[q[i : i + k]] = max(inside.get(q[i : i + k], 0), b)
        kept = []
        for p, a in cand.items():
            if 100 * inside.get(p, 0) >= share * a:
                continue
            cuts = [(1000 * a * n[lang] // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            kept.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def corpus_rows(seed, size=400):
    rng = random.Random(seed)
    vocab = ["the", "The", "of", "and", "new", "york", "city", "é", "Éa", "x-y", "b\x1cc", "日本", "😀", "it's", "#"]
    rows = []
    for _ in range(size):
        out = []
        for _ in range(rng.randint(0, 60)):
            out.append(rng.choice(["new york city", "in the middle of it", "a b a b a b", rng.choice(vocab), rng.choice(vocab)]))
            out.append(rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", "\r\n"]))
        rows.append((rng.choice(["en", "en", "en", "de", None, "und"]), "".join(out)))
    return [*rows, ("en", None), (None, ""), ("fr", "...,;"), ("de", "new york city " * 3000), *rows[:20]]


@pytest.mark.parametrize(("least", "top", "share"), [(20, 2000, 100), (5, 7, 100), (3, 50, 60)])
def test_against_brute_force(spark, least, top, share):
    rows = corpus_rows(least)
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "lang string, text string, n int, phrase string").repartition(5)
    got = co.collocations(df, least=least, top=top, share=share)
    assert dict(got.dtypes) == {"lang": "string", "rank": "bigint", "phrase": "string", "a": "bigint", "l": "bigint", "r": "bigint", "n": "bigint", "score": "bigint"}
    assert sorted(map(tuple, got.collect())) == brute(rows, least, top, share)


def test_small_blocks_and_cuts(monkeypatch, spark):
    rows = corpus_rows(9, 40)
    monkeypatch.setattr(co, "BLOCK", 300)
    for text in ("a b, c d. " * 200, "x" * 2000, "y " * 300 + "." + "z " * 300, ""):
        parts = list(co._pieces(text.encode()))
        assert b"".join(parts) == text.encode() and all(p[-1:] in b".,;:!?\n\x0b\x0c\r" for p in parts[:-1])
    seen = Counter()
    for block in co.blocks(iter([pa.RecordBatch.from_pydict({"lang": [l or "und" for l, _ in rows], "text": pa.array([t for _, t in rows], pa.string())})])):
        for i, w in enumerate(block.index):
            seen[block.langs[block.lang[i]], block.words[w].as_py().decode()] += 1
    want = Counter()
    for lang, text in rows:
        want.update((lang or "und", w) for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)) for w in re.findall(r"[^\x20\x09]+", p))
    assert seen == want


def test_packed_cells():
    rng = np.random.default_rng(2)
    for bits, size in ((27, 50), (27, 200_000), (24, 300_000), (40, 5000)):
        cells = np.sort(rng.integers(0, 1 << bits, size, dtype=np.uint64))
        back = [(p << 22) + co.unpack(u, b) for p, u, b in co.pack(cells, 22)]
        assert np.array_equal(np.concatenate(back).astype(np.uint64), cells)


@pytest.mark.parametrize("bits", [27, 30])
def test_sketch_never_underestimates(spark, bits):
    rows = corpus_rows(4, 200)
    df = spark.createDataFrame([(l or "und", t) for l, t in rows], "lang string, text string").repartition(4)
    heavy = co.heavy_cells(df, 30, bits)
    count = Counter()
    batch = pa.RecordBatch.from_pydict({"lang": [l or "und" for l, _ in rows], "text": pa.array([t for _, t in rows], pa.string())})
    for block in co.blocks(iter([batch])):
        for h in co._hashes(block):
            count[int(h)] += 1
    frequent = np.array([h for h, c in count.items() if c >= 30], dtype=np.uint64)
    rare = np.array([h for h, c in count.items() if c < 30], dtype=np.uint64)
    assert len(frequent) and len(co._survives(frequent, heavy)) == len(frequent)
    assert len(co._survives(rare, heavy)) <= len(rare) // 10


def test_query_and_empty(spark, tmp_path):
    spark.createDataFrame([(1, "Good Morning. " * 150, None), (2, None, "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(r) for r in co.op13_collocations(spark, str(tmp_path)).collect()] == [("und", 1, "good morning", 150, 150, 150, 300, 2000)]
    assert co.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0
