import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from playtide.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    """Targets by source, in order: shared by weight, capped, the excess shared again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, target, open_ = sum(sizes.values()), {}, set(names)
    while open_:
        level = (total - sum(target.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if most * sizes[s] <= level * weight[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: float(most * sizes[s]) for s in full}
        open_ -= full
    return target


def brute_seats(votes, seats, most):
    """Seats one by one to the highest quotient; ties to the first."""
    got = [0] * len(votes)
    for _ in range(min(seats, sum(m for v, m in zip(votes, most, strict=True) if v > 0))):
        best = max((i for i in range(len(votes)) if votes[i] > 0 and got[i] < most[i]), key=lambda i: (votes[i] / (2 * got[i] + 1), -i))
        got[best] += 1
    return got


def documents(seed, sources=7, rows=300):
    rng = random.Random(seed)
    out = []
    for i in range(rows):
        source = None if i % 17 == 0 else "hot" if i % 3 == 0 else f"s{rng.randint(0, sources)}"
        text = rng.choice([None, "", " \n"]) if i % 23 == 0 else " ".join("w" for _ in range(rng.choice([1, 5, 40, 300])))
        out.append((i, text, source))
    return [*out, out[5], out[5], (None, "a b c", "hot"), (None, "a b c", "hot"), (1000, "y " * 9000, "Z"), (1001, None, "é"), (1002, "one", "é2")]


@pytest.mark.parametrize(("block", "shard_words"), [(16, 1 << 22), (16, 900), (7, 300)])
def test_mix(spark, block, shard_words):
    rows = documents(block)
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, source string, size int, place string, `range` int")
    out = mixing.mix(df.repartition(3), block=block, shard_words=shard_words).collect()
    assert sorted((repr((r.doc_id, r.source, r["size"])) for r in out)) == sorted(repr((i, s, len(WORD.findall(t or "")))) for i, t, s in rows)
    size, taken = Counter(), Counter()
    for r in out:
        size[r.source] += r["size"]
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r["size"] and r.taken == r.passes * r["size"] + sum(s.b - s.a for s in r.spans)
        assert all(0 <= s.a < s.b <= r["size"] for s in r.spans) and all(x.b <= y.a for x, y in zip(r.spans, r.spans[1:]))
    target = brute_targets(size)
    names = sorted(size, key=lambda s: (s is None, s or ""))
    quota = dict(zip(names, brute_seats([target[s] for s in names], round(sum(size.values()) / block), [-(-3 * size[s] // block) for s in names]), strict=True))
    cells = defaultdict(lambda: defaultdict(int))
    for r in out:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source])
        cells[r.source][r.shard] += r["size"]
    for s in names:
        shards = sorted(cells[s])
        words = [cells[s][x] for x in shards]
        parts = brute_seats([float(w) for w in words], quota[s], [-(-3 * w // block) for w in words])
        assert taken[s] == sum(min(q * block, 3 * w) for q, w in zip(parts, words, strict=True))
        assert abs(taken[s] - target[s]) <= block * (1 + len(shards))
    again = mixing.mix(df.repartition(5, "text"), block=block, shard_words=shard_words).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, out))


def test_apportionment(spark):
    rng = random.Random(3)
    groups = {}
    for g in range(8):
        n = rng.randint(1, 30)
        votes = [float(rng.choice([0, 1, 1, 5, rng.randint(1, 1000)])) for _ in range(n)] if g else [10.0] * 12
        most = [rng.choice([0, 3, 10_000, 10_000]) for _ in range(n)] if g else [10_000] * 12
        groups[g] = (votes, most, rng.choice([0, 1, n, 5 * n + 3, 400]) if g else 43)
    parties = spark.createDataFrame([(g, i, v, m) for g, (vs, ms, _) in groups.items() for i, (v, m) in enumerate(zip(vs, ms, strict=True))], "group long, place long, votes double, most long")
    seats = spark.createDataFrame([(g, s) for g, (_, _, s) in groups.items()], "group long, seats long")
    got = {(r.group, r.place): r.quota for r in mixing.apportion(parties, seats).collect()}
    for g, (votes, most, s) in groups.items():
        assert [got.get((g, i), 0) for i in range(len(votes))] == brute_seats(votes, s, most), g


def test_places_and_empty(spark):
    names = [None, "b", "B", "é", "", "a b", "😀", "~"]
    df = spark.createDataFrame([(s, 1) for s in names], "source string, source_size long")
    got = mixing.numbered(df, F.col("source").isNull(), F.col("source").asc_nulls_last()).collect()
    assert [r.source for r in sorted(got, key=lambda r: r.place)] == ["", "B", "a b", "b", "~", "é", "😀", None]
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(none).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert [(r.taken, r.target) for r in mixing.mix(blank).collect()] == [(0, 0.0), (0, 0.0)]


def test_word_counts():
    texts = [None, "", "a", " a", "a ", "a b c", "\x1ca b", "日本 語", "  ", "b\x0bc\td"]
    for cut in (slice(None), slice(3, 8), slice(0, 2)):
        assert mixing.word_counts(pa.array(texts)[cut]).tolist() == [len(WORD.findall(t or "")) for t in texts[cut]]


def test_query(spark, frame, tmp_path):
    frame.withColumn("source", frame.key).write.parquet(f"{tmp_path}/documents.parquet")
    out = mixing.op12_mixing(spark, str(tmp_path))
    assert dict(out.dtypes) == {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"}
    got = out.collect()
    assert abs(sum(r.taken for r in got) - sum(r["size"] for r in got)) <= 64 and len(got) == frame.count()
