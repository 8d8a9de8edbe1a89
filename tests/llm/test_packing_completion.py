import itertools
import random
from collections import Counter

import pytest

from playtide.llm import packing

from .test_packing import bins_of, optimum


def triples(seed, n, capacity=1000):
    """Pieces cut from full bins in three, on which best fit does badly."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        a = rng.randint(380, 490)
        b = rng.randint(250, (capacity - a) // 2)
        out += [a, b, capacity - a - b]
    return out


@pytest.mark.parametrize("n", [12, 16, 20])
def test_completion_reaches_the_bound_where_best_fit_does_not(n):
    lengths = triples(1, n)
    counts = Counter(lengths)
    assert sum(m for _, m in packing.best_fit(counts, 1000)) > n
    got = bins_of(packing.complete_bins(counts, 1000))
    assert sorted(itertools.chain(*got)) == sorted(lengths) and max(map(sum, got)) <= 1000
    assert len(got) == n


def test_many_pieces_need_fewer_bins_than_best_fit():
    rng = random.Random(1)
    counts = Counter(min(2048, int(rng.lognormvariate(6, 1)) + 1) for _ in range(200_000))
    plan = packing.complete_bins(counts)
    assert Counter(x for p, m in plan for x, k in p for _ in range(k * m)) == counts
    bins = sum(m for _, m in plan)
    assert bins == packing.least_bins(counts, 2048) < sum(m for _, m in packing.best_fit(counts, 2048))


@pytest.mark.parametrize("seed", range(8))
def test_small_sets_of_long_pieces_are_optimal(seed):
    rng = random.Random(100 + seed)
    lengths = [rng.randint(15, 45) for _ in range(11)]
    got = bins_of(packing.complete_bins(Counter(lengths), 100))
    assert sorted(itertools.chain(*got)) == sorted(lengths) and len(got) == optimum(lengths, 100)


@pytest.mark.parametrize("seed", range(6))
def test_fillings_are_all_that_are_undominated(seed):
    rng = random.Random(seed)
    stock = dict(Counter(rng.randint(3, 30) for _ in range(9)))
    room = 50
    pieces = [x for x, n in stock.items() for _ in range(n)]
    every = {tuple(sorted(c, reverse=True)) for k in range(len(pieces) + 1) for c in itertools.combinations(pieces, k) if sum(c) <= room}

    def dominated(f):
        waste = room - sum(f)
        for y in {x for x, n in stock.items() if n > f.count(x)}:
            for k in range(len(f) + 1):
                for s in itertools.combinations(f, k):
                    if sum(s) <= y <= sum(s) + waste and s != (y,):
                        return True
        return False

    want = {f for f in every if not dominated(f)}
    got = [tuple(f) for f in packing.fillings(stock, room) if f is not None]
    assert set(got) == want and len(got) == len(want)
    assert [room - sum(f) for f in got] == sorted(room - sum(f) for f in got)


def test_the_bound_holds():
    for seed in range(20):
        rng = random.Random(seed)
        lengths = [rng.randint(1, 60) for _ in range(10)]
        assert packing.least_bins(Counter(lengths), 60) <= optimum(lengths, 60)


def test_rows_without_id_and_one_length_in_many_buckets(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, "c d e"), (1, "x"), (1, "y z"), (None, None)], "doc_id long, text string")
    rows = packing.pack_documents(docs).collect()
    assert len(rows) == 5 and sum(r.doc_id is None for r in rows) == 3
    assert len({(r.sequence_id, r.offset) for r in rows}) == 5
    pieces = spark.range(500).selectExpr("id AS doc_id", "0 AS piece", "0L AS start", "cast(7 + id % 2 AS long) AS length", "'k' AS __extra").repartition(4)
    rows = packing.pack(pieces, 64, rows_per_rank=20).collect()
    assert len(rows) == 500 and len({r.doc_id for r in rows}) == 500
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append(r)
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert len(seqs) == packing.least_bins({7: 250, 8: 250}, 64)


def test_the_query_on_nulls_repeats_and_extra_columns(spark, tmp_path):
    docs = [(None, "a", 1), (None, "a", 1), (3, "b" * 9000, 2), (3, "other", 2), (4, None, 3)]
    spark.createDataFrame(docs, "doc_id long, text string, length long").write.parquet(f"{tmp_path}/documents.parquet")
    rows = packing.op5_bin_completion(spark, str(tmp_path)).collect()
    assert rows[0].asDict().keys() >= {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
    assert sum(r.doc_id is None for r in rows) == 2 and sum(r.doc_id == 4 for r in rows) == 1
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
