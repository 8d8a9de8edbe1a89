import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from playtide.llm import packing


def bins_of(plan):
    return [[x for x, k in p for _ in range(k)] for p, m in plan for _ in range(m)]


def optimum(lengths, capacity):
    lengths = sorted(lengths, reverse=True)
    for n in itertools.count(-(-sum(lengths) // capacity)):
        room = [capacity] * n

        def place(i):
            if i == len(lengths):
                return True
            for j in range(n):
                if room[j] >= lengths[i] and room[j] not in room[:j]:
                    room[j] -= lengths[i]
                    if place(i + 1):
                        return True
                    room[j] += lengths[i]
            return False

        if place(0):
            return n


def least_bins(lengths, capacity):
    """Lower bound: pieces over half, and what is left of the middle ones beside the large (Martello and Toth)."""
    best = -(-sum(lengths) // capacity)
    for k in range(capacity // 2 + 1):
        big = [x for x in lengths if x > capacity - k]
        half = [x for x in lengths if capacity // 2 < x <= capacity - k]
        small = sum(x for x in lengths if k <= x <= capacity // 2)
        best = max(best, len(big) + len(half) + max(0, -(-(small - (len(half) * capacity - sum(half))) // capacity)))
    return best


@pytest.mark.parametrize("seed", range(12))
def test_small_sets_are_optimal(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(1, 60) for _ in range(rng.randint(1, 13))]
    counts = {x: lengths.count(x) for x in set(lengths)}
    got = bins_of(packing.complete_bins(counts, 60))
    assert sorted(itertools.chain(*got)) == sorted(lengths) and max(map(sum, got)) <= 60
    assert len(got) == optimum(lengths, 60)


def test_large_sets_near_the_bound():
    rng = random.Random(4)
    lengths = [min(2048, int(rng.lognormvariate(6, 1)) + 1) for _ in range(20_000)]
    counts = {x: lengths.count(x) for x in set(lengths)}
    got = bins_of(packing.complete_bins(counts))
    assert sorted(itertools.chain(*got)) == sorted(lengths) and max(map(sum, got)) <= 2048
    assert len(got) <= -(-sum(lengths) // 2048) + 1


def test_equal_lengths_and_empty():
    assert sum(m for _, m in packing.complete_bins({1025: 1000})) == 1000
    assert sum(m for _, m in packing.complete_bins({1: 5000})) == 3
    assert packing.complete_bins({}) == []


@pytest.mark.parametrize("capacity", [2048, 64])
def test_pieces_and_places(frame, corpus, capacity):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    rows = packing.pack_documents(frame, capacity=capacity).collect()
    docs, seqs = {}, {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    assert set(docs) == {i for i, _ in corpus}
    for i, text in corpus:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        ps = sorted(docs[i], key=lambda r: r.piece)
        assert [p.piece for p in ps] == list(range(len(ps))) and (len(ps) == 1 or all(p.length == capacity for p in ps[1:]))
        assert len(ids) > capacity or len(ps) == 1
        at = 0
        for p in ps:
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    assert len(seqs) <= least_bins([r.length for r in rows], capacity) + 1


def test_empty_and_repeated(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = packing.pack_documents(spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "doc_id long, text string")).collect()
    assert len(rows) == 3 and len({(r.sequence_id, r.offset) for r in rows}) == 3
