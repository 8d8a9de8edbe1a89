import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from playtide.llm import bpe_replay

from .test_tokens import NASTY, fuzz


@pytest.fixture(scope="module")
def ranks():
    return bpe_replay.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_are_the_library_s(ranks, library, corpus):
    rng = random.Random(3)
    odd = ["".join(chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(0x400, 0x3000), rng.randrange(0x1F300, 0x1F700)])) for _ in range(40)) for _ in range(400)]
    runs = ["a" * n for n in range(1, 60)] + [" " * n + "x" for n in range(40)] + ["-" * n for n in range(1, 90)] + ["abab" * 30, "\n" * 33]
    texts = [t or "" for _, t in corpus] + NASTY + fuzz(3000) + odd + runs
    encoder = bpe_replay.CorpusEncoder(bpe_replay.MergeReplay(ranks), public_tokenizers.PATTERN)
    for t, w in zip(texts, encoder.block(texts), strict=True):
        ids = [i for n in w.tolist() for i in encoder.ids[n]]
        assert ids == library.encode_ordinary(t), repr(t)
        assert b"".join(encoder.bytes[n] for n in w.tolist()) == t.encode()


def test_random_ranks():
    """Small random vocabularies, where low ranks can turn up late, against a word-by-word merge."""
    rng = random.Random(8)
    for _ in range(40):
        tokens = {bytes([b]) for b in range(256)}
        pool = [b"a", b"b", b"c"]
        for _ in range(25):
            t = rng.choice(pool) + rng.choice(pool)
            pool.append(t)
            tokens.add(t)
        tail = sorted(t for t in tokens if len(t) > 1)
        tail.sort(key=len)
        ranks = {t: i for i, t in enumerate([bytes([b]) for b in range(256)] + tail)}
        words = [bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 25))) for _ in range(60)]
        library = tiktoken.Encoding("r", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        got = bpe_replay.MergeReplay(ranks).encode(words)
        assert got == [library.encode_ordinary(w.decode()) for w in words]


def test_query_form(spark, frame, corpus, library):
    got = {r.doc_id: r for r in bpe_replay.encode_digests(frame, block=2000).collect()}
    assert set(got) == {i for i, _ in corpus}
    for i, t in corpus:
        ids = library.encode_ordinary(t or "")
        r = got[i]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    rows = bpe_replay.encode(frame).filter("doc_id = 3").collect()
    assert rows[0].decoded.decode() == corpus[3][1]


def test_empty_table(spark):
    assert bpe_replay.encode_digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0
