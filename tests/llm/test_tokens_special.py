import json
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from playtide.llm import orc_tokens, packing
from playtide.llm.tokens import PieceEncoder, cuts

from .test_tokens import NASTY, fuzz

MARKED = ["hello <|endoftext|> world", "<|endoftext|>", "a<|startoftext|>b", "<|ENDOFTEXT|> x", "<|endoftext|><|endoftext|>", "  <|endoftext|>  y", "<|endoftext| >", "x <|startoftext|>", "\n<|endoftext|>\nz"]


def ids_of(encoder, texts, end):
    got = []
    for i in range(0, len(texts), 100):
        ids, n = encoder.encode(texts[i : i + 100], end)
        got += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
    return got


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_of_an_unmodified_tokenizer(name, corpus):
    path = public_tokenizers.path(name)
    texts = [x or "" for _, x in corpus] + NASTY + MARKED + fuzz(1000) + MARKED[:2]
    random.Random(2).shuffle(texts)
    want = [e.ids + [7] for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    for limits in ({}, {"pieces": 5, "runs": 15}):
        for text, a, b in zip(texts, ids_of(PieceEncoder(path, special=True, **limits), texts, 7), want, strict=True):
            assert a == b, repr(text)


def test_other_tokenizers_encode_whole(tmp_path):
    """A file whose pattern may span white space, and one with an added token that may match anywhere."""
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    assert cuts(spec) == "space"
    spanning = spec | {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": False}}
    plain = spec | {"added_tokens": [*spec["added_tokens"], {"id": 50257, "content": "the end", "single_word": False, "lstrip": False, "rstrip": False, "normalized": True, "special": False}]}
    texts = [*MARKED, "the end of the end", "a  b c", "", " x"]
    for k, other in enumerate((spanning, plain)):
        assert cuts(other) == "whole"
        path = str(tmp_path / f"{k}.json")
        with open(path, "w", encoding="utf-8") as f:
            json.dump(other, f)
        want = [e.ids + [0] for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
        assert ids_of(PieceEncoder(path, special=True), texts, 0) == want
    with pytest.raises(ValueError):
        PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"), True)


def test_operators_recognise_special_tokens(spark):
    docs = spark.createDataFrame(list(enumerate(MARKED)), "doc_id long, text string")
    word, byte = (Tokenizer.from_file(public_tokenizers.path(f"{n}.json")) for n in ("word_bpe_49k", "byte_bpe_50k"))
    got = {r.doc_id: r.ids for r in orc_tokens.encode(docs).collect()}
    assert got == {i: [*word.encode(t, add_special_tokens=False).ids, 2] for i, t in enumerate(MARKED)}
    got = {r.doc_id: r.length for r in packing.cut(docs).collect()}
    assert got == {i: len(byte.encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(MARKED)}


def test_tables_are_given_back_when_idle_and_not_before(corpus):
    import time

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [x or "" for _, x in corpus]
    encoder = PieceEncoder.shared(path)
    want = ids_of(encoder, texts, 0)
    PieceEncoder.rest(0.2)
    assert PieceEncoder.shared(path) is encoder and encoder.pieces
    time.sleep(0.5)
    assert encoder.pieces  # a task has it
    PieceEncoder.rest(0.1)
    time.sleep(0.5)
    assert not encoder.pieces and not encoder.runs
    assert ids_of(PieceEncoder.shared(path), texts, 0) == want
