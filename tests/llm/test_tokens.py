import base64
import glob
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.orc
import pytest
from tokenizers import Tokenizer

from playtide.llm import orc_tokens
from playtide.llm.tokens import PieceEncoder

NASTY = ["", " ", "  ", "a  b", " a", "a ", "a\n b", "a \n  b\t c", "x  y", "  z", "\x1c q", "it's  we'll", "<|endoftext|> <|startoftext|> </w>", "é é  ́x", "日本 語  😀 \n\n\n k", "A​ B", "Σίσυφος ΣΑΣ", "a\x00 b", "\r\n \r\n x", "ﬁ ½ ² İ", "   lead", "trail   ", "tab\t\tx  \ty", "ab.\nCd", "ab.\n\nCd", "x\n-y z\n", "\nab c", "12a3,b4 ½x", "don't a'b", "É.É ÀB­c", "ab.\n cd", "İx ŉ ǅ", "a\u0301.b e\u0301"]


def fuzz(n):
    rng = random.Random(9)
    return ["".join(rng.choice("ab  \n\t \x1c'sé́12.! 😀") for _ in range(rng.randint(0, 30))) for _ in range(n)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_give_the_library_s_ids(name, corpus):
    path = public_tokenizers.path(name)
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    texts = [x or "" for _, x in corpus] + NASTY + fuzz(3000)
    want = [e.ids + [7] for e in t.encode_batch(texts, add_special_tokens=False)]
    for limit in (400_000, 5):
        encoder = PieceEncoder(path, name.startswith("word"), limit, 3 * limit)
        got = []
        for i in range(0, len(texts), 500):
            ids, n = encoder.encode(texts[i : i + 500], 7)
            got += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
        for text, a, b in zip(texts, got, want, strict=True):
            assert a == b, repr(text)


def test_orc_round_trip(spark, frame, corpus, tmp_path):
    path = f"file://{tmp_path}/t"
    orc_tokens.write(frame, path, files=3)
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    want, at = {}, 0
    for i, text in sorted(corpus):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        want[i] = (at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        at += len(ids)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in orc_tokens.summary(orc_tokens.read(spark, path)).collect()}
    assert got == want
    files = sorted(glob.glob(f"{tmp_path}/t/*.orc"))
    assert len(files) == 3 and pyarrow.orc.ORCFile(files[0]).nstripes >= 1
    order = [x for f in files for x in pyarrow.orc.read_table(f)["doc_id"].to_pylist()]
    assert order == sorted(order)
    hit = orc_tokens.read(spark, path).filter("doc_id = 3")
    assert hit.count() == 1 and "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,3)]" in hit._jdf.queryExecution().executedPlan().toString().replace("\n", "")


def test_empty_and_repeated(spark, tmp_path):
    orc_tokens.write(spark.createDataFrame([], "doc_id long, text string"), f"file://{tmp_path}/e")
    assert orc_tokens.summary(orc_tokens.read(spark, f"file://{tmp_path}/e")).count() == 0
    orc_tokens.write(spark.createDataFrame([(4, "a b"), (4, "a b"), (1, None)], "doc_id long, text string"), f"file://{tmp_path}/r")
    rows = sorted((r.doc_id, r.start, r.n_tokens) for r in orc_tokens.summary(orc_tokens.read(spark, f"file://{tmp_path}/r")).collect())
    assert rows == [(1, 0, 1), (4, 1, 3), (4, 4, 3)]


def test_path_is_a_parameter(spark, frame):
    assert base64.b64encode(b"x")
    rows = orc_tokens.encode(frame, tokenizer=public_tokenizers.path("byte_bpe_50k.json"), end=0).filter("doc_id = 68").collect()
    assert rows[0].ids[-1] == 0
