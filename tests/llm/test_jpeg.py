import hashlib
import random
import zlib

import numpy as np
import pytest

from playtide.llm import jpeg


def bit_reader(scan):
    """One unit after another, bit by bit, as the standard describes it."""
    data, at = [], 0
    while True:
        unit = bytearray()
        while not (scan[at] == 0xFF and scan[at + 1] != 0):
            unit.append(scan[at])
            at += 2 if scan[at] == 0xFF else 1
        data.append(bytes(unit))
        if scan[at + 1] == 0xD9:
            return data
        at += 2


def slow_decode(file):
    h = jpeg.parse(file)
    tables = {k: {(n, c): s for s, (c, n) in jpeg.codes(*t).items()} for k, t in h["tables"].items()}
    out = []
    for unit in bit_reader(file[h["scan"] :]):
        bits = "".join(f"{b:08b}" for b in unit)
        at = 0
        for k in range(192):
            code, n = 0, 0
            while True:
                code, n, at = code * 2 + int(bits[at]), n + 1, at + 1
                s = tables[0x00 if k % 64 == 0 else 0x10].get((n, code))
                if s is not None:
                    break
            raw = int(bits[at : at + s], 2)
            at += s
            out.append(raw if raw >> (s - 1) else raw - (1 << s) + 1)
        assert set(bits[at:]) <= {"1"} and len(bits) - at < 8
    return out[: 192 * h["units"]]


def test_tables_are_valid():
    counts, symbols = jpeg.TABLE
    assert sum(k / 2**n for n, k in enumerate(counts, 1)) < 1 and sorted(symbols) == list(range(1, 9))
    assert len(set(jpeg.VALUES.tolist())) == 256 and 0 not in jpeg.VALUES and (jpeg.BYTES[jpeg.VALUES + 256] == np.arange(256)).all()


@pytest.mark.parametrize("seed", range(4))
def test_round_trip_and_slow_decoder(seed):
    rng = random.Random(seed)
    payloads = [jpeg.pad(bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 191, 192, 193, 800, 3000])))) for _ in range(12)] + [jpeg.pad(b"\xff\xd9\xff\x00" * 90)]
    files = jpeg.encode(payloads)
    back = jpeg.decode(files)
    assert [p for p, _ in back] == payloads
    for f, p, (_, thumb) in zip(files, payloads, back, strict=True):
        values = slow_decode(f)
        assert bytes(jpeg.BYTES[np.array(values) + 256]) == p
        units = len(p) // 192
        assert thumb.reshape(-1)[:units].tolist() == values[::192]
        assert f[:2] == b"\xff\xd8" and f[-2:] == b"\xff\xd9"


def test_shapes():
    for u in (1, 2, 3, 5, 100, 8192, 70_000, 10**6):
        a, d = jpeg.shape(u)
        assert u <= a * d < u + a and a <= jpeg.MAX_UNITS and d <= jpeg.MAX_UNITS


def test_damage_is_found():
    f = bytearray(jpeg.encode([jpeg.pad(b"abc" * 500)])[0])
    with pytest.raises(ValueError):
        jpeg.parse(bytes(f[1:]))


def test_query_form(spark, frame, corpus, tmp_path):
    jpeg.store(frame, f"file://{tmp_path}/m")
    rows = {r.doc_id: r for r in jpeg.features(spark.read.parquet(f"file://{tmp_path}/m")).collect()}
    assert set(rows) == {i for i, _ in corpus}
    by_text = {}
    for i, t in corpus:
        data = (t or "").encode()
        p = data + b" " * (-len(data) % 192 if data else 192)
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        f = jpeg.encode([p])[0]
        assert (r.media_bytes, r.media_sha256) == (len(f), hashlib.sha256(f).hexdigest())
        assert by_text.setdefault(t or "", (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)


def test_empty_table(spark):
    assert jpeg.features(jpeg.media(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
