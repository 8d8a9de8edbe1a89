import random

import numpy as np
import pytest

from playtide.llm import jpeg, jpeg_read


def canonical(lengths):
    """{symbol: (code, bits)} for {symbol: bits}, and the counts and symbols of a DHT segment."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    out, code, last = {}, 0, 0
    for s in order:
        code <<= lengths[s] - last
        last = lengths[s]
        out[s] = (code, last)
        code += 1
    return out, bytes([sum(v == n for v in lengths.values()) for n in range(1, 17)]), bytes(order)


DC = canonical({s: 4 for s in range(12)})
AC = canonical({0: 2, 0xF0: 6} | {(r << 4) | s: 9 for r in range(16) for s in range(1, 11)})


def bits_of(v):
    size = abs(v).bit_length()
    return size, v if v > 0 else v + (1 << size) - 1


def write_block(out, block, before):
    def put(table, symbol):
        code, n = table[symbol]
        out.append(f"{code:0{n}b}")

    size, raw = bits_of(block[0] - before)
    put(DC[0], size)
    if size:
        out.append(f"{raw:0{size}b}")
    run, last = 0, max((k for k in range(64) if block[k]), default=0)
    for k in range(1, 64):
        if k > last:
            put(AC[0], 0)
            break
        if block[k] == 0:
            run += 1
            continue
        while run > 15:
            put(AC[0], 0xF0)
            run -= 16
        size, raw = bits_of(block[k])
        put(AC[0], run << 4 | size)
        out.append(f"{raw:0{size}b}")
        run = 0


def packed(bits):
    s = "".join(bits)
    s += "1" * (-len(s) % 8)
    return int(s, 2).to_bytes(len(s) // 8, "big").replace(b"\xff", b"\xff\x00") if s else b""


def segment(marker, body):
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def picture(rng, width, height, factors, quant, restart=0, separate=False):
    """A baseline file of random coefficients, and its first component's dequantised DC means."""
    hm, vm = max(h for h, _ in factors), max(v for _, v in factors)
    wide, high = -(-width // (8 * hm)), -(-height // (8 * vm))
    grids = []
    for h, v in factors:
        grid = np.zeros((high * v, wide * h, 64), dtype=int)
        grid[:, :, 0] = [[rng.randint(-60, 60) for _ in range(wide * h)] for _ in range(high * v)]
        for _ in range(grid.shape[0] * grid.shape[1]):
            grid[rng.randrange(grid.shape[0]), rng.randrange(grid.shape[1]), rng.choice([1, 5, 20, 40, 63])] = rng.choice([-300, -2, -1, 1, 3, 500])
        grids.append(grid)
    parts = [(c + 1, *f) for c, f in enumerate(factors)]
    head = b"\xff\xd8" + segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0") + segment(0xDB, bytes([0, quant] + [9] * 63))
    head += segment(0xC0, bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(parts)]) + b"".join(bytes([i, h << 4 | v, 0]) for i, h, v in parts))
    head += segment(0xC4, b"\x00" + DC[1] + DC[2]) + segment(0xC4, b"\x10" + AC[1] + AC[2])
    if restart:
        head += segment(0xDD, restart.to_bytes(2, "big"))

    def scan(which):
        alone = len(which) == 1
        if alone:
            h, v = factors[which[0]]
            cols, rows = -(-(-(-width * h // hm)) // 8), -(-(-(-height * v // vm)) // 8)
            units = [[(which[0], y, x)] for y in range(rows) for x in range(cols)]
        else:
            units = [[(c, uy * factors[c][1] + y, ux * factors[c][0] + x) for c in which for y in range(factors[c][1]) for x in range(factors[c][0])] for uy in range(high) for ux in range(wide)]
        data, out, last, n = b"", [], {}, 0
        for k, unit in enumerate(units):
            if restart and k and k % restart == 0:
                data += packed(out) + bytes([0xFF, 0xD0 + n % 8])
                out, last, n = [], {}, n + 1
            for c, y, x in unit:
                write_block(out, grids[c][y, x].tolist(), last.get(c, 0))
                last[c] = int(grids[c][y, x, 0])
        return segment(0xDA, bytes([len(which)]) + b"".join(bytes([c + 1, 0]) for c in which) + b"\x00\x3f\x00") + data + packed(out)

    body = b"".join(scan([c]) for c in reversed(range(len(parts)))) if separate else scan(list(range(len(parts))))
    h, v = factors[0]
    cols, rows = -(-(-(-width * h // hm)) // 8), -(-(-(-height * v // vm)) // 8)
    want = np.clip(np.rint(grids[0][:rows, :cols, 0] * quant / 8 + 128), 0, 255).astype(int)
    return head + body + b"\xff\xd9", want


CASES = [
    (40, 24, [(1, 1)], 7, 0, False), (33, 17, [(2, 2), (1, 1), (1, 1)], 16, 0, False), (70, 50, [(2, 1), (1, 1), (1, 1)], 3, 2, False),
    (9, 9, [(1, 1), (1, 1), (1, 1)], 1, 1, False), (50, 30, [(2, 2), (1, 1), (1, 1)], 5, 3, True), (17, 65, [(1, 2), (1, 1)], 11, 0, True),
]


@pytest.mark.parametrize("case", CASES)
def test_ordinary_files(case):
    data, want = picture(random.Random(repr(case)), *case)
    width, height, thumb = jpeg_read.luminance(data)
    assert (width, height) == case[:2] and thumb.tolist() == want.tolist()


def test_files_of_the_media_writer():
    texts = [b"hello world " * 40, b"x"]
    for data, text in zip(jpeg.encode([jpeg.pad(t) for t in texts]), texts, strict=True):
        payload, dc = jpeg.decode([data])[0]
        assert payload == jpeg.pad(text)
        width, height, thumb = jpeg_read.luminance(data)
        assert thumb.shape == (height // 8, width // 8) == dc.shape


def test_thumbnails_of_a_table(spark):
    data, want = picture(random.Random(3), 40, 40, [(1, 1)], 9)
    rows = [(1, data), (2, None), (3, b""), (4, data[:-40]), (5, b"\xff\xd8\xff\xc2\x00\x02"), (6, data), (None, data), (7, b"\xff\xd8")]
    df = spark.createDataFrame([(i, bytearray(d) if d is not None else None, "x") for i, d in rows], "doc_id long, media binary, width string").repartition(2)
    got = {r.doc_id: (r.width, r.height, r.thumb_hash, r.thumb) for r in jpeg_read.thumbnails(df).collect()}
    assert got[1] == got[6] == got[None] == (40, 40, jpeg.thumbnail_hash(want), bytes(bytearray(want.reshape(-1).tolist())))
    assert all(got[i] == (None, None, None, None) for i in (2, 3, 5, 7)) and got[4][0] is None
    assert jpeg_read.thumbnails(df.limit(0)).count() == 0
