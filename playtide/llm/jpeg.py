"""Baseline JPEG media columns: bytes kept without loss as quantised coefficients.

A payload of 192-byte groups becomes a baseline image of three full-size components: each group
is one minimum coded unit, each byte one coefficient (every quantiser is 1).  Bytes map to
non-zero values, the most frequent in text to the smallest, so no run of zeros and no early end
of block occurs.  A restart marker follows every unit; units can then be decoded side by side,
and a lost byte costs one unit.

Reading parses the markers, takes the tables from the file and Huffman-decodes all units in
lockstep, one symbol of each at a time.  The luminance DC values are the thumbnail; its size and
a difference hash are the feature.  `decode_scan` takes any scan of this layout (tables as the
file has them, restart after every unit).

Defined results: a null or empty text is one group of spaces; equal texts give equal files and
values; an empty table gives no rows; extra columns are ignored; very long texts become taller
images, as wide as the 65,535-pixel limit asks.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from playtide.llm.common import chunked, read_table, record_batch, shared_path, take, texts

GROUP = 192
PAD = 32
MAX_UNITS = 8191  # a side has at most 65,535 pixels, 8 a unit
#: Bytes by how common they are in text; the rest follow in numeric order.
COMMON = b" etanoirshdlucmfgpwybvkxjqz.,\xc3\n-TAISEROHNDLWCMBFGPUYV'\"KJXQZ0123456789\xa9\xa8\xa4\xbc\xb6\xa0\xaa!*#%$&"
#: Code lengths of the size categories 1..8 (Kraft sum below one; no code is all ones).
CODE_LENGTHS = {1: 3, 2: 2, 3: 2, 4: 3, 5: 4, 6: 5, 7: 6, 8: 7}


def byte_values() -> np.ndarray:
    """Coefficient of each byte: ranks in pairs of a negative and a positive value of rising size."""
    order = list(dict.fromkeys(COMMON + bytes(range(256))))
    value = np.zeros(256, dtype=np.int64)
    for rank, b in enumerate(order):
        value[b] = (rank // 2 + 1) * (-1 if rank % 2 else 1)
    return value


VALUES = byte_values()
BYTES = np.zeros(512, dtype=np.uint8)
BYTES[VALUES + 256] = np.arange(256)


def canonical(lengths: dict[int, int]) -> tuple[list[int], list[int]]:
    """JPEG table (counts by length 1..16, symbols) for symbol -> code length."""
    symbols = sorted(lengths, key=lambda s: (lengths[s], s))
    return [sum(lengths[s] == n for s in symbols) for n in range(1, 17)], symbols


def codes(counts: list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length), as the standard assigns them."""
    out, code, at = {}, 0, 0
    for n, k in enumerate(counts, 1):
        for s in symbols[at : at + k]:
            out[s] = code, n
            code += 1
        at += k
        code <<= 1
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


TABLE = canonical(CODE_LENGTHS)
_CODES = codes(*TABLE)
#: Bits and their number for each byte: the size's code, then the value's low bits.
_SIZE = np.array([int(abs(v)).bit_length() for v in VALUES], dtype=np.int64)
_WORD = np.array([(_CODES[int(s)][0] << int(s)) | (int(v) if v > 0 else int(v) + (1 << int(s)) - 1) for v, s in zip(VALUES, _SIZE, strict=True)], dtype=np.int64)
_BITS = np.array([_CODES[int(s)][1] + int(s) for s in _SIZE], dtype=np.int64)


def shape(units: int) -> tuple[int, int]:
    """Units across and down; the last row may be filled up."""
    across = max(math.isqrt(units), -(-units // MAX_UNITS))
    return across, -(-units // across)


def _header(across: int, down: int, units: int) -> bytes:
    table = bytes(TABLE[0]) + bytes(TABLE[1])
    frame = bytes([8]) + (8 * down).to_bytes(2, "big") + (8 * across).to_bytes(2, "big") + b"\x03" + b"".join(bytes([c, 0x11, 0]) for c in (1, 2, 3))
    return (
        b"\xff\xd8"
        + _segment(0xFE, b"units " + str(units).encode())
        + _segment(0xDB, b"\0" + b"\1" * 64)
        + _segment(0xC0, frame)
        + _segment(0xC4, b"\x00" + table + b"\x10" + table)
        + _segment(0xDD, (1).to_bytes(2, "big"))
        + _segment(0xDA, b"\x03" + b"\x01\0\x02\0\x03\0" + b"\0\x3f\0")
    )


def encode_units(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of whole units (stuffed, without restart markers) and each unit's size."""
    n = len(data) // GROUP
    bits = _BITS[data]
    per = bits.reshape(n, GROUP).sum(axis=1)
    room = -(-per // 8)
    start = np.cumsum(bits) - bits
    start += np.repeat((np.cumsum(room) - room) * 8 - (np.cumsum(per) - per), GROUP)
    # each code fits in 24 bits from the byte it starts in: add it up in three byte planes
    total = int(room.sum())
    shifted = _WORD[data] << (24 - bits - (start & 7))
    at = start >> 3
    plane = np.zeros(total + 3, dtype=np.int64)
    for k in range(3):
        plane[: total + 3] += np.bincount(at + k, weights=(shifted >> (16 - 8 * k)) & 255, minlength=total + 3).astype(np.int64)
    raw = plane[:total].astype(np.uint8)
    fill = room * 8 - per  # ones up to the byte's end
    raw[np.cumsum(room) - 1] |= ((1 << fill) - 1).astype(np.uint8)
    stuffed = raw == 0xFF
    width = 1 + stuffed.astype(np.int64)
    out = np.zeros(int(width.sum()), dtype=np.uint8)
    out[np.cumsum(width) - width] = raw
    return out, np.add.reduceat(width, np.cumsum(room) - room)


def encode(payloads: list[bytes]) -> list[bytes]:
    """A JPEG file for each payload, whose sizes are positive multiples of GROUP."""
    units = [len(p) // GROUP for p in payloads]
    shapes = [shape(u) for u in units]
    filled = [p + bytes([PAD]) * (GROUP * (a * d - u)) for p, u, (a, d) in zip(payloads, units, shapes, strict=True)]
    body, sizes = encode_units(np.frombuffer(b"".join(filled), dtype=np.uint8))
    counts = np.array([a * d for a, d in shapes])
    first = np.repeat(np.cumsum(counts) - counts, counts)
    ordinal = np.arange(len(sizes)) - first
    last = np.zeros(len(sizes), dtype=bool)
    last[np.cumsum(counts) - 1] = True
    # a marker after each unit: restart 0..7 in turn, end of image after the last
    out = np.empty(len(body) + 2 * len(sizes), dtype=np.uint8)
    ends = np.cumsum(sizes) + 2 * np.arange(1, len(sizes) + 1)
    place = np.ones(len(out), dtype=bool)
    place[ends - 2] = place[ends - 1] = False
    out[place] = body
    out[ends - 2] = 0xFF
    out[ends - 1] = np.where(last, 0xD9, 0xD0 + ordinal % 8)
    blob = out.tobytes()
    stops = ends[np.cumsum(counts) - 1].tolist()
    starts = [0, *stops[:-1]]
    return [_header(a, d, u) + blob[i:j] for (a, d), u, i, j in zip(shapes, units, starts, stops, strict=True)]


def parse(data: bytes) -> dict:
    """Markers up to the scan: size, tables, restart interval, comment, and where the scan starts."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    found: dict = {"tables": {}, "quantisers": {}, "restart": 0, "units": None}
    at = 2
    while True:
        if data[at] != 0xFF:
            raise ValueError("a marker was expected")
        marker = data[at + 1]
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xC0:
            found["height"], found["width"] = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            found["components"] = [(body[6 + 3 * i], body[7 + 3 * i], body[8 + 3 * i]) for i in range(body[5])]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only baseline files are read")
        elif marker == 0xC4:
            i = 0
            while i < len(body):
                counts = list(body[i + 1 : i + 17])
                found["tables"][body[i]] = counts, list(body[i + 17 : i + 17 + sum(counts)])
                i += 17 + sum(counts)
        elif marker == 0xDB:
            i = 0
            while i < len(body):
                wide = body[i] >> 4
                found["quantisers"][body[i] & 15] = body[i + 1 : i + 1 + 64 * (1 + wide)]
                i += 1 + 64 * (1 + wide)
        elif marker == 0xDD:
            found["restart"] = int.from_bytes(body, "big")
        elif marker == 0xFE and body.startswith(b"units "):
            found["units"] = int(body[6:])
        elif marker == 0xDA:
            found["scan"] = at
            return found


def lookup(counts: list[int], symbols: list[int]) -> np.ndarray:
    """For every 16 bits ahead: value of the coefficient + 32768, times 32, plus the bits it takes.

    Symbols that are not a plain size (runs, end of block) or do not fit in 16 bits give 0.
    """
    out = np.zeros(1 << 16, dtype=np.int64)
    for s, (code, n) in codes(counts, symbols).items():
        if not 1 <= s <= 10 or n + s > 16:
            continue
        raw = np.arange(1 << s)
        value = np.where(raw >> (s - 1), raw, raw - (1 << s) + 1)
        entry = (value + 32768) * 32 + n + s
        base = code << (16 - n)
        out[base : base + (1 << (16 - n))] = np.repeat(entry, 1 << (16 - n - s))
    return out


def decode_scan(scan: bytes, dc: np.ndarray, ac: np.ndarray) -> np.ndarray:
    """Coefficients (units, GROUP) of scans laid end to end, each unit closed by a marker."""
    b = np.frombuffer(scan, dtype=np.uint8)
    mark = np.flatnonzero(b[:-1] == 0xFF)
    stuffing = mark[b[mark + 1] == 0] + 1
    ends = mark[b[mark + 1] >= 0xD0]
    keep = np.ones(len(b), dtype=bool)
    keep[stuffing] = False
    keep[ends] = keep[ends + 1] = False
    clean = np.concatenate((b[keep], np.zeros(4, dtype=np.uint8))).astype(np.uint32)
    shift = np.cumsum(~keep)
    starts = np.concatenate(([0], ends[:-1] + 2))
    first = starts - np.where(starts > 0, shift[starts - 1], 0)
    ahead = (clean[:-3] << np.uint32(24)) | (clean[1:-2] << np.uint32(16)) | (clean[2:-1] << np.uint32(8)) | clean[3:]
    at = first.astype(np.int64) * 8
    out = np.empty((GROUP, len(at)), dtype=np.int16)
    for k in range(GROUP):
        peek = (ahead[at >> 3] >> (16 - (at & 7)).astype(np.uint32)) & np.uint32(0xFFFF)
        entry = (dc if k % 64 == 0 else ac)[peek]
        if not entry.all():
            raise ValueError("the scan holds a symbol outside this layout")
        out[k] = (entry >> 5) - 32768
        at = at + (entry & 31)
    return out.T


def decode(files: list[bytes]) -> list[tuple[bytes, np.ndarray]]:
    """(payload, luminance DC thumbnail) of each file."""
    heads = [parse(f) for f in files]
    out: list = [None] * len(files)
    by_table: dict = {}
    for i, h in enumerate(heads):
        if h["restart"] != 1 or len(h["components"]) != 3 or any(c[1] != 0x11 for c in h["components"]):
            raise ValueError("three full-size components, restarted after every unit, are read here")
        by_table.setdefault(repr((h["tables"][0x00], h["tables"][0x10])), []).append(i)
    for members in by_table.values():
        tables = heads[members[0]]["tables"]
        found = decode_scan(b"".join(files[i][heads[i]["scan"] :] for i in members), lookup(*tables[0x00]), lookup(*tables[0x10]))
        at = 0
        for i in members:
            h = heads[i]
            across, down = h["width"] // 8, h["height"] // 8
            own = found[at : at + across * down]
            at += across * down
            units = own[: h["units"]] if h["units"] is not None else own
            out[i] = BYTES[units.reshape(-1).astype(np.int64) + 256].tobytes(), own[:, 0].reshape(down, across)
    return out


def thumbnail_hash(thumb: np.ndarray) -> str:
    """64-bit difference hash of the thumbnail, taken at 8 x 9 places."""
    rows = (np.arange(8) * thumb.shape[0]) // 8
    cols = (np.arange(9) * thumb.shape[1]) // 9
    small = thumb[np.ix_(rows, cols)].astype(np.int64)
    if thumb.shape[1] < 9:  # too narrow for differences along rows: take them down a column of the flat image
        flat = thumb.reshape(-1).astype(np.int64)
        small = flat[(np.arange(72) * len(flat)) // 72].reshape(8, 9)
    bits = (small[:, 1:] > small[:, :-1]).reshape(-1)
    return np.packbits(bits).tobytes().hex()


def pad(data: bytes) -> bytes:
    return data + bytes([PAD]) * (-len(data) % GROUP if data else GROUP)


def media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text as a JPEG file."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches):
            data = texts(batch.column("text"))
            yield record_batch(schema, {"doc_id": batch.column("doc_id"), "n_bytes": [len(t) for t in data], "media": encode([pad(t) for t in data])})

    return take(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def features(stored: DataFrame) -> DataFrame:
    """Payload digests and features from stored files: stored(doc_id, n_bytes, media)."""
    names = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}
    schema = pa.schema(list(names.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, column="media"):
            files = batch.column("media").to_pylist()
            out = {n: [] for n in names}
            for f, (payload, thumb) in zip(files, decode(files), strict=True):
                out["payload_bytes"].append(len(payload))
                out["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
                out["tail_crc32"].append(zlib.crc32(payload[-16:]))
                out["media_bytes"].append(len(f))
                out["media_sha256"].append(hashlib.sha256(f).hexdigest())
                out["feature"].append(f"{8 * thumb.shape[1]}x{8 * thumb.shape[0]}:{thumbnail_hash(thumb)}")
            yield record_batch(schema, out | {"doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes")})

    ddl = ", ".join(f"{n} {'string' if t == pa.string() else 'long'}" for n, t in names.items())
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, ddl)


def store(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write media() as Parquet; the files are entropy-coded already, so columns are not compressed again."""
    media(docs, id_col, text_col).write.option("compression", "none").parquet(path)


def op8_jpeg_media(spark, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "media")
    store(read_table(spark, sf_dir, "documents"), path)
    return features(spark.read.schema("doc_id long, n_bytes long, media binary").parquet(path))
