"""Dimensions and luminance thumbnails of ordinary baseline JPEG files.

Any number of components and sampling factors, one scan or several, restart intervals, end of
block and zero runs, DC prediction and quantisers are read.  Only the DC coefficients of the first
component are kept: dequantised, each is the mean of an 8 x 8 block, which makes the thumbnail.

Defined results: null, empty or damaged bytes and files that are not baseline give null
dimensions and no hash; repeated rows give equal results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtide.llm.common import chunked, record_batch
from playtide.llm.jpeg import codes, thumbnail_hash


def _symbols(counts: list[int], symbols: list[int]) -> list[int]:
    """For every 16 bits ahead: the symbol times 32, plus the bits of its code; -1 where there is no code."""
    out = np.full(1 << 16, -1, dtype=np.int64)
    for s, (code, n) in codes(counts, symbols).items():
        base = code << (16 - n)
        out[base : base + (1 << (16 - n))] = s * 32 + n
    return out.tolist()


class _Bits:
    """Bits of one restart segment, stuffing removed."""

    def __init__(self, data: bytes):
        self.data = data.replace(b"\xff\x00", b"\xff") + b"\xff" * 8
        self.end = 8 * (len(self.data) - 8)
        self.at = 0

    def symbol(self, table: list[int]) -> int:
        byte, bit = self.at >> 3, self.at & 7
        d = self.data
        entry = table[((d[byte] << 16 | d[byte + 1] << 8 | d[byte + 2]) >> (8 - bit)) & 0xFFFF]
        if entry < 0 or self.at >= self.end:
            raise ValueError("damaged scan")
        self.at += entry & 31
        return entry >> 5

    def number(self, size: int) -> int:
        """A signed number of `size` bits."""
        if not size:
            return 0
        byte = self.at >> 3
        window = int.from_bytes(self.data[byte : byte + 4], "big")
        raw = (window >> (32 - (self.at & 7) - size)) & ((1 << size) - 1)
        self.at += size
        return raw if raw >> (size - 1) else raw - (1 << size) + 1


def _segments(data: bytes, at: int) -> tuple[list[bytes], int]:
    """The restart segments of the scan that begins there, and where the next marker stands."""
    out, start = [], at
    while True:
        at = data.index(b"\xff", at)
        marker = data[at + 1]
        if marker == 0x00:
            at += 2
        elif 0xD0 <= marker <= 0xD7:
            out.append(data[start:at])
            at = start = at + 2
        elif marker == 0xFF:
            at += 1
        else:
            out.append(data[start:at])
            return out, at


def luminance(data: bytes) -> tuple[int, int, np.ndarray]:
    """Width, height, and the mean of each 8 x 8 block of the first component."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    tables: dict[int, list[int]] = {}
    quantisers: dict[int, int] = {}
    parts: list[tuple[int, int, int, int]] = []  # id, across, down, quantiser
    width = height = restart = 0
    at = 2
    while True:
        while data[at + 1] == 0xFF:
            at += 1
        marker = data[at + 1]
        if data[at] != 0xFF or marker == 0xD9:
            raise ValueError("the first component has no scan")
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xC0:
            height, width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only baseline files are read")
        elif marker == 0xC4:
            i = 0
            while i < len(body):
                counts = list(body[i + 1 : i + 17])
                tables[body[i]] = _symbols(counts, list(body[i + 17 : i + 17 + sum(counts)]))
                i += 17 + sum(counts)
        elif marker == 0xDB:
            i = 0
            while i < len(body):
                wide = body[i] >> 4
                quantisers[body[i] & 15] = int.from_bytes(body[i + 1 : i + 2 + wide], "big")  # that of the DC coefficient comes first
                i += 1 + 64 * (1 + wide)
        elif marker == 0xDD:
            restart = int.from_bytes(body, "big")
        elif marker == 0xDA:
            if not parts or not width or not height:
                raise ValueError("a scan without a frame")
            chosen = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            segments, at = _segments(data, at)
            if parts[0][0] in chosen:
                dc = _scan(segments, [(i, p, chosen[p[0]]) for i, p in enumerate(parts) if p[0] in chosen], parts, tables, restart, width, height)
                return width, height, np.clip(np.rint(dc * quantisers[parts[0][3]] / 8 + 128), 0, 255).astype(np.int64)


def _scan(segments: list[bytes], chosen: list, parts: list, tables: dict[int, list[int]], restart: int, width: int, height: int) -> np.ndarray:
    """DC coefficients of the first component's blocks."""
    most_across, most_down = max(p[1] for p in parts), max(p[2] for p in parts)
    _, across, down, _ = parts[0]
    cols, rows = -(-(-(-width * across // most_across)) // 8), -(-(-(-height * down // most_down)) // 8)
    alone = len(chosen) == 1
    wide, high = (cols, rows) if alone else (-(-width // (8 * most_across)), -(-height // (8 * most_down)))
    out = np.zeros((rows, cols), dtype=np.int64)
    todo = iter(segments)
    bits, last = _Bits(next(todo)), {}
    for unit in range(wide * high):
        if restart and unit and unit % restart == 0:
            bits, last = _Bits(next(todo)), {}
        for i, (_, h, v, _), which in chosen:
            dc, ac = tables[which >> 4], tables[16 + (which & 15)]
            for k in range(1 if alone else h * v):
                size = bits.symbol(dc)
                if size > 11:
                    raise ValueError("damaged scan")
                last[i] = last.get(i, 0) + bits.number(size)
                if i == 0:
                    y, x = (unit // wide, unit % wide) if alone else (unit // wide * v + k // h, unit % wide * h + k % h)
                    if y < rows and x < cols:
                        out[y, x] = last[i]
                n = 1
                while n < 64:
                    s = bits.symbol(ac)
                    if s == 0:  # end of block
                        break
                    n += (s >> 4) + 1  # a run of sixteen zeros has no bits
                    bits.number(s & 15)
    return out


def thumbnails(images: DataFrame, id_col: str = "doc_id", data_col: str = "media") -> DataFrame:
    """(doc_id, width, height, thumb binary, thumb_hash) of images(id, bytes): the thumbnail row by row, a byte a block."""
    schema = pa.schema([("doc_id", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("thumb", pa.binary()), ("thumb_hash", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, column="media"):
            out = {n: [] for n in schema.names[1:]}
            for data in batch.column("media").to_pylist():
                try:
                    width, height, thumb = luminance(data or b"")
                    row = (width, height, thumb.astype(np.uint8).tobytes(), thumbnail_hash(thumb))
                except (ValueError, IndexError, KeyError, StopIteration):
                    row = (None, None, None, None)
                for n, x in zip(out, row, strict=True):
                    out[n].append(x)
            yield record_batch(schema, out | {"doc_id": batch.column("doc_id")})

    rows = images.select(F.col(id_col).cast("long").alias("doc_id"), F.col(data_col).cast("binary").alias("media"))
    return rows.mapInArrow(run, "doc_id long, width int, height int, thumb binary, thumb_hash string")
