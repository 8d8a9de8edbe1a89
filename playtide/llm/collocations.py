"""Phrase collocations: count-min sketches, an exact second pass over what survives, scores, subsumption.

The first pass adds every phrase of one to five words to two sketch rows and merges the rows of all
tasks.  A sketch can only overestimate, so a phrase that is frequent has a large cell in both rows.  The
second pass tests phrases level by level (a phrase only if the two phrases one word shorter passed) and
counts the survivors exactly, by their words and not by hashes: in blocks of text first, then by parts that
phrases are dealt to; those below the threshold go then.

The rows are as wide as the corpus asks for (min_bits to max_bits).  They are merged by ranges of
cells on the executors; only one bit a cell, whether it reached the threshold, folded to
2**min_bits, is collected and broadcast: 16 MB a row at most, at every size of the input.  Wider
corpora let more pass to the exact count; none is lost.

Defined results: a null text has no words; a null language is `und`, together with a language of that
name; repeated rows count each; words are compared by their bytes; long texts are cut at the ends
of pieces, which phrases never cross; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playtide.llm.common import materialise, read_table

MAX_WORDS = 5
MIN_BITS, MAX_BITS, PART_BITS = 27, 36, 22
#: Bytes of text that are counted at a time.
BLOCK = 4 << 20
_ENDS = b".,;:!?\n\x0b\x0c\r"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: 0 in words, 1 between them, 2 between pieces.
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[9, 32]] = 1
_KIND[list(_ENDS)] = 2
#: Multipliers of the sketch rows, and of the rolling phrase hash.
_ROWS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_ROLL = np.uint64(0xD6E8FEB86659FD93)
_SHIFT = np.uint64(32)


@dataclass
class Block:
    """Words of some texts: index into `words`, language, and whether the next word is in the same piece."""

    words: pa.Array
    index: np.ndarray
    lang: np.ndarray
    langs: list[str]
    joined: np.ndarray


def _pieces(text: bytes) -> Iterator[bytes]:
    """A long text in parts of about BLOCK bytes, cut behind ends of pieces."""
    start = 0
    while len(text) - start > BLOCK:
        cut = max(text.rfind(bytes([c]), start, start + BLOCK) for c in _ENDS)
        if cut < 0:
            found = [i for c in _ENDS if (i := text.find(bytes([c]), start + BLOCK)) >= 0]
            if not found:
                break
            cut = min(found)
        yield text[start : cut + 1]
        start = cut + 1
    yield text[start:]


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], list[bytes]]]:
    """Texts and their languages, about BLOCK bytes at a time."""
    langs, held, size = [], [], 0
    for batch in batches:
        names, texts = batch.column("lang").to_pylist(), batch.column("text").cast(pa.large_binary())
        for name, text in zip(names, texts, strict=True):
            for part in _pieces(text.as_py() or b""):
                langs.append(name)
                held.append(part)
                size += len(part) + 1
                if size >= BLOCK:
                    yield langs, held
                    langs, held, size = [], [], 0
    if held:
        yield langs, held


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for names, held in _gather(batches):
        data = _LOWER[np.frombuffer(b"\n".join(held) + b"\n", dtype=np.uint8)]
        kind = _KIND[data]
        word = kind == 0
        edge = np.flatnonzero(np.diff(np.r_[False, word].view(np.int8)))  # the data ends between words
        starts, ends = edge[::2], edge[1::2]
        if not len(starts):
            continue
        offsets = np.r_[0, np.cumsum(ends - starts)].astype(np.int32)
        words = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[word])]).dictionary_encode()
        piece = np.cumsum(kind == 2, dtype=np.int32)[starts]
        at = np.cumsum([0] + [len(x) + 1 for x in held])
        langs = list(dict.fromkeys(names))
        number = {x: i for i, x in enumerate(langs)}
        many = np.diff(np.searchsorted(starts, at))
        lang = np.repeat(np.array([number[x] for x in names], dtype=np.int32), many)
        yield Block(words.dictionary, words.indices.to_numpy().astype(np.int64), lang, langs, np.r_[piece[1:] == piece[:-1], False])


def _lang_hashes(block: Block) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(x.encode(), seed=1) for x in block.langs), dtype=np.uint64, count=len(block.langs))


def _hashes(block: Block) -> np.ndarray:
    """A hash of each word and its language."""
    own = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in block.words.to_pylist()), dtype=np.uint64, count=len(block.words))
    return own[block.index] ^ _lang_hashes(block)[block.lang]


def _roll(longer: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of phrases that are one word longer."""
    return (longer ^ (longer >> _SHIFT)) * _ROLL + word


def _cells(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    mixed = hashes >> _SHIFT
    mixed ^= hashes
    mixed *= _ROWS[row]
    mixed >>= np.uint64(64 - bits)
    return mixed


# -- first pass: the sketch


def pack(cells: np.ndarray, part_bits: int) -> Iterator[tuple[int, int, bytes]]:
    """Sorted cells by part, as differences in units of 1, 2 or 4 bytes; a full unit carries on."""
    if not len(cells):
        return
    kind = cells.dtype.type
    edges = np.flatnonzero(np.diff(cells >> kind(part_bits))) + 1
    first = np.r_[0, edges]
    steps = np.diff(cells, prepend=kind(0))
    steps[first] = cells[first] & kind((1 << part_bits) - 1)
    mean = steps.mean()
    unit = np.dtype(np.uint8 if mean < 64 else np.uint16 if mean < 16_384 else np.uint32)
    full = kind(np.iinfo(unit).max)
    over = np.flatnonzero(steps >= full)
    more = (steps[over] // full).astype(np.int64)
    steps[over] %= full
    out = np.insert(steps.astype(unit), np.repeat(over, more), full)
    begins = np.r_[first + np.r_[0, np.cumsum(more)][np.searchsorted(over, first)], len(out)]
    for i, k in enumerate(first):
        yield int(cells[k] >> kind(part_bits)), unit.itemsize, out[begins[i] : begins[i + 1]].tobytes()


def unpack(unit: int, blob: bytes) -> np.ndarray:
    """Cells of a part, from its first one on."""
    steps = np.frombuffer(blob, dtype=f"u{unit}")
    places = np.cumsum(steps, dtype=np.int64)
    return places[steps != np.iinfo(steps.dtype).max]


def _sketch(bits: int, part_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            word = _hashes(block)
            whole, held = np.flatnonzero(block.joined), [word]
            rolled = word
            for n in range(2, MAX_WORDS + 1):
                longer = np.zeros_like(word)
                longer[whole] = _roll(rolled[whole], word[whole + n - 1])
                held.append(longer[whole])
                rolled = longer
                inner = whole[whole + n - 1 < len(word)]
                whole = inner[block.joined[inner + n - 1]]
            hashes = np.concatenate(held)
            del held, rolled
            for row in range(len(_ROWS)):
                cells = _cells(hashes, row, bits)
                cells = cells.astype(np.uint32) if bits <= 32 else cells
                cells.sort()
                packed = list(pack(cells, part_bits))
                yield pa.RecordBatch.from_pydict({
                    "row": pa.array([row] * len(packed), pa.int32()), "part": pa.array([p for p, _, _ in packed], pa.int64()),
                    "unit": pa.array([u for _, u, _ in packed], pa.int32()), "cells": pa.array([b for _, _, b in packed], pa.binary()),
                })

    return run


def _merge(least: int, part_bits: int, fold: int):
    """Adds up the parts, which come sorted; of each, the bits of the cells that reach `least`."""
    width = 1 << part_bits

    def flush(counts: np.ndarray, held: list[np.ndarray]) -> None:
        if held:
            counts += np.bincount(np.concatenate(held), minlength=width).astype(np.int32)
            held.clear()

    def bits_of(key: tuple[int, int], counts: np.ndarray) -> pa.RecordBatch:
        heavy = (counts >= least).reshape(-1, 1 << fold).any(axis=1)
        return pa.RecordBatch.from_pydict({"row": pa.array([key[0]], pa.int32()), "part": pa.array([key[1]], pa.int64()), "heavy": pa.array([zlib.compress(np.packbits(heavy).tobytes(), 6)], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, counts, held, size = None, None, [], 0
        for batch in batches:
            for row, part, unit, blob in zip(*(batch.column(c).to_pylist() for c in ("row", "part", "unit", "cells")), strict=True):
                if (row, part) != key:
                    if key is not None:
                        flush(counts, held)
                        yield bits_of(key, counts)
                    key, counts, size = (row, part), np.zeros(width, dtype=np.int32), 0
                held.append(unpack(unit, blob))
                size += len(held[-1])
                if size >= width:
                    flush(counts, held)
                    np.minimum(counts, 1 << 30, out=counts)
                    size = 0
        if key is not None:
            flush(counts, held)
            yield bits_of(key, counts)

    return run


def sketch_bits(text_bytes: int) -> int:
    """A cell for each 16 bytes of text (some three phrases), within MIN_BITS and MAX_BITS."""
    return min(MAX_BITS, max(MIN_BITS, (text_bytes >> 4).bit_length()))


def heavy_cells(rows: DataFrame, least: int, bits: int, part_bits: int = PART_BITS) -> list[np.ndarray]:
    """Per sketch row one bit a cell, folded to 2**MIN_BITS: whether a cell under it reached `least`."""
    fold = bits - MIN_BITS
    sketched = rows.mapInArrow(_sketch(bits, part_bits), "row int, part long, unit int, cells binary")
    tasks = len(_ROWS) << min(bits - part_bits, 12)
    merged = sketched.repartition(tasks, "row", "part").sortWithinPartitions("row", "part").mapInArrow(_merge(least, part_bits, fold), "row int, part long, heavy binary")
    out = [np.zeros(1 << (MIN_BITS - 3), dtype=np.uint8) for _ in _ROWS]
    step = 1 << (part_bits - fold - 3)
    for r in merged.toLocalIterator():
        out[r.row][r.part * step : (r.part + 1) * step] = np.frombuffer(zlib.decompress(bytes(r.heavy)), dtype=np.uint8)
    return out


# -- second pass: exact counts of what survives


def _survives(hashes: np.ndarray, heavy: list[np.ndarray]) -> np.ndarray:
    """Places of the hashes that have a heavy cell in each row."""
    left = np.arange(len(hashes))
    for row, table in enumerate(heavy):
        cell = _cells(hashes[left], row, MIN_BITS)
        left = left[(table[cell >> np.uint64(3)] >> (np.uint64(7) - (cell & np.uint64(7))).astype(np.uint8)) & 1 == 1]
    return left


def _phrases(block: Block, first: np.ndarray, n: int) -> pa.Array:
    """Texts of the phrases of n words that begin at the given words."""
    columns = [block.words.take(pa.array(block.index[first + i])) for i in range(n)]
    return columns[0] if n == 1 else pc.binary_join_element_wise(*columns, pa.scalar(b" ", pa.binary()))


_COUNTED = "part int, lang array<string>, words array<int>, phrase array<string>, n array<bigint>"


def _summed(held: list[pa.Table], *by: str) -> pa.Table:
    out = pa.concat_tables(held).group_by(list(by)).aggregate([("n", "sum")])
    return out.select([*by, "n_sum"]).rename_columns([*by, "n"])


def _count(sent, parts: int, most_held: int = 600_000):
    """Exact counts of the survivors of some blocks, dealt to parts by the phrases' hash: a row a part."""

    def table(block: Block, found: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> pa.Table:
        n, first, many, hashes = (np.concatenate([f[i] for f in found]) for i in range(4))
        phrases = [_phrases(block, at, k[0]) if k[0] else pa.array([b""] * len(at), pa.binary()) for k, at, _, _ in found]
        columns = {
            "part": pa.array(((hashes * _ROWS[0] >> _SHIFT).astype(np.int64) % parts).astype(np.int32)),
            "lang": pa.array(block.langs, pa.string()).take(pa.array(block.lang[first])),
            "words": pa.array(n.astype(np.int32)), "phrase": pa.concat_arrays(phrases).cast(pa.string()), "n": pa.array(many.astype(np.int64)),
        }
        return pa.table(columns)

    def dealt(held: list[pa.Table]) -> pa.RecordBatch:
        whole = _summed(held, "part", "lang", "words", "phrase")
        order = np.argsort(whole["part"].to_numpy(), kind="stable")
        whole = whole.take(pa.array(order)).combine_chunks()
        named, begins = np.unique(whole["part"].to_numpy(), return_index=True)
        edges = pa.array(np.r_[begins, len(order)].astype(np.int32))
        names = ["lang", "words", "phrase", "n"]
        return pa.RecordBatch.from_arrays([pa.array(named), *[pa.ListArray.from_arrays(edges, whole[c].chunk(0)) for c in names]], names=["part", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, held = sent.value, []
        for block in blocks(batches):
            _, first, many = np.unique(block.lang, return_index=True, return_counts=True)
            found = [(np.zeros(len(first), dtype=np.int64), first, many, _lang_hashes(block)[block.lang[first]])]
            word = _hashes(block)
            at = _survives(word, heavy)
            keys = block.index[at] * len(block.langs) + block.lang[at]
            hashes = word[at]
            for n in range(1, MAX_WORDS + 1):
                if not len(at):
                    break
                # Exact numbers of the phrases: by the number of the first n - 1 words and the last word.
                _, first, inverse, many = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
                found.append((np.full(len(first), n), at[first], many, hashes[first]))
                if n == MAX_WORDS:
                    break
                alive = np.zeros(len(word) + 1, dtype=bool)
                alive[at] = True
                go = np.flatnonzero(alive[at + 1] & block.joined[np.minimum(at + n - 1, len(word) - 1)])
                rolled = _roll(hashes[go], word[at[go] + n])
                go, hashes = go[left := _survives(rolled, heavy)], rolled[left]
                at = at[go]
                keys = inverse[go] * len(block.words) + block.index[at + n]
            held.append(table(block, found))
            if sum(t.num_rows for t in held) > most_held:
                yield dealt(held)
                held = []
        if held:
            yield dealt(held)

    return run


def _add_up(least: int, most_held: int = 1 << 20):
    """Sums the counts of each part, which come sorted by part, and keeps those that reach `least`."""

    def frequent(held: list[pa.Table]) -> list[pa.RecordBatch]:
        out = _summed(held, "lang", "words", "phrase")
        return out.filter(pc.or_(pc.greater_equal(out["n"], least), pc.equal(out["words"], 0))).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, rows, limit = None, [], 0, most_held
        for batch in batches:
            for i, p in enumerate(batch.column("part").to_pylist()):
                if p != part and held:
                    yield from frequent(held)
                    held, rows, limit = [], 0, most_held
                part = p
                held.append(pa.table({c: batch.column(c).slice(i, 1).flatten() for c in ("lang", "words", "phrase", "n")}))
                rows += held[-1].num_rows
                if rows > limit:
                    held = [_summed(held, "lang", "words", "phrase")]
                    rows = held[0].num_rows
                    limit = max(most_held, 2 * rows)
        if held:
            yield from frequent(held)

    return run


def counts(docs: DataFrame, least: int, lang_col: str, text_col: str) -> DataFrame:
    """(lang, words, phrase, n): all phrases with n >= least; words 0: the language's words in all."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    heavy = heavy_cells(rows, least, sketch_bits(size))
    sent = rows.sparkSession.sparkContext.broadcast(heavy)
    parts = min(4096, max(16, size >> 25))
    found = rows.mapInArrow(_count(sent, parts), _COUNTED).repartition(parts, "part").sortWithinPartitions("part")
    return found.mapInArrow(_add_up(least), "lang string, words int, phrase string, n long")


# -- scores


def scores(counted: DataFrame) -> DataFrame:
    """(lang, words, phrase, a, l, r, n, score) of each phrase of two words or more, by its lowest-scoring cut."""
    own = counted.filter("words > 1").select("lang", "words", "phrase", F.col("n").alias("a"))
    parts = counted.filter("words > 0").select("lang", "phrase", "n")
    total = counted.filter("words = 0").select("lang", F.col("n").alias("all"))
    split = own.withColumn("w", F.split("phrase", " ")).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    text = lambda start, length: F.array_join(F.slice("w", start, length), " ")
    cut = split.select("lang", "words", "phrase", "a", "k", text(F.lit(1), F.col("k")).alias("left"), text(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    cut = cut.join(parts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    cut = cut.join(parts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"]).join(total, "lang")
    big = lambda c: f"CAST({c} AS DECIMAL(19, 0))"
    # Products of 38 digits; the quotient is below 1000 * all.
    cut = cut.withColumn("score", F.expr(f"({big('1000 * a')} * {big('all')}) div ({big('l')} * {big('r')})"))
    best = F.min(F.struct("score", "k", "l", "r")).alias("best")
    return cut.groupBy("lang", "words", "phrase", "a", "all").agg(best).select("lang", "words", "phrase", "a", "best.l", "best.r", F.col("all").alias("n"), "best.score")


def subsumed(counted: DataFrame, share: int) -> DataFrame:
    """(lang, phrase) of the candidates inside a longer one with share per cent of their count or more.

    Phrases one word longer say it all: one between them and a still longer one is at least as frequent as that.
    """
    longer = counted.filter("words > 2").withColumn("w", F.split("phrase", " "))
    inner = longer.select("lang", F.explode(F.array(F.slice("w", F.lit(1), F.col("words") - 1), F.slice("w", F.lit(2), F.col("words") - 1))).alias("w"), "n")
    inner = inner.groupBy("lang", F.array_join("w", " ").alias("phrase")).agg(F.max("n").alias("longer"))
    return inner.join(counted.filter("words > 1").select("lang", "phrase", "n"), ["lang", "phrase"]).filter(100 * F.col("longer") >= share * F.col("n")).select("lang", "phrase")


def first_of(df: DataFrame, group: str, top: int, *order: Column, parts: int = 64) -> DataFrame:
    """The first `top` rows of each group with their rank: first within parts of a group, then among those."""
    part = F.pmod(F.xxhash64("phrase"), F.lit(parts))
    local = df.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy(group, "part").orderBy(*order))).filter(F.col("rank") <= top)
    return local.drop("part").withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("rank") <= top)


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, share: int = 100, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of each language that no longer one subsumes."""
    counted = materialise(counts(docs, least, lang_col, text_col), "phrases")
    left = scores(counted).join(subsumed(counted, share), ["lang", "phrase"], "left_anti")
    ranked = first_of(left, "lang", top, F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


#: The same in DuckDB: all phrases counted, cut, scored, those inside an equally frequent longer one dropped.
ORACLE = r"""
WITH t AS (
  SELECT doc_id, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents
), piece AS (
  SELECT lang, unnest(regexp_extract_all(x, '[^.,;:!?\x0A-\x0D]+')) AS p FROM t
), w AS (
  SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM piece
), g AS (
  SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k
), f AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS c FROM g GROUP BY ALL
), total AS (
  SELECT lang, CAST(sum(c) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang
), cand AS (
  SELECT lang, k, phrase, c AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND c >= 100
), cut AS (
  SELECT cand.lang, phrase, a, w, j, array_to_string(w[1 : j], ' ') AS lp, array_to_string(w[j + 1 : k], ' ') AS rp
  FROM cand, (SELECT unnest(range(1, 5)) AS j) WHERE j < k
), scored AS (
  SELECT cut.lang, cut.phrase, a, x.c AS l, y.c AS r, n, j,
         (CAST(1000 AS HUGEINT) * a * n) // (CAST(x.c AS HUGEINT) * y.c) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = lp JOIN f y ON y.lang = cut.lang AND y.phrase = rp JOIN total ON total.lang = cut.lang
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), kept AS (
  SELECT * FROM best WHERE NOT EXISTS (
    SELECT 1 FROM cand WHERE cand.lang = best.lang AND cand.a >= best.a AND len(cand.phrase) > len(best.phrase)
                         AND contains(' ' || cand.phrase || ' ', ' ' || best.phrase || ' '))
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM kept QUALIFY rank <= 2000
"""
