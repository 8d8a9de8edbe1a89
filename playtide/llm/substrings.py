"""Repeated passages: prefix-partitioned suffix trees over word sequences.

The suffixes that can hold a repeated window are found with a lossless sieve: each window of
`width` words has a leading k-gram (the smallest by a fixed hash, the first on ties), equal
windows have the same one at the same place, so a window whose leading k-gram occurs once in
the corpus cannot repeat.  The rest are routed by that k-gram, the short prefix, so that
consecutive suffixes travel together; suffixes under a prefix too common for one task are
routed by their whole sequence instead, the longest prefix.  Per group the suffix tree is
built top-down, several words an edge; leaves are cut off as soon as they part, and the inner
nodes that reach `width` words are the repeats.

Copies inside one batch of documents are settled there: only one of them is sent on, so a
passage that a third of all documents share costs a row per batch, not per document.

Defined results: a null, empty or blank text has no words, nothing removed and the digest of
the empty string; texts shorter than the window keep all words; repeated rows repeat each
other; an empty table gives no rows; columns other than the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtide.llm.common import chunked, ragged_take, read_table, record_batch, row_key, texts, unused

_MUL = np.uint64(0xD6E8FEB86659FD93)
_ALL = np.uint64((1 << 40) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_MUL), n, 1 << 64))


def rolling(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` values, built by doubling."""
    out, have, power, size = None, 0, h, 1
    rest = width
    while rest:
        if rest & 1:
            if out is None:
                out, have = power, size
            else:
                n = len(h) - have - size + 1
                out = out[:n] * _power(size) + power[have : have + n]
                have += size
        rest >>= 1
        if rest:
            n = max(0, len(power) - size)
            power = power[:n] * _power(size) + power[size : size + n]
            size *= 2
    return _mix(out)


class Windows:
    """All windows of a batch of texts, with their leading k-grams."""

    def __init__(self, docs: list[list[bytes]], width: int, k: int, hashes: bool = True):
        digest = xxhash.xxh3_64_intdigest
        self.counts = np.fromiter(map(len, docs), dtype=np.int64, count=len(docs))
        self.words = np.array([digest(w) for d in docs for w in d], dtype=np.uint64)
        starts = np.cumsum(self.counts) - self.counts
        n = np.maximum(self.counts - width + 1, 0)
        self.doc = np.repeat(np.arange(len(docs)), n)
        self.at = ragged_take(starts, n)  # places in self.words
        self.pos = self.at - starts[self.doc]
        if not len(self.at):
            self.lead = self.key = self.hash = np.zeros(0, dtype=np.uint64)
            return
        mixed = _mix(self.words ^ np.uint64(0xA0761D6478BD642F))
        grams = rolling(mixed, k)
        span = width - k + 1
        # smallest k-gram of each window, the first on ties: minima over two overlapping runs of a power of two
        low, arg, size = grams, np.arange(len(grams)), 1
        while size * 2 <= span:
            a, b = low[: len(low) - size], low[size:]
            right = b < a
            low, arg, size = np.where(right, b, a), np.where(right, arg[size:], arg[: len(arg) - size]), size * 2
        a, b = self.at, self.at + span - size
        right = low[b] < low[a]
        self.lead = np.where(right, arg[b], arg[a])
        self.key = grams[self.lead]
        self.hash = rolling(mixed, width)[self.at] if hashes else None


def _split(batch: pa.RecordBatch) -> list[list[bytes]]:
    return [t.split() for t in texts(batch.column("text"))]


def _leading(docs: DataFrame, width: int, k: int) -> DataFrame:
    """(doc_id, key, n): the leading k-grams of each document, with their places counted."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches):
            w = Windows(_split(batch), width, k, hashes=False)
            # the leading place never moves back as the window moves on, so its runs are its distinct values
            new = np.ones(len(w.doc), dtype=bool)
            new[1:] = w.lead[1:] != w.lead[:-1]
            doc, key = w.doc[new], w.key[new]
            order = np.lexsort((key, doc))
            doc, key = doc[order], key[order]
            new = np.ones(len(doc), dtype=bool)
            new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
            cuts = np.flatnonzero(new)
            n = np.diff(np.append(cuts, len(doc)))
            ids = batch.column("doc_id").to_numpy()
            yield record_batch(schema, {"doc_id": ids[doc[cuts]], "key": key[cuts].view(np.int64), "n": n})

    return docs.mapInArrow(run, "doc_id long, key long, n long")


def _suffixes(docs: DataFrame, width: int, k: int) -> DataFrame:
    """Suffixes to be placed in trees, and windows that are settled already.

    docs(doc_id, text, keys, hot): the k-grams of the document that occur elsewhere, and
    whether each is too common for one task.  A row holds the windows pos, pos+1, ... that lead
    with one k-gram place: `mask` has those to be placed (words given, five bytes each) or,
    without words, those known to repeat.
    """
    schema = pa.schema([("route", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int64()), ("lead", pa.int64()), ("mask", pa.int64()), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches):
            w = Windows(_split(batch), width, k)
            ids = batch.column("doc_id").to_numpy()
            lists = batch.column("keys")
            live_keys = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            live_hot = batch.column("hot").flatten().to_numpy(zero_copy_only=False).astype(bool)
            names, first = np.unique(live_keys, return_index=True)
            live_hot = live_hot[first]
            if not len(names) or not len(w.key):
                continue
            key = w.key.view(np.int64)
            slot = np.minimum(np.searchsorted(names, key), len(names) - 1)
            keep = names[slot] == key
            doc, at, pos, lead, h, slot = w.doc[keep], w.at[keep], w.pos[keep], w.lead[keep], w.hash[keep], slot[keep]
            if not len(doc):
                continue
            _, first, inverse, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            known = n[inverse] > 1  # occurs twice in this batch
            chosen = np.zeros(len(h), dtype=bool)
            chosen[first] = True  # stands for its copies
            new = np.ones(len(doc), dtype=bool)
            new[1:] = (lead[1:] != lead[:-1]) | (at[1:] != at[:-1] + 1)
            run_of = np.cumsum(new) - 1
            cuts = np.flatnonzero(new)
            shift = (at - at[cuts][run_of]).astype(np.uint64)
            bit = np.uint64(1) << shift
            masks = {}
            for name, which in (("known", known), ("place", chosen)):
                masks[name] = np.bitwise_or.reduceat(np.where(which, bit, np.uint64(0)), cuts).view(np.int64)
            sizes = np.diff(np.append(cuts, len(doc)))
            out = {f.name: [] for f in schema}

            def add(route, doc_id, pos, lead, mask, words):
                for name, x in zip(out, (route, doc_id, pos, lead, mask, words), strict=True):
                    out[name].extend(x)

            told = np.flatnonzero(masks["known"])
            add((ids[doc[cuts[told]]] * 2 + 1).tolist(), ids[doc[cuts[told]]].tolist(), pos[cuts[told]].tolist(), [0] * len(told), masks["known"][told].tolist(), [None] * len(told))
            raw = np.ascontiguousarray((w.words & _ALL).view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()
            is_hot = live_hot[slot]
            for r in np.flatnonzero((masks["place"] != 0) & ~is_hot[cuts]).tolist():
                c = cuts[r]
                p = int(at[c])
                add([int(names[slot[c]])], [int(ids[doc[c]])], [int(pos[c])], [int(lead[c] - p)], [int(masks["place"][r])], [raw[5 * p : 5 * (p + int(sizes[r]) - 1 + width)]])
            single = np.flatnonzero(chosen & is_hot)
            if len(single):
                add(h[single].view(np.int64).tolist(), ids[doc[single]].tolist(), pos[single].tolist(), [int(x) for x in lead[single] - at[single]], [1] * len(single), [raw[5 * p : 5 * (p + width)] for p in at[single].tolist()])
            yield record_batch(schema, out)

    return docs.mapInArrow(run, "route long, doc_id long, pos long, lead long, mask long, words binary")


def deep_nodes(node: np.ndarray, at: np.ndarray, words: np.ndarray, width: int, edge: int = 5) -> np.ndarray:
    """The inner node `width` words deep that each suffix lies below, or -1 where there is none.

    node: the subtree each suffix starts in; at: its place in words.  Nodes are split top-down,
    `edge` words at a time, and suffixes that are alone in theirs leave at once.
    """
    live = np.arange(len(at))
    depth = 0
    mixed = _mix(words + np.uint64(1))
    while depth < width and len(live):
        step = min(edge, width - depth)
        label = rolling(mixed, step)[at[live] + depth]
        pair = _mix(node.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) ^ label)
        _, inverse, n = np.unique(pair, return_inverse=True, return_counts=True)
        stay = n[inverse] > 1
        live, node = live[stay], inverse[stay]
        depth += step
    found = np.full(len(at), -1, dtype=np.int64)
    found[live] = node
    return found


def _trees(suffixes: DataFrame, width: int, budget: int) -> DataFrame:
    """(doc_id, pos, mask): windows known to repeat, the tree of each route built in turn."""
    schema = pa.schema([("doc_id", pa.int64()), ("pos", pa.int64()), ("mask", pa.int64())])

    def grow(batch: pa.Table) -> tuple[pa.RecordBatch, pa.Table]:
        """The windows that repeat, and the rows with one of each window left: they stand for the others where more rows follow."""
        route, lead = batch.column("route").to_numpy(), batch.column("lead").to_numpy()
        mask = batch.column("mask").to_numpy().view(np.uint64)
        blobs = batch.column("words").to_pylist()
        n = np.fromiter((len(b) // 5 for b in blobs), dtype=np.int64, count=len(blobs))
        flat = np.zeros((int(n.sum()), 8), dtype=np.uint8)
        flat[:, :5] = np.frombuffer(b"".join(blobs), dtype=np.uint8).reshape(-1, 5)
        starts = np.cumsum(n) - n
        m = np.maximum(n - width + 1, 0)
        row = np.repeat(np.arange(len(blobs)), m)
        at = ragged_take(starts, m)
        shift = (at - starts[row]).astype(np.uint64)
        placed = (mask[row] >> shift & np.uint64(1)).astype(bool)
        row, at, shift = row[placed], at[placed], shift[placed]
        # windows of a route are alike only with the k-gram at the same place in them
        node = _mix(route[row].view(np.uint64) ^ _mix((lead[row] - shift.astype(np.int64)).view(np.uint64)))
        deep = deep_nodes(node, at, flat.reshape(-1).view(np.uint64), width)

        def masks(which: np.ndarray) -> np.ndarray:
            bits = np.zeros(len(blobs), dtype=np.uint64)
            np.bitwise_or.at(bits, row[which], np.uint64(1) << shift[which])
            return bits.view(np.int64)

        found = deep >= 0
        one = ~found
        one[np.flatnonzero(found)[np.unique(deep[found], return_index=True)[1]]] = True
        bits, left = masks(found), masks(one)
        some, stay = np.flatnonzero(bits), np.flatnonzero(left)
        repeats = record_batch(schema, {"doc_id": batch.column("doc_id").to_numpy()[some], "pos": batch.column("pos").to_numpy()[some], "mask": bits[some]})
        rest = batch.take(pa.array(stay))
        return repeats, rest.set_column(rest.schema.get_field_index("mask"), "mask", pa.array(left[stay]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows, full = 0, budget

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, rows, full
            if not held:
                return
            table = pa.concat_tables(held)
            route = table.column("route").to_numpy()
            cut = len(route) if last else int(np.searchsorted(route, route[-1]))
            if cut:
                yield grow(table.slice(0, cut).combine_chunks())[0]
            rest = table.slice(cut)
            if 2 * rest.num_rows > budget:  # one prefix fills the task: one copy of each window is enough of it
                repeats, rest = grow(rest.combine_chunks())
                yield repeats
            held, rows = ([rest] if rest.num_rows else []), rest.num_rows
            full = max(budget, 2 * rows)

        for batch in batches:
            if not batch.num_rows:
                continue
            told = batch.column("words").is_null()
            settled = batch.filter(told)
            if settled.num_rows:
                yield record_batch(schema, {n: settled.column(n) for n in schema.names})
            batch = batch.filter(batch.column("words").is_valid())
            if batch.num_rows:
                held.append(pa.Table.from_batches([batch]))
                rows += batch.num_rows
                if rows >= full:
                    yield from flush(False)
        yield from flush(True)

    return suffixes.repartition("route").sortWithinPartitions("route").mapInArrow(run, "doc_id long, pos long, mask long")


def _by_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, id): doc_id is the row's key, id the id itself."""
    return docs.select(row_key(F.col(id_col), F.col(text_col).cast("string")).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("long").alias("id"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, id) dealt by the row's key.  An inner and a left join read the very same
    exchange, with all three columns, so the texts are shuffled once for both."""
    return _by_key(docs, id_col, text_col).repartition("doc_id")


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 35, k: int = 6, budget: int = 50_000) -> DataFrame:
    """(doc_id, pos, mask): the windows that occur anywhere else; bit b stands for the one at pos + b.

    doc_id is the row's key (row_key).  budget: suffix rows a task holds at once; a prefix with
    more is lengthened.
    """
    if width - k + 1 > 63 or width <= k:
        raise ValueError("width must exceed k, by less than 63")
    keyed = _keyed(docs, id_col, text_col)
    lead = _leading(_by_key(docs, id_col, text_col).select("doc_id", "text"), width, k)
    common = lead.groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1").select("key", (F.col("n") > budget).alias("hot"))
    live = lead.select("doc_id", "key").join(common, "key").groupBy("doc_id").agg(F.collect_list(F.struct("key", "hot")).alias("live"))
    joined = keyed.join(live, "doc_id").select("doc_id", "text", "id", F.col("live.key").alias("keys"), F.col("live.hot").alias("hot"))
    return _trees(_suffixes(joined, width, k), width, budget)


def removed_words(n: int, pos: list[int], mask: list[int], width: int) -> np.ndarray:
    """Flags of the words covered by the windows given."""
    delta = np.zeros(n + 1, dtype=np.int64)
    starts = [p + b for p, m in zip(pos, mask, strict=True) for b in range((m & (1 << 64) - 1).bit_length()) if m >> b & 1]
    starts = np.unique(np.array(starts, dtype=np.int64))
    np.add.at(delta, starts, 1)
    np.add.at(delta, starts + width, -1)
    return np.cumsum(delta[:n]) > 0


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 35, k: int = 6, budget: int = 50_000) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): kept has the words left, joined by one space."""
    found = repeated_windows(docs, id_col, text_col, width, k, budget).groupBy("doc_id").agg(F.collect_list("pos").alias("pos"), F.collect_list("mask").alias("mask"))
    joined = _keyed(docs, id_col, text_col).join(found, "doc_id", "left").drop("doc_id").withColumnRenamed("id", "doc_id")
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches):
            n_words, n_removed, kept = [], [], []
            for words, pos, mask in zip(_split(batch), batch.column("pos").to_pylist(), batch.column("mask").to_pylist(), strict=True):
                n_words.append(len(words))
                if pos:
                    gone = removed_words(len(words), pos, mask, width)
                    n_removed.append(int(gone.sum()))
                    words = [words[i] for i in np.flatnonzero(~gone).tolist()]
                else:
                    n_removed.append(0)
                kept.append(b" ".join(words).decode())
            yield record_batch(schema, {"doc_id": batch.column("doc_id"), "n_words": n_words, "n_removed": n_removed, "kept": kept})

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def rewrite(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, width: int = 35) -> DataFrame:
    """docs with the repeated words gone from text_col, all other columns as they were.

    Texts that lose no word keep their white space too; length_col, if named, gets the code
    points of a changed text.
    """
    id_, pos_, mask_ = (unused(docs, n) for n in ("__id", "__pos", "__mask"))
    key = row_key(F.col(id_col), F.col(text_col).cast("string")).alias(id_)
    found = repeated_windows(docs, id_col, text_col, width).groupBy(F.col("doc_id").alias(id_)).agg(F.collect_list("pos").alias(pos_), F.collect_list("mask").alias(mask_))
    joined = docs.select("*", key).repartition(id_).join(found, id_, "left").drop(id_)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, column=text_col):
            out = []
            lengths = batch.column(length_col).to_pylist() if length_col else []
            for i, (t, pos, mask) in enumerate(zip(batch.column(text_col).to_pylist(), batch.column(pos_).to_pylist(), batch.column(mask_).to_pylist(), strict=True)):
                if pos:
                    words = t.encode().split()
                    gone = removed_words(len(words), pos, mask, width)
                    t = b" ".join(words[j] for j in np.flatnonzero(~gone).tolist()).decode()
                    if length_col:
                        lengths[i] = len(t)
                out.append(t)
            columns = {n: batch.column(n) for n in names} | {text_col: pa.array(out, type=batch.column(text_col).type)}
            if length_col:
                columns[length_col] = pa.array(lengths, type=batch.column(length_col).type)
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    return joined.mapInArrow(run, docs.schema)


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


#: The same in DuckDB: windows as joined words, those that occur twice, the words they cover.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, p, array_to_string(w[p : p + 34], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS p FROM d WHERE len(w) >= 35)
), rep AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY s) AS c FROM win) WHERE c > 1
), gone AS (
  SELECT DISTINCT doc_id, q FROM (SELECT doc_id, unnest(range(p, p + 35)) AS q FROM rep)
), word AS (
  SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS q FROM d
), kept AS (
  SELECT word.doc_id, count(gone.q) AS n_removed,
         string_agg(x, ' ' ORDER BY word.q) FILTER (WHERE gone.q IS NULL) AS s
  FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.q = word.q GROUP BY word.doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
