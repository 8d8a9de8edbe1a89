"""SimHash near-duplicates, found with a Gray-ordered hierarchical index.

Defined results: a null, empty or blank text has fingerprint zero and links like any other
document; texts of fewer words than a shingle use their whole word sequence; repeated rows
and equal texts share a fingerprint and so a component; rows without an id link like others but
name no component, so one of such rows alone has the component null; an empty table gives no rows;
columns other than the id and the text are ignored.  Very long texts are fingerprinted whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtide.llm.common import chunked, materialise, record_batch, row_key, take, texts, unused
from playtide.llm.graph import connected_components

SEED = 42
#: Six blocks of the 64 bits; a pair within four differing bits agrees on two blocks at least.
BLOCKS = (11, 11, 11, 11, 10, 10)


def fingerprint(words: list[bytes], shingle: int = 4) -> int:
    """Majority bits of the XXH64 values of the shingles, repeats included."""
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
        starts = np.concatenate(([0], ends[:-1]))[: len(words) - shingle + 1].tolist()
        stops = (ends[shingle - 1 :] - 1).tolist()
        hashes = [digest(joined[i:j], SEED) for i, j in zip(starts, stops, strict=True)]
    votes = np.zeros(64, dtype=np.int64)
    packed = np.array(hashes, dtype=np.uint64).view(np.uint8).reshape(-1, 8)
    for i in range(0, len(packed), 65536):
        votes += np.unpackbits(packed[i : i + 65536], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * votes > len(hashes), bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches):
            fps = np.array([fingerprint(t.lower().split(), shingle) for t in texts(batch.column("text"))], dtype=np.uint64)
            yield record_batch(schema, {"doc_id": batch.column("doc_id"), "fp": fps.view(np.int64)})

    return take(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each word in the reflected Gray sequence: the prefix xor of its bits."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """A tree over fingerprints in Gray order.

    Each node holds the bits on which all its members agree (a mask and a pattern), less those
    its ancestors hold already.  A search carries the differences counted so far down the tree
    and drops a node, with its whole group, once they pass the radius.
    """

    def __init__(self, fps: np.ndarray, fan: int = 8):
        self.fan = fan
        self.order = np.argsort(gray_rank(fps), kind="stable")
        self.values = fps[self.order]
        every, any_ = [self.values], [self.values]
        while len(every[-1]) > fan:
            cuts = np.arange(0, len(every[-1]), fan)
            every.append(np.bitwise_and.reduceat(every[-1], cuts))
            any_.append(np.bitwise_or.reduceat(any_[-1], cuts))
        masks = [~(x ^ y) for x, y in zip(every, any_, strict=True)]
        self.levels = []  # from the top: pattern, own mask
        for k in range(len(every) - 1, -1, -1):
            held = masks[k + 1][np.arange(len(every[k])) // fan] if k + 1 < len(every) else np.uint64(0)
            self.levels.append((every[k], masks[k] & ~held))

    def search(self, queries: np.ndarray, radius: int, labels: np.ndarray | None = None, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query number, position in Gray order) within the radius.

        With labels (one per position) and own (one per query), nodes whose members all carry
        the query's own label are dropped: they can only repeat a link that is known.
        """
        spans = None
        if labels is not None:
            lo, hi = [labels], [labels]
            while len(lo[-1]) > self.fan:
                cuts = np.arange(0, len(lo[-1]), self.fan)
                lo.append(np.minimum.reduceat(lo[-1], cuts))
                hi.append(np.maximum.reduceat(hi[-1], cuts))
            spans = list(zip(lo, hi, strict=True))[::-1]
        top = len(self.levels[0][0])
        q = np.repeat(np.arange(len(queries)), top)
        node = np.tile(np.arange(top), len(queries))
        seen = np.zeros(len(q), dtype=np.int64)
        for k, (pattern, mask) in enumerate(self.levels):
            if k:
                below = np.minimum(self.fan, len(pattern) - node * self.fan)
                child = np.repeat(node * self.fan, below) + (np.arange(below.sum()) - np.repeat(np.cumsum(below) - below, below))
                q, seen, node = np.repeat(q, below), np.repeat(seen, below), child
            seen = seen + np.bitwise_count((queries[q] ^ pattern[node]) & mask[node])
            keep = seen <= radius
            if spans is not None:
                lo, hi = spans[k]
                keep &= ~((lo[node] == own[q]) & (hi[node] == own[q]))
            q, node, seen = q[keep], node[keep], seen[keep]
        return q, node


def _join(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining the classes of a with those of b; a label is a member's position."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    pairs = np.unique(np.stack([labels[a], labels[b]], axis=1), axis=0)
    for x, y in pairs.tolist():
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    names = np.unique(labels)
    new = np.array([root(x) for x in names.tolist()], dtype=labels.dtype)
    return new[np.searchsorted(names, labels)]


def local_stars(fps: np.ndarray, radius: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect just what pairs within the radius connect, as (member, head) fingerprints."""
    n = len(fps)
    if n < 2:
        return fps[:0], fps[:0]
    if n == 2:
        near = int(fps[0] ^ fps[1]).bit_count() <= radius
        return (fps[1:], fps[:1]) if near else (fps[:0], fps[:0])
    index = GrayIndex(fps)
    v, labels = index.values, np.arange(n)
    near = np.flatnonzero(np.bitwise_count(v[1:] ^ v[:-1]) <= radius)
    if len(near):
        labels = _join(labels, near, near + 1)
    at, block = 0, 64
    while at < n:
        mine = np.arange(at, min(n, at + block))
        q, hit = index.search(v[mine], radius, labels, labels[mine])
        if len(q):
            labels = _join(labels, mine[q], hit)
        at, block = at + block, min(2048, block * 2)
    rest = np.flatnonzero(labels != np.arange(n))
    return v[rest], v[labels[rest]]


def _masks() -> list[int]:
    cut, out = 0, []
    for w in BLOCKS:
        out.append(((1 << w) - 1) << cut)
        cut += w
    pairs = [out[i] | out[j] for i in range(len(out)) for j in range(i)]
    return [m - (1 << 64) if m >> 63 else m for m in pairs]


def _finer(mask: int) -> list[int]:
    """Five masks over the bits that `mask` leaves: a pair within four differing bits agrees on one of them."""
    rest = [b for b in range(64) if not mask >> b & 1]
    out = [sum(1 << b for b in rest[j::5]) for j in range(5)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def link_table(fps: DataFrame, radius: int = 4, hot: int = 20_000) -> DataFrame:
    """Edges (a, b) between distinct fingerprints of fps(fp) whose classes must be joined.

    Every fingerprint goes to the 15 groups named by two of six bit blocks; a pair within four
    differing bits meets in one of them at least.  A group of more than `hot` fingerprints is
    split in the same way by the bits it does not name: into groups by each of five blocks, one of
    which such a pair has in common.  Only what is still larger is cut into parts, and every two
    parts meet in a task of their own, so no task holds more than two parts and no pair is lost.
    """
    if radius > len(BLOCKS) - 2:
        raise ValueError("radius must be 4 or less")
    masks = _masks()
    tables = F.array(*[F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(m).cast("long"))) for t, m in enumerate(masks)])
    rows = fps.select("fp", F.posexplode(tables).alias("t", "key"))
    large = materialise(rows.groupBy("key").count().filter(F.col("count") > hot).select("key", F.lit(True).alias("large")), "large-groups")
    if large.isEmpty():
        rows = rows.select("fp", "key")
    else:
        of_table = F.array(*[F.array(*[F.lit(m).cast("long") for m in _finer(m & (1 << 64) - 1)]) for m in masks])
        split = F.transform(F.element_at(of_table, F.col("t") + 1), lambda m, j: F.xxhash64("key", j, F.col("fp").bitwiseAND(m)))
        rows = rows.join(large, "key", "left").select("fp", F.explode(F.when(F.col("large"), split).otherwise(F.array("key"))).alias("key"))
        larger = rows.groupBy("key").count().filter(F.col("count") > hot).select("key", F.ceil(F.col("count") / (hot // 2)).cast("int").alias("parts"))
        rows = rows.join(larger, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
        meets = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.xxhash64(F.col("key"), F.least(i, F.col("part")), F.greatest(i, F.col("part"))))
        rows = rows.withColumn("part", part).select("fp", F.explode(F.when(F.col("parts") == 1, F.array("key")).otherwise(meets)).alias("key"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stars(keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
            cuts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, int)
            ends = np.append(cuts[1:], len(keys))
            found = [local_stars(np.unique(values[i:j]).view(np.uint64), radius) for i, j in zip(cuts.tolist(), ends.tolist(), strict=True) if j - i > 1]
            a = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.uint64)
            b = np.concatenate([x for _, x in found]) if found else np.zeros(0, np.uint64)
            return record_batch(schema, {"a": a.view(np.int64), "b": b.view(np.int64)})

        keys, values = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            keys = np.concatenate((keys, batch.column("key").to_numpy()))
            values = np.concatenate((values, batch.column("fp").to_numpy()))
            if len(keys) and keys[0] != keys[-1]:
                done = int(np.searchsorted(keys, keys[-1]))
                yield stars(keys[:done], values[:done])
                keys, values = keys[done:], values[done:]
        yield stars(keys, values)

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links."""
    prints = materialise(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = connected_components(link_table(prints.select("fp").distinct(), radius))
    classes = classes.select(F.col("node").alias("fp"), F.col("component"))
    tagged = prints.groupBy("fp").agg(F.min("doc_id").alias("least")).join(classes, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    heads = tagged.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = tagged.join(heads, "component").select("fp", "component_id")
    return prints.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def op4_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    from playtide.llm.common import read_table

    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_pairs(rows: DataFrame, shingle: int = 5, radius: int = 4) -> DataFrame:
    """Pairs (a, b) of nodes of rows(node, text), which connect just what fingerprints within the radius connect."""
    prints = materialise(fingerprints(rows, "node", "text", shingle).select(F.col("doc_id").alias("node"), "fp").distinct(), "node-fingerprints")
    heads = prints.groupBy("fp").agg(F.min("node").alias("head"))
    equal = prints.join(heads, "fp").filter("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    edges = link_table(heads.select("fp"), radius).distinct()
    near = edges.join(heads.select(F.col("fp").alias("a"), F.col("head").alias("x")), "a").join(heads.select(F.col("fp").alias("b"), F.col("head").alias("y")), "b")
    return equal.unionByName(near.select(F.col("x").alias("a"), F.col("y").alias("b")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without the near copies (five-word shingles alike to 0.8): of each component the one with the smallest id stays.

    Fingerprints of the five-word shingles and their Gray-ordered index give the pairs that are looked at
    first.  Each is verified on the whole sets, as fingerprints within the radius may belong to texts that
    are less alike; and texts alike to 0.8 may have fingerprints further apart than any exact index
    reaches, so similar.py then finds, without loss, the links between texts that are not connected yet.

    A row without an id stays only where no row of its component has one; of rows with the same id
    and text one stays.
    """
    from playtide.llm.similar import node_of, similar_documents

    found = similar_documents(docs, id_col, text_col, pairs=near_pairs)
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("x"))
    row = unused(docs, "__row")
    kept = first.select(row_key(F.col("x.doc_id"), F.col("x.node")).alias(row))
    keyed = docs.withColumn(row, row_key(F.col(id_col), node_of(F.col(text_col).cast("string"))))
    # the join has dealt rows by the key, so one of each is kept without another shuffle
    return keyed.join(kept, row, "left_semi").dropDuplicates([row]).drop(row)
