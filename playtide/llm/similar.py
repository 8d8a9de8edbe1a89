"""Near-duplicates by the Jaccard similarity of five-word shingles, without loss.

Two sets alike to 4/5 share an element early in both, in any one order of all elements: of a set
of n only the first n/5 (rounded down, plus one) need to meet.  Rare shingles go first, so common
lines and passages seldom meet at all; how often a shingle occurs is estimated by counters of
fixed number over a sixteenth of the texts, which decides the order and so the speed, never a link.
A pair is looked at where its first common shingle leaves enough behind it in both sets.  Bitmaps
of two to four bits a shingle then give a bound: places in which two bitmaps differ are no more than
the shingles that only one set has.  Pairs within the bound are verified on the whole sets.

Links matter only for components.  So all members of a group meet one of them first, another in
each group.  Members that are still in different components are compared inside one task a
group, by bitmaps; what can be alike makes clusters, and each cluster is settled on the whole
sets inside one task.  Pairs are rows only in the first step, one a member.

Sets are as large as the texts, so they are never stored: they are computed where prefixes are
taken, and again for the few texts that met another.

Defined results: a null, empty or blank text has the empty set, alike to itself only; texts of
fewer words than a shingle use their whole word sequence; equal texts are one node.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playtide.llm.common import WORD, chunked, materialise, record_batch, shared_root, take, texts
from playtide.llm.graph import connected_components

SEED = 42
#: A pair links if its Jaccard similarity is P / Q or more.
P, Q = 4, 5
SLOTS = 1 << 21
BITS = 1 << 23


def shingle_set(words: list[bytes], shingle: int = 5) -> np.ndarray:
    """Sorted distinct XXH64 values of the shingles, as signed longs."""
    if not words:
        return np.zeros(0, dtype=np.int64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
        starts = np.concatenate(([0], ends[:-1]))[: len(words) - shingle + 1].tolist()
        stops = (ends[shingle - 1 :] - 1).tolist()
        hashes = [digest(joined[i:j], SEED) for i, j in zip(starts, stops, strict=True)]
    return np.unique(np.array(hashes, dtype=np.uint64).view(np.int64))


def _lists(schema: pa.Schema, columns: list, *lists: list[np.ndarray]) -> pa.RecordBatch:
    def column(arrays: list[np.ndarray]) -> pa.ListArray:
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in arrays]))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64)))

    return pa.RecordBatch.from_arrays([*columns, *map(column, lists)], schema=schema)


def node_of(text: Column) -> Column:
    """A hash of the text, one for all texts without a word."""
    return F.when(F.coalesce(text.rlike(WORD), F.lit(False)), F.xxhash64(text)).otherwise(F.lit(0))


def nodes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, node)."""
    return take(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("node", node_of(F.col("text")))


def _often(rows: DataFrame, shingle: int) -> np.ndarray:
    """How often the shingles of each counter's slot occur in a sixteenth of the texts, where that stands out."""
    schema = pa.schema([("slot", pa.int32()), ("c", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(SLOTS, dtype=np.int32)
        for batch in chunked(batches):
            for t in texts(batch.column("text")):
                count[shingle_set(t.lower().split(), shingle) & (SLOTS - 1)] += 1
        for part in np.array_split(np.flatnonzero(count).astype(np.int32), 32):
            yield record_batch(schema, {"slot": part, "c": count[part].astype(np.int64)})

    some = rows.filter(F.pmod("node", F.lit(16)) == 0).select("text").mapInArrow(run, "slot int, c long")
    counted = some.groupBy("slot").agg(F.sum("c").cast("int").alias("c"))
    # all but the most frequent count as equally rare; SLOTS rows at most
    found = counted.toArrow()
    often = np.zeros(SLOTS, dtype=np.int32)
    often[found.column("slot").to_numpy()] = found.column("c").to_numpy()
    often[often <= 1 + 1.5 * often.sum() / SLOTS] = 0
    return often


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """Bits of the shingles, as longs: a power of two of bits, twice as many as shingles or more."""
    size = max(64, 1 << (2 * max(1, len(shingles)) - 1).bit_length())
    bits = np.zeros(size, dtype=bool)
    bits[(shingles >> 20) & (size - 1)] = True
    return np.packbits(bits, bitorder="little").view(np.int64)


def prefixes(rows: DataFrame, shingle: int) -> DataFrame:
    """(node, n, prefix, bits): the rarest shingles of each set, as many as must meet, and its bitmap; nodes may repeat."""
    shared = rows.sparkSession.sparkContext.broadcast(_often(rows, shingle))
    longs = pa.list_(pa.int64())
    schema = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("prefix", longs), ("bits", longs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for batch in chunked(batches, 1 << 20):
            names, first = np.unique(batch.column("node").to_numpy(), return_index=True)
            sets = [shingle_set(t.lower().split(), shingle) for t in texts(batch.column("text").take(pa.array(first)))]
            n = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
            flat = np.concatenate(sets)
            row = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((flat, often[flat & (SLOTS - 1)], row))
            place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
            keep = Q * (n[row] - place) >= P * n[row]
            ends = np.cumsum(np.bincount(row[keep], minlength=len(n)))[:-1]
            yield _lists(schema, [pa.array(names), pa.array(n)], np.split(flat[order][keep], ends), list(map(bitmap, sets)))

    return rows.select("node", "text").mapInArrow(run, "node long, n long, prefix array<long>, bits array<long>")


def _bounded(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (a, b) that can be alike by their bitmaps."""
    a = rows.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bits").alias("x"))
    b = rows.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("y"))

    def folded(x: Column, y: Column) -> Column:
        half = F.size(x) / 2
        halves = F.zip_with(F.slice(x, 1, half.cast("int")), F.slice(x, (half + 1).cast("int"), half.cast("int")), lambda p, q: p.bitwiseOR(q))
        return F.when(F.size(x) > F.size(y), halves).otherwise(x)  # alike sets differ by one fold at most

    differ = F.aggregate(F.zip_with(folded(F.col("x"), F.col("y")), folded(F.col("y"), F.col("x")), lambda p, q: F.bit_count(F.coalesce(p, F.lit(0)).bitwiseXOR(F.coalesce(q, F.lit(0))))), F.lit(0), lambda s, k: s + k)
    # common <= (na + nb - differ) / 2
    return pairs.join(a, "a").join(b, "b").filter((P + Q) * (F.col("na") + F.col("nb") - differ) >= 2 * P * (F.col("na") + F.col("nb"))).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are alike on their whole sets."""
    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(a, "a").join(b, "b").filter((P + Q) * common >= P * (F.size("sa") + F.size("sb"))).select("a", "b")


def _of_nodes(rows: DataFrame, wanted: DataFrame, shingle: int, folder: str) -> DataFrame:
    """(node, shingles) of all wanted(node), and few others: a bitmap of fixed size stands for the nodes."""
    spark = rows.sparkSession
    wanted = wanted.select(F.col("node").bitwiseAND(F.lit(BITS - 1)).alias("bit")).distinct().toArrow()
    bits = np.zeros(BITS, dtype=bool)
    bits[wanted.column("bit").to_numpy()] = True
    shared = spark.sparkContext.broadcast(np.packbits(bits))
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(shared.value).view(bool)
        for batch in chunked(batches, 1 << 20):
            names, first = np.unique(batch.column("node").to_numpy(), return_index=True)
            met = bits[names & (BITS - 1)]
            sets = [shingle_set(t.lower().split(), shingle) for t in texts(batch.column("text").take(pa.array(first[met])))]
            yield _lists(schema, [pa.array(names[met])], sets)

    some = rows.select("node", "text").mapInArrow(run, "node long, shingles array<long>")
    return materialise(some.dropDuplicates(["node"]), f"{folder}/met")


def _near(x: str, y: str) -> Column:
    """Whether enough is left of both sets at a key where x and y meet; a span holds the set's size and what is left."""
    n, left = (lambda r: F.shiftright(F.col(f"{r}.span"), 32)), (lambda r: F.col(f"{r}.span").bitwiseAND(F.lit((1 << 32) - 1)))
    return (P + Q) * F.least(left(x), left(y)) >= P * (n(x) + n(y))


def _root(parent: np.ndarray, x: int) -> int:
    while parent[x] != x:
        parent[x] = x = parent[parent[x]]
    return x


def _able(maps: list[np.ndarray], n: np.ndarray, left: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (places i and j, most shingles in common) that can be alike by their bitmaps, and by what is left of them at a key, block by block."""
    width = np.fromiter(map(len, maps), dtype=np.int64, count=len(maps))
    # unsigned: bitwise_count() takes signed numbers without their sign
    stacked = {w: np.stack([maps[i] for i in np.flatnonzero(width == w).tolist()]).view(np.uint64) for w in np.unique(width).tolist()}
    for w, x in stacked.items():
        at = np.flatnonzero(width == w)
        for v in (w, w // 2):  # sets that are alike differ by one fold at most
            if v not in stacked:
                continue
            y, to = stacked[v], np.flatnonzero(width == v)
            folded = x if v == w else x[:, :v] | x[:, v:]
            step = max(1, (1 << 21) // (len(y) * v))
            for i in range(0, len(x), step):
                p, q = at[i : i + step, None], to[None, :]
                differ = np.bitwise_count(folded[i : i + step, None, :] ^ y[None, :, :]).sum(axis=2, dtype=np.int64)
                both = n[p] + n[q]
                hit = (P + Q) * (both - differ) >= 2 * P * both
                if left is not None:
                    hit &= (P + Q) * np.minimum(left[p], left[q]) >= P * both
                if v == w:
                    hit &= p < q
                a, b = np.nonzero(hit)
                yield at[i + a], to[b], (both - differ)[a, b] // 2


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each key, which stand together."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        keys = held.column("key").to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist()]
        for i, j in zip(cuts, cuts[1:], strict=False):
            yield held.slice(i, j - i)
        held = held.slice(cuts[-1])
    if held is not None:
        yield held


def _arrays(column: pa.ChunkedArray) -> list[np.ndarray]:
    lists = column.combine_chunks()
    flat, offsets = lists.flatten().to_numpy(), lists.offsets.to_numpy()
    offsets = offsets - offsets[0]
    return [flat[i:j] for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def _met(rows: DataFrame, most: int) -> DataFrame:
    """rows(key, node, ...) with keys such that no key has more than about `most` rows: those of a larger key are cut into pieces, and every two pieces meet."""
    sizes = rows.groupBy("key").count().select("key", F.ceil(F.col("count") / (most // 2)).cast("int").alias("pieces")).filter(F.col("pieces") > 2)
    rows = rows.join(sizes, "key", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1))).withColumn("piece", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("pieces") - 1), lambda i: F.xxhash64("key", F.least(i, F.col("piece")), F.greatest(i, F.col("piece"))))
    rows = rows.select(F.explode(meets).alias("key"), *[c for c in rows.columns if c not in ("key", "pieces", "piece")])
    return rows.repartition("key").sortWithinPartitions("key")


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _clusters(rows: DataFrame, most: int = 4_000) -> DataFrame:
    """Edges that connect rows(key, node, span, part, bits) which meet at a key, are in different parts and can be alike by their bitmaps.

    Each key's members are compared inside one task; only a tree for each cluster leaves it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches):
            node, part, span = (group.column(c).to_numpy() for c in ("node", "part", "span"))
            parent = np.arange(len(node))
            edges = []
            for i, j, _ in _able(_arrays(group.column("bits")), span >> 32, span & ((1 << 32) - 1)):
                apart = part[i] != part[j]
                for x, y in zip(i[apart].tolist(), j[apart].tolist(), strict=True):
                    r, s = _root(parent, x), _root(parent, y)
                    if r != s:
                        parent[r] = s
                        edges.append((x, y))
            at = np.array(edges, dtype=np.int64).reshape(-1, 2)
            yield record_batch(_PAIRS, {"a": node[at[:, 0]], "b": node[at[:, 1]]})

    return _met(rows, most).mapInArrow(run, "a long, b long").distinct()


def _alike(rows: DataFrame, most: int = 4_000) -> DataFrame:
    """Edges that connect just what pairs alike connect among rows(key, node, part, shingles) of one key.

    Likely pairs are verified first, and a pair that is in one part or connected by then is left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches):
            node, part = (group.column(c).to_numpy() for c in ("node", "part"))
            sets = _arrays(group.column("shingles"))
            n = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
            parent = np.unique(part, return_index=True, return_inverse=True)
            parent = parent[1][parent[2]]  # the first of each part stands for it
            found = [np.stack(x) for x in _able([bitmap(x) for x in sets], n)]
            i, j, most_common = np.concatenate(found, axis=1) if found else np.zeros((3, 0), dtype=np.int64)
            edges = []
            for k in np.argsort((n[i] + n[j] - most_common) / np.maximum(1, most_common), kind="stable").tolist():
                x, y = int(i[k]), int(j[k])
                r, s = _root(parent, x), _root(parent, y)
                if r == s:
                    continue
                common = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if (P + Q) * common >= P * (n[x] + n[y]):
                    parent[r] = s
                    edges.append((x, y))
            at = np.array(edges, dtype=np.int64).reshape(-1, 2)
            yield record_batch(_PAIRS, {"a": node[at[:, 0]], "b": node[at[:, 1]]})

    return _met(rows, most).mapInArrow(run, "a long, b long").distinct()


def links(docs: DataFrame, folder: str, shingle: int = 5, pairs: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """Edges (a, b) between nodes of docs(text, node) that connect just what pairs alike connect.  Only they stay when `folder` is removed.

    `pairs` gives pairs (a, b) of nodes that are looked at first, besides: what they connect is known when
    groups are gone through.  Every group's members meet one of them.  Groups of one component are done then; in the others,
    members of different components that can be alike make clusters, and each cluster is
    settled inside a task.
    """
    sets = materialise(prefixes(docs, shingle).dropDuplicates(["node"]), f"{folder}/prefixes")
    # n and what is left at a key travel as one number
    span = F.shiftleft(F.col("n"), 32) + F.col("n") - F.col("place")
    rows = sets.select("node", "n", F.posexplode("prefix").alias("place", "key")).select("key", "node", span.alias("span"))
    group = Window.partitionBy("key")
    first = F.min(F.struct(F.xxhash64("key", "node").alias("h"), "node", "span")).over(group)
    rows = rows.select("*", F.count("*").over(group).alias("members"), first.dropFields("h").alias("lead")).filter("members > 1")
    rows = materialise(rows, f"{folder}/meetings")
    met = rows.alias("x").filter((F.col("node") != F.col("lead.node")) & _near("x", "lead"))
    met = met.select(F.least("node", "lead.node").alias("a"), F.greatest("node", "lead.node").alias("b"))
    if pairs is not None:
        met = met.unionByName(pairs(docs, shingle).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    met = materialise(_bounded(met.distinct(), sets), f"{folder}/pairs")
    found = materialise(_verified(met, _of_nodes(docs, met.select(F.explode(F.array("a", "b")).alias("node")), shingle, folder)), "links")
    part = materialise(connected_components(found).withColumnRenamed("component", "part"), f"{folder}/parts")
    # two members have met already; in a group of one component no link is missing
    rows = rows.filter("members > 2").select("key", "node", "span").join(part, "node", "left").withColumn("part", F.coalesce("part", "node"))
    rows = rows.select("*", F.min("part").over(group).alias("lo"), F.max("part").over(group).alias("hi")).filter("lo <> hi").drop("lo", "hi")
    trees = materialise(_clusters(rows.join(sets.select("node", "bits"), "node")), f"{folder}/trees")
    clusters = materialise(connected_components(trees).select("node", F.col("component").alias("key")), f"{folder}/clusters")
    members = _of_nodes(docs, clusters, shingle, folder).join(clusters, "node").join(part, "node", "left").withColumn("part", F.coalesce("part", "node"))
    return found.unionByName(materialise(_alike(members), "links"))


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, pairs: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """(doc_id, node, component, component_id): component_id is the smallest doc_id reachable over links."""
    spark, folder = docs.sparkSession, f"similar-{uuid.uuid4().hex}"
    rows = nodes(docs, id_col, text_col)
    prints = materialise(rows.select("doc_id", "node"), "nodes")
    classes = connected_components(links(rows, folder, shingle, pairs))
    # nothing reads the meetings and sets from here on
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_root(spark)}/{spark.sparkContext.applicationId}/{folder}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    tagged = prints.groupBy("node").agg(F.min("doc_id").alias("least")).join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    heads = tagged.groupBy("component").agg(F.min("least").alias("component_id"))
    return prints.join(tagged.join(heads, "component").select("node", "component", "component_id"), "node").select("doc_id", "node", "component", "component_id")
