"""Language-model scores from a probabilistic suffix tree over the bytes of words.

Training words are counted over the whole corpus.  From the counts come those of each byte after
each context of up to `depth` bytes inside a word (a blank stands before and after it).  A
context is kept as a state if its next-byte distribution diverges from that of the context one
byte shorter by `gain` nats over its occurrences; every such context is kept, so the tree grows
with the input, slower than its square root.  A state's distribution is smoothed with that of the next shorter
state, the root's with the uniform one.  A text scores the sum over its words' bytes, each at
the longest suffix that is a state.

The base score needs the count of every word of every text.  The `head` most frequent words are
broadcast; the rest are joined by a 64-bit hash, and as no frequent word is among them the join
has no hot keys.

Defined results: a null, empty or blank text is the end token alone; with nothing to learn from
N is 0, the base score log10(0.5/0.5) a token and the model uniform; repeated rows count and
score each; an empty table gives no rows; extra columns are ignored; long texts score whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtide.llm.common import chunked, materialise, record_batch, take, texts

END = b"\n"  # no word holds it
BLANK = 0x20


def tokens(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


def split(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """tokens() of many texts (null: none), without the ends: the words one after another, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.fill_null(pc.ascii_lower(column.cast(pa.string())), ""))
    words, ends = lists.flatten().cast(pa.binary()), lists.offsets.to_numpy()
    some = pc.greater(pc.binary_length(words), 0)  # blanks at either end of a text leave an empty word
    filled = np.concatenate(([0], np.cumsum(some.to_numpy(zero_copy_only=False))))
    return words.filter(some), np.diff(filled[ends])


def count_words(docs: DataFrame, text_col: str = "text", held: int = 300_000) -> DataFrame:
    """(word binary, n): occurrences of every token, summed in each task first."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: list[pa.RecordBatch] = []
        rows = 0
        for batch in chunked(batches):
            words, _ = split(batch.column("text"))
            found = pc.value_counts(words)
            count.append(record_batch(schema, {"word": found.field("values"), "n": found.field("counts")}))
            rows += batch.num_rows
            if sum(map(len, count)) > held:
                merged = pa.Table.from_batches(count).group_by("word", use_threads=False).aggregate([("n", "sum")])
                count = merged.rename_columns({"n_sum": "n"}).cast(schema).to_batches()
                if merged.num_rows > held // 2:
                    yield from count
                    count = []
        yield from count
        yield record_batch(schema, {"word": [END] * bool(rows), "n": [rows] * bool(rows)})

    rows = docs.select(F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def positions(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every byte of every word and its closing blank: place in the joined bytes, bytes before it in the word (the opening blank counts), word number."""
    n = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    total = int(n.sum())
    word = np.repeat(np.arange(len(words)), n)
    back = np.arange(total) - np.repeat(np.cumsum(n) - n, n) + 1
    return np.arange(total) + word + 1, back, word


def context(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """The `length` bytes before each place, behind a leading one."""
    code = np.ones(len(at), dtype=np.int64)
    for k in range(length, 0, -1):
        code = (code << 8) | data[at - k]
    return code


def laid_out(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(b" " + w + b" " for w in words), dtype=np.uint8).astype(np.int64)


def count_contexts(counts: DataFrame, depth: int) -> DataFrame:
    """(ctx, depth, sym, n) over counted words; ctx packs its bytes behind a leading one."""
    schema = pa.schema([("ctx", pa.int64()), ("depth", pa.int32()), ("sym", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in range(depth + 1)]
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for d, parts in enumerate(held):
                if parts:
                    codes, inverse = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
                    n = np.bincount(inverse, weights=np.concatenate([w for _, w in parts])).astype(np.int64)
                    for i in range(0, len(codes), 200_000):
                        c = codes[i : i + 200_000]
                        yield record_batch(schema, {"ctx": c >> 8, "depth": np.full(len(c), d, np.int32), "sym": (c & 255).astype(np.int32), "n": n[i : i + 200_000]})
                    parts.clear()

        for batch in chunked(batches, 1 << 20, "word"):
            words, n = batch.column("word").to_pylist(), batch.column("n").to_numpy()
            data = laid_out(words)
            at, back, word = positions(words)
            for d in range(depth + 1):
                some = back >= d
                codes, inverse = np.unique((context(data, at[some], d) << 8) | data[at[some]], return_inverse=True)
                held[d].append((codes, np.bincount(inverse, weights=n[word[some]])))
                size += len(codes)
            if size > 2_500_000:
                yield from flush()
                size = 0
        yield from flush()

    return counts.select("word", "n").mapInArrow(run, "ctx long, depth int, sym int, n long").groupBy("ctx", "depth", "sym").agg(F.sum("n").alias("n"))


@dataclass
class SuffixTree:
    """States by context code, their symbol counts, and for each the next shorter state."""

    depth: int
    states: np.ndarray  # sorted codes; the root is 1
    keys: np.ndarray  # sorted state number * 256 + symbol
    probability: np.ndarray
    backoff: np.ndarray  # weight left to the shorter state
    parent: np.ndarray

    @classmethod
    def build(cls, ctx: np.ndarray, sym: np.ndarray, n: np.ndarray, depth: int, prior: float = 1.0) -> SuffixTree:
        states = np.union1d(np.array([1], dtype=np.int64), ctx)
        at = np.searchsorted(states, ctx)
        total = np.bincount(at, weights=n, minlength=len(states))
        key = at * 256 + sym
        order = np.argsort(key)
        key, n, at, sym = key[order], n[order].astype(np.float64), at[order], sym[order]
        length = np.zeros(len(states), dtype=np.int64)
        for d in range(1, depth + 1):
            length += states >= 1 << 8 * d
        parent = np.zeros(len(states), dtype=np.int64)
        for d in range(depth):  # longer suffixes last: they stand
            some = np.flatnonzero(length > d)
            code = (states[some] & ((1 << 8 * d) - 1)) | (1 << 8 * d)
            j = np.minimum(np.searchsorted(states, code), len(states) - 1)
            hit = states[j] == code
            parent[some[hit]] = j[hit]
        tree = cls(depth, states, key, np.zeros(len(key)), prior / (total + prior), parent)
        for d in range(depth + 1):  # shorter states first: each leans on one that is done
            here = np.flatnonzero(length[at] == d)
            below = np.full(len(here), 1 / 256) if d == 0 else tree.p(parent[at[here]], sym[here])
            tree.probability[here] = (n[here] + prior * below) / (total[at[here]] + prior)
        return tree

    def p(self, state: np.ndarray, sym: np.ndarray) -> np.ndarray:
        """Probability of each symbol in each state."""
        out, weight = np.zeros(len(state)), np.ones(len(state))
        left = np.arange(len(state))
        state = state.copy()
        while len(left):
            key = state[left] * 256 + sym[left]
            if len(self.keys):
                k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[k] == key
                out[left[hit]] = weight[left[hit]] * self.probability[k[hit]]
            else:
                hit = np.zeros(len(left), dtype=bool)
            rest = left[~hit]
            weight[rest] *= self.backoff[state[rest]]
            root = state[rest] == 0
            out[rest[root]] = weight[rest[root]] / 256
            left = rest[~root]
            state[left] = self.parent[state[left]]
        return out

    def log10(self, words: list[bytes]) -> np.ndarray:
        """log10 probability of each word with its closing blank."""
        if not words:
            return np.zeros(0)
        data = laid_out(words)
        at, back, word = positions(words)
        state = np.zeros(len(at), dtype=np.int64)
        open_ = np.arange(len(at))
        for d in range(self.depth, 0, -1):
            some = open_[back[open_] >= d]
            code = context(data, at[some], d)
            k = np.minimum(np.searchsorted(self.states, code), len(self.states) - 1)
            hit = self.states[k] == code
            state[some[hit]] = k[hit]
            done = np.zeros(len(at), dtype=bool)
            done[some[hit]] = True
            open_ = open_[~done[open_]]
        return np.bincount(word, weights=np.log10(self.p(state, data[at])), minlength=len(words))


def learn(counts: DataFrame, depth: int = 5, gain: float = 12.0, max_states: int | None = None, least_share: float = 0.0) -> SuffixTree:
    """The tree over counted words, of every context that passes the gain test unless max_states is given.

    least_share: symbols of a context count if they make up that share of all bytes there, which
    bounds a depth's entries by 1/least_share at every size.
    """
    table = materialise(count_contexts(counts, depth), "contexts")
    if least_share:
        whole = table.filter("depth = 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        table = table.filter(F.col("n") >= least_share * whole)
    totals = table.groupBy("ctx").agg(F.sum("n").alias("total"))
    shorter = F.expr("(ctx & (shiftleft(1L, 8 * (depth - 1)) - 1)) | shiftleft(1L, 8 * (depth - 1))")
    withp = table.join(totals, "ctx").select("ctx", "depth", "sym", "n", (F.col("n") / F.col("total")).alias("p"))
    upper = withp.select(F.col("ctx").alias("short"), "sym", F.col("p").alias("q"))
    pairs = withp.filter("depth > 0").withColumn("short", shorter).join(upper, ["short", "sym"])
    # the counts of a context lie inside those of its suffix, so q > 0 wherever p > 0
    worth = pairs.groupBy("ctx").agg(F.sum(F.col("n") * F.log(F.col("p") / F.col("q"))).alias("gain"))
    best = worth.filter(F.col("gain") >= gain)
    if max_states is not None:
        best = best.orderBy(F.desc(F.round("gain", 6)), "ctx").limit(max_states)
    kept = table.join(best.select("ctx"), "ctx", "left_semi").unionByName(table.filter("depth = 0")).select("ctx", "sym", "n").toArrow()
    return SuffixTree.build(*(kept.column(c).to_numpy().astype(np.int64) for c in ("ctx", "sym", "n")), depth)


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def score(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 5, head: int = 150_000) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for docs, learned from train."""
    spark = docs.sparkSession
    counts = materialise(count_words(train, text_col), "words")
    size = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_all, n_words = int(size["n"]), int(size["v"])
    scale = math.log10(n_all + 0.5 * (n_words + 1))
    tree = learn(counts, depth)
    common = counts.orderBy(F.desc("n"), "word").limit(head).toArrow()
    shared = spark.sparkContext.broadcast((tree, dict(zip(common.column("word").to_pylist(), common.column("n").to_pylist(), strict=True))))
    names = {"doc_id": pa.int64(), "row": pa.int64(), "hash": pa.int64(), "tf": pa.int64(), "n_tokens": pa.int64(), "known": pa.int64(), "base": pa.float64(), "score": pa.float64()}
    schema = pa.schema(list(names.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, common = shared.value
        number, worth, c_of, hash_of = _Numbers(), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in chunked(batches):
            if len(number) > 400_000:
                number, worth, c_of, hash_of = _Numbers(), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)
            at = number.__getitem__
            docs_ = [tokens(t) for t in texts(batch.column("text"))]
            sizes = np.fromiter(map(len, docs_), dtype=np.int64, count=len(docs_))
            flat = np.fromiter((at(w) for d in docs_ for w in d), dtype=np.int64, count=int(sizes.sum()))
            new = list(number)[len(worth) :]
            worth = np.concatenate((worth, tree.log10(new)))
            c_of = np.concatenate((c_of, np.array([common.get(w, 0) for w in new], dtype=np.int64)))
            hash_of = np.concatenate((hash_of, np.array([xxhash.xxh64_intdigest(w, 42) for w in new], dtype=np.uint64).view(np.int64)))
            doc = np.repeat(np.arange(len(docs_)), sizes)
            c = c_of[flat]
            near = c > 0
            ids, rows = batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("row").to_numpy()
            base = np.bincount(doc[near], weights=np.log10(c[near] + 0.5) - scale, minlength=len(docs_))
            known = np.bincount(doc[near], minlength=len(docs_))
            total = np.bincount(doc, weights=worth[flat], minlength=len(docs_))
            zero, zerof = np.zeros(len(docs_), np.int64), np.zeros(len(docs_))
            # a document's own row has no count to look up; its hash only spreads it
            yield record_batch(schema, {"doc_id": batch.column("doc_id"), "row": rows, "hash": rows * 31 + 7, "tf": zero, "n_tokens": sizes, "known": known, "base": base, "score": total})
            pair, tf = np.unique(doc[~near] * np.int64(1 << 32) + flat[~near], return_counts=True)
            d, w = pair >> 32, pair & ((1 << 32) - 1)
            zero, zerof = np.zeros(len(d), np.int64), np.zeros(len(d))
            yield record_batch(schema, {"doc_id": pa.array(batch.column("doc_id").take(pa.array(d))), "row": rows[d], "hash": hash_of[w], "tf": tf, "n_tokens": zero, "known": zero, "base": zerof, "score": zerof})

    rows = take(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    parts = rows.mapInArrow(run, ", ".join(f"{n} {'double' if t == pa.float64() else 'long'}" for n, t in names.items()))
    rare = counts.select(F.xxhash64("word").alias("hash"), F.col("n").alias("c"))
    joined = parts.join(rare, "hash", "left")
    c, found = F.coalesce("c", F.lit(0)), F.col("tf") > 0
    summed = joined.groupBy("row", "doc_id").agg(
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("known") + F.when(found & (c > 0), F.col("tf")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + F.when(found, F.col("tf") * (F.log10(c + 0.5) - F.lit(scale))).otherwise(0.0)).alias("base_score"),
        F.sum("score").alias("score"),
    )
    return summed.select("doc_id", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score")

