"""Language-model scores from a probabilistic suffix tree over words, and over bytes where a word is new.

Symbols are tokens.  The root's distribution is that of the training tokens, with as much weight
as there are distinct words left for new ones; a new word is spelled by the byte tree of
suffix_lm, learned from the distinct words.  A context is the words before, up to `words` of them.
The tree grows a word at a time: contexts that make up `share` of the training tokens can be
states, which bounds the states of each length by 1/share at every size; such a context is a state
if the distribution of what follows it diverges from that of its longest suffix that is a state (or
the root's) by `gain` nats over its occurrences.  A context is frequent only if its suffixes are, so
none is missed.  A text is scored with the longest state before each token.  A state's distribution
is smoothed by absolute discounting: each distinct follower gives up one occurrence, and these are
dealt out as the state below has it.  What occurs once is so no evidence, neither for the text it
comes from nor for others.

With n(s,b) occurrences of b after the state s, T(s) distinct followers, and P(b) after the state
below (the root at last), log P(b|s) = log P(b) + log(T(s)/n(s)) + log(1 + (n(s,b)-1) / (T(s) P(b))).
All that a token needs is counted under its own word or under the shortest pair of a context and
the word that is not frequent, so it is looked up in one part.

Pairs of a context and a word are as many as the corpus is long, so they are neither collected nor
broadcast; those of each length are counted once the shorter contexts are known.  Each task
sums its own, deals them to parts by a hash and sends one blob a part; a part counts its pairs.
Texts then ask the parts in the same way and get sums by document back.  Pairs and words that
make up `share` of the corpus are known to all tasks (1/share of them at most) and ask nobody,
so no part has a hot key.  Words are known by 64-bit hashes there.

Defined results: a null, empty or blank text is the end token alone; with nothing to learn from
N is 0, the base score log10(0.5/0.5) a token and every word is spelled; repeated rows, and rows
without an id, count and score each; an empty table gives no rows; extra columns are ignored;
long texts score whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtide.llm.common import bucket_of_id, chunked, materialise, read_table, record_batch
from playtide.llm.suffix_lm import END, SuffixTree, count_words, learn, split, tokens  # noqa: F401

#: Bits of a state's or frequent word's number; the states of all lengths must stay below.
BITS = 21
NONE = (1 << BITS) - 1
#: Kinds of rows that are dealt out: what a part knows, what is asked of it, what is only passed on.
MODEL, STATS, FREQUENT, ASK, LOCAL, COUNTS = range(6)
_BLOBS = ("b0", "b1", "b2", "b3", "b4", "b5")
_SCHEMA = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("batch", pa.int64()), *[(b, pa.binary()) for b in _BLOBS]])
_DDL = "part int, kind int, batch long, " + ", ".join(f"{b} binary" for b in _BLOBS)


def planes(x: np.ndarray) -> bytes:
    """The bytes of an array, first bytes first: sorted numbers compress well so."""
    x = np.ascontiguousarray(x)
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def values(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def part_of(x: np.ndarray, parts: int) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    return ((x * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(33)) % np.uint64(parts)


def summed(keys: tuple[np.ndarray, ...], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct keys, sorted by the first one first, with their sums."""
    order = np.lexsort(keys[::-1])
    keys, n = [k[order] for k in keys], n[order]
    if not len(n):
        return keys, n
    new = np.ones(len(n), dtype=bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    cuts = np.flatnonzero(new)
    return [k[cuts] for k in keys], np.add.reduceat(n, cuts)


@dataclass
class Head:
    """The frequent words and the size of the corpus: the same for all tasks."""

    words: list[bytes]
    counts: np.ndarray
    total: int
    kinds: int

    def root(self, c: np.ndarray, spelled: np.ndarray | float = 0.0) -> np.ndarray:
        """log10 of the root's probability of words with these counts; new words are spelled."""
        if not self.total:
            return np.zeros(len(c)) + spelled
        whole = self.total + self.kinds
        return np.where(c > 0, np.log10(np.maximum(c, 1) / whole), math.log10(self.kinds / whole) + spelled)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.total + 0.5 * (self.kinds + 1)))


def _before(number: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Number of the word before each token, or NONE."""
    before = np.full(len(number), NONE, dtype=np.int64)
    before[1:] = np.where(number[:-1] >= 0, number[:-1], NONE)
    before[np.cumsum(sizes) - sizes] = NONE  # every text has a token
    return before


def _bytes(words: pa.Array) -> list[bytes]:
    """to_pylist() of words, without a scalar for each."""
    if not len(words):
        return []
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].tolist()
    data = words.buffers()[2].to_pybytes()
    return [data[i:j] for i, j in pairwise(ends)]


class _Reader:
    """Tokens of texts as numbers: frequent words by theirs, others by hash; new ones are spelled if there is a tree."""

    def __init__(self, head: Head, tree: SuffixTree | None = None):
        self.head, self.tree = pa.array(head.words, pa.binary()), tree
        self.end = self.head.index(END).as_py()  # -1 if not there

    def read(self, columns: list[pa.Array]) -> tuple[np.ndarray, ...]:
        """By token: text, number or -1, number of the word before or NONE; and tokens by text."""
        words, sizes = zip(*map(split, columns), strict=True)
        self.words, sizes = pa.concat_arrays(words), np.concatenate(sizes) + 1
        self.text, self.ends = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - 1
        number = np.full(len(self.text), self.end, dtype=np.int64)
        inner = np.ones(len(number), dtype=bool)
        inner[self.ends] = False
        number[inner] = pc.fill_null(pc.index_in(self.words, value_set=self.head), -1).to_numpy()
        return self.text, number, _before(number, sizes), sizes

    def others(self, at: np.ndarray, learned: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the tokens there, and log10 of their spelling; a text learned from has no new words, so none of its are spelled."""
        text = self.text[at]
        inner = at != self.ends[text]
        coded = self.words.take(pa.array((at - text)[inner])).dictionary_encode()
        names = [*_bytes(coded.dictionary), END]
        which = np.full(len(at), len(names) - 1)
        which[inner] = coded.indices.to_numpy()
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, names, repeat(42)), np.uint64, len(names))
        spelled = np.zeros(len(names), np.float32)
        if self.tree is not None:
            new = np.unique(which if learned is None else which[~learned[text]])
            spelled[new] = self.tree.log10([names[i] for i in new.tolist()])
        return hashes[which], spelled[which]


def _gathered(batches: Iterator[pa.RecordBatch], tokens_held: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches put together to about so many tokens (six bytes each)."""
    held, size = [], 0
    for batch in chunked(batches):
        held.append(batch)
        size += batch.nbytes
        if size >= 6 * tokens_held:
            yield held
            held, size = [], 0
    if held:
        yield held


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_SCHEMA)
    return record_batch(_SCHEMA, {f.name: list(c) for f, c in zip(_SCHEMA, columns, strict=True)})


def _runs(part: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Order by part, and where each part's run begins."""
    order = np.argsort(part.astype(np.uint16 if parts < 1 << 16 else np.uint32), kind="stable")  # 16 bits are sorted by digits
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def _find(names: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each x in the sorted names, and whether it is there."""
    if not len(names):
        return np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=bool)
    at = np.minimum(np.searchsorted(names, x), len(names) - 1)
    return at, names[at] == x


def _key(state: np.ndarray, word: np.ndarray) -> np.ndarray:
    return (state.astype(np.uint64) << np.uint64(BITS)) | word.astype(np.uint64)


class Known:
    """What all tasks know of contexts and of frequent pairs (context, word).

    Contexts of one word have the numbers of the frequent words; a frequent pair is itself a context
    of a word more, and has the number after those by its place in `pairs`.  Contexts of more
    words have higher numbers, so the pairs of all lengths are one sorted array.
    """

    def __init__(self, head: Head):
        self.words = len(head.words)
        self.counts = head.counts.astype(np.float64)
        self.pairs, self.worth = np.zeros(0, np.uint64), np.zeros(0)  # worth: log10 of the word's probability
        self.parent = np.full(self.words, NONE, np.int64)  # without the oldest word
        self.up = self.parent.copy()  # the longest proper suffix that is a state
        self.kept, self.kinds, self.weight = np.zeros(self.words, bool), np.zeros(self.words), np.zeros(self.words)
        self.first = 0  # of the longest contexts

    def top(self, context: np.ndarray) -> np.ndarray:
        """The longest suffix, itself included, that is a state."""
        out = context.copy()
        there = context != NONE
        c = context[there]
        out[there] = np.where(self.kept[c], c, self.up[c])
        return out

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """_find() among the pairs; many keys are looked up by hash."""
        if len(x) < len(self.pairs):
            return _find(self.pairs, x)
        at = pc.index_in(pa.array(x), value_set=pa.array(self.pairs))
        return pc.fill_null(at, 0).to_numpy(), at.is_valid().to_numpy(zero_copy_only=False)

    def contexts(self, number: np.ndarray, before: np.ndarray, words: int) -> list[np.ndarray]:
        """By length, the context of each token; NONE where it is not frequent or the text is too short."""
        out = [before]
        for _ in range(words - 1):
            last, longer = out[-1], np.full(len(before), NONE, np.int64)
            at = np.flatnonzero((before[1:] != NONE) & (last[:-1] != NONE))
            place, hit = self.find(_key(last[at], number[at]))
            longer[at[hit] + 1] = self.words + place[hit]
            out.append(longer)
        return out

    def suffixes(self, context: np.ndarray, words: int) -> list[np.ndarray]:
        """By length, the suffixes of contexts of so many words, themselves included."""
        out = [context]
        for _ in range(words - 1):
            out.insert(0, self.parent[out[0]])
        return out

    def route(self, contexts: list[np.ndarray], word: np.ndarray) -> np.ndarray:
        """The shortest pair of one of the contexts and the word that is not frequent, or else the longest."""
        out = _key(contexts[0], word)
        open_ = np.arange(len(word))
        for longer in contexts[1:]:
            open_ = open_[(longer[open_] != NONE) & self.find(out[open_])[1]]
            out[open_] = _key(longer[open_], word[open_])
        return out

    def log10(self, state: np.ndarray, root: np.ndarray, times) -> np.ndarray:
        """log10 of the probability of words after states (or NONE), root being that at the root; times(states, where) counts the pairs."""
        chain, at = [], state
        while (at != NONE).any():
            chain.append(at)
            at = np.where(at != NONE, self.up[np.where(at != NONE, at, 0)], NONE)
        p = np.array(root, dtype=np.float64)
        for at in reversed(chain):
            live = np.flatnonzero(at != NONE)
            s = at[live]
            more = np.maximum(times(s, live) - 1.0, 0.0)
            p[live] += self.weight[s] + np.log10(1 + more / (self.kinds[s] * 10.0 ** p[live]))
        return p

    def times(self, key: np.ndarray) -> np.ndarray:
        """How often frequent pairs occur, 0 for others."""
        at, hit = _find(self.pairs, key)
        out = np.zeros(len(key))
        out[hit] = self.counts[self.words + at[hit]]
        return out

    def grow(self, head: Head, kinds: np.ndarray, total: np.ndarray, gain: float, pairs: np.ndarray, n: np.ndarray) -> None:
        """Settle which of the longest contexts are states, and take up their frequent pairs."""
        new = slice(self.first, len(self.counts))
        self.kinds[new] = kinds[new]
        self.kept[new] = (total[new] >= gain) & (kinds[new] > 0)
        self.weight = np.where(self.kept, np.log10(np.maximum(self.kinds, 1) / np.maximum(self.counts, 1)), 0.0)
        order = np.argsort(pairs)
        pairs, n = pairs[order], n[order].astype(np.float64)
        self.first = len(self.counts)
        context, word = (pairs >> np.uint64(BITS)).astype(np.int64), (pairs & np.uint64(NONE)).astype(np.int64)
        short = self.parent[context] if len(pairs) else context
        place, _ = _find(self.pairs, _key(short, word))
        parent = np.where(short == NONE, word, self.words + place)
        self.pairs, self.counts = np.concatenate((self.pairs, pairs)), np.concatenate((self.counts, n))
        self.parent = np.concatenate((self.parent, parent))
        self.up = np.concatenate((self.up, self.top(parent) if len(parent) else parent))
        none = np.zeros(len(pairs))
        self.kept, self.kinds, self.weight = np.concatenate((self.kept, none.astype(bool))), np.concatenate((self.kinds, none)), np.concatenate((self.weight, none))
        worth = self.log10(self.top(context), head.root(head.counts)[word] if len(word) else none, lambda s, at: self.times(_key(s, word[at])))
        self.worth = np.concatenate((self.worth, worth))


def count_pairs(train: DataFrame, head, parts: int, text_col: str, tokens_held: int, known=None, words: int = 1) -> DataFrame:
    """Blobs of pairs by part, of contexts of so many words: (context, frequent word) with counts, and (other word, context) with counts.

    Those of one word also count every other word, after NONE where nothing frequent stands before it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = head.value
        k = Known(h) if known is None else known.value
        reader = _Reader(h)
        for held in _gathered(batches, tokens_held):
            _, number, before, _ = reader.read([b.column("text") for b in held])
            contexts = k.contexts(number, before, words)
            last = contexts[-1]
            both = (number >= 0) & (last != NONE)
            pair, n = np.unique(_key(last[both], number[both]), return_counts=True)
            to = k.route(k.suffixes((pair >> np.uint64(BITS)).astype(np.int64), words), (pair & np.uint64(NONE)).astype(np.int64))
            rare = np.flatnonzero((number < 0) & ((last != NONE) | (words == 1)))
            other, _ = reader.others(rare)
            (word, state), m = summed((other, last[rare]), np.ones(len(other), np.int64))
            o, at = _runs(part_of(to, parts), parts)
            p, on = _runs(part_of(word, parts), parts)
            pair, n, word, state, m = pair[o], n[o], word[p], state[p], m[p]
            out = []
            for i in range(parts):
                x, y = slice(at[i], at[i + 1]), slice(on[i], on[i + 1])
                if x.start < x.stop or y.start < y.stop:
                    out.append((i, COUNTS, 0, planes(pair[x]), planes(n[x].astype(np.uint32)), planes(word[y]), planes(state[y].astype(np.uint32)), planes(m[y].astype(np.uint32)), None))
            if out:
                yield _rows(out)

    return train.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, _DDL)


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows of each part, which stand together."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0]["part"] != row["part"]:
                yield held[0]["part"], held
                held = []
            held.append(row)
    if held:
        yield held[0]["part"], held


class _Part:
    """What a part knows: pairs that occur twice or more, counts of other words, and pairs of a context and such a word."""

    def __init__(self, rows: list[dict]):
        columns = [[values(r[b], np.uint64) for r in rows] or [np.zeros(0, np.uint64)] for b in _BLOBS]
        self.pair, self.n, self.other, self.c, self.key, self.m = map(np.concatenate, columns)
        if len(rows) > 1:  # contexts of more words have higher numbers, so pairs are sorted as they are
            order = np.argsort(self.key, kind="stable")
            self.key, self.m = self.key[order], self.m[order]

    @staticmethod
    def _times(names: np.ndarray, n: np.ndarray, x: np.ndarray) -> np.ndarray:
        at, hit = _find(names, x)
        return np.where(hit, n[at], 0).astype(np.float64) if len(n) else np.zeros(len(x))

    def after(self, known: Known, state: np.ndarray, word: np.ndarray, root: np.ndarray) -> np.ndarray:
        """log10 of the probability of frequent words after states."""

        def times(s: np.ndarray, at: np.ndarray) -> np.ndarray:
            key = _key(s, word[at])
            return np.maximum(known.times(key), self._times(self.pair, self.n, key))

        return known.log10(state, root, times)

    def other_after(self, known: Known, state: np.ndarray, place: np.ndarray, there: np.ndarray, root: np.ndarray) -> np.ndarray:
        """The same for other words, by their places, where they are there."""
        return known.log10(state, root, lambda s, at: np.where(there[at], self._times(self.key, self.m, _key(place[at], s)), 0.0))


def model_parts(pairs: DataFrame, head, parts: int, share: float, known=None, model: DataFrame | None = None, words: int = 1) -> DataFrame:
    """What each part knows of contexts of so many words: MODEL rows, STATS by block of contexts, FREQUENT pairs.

    known and model are what is known of shorter contexts, which the divergence is measured against.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = head.value
        k = Known(h) if known is None else known.value
        least = max(2.0, share * h.total)
        of_word = h.root(h.counts)
        for part, rows in _by_part(batches):
            below = _Part([r for r in rows if r["kind"] == MODEL])
            rows = [r for r in rows if r["kind"] == COUNTS]
            get = lambda b, dtype: np.concatenate([values(r[b], dtype) for r in rows] or [np.zeros(0, dtype)])  # noqa: E731, B023
            (pair,), n = summed((get("b0", np.uint64),), get("b1", np.uint32).astype(np.int64))
            (word, state), m = summed((get("b2", np.uint64), get("b3", np.uint32)), get("b4", np.uint32).astype(np.int64))
            other = c = np.zeros(0, np.uint64)
            if words == 1:
                (other,), c = summed((word,), m)
                below.other, below.c = other, c
            place = np.searchsorted(below.other, word)
            # a context's distinct followers and its divergence, as far as this part's pairs go
            first, second = (pair >> np.uint64(BITS)).astype(np.int64), (pair & np.uint64(NONE)).astype(np.int64)
            after = state != NONE
            behind, spot = state[after].astype(np.int64), place[after]
            s = np.concatenate((first, behind))
            times = np.concatenate((n, m[after])).astype(np.float64)
            lower = below.after(k, k.up[first], second, of_word[second]) if len(pair) else np.zeros(0)
            rest = below.other_after(k, k.up[behind], spot, np.ones(len(spot), bool), h.root(below.c[spot].astype(np.float64))) if len(spot) else np.zeros(0)
            gain = times * (np.log(times / k.counts[s]) - math.log(10) * np.concatenate((lower, rest)))
            some, at = np.unique(s, return_inverse=True)
            kinds, total = np.bincount(at, minlength=len(some)), np.bincount(at, weights=gain, minlength=len(some))
            out = []
            for block in np.unique(some >> 12).tolist():
                x = (some >> 12) == block
                out.append((block, STATS, 0, planes(some[x].astype(np.uint32)), planes(kinds[x].astype(np.uint32)), planes(total[x]), None, None, None))
            often = n >= least
            if often.any():
                out.append((part, FREQUENT, 0, planes(pair[often]), planes(n[often].astype(np.uint64)), None, None, None, None))
            twice, again = n > 1, after & (m > 1)
            key = _key(place[again], state[again])
            out.append((part, MODEL, words, planes(pair[twice]), planes(n[twice].astype(np.uint64)), planes(other), planes(c.astype(np.uint64)), planes(key), planes(m[again].astype(np.uint64))))
            yield _rows(out)

    if model is not None:
        pairs = pairs.unionByName(model.filter(F.col("kind") == MODEL))
    return pairs.repartitionById(parts, "part").sortWithinPartitions("part", "kind", "batch").mapInArrow(run, _DDL)


def states(model: DataFrame, contexts: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct followers of each context, and its divergence.  The driver gets a row for a block of 4,096."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, np.ndarray] = {}
        for batch in batches:
            for r in batch.to_pylist():
                sums = out.setdefault(r["part"], np.zeros((2, 4096)))
                at = values(r["b0"], np.uint32).astype(np.int64) & 4095
                sums[0, at] += values(r["b1"], np.uint32)
                sums[1, at] += values(r["b2"], np.float64)
        yield _rows([(block, STATS, 0, sums[0].tobytes(), sums[1].tobytes(), None, None, None, None) for block, sums in out.items()])

    kinds, total = np.zeros(contexts), np.zeros(contexts)
    for r in model.filter(F.col("kind") == STATS).repartition("part").mapInArrow(run, _DDL).collect():
        low = r["part"] << 12
        k = len(kinds[low : low + 4096])
        kinds[low : low + k] = np.frombuffer(r["b0"])[:k]
        total[low : low + k] = np.frombuffer(r["b1"])[:k]
    return kinds, total


def take_up(known: Known, model: DataFrame, head: Head, gain: float) -> None:
    """Let known grow by what the model's parts have found out about the longest contexts."""
    kinds, total = states(model, len(known.counts))
    found = model.filter(F.col("kind") == FREQUENT).select("b0", "b1").collect()  # 1/share pairs at most
    pairs = np.concatenate([values(r["b0"], np.uint64) for r in found]) if found else np.zeros(0, np.uint64)
    n = np.concatenate([values(r["b1"], np.uint64) for r in found]) if found else np.zeros(0, np.uint64)
    known.grow(head, kinds, total, gain, pairs, n)


def ask(docs: DataFrame, head, tree, known, parts: int, id_col: str, text_col: str, tokens_held: int, words: int = 1, learned: Column | None = None) -> DataFrame:
    """A LOCAL row for each batch of documents, with what its task can tell, and ASK rows for the parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, k = head.value, known.value
        reader = _Reader(h, tree.value)
        of_word, base_of = h.root(h.counts), h.base(h.counts)
        batch_id = TaskContext.get().partitionId() << 32
        for held in _gathered(batches, tokens_held):
            doc, number, before, sizes = reader.read([b.column("text") for b in held])
            near = number >= 0
            n_known = np.bincount(doc[near], minlength=len(sizes))
            base = np.bincount(doc[near], weights=base_of[number[near]], minlength=len(sizes))
            contexts = k.contexts(number, before, words)
            state = before.copy()
            for longer in contexts[1:]:
                np.copyto(state, longer, where=longer != NONE)
            state = k.top(state)
            alone = near & (state == NONE)
            score = np.bincount(doc[alone], weights=of_word[number[alone]], minlength=len(sizes))
            both = np.flatnonzero(near & (state != NONE))
            pair = _key(state[both], number[both])
            at, hit = k.find(pair)
            score += np.bincount(doc[both[hit]], weights=k.worth[at[hit]], minlength=len(sizes))
            pair, both = pair[~hit], both[~hit]
            order = np.argsort(pair, kind="stable")
            pair, both = pair[order], both[order]
            d, to = doc[both], k.route([c[both] for c in contexts], number[both])
            rare = np.flatnonzero(~near)
            word, letters = reader.others(rare, np.concatenate([b.column("learned").to_numpy(zero_copy_only=False) for b in held]))
            state, of = state[rare], doc[rare]
            order = np.argsort(word, kind="stable")
            word, state, of, letters = word[order], state[order], of[order], letters[order]
            o, at = _runs(part_of(to, parts), parts)
            p, on = _runs(part_of(word, parts), parts)
            pair, d, word, state, of, letters = pair[o], d[o].astype(np.uint32), word[p], state[p].astype(np.uint32), of[p].astype(np.uint32), letters[p]
            out = []
            for i in range(parts):
                x, y = slice(at[i], at[i + 1]), slice(on[i], on[i + 1])
                if x.start < x.stop or y.start < y.stop:
                    out.append((i, ASK, batch_id, planes(pair[x]), planes(d[x]), planes(word[y]), planes(state[y]), planes(of[y]), planes(letters[y])))
            ids = pa.chunked_array([b.column("doc_id") for b in held])
            null = ids.is_null().to_numpy().astype(np.uint8)
            out.append((batch_id % parts, LOCAL, batch_id, ids.fill_null(0).to_numpy().tobytes(), null.tobytes(), sizes.tobytes(), n_known.tobytes(), base.tobytes(), score.tobytes()))
            yield _rows(out)
            batch_id += 1

    learned = F.lit(False) if learned is None else F.coalesce(learned, F.lit(False))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), learned.alias("learned")).mapInArrow(run, _DDL)


def answer(asked: DataFrame, model: DataFrame, head, known, parts: int) -> DataFrame:
    """LOCAL rows as they are, and for each ASK row the sums of its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, k = head.value, known.value
        of_word = h.root(h.counts)
        part, rows, here = None, [], _Part([])

        def sums(r: dict) -> tuple:
            p, d = values(r["b0"], np.uint64), values(r["b1"], np.uint32)
            first, second = (p >> np.uint64(BITS)).astype(np.int64), (p & np.uint64(NONE)).astype(np.int64)
            worth = here.after(k, first, second, of_word[second]) if len(p) else np.zeros(0)
            word, state, of = values(r["b2"], np.uint64), values(r["b3"], np.uint32).astype(np.int64), values(r["b4"], np.uint32)
            at, there = _find(here.other, word)
            times = np.where(there, here.c[at] if len(here.c) else 0, 0).astype(np.float64)
            score = here.other_after(k, state, at, there, h.root(times, values(r["b5"], np.float32).astype(np.float64)))
            size = int(max(d.max(initial=0), of.max(initial=0))) + 1
            total = np.bincount(d, weights=worth, minlength=size) + np.bincount(of, weights=score, minlength=size)
            known_ = np.bincount(of[there], minlength=size)
            base = np.bincount(of, weights=h.base(times), minlength=size)
            idx = np.flatnonzero((total != 0) | (base != 0) | (known_ != 0))
            return idx.astype(np.uint32), total[idx].astype(np.float32), known_[idx].astype(np.uint32), base[idx]

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["part"] != part:
                    part, rows, here = r["part"], [], _Part([])
                if r["kind"] == MODEL:
                    rows.append(r)
                elif r["kind"] == LOCAL:
                    out.append(tuple(r.values()))
                else:
                    if rows:
                        rows, here = [], _Part(rows)
                    idx, total, known_, base = sums(r)
                    if len(idx):
                        out.append((r["part"], ASK, r["batch"], planes(idx), planes(total), planes(known_), planes(base), None, None))
            if out:
                yield _rows(out)

    rows = asked.unionByName(model.filter(F.col("kind") == MODEL))
    return rows.repartitionById(parts, "part").sortWithinPartitions("part", "kind", "batch").mapInArrow(run, _DDL)


def total(answers: DataFrame, train_tokens: int) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) from the rows of each batch, its LOCAL row first."""
    names = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "n_known": pa.int64(), "train_tokens": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}
    schema = pa.schema(list(names.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = null = sizes = n_known = base = score = None

        def done() -> pa.RecordBatch:
            out = {"doc_id": pa.array(ids, mask=null.astype(bool)), "n_tokens": sizes, "n_known": n_known, "train_tokens": np.full(len(ids), train_tokens, np.int64), "base_score": base, "score": score}
            return record_batch(schema, out)

        for batch in batches:
            for r in batch.to_pylist():
                if r["kind"] == LOCAL:
                    if ids is not None:
                        yield done()
                    ids, null = np.frombuffer(r["b0"], np.int64), np.frombuffer(r["b1"], np.uint8)
                    sizes, n_known = np.frombuffer(r["b2"], np.int64), np.frombuffer(r["b3"], np.int64).copy()
                    base, score = np.frombuffer(r["b4"]).copy(), np.frombuffer(r["b5"]).copy()
                else:
                    idx = values(r["b0"], np.uint32)
                    score[idx] += values(r["b1"], np.float32)
                    n_known[idx] += values(r["b2"], np.uint32)
                    base[idx] += values(r["b3"], np.float64)
        if ids is not None:
            yield done()

    ddl = ", ".join(f"{n} {'double' if t == pa.float64() else 'long'}" for n, t in names.items())
    return answers.repartition("batch").sortWithinPartitions("batch", F.desc("kind"), "part").mapInArrow(run, ddl)


def score(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = 2e-6, gain: float = 12.0, depth: int = 5, least_share: float = 1e-6, parts: int | None = None, tokens_held: int = 700_000, words: int = 1, learned: Column | None = None) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for docs, learned from train.

    words: of a context, at most.  share: of the training tokens, what makes a word or a pair frequent.  least_share: of all
    bytes of distinct words, what a context and symbol of the byte tree need.  parts: by default
    the number of shuffle partitions.  learned: true for rows of docs that are among train; they have no new words to spell.
    """
    if (words + 1) / share >= NONE:
        raise ValueError("share is too small")
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = materialise(count_words(train, text_col), "words")
    size = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    frequent = counts.filter(F.col("n") >= share * size["n"]).orderBy("word").toArrow()
    head = Head(frequent.column("word").to_pylist(), frequent.column("n").to_numpy().astype(np.float64), int(size["n"]), int(size["v"]))
    tree = learn(counts.select("word", F.lit(1).cast("long").alias("n")), depth, gain, least_share=least_share)
    context = spark.sparkContext
    shared = context.broadcast(head)
    known, told, model = Known(head), None, None
    for length in range(1, words + 1):
        pairs = count_pairs(train, shared, parts, text_col, tokens_held, told, length)
        found = materialise(model_parts(pairs, shared, parts, share, told, model, length), "pairs")
        take_up(known, found, head, gain)
        told = context.broadcast(known)
        model = found if model is None else model.unionByName(found)
        if known.first == len(known.counts):  # no longer context is frequent
            break
    asked = ask(docs, shared, context.broadcast(tree), told, parts, id_col, text_col, tokens_held, length, learned)
    return total(answer(asked, model, shared, told, parts), head.total)


def op9_suffix_tree_lm(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = bucket_of_id(F.col("doc_id")).eqNullSafe(1)
    out = score(docs, docs.filter(~held_out), words=3, learned=~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
