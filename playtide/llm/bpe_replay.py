"""Byte-level BPE by replaying the merges over a corpus of words at once.

A task collects the distinct words of a block of texts (matches of the pattern), lays them out
as one array of symbols and keeps an inverted index from each merge rank to the places where
its pair stands.  Merges are applied in rank order, each to all its places together; only the
neighbours of a merged place change, and their new pairs join the index.  Texts are then put
together from their words' ids.

Defined results: a null or empty text has no ids, and the digests of nothing; repeated rows give
equal results; an empty table gives no rows; extra columns are ignored; very long texts and
words are encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from playtide.llm.common import chunked, read_table, record_batch, take


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class MergeReplay:
    """Ids of words under a rank table."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.symbol = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.table = {v: k for k, v in ranks.items()}
        self.span = max(ranks.values()) + 2
        keys, values = [], []
        for whole, rank in ranks.items():  # every split of a token into two tokens is a pair that merges
            for i in range(1, len(whole)):
                a, b = ranks.get(whole[:i]), ranks.get(whole[i:])
                if a is not None and b is not None:
                    keys.append(a * self.span + b)
                    values.append(rank)
        order = np.argsort(np.array(keys, dtype=np.int64))
        self.keys = np.array(keys, dtype=np.int64)[order]
        self.values = np.array(values, dtype=np.int64)[order]

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's merge, or -1."""
        key = np.where((left < 0) | (right < 0), -1, left * self.span + right)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], -1)

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word; a word that is itself a token is that token."""
        whole = [self.ranks.get(w) for w in words]
        merged = iter(self._replay([w for w, r in zip(words, whole, strict=True) if r is None]))
        return [next(merged) if r is None else [r] for r in whole]

    def _replay(self, words: list[bytes]) -> list[list[int]]:
        if not words:
            return []
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        # words lie side by side, a wall (-1) after each and one in front
        n = int(sizes.sum()) + len(words) + 1
        sym = np.full(n, -1, dtype=np.int64)
        ends = np.cumsum(sizes + 1)
        body = np.ones(n, dtype=bool)
        body[0] = False
        body[ends] = False
        sym[body] = self.symbol[np.frombuffer(b"".join(words), dtype=np.uint8)]
        nxt = np.arange(1, n + 1, dtype=np.int64)
        prv = np.arange(-1, n - 1, dtype=np.int64)
        nxt[-1] = n - 1
        alive = np.ones(n, dtype=bool)
        rank = np.full(n, -1, dtype=np.int64)
        rank[:-1] = self.rank_of(sym[:-1], sym[1:])
        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def post(places: np.ndarray) -> None:
            places = places[rank[places] >= 0]
            if not len(places):
                return
            places = places[np.argsort(rank[places], kind="stable")]
            r = rank[places]
            cuts = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
            for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(r)], strict=True):
                k = int(r[i])
                if k not in index:
                    index[k] = []
                    heapq.heappush(queue, k)
                index[k].append(places[i:j])

        post(np.arange(n))
        while queue:
            k = heapq.heappop(queue)
            found = index.pop(k)
            at = found[0] if len(found) == 1 else np.concatenate(found)
            at = at[alive[at] & (rank[at] == k)]
            if not len(at):
                continue
            at = np.unique(at)
            # of pairs that overlap, every second one merges, from the left
            chained = np.concatenate(([False], nxt[at[:-1]] == at[1:]))
            if chained.any():
                head = np.maximum.accumulate(np.where(~chained, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - head) % 2 == 0]
            gone = nxt[at]
            after = nxt[gone]
            sym[at] = k
            alive[gone] = False
            rank[gone] = -1
            nxt[at] = after
            prv[after] = at
            touched = np.unique(np.concatenate((at, prv[at])))
            rank[touched] = self.rank_of(sym[touched], sym[nxt[touched]])
            post(touched)
        kept = np.flatnonzero(alive)
        kept = kept[kept > 0]
        ids, walls = sym[kept], np.flatnonzero(sym[kept] < 0)
        flat = ids.tolist()
        starts = [0, *(walls[:-1] + 1).tolist()]
        return [flat[i:j] for i, j in zip(starts, walls.tolist(), strict=True)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.table.__getitem__, ids))


class _Numbers(dict):
    """Numbers words as they are first met."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class CorpusEncoder:
    """Encodes blocks of texts; keeps the results of at most `limit` distinct words."""

    def __init__(self, replay: MergeReplay, pattern: str, limit: int = 300_000):
        self.replay, self.limit = replay, limit
        self.split = regex.compile(pattern).findall
        self._forget()

    def _forget(self) -> None:
        self.numbers, self.ids, self.texts, self.bytes = _Numbers(), [], [], []

    def block(self, texts: list[str]) -> list[np.ndarray]:
        """Word numbers of each text; afterwards ids, texts and bytes hold the words' results."""
        if len(self.numbers) > self.limit:
            self._forget()
        have = len(self.numbers)
        number = self.numbers.__getitem__
        out = [np.fromiter(map(number, self.split(t)), dtype=np.int32) for t in texts]
        new = [w.encode() for w in list(self.numbers)[have:]]
        for ids in self.replay.encode(new):
            self.ids.append(ids)
            self.texts.append(" ".join(map(str, ids)))
            self.bytes.append(self.replay.decode(ids))
        return out


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, pattern: str | None = None, block: int = 24 << 20) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): ids as decimal text joined by one space, decoded as bytes."""
    return _run(docs, id_col, text_col, ranks, pattern, block, False)


def encode_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, pattern: str | None = None, block: int = 24 << 20) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode() without its texts leaving the task."""
    return _run(docs, id_col, text_col, ranks, pattern, block, True)


def _run(docs, id_col, text_col, ranks, pattern, block, digests) -> DataFrame:
    if ranks is None or pattern is None:
        import public_tokenizers

        ranks = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
        pattern = pattern or public_tokenizers.PATTERN
    names = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256") if digests else ("doc_id", "n_tokens", "ids", "decoded")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string() if digests else pa.binary())
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = CorpusEncoder(MergeReplay(load_ranks(ranks)), pattern)
        held: list[tuple[list[int], list[str]]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            doc_ids = [i for ids, _ in held for i in ids]
            numbered = encoder.block([t for _, ts in held for t in ts])
            counts = np.fromiter(map(len, encoder.ids), dtype=np.int64, count=len(encoder.ids))
            out: dict[str, list] = {n: [] for n in names}
            room = 0
            for i, w in zip(doc_ids, numbered, strict=True):
                words = w.tolist()
                text = " ".join(map(encoder.texts.__getitem__, words))
                data = b"".join(map(encoder.bytes.__getitem__, words))
                room += 0 if digests else len(text) + len(data)
                row = (i, int(counts[w].sum()), *((hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(data).hexdigest()) if digests else (text, data)))
                for n, x in zip(names, row, strict=True):
                    out[n].append(x)
                if room > 8 << 20:
                    yield record_batch(schema, out)
                    out, room = {n: [] for n in names}, 0
            yield record_batch(schema, out)
            held.clear()

        for batch in chunked(batches):
            ts = [t or "" for t in batch.column("text").to_pylist()]
            held.append((batch.column("doc_id").to_pylist(), ts))
            size += sum(map(len, ts))
            if size >= block:
                yield from flush()
                size = 0
        if held:
            yield from flush()

    ddl = ", ".join(f"{n} {'string' if k == pa.string() else 'binary' if k == pa.binary() else 'long'}" for n, k in zip(names, kinds, strict=True))
    return take(docs, id_col, text_col).mapInArrow(run, ddl)


def op7_bpe_replay(spark, sf_dir: str) -> DataFrame:
    return encode_digests(read_table(spark, sf_dir, "documents"))
