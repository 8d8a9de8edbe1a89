"""Best-fit packing by bin completion.

The packer sees only how many pieces there are of each length, at most `capacity` numbers, so
it runs on the driver whatever the corpus.  A bin is completed around the largest piece left:
fillings of the room beside it are listed by the waste they leave, least first, and dominated
ones are passed over (a filling is dominated if a piece outside it can take the place of some of
its pieces that fit into that piece).  Branches whose waste, with that of the bins before, rules
out fewer bins than the best plan so far are cut.  Many equal bins are completed at once; the
last pieces one bin at a time.  Best-fit decreasing gives the first plan to beat.

Fewest bins are NP-hard, so the search ends at a lower bound (volume, and that of Martello and
Toth), when all branches of its last `back` steps are done, or after `nodes` fillings; a plan then holds every piece all the same, and only its number of bins may be above the least.  Pieces learn their places from
their rank among those of their length.

Defined results: a null or empty text is the end id alone; texts longer than the capacity are
cut into full pieces after a first one that may be shorter; repeated rows, and rows without an
id, are packed each; an empty table packs to no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from playtide.llm.common import chunked, materialise, read_table, record_batch, take
from playtide.llm.tokens import PieceEncoder

CAPACITY = 2048
END = 0
Pattern = tuple[tuple[int, int], ...]  # (length, copies), longest first


def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the pieces of each document's ids."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    path = tokenizer
    names = ("doc_id", "piece", "start", "length", "ids_crc32")
    schema = pa.schema([(n, pa.int32() if n == "piece" else pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder.shared(path)
        for batch in chunked(batches):
            ids, n = encoder.encode([t or "" for t in batch.column("text").to_pylist()], end)
            raw = ids.astype("<u4").tobytes()
            parts = -(-n // capacity)
            row = np.repeat(np.arange(len(n)), parts)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
            first = n - (parts - 1) * capacity
            length = np.where(piece == 0, first[row], capacity)
            start = np.where(piece == 0, 0, first[row] + (piece - 1) * capacity)
            at = 4 * ((np.cumsum(n) - n)[row] + start)
            crc = [zlib.crc32(raw[a : a + 4 * k]) for a, k in zip(at.tolist(), length.tolist(), strict=True)]
            yield record_batch(schema, {"doc_id": batch.column("doc_id").take(pa.array(row)), "piece": piece.astype(np.int32), "start": start, "length": length, "ids_crc32": crc})
        PieceEncoder.rest()

    return take(docs, id_col, text_col).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _pattern(lengths: list[int]) -> Pattern:
    return tuple((x, lengths.count(x)) for x in sorted(set(lengths), reverse=True))


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing over counts: equal bins are handled together."""
    bins: dict[int, list[tuple[list[int], int]]] = {capacity: []}
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = next((r for r in range(length, capacity) if bins.get(r)), None)
            if room is None:
                per = capacity // length
                full, rest = divmod(left, per)
                if full:
                    bins.setdefault(capacity - per * length, []).append(([length] * per, full))
                if rest:
                    bins.setdefault(capacity - rest * length, []).append(([length] * rest, 1))
                left = 0
                continue
            items, k = bins[room].pop()
            m = min(k, left)
            if k > m:
                bins[room].append((items, k - m))
            bins.setdefault(room - length, []).append(([*items, length], m))
            left -= m
    return [(_pattern(items), k) for group in bins.values() for items, k in group]


def least_bins(counts: dict[int, int], capacity: int) -> int:
    """A lower bound: the volume, and for each k the pieces over capacity - k, those over half, and what is left of the middle ones beside these (Martello and Toth)."""
    lengths = sorted(counts, reverse=True)
    best = -(-sum(x * counts[x] for x in lengths) // capacity)
    over_half = sum(counts[x] for x in lengths if 2 * x > capacity)
    for k in {x for x in lengths if 2 * x <= capacity}:
        half = [x for x in lengths if capacity < 2 * x <= 2 * (capacity - k)]
        room = sum((capacity - x) * counts[x] for x in half)
        small = sum(x * counts[x] for x in lengths if k <= x and 2 * x <= capacity)
        best = max(best, over_half + max(0, -(-(small - room) // capacity)))
    return max(best, over_half)


def _smear(bits: int, n: int) -> int:
    """Every bit spread to the n places above it."""
    have = 0
    while have < n:
        step = min(have + 1, n - have)
        bits |= bits << step
        have += step
    return bits


def _dominated(filling: list[int], waste: int, stock: dict[int, int], lengths: int) -> bool:
    """Whether a piece outside the filling can stand for pieces in it that would fit into that piece.  lengths: those in stock, as bits."""
    for x in set(filling):
        if filling.count(x) == stock[x]:
            lengths &= ~(1 << x)
    pairs, seen, longer = 0, 1, 0
    for x in filling:
        pairs |= (seen & ~1) << x  # sums of two pieces or more
        seen |= seen << x
        longer |= _smear(1 << x, waste) & ~(1 << x)
    fresh = _smear(1, waste) & ~1  # one more piece
    return bool(lengths & (_smear(pairs, waste) | longer | fresh))


def fillings(stock: dict[int, int], room: int) -> Iterator[list[int] | None]:
    """Undominated sets of pieces of the stock that fit the room, the least waste first, long pieces first, with None for each dominated one."""
    lengths = sorted((x for x, n in stock.items() if n and x <= room), reverse=True)
    there = sum(1 << x for x, n in stock.items() if n)
    full = (1 << room + 1) - 1
    reach = [1]  # sums that the lengths from some place on can make
    for x in reversed(lengths):
        bits, rest, k = reach[-1], min(stock[x], room // x), 1
        while rest > 0:
            k = min(k, rest)
            bits |= bits << k * x & full
            rest, k = rest - k, 2 * k
        reach.append(bits & full)
    reach.reverse()

    def make(i: int, left: int) -> Iterator[list[int]]:
        if not left:
            yield []
            return
        # the next length that takes part; those skipped can be left out as long as the rest reaches the sum
        for j in range(i, len(lengths)):
            if not reach[j] >> left & 1:
                return
            x = lengths[j]
            for c in range(min(stock[x], left // x), 0, -1):
                if reach[j + 1] >> left - c * x & 1:
                    for more in make(j + 1, left - c * x):
                        yield [x] * c + more

    for total in range(room, -1, -1):
        if reach[0] >> total & 1:
            for found in make(0, total):
                yield None if _dominated(found, room - total, stock, there) else found


def complete_bins(counts: dict[int, int], capacity: int = CAPACITY, tail: int = 64, nodes: int = 300_000, back: int = 128) -> list[tuple[Pattern, int]]:
    """Patterns and how often each is used; together they hold every piece counted.

    tail: from so many pieces on, bins are completed one at a time.  nodes: fillings tried before
    the best plan so far is taken.  back: steps that can be taken back.
    """
    counts = {k: v for k, v in counts.items() if v}
    if any(not 0 < x <= capacity for x in counts):
        raise ValueError("a piece does not fit")
    volume = sum(k * v for k, v in counts.items())
    bound = least_bins(counts, capacity) if counts else 0
    plan = best_fit(counts, capacity)
    # a plan of completed bins is taken if it needs no more bins than best fit does
    limit = sum(m for _, m in plan) + 1
    stock, left, bins, waste = dict(counts), sum(counts.values()), 0, 0
    # a step back undoes its bins: (fillings still to try, pattern, how often, waste)
    trail: list[tuple[Iterator[list[int]] | None, Pattern, int, int]] = []
    ahead: Iterator[list[int]] | None = None
    spent = 0
    while spent < nodes or not trail:
        if not left:
            if bins < limit:
                plan, limit = [(p, m) for _, p, m, _ in trail], bins
            if limit <= bound:
                break
            choices = iter(())
        elif ahead is None:
            top = max(stock)
            stock[top] -= 1
            choices = fillings(dict(stock), capacity - top)
            stock[top] += 1
            spent += len(stock) // 50  # what the sums cost
        else:
            choices, ahead = ahead, None
            top = max(stock)
        found = next(choices, ())
        spent += 1
        while found is None and spent < nodes:
            found = next(choices, ())
            spent += 1
        if found is None:  # nothing but dominated fillings before the end
            break
        if found != ():
            pattern = _pattern([top, *found])
            lost = capacity - top - sum(found)
            m = min(stock[x] // k for x, k in pattern) if left > tail else 1
            # with every bin that follows full, are there still fewer bins than the limit?
            if (limit - 1) * capacity - volume >= waste + m * lost:
                for x, k in pattern:
                    stock[x] -= m * k
                    left -= m * k
                    if not stock[x]:
                        del stock[x]
                bins, waste = bins + m, waste + m * lost
                trail.append((choices, pattern, m, m * lost))
                if len(trail) > back:  # its fillings take memory, and no search of this length comes back so far
                    trail[-back - 1] = (None, *trail[-back - 1][1:])
                continue
            # fillings come by waste, so all that follow are cut too; one bin of many may still do
        if not trail:
            break
        ahead, pattern, m, lost = trail.pop()
        for x, k in pattern:
            stock[x] = stock.get(x, 0) + m * k
            left += m * k
        bins, waste = bins - m, waste - lost
        if ahead is None:
            break
    return plan


def pack(pieces: DataFrame, capacity: int = CAPACITY, rows_per_rank: int = 100_000) -> DataFrame:
    """pieces with (sequence_id, offset); pieces(doc_id, piece, length, ...).

    A piece's rank among those of its length is its rank inside a hash bucket plus the sizes of
    the buckets before it.  A length has a bucket for every `rows_per_rank` pieces, so one that
    many documents share is no single task.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["k"] for r in pieces.groupBy("length").agg(F.count("*").alias("k")).collect()}  # capacity rows at most
    # slots and patterns are bounded by the capacity, not by the corpus: each step but the last few uses a length up
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    used, sequence = dict.fromkeys(counts, 0), 0
    for pattern, m in complete_bins(counts, capacity):
        offset = 0
        for length, k in pattern:
            slots.setdefault(length, []).append((used[length], k, sequence, offset))
            used[length] += m * k
            offset += length * k
        sequence += m
    if used != counts:
        raise AssertionError("the plan does not hold every piece")
    table = spark.sparkContext.broadcast({x: np.array(v, dtype=np.int64).T for x, v in slots.items()})
    buckets = F.create_map(*[F.lit(v) for x, k in counts.items() for v in (x, -(-k // rows_per_rank))]) if counts else None
    of_length = F.element_at(buckets, F.col("length")) if counts else F.lit(1)
    rows = pieces.withColumn("__bucket", F.pmod(F.xxhash64("doc_id", "piece", "start"), of_length).cast("int"))
    sizes = rows.groupBy("length", "__bucket").agg(F.count("*").alias("__k"))
    before = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "__bucket", F.coalesce(F.sum("__k").over(before), F.lit(0)).alias("__ahead"))
    rank = F.row_number().over(Window.partitionBy("length", "__bucket").orderBy("doc_id", "piece")) - 1
    rows = rows.withColumn("__rank", rank).join(sizes, ["length", "__bucket"])
    rows = rows.select(*pieces.columns, (F.col("__rank") + F.col("__ahead")).cast("long").alias("__rank"))
    names = pieces.columns
    ddl = StructType([*pieces.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = table.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("__rank").to_numpy()
            place = np.zeros((2, len(length)), dtype=np.int64)
            for x in np.unique(length).tolist():
                here = np.flatnonzero(length == x)
                low, copies, first, base = at[x]
                slot = np.searchsorted(low, rank[here], side="right") - 1
                inside = rank[here] - low[slot]
                place[0, here] = first[slot] + inside // copies[slot]
                place[1, here] = base[slot] + inside % copies[slot] * x
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(place[0]), pa.array(place[1])], names=[*names, "sequence_id", "offset"])

    return rows.mapInArrow(run, ddl)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    return pack(materialise(cut(docs, id_col, text_col, capacity), "pieces"), capacity)


def op5_bin_completion(spark, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))
