"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Targets share the words of all sources by weight; none exceeds max_repeats times its source, and what
that leaves over is shared again.  The mix consists of blocks of the same number of words.  Blocks go to
sources by the highest quotients target / (2j - 1), and each source's blocks go to its shards (documents dealt by a
seeded hash, a million words a shard) in the same way, which gives an integer quota a shard.  A
shard then takes its documents, in seeded order, as often as its quota fills it, and the rest as
blocks spread evenly over that order from a seeded place on.

Everything is counted by Spark: quotients are compared by counting the seats above thresholds, which
narrow round by round, so neither a list of sources nor of seats is ever in one place.  A shard is
the largest group that a task orders, and its size does not grow with its source.

Defined results: a null text has no words; a null source is a source of its own, last in order; a document
without words, and a source without, takes none and its target is 0; rows alike in every column are
documents of their own, which one of them takes which place is then not to be told; extra columns are
ignored; an empty table gives no rows.  The same rows give the same mix, however they are partitioned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playtide.llm.common import materialise, read_table

WEIGHTS = (5, 2, 1)
BLOCK = 128
SHARD_WORDS = 1 << 20
#: Thresholds a group tries at once.
TRIES = 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_counts(column: pa.Array) -> np.ndarray:
    """Words of each text; null: none."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return np.zeros(0, dtype=np.int64)
    _, offsets, data = column.buffers()
    edges = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if edges[-1] == edges[0]:
        return np.zeros(len(column), dtype=np.int64)
    space = _SPACE[np.frombuffer(data, dtype=np.uint8)[edges[0] : edges[-1]]]
    edges = edges - edges[0]
    begins = ~space
    begins[1:] &= space[:-1]
    full = edges[1:] > edges[:-1]
    firsts = edges[:-1][full]
    begins[firsts] = ~space[firsts]
    counts = np.zeros(len(column), dtype=np.int64)
    counts[full] = np.add.reduceat(begins, firsts, dtype=np.int64)
    return counts


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size = pa.array(word_counts(batch.column("text")), type=pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), batch.column("key"), size], names=["doc_id", "source", "key", "size"])


def sizes(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(doc_id, source, key, size): key is the seeded place of a row in its source."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("key", F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.lit(-1)), F.coalesce("text", F.lit(""))))
    return rows.select("doc_id", "source", "key", "text").mapInArrow(_measure, "doc_id long, source string, key long, size long")


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """df with `place`, its rows' number from 0 in the given order: by ranges, and the ranges' counts."""
    ranged = materialise(df.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("range").count()
    before = counts.select("range", (F.sum("count").over(Window.orderBy("range")) - F.col("count")).alias("before"))
    own = F.row_number().over(Window.partitionBy("range").orderBy(*order)) - 1
    return ranged.withColumn("own", own).join(before, "range").withColumn("place", F.col("before") + F.col("own")).drop("range", "own", "before")


def fill(sources: DataFrame, total: float, max_repeats: int) -> DataFrame:
    """sources (source_size, weight) with their target: weight times one level, or the cap where that is less.

    The level rises as capped sources give back what they cannot take; it ends when no further source is capped.
    """
    cap = F.col("source_size") * max_repeats
    level, capped = 0.0, -1
    while True:
        full = cap <= F.lit(level) * F.col("weight") if capped >= 0 else F.lit(False)
        got = sources.agg(F.count(F.when(full, 1)).alias("n"), F.sum(F.when(full, cap)).alias("cap"), F.sum(F.when(~full, F.col("weight"))).alias("weight")).first()
        if got.n == capped:
            return sources.withColumn("target", F.when(full, cap.cast("double")).otherwise(F.lit(level) * F.col("weight")))
        capped = got.n
        level = (total - (got.cap or 0)) / got.weight if got.weight else math.inf


def apportion(parties: DataFrame, seats: DataFrame) -> DataFrame:
    """Seats of each group to its parties by the highest quotients votes / 1, 3, 5, ...; ties to the smaller place.

    parties: (group, place, votes double, most long: no more seats than these); seats: (group, seats).
    Returns (group, place, quota).  A threshold t gives a party floor((votes / t + 1) / 2) seats; each round
    counts the seats above TRIES thresholds a group and keeps the two next to what is sought.  Where quotients tie,
    the interval shrinks to nothing, and the places of the tied parties are narrowed in the same way.
    """
    parties = materialise(parties.filter("votes > 0 AND most > 0"), "parties")

    def above(t: Column) -> Column:
        return F.least(F.col("most"), F.floor((F.col("votes") / t + 1) / 2))

    ends = parties.groupBy("group").agg(
        (F.max("votes") * 1.01).alias("high"), (F.min(F.col("votes") / (2 * F.col("most") - 1)) * 0.99).alias("low"),
        F.sum("most").alias("room"), F.min("place").alias("first"), F.max("place").alias("last"),
    )
    state = seats.join(ends, "group").select("group", F.least("seats", "room").alias("seats"), "low", "high", F.lit(0).cast("long").alias("above_high"), "first", "last")
    state = materialise(state.withColumn("done", F.col("seats") == 0), "seats")
    ratio = lambda: F.col("high") / F.col("low")
    while state.filter(~F.col("done") & (ratio() > 1 + 1e-12)).limit(1).count():
        open_ = state.filter(~F.col("done") & (ratio() > 1 + 1e-12))
        tries = open_.select("group", F.explode(F.sequence(F.lit(0), F.lit(TRIES))).alias("i"), (F.col("low") * F.pow(ratio(), F.col("i") / F.lit(float(TRIES)))).alias("t"))
        counted = parties.join(tries, "group").groupBy("group", "i", "t").agg(F.sum(above(F.col("t"))).alias("n"))
        counted = counted.join(open_.select("group", "seats"), "group")
        # Low ends keep at least the seats sought, high ends fewer or as many.
        narrowed = counted.groupBy("group").agg(
            F.max(F.when(F.col("n") >= F.col("seats"), F.col("t"))).alias("new_low"),
            F.min(F.when(F.col("n") <= F.col("seats"), F.struct("t", "n"))).alias("new_high"),
        )
        new = state.join(narrowed, "group", "left")
        high = F.least(F.col("high"), F.col("new_high.t"))
        state = materialise(
            new.select(
                "group", "seats",
                F.coalesce(F.greatest("low", "new_low"), F.col("low")).alias("low"),
                F.coalesce(high, F.col("high")).alias("high"),
                F.when(F.col("new_high").isNotNull() & (F.col("new_high.t") <= F.col("high")), F.col("new_high.n")).otherwise(F.col("above_high")).alias("above_high"),
                "first", "last", "done",
            ).withColumn("done", F.col("done") | (F.col("above_high") == F.col("seats"))), "seats",
        )
    # What is left to give goes to tied parties, by place: `last` ends as the place of the last one that gets a seat.
    tied = materialise(
        parties.join(state.filter(~F.col("done")), "group").filter(above(F.col("low")) > above(F.col("high"))).select("group", "place"), "tied"
    )
    bounds = materialise(state.filter(~F.col("done")).select("group", (F.col("seats") - F.col("above_high")).alias("left"), "first", "last"), "places")
    while bounds.filter(F.col("first") < F.col("last")).limit(1).count():
        step = F.greatest(F.lit(1), F.ceil((F.col("last") - F.col("first")) / F.lit(TRIES)))
        tries = bounds.select("group", F.explode(F.sequence(F.col("first"), F.col("last") + step, step)).alias("p")).join(bounds.select("group", "left"), "group")
        counted = tied.join(tries, "group").groupBy("group", "p", "left").agg(F.count(F.when(F.col("place") <= F.col("p"), 1)).alias("n"))
        narrowed = counted.groupBy("group").agg(F.max(F.when(F.col("n") < F.col("left"), F.col("p"))).alias("few"), F.min(F.when(F.col("n") >= F.col("left"), F.col("p"))).alias("enough"))
        bounds = materialise(
            bounds.join(narrowed, "group").select("group", "left", F.greatest("first", F.coalesce(F.col("few") + 1, F.col("first"))).alias("first"), F.least("last", F.coalesce("enough", "last")).alias("last")), "places"
        )
    bounds = bounds.select("group", F.col("last").alias("up_to"))
    out = parties.join(state, "group").join(bounds, "group", "left")
    extra = F.when(~F.col("done") & (F.col("place") <= F.col("up_to")) & (above(F.col("low")) > above(F.col("high"))), 1).otherwise(0)
    return out.select("group", "place", F.when(F.col("seats") == 0, 0).otherwise(above(F.col("high")) + extra).cast("long").alias("quota"))


def _spans(start: str, end: str) -> Column:
    """Taken words of the ring from start to end, as (from, to) beyond `start`.

    The partial pass of `rest` words has `parts` blocks: the ring of `words` is cut into as many stretches,
    [j * words div parts, ...), and a block is the first words of each, of a length in proportion.
    """
    edge = lambda j: f"(({j}) * words div parts)"
    got = lambda j: f"({edge(j)} * rest div words)"
    last = f"((({end}) * parts - 1) div words)"
    first = f"((({start}) + 1) * parts - 1) div words"
    return F.expr(f"""
        CASE WHEN rest > 0 AND ({end}) > ({start}) THEN filter(transform(sequence({first}, {last}), j -> struct(
          greatest({edge('j')}, {start}) - ({start}) AS a,
          least({edge('j')} + {got('j + 1')} - {got('j')}, {end}) - ({start}) AS b)), x -> x.b > x.a)
        ELSE CAST(array() AS ARRAY<STRUCT<a: BIGINT, b: BIGINT>>) END""")


def mix(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = 3, block: int = BLOCK, shard_words: int = SHARD_WORDS, seed: int = 17,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """(doc_id, source, size, source_size, target, shard, passes, spans, taken).

    A document is taken whole `passes` times, and the words of `spans` (from, to; words from 0) once more;
    taken is the number of words.  Sources in order of code points, null last, weigh `weights`, repeating.
    """
    rows = materialise(sizes(docs, seed, id_col, text_col, source_col), "sizes")
    named = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = numbered(named, F.col("source").isNull(), F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    sources = materialise(sources.withColumn("weight", weight).withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words))), "sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    sources = fill(sources, float(total), max_repeats)

    def most(words: Column) -> Column:
        return F.ceil(words * max_repeats / block)

    whole = sources.sparkSession.createDataFrame([(0, round(total / block))], "group long, seats long")
    parties = sources.select(F.lit(0).cast("long").alias("group"), "place", F.col("target").alias("votes"), most(F.col("source_size")).alias("most"))
    quota = apportion(parties, whole)
    sources = materialise(sources.join(quota.select("place", "quota"), "place", "left").withColumn("quota", F.coalesce("quota", F.lit(0).cast("long"))), "sources")

    source = F.col("source").eqNullSafe(F.col("name"))
    dealt = rows.join(sources.select(F.col("source").alias("name"), "place", "shards", "source_size", "target"), source).drop("name")
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("key", F.lit(seed)), F.col("shards"))).drop("shards")
    cells = materialise(dealt.groupBy("place", "shard").agg(F.sum("size").alias("words")), "cells")
    parties = cells.select(F.col("place").alias("group"), F.col("shard").alias("place"), F.col("words").cast("double").alias("votes"), most(F.col("words")).alias("most"))
    quota = apportion(parties, sources.select(F.col("place").alias("group"), F.col("quota").alias("seats")))
    cells = cells.join(quota.select(F.col("group").alias("place"), F.col("place").alias("shard"), "quota"), ["place", "shard"], "left")
    cells = cells.withColumn("take", F.least(F.coalesce("quota", F.lit(0)) * block, F.col("words") * max_repeats)).withColumn("passes", F.expr("CASE WHEN words > 0 THEN take div words ELSE 0 END"))
    cells = cells.withColumn("rest", F.col("take") - F.col("passes") * F.col("words"))
    cells = cells.withColumn("parts", F.greatest(F.lit(1), F.round(F.col("rest") / block)).cast("long"))
    cells = cells.withColumn("turn", F.when(F.col("words") > 0, F.pmod(F.xxhash64(F.lit(seed), "place", "shard"), F.col("words"))).otherwise(0))

    order = Window.partitionBy("place", "shard").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    laid = dealt.withColumn("start", F.coalesce(F.sum("size").over(order), F.lit(0))).join(cells.drop("quota", "take"), ["place", "shard"])
    laid = laid.withColumn("at", F.expr("CASE WHEN words > 0 THEN (start + turn) % words ELSE 0 END"))
    laid = laid.withColumn("cut", F.least(F.col("at") + F.col("size"), F.col("words")))
    # Beyond the ring's end a document goes on at its beginning.
    laid = laid.withColumn("spans", F.concat(_spans("at", "cut"), F.transform(_spans("0L", "at + size - cut"), lambda x: F.struct((x["a"] + F.col("cut") - F.col("at")).alias("a"), (x["b"] + F.col("cut") - F.col("at")).alias("b")))))
    once = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["b"] - x["a"])
    return laid.select("doc_id", "source", "size", "source_size", "target", "shard", "passes", "spans", (F.col("passes") * F.col("size") + once).alias("taken"))


def op12_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
