"""Token ids in ORC: integer run-length encoding, row indexes and Bloom filters on ids.

Documents are dealt by ranges of doc_id, sorted inside each, encoded and written by Spark's ORC
writer: one file a range, stripes readable on their own, doc_id ascending within and across
files, so that row-index minima and maxima and the Bloom filters prune a lookup by id.

Defined results: a null text is empty and holds the end id alone; repeated rows and equal ids
are stored as often as they occur, side by side, and counted in the order of their ids' crc32; an
empty table gives an empty file set; extra columns are ignored; very long texts are encoded whole and
one row holds them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from playtide.llm.common import chunked, read_table, record_batch, shared_path, take
from playtide.llm.tokens import PieceEncoder

END = 2


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end: int = END) -> DataFrame:
    """(doc_id, ids): the ids of each text with the end id.  tokenizer: a file every executor has."""
    path = tokenizer or _tokenizer()
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder.shared(path)
        for batch in chunked(batches):
            ids, n = encoder.encode([t or "" for t in batch.column("text").to_pylist()], end)
            offsets = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
            yield record_batch(schema, {"doc_id": batch.column("doc_id"), "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))})
        PieceEncoder.rest()

    return take(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def _place(x: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are below x, by bisection; none below null."""
    at, n = F.array(*map(F.lit, bounds)), len(bounds)
    steps = F.array(*[F.lit(1 << k) for k in range(n.bit_length() - 1, -1, -1)])
    further = lambda pos, step: (pos + step <= n) & (F.get(at, pos + step - 1) < F.coalesce(x, F.lit(-(1 << 63))))
    return F.aggregate(steps, F.lit(0), lambda pos, step: F.when(further(pos, step), pos + step).otherwise(pos))


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end: int = END, files: int | None = None) -> None:
    """Write (doc_id, ids) as ORC under path, ascending by doc_id within and across files."""
    rows = take(docs, id_col, text_col)
    files = files or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # for the bounds the ids alone are read, without the texts
    shares = [i / files for i in range(1, files)]
    bounds = sorted(set(rows.agg(F.percentile_approx("doc_id", shares, max(10_000, 20 * files))).first()[0] or [])) if shares else []
    ranged = rows.withColumn("part", _place(F.col("doc_id"), bounds) if bounds else F.lit(0)).repartitionById(files, "part")
    encoded = encode(ranged.sortWithinPartitions("doc_id"), tokenizer=tokenizer, end=end)
    (
        encoded.write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", "10000")
        .option("orc.stripe.size", str(16 << 20))
        .option("compression", "none")  # run lengths leave little to compress
        .orc(path)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ids) as stored; filters on doc_id reach the row indexes and Bloom filters."""
    return spark.read.schema("doc_id long, ids array<int>").orc(path)


def summary(stored: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of stored token rows; start counts all ids before, by doc_id.

    Counts are summed by file first (files are ranges of doc_id); only those few sums are
    ordered over the whole table, then each file's rows over the file.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("file", pa.string()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes()
            n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            ends = (np.cumsum(n) * 4).tolist()
            crc = [zlib.crc32(flat[e - 4 * k : e]) for e, k in zip(ends, n.tolist(), strict=True)]
            yield record_batch(schema, {"doc_id": batch.column("doc_id"), "file": batch.column("file"), "n_tokens": n, "ids_crc32": crc})

    rows = stored.select("doc_id", "ids", F.col("_metadata.file_path").alias("file")).mapInArrow(run, "doc_id long, file string, n_tokens long, ids_crc32 long")
    from playtide.llm.common import materialise

    rows = materialise(rows, "token-counts")
    files = rows.groupBy("file").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.sum("n_tokens").alias("n"))
    before = Window.orderBy("low", "high", "file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file").orderBy("doc_id", "ids_crc32", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return rows.join(files, "file").select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def op3_orc_tokens(spark, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "tokens-orc")
    write(read_table(spark, sf_dir, "documents"), path)
    return summary(read(spark, path))
