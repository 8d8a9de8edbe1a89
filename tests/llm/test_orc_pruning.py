from pyspark.sql import functions as F

from playtide.llm import orc_tokens


def scanned(df):
    """Rows that the scan of a collected DataFrame gave."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    if "AdaptiveSparkPlan" in plan.nodeName():
        plan = plan.executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.length()))


def test_bloom_filters_and_row_indexes_skip_rows(spark, tmp_path):
    """Even ids only: an odd one inside their range is met by a Bloom filter, one outside by the minima and maxima."""
    path = f"file://{tmp_path}/t"
    docs = spark.range(0, 60_000, 2).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"))
    orc_tokens.write(docs, path, files=1)
    spark.conf.set("spark.sql.orc.enableVectorizedReader", "false")  # its scan counts rows as they are read, not by batch
    try:
        read = orc_tokens.read(spark, path)
        assert scanned(read.filter("doc_id = 30001")) == 0
        assert scanned(read.filter("doc_id = 70000")) == 0
        assert 0 < scanned(read.filter("doc_id = 30000")) <= 10_000  # one stride of the row index
        plain = f"file://{tmp_path}/p"
        orc_tokens.encode(docs).coalesce(1).sortWithinPartitions("doc_id").write.orc(plain)
        assert scanned(spark.read.schema("doc_id long, ids array<int>").orc(plain).filter("doc_id = 30001")) > 0
    finally:
        spark.conf.unset("spark.sql.orc.enableVectorizedReader")


def test_stripes_are_read_apart(spark, tmp_path):
    import glob

    import pyarrow.orc

    path = f"{tmp_path}/t"
    docs = spark.range(12_000).select(F.col("id").alias("doc_id"), F.expr("array_join(transform(sequence(1, 12), i -> sha2(cast(id * 100 + i as string), 256)), ' ')").alias("text"))
    (
        orc_tokens.encode(docs.repartitionByRange(1, "doc_id").sortWithinPartitions("doc_id"))
        .write.option("orc.stripe.size", str(1 << 20)).option("orc.bloom.filter.columns", "doc_id").orc(f"file://{path}")
    )
    (file,) = glob.glob(f"{path}/*.orc")
    found = pyarrow.orc.ORCFile(file)
    assert found.nstripes > 1
    ids = [found.read_stripe(i, columns=["doc_id"])["doc_id"].to_pylist() for i in range(found.nstripes)]
    assert [x for part in ids for x in part] == list(range(12_000))


def test_the_query_on_nulls_repeats_and_a_long_text(spark, tmp_path):
    rows = [(None, "a b", 1), (None, None, 1), (5, "x " * 50_000, 1), (5, "y", 2), (5, "y", 2), (1, "", 3)]
    spark.createDataFrame(rows, "doc_id long, text string, start int").write.parquet(f"{tmp_path}/documents.parquet")
    got = orc_tokens.op3_orc_tokens(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    order = sorted(got, key=lambda r: r.start)
    at = 0
    for r in order:
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in order] == [None, None, 1, 5, 5, 5] and max(r.n_tokens for r in got) == 50_001


def test_places_among_bounds(spark):
    import bisect
    import random

    rng = random.Random(1)
    for n in (1, 2, 3, 7, 8, 50):
        bounds = sorted(rng.sample(range(-200, 200), n))
        ids = [None, *range(-210, 211, 3)]
        df = spark.createDataFrame([(i,) for i in ids], "doc_id long")
        got = {r.doc_id: r.p for r in df.select("doc_id", orc_tokens._place(F.col("doc_id"), bounds).alias("p")).collect()}
        assert got == {i: 0 if i is None else bisect.bisect_left(bounds, i) for i in ids}
