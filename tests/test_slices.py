import pyarrow as pa
from pyspark.sql import functions as F

from playtide.functions import keys, strings


def test_long_texts_are_handled_in_parts_and_repeats_once(spark):
    parts = list(keys._slices(pa.array(["x" * 600_000, None, "y" * 600_000, "", "z" * 3_000_000, "a"]), 1 << 20))
    assert [len(p) for p in parts] == [2, 2, 1, 1]
    texts = [None, "", "A  b", "x" * 700_000 + "!", "é" * 400_000, "A  b", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1).select("i", keys.norm_title("t").alias("k"), keys.match_keys("t").alias("m"))
    got = {r.i: r.k for r in df.orderBy("i").collect()}
    assert got == {i: strings.norm_title(t) for i, t in enumerate(texts)}
    assert df.filter(F.col("i") >= 0).count() == len(texts)
