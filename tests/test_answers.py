import pytest
from pyspark.sql import functions as F

from playtide.plans import report
from playtide.sources.answers import AnswerCache
from playtide.sources.versions import Versions

ROWS = "k string, v string, created long"


def held(cache):
    return {r.k: (r.v, r.created) for r in cache.rows().collect()}


def test_rounds_and_compaction(spark, tmp_path):
    cache = AnswerCache(spark, f"file://{tmp_path}/it's here", buckets=4)
    assert held(cache) == {}
    cache.add(spark.createDataFrame([("a", "1", 10), ("b", '{"found": false}', 10), ("c", None, 10)], ROWS))
    cache.add(spark.createDataFrame([("a", "2", 20), ("a", "0", 5), ("d", "4", 20)], ROWS))
    want = {"a": ("2", 20), "b": ('{"found": false}', 10), "d": ("4", 20)}
    assert held(cache) == want
    cache.compact()
    assert held(cache) == want and held(AnswerCache(spark, f"file://{tmp_path}/it's here", buckets=4)) == want
    cache.add(spark.createDataFrame([("b", "new")], "k string, v string"), now=30)
    cache.add(spark.createDataFrame([("a", "old")], "k string, v string"), now=1)
    want["b"] = ("new", 30)
    assert held(cache) == want
    cache.compact(keep=1)
    assert held(cache) == want and len(cache.versions.names()) == 1
    cache.clear()
    assert held(cache) == {}


def test_lookup_asks_for_what_is_missing_or_stale(spark, tmp_path):
    cache = AnswerCache(spark, f"file://{tmp_path}/c", buckets=4)
    day = 86_400
    cache.add(spark.createDataFrame([("yes", "1", 0), ("no", '{"exists": false}', 0), ("late", '{"exists": false}', 20 * day)], ROWS))
    wanted = spark.createDataFrame([(k,) for k in ("yes", "no", "late", "never", "never")], "k string")
    assert {r.k: r.v is not None for r in cache.lookup(wanted, 40 * day).collect()} == {"yes": True, "no": False, "late": True, "never": False}
    assert {r.k: r.v is not None for r in cache.lookup(wanted, 40 * day, days=30).collect()} == {"yes": False, "no": False, "late": True, "never": False}


def test_the_cache_is_never_shuffled(spark, tmp_path):
    cache = AnswerCache(spark, f"file://{tmp_path}/c", buckets=4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cache.add(spark.range(500).select(F.concat(F.lit("k"), "id").alias("k"), F.lit("v").alias("v"), F.col("id").alias("created")))
        cache.compact()
        cache.add(spark.range(400, 600).select(F.concat(F.lit("k"), "id").alias("k"), F.lit("w").alias("v"), F.lit(1000).cast("long").alias("created")))
        plan = cache.rows()._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("Bucketed: true") == 2
        found = cache.lookup(spark.range(100).select(F.concat(F.lit("k"), F.col("id") * 7).alias("k")), 0)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(k") == 1 and plan.count("Bucketed: true") == 2
        assert sorted(r.v or "" for r in found.collect()) == sorted("" if k >= 600 else "w" if k >= 400 else "v" for k in range(0, 700, 7))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_failing_write_leaves_the_old_report(spark, tmp_path):
    path = f"file://{tmp_path}/report"
    with pytest.raises(FileNotFoundError):
        report.published(spark, path, "a")
    first = report.publish({"a": spark.range(3), "b": spark.range(2)}, path)
    broken = spark.range(5).select(F.when(F.col("id") == 4, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="broken"):
        report.publish({"a": spark.range(9), "b": broken}, path)
    assert report.published(spark, path, "a").count() == 3 and report.published(spark, path, "b").count() == 2
    assert Versions(spark, path).names() == [first]
    second = report.publish({"a": spark.range(9), "b": spark.range(7)}, path)
    assert report.published(spark, path, "a").count() == 9 and report.published(spark, path, "a", first).count() == 3
    report.publish({"a": spark.range(1)}, path)
    assert len(Versions(spark, path).expire(keep=2)) == 1 and second in Versions(spark, path).names()
