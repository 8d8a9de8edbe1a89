"""Lookup answers as tables: freshness, negative answers, work lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400
#: Days an answer stays fresh, by source; on the client only negatives age.
SHARED_DAYS = {"mb": 30, "spotify": 7}
NEGATIVE_DAYS = 30


def cache_key(kind: Column, a: Column, b: Column) -> Column:
    return F.lower(F.concat_ws(":", kind, a, b))


def is_negative(body: Column) -> Column:
    """Whether a JSON answer says that nothing was found."""
    get = lambda p: F.get_json_object(body, p)
    empty = lambda p: F.coalesce(F.regexp_replace(get(p), r"\s", "") == "[]", F.lit(False))
    no = lambda p: F.coalesce(get(p) == "false", F.lit(False))
    return no("$.found") | no("$.exists") | empty("$.groups") | empty("$.releases")


def newest(cache: DataFrame, key: str = "k", created: str = "created") -> DataFrame:
    """The last written row of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(created), F.desc("v"))
    return cache.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def fresh_shared(cache: DataFrame, now: int, days: int = SHARED_DAYS["mb"]) -> DataFrame:
    """Rows of cache(k, v, created) that may still be served; negatives count as answers."""
    return newest(cache).filter(F.col("created") > now - days * DAY)


def fresh_client(cache: DataFrame, now: int) -> DataFrame:
    """Client rows: positives never expire, negatives after 30 days; rows without a time start now."""
    rows = cache.withColumn("created", F.coalesce("created", F.lit(now)))
    return newest(rows).filter(~is_negative(F.col("v")) | (F.col("created") >= now - NEGATIVE_DAYS * DAY))


def misses(wanted: DataFrame, fresh: DataFrame) -> DataFrame:
    """Keys of wanted(k) that no fresh row answers: what is to be asked."""
    return wanted.join(fresh.select("k"), "k", "left_anti")


def with_answers(fresh: DataFrame, produced: DataFrame, now: int) -> DataFrame:
    """The cache after a round: failed calls (null v) leave no row, so they are asked again."""
    return newest(fresh.unionByName(produced.filter("v IS NOT NULL").withColumn("created", F.lit(now).cast("long"))))


def usage(cache: DataFrame) -> DataFrame:
    """(kind, answers, negatives, bytes) of a cache."""
    return cache.groupBy(F.substring_index("k", ":", 1).alias("kind")).agg(F.count("*").alias("answers"), F.sum(is_negative(F.col("v")).cast("long")).alias("negatives"), F.sum(F.octet_length("v")).alias("bytes"))
