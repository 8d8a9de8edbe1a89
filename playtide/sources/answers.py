"""Lookup answers as bucketed files: a base, and a delta that each round adds to, compacted at times.

Both are bucketed by key, so a round moves the keys that are wanted and the answers that are new, and never the
cache: it is joined, and compacted, bucket by bucket.  One writer at a time; readers see whole versions.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playtide.sources.cache import DAY, NEGATIVE_DAYS, is_negative
from playtide.sources.versions import Versions


def _later(a: Column, b: Column) -> Column:
    """The later of two (created, v), of which one may be null."""
    return F.greatest(a, b)


class AnswerCache:
    """k -> (v, created) at a path.  The number of buckets is fixed when the cache is made."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        self.spark, self.versions, self.buckets = spark, Versions(spark, path), buckets
        if self.versions.current() is None:
            self._publish(spark.createDataFrame([], "k string, v string, created long"))

    def _table(self, version: str, part: str) -> str:
        """The bucketed table over a part of a version, known to this session under a name of its own."""
        where = f"{self.versions.folder(version)}/{part}"
        name = f"answers_{hashlib.sha256(where.encode()).hexdigest()[:24]}"
        quoted = where.replace("'", "\\'")
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (k STRING, v STRING, created BIGINT) USING parquet CLUSTERED BY (k) INTO {self.buckets} BUCKETS LOCATION '{quoted}'")
        return name

    def _publish(self, rows: DataFrame) -> None:
        """rows, which lie by bucket if they come from the cache, as the base of a new version with an empty delta."""
        version = self.versions.begin()
        try:
            rows.select("k", "v", "created").write.insertInto(self._table(version, "base"))
            self._table(version, "delta")
        except BaseException:
            self.versions.abort(version)
            raise
        self.versions.commit(version)

    def _part(self, part: str) -> DataFrame:
        name = self._table(self.versions.current(), part)
        self.spark.catalog.refreshTable(name)
        return self.spark.table(name)

    def _delta(self) -> DataFrame:
        """(k, new): the last answer of each key that rounds have added."""
        return self._part("delta").groupBy("k").agg(F.max(F.struct("created", "v")).alias("new"))

    def rows(self) -> DataFrame:
        """(k, v, created): the last answer of each key."""
        base = self._part("base").select("k", F.struct("created", "v").alias("old"))
        both = base.join(self._delta(), "k", "full_outer").select("k", _later(F.col("old"), F.col("new")).alias("w"))
        return both.select("k", "w.v", "w.created")

    def lookup(self, wanted: DataFrame, now: int, days: int | None = None) -> DataFrame:
        """(k, v, created) of each key of wanted(k); v is null where it is to be asked.

        Answers older than `days` are not served; without it positive ones never age and negative ones do.
        """
        base = self._part("base").select("k", F.struct("created", "v").alias("old"))
        held = wanted.select("k").distinct().join(base, "k", "left").join(self._delta(), "k", "left").select("k", _later(F.col("old"), F.col("new")).alias("w"))
        fresh = F.col("w.created") > now - days * DAY if days is not None else ~is_negative(F.col("w.v")) | (F.col("w.created") >= now - NEGATIVE_DAYS * DAY)
        return held.select("k", F.when(fresh, F.col("w.v")).alias("v"), F.when(fresh, F.col("w.created")).alias("created"))

    def add(self, produced: DataFrame, now: int | None = None) -> None:
        """A round's answers.  Failed calls (null v) leave no row, so they are asked again.  `now` where they have no time of their own."""
        created = F.col("created") if now is None else F.lit(now).cast("long")
        rows = produced.filter("v IS NOT NULL").select("k", "v", created.alias("created"))
        rows.repartition(self.buckets, "k").write.insertInto(self._table(self.versions.current(), "delta"))

    def compact(self, keep: int = 2) -> None:
        """The delta into the base, as a new version; old versions go."""
        self._publish(self.rows())
        self.versions.expire(keep)

    def clear(self) -> None:
        """Forget all answers."""
        self._publish(self.spark.createDataFrame([], "k string, v string, created long"))
        self.versions.expire(1)
