"""Continuous ingest of landed pages, and duplicates found as plays arrive."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from itertools import pairwise

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from playtide.functions import keys
from playtide.functions.strings import norm, norm_title
from playtide.sources.plays import COLUMNS, PAGE_SCHEMA, flatten_pages


def read_landing(spark: SparkSession, landing: str) -> DataFrame:
    """The landing folder as a stream; each file is taken once, whatever is restarted."""
    return spark.readStream.schema(PAGE_SCHEMA).json(landing)


def ingest_pages(spark: SparkSession, landing: str, store: str, checkpoint: str):
    """Take every page landed since the last run into the store, then stop.

    The checkpoint is the resume point: an interrupted walk keeps the pages it has, and a page
    that is landed again replaces its older plays when the store is read with latest_plays().
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        pages = batch.withColumn("user", F.coalesce("user", F.lit("")))
        plays = flatten_pages(pages).withColumn("page", F.floor(F.col("seq") / 1000))
        fetched = pages.groupBy("user", "page").agg(F.max("fetched_at").alias("fetched_at"))
        # one folder a batch: a batch that is run again overwrites itself
        plays.join(fetched, ["user", "page"]).write.mode("overwrite").parquet(f"{store}/batch={batch_id}")

    return read_landing(spark, landing).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_plays(spark: SparkSession, store: str) -> DataFrame:
    """Plays of the newest copy of each page in the store."""
    rows = spark.read.parquet(store)
    newest = rows.groupBy("user", "page").agg(F.max(F.struct("fetched_at", "batch")).alias("w")).select("user", "page", "w.*")
    return rows.join(newest, ["user", "page", "fetched_at", "batch"], "left_semi").select(*COLUMNS)


def hourly_bursts(plays: DataFrame, most: int = 60, late: str = "2 hours") -> DataFrame:
    """Hours with impossible counts, by tumbling window, each when it is over; plays later than `late` are left out.

    Where plays can be later than any watermark, count_hours() counts them all.
    """
    timed = plays.withColumn("time", keys.utc(F.col("uts")).cast("timestamp")).withWatermark("time", late)
    return timed.groupBy("user", F.window("time", "1 hour")).agg(F.count("*").alias("plays")).filter(F.col("plays") > most).select("user", F.col("window.start").alias("hour"), "plays")


def count_hours(plays: DataFrame, store: str, checkpoint: str):
    """Add what has arrived to a store of plays per user and hour, then stop.

    Every batch leaves its own counts, so that a batch that is run again overwrites them, no state is
    held, and a play counts in its hour however late it comes.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        counts = batch.groupBy("user", F.floor(F.col("uts") / 3600).alias("hour")).agg(F.count("*").alias("plays"))
        counts.write.mode("overwrite").parquet(f"{store}/batch={batch_id}")

    return plays.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counted_bursts(spark: SparkSession, store: str, most: int = 60) -> DataFrame:
    """(user, hour, plays): the hours of the store with more than `most` plays; `hour` is a number of hours since 1970."""
    return spark.read.parquet(store).groupBy("user", "hour").agg(F.sum("plays").alias("plays")).filter(F.col("plays") > most)


_PLAY = "uts long, seq long, artist string, track string, shown boolean"
_FOUND = "user string, uts long, artist string, track string, previous_uts long"


class RepeatsOfAStretch(StatefulProcessor):
    """Holds the plays of one user and stretch of time until the watermark has passed it, then compares neighbours."""

    def __init__(self, window_seconds: int, stretch: int) -> None:
        self.window_seconds, self.stretch = window_seconds, stretch

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.plays = handle.getListState("plays", _PLAY)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        if not self.plays.exists():
            self.handle.registerTimer((int(key[1]) + 1) * self.stretch * 1000)
        for part in rows:
            self.plays.appendList([(int(r.uts), int(r.seq), r.artist, r.track, bool(r.shown)) for r in part.itertuples()])
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        order = sorted(self.plays.get(), key=lambda r: (r[0], r[1]))
        self.plays.clear()
        found = [(key[0], b[0], b[2], b[3], a[0]) for a, b in pairwise(order) if not b[4] and b[0] - a[0] <= self.window_seconds and norm_title(b[3]) == norm_title(a[3]) and norm(b[2]) == norm(a[2])]
        if found:
            yield pd.DataFrame(found, columns=[c.split()[0] for c in _FOUND.split(", ")])

    def close(self) -> None:
        pass


def adjacent_repeats(plays: DataFrame, window_seconds: int = 30, late: str = "2 hours", stretch: int = 86_400, arrival: str | None = None) -> DataFrame:
    """Repeats of the play just before, of any track, within the window; what timing.adjacent_repeats() finds in a whole log.

    Plays may come in any order: a stretch of a user's time is judged once the watermark, `late` behind the
    newest play, has passed it, and then its state is given up.  Plays in the last seconds of a stretch are also
    shown to the next, so that a stretch and not the user is what one task holds.  A play that comes later
    still is dropped here; the log has it, and the batch detector finds its repeats.  With `arrival`, a column of epoch
    seconds, a play from a clock that runs ahead moves the watermark no further than its arrival.
    """
    at = F.col("uts") if arrival is None else F.least("uts", arrival)
    rows = plays.withColumn("time", F.timestamp_seconds(at)).withWatermark("time", late)
    number = F.floor(F.col("uts") / stretch)
    own, next_ = F.struct(number.alias("part"), F.lit(False).alias("shown")), F.struct((number + 1).alias("part"), F.lit(True).alias("shown"))
    rows = rows.withColumn("p", F.explode(F.when(F.col("uts") % stretch >= stretch - window_seconds, F.array(own, next_)).otherwise(F.array(own))))
    rows = rows.select("user", "p.part", "time", "uts", "seq", "artist", "track", "p.shown")
    return rows.groupBy("user", "part").transformWithStateInPandas(RepeatsOfAStretch(window_seconds, stretch), _FOUND, "append", "eventTime")


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which processors with timers need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
