"""The roll-up all detectors share: a user's plays by artist, album, track and identifiers.

Plays are summed with partial aggregation, so the log crosses the network once, as its distinct
cells.  Comparison keys need Python; they are computed on the cells, never on the plays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtide.functions import keys
from playtide.sources.scratch import discard, kept

IDS = ("artist_mbid", "album_mbid", "track_mbid")


def roll_up(plays: DataFrame) -> DataFrame:
    """cells_of() without the keys."""
    clean = [F.coalesce(c, F.lit("")).alias(c) for c in ("artist", "album", "track", *IDS)]
    return plays.select("user", "seq", "uts", *clean).groupBy("user", "artist", "album", "track", *IDS).agg(
        F.count("*").alias("plays"), F.min("uts").alias("first_uts"), F.max("uts").alias("last_uts"), F.min("seq").alias("seq")
    )


def cells_of(plays: DataFrame) -> DataFrame:
    """(user, artist, album, track, MBIDs, plays, first_uts, last_uts, seq, keys): plays by name and identifiers.

    A triple of names has a row for each combination of identifiers it was played with, few
    as they are; only numbers are summed, so the aggregation stays in code-generated hash maps.
    """
    return keys.with_keys(roll_up(plays))


def partition_eras(cells: DataFrame, official: DataFrame | None = None) -> DataFrame:
    """cells with is_era: explicit tags, and weaker ones of artists who also tag explicitly.

    official(artist_key, album_key) lists releases known to exist; a weak tag on one is a title.
    """
    # found with built-ins and the keys of the few artists concerned: the cells' own keys are computed once
    named = cells.filter(keys.explicit_era(F.col("album"))).select("user", "artist").distinct()
    # a count keeps the distinct below it, and a key that is never null has no filter on it pushed to every cell
    taggers = named.groupBy("user", F.coalesce(keys.norm("artist"), F.lit("")).alias("artist_key")).agg((F.count("*") > 0).alias("tagger"))
    out = cells.join(taggers, ["user", "artist_key"], "left")
    known: Column = F.lit(False)
    if official is not None:
        out = out.join(official.select("artist_key", "album_key").distinct().withColumn("official", F.lit(True)), ["artist_key", "album_key"], "left")
        known = F.coalesce("official", F.lit(False))
    weaker = (F.col("era_weak") | F.col("era_ambiguous")) & F.coalesce("tagger", F.lit(False)) & ~known
    return out.withColumn("is_era", F.col("era_explicit") | weaker).drop("tagger", "official")


def kept_cells(plays: DataFrame, official: DataFrame | None = None) -> DataFrame:
    """partition_eras() of the log's cells, as a table of the run.

    The roll-up is written ahead of it: partition_eras() reads the cells twice, and the log is not to be read twice.
    """
    rolled = kept(roll_up(plays), "rolled")
    cells = kept(partition_eras(keys.with_keys(rolled), official), "cells")
    discard(plays.sparkSession, rolled)
    return cells


def eras(cells: DataFrame) -> DataFrame:
    return cells.filter("is_era")


def rest(cells: DataFrame) -> DataFrame:
    return cells.filter("NOT is_era")


def weak_era_candidates(cells: DataFrame, limit: int = 40) -> DataFrame:
    """(user, artist, album, plays): albums with only a weak tag, the most played of each user."""
    from pyspark.sql import Window

    rows = cells.filter("album <> '' AND NOT era_explicit AND (era_weak OR era_ambiguous)")
    found = rows.groupBy("user", "artist_key", "album_key").agg(F.min_by("artist", "seq").alias("artist"), F.min_by("album", "seq").alias("album"), F.sum("plays").alias("plays"), F.min("seq").alias("seq"))
    rank = F.row_number().over(Window.partitionBy("user").orderBy(F.desc("plays"), "seq"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= limit).select("user", "artist", "album", "plays", "rank")


def id_sets(cells: DataFrame, column: str, *by: str) -> DataFrame:
    """Distinct identifiers of `column` under the keys `by`, as a set `ids`."""
    return cells.filter(F.col(column) != "").select("user", *by, F.col(column).alias("id")).distinct().groupBy("user", *by).agg(F.collect_set("id").alias("ids"))


def verdict(a: Column, b: Column) -> Column:
    """'same' if two identifier sets meet, 'different' if not, 'unknown' where either is missing."""
    known = (F.coalesce(F.size(a), F.lit(0)) > 0) & (F.coalesce(F.size(b), F.lit(0)) > 0)
    return F.when(~known, "unknown").when(F.arrays_overlap(a, b), "same").otherwise("different")
