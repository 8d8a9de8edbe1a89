"""Matching plays to a catalogue of releases, and planning which lookups to make."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playtide.functions import keys

ALBUM_FIELDS = ("rg_id", "title", "primary", "secondary", "first_release", "status", "source")


def title_index(tracks: DataFrame) -> DataFrame:
    """(artist_key, title_key, rg_id, ord): every key under which a catalogue lists a release.

    tracks(artist_key, title, rg_id, ord).  A title is listed with and without its credits.
    """
    rows = tracks.withColumn("title_key", F.explode(keys.match_keys("title")))
    return rows.groupBy("artist_key", "title_key", "rg_id").agg(F.min("ord").alias("ord"))


def releases_once(releases: DataFrame) -> DataFrame:
    """The first row of each release group of an artist."""
    w = Window.partitionBy("artist_key", "rg_id").orderBy("ord")
    return releases.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def match_tiers(wanted: DataFrame, index: DataFrame) -> DataFrame:
    """(artist_key, track, tier, title_key): the first of exact, base and folded keys that is listed.

    wanted(artist_key, track).  The folded tier takes the catalogue's first key that agrees
    without marks.  Tracks that match nothing are left out: that is no answer, not a no.
    """
    listed = index.groupBy("artist_key", "title_key").agg(F.min("ord").alias("ord"))
    listed = listed.withColumn("folded", keys.norm("title_key"))
    first = listed.groupBy("artist_key", "folded").agg(F.min_by("title_key", F.struct("ord", "title_key")).alias("title_key"))
    w = wanted.select("artist_key", "track").distinct().withColumn("exact", keys.norm_title("track")).withColumn("base", keys.norm_title(keys.base_title("track"))).withColumn("folded", keys.norm("track"))
    exact = w.join(listed.select("artist_key", F.col("title_key").alias("exact")), ["artist_key", "exact"], "left_semi").select("artist_key", "track", F.lit(0).alias("t"), F.col("exact").alias("title_key"))
    base = w.filter("base <> '' AND base <> exact").join(listed.select("artist_key", F.col("title_key").alias("base")), ["artist_key", "base"], "left_semi").select("artist_key", "track", F.lit(1).alias("t"), F.col("base").alias("title_key"))
    folded = w.join(first, ["artist_key", "folded"]).select("artist_key", "track", F.lit(2).alias("t"), "title_key")
    best = exact.unionByName(base).unionByName(folded).groupBy("artist_key", "track").agg(F.min(F.struct("t", "title_key")).alias("b"))
    return best.select("artist_key", "track", F.element_at(F.array(F.lit("exact"), F.lit("base"), F.lit("folded")), F.col("b.t") + 1).alias("tier"), F.col("b.title_key").alias("title_key"))


def match_tracks(wanted: DataFrame, index: DataFrame, releases: DataFrame) -> DataFrame:
    """(artist_key, track, tier, place, release...): matching releases, editions collapsed, earliest first.

    releases(artist_key, rg_id, title, ..., ord), as releases_once() gives them.
    """
    hits = match_tiers(wanted, index).join(index.select("artist_key", "title_key", "rg_id", F.col("ord").alias("hit")), ["artist_key", "title_key"])
    rows = hits.join(releases.drop("ord"), ["artist_key", "rg_id"]).withColumn("edition", keys.edition_key("title"))
    date = F.coalesce(F.nullif("first_release", F.lit("")), F.lit("9999"))
    best = rows.withColumn("n", F.row_number().over(Window.partitionBy("artist_key", "track", "edition").orderBy(date, "hit"))).filter("n = 1")
    place = F.row_number().over(Window.partitionBy("artist_key", "track").orderBy(date, "hit"))
    return best.withColumn("place", place).select("artist_key", "track", "tier", "place", *[c for c in ALBUM_FIELDS if c in rows.columns], "edition")


def resolution_plan(cells: DataFrame, splits: DataFrame, blanks: DataFrame, budget: int = 3000) -> DataFrame:
    """(user, artist, track, plays, kind, artist_mbid, place): lookups worth making, most plays first.

    Splits, tracks without an album and era tracks are one job where artist and track agree but
    for case; the first kind stays and plays add up.
    """
    era = cells.filter("is_era").groupBy("user", "artist", "track").agg(F.sum("plays").alias("plays"), F.min("seq").alias("seq"))
    cols = ["user", "artist", "track", "plays", "at", "kind"]
    jobs = splits.select("user", "artist", "track", F.col("plays_affected").alias("plays"), F.struct(F.lit(0).alias("t"), (-F.col("plays_affected")).alias("p"), F.col("emit_ord").alias("s")).alias("at"), F.lit("split").alias("kind"))
    later = lambda d, t, k: d.select("user", "artist", "track", "plays", F.struct(F.lit(t).alias("t"), F.lit(0).cast("long").alias("p"), F.col("seq").alias("s")).alias("at"), F.lit(k).alias("kind")).select(*cols)
    jobs = jobs.select(*cols).unionByName(later(blanks, 1, "missing")).unionByName(later(era, 2, "era")).filter("artist <> '' AND track <> ''")
    one = jobs.groupBy("user", F.lower("artist").alias("a"), F.lower("track").alias("t")).agg(F.sum("plays").alias("plays"), F.min(F.struct("at", "artist", "track", "kind")).alias("head"))
    one = one.select("user", "head.artist", "head.track", "plays", "head.kind", F.col("head.at").alias("at"))
    ids = cells.filter("artist_mbid <> ''").groupBy("user", "artist_key").agg(F.min_by("artist_mbid", "seq").alias("artist_mbid"))
    out = one.withColumn("artist_key", keys.norm("artist")).join(ids, ["user", "artist_key"], "left")
    place = F.row_number().over(Window.partitionBy("user").orderBy(F.desc("plays"), "at"))
    return out.withColumn("place", place).filter(F.col("place") <= budget).select("user", "artist", "track", "plays", "kind", "artist_mbid", "place")


def by_artist(plan: DataFrame) -> DataFrame:
    """(user, artist_key, artist, jobs, plays, mbid): the plan by artist."""
    rows = plan.withColumn("artist_key", keys.norm("artist"))
    return rows.groupBy("user", "artist_key").agg(F.min_by("artist", "place").alias("artist"), F.count("*").alias("jobs"), F.sum("plays").alias("plays"), F.min(F.when(F.col("artist_mbid").isNotNull(), F.struct("place", "artist_mbid")))["artist_mbid"].alias("mbid"))


def split_by_strategy(plan: DataFrame, catalogue_cost: int = 2) -> DataFrame:
    """by_artist() with `catalogue`: whether reading the artist's catalogue costs less than one call a job.

    A known artist ID saves the call that finds it.
    """
    cost = F.when(F.col("mbid").isNotNull(), catalogue_cost - 1).otherwise(catalogue_cost)
    return by_artist(plan).withColumn("catalogue", F.col("jobs") > cost)


def estimate(artists: DataFrame, albums_per_artist: int = 12) -> DataFrame:
    """(user, artists, tracks, calls, seconds) for reading every artist's catalogue."""
    per = 1 + -(-albums_per_artist // 20)
    d = artists.groupBy("user").agg(F.count("*").alias("artists"), F.sum("jobs").alias("tracks")).withColumn("calls", F.col("artists") * per)
    return d.withColumn("seconds", F.ceil(F.col("calls") / 3))


def estimate_split(strategy: DataFrame, pages: int = 1) -> DataFrame:
    """(user, artists, catalogue_tracks, per_track, calls, seconds) for a split plan at a call a second."""
    c = F.col("catalogue")
    d = strategy.groupBy("user").agg(
        F.sum(c.cast("long")).alias("artists"), F.sum(F.when(c, F.col("jobs")).otherwise(0)).alias("catalogue_tracks"), F.sum(F.when(~c, F.col("jobs")).otherwise(0)).alias("per_track"),
        F.sum(F.when(c, F.when(F.col("mbid").isNull(), 1).otherwise(0) + pages).otherwise(F.col("jobs"))).alias("calls"),
    )
    return d.withColumn("seconds", F.col("calls"))


