"""Release services as landed tables: mapping their answers to one release-group shape.

Every lookup keeps three states: an answer that names releases, an answer that there are none,
and no answer (a call that failed or was never made).  The last is a missing row, never a no.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playtide.functions import keys

NO_DATE = "9999"


def _date(c: str = "first_release") -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(NO_DATE))


def earliest(rows: DataFrame, by: list[str], order: str = "ord") -> DataFrame:
    """The row of the earliest release of each key; on equal dates the first in the source's order."""
    w = Window.partitionBy(*by).orderBy(_date(), order)
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def recording_groups(recordings: DataFrame) -> DataFrame:
    """(artist, track, ord, release group...): MusicBrainz recordings' releases by release group.

    recordings(artist, track, recording_id, releases array<struct<status, rg_id, title, primary,
    secondary, first_release>>, ord): one row a recording found for the looked-up track.
    """
    rows = recordings.select("artist", "track", "recording_id", F.col("ord").alias("rec"), F.posexplode("releases").alias("i", "r")).filter("coalesce(r.rg_id, '') <> ''")
    flat = rows.select(
        "artist", "track", F.struct("rec", "i").alias("at"), "r.rg_id", "r.title", "r.primary", F.coalesce("r.secondary", F.array().cast("array<string>")).alias("secondary"),
        "r.first_release", "r.status", "recording_id", F.lit("musicbrainz").alias("source"),
    )
    best = earliest(flat, ["artist", "track", "rg_id"], "at")
    return best.withColumn("ord", F.row_number().over(Window.partitionBy("artist", "track").orderBy(_date(), "at"))).drop("at")


def album_groups(albums: DataFrame) -> DataFrame:
    """Streaming albums(id, name, album_type, total_tracks, release_date, ...) as release groups.

    A "single" of four to eight tracks is an EP; a compilation is an album with that secondary type.
    """
    kind, n = F.coalesce("album_type", F.lit("album")), F.coalesce(F.col("total_tracks"), F.lit(0))
    primary = F.when((kind == "single") & n.between(4, 8), "EP").when(kind == "single", "Single").otherwise("Album")
    secondary = F.when(kind == "compilation", F.array(F.lit("Compilation"))).otherwise(F.array().cast("array<string>"))
    return albums.select(
        *[c for c in albums.columns if c not in ("id", "name", "album_type", "total_tracks", "release_date")],
        F.concat(F.lit("spotify:"), F.col("id").cast("string")).alias("rg_id"), F.col("name").alias("title"), primary.alias("primary"), secondary.alias("secondary"),
        F.nullif("release_date", F.lit("")).alias("first_release"), F.lit("Official").alias("status"), F.nullif(n, F.lit(0)).alias("total_tracks"), F.lit("spotify").alias("source"),
    )


def track_releases(found: DataFrame) -> DataFrame:
    """Release groups of streaming search hits that match both track and artist exactly.

    found(artist, track, hit_track, hit_artists array, id, name, ..., ord).
    """
    want = found.withColumn("__t", keys.norm_release("track") == keys.norm_release("hit_track"))
    names = want.withColumn("__a", F.explode_outer("hit_artists")).filter(F.col("__t") & (keys.norm_release("__a") == keys.norm_release("artist")))
    rows = names.drop("__a", "__t", "hit_artists").dropDuplicates(["artist", "track", "ord"])
    best = earliest(album_groups(rows), ["artist", "track", "rg_id"])
    return best.withColumn("ord", F.row_number().over(Window.partitionBy("artist", "track").orderBy(_date(), "ord")))


def existence(found: DataFrame, asked: DataFrame, near: int = 5) -> DataFrame:
    """(artist, title, exists, matches, near) for asked(artist, title) that were answered.

    found(artist, title, hit_title, ord), and hit_artists for a source that must match the artist
    too; a question with no hits was answered with no.
    """
    exact = keys.norm_release("hit_title") == keys.norm_release("title")
    rows = found.withColumn("exact", exact)
    if "hit_artists" in found.columns:
        names = rows.withColumn("__a", F.explode_outer("hit_artists")).withColumn("__same", keys.norm_release("__a") == keys.norm_release("artist"))
        others = [c for c in found.columns if c != "hit_artists"]
        rows = names.groupBy(*others).agg(F.bool_or(F.col("exact") & F.coalesce("__same", F.lit(False))).alias("exact"))
    listed = lambda cond: F.slice(F.array_sort(F.collect_list(F.when(cond, F.struct("ord", "hit_title")))), 1, near)
    sums = rows.groupBy("artist", "title").agg(F.bool_or("exact").alias("exists"), listed(F.col("exact")).alias("matches"), listed(~F.col("exact")).alias("near"))
    out = asked.select("artist", "title").distinct().join(sums, ["artist", "title"], "left")
    pick = lambda c: F.transform(F.coalesce(c, F.array().cast("array<struct<ord: bigint, hit_title: string>>")), lambda x: x["hit_title"])
    return out.select("artist", "title", F.coalesce("exists", F.lit(False)).alias("exists"), pick("matches").alias("matches"), pick("near").alias("near"))


def artist_ids(found: DataFrame) -> DataFrame:
    """(artist, id): the first hit whose name is the artist's; found(artist, hit_name, id, ord)."""
    rows = found.filter(keys.norm_release("hit_name") == keys.norm_release("artist"))
    return rows.groupBy("artist").agg(F.min_by("id", "ord").alias("id"))


def artist_albums(found: DataFrame, cap: int = 100) -> DataFrame:
    """(artist, albums, truncated): albums of the exact artist, each id once, `cap` at most.

    found(artist, hit_name, id, name, ord).  The cap is the service's own contract; `truncated`
    tells where it cut.
    """
    rows = found.filter(keys.norm_release("hit_name") == keys.norm_release("artist")).filter("id IS NOT NULL")
    first = rows.groupBy("artist", "id").agg(F.min("ord").alias("ord"), F.min_by("name", "ord").alias("name"))
    n = F.row_number().over(Window.partitionBy("artist").orderBy("ord"))
    total = F.count("*").over(Window.partitionBy("artist"))
    rows = first.withColumn("n", n).withColumn("total", total).filter(F.col("n") <= cap)
    return rows.groupBy("artist").agg(F.array_sort(F.collect_list(F.struct("n", "id", "name"))).alias("albums"), (F.max("total") > cap).alias("truncated"))


def tracklists(albums: DataFrame) -> DataFrame:
    """(album id, title, artists, disc, n, partial): explode albums(id, total_tracks, tracks array).

    partial marks albums whose embedded list is shorter than the album says.
    """
    short = F.coalesce(F.col("total_tracks"), F.lit(0)) > F.coalesce(F.size("tracks"), F.lit(0))
    rows = albums.select("id", short.alias("partial"), F.explode("tracks").alias("t"))
    return rows.select("id", F.col("t.title").alias("title"), F.col("t.artists").alias("artists"), F.coalesce("t.disc", F.lit(1)).alias("disc"), F.col("t.n").alias("n"), "partial")


def catalogue_page(releases: DataFrame) -> DataFrame:
    """(artist, release group..., tracks): MusicBrainz releases(artist, id, title, date, status, rg struct, media array) with tracklists."""
    rg = F.col("rg")
    tracks = F.filter(F.flatten(F.transform("media", lambda m: F.transform(m["tracks"], lambda t: F.coalesce(F.nullif(t["title"], F.lit("")), t["recording_title"])))), lambda t: F.coalesce(t, F.lit("")) != "")
    return releases.filter("id IS NOT NULL").select(
        "artist", "ord", F.when(rg["id"].isNotNull(), F.concat(F.lit("mb:"), rg["id"])).otherwise(F.concat(F.lit("mbrel:"), "id")).alias("rg_id"),
        F.coalesce(rg["title"], "title").alias("title"), rg["primary"].alias("primary"), F.coalesce(rg["secondary"], F.array().cast("array<string>")).alias("secondary"),
        F.coalesce(rg["first_release"], "date").alias("first_release"), F.coalesce("status", F.lit("Official")).alias("status"), F.lit("musicbrainz").alias("source"), tracks.alias("tracks"),
    )


def next_offsets(pages: DataFrame) -> DataFrame:
    """(artist, next_offset): pages(artist, offset, returned, total) advance by what was returned."""
    last = pages.groupBy("artist").agg(F.max(F.struct("offset", "returned", "total")).alias("p")).select("artist", "p.*")
    after = F.col("offset") + F.col("returned")
    return last.select("artist", F.when((F.col("returned") > 0) & (after < F.col("total")), after).alias("next_offset"))
