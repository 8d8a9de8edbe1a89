"""The play log: its schema, landed service pages, and adapters over the fixture tables.

Plays carry `user`, under which everything is grouped, and `seq`, the order of input, which
settles ties and representative spellings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("user", "seq", "uts", "artist", "album", "track", "artist_mbid", "album_mbid", "track_mbid")
SCHEMA = "user string, seq long, uts long, artist string, album string, track string, artist_mbid string, album_mbid string, track_mbid string"

_TRACK = (
    "struct<name: string, mbid: string, artist: struct<`#text`: string, name: string, mbid: string>, album: struct<`#text`: string, mbid: string>, "
    "date: struct<uts: string>, `@attr`: struct<nowplaying: string>>"
)
_ATTR = "`@attr`: struct<total: string, totalPages: string, page: string>"
PAGE_SCHEMA = "user string, page long, fetched_at long, body string"


def flatten_pages(pages: DataFrame, until: int | None = None) -> DataFrame:
    """Plays from landed pages(user, page, fetched_at, body): one JSON page of the service a row.

    A page whose track is one object and not a list counts as a list of one.  Tracks now playing
    or undated are left out; names are trimmed; what is missing is "".  `until` re-anchors a
    walk that broke off: only plays at or before that time are kept.  Where a page was landed
    twice, the newer one counts.
    """
    newest = pages.groupBy("user", "page").agg(F.max_by("body", "fetched_at").alias("body"))
    many = F.from_json("body", f"recenttracks struct<{_ATTR}, track: array<{_TRACK}>>")
    one = F.from_json("body", f"recenttracks struct<{_ATTR}, track: {_TRACK}>")
    listed = F.get_json_object("body", "$.recenttracks.track").startswith("[")
    tracks = F.when(listed, many["recenttracks"]["track"]).otherwise(F.array(one["recenttracks"]["track"]))
    rows = newest.select("user", "page", F.posexplode(tracks).alias("i", "t")).filter(
        "NOT coalesce(t.`@attr`.nowplaying, '') = 'true' AND coalesce(t.date.uts, '') <> ''"
    )
    uts = F.col("t.date.uts").cast("long")
    text = lambda *cs: F.trim(F.coalesce(*[F.nullif(c, F.lit("")) for c in cs], F.lit("")))
    plays = rows.select(
        "user",
        (F.col("page") * 1000 + F.col("i")).cast("long").alias("seq"),
        uts.alias("uts"),
        text(F.col("t.artist.`#text`"), F.col("t.artist.name")).alias("artist"),
        text(F.col("t.album.`#text`")).alias("album"),
        text(F.col("t.name")).alias("track"),
        F.coalesce("t.artist.mbid", F.lit("")).alias("artist_mbid"),
        F.coalesce("t.album.mbid", F.lit("")).alias("album_mbid"),
        F.coalesce("t.mbid", F.lit("")).alias("track_mbid"),
    )
    return plays if until is None else plays.filter(F.col("uts") <= until)


def read_pages(spark: SparkSession, path: str, until: int | None = None) -> DataFrame:
    """flatten_pages() over a folder of JSON lines with the columns of PAGE_SCHEMA."""
    return flatten_pages(spark.read.schema(PAGE_SCHEMA).json(path), until)


def resume_points(pages: DataFrame) -> DataFrame:
    """(user, fetched, total_pages, total_plays, next_page, anchor): where each walk goes on.

    next_page is null when all pages are there; anchor is a second before the oldest play, from
    which a walk can start over when deep pages fail.
    """
    attr = F.from_json("body", f"recenttracks struct<{_ATTR}>")["recenttracks"]["@attr"]
    newest = pages.groupBy("user", "page").agg(F.max_by("body", "fetched_at").alias("body"))
    state = newest.select("user", "page", attr["totalPages"].cast("long").alias("pages"), attr["total"].cast("long").alias("plays"))
    state = state.groupBy("user").agg(F.max("page").alias("fetched"), F.max_by("pages", "page").alias("total_pages"), F.max_by("plays", "page").alias("total_plays"))
    oldest = flatten_pages(pages).groupBy("user").agg((F.min("uts") - 1).alias("anchor"))
    following = F.when(F.col("fetched") < F.coalesce("total_pages", F.lit(1)), F.col("fetched") + 1)
    return state.withColumn("next_page", following).join(oldest, "user", "left")


def store_plays(plays: DataFrame, path: str) -> None:
    """Replace the stored log of each user in plays; other users' stay."""
    plays.sparkSession.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    plays.select(*COLUMNS).repartitionByRange("user", "seq").sortWithinPartitions("user", "seq").write.mode("overwrite").partitionBy("user").parquet(path)


def load_plays(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path).select(*COLUMNS)


# Adapters: the fixture tables as play logs.  The expressions are SQL that Spark and DuckDB share.

_BASE = {
    "user": "'u' || CAST(l_orderkey % 4 AS VARCHAR(9))",
    "seq": "((l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey",
    "k": "(l_orderkey * 7 + l_linenumber * 3 + l_suppkey) % 97",
    "j": "(l_partkey * 5 + l_suppkey + l_linenumber) % 23",
}
_PLAY = {
    "artist": """CASE k WHEN 1 THEN upper(p_brand) WHEN 2 THEN 'The ' || p_brand WHEN 3 THEN p_brand || ' feat. Guest' WHEN 4 THEN p_brand || ' & Brand#1'
        WHEN 5 THEN 'Brannd' || substr(p_brand, 6) WHEN 6 THEN 'Various Artists' WHEN 7 THEN p_brand || ' with Friends' WHEN 8 THEN 'Bránd' || substr(p_brand, 6) ELSE p_brand END""",
    "album": """CASE j WHEN 10 THEN p_type || ' (Deluxe Edition)' WHEN 11 THEN p_name || ' - Single' WHEN 12 THEN 'Unreleased (' || p_type || ' Era)' WHEN 13 THEN 'Unreleased'
        WHEN 14 THEN '' WHEN 15 THEN p_type || ' Sessions' WHEN 16 THEN p_type || ' Leaks' WHEN 17 THEN 'Unreleased [' || p_type || ' Sessions]'
        WHEN 18 THEN 'Unreleased - ' || p_type || ' (Era)' WHEN 19 THEN CASE WHEN k < 20 THEN 'Unreleased (' || substr(p_type, 1, 3) || substr(p_type, 3) || ' Era)' ELSE 'Unreleased  (' || p_type || ' Era)' END
        WHEN 20 THEN 'Greatest Hits' ELSE p_type END""",
    "track": """CASE WHEN k BETWEEN 10 AND 13 THEN p_name || ' (feat. Guest)' WHEN k = 14 THEN p_name || ' (feat. Other)' WHEN k = 15 THEN upper(p_name)
        WHEN k = 16 THEN p_name || '!' WHEN k = 17 THEN 'Intro' ELSE p_name END""",
    "artist_mbid": "CASE WHEN l_partkey % 3 = 0 AND k > 8 THEN 'art-' || substr(p_brand, 7) ELSE '' END",
    "album_mbid": "CASE WHEN l_partkey % 4 = 0 AND j <> 14 THEN 'alb-' || p_brand || '-' || CAST(l_partkey % 8 AS VARCHAR(9)) ELSE '' END",
    "track_mbid": "CASE WHEN l_partkey % 5 = 0 THEN 'trk-' || p_name || CAST(l_partkey % 10 AS VARCHAR(9)) ELSE '' END",
}


def _epoch(column: str) -> str:
    """Seconds of a UTC wall-clock column, whatever the session's time zone."""
    return f"timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST({column} AS TIMESTAMP_NTZ))"


def _listing(exprs: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {c}" if c != "user" else f'{e} AS "user"' for c, e in exprs.items())


#: DuckDB: the rows of lineitem_plays().
PLAYS_SQL = f"""SELECT "user", seq, CAST(epoch(l_shipdate) AS BIGINT) AS uts, {_listing(_PLAY)}
FROM (SELECT *, {_listing(_BASE)} FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def lineitem_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A play log from order lines: brands as artists, parts as tracks, with drift put in."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_brand", "p_type")
    base = items.join(parts, items["l_partkey"] == parts["p_partkey"]).selectExpr("*", *[f"{e} AS {c}" for c, e in _BASE.items()])
    return base.selectExpr("user", "seq", f"{_epoch('l_shipdate')} AS uts", *[f"{e} AS {c}" for c, e in _PLAY.items()])


EVENTS_SQL = """SELECT 'u' || CAST(user_id % 8 AS VARCHAR) AS "user", event_id AS seq, CAST(floor(epoch(ts)) AS BIGINT) AS uts, event_type AS artist, '' AS album, event_type AS track,
'' AS artist_mbid, '' AS album_mbid, '' AS track_mbid FROM events"""


def event_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A play log from the event stream: times to the second, few titles, so adjacent repeats occur."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    blank = [F.lit("").alias(c) for c in ("artist_mbid", "album_mbid", "track_mbid")]
    return rows.select(
        F.concat(F.lit("u"), (F.col("user_id") % 8).cast("string")).alias("user"), F.col("event_id").alias("seq"), F.expr(_epoch("ts")).alias("uts"),
        F.col("event_type").alias("artist"), F.lit("").alias("album"), F.col("event_type").alias("track"), *blank,
    )


_TOP_ARTIST = "CASE l_linenumber WHEN 7 THEN 'Various Artists' WHEN 6 THEN p_brand || ' & Friends' ELSE p_brand END"
_TOP_MBID = "CASE WHEN length(p_name) % 3 = 0 THEN 'rel-' || p_name || '-' || substr(p_brand, 7, 1) ELSE '' END"
TOP_ALBUMS_SQL = f"""SELECT "user", name, artist, mbid, count(*) AS playcount, min(seq) AS ord FROM (
SELECT {_BASE['user']} AS "user", p_name AS name, {_TOP_ARTIST} AS artist, CASE WHEN l_linenumber = 7 THEN '' ELSE {_TOP_MBID} END AS mbid, {_BASE['seq']} AS seq
FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY ALL"""


def top_albums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An album chart (user, name, artist, mbid, playcount, ord) from order lines."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_brand")
    rows = items.join(parts, items["l_partkey"] == parts["p_partkey"]).selectExpr(
        f"{_BASE['user']} AS user", "p_name AS name", f"{_TOP_ARTIST} AS artist", f"CASE WHEN l_linenumber = 7 THEN '' ELSE {_TOP_MBID} END AS mbid", f"{_BASE['seq']} AS seq"
    )
    return rows.groupBy("user", "name", "artist", "mbid").agg(F.count("*").alias("playcount"), F.min("seq").alias("ord"))
