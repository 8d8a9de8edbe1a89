import json

import pytest
from pyspark.sql import functions as F

from playtide.functions import keys
from playtide.operators import catalogue
from playtide.sources import cache, releases

RELEASES = "array<struct<status: string, rg_id: string, title: string, primary: string, secondary: array<string>, first_release: string>>"


def test_recordings_keep_the_earliest_release(spark):
    rows = [("A", "t", "r1", [("Official", "g1", "One", "Album", None, "2001"), ("Official", "g2", "Two", "Single", [], None), (None, None, "x", None, None, None)], 0), ("A", "t", "r2", [("Official", "g1", "One", "Album", [], "1999")], 1)]
    df = spark.createDataFrame(rows, f"artist string, track string, recording_id string, releases {RELEASES}, ord long")
    got = [(r.rg_id, r.first_release, r.recording_id, r.secondary) for r in releases.recording_groups(df).orderBy("ord").collect()]
    assert got == [("g1", "1999", "r2", []), ("g2", None, "r1", [])]


def test_streaming_albums_become_groups(spark):
    rows = [("1", "a", "single", 5, "2020"), ("2", "b", "single", 2, ""), ("3", "c", "compilation", 20, "2021"), ("4", "d", None, None, None)]
    df = spark.createDataFrame(rows, "id string, name string, album_type string, total_tracks int, release_date string")
    got = {r.rg_id: (r.primary, r.secondary, r.first_release, r.total_tracks, r.status) for r in releases.album_groups(df).collect()}
    assert got == {"spotify:1": ("EP", [], "2020", 5, "Official"), "spotify:2": ("Single", [], None, 2, "Official"), "spotify:3": ("Album", ["Compilation"], "2021", 20, "Official"), "spotify:4": ("Album", [], None, None, "Official")}


def test_exact_hits_only(spark):
    rows = [("Yeat", "Sky", "SKY!", ["Yeat"], "1", "Deluxe", "album", 9, "2022", 0), ("Yeat", "Sky", "Sky", ["Y.eat", "YEAT"], "1", "First", "album", 9, "2021", 1), ("Yeat", "Sky", "Sky", ["Other"], "2", "No", "album", 9, "2001", 2), ("Yeat", "Sky", "Skyline", ["Yeat"], "3", "No", "album", 9, "2001", 3)]
    df = spark.createDataFrame(rows, "artist string, track string, hit_track string, hit_artists array<string>, id string, name string, album_type string, total_tracks int, release_date string, ord long")
    assert [(r.rg_id, r.title) for r in releases.track_releases(df).collect()] == [("spotify:1", "First")]


def test_existence_is_an_answer_only_if_asked(spark):
    found = spark.createDataFrame([("A", "Drip Season", "drip  season", 0), ("A", "Drip Season", "Drip Season 3", 1)], "artist string, title string, hit_title string, ord long")
    asked = spark.createDataFrame([("A", "Drip Season"), ("A", "Nothing")], "artist string, title string")
    got = {r.title: (r.exists, r.matches, r.near) for r in releases.existence(found, asked).collect()}
    assert got == {"Drip Season": (True, ["drip  season"], ["Drip Season 3"]), "Nothing": (False, [], [])}
    both = found.withColumn("hit_artists", F.array(F.lit("B")))
    assert not any(r.exists for r in releases.existence(both, asked).collect())


def test_artists_albums_and_pages(spark):
    hits = spark.createDataFrame([("A", "a!", "1", "x", 0), ("A", "A", "1", "x2", 1), ("A", "A", "2", "y", 2), ("A", "AB", "3", "z", 3), ("A", "A", None, "n", 4)], "artist string, hit_name string, id string, name string, ord long")
    assert [(r.artist, r.id) for r in releases.artist_ids(hits).collect()] == [("A", "1")]
    r = releases.artist_albums(hits).first()
    assert ([x.name for x in r.albums], r.truncated) == (["x", "y"], False)
    assert releases.artist_albums(hits, cap=1).first().truncated
    pages = spark.createDataFrame([("A", 0, 25, 60), ("A", 25, 20, 60), ("B", 0, 10, 10), ("C", 0, 0, 5)], "artist string, offset int, returned int, total int")
    assert {r.artist: r.next_offset for r in releases.next_offsets(pages).collect()} == {"A": 45, "B": None, "C": None}


def test_tracklists(spark):
    rows = [("1", 3, [("a", ["X"], None, 1), ("b", ["X", "Y"], 2, 2)]), ("2", 1, [("c", ["Z"], 1, 1)]), ("3", 1, None)]
    df = spark.createDataFrame(rows, "id string, total_tracks int, tracks array<struct<title: string, artists: array<string>, disc: int, n: int>>")
    assert {(r.id, r.title, r.disc, r.partial) for r in releases.tracklists(df).collect()} == {("1", "a", 1, True), ("1", "b", 2, True), ("2", "c", 1, False)}
    page = spark.createDataFrame(
        [("A", 0, "r1", "Title", "2001", None, ("g", "Group", "Album", None, "2000"), [([("x", None), (None, "rec"), (None, None)],)]), ("A", 1, "r2", "Alone", "2003", "Bootleg", None, [])],
        "artist string, ord int, id string, title string, date string, status string, rg struct<id: string, title: string, primary: string, secondary: array<string>, first_release: string>, media array<struct<tracks: array<struct<title: string, recording_title: string>>>>",
    )
    got = {r.rg_id: (r.title, r.first_release, r.status, r.tracks) for r in releases.catalogue_page(page).collect()}
    assert got == {"mb:g": ("Group", "2000", "Official", ["x", "rec"]), "mbrel:r2": ("Alone", "2003", "Bootleg", [])}


def test_match_tiers_and_editions(spark):
    tracks = spark.createDataFrame([("t", "3500", "rodeo", 0), ("t", "3500", "deluxe", 1), ("t", "Sicko", "astro", 2), ("t", "Café (feat. X)", "cafe", 3)], "artist_key string, title string, rg_id string, ord long")
    rel = spark.createDataFrame([("t", "rodeo", "Rodeo", "2015", 0), ("t", "deluxe", "Rodeo (Deluxe Edition)", "2014", 1), ("t", "astro", "ASTROWORLD", None, 2), ("t", "cafe", "Café", "2010", 3)], "artist_key string, rg_id string, title string, first_release string, ord long")
    want = spark.createDataFrame([("t", "3500"), ("t", "Sicko (feat. Drake)"), ("t", "Cafe"), ("t", "Unknown")], "artist_key string, track string")
    got = {r.track: (r.tier, r.title, r.place) for r in catalogue.match_tracks(want, catalogue.title_index(tracks), rel).collect()}
    assert got == {"3500": ("exact", "Rodeo (Deluxe Edition)", 1), "Sicko (feat. Drake)": ("base", "ASTROWORLD", 1), "Cafe": ("folded", "Café", 1)}


def test_strategy(spark):
    rows = [("u", "A", f"t{i}", 5, "split", "id", i) for i in range(6)] + [("u", "B", "t", 3, "era", None, 7), ("u", "C", "t", 3, "era", None, 8), ("u", "C", "v", 3, "era", None, 9)]
    plan = spark.createDataFrame(rows, "user string, artist string, track string, plays long, kind string, artist_mbid string, place long")
    s = catalogue.split_by_strategy(plan)
    assert {r.artist for r in s.filter("catalogue").collect()} == {"A"}
    r = catalogue.estimate_split(s).first()
    assert (r.artists, r.catalogue_tracks, r.per_track, r.calls) == (1, 6, 3, 4)
    e = catalogue.estimate(catalogue.by_artist(plan)).first()
    assert (e.artists, e.tracks, e.calls, e.seconds) == (3, 9, 6, 2)


DAY = 86_400


def test_cache_ages(spark):
    now = 2_000_000_000
    no, yes = json.dumps({"groups": []}), json.dumps({"groups": [{"t": 1}]})
    rows = [("a", no, now - 29 * DAY), ("b", no, now - 31 * DAY), ("c", yes, now - 1800 * DAY), ("d", json.dumps({"exists": False}), None), ("e", json.dumps({"found": False}), now - 40 * DAY), ("e", yes, now - 50 * DAY)]
    df = spark.createDataFrame(rows, "k string, v string, created long")
    fresh = cache.fresh_client(df, now)
    assert {r.k for r in fresh.collect()} == {"a", "c", "d"}
    assert {r.k for r in cache.fresh_shared(df.filter("created IS NOT NULL"), now).collect()} == {"a"}
    wanted = spark.createDataFrame([("a",), ("b",), ("z",)], "k string")
    assert {r.k for r in cache.misses(wanted, fresh).collect()} == {"b", "z"}
    after = cache.with_answers(df, spark.createDataFrame([("b", yes), ("z", None)], "k string, v string"), now)
    assert {r.k: r.v for r in after.filter("k IN ('b', 'z')").collect()} == {"b": yes}
    assert cache.usage(df).agg(F.sum("negatives")).first()[0] == 4


def test_column_forms(spark):
    df = spark.createDataFrame([("arjan", "Years & Years", "Desire (Gryffin Remix)", "a/b"), ("", "X", "y", "z"), ("u", "A", "(no album)", "")], "user string, artist string, album string, track string")
    c = F.col
    rows = df.select(keys.library_link(c("user"), c("artist"), album=c("album")).alias("al"), keys.library_link(c("user"), c("artist"), track=c("track")).alias("tr"), keys.query_escape(F.lit('a"b\\')).alias("q"), keys.redact(F.lit("f" * 32)).alias("r")).collect()
    base = "https://www.last.fm/user/arjan/library/music/Years+%26+Years"
    assert rows[0].al == f"{base}/Desire+%28Gryffin+Remix%29" and rows[0].tr == f"{base}/_/a%2Fb"
    assert rows[1].al is None and rows[1].tr is None and rows[2].al is None and rows[0].q == 'a\\"b\\\\' and rows[0].r == "[redacted-key]"
    assert spark.range(1).select(keys.minute_stamp(F.lit(90)).alias("m"), keys.hour_stamp(F.lit(5)).alias("h"), keys.month_name(F.lit(0)).alias("n")).first() == ("1970-01-01 00:01 UTC", "1970-01-01 05:00", "Jan 1970")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert spark.range(1).select(keys.minute_stamp(F.lit(90))).first()[0] == "1970-01-01 00:01 UTC"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("name", ["similar", "contains_name", "digits_only_differ"])
def test_pairs_of_nulls(spark, name):
    df = spark.createDataFrame([(None, None), ("a", None)], "a string, b string")
    assert len(df.select(getattr(keys, name)("a", "b")).collect()) == 2
