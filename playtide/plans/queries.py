"""The queries: every operator over the fixture tables, in flat columns where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playtide.functions import keys
from playtide.operators import albums, artists, catalogue, chart, resolve, timing, unreleased
from playtide.operators.cells import kept_cells, weak_era_candidates
from playtide.operators.names import edit_pairs
from playtide.plans import report
from playtide.sources import cache, releases
from playtide.sources import plays as source
from playtide.sources.scratch import kept

NOW = 915_148_800


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return kept_cells(source.lineitem_plays(spark, d))


def _rest(spark: SparkSession, d: str) -> DataFrame:
    return _cells(spark, d).filter("NOT is_era")


def _era(spark: SparkSession, d: str) -> DataFrame:
    return _cells(spark, d).filter("is_era")


def _part(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/part.parquet")


def _listed(items: Column, name: str) -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat_ws(":", x[name], x["plays"].cast("string"))), "|")


def _text_key(fn):
    def run(spark: SparkSession, d: str) -> DataFrame:
        docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
        return docs.select("doc_id", F.md5(fn("text").cast("binary")).alias("key"))

    return run


def base_title(spark, d):
    return _cells(spark, d).select("track", F.col("track_base").alias("base"), F.col("base_id").alias("identity")).distinct()


def era_flags(spark, d):
    return _cells(spark, d).select("album", "era_explicit", "era_weak", "era_ambiguous", "era_name", "undifferentiated").distinct()


def era_partition(spark, d):
    return _cells(spark, d).groupBy("user", "artist", "album", "track", "is_era").agg(F.sum("plays").alias("plays"))


def era_overview(spark, d):
    return unreleased.overview(_cells(spark, d)).drop("top_albums")


def d4_groups(spark, d):
    return albums.album_groups(_rest(spark, d)).select("user", "artist", "track", F.col("total").alias("plays_affected"), _listed(F.col("m"), "shown").alias("members"))


def d4_members(spark, d):
    rows = albums.decide_splits(_rest(spark, d)).select("user", "artist", "track", F.explode(F.arrays_zip("m", F.col("j.kinds").alias("kinds"))).alias("x"))
    return rows.select("user", "artist", "track", F.col("x.m.shown").alias("album"), F.col("x.m.plays").alias("plays"), F.col("x.m.first").alias("first"), F.col("x.m.last").alias("last"), F.col("x.kinds").alias("looks_like"))


def _decided(spark, d):
    return albums.decide_splits(_rest(spark, d), ratio=False)


def d4_decision(spark, d):
    return _decided(spark, d).select("user", "artist", "track", F.col("total").alias("plays_affected"), "verdict", "reason", "class", "confidence")


def mbid_verdicts(spark, d):
    return _decided(spark, d).groupBy("verdict").agg(F.count("*").alias("groups"), F.sum("total").alias("plays"))


def d5_missing(spark, d):
    return albums.blank_tracks(_rest(spark, d)).drop("seq")


def d5_months(spark, d):
    return albums.monthly(source.lineitem_plays(spark, d).filter("album = ''")).drop("seq")


def d6_dupes(spark, d):
    return timing.adjacent_repeats(source.event_plays(spark, d))


def d6_systemic(spark, d):
    plays = source.event_plays(spark, d)
    return timing.systemic_months(plays, timing.adjacent_repeats(plays), share=0.001)


def d7_casing(spark, d):
    rows = artists.casing_variants(_rest(spark, d))
    return rows.select("user", F.lower(F.col("members")[0]["artist"]).alias("name"), _listed(F.col("members"), "artist").alias("members"), "plays_affected")


def d8_titles(spark, d):
    return artists.title_groups(_rest(spark, d)).select("user", "artist", "track", "verdict", "kind", "plays_affected")


def d8_joint(spark, d):
    return artists.joint_credits(_rest(spark, d)).drop("seq")


def d8_field(spark, d):
    return artists.field_features(_rest(spark, d)).drop("seq")


def d1_exact(spark, d):
    rows = artists.exact_variants(_rest(spark, d))
    return rows.select("user", F.col("artist_fold").alias("fold"), F.col("kept")[0]["artist"].alias("target"), F.col("total").alias("plays_affected"), _listed(F.col("kept"), "artist").alias("members"))


def d11_various(spark, d):
    return _rest(spark, d).filter(F.col("artist_key").isin(*albums.VARIOUS)).groupBy("user", "album").agg(F.sum("plays").alias("plays"))


def d12_bursts(spark, d):
    return timing.bursts(source.event_plays(spark, d), 3).drop("seq")


def d12_future(spark, d):
    return timing.future_plays(source.event_plays(spark, d), 1_705_276_800).select("user", "seq", "uts", "track")


def d14a_formats(spark, d):
    return unreleased.format_groups(_era(spark, d)).select("user", "artist", "album_key", _listed(F.col("m"), "album").alias("members"), F.col("total").alias("plays_affected"))


def d14c_multi_era(spark, d):
    rows = unreleased.multi_era_tracks(_era(spark, d))
    names = F.array_join(F.array_sort(F.transform("eras", lambda e: e["era_name"])), "|")
    return rows.select("user", "artist", "track", F.size("eras").cast("long").alias("eras"), names.alias("names"), F.col("total").alias("plays_affected"), F.when(F.col("versioned"), 0.3).otherwise(0.45).alias("confidence"))


def d14f_buckets(spark, d):
    return unreleased.buckets(_cells(spark, d), min_tracks=3).select("user", "artist", "album", "plays", "tracks", "chart_rank")


def d15_album_artist(spark, d):
    rows = albums.album_artist_pairs(source.top_albums(spark, d))
    conf = F.when(F.col("evidence") == "release", 0.95).when(F.col("evidence") == "various", 0.85).otherwise(0.8)
    return rows.select("user", "evidence", F.col("hi_name").alias("album"), F.col("hi_artist").alias("artist"), F.col("lo_artist").alias("other"), (F.col("hi_plays") + F.col("lo_plays")).alias("plays_affected"), conf.alias("confidence"))


def d16_candidates(spark, d):
    return resolve.single_candidates(_rest(spark, d)).select("user", "artist", "track", "album", "plays")


def album_chart(spark, d):
    return chart.album_chart(_rest(spark, d)).drop("seq")


def chart_rank(spark, d):
    return chart.chart_ranks(chart.album_chart(_rest(spark, d))).drop("seq")


def top_albums_per_artist(spark, d):
    from pyspark.sql import Window

    rows = _rest(spark, d).filter("album <> ''").groupBy("user", "artist_key", "artist", "album").agg(F.sum("plays").alias("plays"), F.min("seq").alias("seq"))
    w = Window.partitionBy("user", "artist_key").orderBy(F.desc("plays"), "seq")
    return rows.withColumn("place", F.row_number().over(w)).filter("place <= 3").drop("seq")


def _plan(spark, d):
    cells = _cells(spark, d)
    rest = cells.filter("NOT is_era")
    groups = albums.album_groups(rest).select("user", "artist", "track", F.col("total").alias("plays_affected"), F.col("seq").alias("emit_ord"))
    return catalogue.resolution_plan(cells, groups, albums.blank_tracks(rest), budget=1_000_000)


def resolution_plan(spark, d):
    return _plan(spark, d).drop("place")


def by_artist(spark, d):
    return catalogue.by_artist(_plan(spark, d))


def strategy_split(spark, d):
    return catalogue.split_by_strategy(_plan(spark, d)).select("user", "artist_key", "jobs", "catalogue")


def plan_estimates(spark, d):
    return catalogue.estimate_split(catalogue.split_by_strategy(_plan(spark, d))).drop("seconds")


def _catalogue(spark, d):
    """A catalogue of brands from parts: releases, an index of titles, and tracks to be matched."""
    p = _part(spark, d).withColumn("artist_key", keys.norm("p_brand"))
    third, rg = F.col("p_partkey") % 3, F.concat_ws("/", "p_brand", "p_type", (F.col("p_partkey") % 3).cast("string"))
    title = F.concat("p_type", F.when(third == 0, "").when(third == 1, " (Deluxe Edition)").otherwise(" - Remastered"))
    date = F.when(F.col("p_partkey") % 5 == 0, "").otherwise((1960 + F.col("p_partkey") % 60).cast("string"))
    rel = catalogue.releases_once(p.select("artist_key", rg.alias("rg_id"), title.alias("title"), date.alias("first_release"), F.col("p_partkey").alias("ord")))
    name = F.when(F.col("p_partkey") % 4 == 0, F.concat("p_name", F.lit(" (feat. Guest)"))).when(F.col("p_partkey") % 7 == 0, F.regexp_replace("p_name", "e", "é")).otherwise(F.col("p_name"))
    index = catalogue.title_index(p.select("artist_key", name.alias("title"), rg.alias("rg_id"), F.col("p_partkey").alias("ord")))
    want = F.when(F.col("p_size") % 6 == 0, F.concat("p_name", F.lit(" [with Guest]"))).when(F.col("p_size") % 6 == 1, F.regexp_replace("p_name", "e", "ê")).otherwise(F.col("p_name"))
    return p.select("artist_key", want.alias("track")), index, rel


def match_tiers(spark, d):
    wanted, index, _ = _catalogue(spark, d)
    return catalogue.match_tiers(wanted, index)


def match_tracks(spark, d):
    return catalogue.match_tracks(*_catalogue(spark, d))


def recording_groups(spark, d):
    date = F.when(F.col("p_size") % 5 != 0, (1950 + F.col("p_size")).cast("string"))
    release = F.struct(F.lit("Official").alias("status"), F.concat_ws("/", "p_brand", "p_type").alias("rg_id"), F.col("p_type").alias("title"), F.lit("Album").alias("primary"), F.array().cast("array<string>").alias("secondary"), date.alias("first_release"))
    rows = _part(spark, d).select(F.col("p_brand").alias("artist"), F.col("p_name").alias("track"), F.concat(F.lit("rec-"), F.col("p_partkey")).alias("recording_id"), F.array(release).alias("releases"), F.col("p_partkey").alias("ord"))
    return releases.recording_groups(rows).select("artist", "track", "rg_id", "first_release", "recording_id")


def album_groups(spark, d):
    kind = F.when(F.col("p_size") % 3 == 0, "single").when(F.col("p_size") % 3 == 1, "compilation").otherwise("album")
    rows = _part(spark, d).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), kind.alias("album_type"), (F.col("p_size") % 10).alias("total_tracks"), F.lit("").alias("release_date"))
    return releases.album_groups(rows).select("rg_id", "title", F.col("primary").alias("primary_type"), F.array_contains("secondary", "Compilation").alias("compilation"))


def artist_albums(spark, d):
    hit = F.when(F.col("p_partkey") % 3 == 0, "Someone Else").otherwise(F.upper("p_brand"))
    rows = _part(spark, d).select(F.col("p_brand").alias("artist"), hit.alias("hit_name"), F.concat_ws("-", "p_type", (F.col("p_partkey") % 40).cast("string")).alias("id"), F.col("p_name").alias("name"), F.col("p_partkey").alias("ord"))
    return releases.artist_albums(rows).select("artist", F.size("albums").cast("long").alias("albums"), "truncated")


def release_exists(spark, d):
    p = _part(spark, d)
    hit = F.when(F.col("p_partkey") % 4 == 0, F.lower("p_type")).otherwise(F.col("p_name"))
    found = p.filter("p_partkey % 2 = 0").select(F.col("p_brand").alias("artist"), F.col("p_type").alias("title"), hit.alias("hit_title"), F.col("p_partkey").alias("ord"))
    return releases.existence(found, p.select(F.col("p_brand").alias("artist"), F.col("p_type").alias("title"))).select("artist", "title", "exists")


def cache_freshness(spark, d):
    third = F.col("o_orderkey") % 3
    body = F.when(third == 0, '{"groups": []}').when(third == 1, '{"found": false}').otherwise('{"groups": [1]}')
    rows = spark.read.parquet(f"{d}/orders.parquet").select(F.concat(F.lit("mb:"), F.col("o_custkey") % 500).alias("k"), body.alias("v"), F.expr(source._epoch("o_orderdate")).alias("created"))
    return cache.fresh_client(rows, 900_000_000)


def edit_distance_pairs(spark, d):
    return edit_pairs(_part(spark, d), "p_name")


def profile(spark, d):
    return report.profile(source.lineitem_plays(spark, d))


def _sql_issues(spark, d):
    """Findings of the detectors that SQL can express whole, in the columns the score needs."""
    plays = source.lineitem_plays(spark, d)
    cells = _cells(spark, d)
    rest = cells.filter("NOT is_era")
    cols = ["user", "detector", "class", "plays_affected", "style_choice"]
    d4 = albums.decide_splits(rest, ratio=False).select("user", F.lit("D4").alias("detector"), "class", F.col("total").alias("plays_affected"), F.lit(None).cast("boolean").alias("style_choice"))
    rows = d4.unionByName(albums.missing_albums(rest, plays.filter("album = ''")).select(*cols)).unionByName(albums.various_artists(rest).select(*cols))
    return cells, rows.unionByName(timing.impossible(plays, 1 << 40, 20).select(*cols))


def summary_by_detector(spark, d):
    return report.summary_by_detector(_sql_issues(spark, d)[1])


def bucket_scores(spark, d):
    cells, rows = _sql_issues(spark, d)
    totals = report.score_totals(cells).select("user", "total_plays", "album_strings")
    return chart.bucket_scores(rows, totals).drop("weight")


def _pages(spark, d):
    """Event plays as the service would page them, 200 a page, with a page more to come."""
    from pyspark.sql import Window

    # places are counted within blocks of seq, and blocks before it are added: no user's log is one window
    plays = source.event_plays(spark, d).withColumn("block", F.floor(F.col("seq") / 10_000))
    blocks = plays.groupBy("user", "block").agg(F.count("*").alias("held"))
    before = F.sum("held").over(Window.partitionBy("user").orderBy("block")) - F.col("held")
    rows = plays.withColumn("at", F.row_number().over(Window.partitionBy("user", "block").orderBy("seq"))).join(blocks.select("user", "block", before.alias("before")), ["user", "block"])
    rows = rows.withColumn("n", F.col("before") + F.col("at") - 1).withColumn("page", F.floor(F.col("n") / 200) + 1)
    track = F.struct(
        F.col("track").alias("name"), F.lit("").alias("mbid"), F.struct(F.concat(F.lit(" "), F.col("artist")).alias("#text")).alias("artist"), F.struct(F.lit("").alias("#text")).alias("album"),
        F.struct(F.col("uts").cast("string").alias("uts")).alias("date"),
    )
    listed = rows.groupBy("user", "page").agg(F.array_sort(F.collect_list(F.struct("n", track.alias("t")))).alias("ts"))
    total = blocks.groupBy("user").agg(F.ceil(F.sum("held") / 200).alias("pages"), F.sum("held").alias("total"))
    attr = F.struct(F.col("total").cast("string").alias("total"), (F.col("pages") + 1).cast("string").alias("totalPages"))
    body = F.to_json(F.struct(F.struct(attr.alias("@attr"), F.transform("ts", lambda x: x["t"]).alias("track")).alias("recenttracks")))
    return listed.join(total, "user").select("user", "page", F.lit(1).cast("long").alias("fetched_at"), body.alias("body"))


def landed_pages(spark, d):
    return source.flatten_pages(_pages(spark, d)).select("user", "uts", "artist", "album", "track")


def resume_points(spark, d):
    return source.resume_points(_pages(spark, d)).select("user", "fetched", "total_pages", "next_page", "anchor")


# Beyond SQL: the ratio of similarity, folds, and findings with their prose.


def _lookup(spark, d):
    """Release answers for a part of the brands' tracks."""
    p = _part(spark, d).filter("p_partkey % 3 <> 0")
    group = F.struct(
        F.concat(F.lit("rg-"), F.col("p_partkey")).alias("rg_id"), F.concat("p_type", F.lit(" Album")).alias("title"), F.when(F.col("p_size") % 4 == 0, "Single").otherwise("Album").alias("primary"),
        F.when(F.col("p_size") % 9 == 0, F.array(F.lit("Compilation"))).otherwise(F.array().cast("array<string>")).alias("secondary"), (1960 + F.col("p_size")).cast("string").alias("first_release"),
        F.lit("Official").alias("status"), F.concat(F.lit("rec-"), F.col("p_size")).alias("recording_id"), F.when(F.col("p_size") % 2 == 0, "spotify").otherwise("musicbrainz").alias("source"),
    )
    rows = p.groupBy(F.col("p_brand").alias("artist"), F.col("p_name").alias("track")).agg(F.array_sort(F.collect_list(F.struct(F.col("p_partkey").alias("i"), group.alias("g")))).alias("gs"))
    return rows.select("artist", "track", F.transform("gs", lambda x: x["g"]).alias("groups"))


def d4_splits(spark, d):
    return albums.album_splits(_rest(spark, d))


def d1_variants(spark, d):
    return artists.artist_variants(_rest(spark, d))


def d8_features(spark, d):
    return artists.feature_credits(_rest(spark, d))


def d14a_variants(spark, d):
    return unreleased.format_variants(_era(spark, d))


def d0_targets(spark, d):
    return resolve.split_targets(albums.album_splits(_rest(spark, d)), _lookup(spark, d))


def d5_resolved(spark, d):
    return resolve.missing_targets(albums.blank_tracks(_rest(spark, d)), _lookup(spark, d))


def d14e_released(spark, d):
    return resolve.released_since(_era(spark, d), _lookup(spark, d))


def d16_stranded(spark, d):
    rest = _rest(spark, d)
    lastfm = _part(spark, d).filter("p_partkey % 5 = 0").groupBy(F.col("p_brand").alias("artist"), F.col("p_name").alias("track")).agg(F.concat(F.min("p_type"), F.lit(" Album")).alias("title"))
    return resolve.stranded_singles(resolve.single_candidates(rest), _lookup(spark, d), rest.select("user", "album_key").distinct(), lastfm)


def _era_answers(found):
    return resolve.verification_plan(found).select("artist", "title", F.when(F.length("title") % 3 > 0, F.length("title") % 2 == 0).alias("exists"))


def era_verified(spark, d):
    found = unreleased.format_variants(_era(spark, d))
    return resolve.verify_era_names(found, _era_answers(found))


def chart_impact(spark, d):
    rest = _rest(spark, d)
    return chart.chart_impact(rest, albums.album_splits(rest))


def chart_movers(spark, d):
    rest = _rest(spark, d)
    return chart.chart_movers(rest, albums.album_splits(rest))


def _report(spark, d):
    return report.analyse(source.lineitem_plays(spark, d), NOW, top_albums=source.top_albums(spark, d))


def analyse_issues(spark, d):
    return _report(spark, d).issues


def hygiene_score(spark, d):
    return _report(spark, d).hygiene


def _artist_answers(spark, d):
    return _part(spark, d).select(F.concat("p_brand", F.lit(" & Brand#1")).alias("artist"), (F.substring("p_brand", 7, 1) == "2").alias("exists")).distinct()


def resolved_issues(spark, d):
    rest = _rest(spark, d)
    found = albums.album_splits(rest).unionByName(artists.feature_credits(rest)).unionByName(albums.missing_albums(rest, source.lineitem_plays(spark, d).filter("album = ''")))
    return resolve.resolve(kept(found, "findings"), _lookup(spark, d), _artist_answers(spark, d))


QUERIES = {
    "norm_title": _text_key(keys.norm_title), "norm_loose": _text_key(keys.norm), "norm_release": _text_key(keys.norm_release), "track_identity": _text_key(keys.track_identity),
    "weak_candidates": lambda spark, d: weak_era_candidates(_cells(spark, d)),
} | {f.__name__: f for f in (
    base_title, era_flags, era_partition, era_overview, d4_groups, d4_members, d4_decision, mbid_verdicts, d5_missing, d5_months, d6_dupes, d6_systemic, d7_casing, d8_titles, d8_joint, d8_field,
    d1_exact, d11_various, d12_bursts, d12_future, d14a_formats, d14c_multi_era, d14f_buckets, d15_album_artist, d16_candidates, album_chart, chart_rank, top_albums_per_artist, resolution_plan, by_artist,
    strategy_split, plan_estimates, match_tiers, match_tracks, recording_groups, album_groups, artist_albums, release_exists, cache_freshness, edit_distance_pairs, profile, summary_by_detector, bucket_scores,
    landed_pages, resume_points, d4_splits, d1_variants, d8_features, d14a_variants, d0_targets, d5_resolved, d14e_released, d16_stranded, era_verified, chart_impact, chart_movers,
    analyse_issues, hygiene_score, resolved_issues,
)}
