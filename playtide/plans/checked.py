"""Whole operators in narrow columns, with the SQL that says the same: ratios, verdicts, sources, ranking, score, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from playtide.functions import keys
from playtide.operators import albums, artists, chart, resolve, timing, unreleased
from playtide.operators.cells import cells_of, partition_eras
from playtide.plans import oracles as sql
from playtide.plans import queries as q
from playtide.plans import report
from playtide.sources import cache, paged, releases, state
from playtide.sources import plays as source
from playtide.sources.answers import AnswerCache
from playtide.sources.scratch import scratch
from playtide.streaming import ingest

UNTIL = 1_704_240_000


# Similarity: names that share their first word, artists that share a title, eras of one artist.


def similarity_ratio(spark, d):
    names = q._part(spark, d).select("p_name", F.substring_index("p_name", " ", 1).alias("head")).distinct()
    a, b = names.select("head", F.col("p_name").alias("a")), names.select("head", F.col("p_name").alias("b"))
    return a.join(b, "head").filter("a < b").select("a", "b", keys.similar("a", "b").alias("ratio"))


def d1_fuzzy(spark, d):
    rows = artists.fuzzy_pairs(q._rest(spark, d))
    return rows.select("user", F.col("a_artist").alias("a"), F.col("b_artist").alias("b"), "shared", "ratio", "by_ratio", "by_edit")


def d4_decided(spark, d):
    rows = albums.decide_splits(q._rest(spark, d))
    return rows.select("user", "artist", "track", F.col("total").alias("plays_affected"), "verdict", "reason", "class", "confidence")


def d14a_typos(spark, d):
    rows = unreleased.era_name_pairs(q._era(spark, d))
    return rows.select("user", "artist", F.col("lo_era_name").alias("rare"), "lo_plays", F.col("hi_era_name").alias("usual"), "hi_plays")


# Official releases, and sources.


def official_partition(spark, d):
    """Weak tags that name a release known to exist are titles."""
    known = q._part(spark, d).filter("p_partkey % 3 = 0").select(keys.norm("p_brand").alias("artist_key"), keys.norm(F.concat("p_type", F.lit(" Sessions"))).alias("album_key"))
    cells = partition_eras(cells_of(source.lineitem_plays(spark, d)), known)
    return cells.groupBy("user", "artist", "album", "is_era").agg(F.sum("plays").alias("plays"))


def plays_until(spark, d):
    return source.flatten_pages(q._pages(spark, d), UNTIL).select("user", "uts", "artist", "album", "track")


def album_exists(spark, d):
    """Existence by a source that has to match the artist too."""
    p = q._part(spark, d)
    hit = F.when(F.col("p_partkey") % 4 == 0, F.lower("p_type")).otherwise(F.col("p_name"))
    names = F.when(F.col("p_partkey") % 8 == 0, F.array(F.lit("Someone"), F.upper("p_brand"))).otherwise(F.array(F.lit("Someone")))
    found = p.select(F.col("p_brand").alias("artist"), F.col("p_type").alias("title"), hit.alias("hit_title"), names.alias("hit_artists"), F.col("p_partkey").cast("long").alias("ord"))
    return releases.existence(found, p.select(F.col("p_brand").alias("artist"), F.col("p_type").alias("title"))).select("artist", "title", "exists")


def artist_ids(spark, d):
    hit = F.when(F.col("p_partkey") % 3 == 0, F.upper("p_brand")).otherwise(F.concat("p_brand", F.lit(" Band")))
    rows = q._part(spark, d).select(F.col("p_brand").alias("artist"), hit.alias("hit_name"), F.concat(F.lit("id-"), F.col("p_partkey")).alias("id"), F.col("p_partkey").alias("ord"))
    return releases.artist_ids(rows)


def catalogue_pages(spark, d):
    group = F.when(F.col("p_size") % 4 != 0, F.struct(F.concat(F.lit("g"), F.col("p_size")).alias("id"), F.col("p_type").alias("title"), F.lit("Album").alias("primary"), F.lit(None).cast("array<string>").alias("secondary"), F.lit("2000").alias("first_release")))
    track = F.struct(F.when(F.col("p_size") % 2 == 0, F.col("p_name")).alias("title"), F.when(F.col("p_size") % 3 == 0, "rec").alias("recording_title"))
    rows = q._part(spark, d).select(
        F.col("p_brand").alias("artist"), F.col("p_partkey").alias("ord"), F.concat(F.lit("r"), F.col("p_partkey")).alias("id"), F.col("p_name").alias("title"), F.lit("2001").alias("date"),
        F.when(F.col("p_size") % 5 == 0, "Bootleg").alias("status"), group.alias("rg"), F.array(F.struct(F.array(track).alias("tracks"))).alias("media"),
    )
    return releases.catalogue_page(rows).select("artist", "ord", "rg_id", "title", "first_release", "status", F.array_join("tracks", "|").alias("tracks"))


def next_offsets(spark, d):
    rows = q._part(spark, d).groupBy(F.col("p_brand").alias("artist")).agg(F.count("*").alias("total"), F.max("p_size").cast("long").alias("returned"))
    pages = rows.select("artist", F.explode(F.array(F.lit(0).cast("long"), F.lit(25).cast("long"))).alias("offset"), "returned", "total")
    return releases.next_offsets(pages)


def track_releases(spark, d):
    hit, names = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.concat("p_name", F.lit("x"))), F.array(F.lit("Guest"), F.lower("p_brand"))
    rows = q._part(spark, d).select(
        F.col("p_brand").alias("artist"), F.col("p_name").alias("track"), hit.alias("hit_track"), names.alias("hit_artists"), (F.col("p_partkey") % 50).cast("string").alias("id"), F.col("p_type").alias("name"),
        F.when(F.col("p_size") % 3 == 0, "single").otherwise("album").alias("album_type"), (F.col("p_size") % 9).alias("total_tracks"), (1970 + F.col("p_size")).cast("string").alias("release_date"), F.col("p_partkey").cast("long").alias("ord"),
    )
    return releases.track_releases(rows).select("artist", "track", "rg_id", "title", F.col("primary").alias("primary_type"), "first_release")


def track_answers(spark, d):
    """Lookups with what they named; calls that failed are errors and no answers."""
    p = q._part(spark, d)
    asked = p.select(F.col("p_brand").alias("artist"), F.col("p_name").alias("track"))
    answers = p.filter("p_size % 4 <> 0").groupBy(F.col("p_brand").alias("artist"), F.col("p_name").alias("track")).agg((F.min("p_size") % 2 == 0).alias("shared"))
    named = track_releases(spark, d).withColumn("ord", F.col("first_release").cast("long"))
    extra = [F.lit(None).cast("array<string>").alias("secondary"), F.lit("Official").alias("status"), F.lit("spotify").alias("source")]
    rows = state.track_answers(asked, answers, named.select("artist", "track", "ord", "rg_id", "title", F.col("primary_type").alias("primary"), "first_release", *extra))
    return rows.select("artist", "track", "error", "shared", "tier", F.size("groups").cast("long").alias("groups"))


def tracklists(spark, d):
    one = lambda t: F.struct(t.alias("title"), F.array(F.col("p_brand")).alias("artists"), F.when(F.col("p_size") % 2 == 0, 2).alias("disc"), F.lit(1).alias("n"))
    rows = q._part(spark, d).select(F.col("p_partkey").cast("string").alias("id"), (F.col("p_size") % 4).alias("total_tracks"), F.array(one(F.col("p_name")), one(F.col("p_type"))).alias("tracks"))
    return releases.tracklists(rows).select("id", "title", "disc", "partial")


def shared_cache(spark, d):
    """What of the wanted keys is asked for once fresh answers, negatives too, have served theirs."""
    rows = spark.read.parquet(f"{d}/orders.parquet").select(F.concat(F.lit("mb:"), F.col("o_custkey") % 500).alias("k"), F.concat(F.lit('{"groups": ['), F.col("o_orderkey"), F.lit("]}")).alias("v"), F.expr(source._epoch("o_orderdate")).alias("created"))
    fresh = cache.fresh_shared(rows, 900_000_000)
    wanted = spark.range(600).select(F.concat(F.lit("mb:"), F.col("id")).alias("k"))
    return fresh.select("k", F.lit("served").alias("how")).unionByName(cache.misses(wanted, fresh).select("k", F.lit("asked").alias("how")))


def cache_usage(spark, d):
    body = F.when(F.col("o_orderkey") % 3 == 0, '{"exists": false}').otherwise('{"exists": true}')
    rows = spark.read.parquet(f"{d}/orders.parquet").select(F.concat_ws(":", F.substring("o_orderpriority", 1, 1), "o_orderkey").alias("k"), body.alias("v"))
    return cache.usage(rows)


# Lookups: recordings, targets, releases since.


def _sides(spark, d):
    """Two lookups' groups by track: recording IDs of parts of one name, of odd and even numbers."""
    group = F.struct(F.when(F.col("p_partkey") % 7 != 0, F.concat(F.lit("rec-"), F.col("p_size") % 6)).alias("recording_id"))
    side = lambda k: F.collect_list(F.when(F.col("p_partkey") % 2 == k, group))
    return q._part(spark, d).groupBy("p_brand", F.substring_index("p_name", " ", 1).alias("head")).agg(side(0).alias("a"), side(1).alias("b"), F.sum("p_size").cast("long").alias("n"))


def same_recordings(spark, d):
    return _sides(spark, d).select("p_brand", "head", resolve.same_recording(F.col("a"), F.col("b")).alias("verdict"))


def recording_verdicts(spark, d):
    """Title findings after the verdict of their two recordings."""
    rows = _sides(spark, d).select(
        "p_brand", "head", F.lit("split").alias("class"), F.lit(0.8).alias("confidence"), F.lit("s").alias("suggest"), F.lit(None).cast("string").alias("evidence"), F.lit(None).cast("boolean").alias("resolved"),
        resolve.same_recording(F.col("a"), F.col("b")).alias("recording_verdict"),
    )
    return resolve.apply_recording_verdict(rows).drop("suggest")


def d5_targets(spark, d):
    return resolve.missing_targets(albums.blank_tracks(q._rest(spark, d)), q._lookup(spark, d))


def d0_aimed(spark, d):
    rows = resolve.split_targets(albums.album_splits(q._rest(spark, d)), q._lookup(spark, d))
    return rows.select("user", "artist", "track", "class", "confidence", "plays_affected", F.col("external.title").alias("target"))


def d14e_since(spark, d):
    rows = resolve.released_since(q._era(spark, d), q._lookup(spark, d))
    return rows.select("user", "artist", "track", "plays_affected", "confidence", F.col("external.title").alias("release"))


def era_checked(spark, d):
    """Probable typos of era names once both names have been looked up."""
    found = unreleased.format_variants(q._era(spark, d)).filter("verify IS NOT NULL")
    rows = resolve.verify_era_names(found, q._era_answers(found))
    return rows.select("user", "artist", "class", "confidence", "plays_affected")


def joint_checked(spark, d):
    """Joint credits once their names have been looked up: real ones go, unreal ones gain confidence."""
    found = artists.feature_credits(q._rest(spark, d)).filter("verify_artist IS NOT NULL")
    rows = resolve.verify_joint_credits(found, q._artist_answers(spark, d))
    return rows.select("user", "artist", "confidence", "plays_affected", "evidence")


def chart_tops(spark, d):
    """Both top lists of chart_impact(), a row a place, and whether the first place changes."""
    rest = q._rest(spark, d)
    rows = chart.chart_impact(rest, albums.album_splits(rest))
    lists = F.array(*[F.struct(F.lit(name).alias("chart"), F.col(f"{name}_top").alias("top")) for name in ("reported", "corrected")])
    rows = rows.select("user", "number_one_changes", F.explode(lists).alias("l")).select("user", "number_one_changes", "l.chart", F.explode("l.top").alias("t"))
    return rows.select("user", "number_one_changes", "chart", "t.rank", "t.album", "t.plays")


# The report: every detector's findings in the columns that rank and score them.


def _findings(spark, d):
    return q._report(spark, d)


def ranked_issues(spark, d):
    """Findings that rank alike but for the order they were emitted in: the places they take, how many, and what they are."""
    rows = _findings(spark, d).issues
    order = report.importance()[:4]
    place = F.dense_rank().over(Window.partitionBy("user").orderBy(*order))
    kept = F.row_number().over(Window.partitionBy("user").orderBy("place"))
    rows = rows.withColumn("group", place).withColumn("n", kept)
    held = rows.groupBy("user", "group").agg(F.min("n").alias("first"), F.max("n").alias("last"), F.count("*").alias("issues"), F.min("detector").alias("detector"), F.min("class").alias("class"), F.min("plays_affected").alias("plays_affected"))
    return held.drop("group")


def issue_summary(spark, d):
    return _findings(spark, d).summary_by_detector


def hygiene(spark, d):
    h = _findings(spark, d).hygiene
    flat = [F.col("subscores")[b].alias(b) for b in chart.BUCKETS] + [F.col("weight_share")[b].alias(f"weight_{b}") for b in chart.BUCKETS]
    return h.select("user", "score", "actionable", *flat)


# Stores: pages walked through the data source, a cache over rounds, a report whose parts appear together.


def walked_pages(spark, d):
    """Plays of a walk that broke off after two pages a user and went on from its checkpoint."""
    landing, store = scratch(spark, "pages"), scratch(spark, "walk")
    pages = q._pages(spark, d)
    for part in (pages.filter("page <= 2"), pages.filter("page > 2")):
        part.write.partitionBy("user", "page").mode("append").json(landing)
        paged.walk(spark, store, f"{store}-state", path=landing).awaitTermination()
    return source.flatten_pages(paged.walked(spark, store)).select("user", "uts", "artist", "album", "track")


def read_pages(spark, d):
    """The same pages in one batch, ten pages a task."""
    landing = scratch(spark, "pages")
    q._pages(spark, d).write.partitionBy("user", "page").json(landing)
    paged.register(spark)
    pages = spark.read.format("play_pages").options(path=landing, pages_per_partition=10).load()
    return source.flatten_pages(paged.unbroken(pages)).select("user", "uts", "artist", "album", "track")


def cache_rounds(spark, d):
    """Three rounds of answers, with a compaction after the second: what each key has then, and what is served of it."""
    cached = AnswerCache(spark, scratch(spark, "answers"), buckets=8)
    key = F.concat(F.lit("mb:"), F.col("o_custkey") % 700)
    body = F.when(F.col("o_orderkey") % 4 == 0, '{"found": false}').when(F.col("o_orderkey") % 5 > 0, F.concat(F.lit('{"groups": ['), F.col("o_orderkey"), F.lit("]}")))
    orders = spark.read.parquet(f"{d}/orders.parquet").select(key.alias("k"), body.alias("v"), F.expr(source._epoch("o_orderdate")).alias("created"), (F.col("o_orderkey") % 3).alias("round"))
    for n in range(3):
        cached.add(orders.filter(F.col("round") == n))
        if n == 1:
            cached.compact()
    wanted = spark.range(800).select(F.concat(F.lit("mb:"), F.col("id")).alias("k"))
    served = cached.lookup(wanted, 900_000_000).select("k", F.col("v").isNotNull().alias("served"))
    return cached.rows().join(served, "k", "full_outer")


def published_profile(spark, d):
    """A report's profile and overview, read back after a later one has failed to be written."""
    path = scratch(spark, "report")
    cells = q._cells(spark, d)
    report.publish({"profile": report.profile(source.lineitem_plays(spark, d)), "era": unreleased.overview(cells)}, path)
    try:
        report.publish({"profile": spark.range(1), "era": spark.range(1).select(F.raise_error(F.lit("no room")).alias("x"))}, path)
    except Exception as e:
        if "no room" not in str(e):
            raise
    return report.published(spark, path, "profile").join(report.published(spark, path, "era").select("user", F.col("distinct_eras").alias("eras")), "user")


# Streams, each run to the end of what has landed.


def ingested_plays(spark, d):
    """Landed pages through the streaming ingest; half of them are landed again, later."""
    landing, store = scratch(spark, "landing"), scratch(spark, "store")
    pages = q._pages(spark, d)
    pages.write.json(landing)
    ingest.ingest_pages(spark, landing, store, f"{store}-state").awaitTermination()
    pages.filter("page % 2 = 0").withColumn("fetched_at", F.lit(2).cast("long")).write.mode("append").json(landing)
    ingest.ingest_pages(spark, landing, store, f"{store}-state").awaitTermination()
    return ingest.latest_plays(spark, store).select("user", "uts", "artist", "album", "track")


def _arrivals(rows: DataFrame, parts: int = 4) -> tuple[list[DataFrame], int]:
    """Plays in the order they might arrive, a third of each stretch of time one stretch late, then one play of years after; and two stretches in seconds."""
    first, last = rows.agg(F.min("uts"), F.max("uts")).first()
    if first is None:
        return [rows], 1
    stretch = (last - first) // parts + 1
    turn = F.floor((F.col("uts") - first) / stretch) + (F.col("seq") % 3 == 0).cast("int")
    closing = rows.limit(1).withColumns({"user": F.lit(""), "uts": F.lit(last + 10 * 365 * 86_400).cast("long")}).select(*rows.columns)
    return [*[rows.filter(turn == k) for k in range(parts + 1)], closing], 2 * stretch


def _streamed(spark, arrivals: list[DataFrame], query, start) -> str:
    """Runs the query once for each arrival, from the checkpoint of the run before.  Returns where start(found, out) has written."""
    path, out = scratch(spark, "arrivals"), scratch(spark, "found")
    for rows in arrivals:
        rows.write.mode("append").parquet(path)
        with ingest.rocks(spark):
            running = start(query(spark.readStream.schema(rows.schema).parquet(path)), out)
        running.awaitTermination()
    return out


def _append(found: DataFrame, out: str):
    write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}")
    return found.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()


def streamed_hours(spark, d):
    """Bursts as the watermark closes their hours."""
    arrivals, late = _arrivals(source.event_plays(spark, d))
    out = _streamed(spark, arrivals, lambda s: ingest.hourly_bursts(s, 3, f"{late} seconds"), _append)
    return spark.read.schema("user string, hour timestamp, plays long").parquet(out).select("user", F.date_format("hour", "yyyy-MM-dd HH:00").alias("hour"), "plays")


def streamed_repeats(spark, d):
    """Repeats by event time, plays late and the query restarted between arrivals."""
    arrivals, late = _arrivals(source.event_plays(spark, d))
    out = _streamed(spark, arrivals, lambda s: ingest.adjacent_repeats(s, late=f"{late} seconds"), _append)
    return spark.read.schema("user string, uts long, artist string, track string, previous_uts long").parquet(out).drop("batch")


def counted_hours(spark, d):
    """Bursts from a store of counts, in which late plays count."""
    arrivals, _ = _arrivals(source.event_plays(spark, d))
    out = _streamed(spark, arrivals[:-1], lambda s: s, lambda s, out: ingest.count_hours(s, out, f"{out}-state"))
    return ingest.counted_bursts(spark, out, 3)


QUERIES = {f.__name__: f for f in (
    similarity_ratio, d1_fuzzy, d4_decided, d14a_typos, official_partition, plays_until, album_exists, artist_ids, catalogue_pages, next_offsets, track_releases, track_answers, tracklists, shared_cache, cache_usage,
    same_recordings, recording_verdicts, d5_targets, d0_aimed, d14e_since, era_checked, joint_checked, chart_tops, ranked_issues, issue_summary, hygiene, ingested_plays, streamed_hours, streamed_repeats, counted_hours, walked_pages, read_pages, cache_rounds, published_profile,
)}


# The SQL.

#: Longest common run of a and b, the first in a on ties; strpos() then gives the first in b.
_RUN = "flatten([[{'l': l, 'i': i} for i in range(1, length(a) - l + 2) if contains(b, substr(a, i, l))] for l in range(least(length(a), length(b)), 0, -1)])[1]"


def ratios(pairs: str) -> str:
    """CTEs ending in ratio(x, y, ratio) for the pairs (a, b) of a SELECT: matching runs, then those on both sides of each."""
    return f"""wanted AS ({pairs}),
seg AS (SELECT a AS x, b AS y, a, b, {_RUN} AS m FROM wanted
  UNION ALL SELECT x, y, a, b, {_RUN} FROM (SELECT x, y, unnest([substr(a, 1, m.i - 1), substr(a, m.i + m.l)]) AS a, unnest([substr(b, 1, strpos(b, substr(a, m.i, m.l)) - 1), substr(b, strpos(b, substr(a, m.i, m.l)) + m.l)]) AS b
    FROM seg WHERE m IS NOT NULL) WHERE a <> '' AND b <> ''),
runs AS (SELECT x, y, sum(m.l) AS common FROM seg GROUP BY x, y),
ratio AS (SELECT x, y, CASE WHEN x = '' AND y = '' THEN 1.0 ELSE CAST(2 * coalesce(common, 0) AS DOUBLE) / (length(x) + length(y)) END AS ratio FROM runs)"""


def _recursive(text: str) -> str:
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


_BEFORE, _AFTER = sql.norm("earlier"), sql.norm("later")
SPLITS = _recursive(sql.SPLITS).replace("d2 AS (", ratios(f"SELECT DISTINCT {_BEFORE} AS a, {_AFTER} AS b FROM d1 WHERE apart") + ",\nd2 AS (")
SPLITS = SPLITS.replace(") AS migration FROM d1)", f" OR EXISTS (SELECT 1 FROM ratio WHERE x = {_BEFORE} AND y = {_AFTER} AND ratio >= 0.6)) AS migration FROM d1)")

_FUZZY = """, names AS (SELECT "user", artist, any_value(artist_key) AS artist_key, regexp_replace(any_value(artist_key), '^the ', '') AS fold, CAST(sum(plays) AS BIGINT) AS plays, min(seq) AS seq FROM rest GROUP BY "user", artist),
ordered AS (SELECT *, min(seq) OVER (PARTITION BY "user", fold) AS fold_seq FROM names),
titled AS (SELECT DISTINCT o.*, track_title FROM ordered o JOIN rest r ON r."user" = o."user" AND r.artist = o.artist),
near AS (SELECT a."user", a.artist AS a_artist, b.artist AS b_artist, any_value(a.fold) AS a_fold, any_value(b.fold) AS b_fold, any_value(a.artist_key) AS a_key, any_value(b.artist_key) AS b_key,
  any_value(a.plays) AS a_plays, any_value(b.plays) AS b_plays, count(*) AS shared FROM titled a JOIN titled b ON a."user" = b."user" AND a.track_title = b.track_title AND a.fold_seq < b.fold_seq
  WHERE abs(length(a.fold) - length(b.fold)) <= 3 AND least(a.plays, b.plays) <= 0.4 * greatest(a.plays, b.plays) GROUP BY a."user", a.artist, b.artist),
open AS (SELECT * FROM near WHERE NOT (a_key <> b_key AND regexp_replace(a_key, '[0-9]+', '#', 'g') = regexp_replace(b_key, '[0-9]+', '#', 'g') AND regexp_extract_all(a_key, '[0-9]+') <> regexp_extract_all(b_key, '[0-9]+'))),
""" + ratios("SELECT DISTINCT a_fold AS a, b_fold AS b FROM open") + """,
fuzzy AS (SELECT o.*, ratio, ratio >= 0.9 AS by_ratio, levenshtein(a_fold, b_fold) <= greatest(1, floor(greatest(length(a_fold), length(b_fold)) / 10)) AS by_edit FROM open o JOIN ratio ON x = a_fold AND y = b_fold)
"""  # fmt: skip

_TYPOS = """, eras AS (SELECT "user", artist, era_name, """ + sql.norm("era_name") + """ AS era_key, CAST(sum(plays) AS BIGINT) AS plays, min(seq) AS seq FROM era WHERE era_name IS NOT NULL GROUP BY "user", artist, era_name),
met AS (SELECT a."user", a.artist, a.era_name AS a_name, b.era_name AS b_name, a.era_key AS a_key, b.era_key AS b_key, a.plays AS a_plays, b.plays AS b_plays FROM eras a JOIN eras b ON a."user" = b."user" AND a.artist = b.artist
  WHERE a.seq < b.seq AND a.era_key <> b.era_key AND least(a.plays, b.plays) <= greatest(2.0, 0.25 * greatest(a.plays, b.plays))),
""" + ratios("SELECT DISTINCT a_key AS a, b_key AS b FROM met") + """,
typos AS (SELECT "user", artist, CASE WHEN a_plays <= b_plays THEN a_name ELSE b_name END AS rare, least(a_plays, b_plays) AS lo_plays, CASE WHEN a_plays <= b_plays THEN b_name ELSE a_name END AS usual, greatest(a_plays, b_plays) AS hi_plays
  FROM met JOIN ratio ON x = a_key AND y = b_key WHERE ratio >= 0.82)
"""  # fmt: skip

_LOOKUP = """lookup AS (SELECT p_brand AS artist, p_name AS track, list({'title': p_type || ' Album', 'kind': CASE WHEN p_size % 4 = 0 THEN 'Single' ELSE 'Album' END, 'compilation': p_size % 9 = 0, 'date': CAST(1960 + p_size AS VARCHAR), 'stream': p_size % 2 = 0} ORDER BY p_partkey) AS groups
  FROM part WHERE p_partkey % 3 <> 0 GROUP BY ALL),
aim AS (SELECT artist, track, groups, coalesce(list_filter(groups, lambda g: g.kind = 'Album' AND NOT g.compilation)[1], groups[1]).title AS target FROM lookup)
"""

_SIDES = """WITH s AS (SELECT p_brand, split_part(p_name, ' ', 1) AS head, list(DISTINCT 'rec-' || (p_size % 6)) FILTER (WHERE p_partkey % 2 = 0 AND p_partkey % 7 <> 0) AS a, list(DISTINCT 'rec-' || (p_size % 6)) FILTER (WHERE p_partkey % 2 = 1 AND p_partkey % 7 <> 0) AS b FROM part GROUP BY ALL),
v AS (SELECT p_brand, head, CASE WHEN a IS NULL OR b IS NULL THEN 'unknown' WHEN list_has_any(a, b) THEN 'same' ELSE 'different' END AS verdict FROM s)
"""

_TRACKS = f"""WITH f AS (SELECT p_brand AS artist, p_name AS track, 'spotify:' || (p_partkey % 50) AS rg_id, p_type AS title, CASE WHEN p_size % 3 = 0 AND p_size % 9 BETWEEN 4 AND 8 THEN 'EP' WHEN p_size % 3 = 0 THEN 'Single' ELSE 'Album' END AS primary_type, CAST(1970 + p_size AS VARCHAR) AS first_release, p_partkey AS ord
  FROM part WHERE p_partkey % 2 = 0),
t AS (SELECT * EXCLUDE (n, ord) FROM (SELECT *, row_number() OVER (PARTITION BY artist, track, rg_id ORDER BY first_release, ord) AS n FROM f) WHERE n = 1)
"""

_NONE = "CAST(NULL AS BOOLEAN)"


def _detected() -> str:
    """Every finding of the report as (user, detector, class, confidence, plays_affected, style)."""
    s = sql.SQL
    of = lambda detector, kind, conf, plays, source, style="false": f"SELECT \"user\", '{detector}' AS detector, {kind} AS class, CAST({conf} AS DOUBLE) AS confidence, CAST({plays} AS BIGINT) AS plays_affected, {style} AS style FROM ({source})"
    total = lambda text, value: f'SELECT "user", sum({value}) AS n FROM ({text}) GROUP BY "user"'
    keyed = f"SELECT * REPLACE ({sql.norm('artist')} AS artist, {sql.norm_title('track')} AS track) FROM ({source.PLAYS_SQL})"
    day = sql.DUPES.replace(sql.EVENTS, f"WITH plays AS ({keyed})\n")
    month = sql.MONTH
    systemic = day + f""", t AS (SELECT "user", {month} AS month, count(*) AS total FROM plays GROUP BY ALL), k AS (SELECT "user", {month} AS month, count(*) AS dupes FROM dupes GROUP BY ALL)
SELECT "user", sum(dupes) AS n FROM k JOIN t USING ("user", month) WHERE total >= 50 AND dupes / total > 0.25 GROUP BY "user\""""
    log = f"WITH plays AS ({source.PLAYS_SQL}) "
    buckets = s["d14f_buckets"].replace(">= 3)", ">= 8)")
    return "\nUNION ALL ".join((
        of("D14a", "'split'", "0.95", "plays_affected", s["d14a_formats"]),
        of("D14a", "'error'", "0.7", "lo_plays + hi_plays", SQL["d14a_typos"]),
        of("D14c", "'review'", "confidence", "plays_affected", s["d14c_multi_era"]),
        of("D14f", "'review'", "0.3", "plays", buckets, "true"),
        of("D4", "class", "confidence", "plays_affected", SQL["d4_decided"]),
        of("D8", "CASE kind WHEN 'conflict' THEN 'review' WHEN 'proven' THEN 'error' ELSE 'split' END", "CASE kind WHEN 'conflict' THEN 0.2 WHEN 'proven' THEN 0.97 WHEN 'stray' THEN 0.5 ELSE 0.8 END", "plays_affected", s["d8_titles"]),
        of("D8", "'review'", "CASE WHEN albums <= 1 THEN 0.6 ELSE 0.35 END", "plays", s["d8_joint"]),
        of("D8", "CASE kind WHEN 'strong' THEN 'error' ELSE 'review' END", "CASE kind WHEN 'strong' THEN 0.9 ELSE 0.4 END", "plays", s["d8_field"]),
        of("D1", "'split'", "0.95", "plays_affected", s["d1_exact"]),
        of("D1", "'split'", "CASE WHEN by_ratio THEN 0.75 ELSE 0.6 END", "n", _recursive(sql.CELLS) + _FUZZY + "SELECT \"user\", by_ratio, a_plays + b_plays AS n FROM fuzzy WHERE (by_ratio OR by_edit) AND lower(a_artist) <> lower(b_artist)"),
        of("D5", "'error'", "0.9", "n", total(s["d5_missing"], "plays")),
        of("D6", "'error'", "0.8", "n", day + 'SELECT "user", count(*) AS n FROM dupes GROUP BY "user"'),
        of("D6", "'anomaly'", "0.85", "n", systemic),
        of("D11", "'error'", "0.9", "n", total(s["d11_various"], "plays")),
        of("D12", "'anomaly'", "0.99", "n", log + f'SELECT "user", count(*) AS n FROM plays WHERE uts > {q.NOW} + 3600 GROUP BY "user"'),
        of("D12", "'anomaly'", "0.7", "n", total(log + sql.HOURS + "60", "plays")),
        of("D15", "CASE evidence WHEN 'release' THEN 'error' ELSE 'split' END", "confidence", "plays_affected", s["d15_album_artist"]),
    ))


SQL: dict[str, str] = {
    "similarity_ratio": "WITH RECURSIVE names AS (SELECT DISTINCT p_name, split_part(p_name, ' ', 1) AS head FROM part), " + ratios("SELECT m.p_name AS a, n.p_name AS b FROM names m JOIN names n ON m.head = n.head AND m.p_name < n.p_name") + " SELECT x AS a, y AS b, ratio FROM ratio",
    "d1_fuzzy": _recursive(sql.CELLS) + _FUZZY + 'SELECT "user", a_artist AS a, b_artist AS b, shared, ratio, by_ratio, by_edit FROM fuzzy WHERE by_ratio OR by_edit',
    "d4_decided": SPLITS + f'SELECT "user", artist, track, total AS plays_affected, verdict, reason, {sql.CLASS} AS class, {sql.CONFIDENCE} AS confidence FROM decided',
    "d14a_typos": _recursive(sql.CELLS) + _TYPOS + "SELECT * FROM typos",
    "official_partition": sql.CELLS + f""", known AS (SELECT DISTINCT {sql.norm('p_brand')} AS a, {sql.norm("p_type || ' Sessions'")} AS b FROM part WHERE p_partkey % 3 = 0)
SELECT "user", artist, album, era_explicit OR ((era_weak OR era_ambiguous) AND tk IS NOT NULL AND a IS NULL) AS is_era, CAST(sum(plays) AS BIGINT) AS plays FROM c2 LEFT JOIN taggers ON tu = "user" AND tk = artist_key LEFT JOIN known ON a = artist_key AND b = album_key GROUP BY ALL""",
    "plays_until": sql.EVENTS + f'SELECT "user", uts, artist, album, track FROM plays WHERE uts <= {UNTIL}',
    "album_exists": f"""SELECT p_brand AS artist, p_type AS title, bool_or({sql.norm_release("CASE WHEN p_partkey % 4 = 0 THEN lower(p_type) ELSE p_name END")} = {sql.norm_release('p_type')} AND p_partkey % 8 = 0) AS exists FROM part GROUP BY ALL""",
    "artist_ids": "SELECT p_brand AS artist, 'id-' || min(p_partkey) AS id FROM part WHERE p_partkey % 3 = 0 GROUP BY ALL",
    "catalogue_pages": """SELECT p_brand AS artist, p_partkey AS ord, CASE WHEN p_size % 4 <> 0 THEN 'mb:g' || p_size ELSE 'mbrel:r' || p_partkey END AS rg_id, CASE WHEN p_size % 4 <> 0 THEN p_type ELSE p_name END AS title, CASE WHEN p_size % 4 <> 0 THEN '2000' ELSE '2001' END AS first_release,
  CASE WHEN p_size % 5 = 0 THEN 'Bootleg' ELSE 'Official' END AS status, CASE WHEN p_size % 2 = 0 THEN p_name WHEN p_size % 3 = 0 THEN 'rec' ELSE '' END AS tracks FROM part""",
    "next_offsets": "SELECT p_brand AS artist, CASE WHEN 25 + max(p_size) < count(*) THEN CAST(25 + max(p_size) AS BIGINT) END AS next_offset FROM part GROUP BY ALL",
    "track_releases": _TRACKS + "SELECT artist, track, rg_id, title, primary_type, first_release FROM t",
    "track_answers": _TRACKS + """, asked AS (SELECT DISTINCT p_brand AS artist, p_name AS track FROM part), back AS (SELECT p_brand AS artist, p_name AS track, min(p_size) % 2 = 0 AS shared FROM part WHERE p_size % 4 <> 0 GROUP BY ALL),
n AS (SELECT artist, track, count(*) AS n FROM t GROUP BY ALL)
SELECT artist, track, shared IS NULL AS error, shared, CASE WHEN shared IS NULL THEN NULL WHEN n > 0 THEN 'exact' ELSE 'none' END AS tier, CASE WHEN shared IS NULL THEN NULL ELSE coalesce(n, 0) END AS groups FROM asked LEFT JOIN back USING (artist, track) LEFT JOIN n USING (artist, track)""",
    "tracklists": """SELECT CAST(p_partkey AS VARCHAR) AS id, unnest([p_name, p_type]) AS title, CASE WHEN p_size % 2 = 0 THEN 2 ELSE 1 END AS disc, p_size % 4 > 2 AS partial FROM part""",
    "shared_cache": """WITH f AS (SELECT 'mb:' || (o_custkey % 500) AS k, max(CAST(epoch(o_orderdate) AS BIGINT)) AS created FROM orders GROUP BY ALL HAVING max(CAST(epoch(o_orderdate) AS BIGINT)) > 900000000 - 30 * 86400)
SELECT k, 'served' AS how FROM f UNION ALL SELECT 'mb:' || i, 'asked' FROM range(600) r(i) WHERE NOT EXISTS (SELECT 1 FROM f WHERE k = 'mb:' || i)""",
    "cache_usage": """SELECT substr(o_orderpriority, 1, 1) AS kind, count(*) AS answers, CAST(sum(CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS negatives, CAST(sum(CASE WHEN o_orderkey % 3 = 0 THEN 17 ELSE 16 END) AS BIGINT) AS bytes FROM orders GROUP BY ALL""",
    "same_recordings": _SIDES + "SELECT * FROM v",
    "recording_verdicts": _SIDES + f"""SELECT p_brand, head, CASE verdict WHEN 'different' THEN 'review' ELSE 'split' END AS class, CAST(CASE verdict WHEN 'same' THEN 0.97 WHEN 'different' THEN 0.1 ELSE 0.8 END AS DOUBLE) AS confidence,
  CASE verdict WHEN 'same' THEN 'same MusicBrainz recording' WHEN 'different' THEN 'different recordings' END AS evidence, CASE verdict WHEN 'different' THEN true ELSE {_NONE} END AS resolved FROM v""",
    "d5_targets": sql.CELLS + ", " + _LOOKUP + """, b AS (SELECT "user", arg_min(artist, seq) AS artist, arg_min(track, seq) AS track, CAST(sum(plays) AS BIGINT) AS plays, min(seq) AS seq FROM rest WHERE album = '' GROUP BY "user", artist_key, track_id),
r AS (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY plays DESC, seq) AS place FROM b)
SELECT "user", place, r.artist, r.track, plays, target AS should_be FROM r LEFT JOIN aim ON aim.artist = r.artist AND aim.track = r.track WHERE place <= 30""",
    "d0_aimed": SPLITS + ", " + _LOOKUP + f"""SELECT "user", decided.artist, decided.track, {sql.CLASS} AS class, CAST(CASE WHEN reason NOT IN ('structural', 'disproven') AND apart THEN 0.9 ELSE 0.75 END AS DOUBLE) AS confidence, total AS plays_affected, target
FROM decided JOIN aim ON aim.artist = decided.artist AND aim.track = decided.track""",
    "d14e_since": sql.CELLS + ", " + _LOOKUP + f""", t AS (SELECT "user", artist, track, CAST(sum(plays) AS BIGINT) AS total, list(DISTINCT {sql.norm('era_name')}) FILTER (WHERE era_name IS NOT NULL) AS eras FROM era GROUP BY "user", artist, track),
g AS (SELECT t.*, unnest(groups) AS g, unnest(range(len(groups))) AS i FROM t JOIN lookup l ON l.artist = t.artist AND l.track = t.track),
ok AS (SELECT *, {sql.norm('g.title')} AS title_key FROM g),
w AS (SELECT "user", artist, track, any_value(total) AS total, arg_min(g, (NOT g.stream, i)) AS g FROM ok WHERE len([e for e in coalesce(eras, []) if e <> '' AND (contains(title_key, e) OR contains(e, title_key))]) = 0 GROUP BY "user", artist, track)
SELECT "user", artist, track, total AS plays_affected, CAST(CASE WHEN g.stream THEN 0.6 ELSE 0.35 END AS DOUBLE) AS confidence, g.title AS release FROM w""",
    "ingested_plays": sql.EVENTS + 'SELECT "user", uts, artist, album, track FROM plays',
    "streamed_hours": sql.EVENTS + """SELECT "user", strftime(make_timestamp(uts // 3600 * 3600000000), '%Y-%m-%d %H:00') AS hour, count(*) AS plays FROM plays GROUP BY ALL HAVING count(*) > 3""",
    "walked_pages": sql.EVENTS + 'SELECT "user", uts, artist, album, track FROM plays',
    "read_pages": sql.EVENTS + 'SELECT "user", uts, artist, album, track FROM plays',
    "cache_rounds": """WITH o AS (SELECT 'mb:' || (o_custkey % 700) AS k, CASE WHEN o_orderkey % 4 = 0 THEN '{"found": false}' WHEN o_orderkey % 5 > 0 THEN '{"groups": [' || o_orderkey || ']}' END AS v, CAST(epoch(o_orderdate) AS BIGINT) AS created FROM orders),
n AS (SELECT k, v, created FROM o WHERE v IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k ORDER BY created DESC, v DESC) = 1)
SELECT coalesce(n.k, w.k) AS k, v, created, CASE WHEN w.k IS NOT NULL THEN coalesce(v NOT LIKE '%false%' OR created >= 900000000 - 30 * 86400, false) END AS served FROM n FULL JOIN (SELECT 'mb:' || i AS k FROM range(800) r(i)) w ON w.k = n.k""",
    "counted_hours": sql.EVENTS + 'SELECT "user", uts // 3600 AS hour, CAST(count(*) AS BIGINT) AS plays FROM plays GROUP BY ALL HAVING count(*) > 3',
    "streamed_repeats": sql.DUPES + 'SELECT "user", uts, artist, track, previous_uts FROM dupes',
}
SQL["published_profile"] = f"""SELECT p.*, o.distinct_eras AS eras FROM ({sql.SQL['profile']}) p JOIN ({sql.SQL['era_overview']}) o ON o."user" = p."user\""""
_A, _B = (f"CASE WHEN length({n}) % 3 > 0 THEN length({n}) % 2 = 0 END" for n in ("rare", "usual"))
SQL["era_checked"] = _recursive(sql.CELLS) + _TYPOS + f""", v AS (SELECT *, {_A} AS a, {_B} AS b FROM typos)
SELECT "user", artist, CASE WHEN a AND NOT b THEN 'review' ELSE 'error' END AS class, CAST(CASE WHEN a IS NULL OR b IS NULL THEN 0.25 WHEN b THEN 0.85 WHEN a THEN 0.4 ELSE 0.3 END AS DOUBLE) AS confidence, CAST(lo_plays + hi_plays AS BIGINT) AS plays_affected
FROM v WHERE a IS NULL OR b IS NULL OR NOT (a AND b)"""
SQL["joint_checked"] = f"""WITH j AS ({sql.SQL['d8_joint']}), e AS (SELECT DISTINCT p_brand || ' & Brand#1' AS artist, substr(p_brand, 7, 1) = '2' AS real FROM part),
c AS (SELECT j.*, e.real, CASE WHEN albums <= 1 THEN 0.6 ELSE 0.35 END AS base FROM j LEFT JOIN e ON e.artist = j.artist)
SELECT "user", artist, CAST(CASE WHEN NOT real THEN least(0.75, base + 0.15) ELSE base END AS DOUBLE) AS confidence, CAST(plays AS BIGINT) AS plays_affected, CASE WHEN NOT real THEN 'no artist page under this name' END AS evidence FROM c WHERE real IS NULL OR NOT real"""

# Moves one after another: an artist's names and plays as a map, which each move of its queue changes.
_SETTLED = SPLITS + f""", mv0 AS (SELECT k."user", k.artist_key, k.track_id, k.artist, -k.total AS less, min(k.seq) OVER (PARTITION BY k."user", k.artist_key, k.track_id) AS turn, k.i AS place, k.shown AS album, k.plays AS most, k.kind,
  CASE WHEN d.reason NOT IN ('structural', 'disproven') AND d.apart THEN d.later ELSE '' END AS wanted FROM k JOIN decided d ON d."user" = k."user" AND d.artist_key = k.artist_key AND d.track_id = k.track_id),
mv1 AS (SELECT *, {sql.norm('album')} AS name, {sql.norm('wanted')} AS want FROM mv0),
mv2 AS (SELECT *, CASE WHEN wanted <> '' AND name = want THEN -1 WHEN wanted <> '' AND (contains(name, want) OR contains(want, name)) THEN 0 ELSE list_position({list(chart.SINKS)}, kind) END AS tier FROM mv1),
mv3 AS (SELECT *, first_value(album) OVER (PARTITION BY "user", artist_key, track_id ORDER BY tier, place) AS target FROM mv2),
queue AS (SELECT "user", artist, album, target, CAST(most AS BIGINT) AS most, turn, row_number() OVER (PARTITION BY "user", artist ORDER BY less, turn, place) AS n FROM mv3 WHERE album <> target),
charted AS (SELECT "user", artist, album, CAST(sum(plays) AS BIGINT) AS plays, min(seq) AS seq FROM rest WHERE album <> '' GROUP BY ALL),
walk AS (SELECT "user", artist, CAST(0 AS BIGINT) AS n, map(list(album), list({{'p': plays, 's': seq}})) AS held FROM charted GROUP BY ALL
  UNION ALL SELECT w."user", w.artist, w.n + 1, CASE WHEN coalesce(held[q.album].p, 0) = 0 THEN held ELSE map_concat(held, map([q.album, q.target],
    [{{'p': held[q.album].p - least(q.most, held[q.album].p), 's': held[q.album].s}}, {{'p': coalesce(held[q.target].p, 0) + least(q.most, held[q.album].p), 's': coalesce(held[q.target].s, 4611686018427387904 + q.turn)}}])) END
  FROM walk w JOIN queue q ON q."user" = w."user" AND q.artist = w.artist AND q.n = w.n + 1),
ended AS (SELECT "user", artist, unnest(map_entries(held)) AS e FROM (SELECT "user", artist, arg_max(held, n) AS held FROM walk GROUP BY ALL)),
before AS (SELECT "user", artist, album, plays, row_number() OVER (PARTITION BY "user" ORDER BY plays DESC, seq) AS rank FROM charted),
after AS (SELECT "user", artist, e.key AS album, e.value.p AS plays, row_number() OVER (PARTITION BY "user" ORDER BY e.value.p DESC, e.value.s) AS rank FROM ended WHERE e.value.p > 0)
"""
SQL["chart_movers"] = _SETTLED + """, pair AS (SELECT b."user", b.artist, b.album, b.rank AS rank_before, b.plays AS plays_before, a.rank AS rank_after, a.plays AS plays_after, b.rank - a.rank AS delta,
  CASE WHEN b.plays = a.plays THEN 'displaced' ELSE 'merged' END AS reason FROM before b JOIN after a ON a."user" = b."user" AND a.artist = b.artist AND a.album = b.album
  WHERE b.rank <= 200 AND a.rank <= 200 AND least(b.rank, a.rank) <= 120 AND a.rank <> b.rank)
SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY reason DESC, abs(delta) DESC, CASE WHEN rank_before <= 120 THEN rank_before ELSE 1000 + rank_after END) AS place FROM pair QUALIFY place <= 20"""
SQL["chart_tops"] = _SETTLED + """, tops AS (SELECT "user", 'reported' AS chart, rank, artist || '␟' || album AS album, plays FROM before WHERE rank <= 25 UNION ALL SELECT "user", 'corrected', rank, artist || '␟' || album, plays FROM after WHERE rank <= 25)
SELECT *, max(album) FILTER (WHERE rank = 1) OVER (PARTITION BY "user") <> min(album) FILTER (WHERE rank = 1) OVER (PARTITION BY "user") AS number_one_changes FROM tops"""
_ALL = f"WITH found AS ({_detected()})\n"
SQL["issue_summary"] = _ALL + 'SELECT "user", detector, count(*) AS issues, CAST(sum(plays_affected) AS BIGINT) AS plays_affected FROM found GROUP BY "user", detector'
SQL["ranked_issues"] = _ALL + """, k AS (SELECT *, CAST(style OR class NOT IN ('error', 'split') AS INT) AS idle, CASE WHEN detector = 'D5' THEN 0 WHEN detector IN ('D0', 'D4', 'D15') THEN 1 WHEN detector = 'D8' THEN 2 WHEN detector = 'D1' THEN 3 WHEN detector = 'D11' THEN 4 WHEN detector IN ('D6', 'D12') THEN 5 ELSE 6 END AS tier FROM found),
g AS (SELECT "user", idle, tier, round(confidence * 4) AS quarter, plays_affected, count(*) AS issues, min(detector) AS detector, min(class) AS class FROM k GROUP BY "user", idle, tier, round(confidence * 4), plays_affected),
r AS (SELECT *, sum(issues) OVER (PARTITION BY "user" ORDER BY idle, tier, quarter DESC, plays_affected DESC) AS last FROM g)
SELECT "user", CAST(last - issues + 1 AS INT) AS first, CAST(last AS INT) AS last, issues, detector, class, plays_affected FROM r"""
SQL["hygiene"] = _ALL + f""", cells AS (SELECT * FROM ({sql.CELLS} SELECT * FROM cells)),
t AS (SELECT "user", sum(plays) AS n, greatest(count(DISTINCT (artist, album)) FILTER (WHERE album <> ''), 80) AS d, sum(CASE WHEN is_era THEN plays ELSE 0 END) / sum(plays) AS era, sum(CASE WHEN album <> '' THEN plays ELSE 0 END) / sum(plays) AS album FROM cells GROUP BY "user"),
slots AS (SELECT "user", d, unnest(['album_integrity', 'artist_integrity', 'duplicate_rate', 'era_consistency']) AS bucket, unnest([album, 1.0, 1.0, era]) AS weight FROM t),
b AS (SELECT "user", CASE WHEN detector IN ('D4', 'D5', 'D15') THEN 'album_integrity' WHEN detector IN ('D1', 'D8', 'D11') THEN 'artist_integrity' WHEN detector IN ('D6', 'D12') THEN 'duplicate_rate' ELSE 'era_consistency' END AS bucket,
  sum(CASE WHEN style THEN 0 ELSE CASE class WHEN 'error' THEN 3 WHEN 'split' THEN 2 WHEN 'review' THEN 0 ELSE 1 END * (1 + log10(1 + plays_affected)) END) AS penalty, sum(CASE WHEN NOT style AND class <> 'review' THEN 1 ELSE 0 END) AS actionable FROM found GROUP BY 1, 2),
s AS (SELECT slots."user", slots.bucket, weight, CASE WHEN weight > 0 THEN CASE WHEN coalesce(penalty, 0) = 0 THEN 100 ELSE greatest(1, CAST(round(100 * 0.06 * d / (penalty + 0.06 * d)) AS INT)) END END AS score, CASE WHEN weight > 0 THEN coalesce(actionable, 0) ELSE 0 END AS actionable FROM slots LEFT JOIN b ON b."user" = slots."user" AND b.bucket = slots.bucket),
m AS (SELECT "user", CAST(round(exp(sum(CASE WHEN weight > 0 THEN weight * ln(score) ELSE 0 END) / sum(greatest(weight, 0)))) AS INT) AS raw, CAST(sum(actionable) AS BIGINT) AS actionable, sum(greatest(weight, 0)) AS whole FROM s GROUP BY "user")
SELECT s."user", any_value(CASE WHEN m.actionable > 0 THEN least(raw, 99) ELSE raw END) AS score, any_value(m.actionable) AS actionable, """ + ", ".join(
    [f"max(score) FILTER (WHERE bucket = '{b}') AS {b}" for b in chart.BUCKETS] + [f"max(CAST(round(100 * greatest(weight, 0) / whole) AS INT)) FILTER (WHERE bucket = '{b}') AS weight_{b}" for b in chart.BUCKETS]
) + ' FROM s JOIN m ON m."user" = s."user" GROUP BY s."user"'
