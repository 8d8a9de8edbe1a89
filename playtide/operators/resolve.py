"""Findings enriched by lookups.  Lookups are tables; a missing row means not asked.

lookup(artist, track, groups array<release group>): an empty list is an answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playtide.functions import keys
from playtide.operators.issues import issue, member, plural, ranked, text

#: Which detectors a lookup can say more about.
LOCAL_ONLY = ("D6", "D12")
DISCOVERY = ("D14e", "D16")
RESOLVABLE = ("D0", "D4", "D5", "D8", "D1", "D11", "D15", "D14a", "D14c")


def studio(groups: Column) -> Column:
    """Albums that are not compilations."""
    return F.filter(groups, lambda g: (g["primary"] == "Album") & ~F.coalesce(F.array_contains(g["secondary"], "Compilation"), F.lit(False)))


def target(groups: Column) -> Column:
    """The first studio album, else the first release."""
    return F.coalesce(F.get(studio(groups), F.lit(0)), F.get(groups, F.lit(0)))


def is_resolvable() -> Column:
    done = F.coalesce("resolved", F.lit(False)) | F.coalesce("dropped", F.lit(False))
    return ~done & F.col("detector").isin(*RESOLVABLE)


def split_targets(splits: DataFrame, lookup: DataFrame) -> DataFrame:
    """Splits whose release is known, pointed at it.  Splits without an answer are left out."""
    rows = splits.join(lookup.select("artist", "track", "groups"), ["artist", "track"]).filter(F.size("groups") > 0).withColumn("__t", target(F.col("groups")))
    t = F.col("__t")
    return rows.select(
        *[c for c in splits.columns if c not in ("detector", "confidence", "suggest", "external", "candidates")],
        F.lit("D0").alias("detector"), F.when(F.col("temporal").isNotNull(), 0.9).otherwise(0.75).alias("confidence"),
        text("consolidate to '", t["title"], "' (", F.coalesce(t["primary"], F.lit("type unknown")), ", ", F.coalesce(t["first_release"], F.lit("date unknown")), ")").alias("suggest"),
        t.alias("external"), F.slice("groups", 1, 8).alias("candidates"),
    ).select(*splits.columns)


def missing_targets(blanks: DataFrame, lookup: DataFrame, top: int = 30) -> DataFrame:
    """D5 with releases: (user, artist, track, plays, should_be): the most played tracks without an album."""
    w = Window.partitionBy("user").orderBy(F.desc("plays"), "seq")
    rows = blanks.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top).join(lookup.select("artist", "track", "groups"), ["artist", "track"], "left")
    return rows.select("user", "place", "artist", "track", "plays", target(F.col("groups"))["title"].alias("should_be"))


def released_since(era: DataFrame, lookup: DataFrame) -> DataFrame:
    """D14e: era tracks that an official release now lists.

    The release must be official, an album, single or EP, no bootleg or demo, dated, and not
    named like one of the track's eras.  A streaming source is better evidence than a database.
    """
    named = era.groupBy("user", "artist", "track", "era_name", "era_key").agg(F.sum("plays").alias("plays"), F.min("seq").alias("seq"), F.min("first_uts").alias("first"), F.max("last_uts").alias("last"))
    tracks = named.groupBy("user", "artist", "track").agg(F.sum("plays").alias("total"), F.min("seq").alias("seq"), F.min("first").alias("first"), F.max("last").alias("last"), ranked("era_name", "era_key", "plays").alias("all"))
    tracks = tracks.withColumn("eras", F.filter("all", lambda e: e["era_name"].isNotNull()))
    groups = lookup.select("artist", "track", F.posexplode("groups").alias("i", "g")).withColumn("title_key", keys.norm("g.title"))
    ok = (F.col("g.status") == "Official") & F.col("g.primary").isin("Album", "Single", "EP") & (F.coalesce("g.first_release", F.lit("")) != "")
    ok &= ~F.exists(F.coalesce("g.secondary", F.array().cast("array<string>")), lambda s: s.rlike("(?i)bootleg|demo"))
    like = lambda e: (e["era_key"] != "") & (F.contains(F.col("title_key"), e["era_key"]) | F.contains(e["era_key"], F.col("title_key")))
    rows = tracks.join(groups.filter(ok), ["artist", "track"]).filter(~F.exists("eras", like))
    stream = F.coalesce(F.col("g.source") == "spotify", F.lit(False))
    best = rows.groupBy("user", "artist", "track").agg(F.min_by("g", F.struct((~stream).alias("s"), "i")).alias("g"), *[F.first(c).alias(c) for c in ("total", "seq", "first", "last", "eras")])
    stream, g = F.coalesce(F.col("g.source") == "spotify", F.lit(False)), F.col("g")
    return issue(
        best, "D14e", **{"class": "split"}, confidence=F.when(stream, 0.6).otherwise(0.35), artist=F.col("artist"), track=F.col("track"), plays_affected=F.col("total"), external=g, no_auto_action=True, emit_ord=F.col("seq"),
        title=text(F.col("artist"), " - ", F.col("track"), " may be out by now"),
        suggest=text(g["primary"], " '", g["title"], "' (", g["first_release"], ") lists this title", F.when(stream, ", and it can be streamed now.").otherwise(", by MusicBrainz, which lists leaks too."), " It may be another mix. Your plays run ", keys.month_name(F.col("first")), " to ", keys.month_name(F.col("last")), "."),
        members=F.transform("eras", lambda e: member(era=e["era_name"], plays=e["plays"])),
    )


def single_candidates(rest: DataFrame, min_plays: int = 1) -> DataFrame:
    """(user, artist, track, album, plays): plays of singles, by track and album key."""
    rows = rest.filter("single_shaped AND artist <> '' AND track <> '' AND album <> ''").groupBy("user", "artist_key", "track_id", "album_key").agg(F.min(F.struct("seq", "artist", "track", "album")).alias("h"), F.sum("plays").alias("plays"))
    return rows.filter(F.col("plays") >= min_plays).select("user", "h.artist", "h.track", "h.album", "artist_key", "album_key", "plays", F.col("h.seq").alias("seq"))


#: Confidence by evidence, and by whether the album is in the library already.
STRANDED = {("both", True): 0.80, ("both", False): 0.50, ("curated", True): 0.70, ("curated", False): 0.35, ("lastfm", True): 0.45, ("lastfm", False): 0.20}
NOTES = {"both": "Release data and Last.fm agree", "curated": "From release data", "lastfm": "From Last.fm only"}


def stranded_singles(candidates: DataFrame, lookup: DataFrame, owned: DataFrame, lastfm: DataFrame | None = None) -> DataFrame:
    """Tracks played only as singles that an album holds, by album.

    lastfm(artist, track, title) is the service's own album, the weakest evidence; a group is as
    strong as its weakest member.  owned(user, album_key) are the albums in the library.
    """
    rows = candidates.join(lookup.select("artist", "track", "groups"), ["artist", "track"], "left")
    rows = rows.join(lastfm.select("artist", "track", F.col("title").alias("lfm_raw")), ["artist", "track"], "left") if lastfm is not None else rows.withColumn("lfm_raw", F.lit(None).cast("string"))
    best = F.get(studio(F.col("groups")), F.lit(0))
    rows = rows.withColumn("curated", F.coalesce(best["title"], F.lit(""))).withColumn("released", F.coalesce(best["first_release"], F.lit(""))).withColumn("lfm_raw", F.coalesce("lfm_raw", F.lit("")))
    rows = rows.withColumn("lfm_key", keys.norm("lfm_raw")).withColumn("curated_key", keys.norm("curated")).withColumn("lfm_single", keys.single_shaped("lfm_raw", "track"))
    usable = (F.col("lfm_raw") != "") & (F.col("lfm_key") != F.col("album_key")) & ~F.col("lfm_single")
    rows = rows.withColumn("lfm", F.when(usable, F.col("lfm_raw")).otherwise("")).filter("curated <> '' OR lfm <> ''")
    agree = (F.col("curated") != "") & (F.col("lfm") != "") & (F.col("curated_key") == F.col("lfm_key"))
    rows = rows.withColumn("source", F.when(agree, "both").when(F.col("curated") != "", "curated").otherwise("lastfm"))
    rows = rows.withColumn("target", F.when(F.col("curated") != "", F.col("curated")).otherwise(F.col("lfm"))).withColumn("target_key", F.when(F.col("curated") != "", F.col("curated_key")).otherwise(F.col("lfm_key")))
    rows = rows.filter("target_key <> album_key").filter(~keys.single_shaped("target", "track"))
    rows = rows.withColumn("disagreed", F.when((F.col("curated") != "") & (F.col("lfm") != "") & (F.col("source") != "both"), F.col("lfm")).otherwise("")).withColumn("severity", F.when(F.col("source") == "lastfm", 2).when(F.col("source") == "curated", 1).otherwise(0))
    groups = rows.groupBy("user", "artist_key", "target_key").agg(
        F.min(F.struct((-F.col("plays")).alias("less"), "seq", "artist", "target", "released", "disagreed")).alias("h"), F.max("severity").alias("severity"), F.sum("plays").alias("total"), ranked("artist", "track", "album", "plays").alias("t")
    )
    held = owned.select("user", F.col("album_key").alias("target_key")).distinct().withColumn("held", F.lit(True))
    d = groups.join(held, ["user", "target_key"], "left").withColumn("held", F.coalesce("held", F.lit(False))).withColumn("source", F.element_at(F.array(F.lit("both"), F.lit("curated"), F.lit("lastfm")), F.col("severity") + 1))
    conf = F.create_map(*[F.lit(x) for (s, h), c in STRANDED.items() for x in (f"{s}|{str(h).lower()}", c)])[F.concat_ws("|", "source", F.col("held").cast("string"))]
    n, h = F.size("t"), F.col("h")
    return issue(
        d, "D16", **{"class": "review"}, style_choice=True, confidence=conf, artist=h["artist"], album=h["target"], plays_affected=F.col("total"), chart_already_correct=~F.col("held"), released=h["released"], emit_ord=h["seq"],
        evidence=F.create_map(*[F.lit(x) for p in NOTES.items() for x in p])[F.col("source")], evidence_source=F.col("source"),
        title=text("'", h["target"], "' has ", n, " track", plural(n), " that you know as singles only"),
        suggest=text("'", h["target"], "'", F.when(h["released"] != "", text(" (", h["released"], ")")).otherwise(""), " holds ", F.when(n == 1, "it").otherwise("them"), ", while ", F.col("total"), " play", plural(F.col("total")), " sit under singles. ",
                     F.when(F.col("held"), "You have plays on that album, so re-tagging merges into it.").otherwise("You have no plays on that album, so this would add a chart entry."),
                     F.when(F.col("source") == "lastfm", " Only the service's own, editable data says so.").otherwise(""), F.when(h["disagreed"] != "", text(" The service calls it '", h["disagreed"], "'.")).otherwise("")),
        members=F.transform("t", lambda x: member(artist=x["artist"], track=x["track"], plays=x["plays"], looks_like=text("tagged '", x["album"], "'"))),
    )


def verification_plan(issues: DataFrame) -> DataFrame:
    """(artist, title): era names to look up, each once but for case."""
    v = issues.filter("verify IS NOT NULL").select("emit_ord", "verify.artist", F.posexplode(F.array("verify.a", "verify.b")).alias("i", "title"))
    return v.groupBy(F.lower("artist").alias("ka"), F.lower("title").alias("kt")).agg(F.max(F.struct("emit_ord", "i", "artist", "title")).alias("x")).select("x.artist", "x.title")


def verify_era_names(issues: DataFrame, exists: DataFrame) -> DataFrame:
    """Typo findings settled by exists(artist, title, exists), whose missing rows and nulls mean unknown.

    Names are asked for once but for case, so an answer holds for all spellings of that kind.
    Both names real: no finding.  The rarer one real: doubtful.  The other alone real: likely a
    typo.  Neither: for information.  Unknown: unconfirmed.
    """
    plain, asked = issues.filter("verify IS NULL"), issues.filter("verify IS NOT NULL")
    answers = exists.groupBy(F.lower("artist").alias("__artist"), F.lower("title").alias("__title")).agg(F.max("exists").alias("__exists"))
    for n in "ab":
        side = answers.withColumnRenamed("__exists", f"__{n}")
        asked = asked.join(side, (F.lower("verify.artist") == F.col("__artist")) & (F.lower(f"verify.{n}") == F.col("__title")), "left").drop("__artist", "__title")
    a, b, v = F.col("__a"), F.col("__b"), F.col("verify")
    unknown = a.isNull() | b.isNull()
    asked = asked.filter(unknown | ~(a & b))
    state = F.when(unknown, "unknown").when(b, "other").when(a, "rarer").otherwise("neither")
    aa, ba = F.coalesce(v["a_album"], v["a"]), F.coalesce(v["b_album"], v["b"])
    both = text(" The two entries are '", aa, "' and '", ba, "'.")
    pick = lambda name, **kw: F.when(F.col("__s") == "unknown", kw["unknown"]).when(F.col("__s") == "other", kw["other"]).when(F.col("__s") == "rarer", kw["rarer"]).otherwise(kw["neither"]).alias(name)
    asked = asked.withColumn("__s", state)
    new = {
        "confidence": pick("confidence", unknown=0.25, other=0.85, rarer=0.4, neither=0.3),
        "class": pick("class", unknown=F.col("class"), other=F.lit("error"), rarer=F.lit("review"), neither=F.col("class")),
        "title": F.when(F.col("__s") == "other", text("No release of ", v["artist"], " is called '", aa, "'")).otherwise(F.col("title")).alias("title"),
        "suggest": pick("suggest", unknown=text("Could not be checked this run, so unconfirmed either way.", both), other=text("'", v["b"], "' is a release and '", v["a"], "' is not: likely a typo or a wrong era name. Compare '", ba, "'."),
                        rarer=text("'", v["a"], "' is a release and '", v["b"], "' is not: the rarer spelling is the real one.", both), neither=text("Neither is a release, as is usual for unreleased projects.", both)),
        "verify": F.lit(None).cast(dict(issues.dtypes)["verify"]).alias("verify"),
    }
    return plain.unionByName(asked.select(*[new.get(c, F.col(c)) for c in issues.columns]))


def verify_joint_credits(issues: DataFrame, exists: DataFrame) -> DataFrame:
    """Joint-credit findings settled by exists(artist, exists): real names go, unreal ones gain confidence."""
    rows = issues.join(exists.select(F.col("artist").alias("verify_artist"), F.col("exists").alias("__e")), "verify_artist", "left")
    rows = rows.filter("verify_artist IS NULL OR NOT coalesce(__e, false)")
    no = F.col("verify_artist").isNotNull() & F.coalesce(~F.col("__e"), F.lit(False))
    new = {
        "confidence": F.when(no, F.least(F.lit(0.75), F.coalesce("confidence", F.lit(0.5)) + 0.15)).otherwise(F.col("confidence")).alias("confidence"),
        "evidence": F.when(no, "no artist page under this name").otherwise(F.col("evidence")).alias("evidence"),
        "suggest": F.when(no, text(F.col("suggest"), " No release database knows '", F.col("verify_artist"), "' as an artist either.")).otherwise(F.col("suggest")).alias("suggest"),
    }
    return rows.select(*[new.get(c, F.col(c)) for c in issues.columns])


def same_recording(a: Column, b: Column) -> Column:
    """'same', 'different' or 'unknown' by the recording IDs of two lookups' groups."""
    ids = lambda g: F.array_distinct(F.filter(F.transform(g, lambda x: x["recording_id"]), lambda r: F.coalesce(r, F.lit("")) != ""))
    known = (F.coalesce(F.size(ids(a)), F.lit(0)) > 0) & (F.coalesce(F.size(ids(b)), F.lit(0)) > 0)
    return F.when(~known, "unknown").when(F.arrays_overlap(ids(a), ids(b)), "same").otherwise("different")


def apply_recording_verdict(issues: DataFrame, verdict: str = "recording_verdict") -> DataFrame:
    """Title findings after a recording verdict, given as a column of issues."""
    same, other = F.col(verdict) == "same", F.col(verdict) == "different"
    new = {
        "class": F.when(other, "review").otherwise(F.col("class")).alias("class"),
        "confidence": F.when(same, 0.97).when(other, 0.1).otherwise(F.col("confidence")).alias("confidence"),
        "evidence": F.when(same, "same MusicBrainz recording").when(other, "different recordings").otherwise(F.col("evidence")).alias("evidence"),
        "resolved": F.when(other, True).otherwise(F.col("resolved")).alias("resolved"),
        "suggest": F.when(same, text(F.coalesce("suggest", F.lit("")), " Confirmed: one recording in MusicBrainz under both spellings.")).when(other, "Two DIFFERENT recordings in MusicBrainz, so likely a remix or rework. Nothing to fix here.").otherwise(F.col("suggest")).alias("suggest"),
    }
    return issues.select(*[new.get(c, F.col(c)) for c in issues.columns if c != verdict])


def resolve(issues: DataFrame, lookup: DataFrame, artist_exists: DataFrame | None = None) -> DataFrame:
    """Every finding after its lookup, marked resolved, unresolved or dropped; others pass unchanged."""
    able = issues.filter(is_resolvable())
    out = issues.filter(~is_resolvable())
    flags = lambda d, **kw: d.select(*[F.lit(kw[c]).alias(c) if c in kw else F.col(c) for c in issues.columns])

    joint = able.filter("detector = 'D8' AND verify_artist IS NOT NULL")
    if artist_exists is not None:
        gone = joint.join(artist_exists.filter("exists").select(F.col("artist").alias("verify_artist")).distinct(), "verify_artist", "left_semi").select(*issues.columns)
        out = out.unionByName(verify_joint_credits(joint, artist_exists)).unionByName(flags(gone, resolved=True, dropped=True))
    else:
        out = out.unionByName(joint)

    blank = able.filter("detector = 'D5'")
    tracks = blank.select("user", F.posexplode(F.slice("tracks", 1, 30)).alias("i", "t")).select("user", "i", "t.*").join(lookup.select("artist", "track", "groups"), ["artist", "track"], "left").withColumn("should", target(F.col("groups"))["title"])
    found = tracks.groupBy("user").agg(
        F.array_sort(F.collect_list(F.struct("i", member(artist=F.col("artist"), track=F.col("track"), plays=F.col("plays"), looks_like=F.coalesce(text("should be: ", F.col("should")), F.lit("no album found for this title"))).alias("m")))).alias("__m"),
        F.count("should").alias("__n"), F.count("*").alias("__of"),
    )
    named = blank.join(found, "user", "left").withColumn("members", F.coalesce(F.transform("__m", lambda x: x["m"]), F.col("members")))
    named = named.withColumn("suggest", F.when(F.col("__n") > 0, text(F.col("__n"), " of ", F.col("__of"), " have been matched to a release, shown next to each track. ", F.col("suggest"))).otherwise(F.col("suggest")))
    out = out.unionByName(flags(named, resolved=True))

    splits = able.filter("detector IN ('D0', 'D4')")
    aimed = split_targets(splits, lookup)
    bare = splits.join(lookup.filter(F.size("groups") > 0).select("artist", "track").distinct(), ["artist", "track"], "left_anti").select(*issues.columns)
    out = out.unionByName(flags(aimed, resolved=True)).unionByName(flags(bare, resolved=True, unresolved=True))

    other = able.filter("NOT (detector = 'D8' AND verify_artist IS NOT NULL) AND detector NOT IN ('D5', 'D0', 'D4')")
    track = F.coalesce(F.nullif("track", F.lit("")), F.get(F.filter(F.transform("members", lambda m: m["track"]), lambda t: F.coalesce(t, F.lit("")) != ""), F.lit(0)))
    rows = other.withColumn("__track", track).join(lookup.select(F.col("artist").alias("__la"), F.col("track").alias("__lt"), F.col("groups").alias("__g")), (F.col("artist") == F.col("__la")) & (F.col("__track") == F.col("__lt")), "left")
    hit, best, n = F.coalesce(F.size("__g"), F.lit(0)) > 0, F.get("__g", F.lit(0)), F.size("__g")
    shape = F.when(best["primary"].isNull(), "").otherwise(text(" (", best["primary"], F.when(best["first_release"].isNotNull(), text(", ", best["first_release"])).otherwise(""), ")"))
    more = F.when(n > 1, text(" and ", n - 1, " other release", F.when(n > 2, "s").otherwise(""), ".")).otherwise(".")
    new = {
        "resolved": F.lit(True).alias("resolved"), "unresolved": F.when(hit, F.col("unresolved")).otherwise(True).alias("unresolved"),
        "external": F.when(hit, best).otherwise(F.col("external")).alias("external"), "candidates": F.when(hit, F.slice("__g", 1, 5)).otherwise(F.col("candidates")).alias("candidates"),
        "evidence": F.when(hit, F.coalesce("evidence", F.lit("release data"))).otherwise(F.col("evidence")).alias("evidence"),
        "suggest": F.when(hit, text(F.coalesce("suggest", F.lit("")), " Release data: '", best["title"], "'", shape, more)).otherwise(F.col("suggest")).alias("suggest"),
    }
    return out.unionByName(rows.select(*[new.get(c, F.col(c)) for c in issues.columns]))
