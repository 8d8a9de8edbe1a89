"""What reads the whole log: names are compared by built-ins first, and the report reads plays no oftener than it has to."""

import random

from pyspark.sql import functions as F

from playtide.functions import keys, strings
from playtide.operators import albums, timing
from playtide.plans import report

from .oracle import duplicates, frame, play


def library():
    rng = random.Random(5)
    names = ["Ab Cd", "ab-cd", "AB  CD!", "A`b", "a'b", "Éa", "Éa", "ea", "(Ab) cd", "9 Lives", "9 lives!", "", "?", "Ash", "Ab\x1fCd"]
    return [play(1_600_000_000 + 86_400 * (i // 40), rng.choice(names), rng.choice(names), rng.choice(["", "X"])) for i in range(400)]


def plan_of(rows) -> str:
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_names_with_one_key_may_share_it(spark):
    rng = random.Random(1)
    pieces = ["a", "B", "h", "w", "r", "7", " ", "-", "'", "`", "(", "\t", "\x1c", "s", "ck", "é", "é", "The "]
    names = ["".join(rng.choice(pieces) for _ in range(rng.randrange(6))) for _ in range(300)]
    names += [n.upper() for n in names] + [n.replace(" ", " - ") for n in names]
    names = sorted(set(names))
    pairs = [(a, b) for a in names for b in names if a < b and (strings.norm(a) == strings.norm(b) or strings.norm_title(a) == strings.norm_title(b))]
    assert len(pairs) > 100
    rows = spark.createDataFrame(pairs, "a string, b string")
    assert rows.filter(~keys.may_share_key(F.col("a"), F.col("b"))).count() == 0
    apart = spark.createDataFrame([("hot bolt", "large ring"), ("Brand", "Drum")], "a string, b string")
    assert apart.filter(keys.may_share_key(F.col("a"), F.col("b"))).count() == 0


def test_repeats_of_dated_plays_are_told_apart_ahead_of_python(spark):
    plays = library()
    found = timing.adjacent_repeats(frame(spark, plays))
    assert sorted(r.uts for r in found.collect()) == sorted(duplicates(plays)) != []
    plan = plan_of(found)
    assert plan.index("ArrowEvalPython") < plan.index("soundex")  # listed from the last step to the first


def test_hours_give_months_and_full_hours(spark):
    log = frame(spark, library() + [play(-5, "A", "t", ""), play(3_599, "A", "t", "X")])
    hours = timing.hourly(log)
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(albums.months_of(hours)) == rows(albums.monthly(log))
    assert rows(albums.months_of(hours, "blanks", "blank_seq")) == rows(albums.monthly(log.filter("album = ''")))
    assert rows(timing.bursts(log, 30, hours)) == rows(timing.bursts(log, 30))


def test_a_kept_report_says_the_same_and_reads_plays_for_dates_ahead_only(spark, tmp_path):
    frame(spark, library()).write.parquet(f"{tmp_path}/log")
    log = spark.read.parquet(f"{tmp_path}/log")
    kept, lazy = report.analyse(log, now=1_600_200_000), report.analyse(log, now=1_600_200_000, keep=False)
    assert sorted(map(str, kept.issues.collect())) == sorted(map(str, lazy.issues.collect()))
    plan = kept.issues._jdf.queryExecution().optimizedPlan()
    read = [leaf for leaf in plan.collectLeaves().mkString("\n\n").split("\n\n") if "uts#" in leaf and "artist_mbid#" in leaf and "first_uts#" not in leaf]
    assert len(read) == 2
    kept.release()


def test_keys_of_an_album_chart_are_computed_on_its_rows(spark):
    log = frame(spark, library())
    chart = log.groupBy("user", F.col("album").alias("name"), "artist", F.col("album_mbid").alias("mbid")).agg(F.count("*").alias("playcount"), F.min("seq").alias("ord"))
    lines = plan_of(albums.album_artist_pairs(chart)).splitlines()
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    for i, line in enumerate(lines):
        if "Aggregate" in line:
            under = [x for x, d in zip(lines[i + 1 :], depth[i + 1 :], strict=True) if d > depth[i]]
            assert not any("EvalPython" in x for x in under)
