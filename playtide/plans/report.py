"""The whole report: all detectors, ranked findings, chart, score, profile, as named DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from playtide.operators import albums, artists, chart, timing, unreleased
from playtide.operators.cells import cells_of, kept_cells, partition_eras
from playtide.sources.scratch import discard, kept
from playtide.sources.versions import Versions

#: Tiers of detectors, the most worth fixing first.
TIERS = (("D5",), ("D0", "D4", "D15"), ("D8",), ("D1",), ("D11",), ("D6", "D12"), ("D14a", "D14c", "D14e", "D14f"), ("D16",))


def importance() -> list[Column]:
    """Sort order of findings: actionable, detector tier, confidence in quarters, plays; then as emitted."""
    idle = F.coalesce("style_choice", F.lit(False)) | ~F.col("class").isin("error", "split")
    tier = F.coalesce(F.create_map(*[F.lit(x) for i, ds in enumerate(TIERS) for d in ds for x in (d, i)])[F.col("detector")], F.lit(99))
    quarter = F.round(F.coalesce("confidence", F.lit(0.0)) * 4)
    return [idle.cast("int"), tier, F.desc(quarter), F.desc(F.coalesce("plays_affected", F.lit(0))), F.col("emit_tier"), F.col("emit_ord")]


def rank_issues(issues: DataFrame) -> DataFrame:
    """issues with `place`, their rank within the user."""
    return issues.withColumn("place", F.row_number().over(Window.partitionBy("user").orderBy(*importance())))


def summary_by_detector(issues: DataFrame) -> DataFrame:
    return issues.groupBy("user", "detector").agg(F.count("*").alias("issues"), F.sum(F.coalesce("plays_affected", F.lit(0))).alias("plays_affected"))


def profile(plays: DataFrame) -> DataFrame:
    """(user, scrobbles, artists, albums, tracks): exact distinct counts, from one roll-up."""
    cells = plays.groupBy("user", "artist", "album", "track").agg(F.count("*").alias("plays"))
    return cells.groupBy("user").agg(
        F.sum("plays").alias("scrobbles_ingested"), F.count_distinct("artist").alias("distinct_artists"),
        F.count_distinct(F.when(F.col("album") != "", F.struct("artist", "album"))).alias("distinct_albums"), F.count_distinct("artist", "track").alias("distinct_tracks"),
    )


def score_totals(cells: DataFrame) -> DataFrame:
    """Totals and bucket weights of hygiene_score(): era and album buckets count by their share of plays."""
    n = F.sum("plays")
    return cells.groupBy("user").agg(
        n.alias("total_plays"), F.count_distinct(F.when(F.col("album") != "", F.struct("artist", "album"))).alias("album_strings"),
        (F.sum(F.when(F.col("is_era"), F.col("plays")).otherwise(0)) / n).alias("weight_era_consistency"), (F.sum(F.when(F.col("album") != "", F.col("plays")).otherwise(0)) / n).alias("weight_album_integrity"),
        F.lit(1.0).alias("weight_artist_integrity"), F.lit(1.0).alias("weight_duplicate_rate"),
    )


PARTS = ("issues", "profile", "hygiene", "era", "impact", "summary_by_detector")


def publish(parts: dict[str, DataFrame | Callable], path: str) -> str:
    """Write all parts as one version of the report at path: they appear together, or, if one fails, none does.

    A part may be a function of those before it: it is given one that reads them by name.
    """
    spark = next(p for p in parts.values() if isinstance(p, DataFrame)).sparkSession
    versions = Versions(spark, path)
    name = versions.begin()
    done = lambda part: spark.read.parquet(f"{versions.folder(name)}/{part}")
    try:
        for part, rows in parts.items():
            (rows if isinstance(rows, DataFrame) else rows(done)).write.parquet(f"{versions.folder(name)}/{part}")
    except BaseException:
        versions.abort(name)
        raise
    versions.commit(name)
    return name


def published(spark: SparkSession, path: str, part: str, version: str | None = None) -> DataFrame:
    """A part of the report at path, of its current version or the one named."""
    versions = Versions(spark, path)
    name = version or versions.current()
    if name is None:
        raise FileNotFoundError(f"no report has been published at {path}")
    return spark.read.parquet(f"{versions.folder(name)}/{part}")


@dataclass
class Report:
    cells: DataFrame
    splits: DataFrame
    issues: DataFrame
    profile: DataFrame
    hygiene: DataFrame
    era: DataFrame
    impact: DataFrame
    summary_by_detector: DataFrame
    totals: DataFrame
    tables: tuple[DataFrame, ...] = ()

    def release(self) -> None:
        """Delete the run's own tables; the report can no longer be read, but for what has been written."""
        for table in self.tables:
            discard(table.sparkSession, table)

    def write(self, path: str) -> None:
        """All parts under path, as its new version.  What sums up the findings reads them back, so they are found once."""
        summed = {"hygiene": lambda done: chart.hygiene_score(done("issues"), self.totals), "summary_by_detector": lambda done: summary_by_detector(done("issues"))}
        publish({name: summed.get(name, getattr(self, name)) for name in PARTS}, path)


def analyse(plays: DataFrame, now: int, official: DataFrame | None = None, top_albums: DataFrame | None = None, keep: bool = True) -> Report:
    """The report of every user in a play log.  `now` is given, so that a run can be repeated.

    The roll-up is written once, as a table of the run (see sources/scratch.py); every detector then
    reads the columns of it that it needs.  Those of time read the plays' counts by hour and their
    repeats, tables of the run too; but for these three, only dates in the future read plays again.
    """
    if keep:
        cells, hours, repeats = kept_cells(plays, official), kept(timing.hourly(plays), "hours"), kept(timing.adjacent_repeats(plays), "repeats")
        tables = (cells, hours, repeats)
    else:
        cells, hours, repeats, tables = partition_eras(cells_of(plays), official), None, None, ()
    era, rest = cells.filter("is_era"), cells.filter("NOT is_era")
    splits = albums.album_splits(rest)
    blanks = albums.monthly(plays.filter("coalesce(album, '') = ''")) if hours is None else albums.months_of(hours, "blanks", "blank_seq")
    found = [unreleased.format_variants(era), unreleased.tracks_in_two_eras(era), unreleased.single_buckets(cells), splits, artists.feature_credits(rest), artists.artist_variants(rest), albums.missing_albums(rest, None, blanks), timing.duplicates(plays, found=repeats, hours=hours), albums.various_artists(rest), timing.impossible(plays, now, hours=hours)]
    if top_albums is not None:
        found.append(albums.album_artist_splits(top_albums))
    issues = found[0]
    for more in found[1:]:
        issues = issues.unionByName(more)
    totals = score_totals(cells)
    return Report(
        cells, splits, rank_issues(issues), profile(plays), chart.hygiene_score(issues, totals), unreleased.overview(cells), chart.chart_impact(rest, splits), summary_by_detector(issues), totals, tables
    )
