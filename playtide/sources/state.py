"""Scan state as a table, and a track lookup's answer with the call that failed kept apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATE = "user string, fetched long, total_pages long, next_page long, anchor long, saved long"


def save_state(state: DataFrame, path: str, now: int) -> None:
    """Keep state(user, ...) as each user's; other users' stays.  A folder a user, replaced whole."""
    columns = [c.split()[0] for c in STATE.split(", ") if c != "saved long"]
    rows = state.select(*columns).withColumn("saved", F.lit(now).cast("long"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("user").parquet(path)


def load_state(spark: SparkSession, path: str) -> DataFrame:
    """The state of every user that has one; none is no row."""
    return spark.read.schema(STATE).parquet(path).select(*[c.split()[0] for c in STATE.split(", ")])


def clear_state(spark: SparkSession, path: str, users: list[str] | None = None) -> None:
    """Forget the state of these users, or all of it."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if users is None:
        files.delete(root, True)
        return
    gone = set(users)
    for found in files.listStatus(root):
        name = found.getPath().getName()
        if name.startswith("user=") and spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(name[5:]) in gone:
            files.delete(found.getPath(), True)


def track_answers(asked: DataFrame, answers: DataFrame, releases: DataFrame, source: str = "spotify") -> DataFrame:
    """(artist, track, source, error, shared, tier, groups) of each lookup in asked(artist, track).

    answers(artist, track, shared): calls that came back, from the shared cache or not.  A call
    without a row failed: `error` is set, and that is no answer.  releases(artist, track, ord,
    release group...) are what it named, earliest first; "exact" if any, else "none".
    """
    fields = ("rg_id", "title", "primary", "secondary", "first_release", "status", "source")
    groups = releases.groupBy("artist", "track").agg(F.array_sort(F.collect_list(F.struct("ord", *fields))).alias("listed"))
    rows = asked.select("artist", "track").distinct().join(answers.select("artist", "track", "shared").distinct(), ["artist", "track"], "left").join(groups, ["artist", "track"], "left")
    back = F.col("shared").isNotNull()
    named = F.transform("listed", lambda x: F.struct(*[x[f].alias(f) for f in fields]))
    found = F.when(back, F.coalesce(named, F.array().cast("array<struct<rg_id: string, title: string, primary: string, secondary: array<string>, first_release: string, status: string, source: string>>")))
    return rows.select(
        "artist", "track", F.lit(source).alias("source"), (~back).alias("error"), F.col("shared").alias("shared"),
        F.when(back, F.when(F.size("listed") > 0, "exact").otherwise("none")).alias("tier"), found.alias("groups"),
    )
