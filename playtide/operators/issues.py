"""The shape of a finding, and helpers to build rows of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MEMBER = "artist string, album string, track string, era string, plays long, first long, last long, month string, dupes long, total long, uts long, looks_like string"
RELEASE = "rg_id string, title string, primary string, secondary array<string>, first_release string, status string, recording_id string, source string"
FIELDS = {
    "user": "string", "detector": "string", "class": "string", "confidence": "double", "reason": "string", "mbid_verdict": "string",
    "artist": "string", "album": "string", "track": "string", "title": "string", "suggest": "string", "plays_affected": "long",
    "style_choice": "boolean", "no_auto_action": "boolean", "chart_already_correct": "boolean", "chart_rank": "long",
    "verify": "struct<artist: string, a: string, b: string, a_album: string, b_album: string>", "verify_artist": "string",
    "temporal": "struct<pattern: string, migration: boolean, earlier: string, later: string, boundary: bigint>",
    "external": f"struct<{', '.join(': '.join(x.split(' ')) for x in RELEASE.split(', '))}>",
    "candidates": f"array<struct<{', '.join(': '.join(x.split(' ')) for x in RELEASE.split(', '))}>>",
    "evidence": "string", "evidence_source": "string", "released": "string", "resolved": "boolean", "unresolved": "boolean", "dropped": "boolean",
    "members": f"array<struct<{', '.join(': '.join(x.split(' ')) for x in MEMBER.split(', '))}>>",
    "tracks": "array<struct<artist: string, track: string, plays: bigint, first: bigint, last: bigint>>",
    "months": "array<struct<month: string, plays: bigint>>",
    "emit_tier": "int", "emit_ord": "long",
}

#: Order in which detectors are run; ties of the ranking keep it.
EMITTED = ("D14a", "D14c", "D14f", "D4", "D8", "D1", "D5", "D6", "D11", "D12", "D15")


def issue(df: DataFrame, detector: str, **columns) -> DataFrame:
    """Rows of FIELDS; columns not given are null.  Values may be literals."""
    given = {"detector": F.lit(detector), "emit_tier": F.lit(EMITTED.index(detector) if detector in EMITTED else 99)} | columns
    out = []
    for name, kind in FIELDS.items():
        c = given.get(name, F.col(name) if name == "user" else None)
        c = c if isinstance(c, Column) else F.lit(c)
        out.append(c.cast(kind).alias(name))
    return df.select(*out)


def member(**fields) -> Column:
    """A member struct; fields not given are null."""
    out = []
    for spec in MEMBER.split(", "):
        name, kind = spec.split(" ")
        c = fields.get(name)
        out.append((c if isinstance(c, Column) else F.lit(c)).cast("bigint" if kind == "long" else kind).alias(name))
    return F.struct(*out)


def ranked(*columns: str) -> Column:
    """Collected rows, most plays first, then first seen."""
    return F.array_sort(F.collect_list(F.struct((-F.col("plays")).alias("less"), F.col("seq"), *[F.col(c) for c in columns])))


def quoted(names: Column, glue: str = ", ") -> Column:
    return F.array_join(F.transform(names, lambda n: F.concat(F.lit("'"), n, F.lit("'"))), glue)


def plural(n: Column, word: str = "") -> Column:
    return F.when(n == 1, F.lit(word)).otherwise(F.lit(word + "s"))


def text(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)
