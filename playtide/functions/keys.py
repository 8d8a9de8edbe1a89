"""The scalar functions on DataFrames: Arrow UDFs over distinct strings, built-ins elsewhere."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from playtide.functions import eras, strings, titles

KEYS = (
    "artist_key string, artist_fold string, artist_lower string, album_key string, album_title string, track_key string, track_title string, track_id string, "
    "track_base string, base_id string, credits array<string>, era_explicit boolean, era_weak boolean, era_ambiguous boolean, "
    "era_name string, era_key string, undifferentiated boolean, kind string, structural boolean, single_shaped boolean"
)


_TYPES = {"string": T.StringType(), "boolean": T.BooleanType(), "double": T.DoubleType(), "array<string>": T.ArrayType(T.StringType())}


def fields(spec: str) -> T.StructType:
    """A struct type from "name type, ..."; unlike a DDL string it needs no session at import."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (c.split(" ") for c in spec.split(", "))])


def _artist_keys(a: str) -> tuple:
    return strings.norm(a), strings.norm_artist(a), unicodedata.normalize("NFC", a).lower()


def _album_keys(b: str) -> tuple:
    e = eras.parse(b)
    return strings.norm(b), strings.norm_title(b), e.explicit, e.weak, e.ambiguous, e.name, strings.norm(e.name), e.undifferentiated, titles.kind_by_name(b), titles.has_single_suffix(b)


def _track_keys(t: str) -> tuple:
    base = titles.base_title(t)
    return strings.norm(t), strings.norm_title(t), strings.track_identity(t), base, strings.track_identity(base), titles.credits(t), titles.is_structural(t), strings.norm(base)


_OF_ARTIST = ("artist_key", "artist_fold", "artist_lower")
_OF_ALBUM = ("album_key", "album_title", "era_explicit", "era_weak", "era_ambiguous", "era_name", "era_key", "undifferentiated", "by_name", "suffix")
_OF_TRACK = ("track_key", "track_title", "track_id", "track_base", "base_id", "credits", "structural", "base_key")


def _by_dictionary(values: pa.Array, fn, names: tuple[str, ...]) -> dict[str, pa.Array]:
    """The keys of all values, each distinct one computed once."""
    coded = pc.fill_null(values, "").dictionary_encode()
    columns = zip(*map(fn, coded.dictionary.to_pylist()), strict=True) if len(coded.dictionary) else ((),) * len(names)
    kind = lambda n: pa.list_(pa.string()) if n == "credits" else pa.bool_() if n.startswith("era_") and n not in ("era_name", "era_key") or n in ("undifferentiated", "suffix", "structural") else pa.string()
    return {n: pa.array(list(c), kind(n)).take(coded.indices) for n, c in zip(names, columns, strict=True)}


@F.arrow_udf(fields(KEYS))
def _keys(artist: pa.Array, album: pa.Array, track: pa.Array) -> pa.Array:
    found = _by_dictionary(artist, _artist_keys, _OF_ARTIST) | _by_dictionary(album, _album_keys, _OF_ALBUM) | _by_dictionary(track, _track_keys, _OF_TRACK)
    full = lambda c: pc.not_equal(pc.fill_null(c, ""), "")
    same = pc.or_(pc.equal(found["album_key"], found["track_key"]), pc.equal(found["album_key"], found["base_key"]))
    after = pc.and_(pc.equal(found["album_title"], found["track_title"]), pc.not_equal(found["by_name"], titles.MISSING))
    found["kind"] = pc.if_else(after, pa.scalar(titles.AFTER_TRACK), found["by_name"])
    found["single_shaped"] = pc.and_(pc.and_(full(album), full(track)), pc.or_(found["suffix"], pc.and_(full(found["album_key"]), same)))
    names = [c.split()[0] for c in KEYS.split(", ")]
    return pa.StructArray.from_arrays([found[n] for n in names], names)


def with_keys(cells: DataFrame) -> DataFrame:
    """cells(artist, album, track, ...) with all comparison keys, in one Arrow pass over the distinct names of each batch."""
    return cells.withColumn("__k", _keys("artist", "album", "track")).select(*cells.columns, "__k.*")


def _slices(values: pa.Array, limit: int = 1 << 20) -> Iterator[pa.Array]:
    """Parts of about `limit` bytes of text, one value at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(values):
        stop = max(start + 1, int(np.searchsorted(ends, limit + (ends[start - 1] if start else 0), side="right")))
        yield values.slice(start, stop - start)
        start = stop


def _text_udf(fn, kind: str = "string"):
    """An Arrow UDF that computes each distinct string of a batch once; of long texts a worker holds a few at a time."""
    out = pa.list_(pa.string()) if kind == "array<string>" else pa.string()

    @F.arrow_udf(_TYPES[kind])
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for values in batches:
            if not len(values):
                yield pa.array([], out)
            for part in _slices(values):
                coded = part.dictionary_encode(null_encoding="encode")
                yield pa.array([fn(v) for v in coded.dictionary.to_pylist()], out).take(coded.indices)

    return run


norm = _text_udf(strings.norm)
norm_artist = _text_udf(strings.norm_artist)
norm_title = _text_udf(strings.norm_title)
track_identity = _text_udf(strings.track_identity)
norm_release = _text_udf(strings.norm_release)
base_title = _text_udf(titles.base_title)
edition_key = _text_udf(titles.edition_key)
era_name = _text_udf(lambda v: eras.parse(v).name)
match_keys = _text_udf(titles.match_keys, "array<string>")
credits = _text_udf(titles.credits, "array<string>")
redact = _text_udf(lambda v: None if v is None else strings.redact(v))


def _pair_udf(fn, kind: str):
    @F.pandas_udf(_TYPES[kind])
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([fn(x or "", y or "") for x, y in zip(a, b, strict=True)])

    return run


similar = _pair_udf(strings.similar, "double")
single_shaped = _pair_udf(titles.single_shaped, "boolean")
album_kind = _pair_udf(titles.album_kind, "string")
contains_name = _pair_udf(titles.contains_name, "boolean")
differs_only_by_version = _pair_udf(titles.differs_only_by_version, "boolean")
digits_only_differ = _pair_udf(strings.digits_only_differ, "boolean")


@F.pandas_udf(_TYPES["boolean"])
def plausible_pre_release(earlier: pd.Series, later: pd.Series, track: pd.Series) -> pd.Series:
    return pd.Series([titles.plausible_pre_release(a or "", b or "", t or "") for a, b, t in zip(earlier, later, track, strict=True)])


@F.pandas_udf(fields("kind string, head string, parts array<string>"))
def artist_credit(artist: pd.Series) -> pd.DataFrame:
    rows = [(titles.artist_credit(a or ""), titles.artist_head(a or ""), titles.artist_parts(a or "")) for a in artist]
    return pd.DataFrame(rows, columns=["kind", "head", "parts"])


# Built-ins.


def typo_budget(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.greatest(F.length(a), F.length(b)) / 10)).cast("int")


def within_edits(a: Column, b: Column, limit: Column | int) -> Column:
    """Whether a and b are at most `limit` edits apart."""
    return F.levenshtein(a, b) <= limit


def may_share_key(a: Column, b: Column) -> Column:
    """False only for names with different norm() and norm_title(), by built-ins.

    Those of ASCII names keep letters and their order but for case, and a gap where there is one: so does soundex(),
    which wants a letter at the start.
    """
    plain = lambda c: (F.octet_length(c) == F.char_length(c)) & (F.ascii(c).between(65, 90) | F.ascii(c).between(97, 122))
    return (F.soundex(a) == F.soundex(b)) | ~plain(a) | ~plain(b)


def ratio_bound(a: Column, b: Column) -> Column:
    """At least the ratio of similar(): twice the letters that both names hold, however placed, over all.

    Characters count as code points, of which one beyond the basic plane is two units to similar(): such names are given 1.
    """
    letters = F.array_distinct(F.split(a, ""))
    many = lambda x, c: F.length(x) - F.length(F.replace(x, c, F.lit("")))
    common = F.aggregate(letters, F.lit(0), lambda n, c: n + F.when(c == "", 0).otherwise(F.least(many(a, c), many(b, c))))
    wide = F.rlike(F.concat(a, b), F.lit("[^\\x00-\\uFFFF]"))
    whole = F.length(a) + F.length(b)
    return F.when(wide | (whole == 0), 1.0).otherwise(2.0 * common / whole)


def utc(uts: Column) -> Column:
    """Epoch seconds as a UTC wall clock, whatever the session's time zone."""
    return F.timestamp_add("SECOND", uts, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def month(uts: Column) -> Column:
    return F.date_format(utc(uts), "yyyy-MM")


def month_name(uts: Column) -> Column:
    return F.date_format(utc(uts), "MMM yyyy")


def minute_stamp(uts: Column) -> Column:
    return F.concat(F.date_format(utc(uts), "yyyy-MM-dd HH:mm"), F.lit(" UTC"))


def hour_stamp(hour: Column) -> Column:
    """Label of an hour number (epoch seconds over 3600)."""
    return F.date_format(utc(hour * 3600), "yyyy-MM-dd HH:00")


def explicit_era(album: Column) -> Column:
    """eras.parse(album).explicit, built in: a strong marker, or a bracket that ends in a qualifier."""
    space = strings.SPACE
    words = "|".join(sorted(eras.QUALIFIERS, key=len, reverse=True))
    return album.rlike(f"(?i){eras.STRONG}") | album.rlike(rf"(?i)[(\[](?:[^)\]]*[{space}])?(?:{words})[{space}]*[)\]]")


#: Characters with a meaning in the query syntax of the release database.
QUERY_SYNTAX = '\\+-!(){}[]^"~*?:/&|'


def query_escape(text: Column) -> Column:
    """A phrase for a Lucene query: every character of its syntax escaped."""
    return F.regexp_replace(text, "([" + "".join("\\" + c for c in QUERY_SYNTAX) + "])", r"\\$1")


def library_link(user: Column, artist: Column, album: Column | None = None, track: Column | None = None) -> Column:
    """Library page of an artist, album or track; null without a user or an artist."""
    enc = lambda c: F.url_encode(c)
    base = F.concat(F.lit("https://www.last.fm/user/"), enc(user), F.lit("/library/music/"), enc(artist))
    if track is not None:
        base = F.when(F.coalesce(track, F.lit("")) != "", F.concat(base, F.lit("/_/"), enc(track))).otherwise(base)
    elif album is not None:
        known = (F.coalesce(album, F.lit("")) != "") & (album != strings.NO_ALBUM)
        base = F.when(known, F.concat(base, F.lit("/"), enc(album)))
    ok = (F.coalesce(F.trim(user), F.lit("")) != "") & (F.coalesce(F.trim(artist), F.lit("")) != "")
    return F.when(ok, base)
