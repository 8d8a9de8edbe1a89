import unicodedata

from pyspark.sql import functions as F

from playtide.functions import keys
from playtide.operators import artists
from playtide.operators.cells import cells_of
from playtide.sources import plays, state


def test_state_is_saved_loaded_and_cleared_by_user(spark, tmp_path):
    path = f"{tmp_path}/state"
    one = spark.createDataFrame([("a/b", 3, 9, 4, 100), ("c", 1, 1, None, 50)], "user string, fetched long, total_pages long, next_page long, anchor long")
    state.save_state(one, path, 10)
    state.save_state(one.filter("user = 'c'").withColumn("fetched", F.lit(7).cast("long")), path, 20)
    assert {r.user: (r.fetched, r.next_page, r.saved) for r in state.load_state(spark, path).collect()} == {"a/b": (3, 4, 10), "c": (7, None, 20)}
    state.clear_state(spark, path, ["a/b"])
    assert [r.user for r in state.load_state(spark, path).collect()] == ["c"]
    state.clear_state(spark, path)
    state.save_state(one, path, 30)
    assert state.load_state(spark, path).count() == 2


def test_failed_calls_are_no_answers(spark):
    asked = spark.createDataFrame([("A", "x"), ("A", "y"), ("A", "z")], "artist string, track string")
    answers = spark.createDataFrame([("A", "x", True), ("A", "y", False)], "artist string, track string, shared boolean")
    rel = spark.createDataFrame([("A", "x", 2, "g2", "Two", "Album", [], "2001", "Official", "spotify"), ("A", "x", 1, "g1", "One", "Album", [], "2000", "Official", "spotify")],
                                "artist string, track string, ord long, rg_id string, title string, primary string, secondary array<string>, first_release string, status string, source string")
    got = {r.track: r for r in state.track_answers(asked, answers, rel).collect()}
    assert [g.rg_id for g in got["x"].groups] == ["g1", "g2"] and (got["x"].tier, got["x"].shared, got["x"].error) == ("exact", True, False)
    assert (got["y"].groups, got["y"].tier, got["y"].error) == ([], "none", False)
    assert (got["z"].groups, got["z"].tier, got["z"].error) == (None, None, True)


def test_names_that_differ_by_case_alone_are_no_variants_however_composed(spark):
    names = ["Björk", unicodedata.normalize("NFD", "BJÖRK"), "Sigur Rós", "Sigur Ros"]
    log = spark.createDataFrame([("u", i, 1000 + i, a, "Album", f"t{i}", "", "", "") for i, a in enumerate(names)], plays.SCHEMA)
    got = artists.exact_variants(cells_of(log)).collect()
    assert [{x.artist for x in r.kept} for r in got] == [{"Sigur Rós", "Sigur Ros"}]


def test_every_character_of_the_query_syntax_is_escaped(spark):
    text = 'a\\b+c-d!e(f)g{h}i[j]k^l"m~n*o?p:q/r&s|t u.v'
    got = spark.createDataFrame([(text,)], "t string").select(keys.query_escape(F.col("t")).alias("t")).first().t
    assert got == "".join("\\" + c if c in keys.QUERY_SYNTAX else c for c in text)
