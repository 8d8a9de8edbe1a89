"""D1's pairs: names are compared once a pair, and artists of a widespread title meet in parts."""

from playtide.operators import artists
from playtide.operators.cells import cells_of, partition_eras
from playtide.sources import plays as source


def log(spark, names):
    rows = [("u", i * 100 + j, i * 1000 + j, name, "An Album", title, "", "", "") for i, name in enumerate(names) for j, title in enumerate(["Intro"] * (1 + 9 * (i % 2)) + [f"Song {i // 4}"])]
    return partition_eras(cells_of(spark.createDataFrame(rows, source.SCHEMA)))


def below(plan: str, mark: str) -> list[str]:
    """Lines of the plan's nodes that hold the mark, and of all below them."""
    lines, found = plan.splitlines(), []
    for i, line in enumerate(lines):
        if mark in line:
            depth = len(line) - len(line.lstrip(" :+-"))
            found.append(line)
            for more in lines[i + 1 :]:
                if len(more) - len(more.lstrip(" :+-")) <= depth:
                    break
                found.append(more)
    return found


def test_names_are_compared_after_titles_are_counted(spark):
    plan = artists.fuzzy_pairs(log(spark, ["Alpha Band", "Alpha Bandd"]))._jdf.queryExecution().optimizedPlan().toString()
    counted = below(plan, "AS shared#")
    assert counted and "levenshtein" in plan
    assert not [line for line in counted if "levenshtein" in line]


def test_artists_of_one_title_meet_in_parts(spark, monkeypatch):
    names = [f"{base}{tail}" for base in ("Alpha Band", "Bravo Choir", "Cello Trio") for tail in ("", "s", "ss", " x")]
    rest = log(spark, names)
    whole = sorted(map(str, artists.fuzzy_pairs(rest).collect()))
    monkeypatch.setattr(artists, "PART", 2)
    assert len(whole) > 5 and sorted(map(str, artists.fuzzy_pairs(rest).collect())) == whole
