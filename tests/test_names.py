import random

from playtide.functions.strings import edit_distance
from playtide.operators.names import edit_pairs


def test_pairs_are_those_of_all_with_all(spark):
    rng = random.Random(3)
    names = {"", "a", "b", "ab", "ba", "abc"}
    for _ in range(60):
        name = "".join(rng.choice("abcde é") for _ in range(rng.choice([3, 8, 9, 10, 11, 19, 20, 29, 30, 31, 45])))
        names.add(name)
        for _ in range(4):  # copies with one to five edits, some beyond the budget
            out = list(name)
            for _ in range(rng.randint(1, 5)):
                at = rng.randrange(len(out) + 1)
                kind = rng.random()
                if kind < 0.4:
                    out.insert(at, rng.choice("abcde"))
                elif out and kind < 0.7:
                    out.pop(min(at, len(out) - 1))
                elif out:
                    out[min(at, len(out) - 1)] = rng.choice("abcde")
            names.add("".join(out))
    want = {(a, b, max(1, max(len(a), len(b)) // 10)) for a in names for b in names if a < b and edit_distance(a, b, 6) <= max(1, max(len(a), len(b)) // 10)}
    found = edit_pairs(spark.createDataFrame([(n,) for n in [*names, *list(names)[:5], None]], "name string"))
    assert {tuple(r) for r in found.collect()} == want and len(want) > 80
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert edit_pairs(spark.createDataFrame([], "name string")).count() == 0
