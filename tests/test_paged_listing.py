"""A page is fetched without listing the others, and places of plays do not depend on one window a user."""

import json

from playtide.plans import queries
from playtide.sources import paged


def test_a_page_is_fetched_from_its_own_folder(tmp_path, monkeypatch):
    for n in range(1, 4):
        folder = tmp_path / "user=u" / f"page={n}"
        folder.mkdir(parents=True)
        (folder / "part.json").write_text(json.dumps({"fetched_at": n, "body": f"b{n}"}))
    service = paged.Landed({"path": f"file://{tmp_path}"})
    listed = []
    names = service._names
    monkeypatch.setattr(service, "_names", lambda *a: listed.append(a) or names(*a))
    assert [service.fetch("u", n) for n in (1, 2, 3)] == [(1, "b1"), (2, "b2"), (3, "b3")]
    assert not listed


def test_pages_are_numbered_over_blocks(spark, tmp_path):
    rows = [(i * 37, f"2024-01-0{1 + i % 9} 00:00:00", 8 * (i % 3), "play") for i in range(3000)]
    events = spark.createDataFrame(rows, "event_id long, t string, user_id long, event_type string").selectExpr("event_id", "CAST(t AS timestamp_ntz) AS ts", "user_id", "event_type")
    events.write.parquet(f"{tmp_path}/events.parquet")
    got = queries._pages(spark, str(tmp_path))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    numbered = [line for line in plan.splitlines() if "row_number()" in line and "windowspecdefinition" in line]
    assert numbered and all("block" in line for line in numbered)
    assert sorted((r.user, r.page) for r in got.collect()) == [("u0", n) for n in range(1, 16)]
    assert all(json.loads(r.body)["recenttracks"]["@attr"] == {"total": "3000", "totalPages": "16"} for r in got.collect())
