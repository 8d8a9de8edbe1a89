import json

import pytest

from playtide.sources import paged, plays


def page(user, n, times):
    tracks = [{"name": f"t{t}", "artist": {"#text": user.upper()}, "album": {"#text": ""}, "date": {"uts": str(t)}} for t in times]
    return {"user": user, "page": n, "fetched_at": 1, "body": json.dumps({"recenttracks": {"@attr": {"total": "9", "totalPages": "9"}, "track": tracks}})}


def land(spark, path, *pages, fetched=1):
    rows = [(p["user"], p["page"], fetched, p["body"]) for p in pages]
    spark.createDataFrame(rows, plays.PAGE_SCHEMA).write.partitionBy("user", "page").mode("append").json(path)


def found(pages):
    return sorted((r.user, r.uts) for r in plays.flatten_pages(pages).collect())


def test_batch_reads_what_there_is(spark, tmp_path):
    paged.register(spark)
    path = f"file://{tmp_path}/landing"
    land(spark, path, *[page("a/b c", n, [100 - n]) for n in range(1, 8)], page("v", 1, [7]), page("v", 3, [5]))
    land(spark, path, page("v", 1, [8]), fetched=2)
    read = spark.read.format("play_pages").option("path", path)
    rows = read.option("pages_per_partition", 3).load()
    assert rows.rdd.getNumPartitions() == 4  # three ranges of one user, one of the other
    assert found(rows) == [("a/b c", 100 - n) for n in range(7, 0, -1)] + [("v", 8)]  # the newer copy; nothing behind the gap
    assert found(read.option("users", '["v"]').load()) == [("v", 8)]
    assert read.option("users", '["nobody"]').load().count() == 0


class Flaky:
    """Three pages, of which the second fails until there is a file that says otherwise."""

    def __init__(self, options):
        self.fixed = options["fixed"]

    def users(self):
        return ["u"]

    def last_page(self, user):
        return 3

    def fetch(self, user, n):
        import os

        if n == 2 and not os.path.exists(self.fixed):
            raise paged.PageError("HTTP 500")
        return 1, page(user, n, [50 - n])["body"]


def test_a_failing_page_keeps_what_came_and_is_asked_for_again(spark, tmp_path):
    paged.register(spark)
    options = {"service": "tests.test_paged:Flaky", "fixed": f"{tmp_path}/fixed", "retries": "2", "pages_per_partition": "1"}
    rows = spark.read.format("play_pages").options(**options).load()
    assert found(rows) == [("u", 47), ("u", 49)] and found(paged.unbroken(rows)) == [("u", 49)]
    store, mark = f"file://{tmp_path}/store", f"file://{tmp_path}/mark"
    with pytest.raises(Exception, match="HTTP 500"):
        paged.walk(spark, store, mark, **options).awaitTermination()
    (tmp_path / "fixed").write_text("")
    paged.walk(spark, store, mark, **options).awaitTermination()
    assert found(paged.walked(spark, store)) == [("u", 47), ("u", 48), ("u", 49)]


def test_a_walk_goes_on_from_its_offset(spark, tmp_path):
    path, store, mark = (f"file://{tmp_path}/{x}" for x in ("landing", "store", "mark"))
    go = lambda: paged.walk(spark, store, mark, path=path).awaitTermination()
    land(spark, path, page("u", 1, [90]), page("u", 2, [80]), page("u", 4, [60]))
    go()
    assert found(paged.walked(spark, store)) == [("u", 80), ("u", 90)]
    land(spark, path, page("u", 3, [70]), page("v", 1, [5]))
    go()
    go()
    rows = paged.walked(spark, store)
    assert found(rows) == [("u", 60), ("u", 70), ("u", 80), ("u", 90), ("v", 5)] and rows.count() == 5
