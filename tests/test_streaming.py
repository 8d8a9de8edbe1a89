import json

from playtide.sources import plays as source
from playtide.streaming import ingest


def page(user, n, plays, fetched=1, total=3, single=False):
    tracks = [{"name": t, "mbid": "", "artist": {"#text": a, "mbid": ""}, "album": {"#text": b}, "date": {"uts": str(u)}} for u, a, b, t in plays]
    body = {"recenttracks": {"@attr": {"total": "500", "totalPages": str(total)}, "track": tracks[0] if single else tracks}}
    return {"user": user, "page": n, "fetched_at": fetched, "body": json.dumps(body)}


def land(folder, name, *pages):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(p) + "\n" for p in pages))


def test_pages_are_taken_once_and_replaced(spark, tmp_path):
    landing, store, mark = tmp_path / "landing", f"file://{tmp_path}/store", f"file://{tmp_path}/mark"
    land(landing, "a.json", page("u", 1, [(100, "A ", "", "x"), (90, "A", "B", "y")]), page("u", 2, [(80, "C", "D", "z")], single=True))
    ingest.ingest_pages(spark, str(landing), store, mark).awaitTermination()
    got = sorted((r.uts, r.artist, r.album, r.track) for r in ingest.latest_plays(spark, store).collect())
    assert got == [(80, "C", "D", "z"), (90, "A", "B", "y"), (100, "A", "", "x")]
    land(landing, "b.json", page("u", 2, [(80, "C", "D", "z2")], fetched=2))
    ingest.ingest_pages(spark, str(landing), store, mark).awaitTermination()
    assert sorted(r.track for r in ingest.latest_plays(spark, store).collect()) == ["x", "y", "z2"]


def test_flatten_and_resume(spark, tmp_path):
    odd = page("u", 1, [(100, "A", "", "x")])
    body = json.loads(odd["body"])
    body["recenttracks"]["track"] += [{"name": "now", "artist": {"name": "N"}, "@attr": {"nowplaying": "true"}}, {"name": "undated", "artist": {"#text": "U"}}, {"name": " n ", "artist": {"name": "By name", "mbid": "id"}, "date": {"uts": "70"}}]
    odd["body"] = json.dumps(body)
    land(tmp_path / "l", "a.json", odd, page("v", 1, [(50, "Z", "", "q")], total=1))
    rows = source.read_pages(spark, str(tmp_path / "l"))
    assert sorted((r.user, r.uts, r.artist, r.track, r.artist_mbid) for r in rows.collect()) == [("u", 70, "By name", "n", "id"), ("u", 100, "A", "x", ""), ("v", 50, "Z", "q", "")]
    assert source.read_pages(spark, str(tmp_path / "l"), until=70).count() == 2
    points = {r.user: r for r in source.resume_points(spark.read.schema(source.PAGE_SCHEMA).json(str(tmp_path / "l"))).collect()}
    assert points["u"].next_page == 2 and points["u"].anchor == 69 and points["v"].next_page is None


def test_store_replaces_one_user(spark, tmp_path):
    path = f"file://{tmp_path}/plays"
    rows = lambda u, n: spark.createDataFrame([(u, i, i, "A", "B", "t", "", "", "") for i in range(n)], source.SCHEMA)
    source.store_plays(rows("u", 5).union(rows("v", 2)), path)
    source.store_plays(rows("u", 3), path)
    assert {r["user"]: r["count"] for r in source.load_plays(spark, path).groupBy("user").count().collect()} == {"u": 3, "v": 2}


COLUMNS = "user string, seq long, uts long, artist string, track string"


def arrive(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(dict(zip(["user", "seq", "uts", "artist", "track"], r, strict=True))) + "\n" for r in rows))


def repeats(spark, folder, out, **options):
    """One run to the end of what has arrived, from the checkpoint of the run before."""
    stream = spark.readStream.schema(COLUMNS).json(str(folder))
    write = lambda batch, n: batch.write.mode("overwrite").parquet(f"file://{out}/found/batch={n}")
    with ingest.rocks(spark):
        query = ingest.adjacent_repeats(stream, **options).writeStream.foreachBatch(write).option("checkpointLocation", f"file://{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return sorted((r.user, r.uts, r.previous_uts) for r in spark.read.parquet(f"file://{out}/found").collect())


def test_stateful_repeats_over_batches(spark, tmp_path):
    landing = tmp_path / "plays"
    arrive(landing, "1.json", [("u", 0, 10, "A", "x"), ("u", 1, 30, "a", "X"), ("u", 2, 40, "A", "y"), ("v", 4, 31, "A", "x"), ("u", 6, 3590, "A", "z"), ("v", 9, 3595, "B", "q")])
    assert repeats(spark, landing, tmp_path, stretch=3600) == []  # the hour is not over
    # A late play of u parts two others, one makes a repeat across the hour; v's second play joins its hour.
    arrive(landing, "2.json", [("u", 5, 20, "A", "other"), ("u", 7, 3605, "A", "Z"), ("v", 8, 45, "A", "x"), ("w", 10, 9 * 3600, "A", "x")])
    assert repeats(spark, landing, tmp_path, stretch=3600) == [("u", 3605, 3590), ("v", 45, 31)]
    # After the watermark a play is too late, and the state of the hours that are over is gone.
    arrive(landing, "3.json", [("v", 11, 50, "A", "x"), ("w", 12, 9 * 3600 + 5, "A", "x"), ("w", 13, 30 * 3600, "A", "q")])
    assert repeats(spark, landing, tmp_path, stretch=3600) == [("u", 3605, 3590), ("v", 45, 31), ("w", 32405, 32400)]


def test_a_clock_ahead_does_not_move_the_watermark(spark, tmp_path):
    landing = tmp_path / "plays"
    rows = [("u", 0, 10, "A", "x"), ("u", 1, 10**9, "A", "ahead")]
    folder = tmp_path / "plain"
    arrive(folder, "1.json", rows)
    repeats(spark, folder, tmp_path / "p", stretch=3600)
    arrive(folder, "2.json", [("u", 2, 25, "A", "x"), ("u", 3, 2 * 10**9, "A", "y")])
    assert repeats(spark, folder, tmp_path / "p", stretch=3600) == []  # too late for a watermark that followed the play
    landing.mkdir()
    timed = lambda name, rs: (landing / name).write_text("".join(json.dumps({"user": u, "seq": s, "uts": t, "artist": a, "track": x, "fetched_at": f}) + "\n" for u, s, t, a, x, f in rs))

    def run():
        stream = spark.readStream.schema(COLUMNS + ", fetched_at long").json(str(landing))
        write = lambda batch, n: batch.write.mode("overwrite").parquet(f"file://{tmp_path}/f/batch={n}")
        with ingest.rocks(spark):
            query = ingest.adjacent_repeats(stream, stretch=3600, arrival="fetched_at").writeStream.foreachBatch(write).option("checkpointLocation", f"file://{tmp_path}/s").trigger(availableNow=True).start()
        query.awaitTermination()
        return [(r.uts, r.previous_uts) for r in spark.read.parquet(f"file://{tmp_path}/f").collect()]

    timed("1.json", [(*r, 20) for r in rows])
    assert run() == []
    timed("2.json", [("u", 2, 25, "A", "x", 30), ("u", 3, 40_000, "A", "y", 40_000)])
    assert run() == [(25, 10)]


def test_counts_by_hour_take_late_plays(spark, tmp_path):
    landing, store, mark = tmp_path / "plays", f"file://{tmp_path}/store", f"file://{tmp_path}/mark"
    read = lambda: spark.readStream.schema(COLUMNS).json(str(landing))
    arrive(landing, "1.json", [("u", i, 3600 * 500 + i, "A", "x") for i in range(3)] + [("u", 9, 3600 * 9000, "A", "x")])
    ingest.count_hours(read(), store, mark).awaitTermination()
    arrive(landing, "2.json", [("u", i, 3600 * 500 + 60 * i, "A", "x") for i in range(3, 6)])
    ingest.count_hours(read(), store, mark).awaitTermination()
    ingest.count_hours(read(), store, mark).awaitTermination()
    assert [tuple(r) for r in ingest.counted_bursts(spark, store, most=5).collect()] == [("u", 500, 6)]


def test_hourly_window(spark, tmp_path):
    landing = tmp_path / "plays"
    landing.mkdir()
    rows = [{"user": "u", "uts": 3600 * 5 + i} for i in range(7)] + [{"user": "u", "uts": 3600 * 9}]
    (landing / "1.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
    stream = spark.readStream.schema("user string, uts long").json(str(landing))
    q = ingest.hourly_bursts(stream, most=5).writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.user, r.plays) for r in spark.table("bursts").collect()] == [("u", 7)]
