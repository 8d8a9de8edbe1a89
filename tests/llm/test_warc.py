import hashlib
import random

import duckdb
import pytest

from playtide.llm import warc


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    body = "<p>é word\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n</p>" * 4
    out = [(i, f"http://www.a{rng.randrange(9)}.example.com/p/{rng.randrange(30)}?q={i % 3}", f"<html>{rng.random()}</html>" * rng.randint(0, 9)) for i in range(80)]
    out += [(80 + i, "https://hot.example.org/", body) for i in range(40)]
    return out + [(200, None, None), (201, "http://[bad", ""), (202, "http://x y/é\n", "short"), (203, "-", "short"), (204, "http://b.example", "x\ny\n\n" * 30), (205, "q", "\r\n\r\n")]


def want(rows):
    first = {}
    for i, _, h in sorted(rows, key=lambda r: r[0]):
        first.setdefault(h or "", i)
    out = {}
    for i, _, h in rows:
        data = (h or "").encode()
        again = len(data) >= 100 and first[h or ""] != i
        out[i] = (len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[h or ""] if again else None)
    return out


@pytest.fixture(scope="module")
def found(spark, rows, tmp_path_factory):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, digest string, first int").repartition(4)
    return warc.archive(df, f"file://{tmp_path_factory.mktemp('w')}/a").collect()


def test_records(found, rows):
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found} == want(rows) and len(found) == len(rows)


def test_index_is_in_global_order(found):
    order = [(r.url_key, r.time, r.page_id) for r in sorted(found, key=lambda r: (r.shard, r.place))]
    assert order == sorted(order)


def test_sql_agrees(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    assert {r[0]: r[1:] for r in con.sql(warc.ORACLE).fetchall()} == want(rows)


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 16])
def test_loser_tree(k):
    rng = random.Random(k)
    runs = [sorted(rng.randrange(50) for _ in range(rng.randint(0, 30))) for _ in range(k)]
    assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_damage_and_empty(spark, tmp_path):
    text = warc.record(1, "http://a", "abc", "00", 3, None) + warc.BREAK
    assert [b for _, _, b in warc.parse(text.encode())] == [b"abc"]
    with pytest.raises(ValueError):
        list(warc.parse(text.replace("Content-Length: 3", "Content-Length: 2").encode()))
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive(empty, f"file://{tmp_path}/e").count() == 0


def test_url_keys():
    assert warc.url_key("http://www.A.example.com/X?y=1") == "com,example,a)/x?y=1" and warc.url_key("") == "-" and warc.url_key("urn:none") == "-"


def test_null_and_repeated_page_ids(spark, tmp_path):
    one, two, three = "<p>one</p>" * 20, "<p>two</p>" * 20, "<p>three</p>" * 20
    rows = [(1, "u", one), (2, "u", two), (5, "u", one), (5, "u", two), (5, "u", three), (5, "u", "short"), (None, "u", three), (None, "u", one), (0, "u", None), (None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = warc.archive(df, f"file://{tmp_path}/a").collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    assert sorted(map(repr, con.sql(warc.ORACLE).fetchall())) == sorted(repr((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got)
    assert {r.payload_digest for r in got if r.record_type == "response"} == {r.payload_digest for r in got}
