import glob
import os
import random

import pytest

from playtide.llm import warc


@pytest.mark.parametrize("seed", range(6))
def test_blocks_are_merged_with_little_held(seed):
    rng = random.Random(seed)
    runs = [sorted((rng.randrange(300), r, i) for i in range(rng.randint(0, 400))) for r in range(9)]
    blocks = sorted((x[i : i + 20][0], r, x[i : i + 20]) for r, x in enumerate(runs) for i in range(0, len(x), 20))
    taken = 0

    def feed():
        nonlocal taken
        for _, r, b in blocks:
            taken += len(b)
            yield r, b

    given, most = [], 0
    for x in warc.merge_blocks(feed()):
        given.append(x)
        most = max(most, taken - len(given))
    assert given == sorted(y for x in runs for y in x)
    assert most <= 20 * 9 * 2  # about a block a run


def test_order_over_many_runs_ranges_and_a_hot_key(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, "http://hot.example/" if i % 3 == 0 else f"http://h{rng.randrange(40)}.example/{rng.randrange(9)}", f"<p>{rng.randrange(500)}</p>" * 12) for i in range(3000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    warc.write(warc.plan_records(df), f"file://{tmp_path}/a", bytes_per_file=20_000)
    files = [f for f in glob.glob(f"{tmp_path}/a/*.txt") if os.path.getsize(f)]
    assert len(files) > 20 and max(map(os.path.getsize, files)) < 21_000
    captures = warc.read(spark, f"file://{tmp_path}/a").cache()
    merged = warc.merge_index(captures, least_ranges=9, block=50).collect()
    order = [(r.url_key, r.time, r.page_id) for r in sorted(merged, key=lambda r: (r.shard, r.place))]
    assert order == sorted(order) and sorted(x[2] for x in order) == list(range(3000))
    sizes = {s: sum(r.shard == s for r in merged) for s in {r.shard for r in merged}}
    assert len(sizes) == 9 and max(sizes.values()) < 900
    assert {(r.page_id, r.payload_digest, r.refers_to) for r in merged} == {(r.page_id, r.payload_digest, r.refers_to) for r in captures.collect()}
    captures.unpersist()


def test_the_query_with_a_very_long_page(spark, tmp_path):
    rows = [(1, "http://a/", "x" * 3_000_000, 1), (2, None, "x" * 3_000_000, 2), (None, "u", None, 3)]
    spark.createDataFrame(rows, "page_id long, url string, html string, shard int").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r for r in warc.op10_warc_merge(spark, str(tmp_path)).collect()}
    assert got[1].record_type == "response" and got[2].refers_to == 1 and got[2].payload_bytes == 3_000_000 and got[None].payload_bytes == 0
