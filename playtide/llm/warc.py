"""WARC archives with revisit records, and a capture index merged from sorted runs.

Pages with equal payloads of at least 100 bytes are captured once: the smallest page_id is the
response, the rest are revisits that name it.  Records are written with Spark's text writer
(the record separator, two line ends, is its line separator), so archives land wherever Spark
can write and an executor's loss repeats only its files; they are read back as whole binary
files and parsed by their Content-Length.

The index is merged externally.  Captures are sorted in each task, a run each, and cut into blocks
that end at common boundaries of the key ranges.  A key range gets its blocks in the order of
their first keys, so a block is needed only once all smaller keys are out: what is held is about a
block a run, whatever the range's size.  A loser tree merges what is held and yields capture
histories in global order (URL key, then time, then page), over ranges that are ordered among
themselves.  Blocks carry whole captures, so what is merged is the result.

Defined results: null html is an empty payload and a response; null or odd URLs get the key "-";
repeated page_ids are written each, by their own payload; a null page_id is a response of the
time zero, named "none", and nothing refers to it; an empty table gives no rows; extra columns are ignored;
very long pages are kept whole, in an archive of their own if need be.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playtide.llm.common import chunked, materialise, read_table, record_batch, shared_path

LEAST = 100
#: Stands for a null page_id where captures are ordered: before all others.
_NO_ID = -(1 << 63)
BREAK = "\r\n\r\n"
_SAFE = re.compile(r"[\x00-\x20\x7f]")


def plan_records(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str | None = "url") -> DataFrame:
    """(page_id, url, html, digest, size, refers_to): refers_to is null for responses.

    Digests are grouped with the smallest id first; only ids and digests are shuffled for that.
    Runs that job at once.
    """
    url = F.col(url_col).cast("string") if url_col else F.lit(None).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    sized = rows.select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("digest"), F.octet_length("html").cast("long").alias("size"))
    first = sized.filter(F.col("size") >= LEAST).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    shared = sized.filter(F.col("size") >= LEAST).join(first, "digest").filter("page_id > first").select("page_id", "digest", "first").distinct()
    # stored first, so that its size is known: while it is small Spark broadcasts it and pages stay where they are
    shared = materialise(shared, "revisits")
    marked = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)).join(shared, ["page_id", "digest"], "left")
    return marked.select("page_id", "url", "html", "digest", F.octet_length("html").cast("long").alias("size"), F.col("first").alias("refers_to"))


def capture_time(page_id: int | None) -> str:
    """Pages carry no time; captures are dated by their ids, a second each."""
    return datetime.fromtimestamp((page_id or 0) % (1 << 31), UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def record(page_id: int | None, url: str | None, html: str, digest: str, size: int, refers_to: int | None) -> str:
    """One record without the final break: headers, break, block."""
    target = _SAFE.sub(lambda m: f"%{ord(m[0]):02X}", url or "") or "urn:none"
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>", f"WARC-Date: {capture_time(page_id)}", f"WARC-Target-URI: {target}"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    block = html if refers_to is None else ""
    lines += [f"Content-Type: text/html; charset=utf-8\r\nContent-Length: {len(block.encode())}"]
    return "\r\n".join(lines) + BREAK + block


def write(planned: DataFrame, path: str, bytes_per_file: int = 32 << 20) -> None:
    """Write planned records as .warc text under path; a file ends with the record that reaches its size."""
    schema = pa.schema([("value", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        size = 0
        for batch in chunked(batches, column="html"):
            cols = [batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "size", "refers_to")]
            for r in zip(*cols, strict=True):
                held.append(record(*r))
                size += len(held[-1])
                if size >= bytes_per_file:
                    yield record_batch(schema, {"value": [BREAK.join(held)]})
                    held, size = [], 0
        if held:
            yield record_batch(schema, {"value": [BREAK.join(held)]})

    planned.mapInArrow(run, "value string").write.option("lineSep", BREAK).option("maxRecordsPerFile", 1).text(path)


def parse(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of each record of an archive."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:stop].decode().split("\r\n")
        if first != "WARC/1.1":
            raise ValueError(f"no record at {at}")
        headers = dict(x.split(": ", 1) for x in lines)
        begin = stop + 4
        end = begin + int(headers["Content-Length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"record at {at} does not end where it says")
        yield at, headers, data[begin:end]
        at = end + 4


def _page(urn: str) -> int | None:
    name = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if name == "none" else int(name)


def url_key(url: str) -> str:
    """Host labels reversed, then path and query: keys of one site stand together."""
    try:
        parts = urlsplit(url.strip().lower())
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return "-"
    if not host:
        return "-"
    return ",".join(reversed(host.split("."))) + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(file, page_id, url, time, record_type, payload_bytes, payload_digest, refers_to, offset, length, url_key).

    A response's digest and size are taken from its block and held against its headers.
    """
    names = {"file": pa.string(), "page_id": pa.int64(), "url": pa.string(), "time": pa.string(), "record_type": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.int64(), "offset": pa.int64(), "length": pa.int64(), "url_key": pa.string()}
    schema = pa.schema(list(names.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                out = {n: [] for n in names}
                for at, h, block in parse(data):
                    kind = h["WARC-Type"]
                    digest, size = h["WARC-Payload-Digest"].removeprefix("sha256:"), int(h["X-Payload-Length"])
                    if kind == "response":
                        if hashlib.sha256(block).hexdigest() != digest or len(block) != size:
                            raise ValueError(f"{file}: the record at {at} is damaged")
                    row = (file, _page(h["WARC-Record-ID"]), h["WARC-Target-URI"], h["WARC-Date"], kind, size, digest, _page(h["WARC-Refers-To"]) if kind == "revisit" else None, at, len(block), url_key(h["WARC-Target-URI"]))
                    for n, x in zip(names, row, strict=True):
                        out[n].append(x)
                yield record_batch(schema, out)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter("length > 0").select("path", "content")
    ddl = ", ".join(f"{n} {'string' if t == pa.string() else 'long'}" for n, t in names.items())
    return files.mapInArrow(run, ddl)


class LoserTree:
    """Merges k sorted sequences; each step replays one path of the tree of losers."""

    _END = object()

    def __init__(self, runs: list[list]):
        self.runs = [iter(r) for r in runs]
        self.k = len(runs)
        self.head = [next(r, self._END) for r in self.runs]
        self.tree = [-1] * self.k
        for i in range(self.k):
            self._play(i, True)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        if x is self._END or y is self._END:
            return y is self._END and (x is not self._END or a < b)
        return x < y or (x == y and a < b)

    def _play(self, i: int, building: bool) -> None:
        node = (i + self.k) // 2
        while node:
            held = self.tree[node]
            if building and held < 0:
                self.tree[node] = i
                return
            if held >= 0 and self._beats(held, i):
                self.tree[node], i = i, held
            node //= 2
        self.tree[0] = i

    def __iter__(self) -> Iterator:
        while self.k and (x := self.head[self.tree[0]]) is not self._END:
            yield x
            i = self.tree[0]
            self.head[i] = next(self.runs[i], self._END)
            self._play(i, False)


def merge_blocks(blocks: Iterator[tuple[int, list[tuple]]]) -> Iterator[tuple]:
    """All rows of the blocks in order.  blocks: (run, sorted rows), by first rows; a run's blocks follow one another."""
    held: dict[int, list[tuple]] = {}
    for run, rows in blocks:
        ready = []
        for r, have in list(held.items()):
            k = bisect.bisect_left(have, rows[0])
            ready.append(have[:k])
            held[r] = have[k:]
            if not held[r]:
                del held[r]
        yield from LoserTree([x for x in ready if x])
        held.setdefault(run, []).extend(rows)
    yield from LoserTree(list(held.values()))


#: What orders captures, and what else the index has of them.
ORDER = ("url_key", "time", "page_id", "file", "offset")
REST = ("length", "url", "record_type", "payload_bytes", "payload_digest", "refers_to")


def merge_index(captures: DataFrame, least_ranges: int = 24, rows_per_range: int = 1_000_000, block: int = 2_000) -> DataFrame:
    """(shard, place, and the columns of captures) in global order by (shard, place).

    captures: a stored table as read() gives it.  Range boundaries come from the keys' own
    distribution, some twenty keys a range; a range with one very common key is cut further by
    time and page.
    """
    spark = captures.sparkSession
    rows = captures.select(*ORDER, *REST).withColumn("page_id", F.coalesce("page_id", F.lit(_NO_ID)))
    total = rows.count()
    ranges = max(least_ranges, -(-total // rows_per_range))
    # a sample only says where to cut; every capture is merged
    sample = sorted(tuple(r) for r in rows.sample(min(1.0, 20.0 * ranges / max(1, total)), seed=7).select("url_key", "time", "page_id").collect())
    cuts = [sample[len(sample) * i // ranges] for i in range(1, ranges)] if len(sample) >= ranges else []
    shared = spark.sparkContext.broadcast(cuts)
    strings = {"url_key", "time", "file", "url", "record_type", "payload_digest"}
    kind = lambda c: pa.string() if c in strings else pa.int64()
    whole = pa.schema([(c, kind(c)) for c in (*ORDER, *REST)])
    schema = pa.schema([("shard", pa.int32()), *[(c, kind(c)) for c in ORDER], ("run", pa.int64()), ("rows", pa.binary())])
    out = pa.schema([("shard", pa.int64()), ("place", pa.int64()), *whole])

    def sorted_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, run = shared.value, TaskContext.get().partitionId()
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ORDER[:3]), strict=True))
            at, blocks = 0, {f.name: [] for f in schema}
            while at < len(keys):
                shard = bisect.bisect_right(cuts, keys[at])
                end = bisect.bisect_left(keys, cuts[shard], at) if shard < len(cuts) else len(keys)
                part = batch.slice(at, min(block, end - at))
                for c in ORDER:
                    blocks[c].append(part.column(c)[0].as_py())
                blocks["shard"].append(shard)
                blocks["run"].append(run)
                blocks["rows"].append(_packed(part))
                at += part.num_rows
            if keys:
                yield record_batch(schema, blocks)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flat() -> Iterator[tuple[int, int, list[tuple]]]:
            for batch in batches:
                for i in range(batch.num_rows):
                    part = _unpacked(batch.column("rows")[i].as_buffer())
                    yield batch.column("shard")[i].as_py(), batch.column("run")[i].as_py(), list(zip(*(part.column(c).to_pylist() for c in whole.names), strict=True))

        for shard, group in itertools.groupby(flat(), key=lambda x: x[0]):
            place, merged = 0, merge_blocks((run, rows) for _, run, rows in group)
            while some := list(itertools.islice(merged, 10_000)):
                columns = dict(zip(whole.names, map(list, zip(*some, strict=True)), strict=True))
                yield record_batch(out, {"shard": [shard] * len(some), "place": list(range(place, place + len(some)))} | columns)
                place += len(some)

    ddl = ", ".join(f"{f.name} {_ddl(f.type)}" for f in schema)
    runs = rows.sortWithinPartitions(*ORDER).mapInArrow(sorted_blocks, ddl)
    dealt = runs.repartitionById(ranges, "shard").sortWithinPartitions("shard", *ORDER)
    return dealt.mapInArrow(merge, ", ".join(f"{f.name} {_ddl(f.type)}" for f in out)).withColumn("page_id", F.nullif("page_id", F.lit(_NO_ID)))


def _ddl(kind: pa.DataType) -> str:
    return {pa.string(): "string", pa.int32(): "int", pa.binary(): "binary"}.get(kind, "long")


def _packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: pa.Buffer) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def archive(pages: DataFrame, path: str, **columns) -> DataFrame:
    """Write pages as WARC under path, read them back and merge the captures' index: (shard, place, and the columns of read())."""
    write(plan_records(pages, **columns), path)
    return merge_index(materialise(read(pages.sparkSession, path), "records"))


def op10_warc_merge(spark, sf_dir: str) -> DataFrame:
    found = archive(read_table(spark, sf_dir, "pages"), shared_path(spark, "warc"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
         sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM f
"""
