"""The paged play history as a Spark data source: format("play_pages"), for batches and for streams.

A service has, for each user, pages 1, 2, ... of the plays up to a time.  The batch reader plans ranges of pages
and fetches them side by side; the stream reader's offset holds the last page taken of each user, so the
checkpoint is the resume point of a walk that broke off.  Rows have the columns of plays.PAGE_SCHEMA and go through
plays.flatten_pages().

Options: service ("landed", or "module:Class" of another), users (a JSON list; all that the service knows where
absent), pages_per_partition, retries, and what the service itself takes.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from playtide.sources.plays import PAGE_SCHEMA


class PageError(Exception):
    """A page that the service did not give, after all retries."""


class Landed:
    """Pages as files below `path`, in folders user=.../page=.../ of JSON lines (fetched_at, body), on any file system that pyarrow knows."""

    def __init__(self, options: dict[str, str]) -> None:
        from pyarrow.fs import FileSystem

        self.files, self.root = FileSystem.from_uri(options["path"])
        self.listed: dict[str, dict[int, str]] = {}  # pages of users whose folders have other than the usual names

    def _names(self, folder: str, key: str) -> list[tuple[str, str]]:
        """(value, folder) of the folders key=value."""
        from pyarrow.fs import FileSelector

        found = self.files.get_file_info(FileSelector(folder, allow_not_found=True))
        return [(unquote(f.base_name.removeprefix(key + "=")), f.path) for f in found if f.base_name.startswith(key + "=")]

    def users(self) -> list[str]:
        return sorted(u for u, _ in self._names(self.root, "user"))

    def _pages(self, user: str) -> dict[int, str]:
        return {int(n): path for u, folder in self._names(self.root, "user") if u == user for n, path in self._names(folder, "page")}

    def last_page(self, user: str) -> int:
        """The page up to which all have landed."""
        there, last = self._pages(user), 0
        while last + 1 in there:
            last += 1
        return last

    def fetch(self, user: str, page: int) -> tuple[int, str]:
        from pyarrow.fs import FileSelector

        # a page's own folder is asked for: listing all of a user's for each page would make a walk quadratic
        plain = user.replace("_", "").replace("-", "").isalnum()
        files = self.files.get_file_info(FileSelector(f"{self.root}/user={user}/page={page}", allow_not_found=True)) if plain else []
        if not files:
            if page not in self.listed.get(user, {}):
                self.listed[user] = self._pages(user)
            folder = self.listed[user].get(page)
            files = self.files.get_file_info(FileSelector(folder)) if folder else []
        copies = []
        for f in files:
            if f.is_file and not f.base_name.startswith(("_", ".")):
                copies += [json.loads(line) for line in self.files.open_input_stream(f.path).read().splitlines() if line]
        if not copies:
            raise PageError(f"page {page} of {user} is not there")
        newest = max(copies, key=lambda c: c["fetched_at"])
        return newest["fetched_at"], newest["body"]


def _service(options: dict[str, str]):
    module, _, name = options.get("service", "landed").partition(":")
    return Landed(options) if module == "landed" else getattr(importlib.import_module(module), name)(options)


@dataclass
class Pages(InputPartition):
    user: str
    first: int
    last: int


def _ranges(user: str, first: int, last: int, size: int) -> list[Pages]:
    return [Pages(user, at, min(last, at + size - 1)) for at in range(first, last + 1, size)]


class _Walk:
    """What both readers share: the users, ranges of pages, and fetching with retries."""

    def __init__(self, options: dict[str, str]) -> None:
        self.options = dict(options)
        self.size, self.retries = int(options.get("pages_per_partition", 50)), int(options.get("retries", 3))

    def last_pages(self) -> dict[str, int]:
        service = _service(self.options)
        users = json.loads(self.options["users"]) if "users" in self.options else service.users()
        return {u: service.last_page(u) for u in users}

    def fetch(self, pages: Pages | None) -> Iterator[tuple]:
        if pages is None:  # no partition was planned
            return
        service = _service(self.options)
        for page in range(pages.first, pages.last + 1):
            for left in reversed(range(self.retries)):
                try:
                    at, body = service.fetch(pages.user, page)
                    break
                except (PageError, OSError):
                    if not left:
                        raise
            yield pages.user, page, at, body


class _Batch(_Walk, DataSourceReader):
    """All pages there are.  A page that fails ends its range: what was fetched is kept, see unbroken()."""

    def partitions(self) -> list[Pages]:
        return [p for user, last in self.last_pages().items() for p in _ranges(user, 1, last, self.size)]

    def read(self, partition: Pages | None) -> Iterator[tuple]:
        try:
            yield from self.fetch(partition)
        except (PageError, OSError):
            return


class _Stream(_Walk, DataSourceStreamReader):
    """Pages since the last offset.  A page that fails fails the batch, which is run again from its offset."""

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return self.last_pages()

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        return [p for user, last in end.items() for p in _ranges(user, start.get(user, 0) + 1, last, self.size)]

    def read(self, partition: Pages | None) -> Iterator[tuple]:
        return self.fetch(partition)

    def commit(self, end: dict) -> None:
        pass


class PlayPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "play_pages"

    def schema(self) -> str:
        return PAGE_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PlayPages)


def unbroken(pages: DataFrame) -> DataFrame:
    """The pages of each user before the first that is missing: what a walk that broke off has."""
    there = pages.select("user", "page").distinct()
    after = there.select("user", (F.col("page") + 1).alias("page"))
    gaps = after.unionByName(there.select("user", F.lit(1).cast("long").alias("page")).distinct()).join(there, ["user", "page"], "left_anti")
    return pages.join(gaps.groupBy("user").agg(F.min("page").alias("gap")), "user").filter(F.col("page") < F.col("gap")).drop("gap")


def walk(spark: SparkSession, store: str, checkpoint: str, **options: str):
    """Take the pages that there are since the last run into the store, then stop.  A page comes once, whatever is restarted."""
    register(spark)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store}/batch={batch_id}")

    pages = spark.readStream.format("play_pages").options(**options).load()
    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def walked(spark: SparkSession, store: str) -> DataFrame:
    """The pages in a store that walk() has filled."""
    return spark.read.schema(PAGE_SCHEMA).parquet(store).select("user", "page", "fetched_at", "body")
