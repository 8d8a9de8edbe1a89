"""Folders that change as a whole: versions beside each other, and a pointer to the current one.

A version is written in a folder of its own (phase one: Spark's committers make each part whole), and becomes
current by the renaming of one small file (phase two).  Whoever reads sees the old version or the new one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Versions:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.path = path.rstrip("/")
        self._hadoop, self._conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
        self._gateway, self._io = spark.sparkContext._gateway, spark._jvm.org.apache.commons.io.IOUtils
        self._files = self._at().getFileSystem(self._conf)

    def _at(self, *names: str):
        return self._hadoop.Path("/".join((self.path, *names)))

    def current(self) -> str | None:
        """The name of the current version, None before the first."""
        pointer = self._at("_current")
        if not self._files.exists(pointer):
            return None
        stream = self._files.open(pointer)
        try:
            return self._io.toString(stream, "UTF-8")
        finally:
            stream.close()

    def folder(self, name: str) -> str:
        return f"{self.path}/{name}"

    def begin(self) -> str:
        """The name of a version to come; nobody reads its folder until commit()."""
        return f"v-{uuid.uuid4().hex}"

    def commit(self, name: str) -> None:
        ready = self._at(f"_ready-{name}")
        stream = self._files.create(ready, True)
        try:
            stream.write(bytearray(name.encode()))
        finally:
            stream.close()
        rename = getattr(self._hadoop, "Options$Rename")
        how = self._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        self._hadoop.FileContext.getFileContext(ready.toUri(), self._conf).rename(ready, self._at("_current"), how)

    def abort(self, name: str) -> None:
        self._files.delete(self._at(name), True)

    def names(self) -> list[str]:
        """All versions that are there, the newest first."""
        if not self._files.exists(self._at()):
            return []
        found = [f for f in self._files.listStatus(self._at()) if f.isDirectory() and f.getPath().getName().startswith("v-")]
        return [f.getPath().getName() for f in sorted(found, key=lambda f: -f.getModificationTime())]

    def expire(self, keep: int = 2) -> list[str]:
        """Delete all versions but the current one and the newest others, `keep` in all.  Call it when nothing is being written."""
        current = self.current()
        gone = [n for n in self.names() if n != current][max(0, keep - 1) :]
        for name in gone:
            self.abort(name)
        return gone
