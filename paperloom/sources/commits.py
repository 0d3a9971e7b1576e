"""Versions of a folder of tables: small JSON documents, each committed once, in any file system that Spark reaches."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Someone else has committed the version that was to be written."""


class Commits:
    """What each version of a folder consists of. Files of a version are written first; they count once it is committed.

    A version's document is made under a name that is created once: of two writers who started from the same version the
    second one fails, and nothing of what it wrote is read.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.folder = str(self.fs.makeQualified(path).toString())

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *parts)))

    def versions(self) -> list[int]:
        """The committed versions, in order."""
        where = self._path("commits")
        names = [s.getPath().getName() for s in self.fs.listStatus(where)] if self.fs.exists(where) else []
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def read(self, version: int) -> dict:
        stream = self.fs.open(self._path("commits", f"v{version:08d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def latest(self) -> tuple[int, dict | None]:
        """The last version and its document; 0 and None before the first one."""
        known = self.versions()
        return (known[-1], self.read(known[-1])) if known else (0, None)

    def commit(self, version: int, document: dict) -> None:
        """Commits the version that follows the one its writer started from."""
        hidden, final = self._path("commits", f".{self.spark._jvm.java.util.UUID.randomUUID().toString()}"), self._path("commits", f"v{version:08d}.json")
        out = self.fs.create(hidden, False)
        try:
            out.write(bytearray(json.dumps(document).encode()))
        finally:
            out.close()
        if self.fs.exists(final) or not self.fs.rename(hidden, final):
            self.fs.delete(hidden, False)
            raise Conflict(f"version {version} of {self.folder} was committed by someone else")

    def remove(self, *parts: str) -> None:
        """Removes files that no version refers to any more."""
        self.fs.delete(self._path(*parts), True)

    def whole_folders(self) -> list[str]:
        """Folders of tables that were written whole, by name."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        names = [s.getPath().getName() for s in self.fs.listStatus(where) if s.isDirectory()] if self.fs.exists(where) else []
        return sorted(n for n in names if self.fs.exists(self._path(n, "_SUCCESS")))

    def upload(self, file: str, to: str) -> None:
        """Copies a file of this machine to a place that Spark reaches."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        self.fs.copyFromLocalFile(False, True, path("file://" + file), path(to))
