"""Small files beside the data, on whatever file system the session reaches.

That a file appears whole or not at all, and that of two writers one is refused, needs a file system that
links or renames atomically without replacing: local disks and HDFS do. Object stores copy on a rename, so
there only one process may write at a time.
"""

from __future__ import annotations

import json
import os
import uuid
from urllib.parse import unquote

from pyspark.sql import SparkSession


class Folder:
    """A folder, through Hadoop's file system interface."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def names(self, name: str = "") -> list[str]:
        """What lies in the folder, or in one under it; nothing if there is no such folder."""
        p = self._path(name)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def remove(self, name: str) -> None:
        """Removes a file or a folder with all in it."""
        self._fs.delete(self._path(name), True)

    def create(self, name: str, text: str) -> bool:
        """Writes a file that readers see whole or not at all (see above); False if there is one of this name."""
        new = self._path(f"_new-{uuid.uuid4().hex}")
        out = self._fs.create(new, True)
        out.write(bytearray(text.encode()))
        out.close()
        final = self._path(name)
        self._fs.mkdirs(final.getParent())
        if self._fs.getScheme() == "file":  # a rename would replace; a second link to the file is refused if the name is taken
            try:
                os.link(*(unquote(self._fs.makeQualified(p).toUri().getPath()) for p in (new, final)))
                done = True
            except FileExistsError:
                done = False
        else:
            done = not self._fs.exists(final) and self._fs.rename(new, final)
        if self._fs.exists(new):
            self._fs.delete(new, False)
        return done


class ConcurrentWriter(Exception):
    """Somebody else has published since this state was read."""


class Versions:
    """Numbered versions of a small JSON state; the greatest number counts.

    A version is a file of its own that is linked or renamed into place, so publishing is atomic, replaces
    nothing, and fails if another writer was first.
    """

    def __init__(self, folder: Folder, name: str):
        self.folder, self.name = folder, name

    def latest(self) -> tuple[int, dict | None]:
        """The number and state of the last version; 0 and None if there is none."""
        known = [n for n in self.folder.names(self.name) if n.endswith(".json")]
        if not known:
            return 0, None
        number = int(known[-1].removesuffix(".json"))
        return number, self.read(number)

    def read(self, number: int) -> dict:
        return json.loads(self.folder.read(f"{self.name}/{number:012d}.json"))

    def publish(self, number: int, state: dict) -> None:
        if not self.folder.create(f"{self.name}/{number:012d}.json", json.dumps(state)):
            raise ConcurrentWriter(f"version {number} of {self.folder.path}/{self.name}")
