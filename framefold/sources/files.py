"""Small files and renames under a store root, through the Hadoop file system of that root.

Only metadata passes here: listings, markers of a few bytes and renames. Table rows never do.
"""
from __future__ import annotations

import os

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class StoreFiles:
    """Paths are relative to ``root``. Where the root is, or is mounted on, a POSIX folder, listings and small files go
    there directly; renames and deletions always go through Hadoop, which keeps checksum files beside their data."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark.sparkContext._jvm
        self.root = root.rstrip("/")
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)
        self._posix: str | None = None
        self._resolved = False

    def _path(self, rel: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{rel}" if rel else self.root)

    def exists(self, rel: str) -> bool:
        return self._fs.exists(self._path(rel))

    def names(self, rel: str) -> list[str]:
        """Names in a folder, sorted, hidden ones (``.``) left out; a missing folder has none."""
        local = self._local(rel)
        try:
            if local is not None:
                found = os.listdir(local)
            elif not self.exists(rel):
                return []
            else:
                found = [s.getPath().getName() for s in self._fs.listStatus(self._path(rel))]
        except FileNotFoundError:
            return []
        except Py4JJavaError:
            if self.exists(rel):
                raise
            return []  # removed in between
        return sorted(n for n in found if not n.startswith("."))

    def modified(self, rel: str) -> float | None:
        """Seconds since the epoch at which a file was written, None if it is gone."""
        try:
            return self._fs.getFileStatus(self._path(rel)).getModificationTime() / 1000
        except Py4JJavaError:
            if self.exists(rel):
                raise
            return None

    def folders(self, rel: str, depth: int) -> list[str]:
        """Partition folders (``key=value``) ``depth`` levels below ``rel``, as relative paths."""
        found = [rel]
        for _ in range(depth):
            found = [f"{d}/{n}" for d in found for n in self.names(d) if "=" in n]
        return found

    def make_folder(self, rel: str) -> None:
        self._fs.mkdirs(self._path(rel))

    def move(self, source: str, target: str) -> bool:
        """Rename; false where ``source`` is gone or the file system refuses."""
        return self._fs.rename(self._path(source), self._path(target))

    def remove(self, rel: str) -> None:
        """Delete a file or folder of this store; a missing one is fine."""
        self._fs.delete(self._path(rel), True)

    def _local(self, rel: str) -> str | None:
        """The POSIX path where the root is on one (of this driver, or shared by all), else None."""
        if not self._resolved:
            self._fs.mkdirs(self._path("_runs"))
            uri = self._fs.resolvePath(self._path("")).toUri()
            self._posix = uri.getPath() if uri.getScheme() in (None, "file") else None
            self._resolved = True
        return None if self._posix is None else f"{self._posix}/{rel}"

    def create(self, rel: str, text: str) -> bool:
        """Create a file with ``text`` unless it exists; false if it does. Exactly one of several callers succeeds.

        POSIX: exclusive creation; elsewhere the file system's own create without overwrite, which is
        atomic on HDFS and on object stores with conditional writes.
        """
        local = self._local(rel)
        if local is not None:
            os.makedirs(os.path.dirname(local), exist_ok=True)
            try:
                handle = os.open(local, os.O_CREAT | os.O_EXCL | os.O_WRONLY, 0o644)
            except FileExistsError:
                return False
            with os.fdopen(handle, "w", encoding="utf-8") as f:
                f.write(text)
            return True
        path = self._path(rel)
        self._fs.mkdirs(path.getParent())
        try:
            out = self._fs.create(path, False)
        except Py4JJavaError:
            if self._fs.exists(path):
                return False
            raise
        try:
            out.write(bytearray(text.encode("utf-8")))
        finally:
            out.close()
        return True

    def replace(self, rel: str, text: str) -> None:
        """Write a small file of this caller anew; readers see the old or the new one."""
        fresh = f"{rel}.new"
        local = self._local(fresh)
        if local is not None:
            os.makedirs(os.path.dirname(local), exist_ok=True)
            with open(local, "w", encoding="utf-8") as f:
                f.write(text)
            os.replace(local, self._local(rel))
            return
        out = self._fs.create(self._path(rel), True)
        try:
            out.write(bytearray(text.encode("utf-8")))
        finally:
            out.close()

    def read(self, rel: str) -> str | None:
        """The text of a small file, None if it is gone."""
        local = self._local(rel)
        if local is not None:
            try:
                with open(local, encoding="utf-8") as f:
                    return f.read()
            except FileNotFoundError:
                return None
        try:
            stream = self._fs.open(self._path(rel))
        except Py4JJavaError:
            if self.exists(rel):
                raise
            return None
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
        finally:
            stream.close()
