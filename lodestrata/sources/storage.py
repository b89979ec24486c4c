"""Small state files on Hadoop file systems that can create a file atomically."""

from __future__ import annotations

import json
import os
import uuid
from typing import Any

from pyspark.sql import SparkSession


#: File systems whose rename is one step and fails if there is such a file, and the setting that vouches for a single writer.
ATOMIC_RENAME, ONE_WRITER = ("hdfs", "viewfs", "webhdfs", "abfs", "abfss"), "lodestrata.catalog.one_writer"


class NotAtomic(ValueError):
    """The file system cannot keep two writers apart."""


class Storage:
    """JSON documents and directories under a root path."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()

    def path(self, *parts: str) -> str:
        """Full path of a relative one."""
        return "/".join([self.root, *parts])

    def _fs(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def exists(self, *parts: str) -> bool:
        fs, p = self._fs(self.path(*parts))
        return fs.exists(p)

    def read(self, *parts: str) -> Any:
        """The JSON value of a document."""
        fs, p = self._fs(self.path(*parts))
        stream = fs.open(p)
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream).decode())
        finally:
            stream.close()

    def write(self, value: Any, *parts: str) -> bool:
        """Write a document unless there is one (False then), which makes it a lock on a version.

        The content goes to a file of its own first, which then gets the name, in one step that fails if the name is taken:
        a hard link on local disks, a rename on the file systems of ``ATOMIC_RENAME``. Others, object stores among them,
        only check before they write, so they are refused unless ``ONE_WRITER`` is set in the session.
        """
        fs, p = self._fs(self.path(*parts))
        scheme = fs.getUri().getScheme()
        if scheme != "file" and scheme not in ATOMIC_RENAME and self.spark.conf.get(ONE_WRITER, "false") != "true":
            raise NotAtomic(f"{scheme} files cannot be created atomically; set {ONE_WRITER} if there is one writer only")
        if fs.exists(p):
            return False
        path = self.path(*parts[:-1], f".{parts[-1]}.{uuid.uuid4().hex}")
        _, tmp = self._fs(path)
        out = fs.create(tmp, False)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        try:
            if scheme != "file":
                return bool(fs.rename(tmp, p))
            local = lambda x: fs.makeQualified(x).toUri().getPath()
            try:
                os.link(local(tmp), local(p))
            except FileExistsError:
                return False
            return True
        finally:
            fs.delete(tmp, False)

    def age(self, *parts: str) -> float:
        """Seconds since a file or directory was changed."""
        fs, p = self._fs(self.path(*parts))
        return (self._jvm.java.lang.System.currentTimeMillis() - fs.getFileStatus(p).getModificationTime()) / 1000.0

    def list(self, *parts: str) -> list[str]:
        """Names in a directory; none if there is no such directory."""
        fs, p = self._fs(self.path(*parts))
        names = (s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else ()
        return sorted(n for n in names if not n.startswith("."))

    def delete(self, *parts: str) -> None:
        fs, p = self._fs(self.path(*parts))
        fs.delete(p, True)
