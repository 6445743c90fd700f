"""Small files through Hadoop's file systems, so that any store Spark can write holds the metadata too."""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession


class Files:
    """A folder's small files.

    create() must let one of several writers win. A local folder does it by a hard link, HDFS by a rename that never
    overwrites, and other stores by creating the name itself without overwriting: it is for the store to refuse the second,
    as S3A does with conditional writes; one that can't isn't safe for several writers.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._jvm, self.root = spark._jvm, root.rstrip("/")
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)
        self.scheme = str(self._fs.getUri().getScheme())

    def _at(self, name: str):
        return self._path(f"{self.root}/{name}")

    def _local(self, name: str) -> str:
        at = urlparse(f"{self.root}/{name}")
        return unquote(at.path) if at.scheme else f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def names(self, folder: str) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._at(folder))] if self.exists(folder) else []

    def read(self, name: str) -> bytes:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def create(self, name: str, data: bytes) -> bool:
        """Write a new file, seen whole or not at all; False if the name is taken."""
        if self.scheme == "file":
            return self._create_local(name, data)
        if self.exists(name):
            return False
        self._fs.mkdirs(self._at(name).getParent())
        if self.scheme in ("hdfs", "viewfs"):
            draft = self._at(f"_drafts/{uuid.uuid4().hex}")
            self._write(draft, data)
            try:
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(draft, self._at(name), self._no_overwrite())
            except Exception as e:
                self._fs.delete(draft, False)
                if _taken(e):
                    return False
                raise
            return True
        try:
            self._write(self._at(name), data)
        except Exception as e:
            if _taken(e):
                return False
            raise
        return True

    def _no_overwrite(self):
        options = self._jvm.java.lang.reflect.Array.newInstance(self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        options[0] = getattr(self._jvm, "org.apache.hadoop.fs.Options$Rename").NONE
        return options

    def _write(self, path, data: bytes) -> None:
        stream = self._fs.create(path, False)
        stream.write(bytearray(data))
        stream.close()

    def _create_local(self, name: str, data: bytes) -> bool:
        target, draft = self._local(name), self._local(f"_drafts/{uuid.uuid4().hex}")
        for p in (target, draft):
            os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(draft, "wb") as f:
            f.write(data)
        try:
            os.link(draft, target)
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)
        return True

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


def _taken(e: Exception) -> bool:
    java = getattr(e, "java_exception", None)
    return java is not None and java.getClass().getSimpleName() == "FileAlreadyExistsException"
