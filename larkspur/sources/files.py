"""Small files and folders through Spark's own file systems, so that stores can lie wherever Spark reads."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Folder:
    """Files below a root path."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        jvm = spark.sparkContext._jvm
        self.jvm, self.root, self.conf = jvm, root.rstrip("/"), spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(self.conf)

    def path(self, name: str):  # noqa: ANN201
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, name: str = "") -> list[str]:
        """The names of what is in a folder, sorted; none if it isn't there."""
        path = self.path(name)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a new file; False if one of that name is there already, also if several writers try at once.

        Local disks link a finished file to the name and HDFS renames it, both of which fail where the name is taken;
        other stores are asked to create the name only if it isn't there.
        """
        target, scheme = self.path(name), self.fs.getUri().getScheme()
        if scheme not in ("file", "hdfs", "viewfs"):
            try:
                build = self.fs.createFile(target)
                build.overwrite(False)
                build.opt("fs.option.create.conditional.overwrite", True)
                return self._write(build.build(), text)
            except Py4JJavaError:
                return False
        part = self.path(f"{name}.{uuid.uuid4().hex}.part")
        self._write(self.fs.create(part, True), text)
        try:
            if scheme == "file":
                self.jvm.java.nio.file.Files.createLink(*(self.jvm.java.io.File(p.toUri().getPath()).toPath() for p in (target, part)))
                return True
            return bool(self.fs.rename(part, target))
        except Py4JJavaError:
            return False
        finally:
            self.fs.delete(part, False)

    @staticmethod
    def _write(stream, text: str) -> bool:  # noqa: ANN001
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return True

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def copy_to(self, name: str, other: Folder) -> None:
        self.jvm.org.apache.hadoop.fs.FileUtil.copy(self.fs, self.path(name), other.fs, other.path(name), False, self.conf)
