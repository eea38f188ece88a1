"""Small files in the store that holds the tables, through Hadoop's file systems. The only place that calls them."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Store:
    """A folder in any store that Spark reads. Paths are relative to it."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path
        self._jvm, self._gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, folder: str) -> list[str]:
        """What lies in a folder; nothing if there is none."""
        at = self._at(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def age_seconds(self, name: str) -> float:
        """Since the last change of a file or folder."""
        return (self._jvm.System.currentTimeMillis() - self._fs.getFileStatus(self._at(name)).getModificationTime()) / 1000

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a new file as a whole; False if there is one of that name, whoever wrote it.

        The text is written beside it and renamed without overwriting, which the store does in one step
        (HDFS and its like; in an object store without such a rename keep to one writer).
        """
        folder, _, last = name.rpartition("/")
        draft = self._at(f"{folder}/.{last}.{uuid.uuid4().hex}")
        out = self._fs.create(draft)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        kind = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self._gateway.new_array(kind, 1)
        how[0] = kind.NONE
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self._conf)
        try:
            files.rename(draft, self._at(name), how)
            return True
        except Py4JJavaError as problem:
            if "FileAlreadyExistsException" not in problem.java_exception.getClass().getName():
                raise
            self._fs.delete(draft, False)
            return False

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)
