"""The few file operations that hold metadata, on whatever file system a path names."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()

    def _open(self, path: str):
        where = self._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self._conf), where

    def names(self, path: str) -> list[str]:
        fs, where = self._open(path)
        return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []

    def make_folder(self, path: str) -> None:
        fs, where = self._open(path)
        fs.mkdirs(where)

    def read_text(self, path: str) -> str:
        fs, where = self._open(path)
        stream = fs.open(where)
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def create_whole(self, path: str, text: str) -> None:
        """Write a file that is complete as soon as it is visible; it must not exist yet."""
        fs, where = self._open(path)
        if fs.exists(where):
            raise FileExistsError(f"{path} was written by someone else")
        parent = where.getParent()
        fs.mkdirs(parent)
        draft = self._jvm.org.apache.hadoop.fs.Path(parent, f".{uuid.uuid4().hex}.tmp")
        stream = fs.create(draft, False)
        try:
            stream.write(bytearray(text, "utf-8"))
        finally:
            stream.close()
        if not fs.rename(draft, where):
            fs.delete(draft, False)
            raise FileExistsError(f"{path} was written by someone else")

    def delete(self, path: str) -> None:
        fs, where = self._open(path)
        fs.delete(where, True)
