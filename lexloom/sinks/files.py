"""Small files and folders on whatever file system Spark reads, and the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder where it is unset and Spark is local, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lexloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def open_store(path: str):
    """pyarrow's file system of a path or URI, and the path within it."""
    from pyarrow import fs

    if path.startswith("file:/"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


class Files:
    """File operations under one root, by Hadoop's file system of that root."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._jvm, self._gateway, self._conf = spark._jvm, spark.sparkContext._gateway, spark._jsc.hadoopConfiguration()
        self._fs = self._path(root).getFileSystem(self._conf)

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def names(self, folder: str) -> list[str]:
        """Names in a folder; none where there is no folder."""
        path = self._path(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(self._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)).decode()
        finally:
            stream.close()

    def publish(self, text: str, path: str) -> bool:
        """Writes a file that others see whole or not at all; False if the name was taken first."""
        staged = f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}"
        stream = self._fs.create(self._path(staged), False)
        try:
            stream.write(text.encode())
        finally:
            stream.close()
        kind = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        keep = self._gateway.new_array(kind, 1)
        keep[0] = kind.NONE
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(self._fs.makeQualified(self._path(staged)), self._fs.makeQualified(self._path(path)), keep)
        except Exception as e:
            self.delete(staged)
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def move(self, source: str, target: str) -> None:
        """Moves a file; a file that stands there goes first."""
        self._fs.mkdirs(self._path(target).getParent())
        if self.exists(target):
            self.delete(target)
        if not self._fs.rename(self._path(source), self._path(target)):
            raise OSError(f"could not move {source} to {target}")

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)
