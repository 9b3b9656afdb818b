"""Small files beside tables, through Hadoop's file systems: they may lie in any store that Spark reads."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession


_OWN: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """A folder of this run that driver and executors share, below ``spark.checkpoint.dir``; only on a local master without one, a temporary folder."""
    key = spark.sparkContext.applicationId
    if key not in _OWN:
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if named:
            _OWN[key] = f"{named}/{key}-{uuid.uuid4().hex}"
        elif spark.sparkContext.master.startswith("local"):
            folder = tempfile.TemporaryDirectory(prefix="lexspark-index-")
            atexit.register(folder.cleanup)
            _OWN[key] = f"file://{folder.name}"
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _OWN[key]


class Files:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.jvm = spark._jvm

    def _at(self, path: str):
        where = self.jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def exists(self, path: str) -> bool:
        fs, where = self._at(path)
        return fs.exists(where)

    def names(self, path: str) -> list[str]:
        fs, where = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []

    def size(self, path: str) -> int:
        fs, where = self._at(path)
        return fs.getContentSummary(where).getLength() if fs.exists(where) else 0

    def read(self, path: str) -> str:
        fs, where = self._at(path)
        stream = fs.open(where)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Whole or not at all: written beside, then renamed over."""
        fs, where = self._at(path)
        beside = self.jvm.org.apache.hadoop.fs.Path(path + ".tmp")
        fs.mkdirs(where.getParent())
        stream = fs.create(beside, True)
        try:
            stream.write(bytearray(text.encode()))
            stream.hsync()
        finally:
            stream.close()
        options = self.jvm.org.apache.hadoop.fs.Options.Rename
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri() if where.toUri().getScheme() else fs.getUri(), self.spark._jsc.hadoopConfiguration())
        array = self.spark.sparkContext._gateway.new_array(options, 1)
        array[0] = options.OVERWRITE
        context.rename(fs.makeQualified(beside), fs.makeQualified(where), array)

    def delete(self, path: str) -> None:
        fs, where = self._at(path)
        fs.delete(where, True)
