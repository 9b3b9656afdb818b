"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data set; Spark's reader alone touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``. Only where that is unset, as in
    tests on a local master, a temporary folder of this process stands in.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if "dir" not in _OWN:
        folder = tempfile.TemporaryDirectory(prefix="lexspark-")
        atexit.register(folder.cleanup)
        _OWN["dir"] = f"file://{folder.name}"
    return _OWN["dir"]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, survives executors.

    The table goes when the driver's process ends (see ``drop_written``).
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN.append((spark, path, out))
    return out


_WRITTEN: list[tuple[SparkSession, str, DataFrame]] = []


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(df: DataFrame) -> None:
    """Deletes a table of ``written`` that nothing reads any more."""
    for k, (spark, path, out) in enumerate(_WRITTEN):
        if out is df:
            del _WRITTEN[k]
            _delete(spark, path)
            return


def drop_written() -> None:
    """Deletes the tables of ``written``; call it once no result reads them any more."""
    while _WRITTEN:
        spark, path, _ = _WRITTEN.pop()
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone at exit
            return


atexit.register(drop_written)


def release() -> None:
    """Gives a Python worker's unused memory back: workers stay, and take up other stages' batches."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def free_name(df: DataFrame, base: str) -> str:
    """A column name that clashes with none of ``df``."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


#: Bits of the filter of ``with_ids``, in words of 64.
FILTER_WORDS = 1 << 20


def with_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without most of the rows whose ``doc_id`` isn't among ``ids``; a join has to follow.

    The ids set bits in a filter of ``FILTER_WORDS`` words at most, which is all that is
    broadcast, so rows that a join would drop aren't shuffled for it. With very many ids the filter
    lets all rows through.
    """
    word = lambda c: F.pmod(F.shiftright(F.xxhash64(c), 6), F.lit(FILTER_WORDS)).cast("int")
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.xxhash64(c).bitwiseAND(F.lit(63)).cast("int"))
    bits = ids.groupBy(word("doc_id").alias("filter_word")).agg(F.bit_or(bit("doc_id")).alias("filter_bits"))
    met = docs.join(F.broadcast(bits), word("doc_id") == F.col("filter_word"))
    return met.where(F.col("filter_bits").bitwiseAND(bit("doc_id")) != 0).select(*docs.columns)


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))
