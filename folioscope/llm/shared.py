"""Helpers that several operators use: reading, shared storage, batches of text."""

from __future__ import annotations

import ctypes
import re
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the word contracts have it: U+0020 and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders made for each application, until clean() or dropped().
_FOLDERS: dict[str, set[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """A new folder's name below spark.checkpoint.dir, which driver and executors share; clean() deletes it.

    Where the session names none, a session on one machine gets one of its own; a cluster is asked to name it.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="folioscope-")
        spark.conf.set("spark.checkpoint.dir", top)
    folder = f"{top.rstrip('/')}/folioscope-{uuid.uuid4().hex}"
    _FOLDERS.setdefault(spark.sparkContext.applicationId, set()).add(folder)
    return folder


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read again: a cut lineage that survives lost executors.

    The driver's JVM is asked to collect garbage then, so that Spark's cleaner deletes the shuffle files of the steps that ended.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folder = path
    spark.sparkContext._jvm.java.lang.System.gc()
    return out


def shuffles_freed(spark: SparkSession, pause: float = 1.5) -> None:
    """Ask for the shuffle files of ended steps once more, after a pause: Spark's listeners hold the plan of a large step for a moment when it has just ended."""
    time.sleep(pause)
    spark.sparkContext._jvm.java.lang.System.gc()


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    _FOLDERS.get(spark.sparkContext.applicationId, set()).discard(folder)


def dropped(*frames: DataFrame) -> None:
    """Delete the files of stored() frames that nothing reads any more."""
    for df in frames:
        _delete(df.sparkSession, df._folder)


def clean(spark: SparkSession) -> None:
    """Delete all folders that this application's operators have made; frames that read them are of no use after that."""
    for folder in list(_FOLDERS.get(spark.sparkContext.applicationId, ())):
        _delete(spark, folder)


def crc32_mod4(col: str = "doc_id") -> F.Column:
    """crc32 of the id as text, modulo 4: fold 2 is held out."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % 4


def _free() -> None:
    """Give memory that is free back to the system, so that workers of one executor don't hold it for long."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim  # noqa: B018
except (OSError, AttributeError):  # another C library, which has no such call
    _LIBC = None


def pieces(batches: Iterator[pa.RecordBatch], text: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that each holds about most_bytes of text, or one row; the memory of a step stays bounded."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16
        ends = np.cumsum(size)
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most_bytes, "right")))
            yield batch.slice(start, stop - start)
            start = stop
            pa.default_memory_pool().release_unused()
    _free()
