"""What the corpus operators share: the shared folder, text batches and file access."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words; every other character belongs to a word.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the setting is absent and the session is a local one (tests) a temporary folder of this
    machine is made and becomes the checkpoint folder of the session; on a cluster that is an error.
    """
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        there = getattr(spark, "_quillmill_dir", None)
    if not there:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        there = spark._quillmill_dir = "file://" + tempfile.mkdtemp(prefix="quillmill-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(there)
    return there.rstrip("/")


def fresh(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder; nothing is written yet."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str, *by: str) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again: a cut in the lineage."""
    spark, path = df.sparkSession, fresh(df.sparkSession, what)
    out = df.write.option("compression", "zstd")
    (out.partitionBy(*by) if by else out).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Tables of ids of up to so many rows (some tens of MB) are broadcast.
BROADCAST_ROWS = 1_000_000


def sized(ids: DataFrame) -> DataFrame:
    """A written table of ids, marked to be broadcast if it is counted to be small; larger ones are joined by a shuffle."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids.hint("merge")


def discard(df: DataFrame, kind: int | None = None) -> None:
    """Delete the files of a table that ``written`` made and nothing reads any more, or those of one ``kind`` of a table written by kinds.

    A collection on the driver follows, so that Spark drops the shuffle files of steps that are done.
    """
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders if kind is None else {f for f in folders if f.endswith(f"/kind={kind}")}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
    gc.collect()
    jvm.System.gc()


def filesystem(uri: str):
    """The pyarrow file system of a URI (file, hdfs, s3, gs) and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else os.path.abspath(uri))


def text_of(name: str = "text") -> Column:
    """The text column with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def lower_ascii(col: Column) -> Column:
    """A-Z in lower case, everything else untouched."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: For ``str.translate``: A-Z in lower case only.
ASCII_LOWER = {i: i + 32 for i in range(65, 91)}


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches cut to at most ``rows`` rows, to bound what a step holds."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def fresh_memory() -> None:
    """Free memory of this process goes back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def releasing(rows: Iterator[pa.RecordBatch], *forget: Callable[[], object]) -> Iterator[pa.RecordBatch]:
    """``rows``, and at their end (or when the task fails) the worker's tables are cleared and its free memory goes back to the system.

    Python workers outlive their tasks and wait for others, so what a module keeps would stand beside the JVM of all later stages.
    """
    try:
        yield from rows
    finally:
        for f in forget:
            f()
        fresh_memory()
