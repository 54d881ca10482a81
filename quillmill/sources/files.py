"""Files as tables: whole texts, JSON documents, several sources of which some may fail, speed curves; and safe writers."""

from __future__ import annotations

import logging
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

log = logging.getLogger(__name__)


def texts(spark: SparkSession, path: str) -> DataFrame:
    """path and text of whole text files (a file, a folder or a pattern)."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def json_documents(spark: SparkSession, path: str, schema: str | T.StructType, rows: str | None = None) -> DataFrame:
    """JSON documents of one file each by an explicit schema; with ``rows``, the elements of that array.

    A document that can't be read fails the job, as a broken cache or spec must not pass for an empty one.
    """
    df = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return df if rows is None else df.select(F.explode(rows).alias("_r")).select("_r.*")


def fetch_all(spark: SparkSession, loaders: dict[str, Callable[[], DataFrame]], schemas: dict[str, str], last: dict[str, DataFrame] | None = None) -> tuple[dict[str, DataFrame], list[str]]:
    """The tables of several sources and the names of those that loaded.

    A source that fails, or comes empty, has its last good table, or an empty one of its schema; the
    others go on. If all fail the error of the first is raised.
    """
    out, good, first = {}, [], None
    for name, load in loaders.items():
        try:
            df = load()
            if df.isEmpty():
                raise ValueError(f"{name}: no rows")
            out[name] = df
            good.append(name)
        except Exception as e:  # noqa: BLE001 - the others must go on
            first = first or e
            log.warning("source %s failed: %s", name, e)
            out[name] = (last or {}).get(name) if (last or {}).get(name) is not None else spark.createDataFrame([], schemas[name])
    if loaders and not good:
        raise RuntimeError("all sources failed") from first
    return out, good


SPEED = "t array<double>, v array<double>, fps double, speed array<double>, t0 double, points array<array<double>>"


def speed_curve(spec: Column) -> Column:
    """``array<struct<t, v>>`` of a speed curve in JSON, by time and without signs.

    Three shapes: ``[[t, v], ...]``; ``{"t": [...], "v": [...]}``; ``{"fps": n, "speed": [...], "t0": t}`` with one value a frame.
    """
    s = F.from_json(F.when(F.trim(spec).startswith("["), F.concat(F.lit('{"points":'), spec, F.lit("}"))).otherwise(spec), SPEED)
    point = lambda t, v: F.struct(t.alias("t"), F.abs(v).alias("v"))
    values = F.coalesce(s["speed"], s["v"])
    rows = (
        F.when(s["points"].isNotNull(), F.transform(s["points"], lambda p: point(F.get(p, 0), F.get(p, 1))))
        .when(s["t"].isNotNull(), F.zip_with(s["t"], s["v"], point))
        .otherwise(F.transform(values, lambda v, i: point(F.coalesce(s["t0"], F.lit(0.0)) + i / s["fps"], v)))
    )
    return F.array_sort(rows)


# ---- writers


def work_dir(spark: SparkSession, what: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``), or of this machine in a local session."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        there = "file://" + tempfile.gettempdir()
    return f"{there.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def as_json(df: DataFrame, name: str = "json") -> DataFrame:
    """Each row as one JSON text; missing fields are left out."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))


def write_json(df: DataFrame, path: str, *order: str) -> None:
    """Rows as JSON lines; with ``order`` the files follow it."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").json(path)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def replace_table(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as the new state of the table at ``path``; readers see the old or the new state, never a part.

    Each state is a folder of its own; ``CURRENT`` names the valid one and is replaced by a rename. A
    state that could not be written leaves the table as it was. The state before is kept.
    """
    spark, name = df.sparkSession, f"state-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{name}")
    before = _current(spark, path)
    fs, new = _fs(spark, f"{path}/_CURRENT.{name}")
    out = fs.create(new)
    out.write(bytearray(name.encode()))
    out.close()
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    options = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(new), fs.makeQualified(jvm.org.apache.hadoop.fs.Path(f"{path}/CURRENT")), options)
    for old in fs.listStatus(jvm.org.apache.hadoop.fs.Path(path)):
        folder = old.getPath().getName()
        if folder.startswith("state-") and folder not in (name, before):
            fs.delete(old.getPath(), True)
    return spark.read.schema(df.schema).parquet(f"{path}/{name}")


def _current(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, f"{path}/CURRENT")
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def current_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The valid state of a table written by ``replace_table``; null if there is none."""
    name = _current(spark, path)
    return None if name is None else spark.read.parquet(f"{path}/{name}")


def overwrite_part(df: DataFrame, path: str, by: str, key: str, expected: int) -> None:
    """Replace the partitions ``by`` that ``df`` holds in a kept table, which must be whole before: ``expected`` distinct keys.

    Partitions that ``df`` doesn't hold stay as they are.
    """
    spark = df.sparkSession
    kept = spark.read.parquet(path).select(key).distinct().count()
    if kept != expected:
        raise ValueError(f"{path} holds {kept} of {expected} rows: write it whole first")
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
