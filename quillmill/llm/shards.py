"""Deterministic contiguous shards of a table by an integer key, and files written shard by shard.

Shard borders come from the data alone, not from a sample, so another run or a repeated task writes the
same shards: an equal-width histogram of the keys, zoomed into where most of the weight is in one
bucket, as an outlier among the keys makes it, with buckets heavier than a shard cut finer by one more
pass. A shard is written by one task as a stream, in key order, so memory does not grow with a shard's size.

Files lie in folders of ``FOLDER`` shards. A task writes each file under a temporary name that holds its attempt, and returns a manifest row
for it. After all rows are safe in a manifest table, the files are renamed in a second step that may
be repeated; files of lost or doubled attempts keep temporary names and are removed at the end.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.llm.common import filesystem, fresh

#: Buckets of a histogram, cells of the finer one, zooms, shards of a folder.
BUCKETS, CELLS, ZOOMS, FOLDER = 16384, 1 << 17, 6, 1000

MANIFEST = T.StructType(
    [T.StructField("shard", T.IntegerType()), T.StructField("file", T.IntegerType()), T.StructField("temporary", T.StringType()), T.StructField("path", T.StringType()), T.StructField("rows", T.LongType()), T.StructField("units", T.LongType()), T.StructField("bytes", T.LongType())]
)


def _div(a: Column, b: Column) -> Column:
    """Whole division of numbers that are not negative, without rounding."""
    return F.call_function("div", a, b.cast("decimal(20,0)")).cast("int")


def _offset(key: Column, low: int) -> Column:
    return key.cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")


def _bucket(low: int, width: int) -> Column:
    return _div(_offset(F.col("k"), low), F.lit(width))


def _histogram(rows: DataFrame, *by: Column) -> dict[tuple, int]:
    """The weight of each cell; the callers see to it that there are few."""
    names = [f"b{i}" for i in range(len(by))]
    found = rows.groupBy(*(c.alias(n) for c, n in zip(by, names, strict=True))).agg(F.sum("w").alias("w")).collect()
    return {tuple(r[n] for n in names): r["w"] or 0 for r in found}


def borders(df: DataFrame, key: str, weight: Column, target: int) -> tuple[Column, int]:
    """A shard number that never falls as the integer ``key`` rises, as an expression, and the number of shards.

    A shard holds about ``target`` of ``weight``, and a key that is heavier alone is one shard; null keys
    are in shard 0. At most ``BUCKETS`` and ``CELLS`` rows of histograms reach the driver whatever the table holds.
    """
    rows = df.select(F.col(key).cast("long").alias("k"), weight.cast("long").alias("w")).where("k is not null")
    low, high = rows.agg(F.min("k"), F.max("k")).first()
    if low is None:
        return F.lit(0), 1
    levels: list[tuple[int, int, int, dict[int, int]]] = []
    zoomed: list[int] = []
    while True:
        width = max(1, -(-(high - low + 1) // BUCKETS))
        weights = {b: w for (b,), w in _histogram(rows.where(F.col("k").between(low, high)), _bucket(low, width)).items()}
        levels.append((low, high, width, weights))
        heavy = max(weights, key=lambda b: (weights[b], -b))
        if width == 1 or len(levels) == ZOOMS or weights[heavy] <= target or 2 * weights[heavy] <= sum(weights.values()):
            break
        zoomed.append(heavy)
        low, high = low + heavy * width, min(high, low + (heavy + 1) * width - 1)

    def leaves(level: int) -> Iterator[tuple[int, int, int]]:
        for b in sorted(levels[level][3]):
            if level < len(zoomed) and b == zoomed[level]:
                yield from leaves(level + 1)
            else:
                yield level, b, levels[level][3][b]

    every = list(leaves(0))
    # buckets that are heavier than a shard, and how many cells each is cut into
    asked = {(v, b): min(levels[v][2], 2 * -(-w // target)) for v, b, w in every if w > target and levels[v][2] > 1}
    most = sum(asked.values())
    step = {x: -(-levels[x[0]][2] // max(2, n * CELLS // max(CELLS, most))) for x, n in asked.items()}
    cells: dict[tuple[int, int], dict[int, int]] = {}
    for v in {x[0] for x in step}:
        lo, hi, width, _ = levels[v]
        table = F.from_json(F.lit(json.dumps([step.get((v, b), 0) for b in range(BUCKETS)])), "array<bigint>")
        inside = rows.where(F.col("k").between(lo, hi)).withColumn("b", _bucket(lo, width)).withColumn("s", F.get(table, F.col("b"))).where("s > 0")
        cell = _div(_offset(F.col("k"), lo) - F.col("b").cast("decimal(20,0)") * F.lit(width), F.col("s"))
        for (b, c), w in _histogram(inside, F.col("b"), cell).items():
            cells.setdefault((v, b), {})[c] = w
    number, filled = 0, 0
    tables: list[dict[int, tuple[int, list[int]]]] = [{} for _ in levels]
    for v, b, w in every:
        parts = cells.get((v, b), {0: w})
        shards = [0] * (max(parts) + 1)
        for c in sorted(parts):
            if filled and filled + parts[c] > target:
                number, filled = number + 1, 0
            shards[c] = number
            filled += parts[c]
        tables[v][b] = (step.get((v, b), levels[v][2]), shards)
    out = None
    for (lo, hi, width, _), table in reversed(list(zip(levels, tables, strict=True))):
        rows_ = [{"s": s, "n": n} for s, n in (table.get(b, (1, [])) for b in range(max(table) + 1))] if table else []
        known = F.from_json(F.lit(json.dumps(rows_)), "array<struct<s:bigint,n:array<int>>>")
        b = _div(_offset(F.col(key), lo), F.lit(width))
        x = F.get(known, b)
        found = F.get(x["n"], _div(_offset(F.col(key), lo) - b.cast("decimal(20,0)") * F.lit(width), x["s"]))
        out = found if out is None else F.when(F.col(key).between(F.lit(inner[0]), F.lit(inner[1])), out).otherwise(found)
        inner = (lo, hi)
    return F.coalesce(out, F.lit(0)), number + 1


def dealt(df: DataFrame, shards: int, *order, shard: str = "shard") -> DataFrame:
    """One partition for each shard, sorted by ``order`` within it."""
    return df.repartitionById(shards, F.col(shard)).sortWithinPartitions(shard, *order)


class Files:
    """Opens temporary files for one task and remembers their manifest rows."""

    def __init__(self, folder: str, ending: str):
        self.folder, self.ending, self.rows = folder, ending, []
        self.fs, self.root = filesystem(folder)
        self.fs.create_dir(self.root, recursive=True)

    def open(self, shard: int, number: int):
        place, name = f"{shard // FOLDER:06d}", f"{shard:09d}-{number:05d}{self.ending}"
        temporary = f"{place}/_{uuid.uuid4().hex}-{name}"
        self.fs.create_dir(f"{self.root}/{place}", recursive=True)
        self.rows.append({"shard": shard, "file": number, "temporary": f"{self.folder}/{temporary}", "path": f"{self.folder}/{place}/{name}"})
        return self.fs.open_output_stream(f"{self.root}/{temporary}", compression=None)

    def done(self, rows: int, units: int, size: int) -> None:
        self.rows[-1] |= {"rows": rows, "units": units, "bytes": size}

    def batch(self) -> pa.RecordBatch:
        types = {"shard": pa.int32(), "file": pa.int32(), "temporary": pa.string(), "path": pa.string(), "rows": pa.int64(), "units": pa.int64(), "bytes": pa.int64()}
        out = pa.RecordBatch.from_arrays([pa.array([r[c] for r in self.rows], t) for c, t in types.items()], names=list(types))
        self.rows = []
        return out


def commit(files: DataFrame, folder: str) -> DataFrame:
    """Run the writing job, keep its manifest as Parquet, rename its files; returns the manifest."""
    spark = files.sparkSession
    pending, final = fresh(spark, "pending"), f"{folder}/_manifest"
    files.write.parquet(pending)

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileType

        for batch in batches:
            for temporary, path in zip(batch.column("temporary").to_pylist(), batch.column("path").to_pylist(), strict=True):
                fs, old = filesystem(temporary)
                _, new = filesystem(path)
                if fs.get_file_info(old).type != FileType.NotFound:
                    fs.move(old, new)
                elif fs.get_file_info(new).type == FileType.NotFound:
                    raise FileNotFoundError(path)
            yield batch

    spark.read.schema(MANIFEST).parquet(pending).mapInArrow(rename, MANIFEST).write.parquet(final)
    manifest = spark.read.schema(MANIFEST).parquet(final)
    _sweep(manifest)
    return manifest


def _sweep(manifest: DataFrame) -> None:
    """Remove temporary files that no manifest row names any more, folder by folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSelector

        for batch in batches:
            gone = []
            for folder in batch.column("folder").to_pylist():
                fs, root = filesystem(folder)
                old = [i.path for i in fs.get_file_info(FileSelector(root)) if i.is_file and i.base_name.startswith("_")]
                for path in old:
                    fs.delete_file(path)
                gone.append(len(old))
            yield pa.RecordBatch.from_arrays([pa.array(gone, pa.int64())], names=["n"])

    folders = manifest.select(F.regexp_extract("path", "^(.*)/[^/]+$", 1).alias("folder")).distinct()
    folders.mapInArrow(run, "n long").agg(F.sum("n")).collect()
