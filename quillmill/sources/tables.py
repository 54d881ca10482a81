"""Readers for the named Parquet tables under one directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read ``name`` lazily; Spark resolves the scheme of ``sf_dir``."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where it comes in fewer splits than there are, for work that is heavy on the CPU.

    Only inputs that are small by the plan's own figures are dealt anew, so nothing large is ever moved.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().optimizedPlan()
    if plan.stats().sizeInBytes() > cores * spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes():
        return df
    return df.repartition(cores) if 0 < len(df.inputFiles()) < cores else df
