"""Streaming forms of the gap sessions and of last-value lookups.

The reference point is the batch form: over a closed input an ``availableNow`` run gives the same
sessions once the watermark has passed them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Events of a folder of Parquet files, as they come; times are UTC."""
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def sessions(events: DataFrame, gap: str = "1 day", late: str = "1 hour", key: str = "user_id", ts: str = "ts") -> DataFrame:
    """Gap sessions of each key with their number of rows; rows later than ``late`` are dropped by the watermark."""
    marked = events.withWatermark(ts, late) if events.isStreaming else events
    out = marked.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def counts(events: DataFrame, width: str = "1 day", late: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Rows of each type in tumbling windows."""
    marked = events.withWatermark(ts, late) if events.isStreaming else events
    return marked.groupBy(F.window(ts, width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events")).select(F.col("w.start").alias("start"), "event_type", "events")


def run_once(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """All input that is there, appended to Parquet, exactly once over restarts."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return query
