"""Windowed aggregates over an event stream, the same as their batch forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.monitoring import daily_report  # noqa: F401  the batch counterpart


def tumbling(events: DataFrame, width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """(window_start, event_type, n, total) of event-time windows; on a stream, state is dropped behind the watermark."""
    if events.isStreaming:  # watermarks need an instant
        events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return rows.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def run_available(spark: SparkSession, path: str, folder: str, width: str = "1 day") -> DataFrame:
    """Read all files under a path as a stream, write the complete windows under ``folder``, and read them back.

    Complete mode: each micro-batch replaces the table of windows, which is as long as the number of windows and types,
    so open windows are in it as well.
    """
    schema = spark.read.parquet(path).schema
    stream = tumbling(spark.readStream.schema(schema).parquet(path), width)
    out = f"{folder}/windows"

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    query = stream.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    last = spark.read.parquet(out)
    done = last.where(F.col("epoch") == last.agg(F.max("epoch")).first()[0]).drop("epoch")
    return done.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
