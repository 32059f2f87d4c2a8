"""Running the batch operators on streams and keeping an event log.

The batch functions are applied to each micro-batch; nothing here keeps state of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridlark.sources.sinks import event_json


def each_batch(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Append operator(batch) as Parquet, with the batch's number, so a replayed batch can be told apart."""

    def write(batch: DataFrame, number: int) -> None:
        operator(batch).withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/{number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str, by: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows per time window and key, with rows later than the watermark dropped by Spark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("n")).select("w.start", "w.end", by, "n")


def log_lines(events: DataFrame) -> DataFrame:
    """value: one JSON line for each event (time, event, payload struct)."""
    return events.select(event_json(F.col("time"), F.col("event"), F.col("payload")).alias("value"))
