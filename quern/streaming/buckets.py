"""The month and day maps of documents, as tumbling windows over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def buckets(events: DataFrame, by: list[str], time: str = "ts", width: str = "1 day", late: str = "1 hour", value: str = "value") -> DataFrame:
    """Count and sum for each key and window. Events later than ``late`` behind the newest are dropped, so state stays bounded."""
    stamped = events.withColumn(time, F.col(time).cast("timestamp"))
    stamped = stamped.withWatermark(time, late) if events.isStreaming else stamped
    counted = stamped.groupBy(*by, F.window(time, width).alias("w")).agg(F.count(F.lit(1)).alias("event_count"), F.round(F.sum(value), 4).alias("value_total"))
    return counted.select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_count", "value_total")
