"""Extension: wind from a stream of weather events."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def windows(events: DataFrame, size: str = "10 minutes", late: str = "30 minutes", event_type: str | None = None) -> DataFrame:
    """(start, end, n, speed): mean value by tumbling event-time window; batch or stream.

    On a stream events later than `late` are dropped with their window's state; the batch
    form of the same query is exact.
    """
    if event_type is not None:
        events = events.where(F.col("event_type") == event_type)
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    out = events.groupBy(F.window("ts", size)).agg(F.count("*").alias("n"), F.avg("value").alias("speed"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "speed")


def latest(windowed: DataFrame) -> DataFrame:
    """(start, speed) of the last window."""
    return windowed.agg(F.max("start").alias("start"), F.max_by("speed", "start").alias("speed"))


def drive(stream: DataFrame, step, checkpoint: str, **options):
    """Start a query that hands the latest wind speed of each micro-batch to step(speed, batch)."""

    def each(batch: DataFrame, number: int) -> None:
        row = latest(batch).first()
        if row["speed"] is not None:
            step(row["speed"], number)

    return windows(stream, **options).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(each).start()
