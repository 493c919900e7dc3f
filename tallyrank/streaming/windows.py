"""Window statistics of an event stream: the time analogue of the batch windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rolled_up(events: DataFrame, width: str = "64 seconds", slide: str = "16 seconds", late: str = "10 minutes") -> DataFrame:
    """Per event type and sliding window: n, mean, deviation, extremes. Windows close ``late`` after their end.

    The state is one row of aggregates per open window and type, whatever the rate.
    """
    w = F.window("ts", width, slide)
    return (
        events.withWatermark("ts", late)
        .groupBy(w.alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.min("value").alias("low"), F.max("value").alias("high"))
        .select("event_type", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean", "sd", "low", "high")
    )
