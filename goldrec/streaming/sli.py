"""Service levels over a stream, with a bound on late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldrec.operators.slo import log_counts, ratio


def sli_stream(log: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts, events per second and ratios per window, each window sent once when
    the watermark passes its end."""
    windows = (
        log.withWatermark("event_ts", late).groupBy(F.window("event_ts", width)).agg(*log_counts())
    )
    seconds = F.unix_timestamp(F.col("window.end")) - F.unix_timestamp(F.col("window.start"))
    return windows.select(
        F.col("window.start").alias("window_start"),
        "processed",
        "errors",
        "duplicates",
        F.round(F.col("processed") / seconds, 6).alias("events_per_sec"),
        F.round(ratio(F.col("errors"), F.col("processed")), 6).alias("error_ratio"),
        F.round(ratio(F.col("duplicates"), F.col("processed")), 6).alias("duplicate_ratio"),
    )
