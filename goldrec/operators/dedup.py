"""Raw events are stored and mastered once per event id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from goldrec.plans.skew import find_hot_keys, mark_first


def dedup_event_id(events: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """First delivery of each event id that is not stored yet.

    ``min`` over the whole row keeps one row per id with partial aggregation, so
    an id delivered any number of times costs one row per task in the shuffle.
    """
    columns = [c for c in events.columns if c != "event_id"]
    ordered = sorted(columns, key=lambda c: c != "event_ts")
    row = F.min(F.struct(*ordered)).alias("row")
    unique = events.groupBy("event_id").agg(row).select("event_id", "row.*")
    if stored is not None:
        unique = unique.join(stored.select("event_id"), "event_id", "left_anti")
    return unique.select(*events.columns)


def duplicates_by_customer(events: DataFrame) -> DataFrame:
    """Flag every event whose customer already has an earlier one; of a first event that
    was delivered again one delivery is not flagged."""
    first = F.min(F.struct("event_ts", "event_id")).alias("first")
    hot = find_hot_keys(events, "national_id")
    cold = events if hot is None else hot.cold(events)
    w = W.partitionBy("national_id").orderBy("event_ts", "event_id")
    flagged = cold.withColumn("is_duplicate", F.row_number().over(w) > 1)
    if hot is None:
        return flagged
    firsts = hot.hot(events).groupBy("national_id").agg(first)
    rest = events.join(hot.small(firsts), "national_id")
    is_first = F.struct("event_ts", "event_id") == F.col("first")
    rest = mark_first(rest, hot, is_first, "is_first")
    return flagged.unionByName(rest.withColumn("is_duplicate", ~F.col("is_first")).select(*flagged.columns))
