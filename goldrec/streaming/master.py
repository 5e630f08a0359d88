"""Continuous mastering: each micro-batch is written as one batch of every table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from goldrec.config import MasteringConfig
from goldrec.functions.text import norm_national_id
from goldrec.operators import dlq, golden
from goldrec.operators.dedup import dedup_event_id
from goldrec.plans.durable import durable, scratch
from goldrec.sources.raw_events import raw_audit
from goldrec.sources.tables import golden_store, seen_store, write_batch


def master_batch(
    events: DataFrame, batch_id: int, root: str, cfg: MasteringConfig = MasteringConfig()
) -> None:
    """Master one batch of raw events. Every table is written under the batch id and
    only earlier batches are read, so running a batch again gives the same tables."""
    with scratch(events.sparkSession):
        _master_batch(events, batch_id, root, cfg)


def _master_batch(events: DataFrame, batch_id: int, root: str, cfg: MasteringConfig) -> None:
    spark = events.sparkSession
    id_type = dict(events.dtypes)["event_id"]
    seen, known = seen_store(spark, root, id_type), golden_store(spark, root)
    seen.merge(batch_id)
    known.merge(batch_id)
    events = durable(events, "batch")
    fresh = durable(dlq.check_mastering(dedup_event_id(events, seen.matching(events, batch_id))))
    good = fresh.filter(F.col("error_type").isNull()).drop("error_type", "error_message")
    ids = good.select(norm_national_id(F.col("national_id")).alias("national_id")).distinct()
    touched = known.matching(ids, batch_id)
    trace = durable(golden.golden_trace(good, cfg, touched))
    known.write(golden.golden_from_trace(trace), batch_id)
    write_batch(golden.mastered_events(trace), root, "mastered", batch_id)
    conflicts = golden.field_conflicts(trace, cfg)
    write_batch(golden.conflict_log(conflicts), root, "conflicts", batch_id)
    write_batch(fresh.filter(F.col("error_type").isNotNull()), root, "dlq", batch_id)
    write_batch(raw_audit(fresh.drop("error_type", "error_message")), root, "raw", batch_id)
    # Last: once an event is listed as seen, its effects are all written.
    seen.write(fresh.select("event_id"), batch_id)


def master_stream(
    raw: DataFrame, root: str, checkpoint: str, cfg: MasteringConfig = MasteringConfig()
) -> StreamingQuery:
    """Start mastering a stream of raw events into the tables under ``root``."""
    run: Callable[[DataFrame, int], None] = lambda df, batch_id: master_batch(df, batch_id, root, cfg)
    return (
        raw.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
