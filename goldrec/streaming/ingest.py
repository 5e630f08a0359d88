"""Continuous ingestion: requests are checked, replays recognised, new requests published
as raw event messages, and every request answered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from goldrec.operators import idempotency, ingest
from goldrec.plans.durable import durable, scratch
from goldrec.sources.raw_events import raw_records
from goldrec.sources.tables import write_batch
from goldrec.streaming.idem import keys_store


def all_replies(classified: DataFrame, invalid: DataFrame) -> DataFrame:
    """One reply per request: ACCEPTED, CACHED, or REJECTED with the reason."""
    rejected = invalid.select(
        F.col("event_id").alias("request_id"),
        F.lit(None).cast(classified.schema["event_id"].dataType).alias("event_id"),
        F.lit("REJECTED").alias("status"),
        "reason",
    )
    good = idempotency.replies(classified).withColumn("reason", F.lit(None).cast("string"))
    return good.unionByName(rejected)


def ingest_batch(requests: DataFrame, batch_id: int, root: str, ttl_factor: int = 1) -> None:
    """Ingest one micro-batch. Every table is written under the batch id and only keys of
    earlier batches are read, so running a batch again gives the same tables."""
    with scratch(requests.sparkSession):
        checked = durable(ingest.check_requests(requests), "checked")
        invalid = checked.filter(F.col("reason").isNotNull())
        keyed = idempotency.with_idem_key(checked.filter(F.col("reason").isNull()).drop("reason"), ttl_factor)
        store = keys_store(keyed, root)
        store.merge(batch_id)
        stored = durable(store.matching(keyed, batch_id), "stored")
        classified = durable(idempotency.classify(keyed, stored=stored), "classified")
        write_batch(raw_records(idempotency.accepted(classified)), root, "raw_events", batch_id)
        write_batch(invalid, root, "quarantine", batch_id)
        write_batch(all_replies(classified, invalid), root, "replies", batch_id)
        # Last: a stored key means that its request is published.
        store.write(idempotency.keys_table(keyed, stored), batch_id)


def ingest_stream(requests: DataFrame, root: str, checkpoint: str, ttl_factor: int = 1) -> StreamingQuery:
    """Start ingesting a stream of requests into the tables under ``root``."""
    return (
        requests.writeStream.foreachBatch(lambda df, batch_id: ingest_batch(df, batch_id, root, ttl_factor))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
