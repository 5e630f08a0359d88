"""Streaming idempotency.

Without re-arming, a request's class depends on its key's first request only, so
each micro-batch is classified by the batch operators against the stored keys;
a key that fills a micro-batch is handled as it is in a batch. With re-arming
the accepted requests form a chain per key, of which the stored state is the
expiry. A micro-batch folds it over its requests inside Spark: a call of a Python
state processor cost some milliseconds a key. A key's rows of one micro-batch meet
in one task, so the trigger must bound the micro-batch (``maxFilesPerTrigger``,
``maxBytesPerTrigger``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from goldrec.operators import idempotency
from goldrec.plans.durable import durable, scratch
from goldrec.sources.store import Store
from goldrec.sources.tables import write_batch


def keys_store(keyed: DataFrame, root: str) -> Store:
    """The stored keys, for requests of the types of ``keyed``."""
    types = dict(keyed.dtypes)
    schema = ", ".join(
        f"{column} {kind}"
        for column, kind in (
            ("key_hash", "string"),
            ("client_key", "string"),
            ("event_id", types["event_id"]),
            ("status", "string"),
            ("created_at", types["event_ts"]),
            ("expires_at", types["event_ts"]),
        )
    )
    return Store(keyed.sparkSession, f"{root}/keys", "key_hash", schema)


def idem_batch(keyed: DataFrame, batch_id: int, root: str) -> None:
    """Classify one micro-batch and store its new keys, both under the batch id."""
    with scratch(keyed.sparkSession):
        rows = durable(keyed)
        store = keys_store(rows, root)
        store.merge(batch_id)
        stored = durable(store.matching(rows, batch_id), "stored")
        write_batch(idempotency.classify(rows, stored=stored), root, "classified", batch_id)
        store.write(idempotency.keys_table(rows, stored), batch_id)


def idem_stream(keyed: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Start classifying a stream of keyed requests into the tables under ``root``."""
    return (
        keyed.writeStream.foreachBatch(lambda df, batch_id: idem_batch(df, batch_id, root))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def expiry_store(keyed: DataFrame, root: str) -> Store:
    """When each key expires; an accepted request only moves that on."""
    schema = "key_hash string, expires_us bigint"
    latest = lambda rows: rows.groupBy("key_hash").agg(F.max("expires_us").alias("expires_us"))
    return Store(keyed.sparkSession, f"{root}/expiry", "key_hash", schema, latest)


def _fold_requests() -> Column:
    """``expires_us`` and the places (from 0) in ``reqs`` of the accepted requests."""
    start = F.struct(F.col("expires_us"), F.array().cast("array<int>").alias("kept"))

    def step(state: Column, req: Column) -> Column:
        new = state["expires_us"].isNull() | (req["event_us"] > state["expires_us"])
        moved = F.struct(
            (req["event_us"] + req["ttl_us"]).alias("expires_us"),
            F.concat(state["kept"], F.array(req["place"])).alias("kept"),
        )
        return F.when(new, moved).otherwise(state)

    placed = F.transform("reqs", lambda r, i: r.withField("place", i))
    return F.aggregate(placed, start, step)


def rearm(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """One row per key of ``rows``: its requests in time order as ``reqs``, the expiry that it
    had as ``before``, and ``after``, the expiry and the places of the accepted requests."""
    order = (F.col("event_us"), F.col("event_id").isNull().alias("no_id"), F.col("event_id"), F.col("ttl_us"))
    grouped = rows.groupBy("key_hash").agg(F.array_sort(F.collect_list(F.struct(*order))).alias("reqs"))
    folded = grouped.join(stored, "key_hash", "left").withColumn("after", _fold_requests())
    return folded.withColumnRenamed("expires_us", "before")


def rearm_batch(keyed: DataFrame, batch_id: int, root: str) -> None:
    """Classes of one micro-batch and the new expiries of its keys, under the batch id."""
    with scratch(keyed.sparkSession):
        rows = durable(keyed)
        store = expiry_store(rows, root)
        store.merge(batch_id)
        folded = durable(rearm(rows, store.matching(rows, batch_id)), "rearmed")
        first = F.col("before").isNull() & (F.col("place") == 0)
        kept = F.array_contains("after.kept", F.col("place"))
        result = F.when(~kept, "HIT").when(first, "MISS").otherwise("EXPIRED")
        requests = folded.select("key_hash", "before", "after", F.posexplode("reqs").alias("place", "r"))
        classes = requests.select("key_hash", "r.event_id", "r.event_us", result.alias("result"))
        write_batch(classes, root, "rearmed", batch_id)
        moved = folded.filter(F.size("after.kept") > 0)
        store.write(moved.select("key_hash", "after.expires_us"), batch_id)


def rearm_stream(keyed: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Start classifying with re-arming: the state is a key's expiry, moved on by every
    accepted request and stored by key. Requests of a micro-batch are taken in time order.
    Input: ``key_hash, event_id, event_us, ttl_us``."""
    return (
        keyed.writeStream.foreachBatch(lambda df, batch_id: rearm_batch(df, batch_id, root))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
