"""Ordered chunks: cut the history of a hot key into pieces many tasks can share.

A chunk is a run of neighbouring rows in key order, so a window over
``(key, chunk)`` sees a bounded group, and what one chunk hands to the next is
computed on a table of one row per chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from goldrec.plans.durable import durable
from goldrec.plans.skew import MAX_HOT_KEYS, HotKeys


def assign_chunks(
    df: DataFrame,
    hot: HotKeys,
    ts: str,
    target: int | None = None,
    slot: str = "second",
    then: str = "event_id",
) -> DataFrame:
    """Add ``chunk`` (0, 1, ...) to rows of hot keys, fewer than ``2 * target`` rows each.

    Rows are counted per key and time slot; slots join a chunk until it is full. The
    slot table holds hot keys only and grows with the time they span, not with their
    rows. A slot of more than ``target`` rows is cut first: one sort by key, ``ts`` and
    ``then``, whose range borders are sampled from all three, numbers such rows where
    they lie, and a run of ``target`` numbers is a slot of its own.
    """
    target = target or hot.limit
    keys = list(hot.keys)
    slots = [*keys, "_slot"]
    size = F.count(F.lit(1)).alias("_n")
    none = F.lit(0).cast("long")
    rows = hot.hot(df).withColumns({"_slot": F.date_trunc(slot, F.col(ts)), "_cut": none})
    sizes = durable(rows.groupBy(*slots).agg(size), "slots").withColumn("_cut", none)
    full = sizes.filter(F.col("_n") > target).select(*slots)
    n_full = full.count()
    if n_full:
        full = F.broadcast(full) if n_full <= MAX_HOT_KEYS else full
        # Numbers grow from partition to partition, so runs of them follow the order.
        run = F.expr(f"monotonically_increasing_id() div {int(target)}")
        cut = rows.join(full, slots, "left_semi").sort(*keys, ts, then).withColumn("_cut", run)
        cut = durable(cut, "cut-slots")
        rows = rows.join(full, slots, "left_anti").unionByName(cut)
        sizes = sizes.join(full, slots, "left_anti").unionByName(cut.groupBy(*slots, "_cut").agg(size))
    before = W.partitionBy(*keys).orderBy("_slot", "_cut").rowsBetween(W.unboundedPreceding, -1)
    filled = F.coalesce(F.sum("_n").over(before), F.lit(0))
    chunks = sizes.select(*slots, "_cut", F.floor(filled / F.lit(target)).alias("chunk"))
    return rows.join(chunks, [*slots, "_cut"]).drop("_slot", "_cut")


def carried(chunks: DataFrame, keys: list[str], **columns: Column) -> DataFrame:
    """One row per ``(key, chunk)`` with aggregates over all *earlier* chunks of
    the key; ``columns`` are aggregate expressions over ``chunks``."""
    before = W.partitionBy(*keys).orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    return chunks.select(
        *keys, "chunk", *(expr.over(before).alias(name) for name, expr in columns.items())
    )
