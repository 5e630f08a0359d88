"""Idempotent ingestion: keys with a time to live decide which request is new.

Input rows are valid requests with ``event_id, national_id, source_system,
client_key, event_ts`` (and ``done_ts``, the end of processing, for the
PROCESSING class).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from goldrec.config import CLIENT_TTL_HOURS, DETERMINISTIC_TTL_HOURS
from goldrec.functions import text as T
from goldrec.plans.durable import durable
from goldrec.plans.skew import HotKeys, find_hot_keys, join_unique, mark_first

ORDER = ("event_ts", "event_id")


def with_idem_key(requests: DataFrame, ttl_factor: int = 1) -> DataFrame:
    """Add ``key_type, key_hash, ttl_hours``: a client key replaces the deterministic one."""
    has_client = ~T.is_blank(F.col("client_key"))
    ttl_hours = F.when(has_client, CLIENT_TTL_HOURS * ttl_factor).otherwise(
        DETERMINISTIC_TTL_HOURS * ttl_factor
    )
    return requests.withColumns(
        {
            "key_type": F.when(has_client, "CLIENT").otherwise("DETERMINISTIC"),
            "key_hash": F.sha2(_key_text(has_client), 256),
            "ttl_hours": ttl_hours,
        }
    )


def _key_text(has_client: Column) -> Column:
    """What the key hashes; ids and sources are clean already."""
    text = T.det_text(F.col("national_id"), F.col("source_system"))
    return F.when(has_client, F.col("client_key")).otherwise(text)


def _hot_keys(keyed: DataFrame, bound: DataFrame | None = None) -> HotKeys | None:
    """Hot keys, sought by the text behind the hash, which is cheaper to make."""
    by = _key_text(F.col("key_type") == "CLIENT")
    return find_hot_keys(keyed, "key_hash", bucket_by=by, bound=bound)


def _ttl(hours: Column) -> Column:
    return F.make_dt_interval(hours=hours)


def _first_of_key(rows: DataFrame, *extra: str) -> Column:
    """Struct of the first request, ordered by its leading fields."""
    return F.struct(*ORDER, *(c for c in extra if c in rows.columns))


def with_first(keyed: DataFrame, bound: DataFrame | None = None) -> DataFrame:
    """Add ``first`` = struct of the key's first request to every row.

    Cold keys: one window, one shuffle. Hot keys: their first request is a
    partial aggregate, broadcast back, so their rows are not shuffled at all.
    """
    hot = _hot_keys(keyed, bound)
    if hot is None:
        return _first_by_window(keyed)
    return _first_by_window(hot.cold(keyed)).unionByName(_first_by_broadcast(keyed, hot))


def _first_by_window(keyed: DataFrame) -> DataFrame:
    w = W.partitionBy("key_hash").orderBy(*ORDER)
    return keyed.withColumn("first", F.first(_first_of_key(keyed, "done_ts")).over(w))


def _first_by_broadcast(keyed: DataFrame, hot: HotKeys) -> DataFrame:
    firsts = (
        hot.hot(keyed).groupBy("key_hash").agg(F.min(_first_of_key(keyed, "done_ts")).alias("first"))
    )
    return keyed.join(hot.small(firsts), "key_hash").select(*keyed.columns, "first")


def _with_new(keyed: DataFrame, bound: DataFrame | None) -> DataFrame:
    """Add ``first`` and ``new``: true for one delivery of the key's first request. Hot
    rows are not shuffled for it."""
    hot = _hot_keys(keyed, bound)

    def by_window(rows: DataFrame) -> DataFrame:
        delivery = F.row_number().over(W.partitionBy("key_hash", "event_id").orderBy("event_ts"))
        new = (F.col("event_id") == F.col("first.event_id")) & (delivery == 1)
        return _first_by_window(rows).withColumn("new", new)

    if hot is None:
        return by_window(keyed)
    rows = _first_by_broadcast(keyed, hot)
    is_first = (F.col("event_id") == F.col("first.event_id")) & (F.col("event_ts") == F.col("first.event_ts"))
    return by_window(hot.cold(keyed)).unionByName(mark_first(rows, hot, is_first, "new"))


def classify(
    keyed: DataFrame,
    in_flight: bool = False,
    stored: DataFrame | None = None,
    bound: DataFrame | None = None,
) -> DataFrame:
    """Add ``first_event_id, expires_at, result`` (MISS, HIT, EXPIRED, and with
    ``in_flight`` also PROCESSING). An expired key is not re-armed, and a request
    delivered again is a replay of itself. ``stored`` is
    the keys table of earlier batches; its keys come before any request here.
    ``bound`` is a stored table with at least as many rows (see ``find_hot_keys``)."""
    rows = _with_new(keyed, bound)
    first = F.col("first")
    first_id, expires = first["event_id"], first["event_ts"] + _ttl(F.col("ttl_hours"))
    if stored is not None:
        known = stored.select(
            "key_hash",
            F.col("event_id").alias("stored_id"),
            F.col("expires_at").alias("stored_expiry"),
        )
        rows = join_unique(rows, known, "key_hash", how="left")
        first_id = F.coalesce("stored_id", first_id)
        expires = F.coalesce("stored_expiry", expires)
    new = F.col("new")
    if stored is not None:  # a key from before is never new
        new = new & F.col("stored_id").isNull()
    rows = rows.withColumns({"expires_at": expires, "first_event_id": first_id, "new": new})
    late = F.col("event_ts") > F.col("expires_at")
    result = F.when(F.col("new"), "MISS").when(late, "EXPIRED")
    if in_flight:
        result = result.when(F.col("event_ts") < first["done_ts"], "PROCESSING")
    return rows.withColumn("result", result.otherwise("HIT")).drop(
        "first", "ttl_hours", "stored_id", "stored_expiry", "new"
    )


def accepted(classified: DataFrame) -> DataFrame:
    """Requests that become raw events: new keys and expired ones."""
    return classified.filter(F.col("result").isin("MISS", "EXPIRED"))


def replies(classified: DataFrame) -> DataFrame:
    """One reply per request; a replay names the key's first event."""
    is_new = F.col("result").isin("MISS", "EXPIRED")
    return classified.select(
        F.col("event_id").alias("request_id"),
        F.when(is_new, F.col("event_id")).otherwise(F.col("first_event_id")).alias("event_id"),
        F.when(is_new, "ACCEPTED").otherwise("CACHED").alias("status"),
    )


def keys_table(keyed: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One row per key, insert if absent: an aggregate, then an anti join against
    the keys already stored."""
    first = F.min(F.struct(*ORDER, "client_key", "ttl_hours")).alias("first")
    rows = keyed.groupBy("key_hash").agg(first)
    if existing is not None:
        rows = rows.join(existing.select("key_hash"), "key_hash", "left_anti")
    f = F.col("first")
    return rows.select(
        "key_hash",
        f["client_key"].alias("client_key"),
        f["event_id"].alias("event_id"),
        F.lit("COMPLETED").alias("status"),
        f["event_ts"].alias("created_at"),
        (f["event_ts"] + _ttl(f["ttl_hours"])).alias("expires_at"),
    )


def idem_stats(classified: DataFrame) -> DataFrame:
    """Counts and share per key type and result."""
    n = classified.groupBy("key_type", "result").agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy("key_type"))
    return n.select("key_type", "result", "n", F.round(F.col("n") / total, 6).alias("ratio"))


def rearmed(keyed: DataFrame) -> DataFrame:
    """Requests accepted when every accepted one re-arms its key's expiry.

    The chain of accepted requests is sequential per key. A cold key folds its
    ordered requests in one expression. Of a hot key every request gets its next
    acceptable one, and pointer doubling follows the chain from the first request,
    so the number of jobs grows with the logarithm of the time spanned.
    """
    hot = _hot_keys(keyed)
    if hot is None:
        return _rearm_by_fold(keyed)
    return _rearm_by_fold(hot.cold(keyed)).unionByName(_rearm_by_doubling(hot.hot(keyed)))


def _rearm_by_fold(keyed: DataFrame) -> DataFrame:
    grouped = keyed.groupBy("key_hash").agg(
        F.array_sort(F.collect_list(F.struct(*ORDER))).alias("reqs"),
        F.first("ttl_hours").alias("ttl_hours"),
    )

    def step(kept: Column, req: Column) -> Column:
        expiry = F.element_at(kept, -1)["event_ts"] + _ttl(F.col("ttl_hours"))
        return F.when(req["event_ts"] > expiry, F.concat(kept, F.array(req))).otherwise(kept)

    kept = F.aggregate(F.slice("reqs", 2, F.size("reqs")), F.slice("reqs", 1, 1), step)
    return grouped.select("key_hash", F.inline(kept)).select("key_hash", *ORDER)


def _next_acceptable(moments: DataFrame) -> DataFrame:
    """``key_hash, event_ts, next_ts``: the first later moment of the key behind the expiry.

    Moments and expiries are sorted together by ranges. The next moment behind an expiry is
    in its own range, or the first one of a later range of the key, which is looked up among
    one row per key and range.
    """
    asked = moments.select("key_hash", (F.col("event_ts") + _ttl(F.col("ttl_hours"))).alias("at"), F.lit(1).alias("kind"), "event_ts")
    given = moments.select("key_hash", F.col("event_ts").alias("at"), F.lit(0).alias("kind"), "event_ts")
    order = ("key_hash", "at", "kind")
    rows = asked.unionByName(given).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = durable(rows.withColumn("part", F.spark_partition_id()), "moments")
    moment = F.when(F.col("kind") == 0, F.col("at"))
    firsts = rows.groupBy("key_hash", "part").agg(F.min(moment).alias("first"))
    after = W.partitionBy("key_hash").orderBy("part").rowsBetween(1, W.unboundedFollowing)
    firsts = firsts.select("key_hash", "part", F.min("first").over(after).alias("later"))
    within = W.partitionBy("key_hash", "part").orderBy("at", "kind").rowsBetween(1, W.unboundedFollowing)
    rows = rows.withColumn("own", F.min(moment).over(within)).filter("kind = 1")
    rows = rows.join(firsts, ["key_hash", "part"])
    return rows.select("key_hash", "event_ts", F.coalesce("own", "later").alias("next_ts"))


def _rearm_by_doubling(keyed: DataFrame) -> DataFrame:
    """Requests of one key at one moment are one node, of which the smallest id counts."""
    grouped = keyed.groupBy("key_hash", "event_ts")
    nodes = durable(grouped.agg(F.min("event_id").alias("event_id"), F.first("ttl_hours").alias("ttl_hours")), "nodes")
    jump = durable(_next_acceptable(nodes).filter("next_ts is not null"), "jump")
    span = nodes.groupBy("key_hash").agg(
        F.min("event_ts").alias("event_ts"),
        (F.unix_seconds(F.max("event_ts").cast("timestamp")) - F.unix_seconds(F.min("event_ts").cast("timestamp"))).alias("seconds"),
        F.min("ttl_hours").alias("hours"),
    )
    span = durable(span, "spans")
    steps = span.agg(F.max(F.expr("seconds div (hours * 3600)"))).first()[0] or 0  # of the longest chain
    jumps = [jump]
    for _ in range(int(steps).bit_length()):
        ahead = jumps[-1].select("key_hash", F.col("event_ts").alias("next_ts"), F.col("next_ts").alias("then_ts"))
        jump = jumps[-1].join(ahead, ["key_hash", "next_ts"]).select("key_hash", "event_ts", F.col("then_ts").alias("next_ts"))
        jumps.append(durable(jump, "jump"))
    reached = span.select("key_hash", "event_ts")
    for jump in reversed(jumps):  # what is reached doubles with every step
        found = reached.join(jump, ["key_hash", "event_ts"]).select("key_hash", F.col("next_ts").alias("event_ts"))
        reached = durable(reached.unionByName(found).distinct(), "reached")
    return nodes.join(reached, ["key_hash", "event_ts"]).select("key_hash", *ORDER)
