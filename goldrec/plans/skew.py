"""Hot keys: find them, and keep their rows out of single-task groups.

A key that holds more than ``limit`` rows is hot. Every per-key window in this
package runs over cold keys only; hot keys take a second way that works on many
tasks (a broadcast of one row per hot key, or ordered chunks).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from goldrec.plans.durable import durable

HOT_ROWS = 1_000_000
# A list of hot keys is broadcast up to this length (N rows hold at most N/limit keys
# above the limit); a longer one is joined by a shuffle, in which AQE splits the hot keys.
MAX_HOT_KEYS = 200_000
# Rows of one key that meet in one task of a join of pairs: their product is its work.
PAIRED_ROWS = 1 << 13
# Keys are counted in buckets first: a key above the limit makes its bucket pass
# the limit, so usually one small shuffle of bucket counts rules out any hot key.
BUCKETS = 1 << 18


def hot_rows(spark: SparkSession) -> int:
    return int(spark.conf.get("goldrec.hot.rows", str(HOT_ROWS)))


@dataclass(frozen=True)
class HotKeys:
    """Keys with more than ``limit`` rows (one row per key, ``n`` = its size)."""

    keys: tuple[str, ...]
    table: DataFrame
    limit: int
    count: int = 0

    def small(self, df: DataFrame) -> DataFrame:
        """``df``, at most one row per hot key, to be broadcast if the keys are few."""
        return F.broadcast(df) if self.count <= MAX_HOT_KEYS else df

    def cold(self, df: DataFrame) -> DataFrame:
        return df.join(self.small(self.table.select(*self.keys)), list(self.keys), "left_anti")

    def hot(self, df: DataFrame) -> DataFrame:
        return df.join(self.small(self.table.select(*self.keys)), list(self.keys), "left_semi")


def find_hot_keys(
    df: DataFrame,
    *keys: str,
    limit: int | None = None,
    bucket_by: Column | None = None,
    bound: DataFrame | None = None,
) -> HotKeys | None:
    """The keys with more than ``limit`` rows; None when there are none, which is
    the usual case. ``bucket_by`` may be any expression equal for rows of one key.
    ``bound`` may be a stored table with at least as many rows: its count comes
    from file footers, and a table within the limit cannot hold a hot key."""
    limit = limit or hot_rows(df.sparkSession)
    if bound is not None and bound.count() <= limit:
        return None
    over = F.col("n") > limit
    size = F.count(F.lit(1)).alias("n")
    by = keys if bucket_by is None else (bucket_by,)
    bucketed = df.select(*keys, F.pmod(F.xxhash64(*by), F.lit(BUCKETS)).alias("_bucket"))
    full = bucketed.groupBy("_bucket").agg(size).filter(over)
    if full.isEmpty():
        return None
    full = F.broadcast(durable(full.select("_bucket"), "full-buckets"))  # at most BUCKETS rows
    counts = bucketed.join(full, "_bucket", "left_semi").groupBy(*keys).agg(size).filter(over)
    table = durable(counts, "hot-keys")
    found = table.count()
    return HotKeys(tuple(keys), table, limit, found) if found else None


def join_unique(
    rows: DataFrame,
    unique: DataFrame,
    *keys: str,
    how: str = "inner",
    bound: DataFrame | None = None,
) -> DataFrame:
    """Join many rows with a table that holds at most one row per key.

    Rows of hot keys meet their one partner by broadcast and are not shuffled;
    the rest is a plain equi-join.
    """
    on = list(keys)
    hot = find_hot_keys(rows, *keys, bound=bound)
    if hot is None:
        return rows.join(unique, on, how)
    partners = hot.small(hot.hot(unique))
    return hot.cold(rows).join(unique, on, how).unionByName(hot.hot(rows).join(partners, on, how))


def mark_first(rows: DataFrame, hot: HotKeys, candidate: Column, name: str) -> DataFrame:
    """Add ``name``: true for exactly one of the ``candidate`` rows of each hot key.

    Candidates are equal rows, of which there may be many, so they are numbered where they
    lie and the smallest number is a partial aggregate; no other row is shuffled.
    """
    candidate = F.coalesce(candidate, F.lit(False))
    found = durable(rows.filter(candidate).withColumn("_row", F.monotonically_increasing_id()), "first-rows")
    best = found.groupBy(*hot.keys).agg(F.min("_row").alias("_best"))
    marked = found.join(hot.small(best), list(hot.keys)).withColumn(name, F.col("_row") == F.col("_best"))
    others = rows.filter(~candidate).withColumn(name, F.lit(False))
    return others.unionByName(marked.select(*others.columns))


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows in as many tasks as a shuffle has: they are small, the work on each is not."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *keys)


def salted_join(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str) -> DataFrame:
    """Inner join on ``key`` where either side may hold very many rows per key.

    A key with more than ``PAIRED_ROWS`` (or the hot limit) of rows on a side is split into
    parts of that size by a hash of the row's id, and the other side's rows of that key
    are sent to every part. All pairs are kept; no task gets a whole hot key. Pairs are many
    times the rows, so tasks are not merged by the size of their rows.
    """
    limit = min(hot_rows(left.sparkSession), PAIRED_ROWS)

    def parts(df: DataFrame, name: str) -> DataFrame | None:
        hot = find_hot_keys(df, key, limit=limit, bound=df)
        if hot is None:
            return None
        n_parts = F.ceil(F.col("n") / F.lit(hot.limit)).cast("int")
        return hot.small(hot.table.select(key, n_parts.alias(name)))

    left_parts, right_parts = parts(left, "_lp"), parts(right, "_rp")
    if left_parts is None and right_parts is None:
        return spread(left, key).join(spread(right, key), key)

    def salted(df: DataFrame, row_id: str, own: str, own_salt: str, other: str, other_salt: str):
        for table in (left_parts, right_parts):
            if table is not None:
                df = df.join(table, key, "left")
        for name in ("_lp", "_rp"):
            present = F.coalesce(name, F.lit(1)) if name in df.columns else F.lit(1)
            df = df.withColumn(name, present)
        salt = F.pmod(F.xxhash64(row_id), F.col(own)).cast("int")
        return (
            df.withColumn(own_salt, salt)
            .withColumn(other_salt, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
            .drop("_lp", "_rp")
        )

    on = [key, "_ls", "_rs"]
    mine = spread(salted(left, left_id, "_lp", "_ls", "_rp", "_rs"), *on)
    return mine.join(spread(salted(right, right_id, "_rp", "_rs", "_lp", "_ls"), *on), on).drop("_ls", "_rs")
