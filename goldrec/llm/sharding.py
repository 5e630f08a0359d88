"""Resharding by minimum-cost flow: move the fewest bytes, rewrite affected files only.

The old layout is a table of files, one per old shard and block of rows. From old shard
sizes and new capacities (shards alone, so a few dozen numbers) a minimum-cost flow
gives the bytes to move between each pair of shards. A shard's blocks lie along a line
of bytes that is cut by its outflows: whole blocks go to one shard, blocks on a cut are
split between rows. What row sizes leave over is evened out by a second flow that moves
the smallest rows. Files with a row that moves are rewritten, the others stay.

No window runs over a shard: running sums run over blocks, and over rows of one block.

Defined results: a null text has no bytes, its row counts 1; rows with null or equal
keys are placed like others, repeated rows one by one; other columns go along whatever
their names; an empty table gives an empty table.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from goldrec.plans.durable import work_path

#: Bytes of text in one file of the layout, about.
BLOCK_BYTES = 8 << 20
#: Files of a layout at most, so that a table with a row a file may be broadcast; where
#: this bound is met, files are larger.
MOST_BLOCKS = 1 << 16
#: Ranges of moved rows that are broadcast; longer lists are joined by shuffling.
MOST_RANGES = 1 << 18
#: Smallest rows of each shard that the last moves choose from.
LAST_ROWS = 256
#: Bytes of each shard from which the second flow picks its small rows, about.
POOL_BYTES = 32 << 20


def transfers(
    sizes: list[int], capacities: list[int], cost: list[list[int]] | None = None
) -> list[list[int]]:
    """Bytes from each old to each new shard at least cost; to stay costs nothing, and a
    moved byte 1 unless ``cost`` says otherwise. Both sides must have equal sums.

    Successive shortest paths over the residual graph of shards.
    """
    n, m = len(sizes), len(capacities)
    if cost is None:
        cost = [[int(s != t) for t in range(m)] for s in range(n)]
    flow = [[0] * m for _ in range(n)]
    left, room = list(sizes), list(capacities)
    while any(left):
        far = [0 if x else None for x in left] + [None] * m
        came: list[int | None] = [None] * (n + m)
        changed = True
        while changed:
            changed = False
            for s in range(n):
                for t in range(m):
                    steps = [(s, n + t, cost[s][t])]
                    if flow[s][t]:
                        steps.append((n + t, s, -cost[s][t]))
                    for a, b, c in steps:
                        if far[a] is not None and (far[b] is None or far[a] + c < far[b]):
                            far[b], came[b], changed = far[a] + c, a, True
        at = min((t for t in range(m) if room[t] and far[n + t] is not None), key=lambda t: far[n + t])
        path = [n + at]
        while came[path[-1]] is not None:
            path.append(came[path[-1]])
        path.reverse()
        amount = min(left[path[0]], room[at])
        for a, b in zip(path, path[1:], strict=False):
            if a >= n:
                amount = min(amount, flow[b][a - n])
        for a, b in zip(path, path[1:], strict=False):
            if a < n:
                flow[a][b - n] += amount
            else:
                flow[b][a - n] -= amount
        left[path[0]] -= amount
        room[at] -= amount
    return flow


def even(total: int, n: int) -> list[int]:
    return [total * (i + 1) // n - total * i // n for i in range(n)]


def row_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text.cast("string")), F.lit(0)).cast("long") + 1


PLACE = ("old_shard", "block", "ordinal")


# ---- the old layout -------------------------------------------------------


@dataclass(frozen=True)
class Layout:
    """A stored table of ``row`` (struct), ``size``, and its place: ``old_shard``, ``block``
    and ``ordinal``, gapless from 0 within the block."""

    table: DataFrame
    path: str
    shards: int


def lay_out(docs: DataFrame, key: str, text: str, shards: int, block_bytes: int = BLOCK_BYTES) -> Layout:
    """Write ``docs`` as the layout a job starts from: shard by a hash of the key."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(row_size(F.col(text)))).first()[0] or 0
    n_blocks = min(max(1, -(-total // (shards * block_bytes))), MOST_BLOCKS // shards)
    shard = F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(shards))
    rows = docs.select(
        F.struct(*(docs[c] for c in docs.columns)).alias("row"),
        row_size(F.col(text)).alias("size"),
        shard.cast("int").alias("old_shard"),
        F.pmod(F.xxhash64(F.col(key), F.col(text).cast("string")), F.lit(n_blocks)).cast("int").alias("block"),
    )
    in_block = W.partitionBy("old_shard", "block").orderBy(F.col("row")[key])
    rows = rows.withColumn("ordinal", (F.row_number().over(in_block) - 1).cast("long"))
    path = work_path(spark, "layout")
    rows.write.partitionBy("old_shard", "block").option("compression", "zstd").parquet(path)
    return Layout(spark.read.schema(rows.schema).parquet(path), path, shards)


# ---- where rows go --------------------------------------------------------


def _cuts(flow: list[list[int]]) -> list[tuple[int, int, int, int]]:
    """``old, new, from, upto``: the line of each old shard cut into its outflows, what
    stays first."""
    out = []
    for s, row in enumerate(flow):
        at = 0
        for t in sorted(range(len(row)), key=lambda t: (t != s, t)):
            if row[t]:
                out.append((s, t, at, at + row[t]))
                at += row[t]
    return out


def _sizes(rows: DataFrame, shard: str, n: int) -> list[int]:
    found = {r[0]: r[1] for r in rows.groupBy(shard).agg(F.sum("size")).collect()}  # a row per shard
    return [found.get(i, 0) for i in range(n)]


def _table(spark, rows: list[tuple], schema: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(rows, schema))  # at most old times new shards


def assign(layout: Layout, shards: int) -> DataFrame:
    """``old_shard, block, ordinal, size, shard`` for every row; shard sizes near equal."""
    spark = layout.table.sparkSession
    rows = layout.table.select(*PLACE, "size")
    sizes = _sizes(rows, "old_shard", layout.shards)
    capacities = even(sum(sizes), shards)
    cuts = _table(spark, _cuts(transfers(sizes, capacities)), "old_shard int, shard int, lo long, hi long")
    along = W.partitionBy("old_shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = rows.groupBy("old_shard", "block").agg(F.sum("size").alias("n"))
    blocks = blocks.select(
        "old_shard", "block", "n", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("block_at")
    )
    parts = blocks.join(cuts, "old_shard").filter("lo < block_at + n and block_at < hi")
    own = W.partitionBy("old_shard", "block").orderBy("ordinal").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn("at", F.coalesce(F.sum("size").over(own), F.lit(0)))
    middle = F.col("block_at") + F.col("at") + F.expr("size div 2")
    first = (
        placed.join(parts, ["old_shard", "block"])
        .filter((middle >= F.col("lo")) & (middle < F.col("hi")))
        .select(*PLACE, "size", "shard")
    )
    path = work_path(spark, "assigned")
    first.write.parquet(path)
    first = spark.read.schema(first.schema).parquet(path)
    return _even_out(first, capacities, shards)


def _even_out(rows: DataFrame, capacities: list[int], shards: int) -> DataFrame:
    """Move the smallest rows, of files that are rewritten anyway, so that shard sizes come
    as near as rows allow."""
    spark = rows.sparkSession
    sizes = _sizes(rows, "shard", shards)
    flow = transfers(sizes, capacities)
    cuts = [c for c in _cuts(flow) if c[0] != c[1]]
    if not cuts:
        return rows
    lows = {s: min(lo for x, _, lo, _ in cuts if x == s) for s, *_ in cuts}
    moved = [(s, t, lo - lows[s], hi - lows[s]) for s, t, lo, hi in cuts]
    most = max(hi for *_, hi in moved)
    pools = max(1, max(sizes) // max(POOL_BYTES, 4 * most))
    pool = rows.join(_touched(rows), ["old_shard", "block"], "left_semi")
    pool = pool.filter(F.pmod(F.xxhash64(*PLACE), F.lit(pools)) == 0)
    ascending = W.partitionBy("old").orderBy("size", *PLACE).rowsBetween(W.unboundedPreceding, 0)
    pool = pool.select(*PLACE, F.col("shard").alias("old"), "size").withColumn("upto", F.sum("size").over(ascending))
    table = _table(spark, moved, "old int, to int, lo long, hi long")
    fixes = (
        pool.filter(F.col("upto") <= most)
        .join(table, "old")
        .filter("upto - size >= lo and upto <= hi")
        .select(*PLACE, "to")
    )
    path = work_path(spark, "evened")
    fixes.write.parquet(path)
    fixes = spark.read.schema(fixes.schema).parquet(path)
    rows = rows.join(fixes, list(PLACE), "left").withColumn("shard", F.coalesce("to", "shard")).drop("to")

    # what is left is less than a row or two: single moves among the smallest rows
    rank = F.row_number().over(W.partitionBy("shard").orderBy("size", *PLACE))
    smallest = pool.select(*PLACE).join(rows, list(PLACE)).withColumn("rank", rank)
    smallest = smallest.filter(F.col("rank") <= LAST_ROWS).select(*PLACE, "size", "shard")
    moves = _single_moves(_sizes(rows, "shard", shards), [tuple(r) for r in smallest.collect()])
    if not moves:
        return rows
    places = "old_shard int, block int, ordinal long, to int"
    last = F.broadcast(spark.createDataFrame(moves, places))  # at most LAST_ROWS a shard
    return rows.join(last, list(PLACE), "left").withColumn("shard", F.coalesce("to", "shard")).drop("to")


def _single_moves(sizes: list[int], rows: list[tuple]) -> list[tuple]:
    """``old_shard, block, ordinal, to`` of rows (``.., size, shard``) whose moves bring shard
    sizes nearer to each other, one move at a time, until none does.

    A move or an exchange from a larger to a smaller shard is the better the nearer it comes
    to half of the difference; the pair of shards furthest apart goes first.
    """
    sizes, held = list(sizes), {s: [] for s in range(len(sizes))}
    for *place, size, shard in rows:
        held[shard].append((size, tuple(place)))
    for own in held.values():
        own.sort()
    start = {place: s for s, own in held.items() for _, place in own}
    for _ in range(4 * len(rows)):
        best = None
        order = sorted(range(len(sizes)), key=sizes.__getitem__)
        for a, b in [(order[-1], t) for t in order[:-1]] + [(s, order[0]) for s in order[1:-1]]:
            gap = sizes[a] - sizes[b]
            for size, place in held[a]:
                others = [(0, None)]
                at = bisect_left(held[b], (size - gap // 2,))
                others += held[b][max(at - 1, 0) : at + 1]
                for other, back in others:
                    gain = gap - abs(gap - 2 * (size - other))
                    if 0 < size - other < gap and (best is None or gain > best[0]):
                        best = gain, a, b, (size, place), (other, back)
            if best:
                break
        if not best:
            break
        _, a, b, out, back = best
        held[a].remove(out)
        insort(held[b], out)
        sizes[a] -= out[0] - back[0]
        sizes[b] += out[0] - back[0]
        if back[1] is not None:
            held[b].remove(back)
            insort(held[a], back)
    return [(*place, s) for s, own in held.items() for _, place in own if start[place] != s]


def _touched(rows: DataFrame) -> DataFrame:
    """Files with a row that moves: at most ``MOST_BLOCKS``."""
    return F.broadcast(rows.filter("old_shard <> shard").select("old_shard", "block").distinct())


def with_slots(rows: DataFrame) -> DataFrame:
    """Add ``slot``: gapless from 0 within each shard, in order of old block and row, and
    ``before``, the first slot of the row's block."""
    group = ["shard", "old_shard", "block"]
    counts = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    along = W.partitionBy("shard").orderBy("old_shard", "block").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(*group, F.coalesce(F.sum("n").over(along), F.lit(0)).cast("long").alias("before"))
    own = F.row_number().over(W.partitionBy(*group).orderBy("ordinal")) - 1
    rows = rows.withColumn("own", own).join(counts, group)
    return rows.withColumn("slot", (F.col("before") + F.col("own")).cast("long")).drop("own")


def _ranges(placed: DataFrame) -> DataFrame:
    """Neighbouring rows of a block that go to one shard as ``lo .. hi`` and the ``shift``
    from ordinal to slot: one row a block, but for blocks on a cut and evened-out rows."""
    ranges = placed.groupBy("old_shard", "block", "shard", (F.col("slot") - F.col("ordinal")).alias("shift"))
    ranges = ranges.agg(F.min("ordinal").alias("lo"), F.max("ordinal").alias("hi"))
    path = work_path(placed.sparkSession, "ranges")
    ranges.write.parquet(path)
    return placed.sparkSession.read.schema(ranges.schema).parquet(path)


# ---- files ----------------------------------------------------------------


def reshard(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    old_shards: int = 12,
    shards: int = 16,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows of ``docs`` (struct ``row``) from the files after resharding, with
    ``shard`` and ``slot``. Files whose rows all stay are read where they lie."""
    spark = docs.sparkSession
    layout = lay_out(docs, key, text, old_shards, block_bytes)
    path = work_path(spark, "placed")
    placed = with_slots(assign(layout, shards)).select(*PLACE, "shard", "slot", "before")
    placed.write.parquet(path)
    placed = spark.read.schema(placed.schema).parquet(path)
    touched = _touched(placed)
    ranges = _ranges(placed.join(touched, ["old_shard", "block"], "left_semi"))
    if ranges.count() <= MOST_RANGES:
        ranges = F.broadcast(ranges)
    rewritten = layout.table.join(ranges, ["old_shard", "block"]).filter("ordinal between lo and hi")
    rewritten = rewritten.select("row", (F.col("ordinal") + F.col("shift")).alias("slot"), "shard")
    new_path = work_path(spark, "rewritten")
    rewritten.write.partitionBy("shard").option("compression", "zstd").parquet(new_path)
    rewritten = spark.read.schema(rewritten.schema).parquet(new_path)
    # a file that stays lies whole in its shard: its rows follow from its first slot
    first = placed.filter("ordinal = 0").join(touched, ["old_shard", "block"], "left_anti")
    first = F.broadcast(first.select("old_shard", "block", "before"))  # at most MOST_BLOCKS
    stayed = layout.table.join(first, ["old_shard", "block"])
    stayed = stayed.select(
        "row", (F.col("before") + F.col("ordinal")).alias("slot"), F.col("old_shard").alias("shard")
    )
    return stayed.unionByName(rewritten).select("row", "shard", "slot")
