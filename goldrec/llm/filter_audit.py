"""Audit of how filters interact: what each removes in every order they may run in.

A document fails a set of filters, whatever the order, so the table folds into counts per
part and set of failed filters. The orders are the paths through the lattice of filter
subsets, from none applied to all. Counting paths forward (orders that reach a subset) and
backward (orders that go on from it) weighs every edge, a filter applied after a subset,
by the orders that pass over it. A filter's Shapley sum is the sum of its edges' weight
times what the edge removes, and the steps of one order are read from the same edges.

Defined results: a null text is empty, a null part the empty string; a null key is neither
smaller nor larger than any, so its row never counts as a copy; repeated rows count one by
one, and rows with equal text and key are all the first; of several labels of a key any
that says 1 counts; other columns are not looked at; an empty table gives an empty table.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldrec.plans.durable import durable
from goldrec.plans.skew import join_unique

FILTERS = "ABCDE"

# ---- what every document fails --------------------------------------------

MIN_WORDS = 100
DISTINCT_PERCENT = 80
CAPITAL_PERCENT = 10
SYMBOLS = "[#$%&*|]"


def text_failures(text: Column, words: Column) -> list[Column]:
    """The filters that look at one text: short, repetitive, shouting, symbols."""
    n = F.size(words)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [
        n < MIN_WORDS,
        F.size(F.array_distinct(words)) * 100 < n * DISTINCT_PERCENT,
        capitals * 100 > F.length(text) * CAPITAL_PERCENT,
        text.rlike(SYMBOLS),
    ]


def _mask(flags: list[Column]) -> Column:
    bits = [F.when(flag, F.lit(1 << i)).otherwise(0) for i, flag in enumerate(flags)]
    return sum(bits[1:], bits[0]).cast("int")


def failed_sets(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    part: str = "lang",
) -> DataFrame:
    """``part, mask, n, good, toxic``: documents per part and set of failed filters (bit i:
    filter i), of these with quality 1 and with toxic 1.

    Texts are read once; what goes on is a digest of each. Rows of one text and key are
    counted before they are shuffled, so the join that marks a text's first key has no
    hot key; hot keys of the labels are joined by broadcast.
    """
    rows = docs.select(
        docs[key].alias("key"),
        F.coalesce(docs[part].cast("string"), F.lit("")).alias("part"),
        F.coalesce(docs[text].cast("string"), F.lit("")).alias("body"),
    )
    words = F.array_remove(F.split("body", r"[\x20\x09-\x0D]+"), "")
    rows = rows.withColumn("words", words).select(
        "key",
        "part",
        F.sha2(F.col("body").cast("binary"), 256).alias("digest"),
        _mask(text_failures(F.col("body"), F.col("words"))).alias("own"),
    )
    rows = rows.groupBy("digest", "key", "part", "own").agg(F.count(F.lit(1)).alias("n"))
    rows = durable(rows, "failures")
    firsts = rows.filter("key is not null").groupBy("digest").agg(F.min("key").alias("key"))
    rows = rows.join(firsts.withColumn("first", F.lit(True)), ["digest", "key"], "left")
    copy = F.col("key").isNotNull() & F.col("first").isNull()
    rows = rows.select(
        "key",
        "part",
        (F.col("own") + F.when(copy, 1 << 4).otherwise(0)).alias("mask"),
        "n",
    )
    rows = rows.groupBy("key", "part", "mask").agg(F.sum("n").alias("n"))
    counts = [
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("quality"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("harm"), F.col("n")).otherwise(0)).alias("toxic"),
    ]
    rows = durable(rows, "masks")
    marks = labels.groupBy(labels["doc_id"].alias("key")).agg(
        F.max(F.coalesce(labels["quality"] == 1, F.lit(False))).alias("quality"),
        F.max(F.coalesce(labels["toxic"] == 1, F.lit(False))).alias("harm"),
    )
    marks = marks.filter("key is not null and (quality or harm)")
    no = F.lit(False)
    unmarked = rows.filter("key is null").withColumns({"quality": no, "harm": no})
    marked = join_unique(rows.filter("key is not null"), marks, "key", how="left", bound=rows)
    marked = marked.unionByName(unmarked)
    return marked.groupBy("part", "mask").agg(*counts)


# ---- the lattice -----------------------------------------------------------


def edges(n: int) -> list[tuple[int, int, int]]:
    """``state, filter, weight`` of every edge of the lattice of subsets of ``n`` filters:
    the orders that reach the state times those that go on behind the filter."""
    full = (1 << n) - 1
    reach, leave = [0] * (full + 1), [0] * (full + 1)
    reach[0] = leave[full] = 1
    for state in range(full + 1):
        for i in range(n):
            if not state >> i & 1:
                reach[state | 1 << i] += reach[state]
    for state in range(full, -1, -1):
        for i in range(n):
            if not state >> i & 1:
                leave[state] += leave[state | 1 << i]
    return [
        (s, i, reach[s] * leave[s | 1 << i])
        for s in range(full + 1)
        for i in range(n)
        if not s >> i & 1
    ]


def audit(counts: DataFrame, names: str = FILTERS) -> DataFrame:
    """One row per part, order and step from ``failed_sets``-like counts.

    All tables joined here have a size that depends on the number of filters only, and
    are joined on the mask, the edge or the filter.
    """
    spark, n = counts.sparkSession, len(names)
    masks = range(1 << n)
    lattice = edges(n)

    def small(rows: list[tuple], schema: str) -> DataFrame:
        return F.broadcast(spark.createDataFrame(rows, schema))

    # every part has a row for every mask, so that every edge has one
    blank = counts.select("part").distinct().withColumns(
        {"mask": F.explode(F.array(*(F.lit(m) for m in masks))), "n": F.lit(0), "good": F.lit(0), "toxic": F.lit(0)}
    )
    sums = [F.sum(c).cast("long").alias(c) for c in ("n", "good", "toxic")]
    counts = durable(counts.unionByName(blank).groupBy("part", "mask").agg(*sums), "counts")

    over = [(m, s, i, w) for s, i, w in lattice for m in masks if not m & s and m >> i & 1]
    edge_rows = counts.join(small(over, "mask int, state int, i int, weight long"), "mask")
    edge_rows = edge_rows.groupBy("part", "state", "i").agg(
        F.sum("n").alias("removed"),
        F.sum("good").alias("good_lost"),
        F.sum("toxic").alias("toxic_lost"),
        F.first("weight").alias("weight"),
    )
    left = [(m, s | 1 << i, s, i) for s, i, _ in lattice for m in masks if not m & (s | 1 << i)]
    kept = counts.join(small(left, "mask int, upto int, state int, i int"), "mask")
    kept = kept.groupBy("part", "state", "i").agg(F.sum("n").alias("kept"))
    fails = [(m, i, m == 1 << i) for i in range(n) for m in masks if m >> i & 1]
    by_filter = counts.join(small(fails, "mask int, i int, alone boolean"), "mask").groupBy("part", "i")
    by_filter = by_filter.agg(
        F.sum("n").alias("fails"), F.sum(F.when(F.col("alone"), F.col("n"))).alias("unique_fails")
    )
    shapley = edge_rows.groupBy("part", "i").agg(F.sum(F.col("removed") * F.col("weight")).alias("shapley"))

    steps = []
    for order in permutations(range(n)):
        state = 0
        for step, i in enumerate(order, 1):
            steps.append(("".join(names[j] for j in order), step, state, i))
            state |= 1 << i
    joined = edge_rows.join(kept, ["part", "state", "i"]).join(by_filter, ["part", "i"]).join(shapley, ["part", "i"])
    joined = joined.join(small(steps, "filter_order string, step int, state int, i int"), ["state", "i"])
    return joined.select(
        "part",
        "filter_order",
        "step",
        "kept",
        "removed",
        (F.col("fails") - F.col("removed")).alias("redundant"),
        "unique_fails",
        "good_lost",
        "toxic_lost",
        "shapley",
    )
