"""Mixing sources to target weights by temperature, with DataFrame functions only.

Token shares are raised to an exponent between 0 (all sources equal) and 1 (as they
are) and normalised. The exponent is found by sectioning: each round evaluates a few
dozen exponents over the per-source counts in one small aggregation. The weights are
then realised with a token budget: a source is passed over as often as its budget
holds it, and the last pass stops where the budget ends. Every pass takes the blocks
of a source, and the rows of a block, in an order of its own.

No window or group runs over a whole source: rows are counted per block, running sums
run over blocks, and rows are ordered only in the one block a source where a pass stops.

Defined results: words of a null text: none; a null source counts as ``''``; sources
without tokens have weight 0 and their rows pass once; rows with equal ids are taken
together; other columns are untouched; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from goldrec.plans.durable import durable

#: Exponents are multiples of 1 / STEPS, weights of 1 / UNITS.
STEPS = 1_000_000
UNITS = 1_000_000_000
SECTIONS = 32


@dataclass(frozen=True)
class Mix:
    """``entropy``: flatten until the weights reach this part of the largest entropy;
    or ``repeat``: flatten as far as no source is passed over more often than this.
    ``epochs``: tokens to give out, as a multiple of all tokens; by default as many as pass
    over each source once at least.
    Blocks hold ``block_tokens``, or more where a source would have over ``most_blocks``."""

    entropy: float | None = None
    repeat: float | None = None
    epochs: float | None = None
    seed: int = 7
    block_tokens: int = 1 << 18
    most_blocks: int = 1 << 20


def n_tokens(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _hash(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))


def _block(key: Column, n_blocks: Column) -> Column:
    return F.pmod(F.conv(F.substring(_hash(key), 1, 8), 16, 10).cast("long"), n_blocks)


# ---- weights --------------------------------------------------------------


def exponent(sources: DataFrame, mix: Mix) -> int:
    """The exponent in steps: the largest that reaches the entropy, or the smallest
    that keeps to the repetition limit. ``sources``: one row each, with ``tokens``."""
    used = sources.filter("tokens > 0")
    n, total, least, most = used.agg(F.count("*"), F.sum("tokens"), F.min("tokens"), F.max("tokens")).first()
    if not n:
        return STEPS
    share = F.col("tokens") / F.lit(float(total))

    def reached(points: list[int]) -> dict[int, bool]:
        rows = used.select(share.alias("p"), F.explode(F.array(*map(F.lit, points))).alias("step"))
        a = F.col("step") / F.lit(float(STEPS))
        rows = rows.select("step", F.pow("p", a).alias("w"), (a * F.log("p")).alias("log_w"))
        sums = rows.groupBy("step").agg(F.sum("w").alias("z"), F.sum(F.col("w") * F.col("log_w")).alias("s"))
        z = F.col("z")
        if mix.entropy is not None:
            goal = mix.entropy * F.log(F.lit(float(n)))
            good = F.log(z) - F.col("s") / z >= goal - F.lit(1e-12)
        else:
            power = F.col("step") / F.lit(float(STEPS)) - 1
            often = F.pow(F.lit(least / total), power)
            if mix.epochs is None:
                often = often / F.pow(F.lit(most / total), power)
            else:
                often = often / z * F.lit(float(mix.epochs))
            good = often <= F.lit(mix.repeat) + F.lit(1e-12)
        return {r.step: r.good for r in sums.select("step", good.alias("good")).collect()}

    # along the exponent the entropy falls, and so does the repetition of small sources
    falls = mix.entropy is not None
    low, high = 0, STEPS
    ends = reached([low, high])
    if falls and ends[high] or not falls and not ends[high]:
        return high
    if falls and not ends[low] or not falls and ends[low]:
        return low
    while high - low > 1:
        points = sorted({low + (high - low) * i // SECTIONS for i in range(1, SECTIONS)} - {low})
        good = reached(points)
        low = max([low, *(p for p in points if good[p] == falls)])
        high = min([high, *(p for p in points if good[p] != falls)])
    return low if falls else high


def weights(sources: DataFrame, mix: Mix) -> DataFrame:
    """Add ``exponent_ppm``, ``weight_ppb``, ``goal`` (tokens to give out), ``passes``
    (whole ones) and ``rest`` (tokens of the last one)."""
    step = exponent(sources, mix)
    used = sources.filter("tokens > 0")
    power = step / STEPS
    z, total, least_ratio = used.agg(
        F.sum(F.pow(F.col("tokens").cast("double"), F.lit(power))),
        F.sum("tokens"),
        F.max(F.col("tokens") / F.pow(F.col("tokens").cast("double"), F.lit(power))),
    ).first()
    if not total:
        z, total, least_ratio = 1.0, 0, 0.0
    budget = int(least_ratio * z) if mix.epochs is None else int(total * mix.epochs)
    weight = F.round(F.pow(F.col("tokens").cast("double"), F.lit(power)) / F.lit(z) * UNITS).cast("long")
    goal = F.expr(f"cast(weight_ppb as decimal(10, 0)) * cast({budget} as decimal(19, 0)) div {UNITS}")
    if mix.epochs is None:
        goal = F.greatest(goal, F.col("tokens"))
    empty = F.col("tokens") == 0
    return (
        sources.withColumn("exponent_ppm", F.lit(step).cast("long"))
        .withColumn("weight_ppb", F.when(empty, F.lit(0).cast("long")).otherwise(weight))
        .withColumn("goal", F.when(empty, F.lit(0).cast("long")).otherwise(goal))
        .withColumn("passes", F.when(empty, F.lit(1).cast("long")).otherwise(F.expr("goal div tokens")))
        .withColumn("rest", F.when(empty, F.lit(0).cast("long")).otherwise(F.expr("goal % tokens")))
    )


# ---- passes ---------------------------------------------------------------


def schedule(rows: DataFrame, mix: Mix) -> tuple[DataFrame, DataFrame]:
    """From ``key, source, tokens``: the weighted sources with their ``n_blocks``, and one
    row per source, block and pass (``epoch``) that takes it, with its ``block_position``
    and, where the pass stops inside the block, the last order key it takes (``cut``)."""
    stats = rows.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    n_blocks = F.ceil(F.col("tokens") / F.lit(mix.block_tokens))
    n_blocks = F.least(F.greatest(n_blocks, F.lit(1)), F.lit(mix.most_blocks)).cast("long")
    sources = durable(weights(durable(stats, "sources"), mix).withColumn("n_blocks", n_blocks), "weights")
    blocked = rows.join(sources.select("source", "n_blocks"), "source").select(
        "source", _block(F.col("key"), F.col("n_blocks")).alias("block"), "key", "tokens"
    )
    blocked = durable(blocked, "blocked")
    blocks = blocked.groupBy("source", "block").agg(F.sum("tokens").alias("n"))
    passes = (
        blocks.join(sources.select("source", "passes", "rest"), "source")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), "passes")))
        .withColumn("_order", _hash(F.col("source"), F.col("block"), F.col("epoch"), F.lit(mix.seed)))
    )
    in_order = W.partitionBy("source", "epoch").orderBy("_order", "block")
    passes = passes.withColumns(
        {
            "block_position": (F.row_number().over(in_order) - 1).cast("long"),
            "upto": F.sum("n").over(in_order.rowsBetween(W.unboundedPreceding, 0)),
        }
    )
    passes = passes.filter("epoch < passes or rest > 0")
    whole = (F.col("epoch") < F.col("passes")) | (F.col("upto") <= F.col("rest"))
    passes = durable(
        passes.filter(whole | (F.col("upto") - F.col("n") < F.col("rest"))).withColumn("whole", whole), "passes"
    )
    # the block where the last pass stops: take its rows in order while the budget holds them
    stops = passes.filter("not whole").select(
        "source", "block", "epoch", (F.col("rest") - F.col("upto") + F.col("n")).alias("left")
    )
    inside = blocked.join(stops, ["source", "block"]).withColumn(
        "order_key", order_key(F.col("key"), F.col("epoch"), mix)
    )
    upto = F.sum("tokens").over(W.partitionBy("source", "block", "epoch").orderBy("order_key"))
    cuts = (
        inside.withColumn("upto", upto)
        .filter("upto <= left")
        .groupBy("source", "block", "epoch")
        .agg(F.max("order_key").alias("cut"))
    )
    taken = passes.join(cuts, ["source", "block", "epoch"], "left").filter("whole or cut is not null")
    return sources, taken.select("source", "block", "epoch", "block_position", "cut")


def order_key(key: Column, epoch: Column, mix: Mix) -> Column:
    return _hash(key, epoch, F.lit(mix.seed), F.lit("row"))


def mixed(
    docs: DataFrame,
    mix: Mix,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """The rows of ``docs`` (struct ``row``) as often as the mixture takes them, with
    ``epoch``, ``block``, ``block_position`` and ``order_key`` (a pass in its order: by
    block position, then by order key) and the source's ``exponent_ppm, weight_ppb``."""
    of_source = F.coalesce(F.col(source).cast("string"), F.lit(""))
    rows = durable(
        docs.select(F.col(key).alias("key"), of_source.alias("source"), n_tokens(text).alias("tokens")), "tokens"
    )
    sources, taken = schedule(rows, mix)
    found = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), of_source.alias("source"))
    found = found.join(sources.select("source", "n_blocks", "exponent_ppm", "weight_ppb"), "source")
    found = found.withColumn("block", _block(F.col("row")[key], F.col("n_blocks"))).drop("n_blocks")
    found = found.join(durable(taken, "taken"), ["source", "block"])
    found = found.withColumn("order_key", order_key(F.col("row")[key], F.col("epoch"), mix))
    return found.filter("cut is null or order_key <= cut").drop("cut")


def mix_rows(docs: DataFrame, mix: Mix, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mixture with the columns of ``docs`` alone."""
    return mixed(docs, mix, key, source, text).select("row.*")
