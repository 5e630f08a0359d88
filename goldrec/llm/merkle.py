"""Merkle manifest of a table: one tree per group, one over the groups' roots.

The built levels are stored as rows of nodes, each linked to the row above it. A row spans
six levels: it names the node that lies six levels higher and has the siblings met on the
way, so a recursive query that ascends from every leaf takes one step for six levels. The
first step is taken where the leaves' own level is built. A step appends the siblings to
the proof and folds the hash that is to be verified through them.

Nodes are numbered along their tree by ranges of the sorted leaves, so no group meets in one
task; a page of 3^6 neighbouring nodes does. The recursive query works on the leaves' rows
and a table of 1/729 of their number, which is broadcast while it is small.

Defined results: a null field hashes as ``-`` and an empty one as ``0:``; a null group comes
before all others; null keys come first in their group and equal keys follow their leaf's
hash and their claim, so equal rows may stand in any order; other columns are not looked at; an empty table
has no leaves and no root.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from goldrec.plans.durable import durable

ARITY = 3
LEVELS = 6
PAGE = ARITY**LEVELS
#: Rows of upper nodes that are broadcast, under 1 KB each; longer tables are joined by
#: shuffling, in which Spark splits the nodes that many leaves lie below.
MOST_BROADCAST = 50_000
#: The tree over the groups' roots. Names of the other trees begin with ``=`` or are ``-``.
TOP = "^"


def field(value: Column) -> Column:
    """A value as it is hashed: its length in bytes, a colon, its text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


# ---- numbering -------------------------------------------------------------


def _numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """Add ``idx``, the place of a row in its group from 0, and ``m``, the group's size.

    ``rows`` must be stored. A running number splits ranges of rows that are alike, so
    that no range depends on a key.
    """
    rows = rows.withColumn("tie", F.monotonically_increasing_id())
    by = [group, *order, "tie"]
    at = F.monotonically_increasing_id()
    placed = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", at)
    placed = durable(placed.drop("tie"), "sorted").withColumn("part", F.shiftright("at", 33))
    runs = placed.groupBy(group, "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    along = W.partitionBy(group).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.select(
        group,
        "part",
        "first",
        F.coalesce(F.sum("n").over(along), F.lit(0)).alias("before"),
        F.sum("n").over(W.partitionBy(group)).alias("m"),
    )
    placed = placed.join(runs, [group, "part"])
    idx = F.col("before") + F.col("at") - F.col("first")
    return placed.withColumn("idx", idx).drop("at", "part", "first", "before")


# ---- building --------------------------------------------------------------


def _run_hashes(level: Column) -> Column:
    """The level above: the hash of every three neighbours."""
    starts = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / ARITY))
    run = lambda i: F.slice(level, (i * ARITY + 1).cast("int"), ARITY)
    return F.transform(starts, lambda i: F.sha2(F.array_join(run(i), "").cast("binary"), 256))


def _sides(levels: Column, depth: Column, place: Column) -> Column:
    """What stands left and right of the path that begins at ``place`` of a page."""

    def at(level: Column, k: Column) -> Column:
        own = F.floor(place / F.pow(F.lit(ARITY), k)).cast("int")
        first = own - own % ARITY
        return F.struct(
            F.array_join(F.slice(level, first + 1, own - first), "").alias("left"),
            F.array_join(F.slice(level, own + 2, first + ARITY - 1 - own), "").alias("right"),
        )

    return F.transform(F.slice(levels, 1, depth), at)


def _paged(nodes: DataFrame, *payload: str) -> DataFrame:
    """Rows of ``nodes`` (``tree, m, idx, hash``) with ``page``, ``sides`` of the next
    levels and, in a page's first row, ``top``, the node above them all."""
    page = F.floor(F.col("idx") / PAGE).alias("page")
    rows = nodes.groupBy("tree", "m", page).agg(
        F.array_sort(F.collect_list(F.struct("idx", "hash", *payload))).alias("rows")
    )
    depth = sum((F.when(F.col("m") > ARITY**k, 1).otherwise(0) for k in range(1, LEVELS)), F.when(F.col("m") > 1, 1).otherwise(0))
    rows = rows.withColumn("depth", depth)
    start = F.array(F.transform("rows", lambda x: x["hash"]))
    up = F.aggregate(
        F.array_repeat(F.lit(0), F.col("depth")),
        start,
        lambda done, _: F.concat(done, F.array(_run_hashes(F.element_at(done, -1)))),
    )
    rows = rows.withColumn("levels", up)

    def full(row: Column, place: Column) -> Column:
        top = F.when(place == 0, F.element_at(F.element_at(F.col("levels"), -1), 1))
        return F.struct(
            *(row[c].alias(c) for c in ("idx", "hash", *payload)),
            _sides(F.col("levels"), F.col("depth"), place).alias("sides"),
            top.alias("top"),
        )

    rows = rows.select("tree", "m", "page", F.explode(F.transform("rows", full)).alias("row"))
    return rows.select("tree", "m", "page", "row.*")


def _node_id(tree: Column, level: int, idx: Column) -> Column:
    return F.concat(F.lit(f"{level}/"), idx.cast("string"), tree)


def _linked(rows: DataFrame, level: int, above: Column) -> DataFrame:
    """Add ``up``, the id of the row above; ``above`` is that of a whole tree."""
    many = F.col("m") > PAGE
    return rows.withColumn("up", F.when(many, _node_id(F.col("tree"), level + 1, F.col("page"))).otherwise(above))


def _fold(sides: Column, claim: Column) -> Column:
    step = lambda f, s: F.sha2(F.concat(s["left"], f, s["right"]).cast("binary"), 256)
    return F.aggregate(sides, claim, step)


def _joined(sides: Column) -> Column:
    return F.unhex(F.array_join(F.transform(sides, lambda s: F.concat(s["left"], s["right"])), ""))


def _upper(tops: DataFrame, above: Column) -> tuple[list[DataFrame], DataFrame]:
    """All upper levels of trees whose lowest pages end in ``tops``, and the trees' roots
    as ``tree, hash``. The number of rounds grows with the logarithm of a tree's size."""
    steps, roots, level = [], [], 0
    while True:
        roots.append(tops.filter(F.col("m") <= PAGE).select("tree", F.col("top").alias("hash")))
        nodes = tops.filter(F.col("m") > PAGE).select(
            "tree", F.ceil(F.col("m") / PAGE).alias("m"), F.col("page").alias("idx"), F.col("top").alias("hash")
        )
        if nodes.isEmpty():
            break
        level += 1
        rows = durable(_linked(_paged(nodes), level, above), "nodes")
        steps.append(rows.withColumn("id", _node_id(F.col("tree"), level, F.col("idx"))))
        tops = rows.filter("top is not null").select("tree", "m", "page", "top")
    every = roots[0]
    for other in roots[1:]:
        every = every.unionByName(other)
    return steps, every


class Manifest:
    """The stored tree: ``leaves`` after their first step and ``nodes`` above them."""

    def __init__(self, leaves: DataFrame, nodes: DataFrame):
        self.leaves, self.nodes = leaves, nodes


def build(leaves: DataFrame) -> Manifest:
    """The manifest of a stored table of ``key, group, leaf, claim``: a leaf's hash and the
    hash that is to be folded in its place."""
    tree = F.coalesce(F.concat(F.lit("="), F.col("group").cast("string")), F.lit("-"))
    rows = leaves.select("key", tree.alias("tree"), F.col("leaf").alias("hash"), "claim")
    rows = _paged(_numbered(rows, "tree", "key", "hash", "claim"), "key", "claim")
    # a tree's name is the id of its root, which is a leaf of the tree above
    rows = _linked(rows, 0, F.col("tree"))
    rows = rows.select(
        "key",
        "tree",
        "m",
        "page",
        "top",
        "up",
        F.unhex("hash").alias("leaf"),
        F.unhex(_fold(F.col("sides"), F.col("claim"))).alias("folded"),
        _joined(F.col("sides")).alias("siblings"),
    )
    rows = durable(rows, "leaves")
    tops = rows.filter("top is not null").select("tree", "m", "page", "top")
    steps, roots = _upper(tops, F.col("tree"))

    # "-" stands before "=" as null does before all groups
    roots = durable(roots.withColumnRenamed("tree", "name").withColumn("tree", F.lit(TOP)), "roots")
    nothing = F.lit(None).cast("string")
    crown = durable(_linked(_paged(_numbered(roots, "tree", "name"), "name"), 0, nothing), "roots")
    steps.append(crown.withColumn("id", F.col("name")).drop("name"))
    more, _ = _upper(crown.filter("top is not null").select("tree", "m", "page", "top"), nothing)
    nodes = None
    for step in [*steps, *more]:
        step = step.select("id", "up", "tree", "hash", "sides", "m", "top")
        nodes = step if nodes is None else nodes.unionByName(step)
    return Manifest(rows.drop("m", "page", "top", "tree"), durable(nodes, "manifest"))


# ---- climbing --------------------------------------------------------------

CLIMB = """
WITH RECURSIVE climb AS (
  SELECT key, leaf, CAST(NULL AS BINARY) AS subroot, folded, siblings, up FROM {leaves}
  UNION ALL
  SELECT {hint} c.key, c.leaf,
    IF(n.id = c.up AND (n.id LIKE '=%' OR n.id = '-'), unhex(n.hash), c.subroot),
    unhex(aggregate(n.sides, lower(hex(c.folded)), (f, s) -> sha2(concat(s.left, f, s.right), 256))),
    concat(c.siblings, unhex(array_join(transform(n.sides, s -> concat(s.left, s.right)), ''))),
    n.up
  FROM climb c JOIN {nodes} n ON c.up = n.id
)
SELECT key, lower(hex(leaf)) AS leaf, lower(hex(subroot)) AS subroot,
  lower(hex(folded)) AS folded_root, siblings
FROM climb WHERE up IS NULL
"""


@contextmanager
def _any_number_of_rows(spark: SparkSession) -> Iterator[None]:
    """Recursive queries stop at a million rows by default; a manifest may have any number.
    Their number of steps stays limited by Spark's own setting."""
    name = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def climb(manifest: Manifest) -> DataFrame:
    """``key, leaf, subroot, root, siblings, folded_root`` for every leaf: ``siblings`` are
    the proof, 32 bytes a hash, level by level and left to right; ``folded_root`` is what
    its claimed hash leads to."""
    nodes = manifest.nodes
    spark = nodes.sparkSession
    hint = "/*+ BROADCAST(n) */" if nodes.count() <= MOST_BROADCAST else ""
    query = CLIMB.replace("{hint}", hint)
    with _any_number_of_rows(spark):
        found = durable(spark.sql(query, leaves=manifest.leaves, nodes=nodes), "proofs")
    top = nodes.filter((F.col("tree") == TOP) & F.col("up").isNull() & F.col("top").isNotNull())
    root = top.agg(F.max("top")).first()[0]  # one row
    return found.withColumn("root", F.lit(root).cast("string"))
