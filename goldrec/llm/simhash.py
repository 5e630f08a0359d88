"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are compared exactly, tile against tile, with exclusive-or and bit
counts. A tile holds distinct fingerprints with equal bit counts in each of their
parts; the counts of two fingerprints differ by no more than their bits do, so tile
pairs whose counts differ beyond the radius are never formed. Exact copies share a
fingerprint and meet as one class; a tile pair hands on a spanning forest of its
links, so a group of near copies costs rows in proportion to its size.

Defined results: a null or empty text has no shingles and fingerprint zero, linked
like any other; repeated rows are separate members of one component; a component of
null keys only has a null id; other columns are not read; an empty table gives an
empty table. Texts are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldrec.llm.batches import slices
from goldrec.llm.components import components
from goldrec.llm.names import fresh
from goldrec.llm.suffixes import sums_by
from goldrec.plans.durable import durable

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Fingerprints in one tile.
TILE = 16_384
#: Distinct fingerprints from which four bit counts a fingerprint pay; two before that.
MANY = 1 << 20
#: Hashes whose bits are counted at once.
CHUNK = 1 << 18

_LOWER = bytes(x + 32 if 0x41 <= x <= 0x5A else x for x in range(256))


# ---- fingerprints ---------------------------------------------------------


def shingle_hashes(text: str | None, size: int = SHINGLE) -> list[int]:
    """XXH64 of every run of ``size`` words, or of all words if there are fewer."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[s:e], SEED) for s, e in zip(starts, ends[size - 1 :].tolist(), strict=False)]


def _majority(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per slice the number whose bits are set in over half of its hashes."""
    n = np.diff(offsets)
    set_bits = np.zeros((len(n), 64), np.int64)
    for first in range(0, len(hashes), CHUNK):
        part = hashes[first : first + CHUNK]
        inside = np.clip(offsets, first, first + len(part)) - first
        bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        busy = np.flatnonzero(np.diff(inside))
        if len(busy):
            set_bits[busy] += np.add.reduceat(bits, inside[busy], axis=0, dtype=np.int32)
    over = 2 * set_bits > n[:, None]
    return np.packbits(over, axis=1).view(">u8").ravel().astype(np.uint64)


def _fingerprints(texts: list[str | None], size: int) -> np.ndarray:
    hashes: list[np.ndarray] = []
    offsets = [0]
    for text in texts:
        found = np.array(shingle_hashes(text, size), np.uint64)
        hashes.append(found)
        offsets.append(offsets[-1] + len(found))
    if not texts:
        return np.empty(0, np.uint64)
    return _majority(np.concatenate(hashes), np.array(offsets))


def fingerprints(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE
) -> DataFrame:
    """``key`` and ``fp`` (the 64 bits as a long) of every row."""
    rows = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text"))
    kind = rows.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                fp = _fingerprints(part.column(1).to_pylist(), shingle).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp)], ["key", "fp"])

    return rows.mapInArrow(run, f"key {kind}, fp long")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# ---- tiles ----------------------------------------------------------------


def _cell(parts: int) -> Column:
    """The bit counts of the parts of ``fp`` as one number, six bits each."""
    width = 64 // parts
    mask = F.lit((1 << width) - 1)
    counts = (
        F.bit_count(F.shiftrightunsigned("fp", width * i).bitwiseAND(mask)).cast("long") for i in range(parts)
    )
    out = F.lit(0).cast("long")
    for i, n in enumerate(counts):
        out = out + F.shiftleft(n, 6 * i)
    return out


def _steps(parts: int, radius: int) -> list[list[int]]:
    """All changes of the bit counts that sum up to at most ``radius``."""
    out: list[list[int]] = [[]]
    for _ in range(parts):
        out = [
            [*x, d] for x in out for d in range(-radius, radius + 1) if sum(map(abs, x)) + abs(d) <= radius
        ]
    return out


def links(classes: DataFrame, radius: int = RADIUS, parts: int | None = None, tile: int = TILE) -> DataFrame:
    """``u, v``: a spanning forest, tile pair by tile pair, of all pairs in ``classes.fp``
    (distinct) that differ in at most ``radius`` bits."""
    if parts is None:
        parts = 4 if classes.count() >= MANY else 2
    limit = 64 // parts
    rows = classes.select("fp", _cell(parts).alias("cell"))
    # at most 33^2 or 17^4 rows
    cells = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(tile)).alias("n_tiles"))
    tiles = (
        rows.join(F.broadcast(cells), "cell")
        .groupBy("cell", F.pmod(F.xxhash64("fp"), "n_tiles").alias("tile"))
        .agg(F.collect_list("fp").alias("fps"))  # about ``tile`` of them
    )
    tiles = durable(tiles, "tiles")
    low = [F.shiftright("cell", 6 * i).bitwiseAND(F.lit(63)) for i in range(parts)]
    # each unordered pair of cells once, and each cell with itself
    changes = [s for s in _steps(parts, radius) if next((d for d in reversed(s) if d), 0) >= 0]
    near = F.array(
        *(
            F.when(
                _all((n + d >= 0) & (n + d <= limit) for n, d in zip(low, s, strict=True)),
                F.col("cell") + sum(d << 6 * i for i, d in enumerate(s)),
            )
            for s in changes
        )
    )
    left = tiles.select(
        F.col("cell").alias("own"),
        F.col("tile").alias("own_tile"),
        F.col("fps").alias("left"),
        F.explode(F.array_compact(near)).alias("cell"),
    )
    pairs = left.join(tiles.hint("shuffle_merge"), "cell").filter("own <> cell or own_tile <= tile")
    same = (F.col("own") == F.col("cell")) & (F.col("own_tile") == F.col("tile"))
    pairs = pairs.select("left", F.when(~same, F.col("fps")).alias("right"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = (batch.column(c)[i].values for c in (0, 1))
                u, v = _forest(a.to_numpy(), None if b is None else b.to_numpy(), radius)
                if len(u):
                    yield pa.RecordBatch.from_pydict({"u": pa.array(u), "v": pa.array(v)})

    return pairs.mapInArrow(run, "u long, v long")


def _all(conditions: Iterator[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def _forest(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two tiles, or within one."""
    both = left if right is None else np.concatenate([left, right])
    bits = both.view(np.uint64)
    n, shift = len(left), 0 if right is None else len(left)
    others = bits[shift:]
    root = np.arange(len(both))
    out: list[tuple[int, int]] = []
    step = max(1, (1 << 20) // max(len(others), 1))
    for first in range(0, n, step):
        apart = np.bitwise_count(bits[first : min(first + step, n), None] ^ others[None, :])
        i, j = np.nonzero(apart <= radius)
        a, b = root[i + first], root[j + shift]
        new = a != b
        if not new.any():
            continue
        for x, y in np.unique(np.stack([a[new], b[new]], axis=1), axis=0).tolist():
            x, y = _top(root, x), _top(root, y)
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((x, y))
        while (root[root] != root).any():
            root = root[root]
    edges = np.array(out, np.int64).reshape(-1, 2)
    return both[edges[:, 0]], both[edges[:, 1]]


def _top(root: np.ndarray, x: int) -> int:
    while root[x] != x:
        x = int(root[x])
    return x


# ---- groups ---------------------------------------------------------------


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    radius: int = RADIUS,
    parts: int | None = None,
    tile: int = TILE,
) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``fp``, ``component_id`` (the smallest key of
    the component) and ``root``, which tells components apart where keys are null."""
    rows = durable(fingerprints(docs, key, text, shingle), "fingerprints")
    classes = durable(rows.groupBy("fp").agg(F.min("key").alias("first")), "classes")
    stars = components(links(classes, radius, parts, tile))
    labelled = classes.join(stars.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left")
    labelled = durable(labelled.select("fp", "first", F.coalesce("root", "fp").alias("root")), "labelled")
    smallest = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    # classes without links answer for themselves
    by_class = labelled.join(smallest, "root").select("fp", "root", "component_id")
    return rows.join(by_class, "fp").select("key", "fp", "component_id", "root")


def keep_one_of_each(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS
) -> DataFrame:
    """The rows of ``docs`` less near copies: of each component one row with the smallest
    key stays, all its columns unchanged."""
    name = F.concat_ws(
        "-", F.coalesce(F.col(key).cast("string"), F.lit("null")), F.xxhash64(F.col(text).cast("string"))
    )
    own = fresh(docs, "_row")
    named = docs.select("*", name.alias(own))
    row = F.struct(F.col(key).isNull().alias("no_key"), F.col(key).alias("k"), name.alias("r"))
    pairs = docs.select(row.alias("row"), F.col(text).alias("text"))
    found = near_duplicates(pairs, "row", "text", shingle, radius)
    # the smallest (no_key, key, name) of a component is one with the smallest key
    stay = found.filter("key.r = component_id.r").select(F.col("key.r").alias(own)).distinct()
    return named.join(stay, own, "left_semi").dropDuplicates([own]).drop(own)
