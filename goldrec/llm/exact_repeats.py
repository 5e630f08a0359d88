"""Suffix-array dedup: remove later copies of any 50 bytes, keep the first.

A byte goes if it lies in a 50-byte string that also starts in a text with a smaller
key. The work is done in four steps:

1. Texts are packed into compressed packs, a table in the shared folder.
2. Every 50-byte window belongs to the smallest hash among its 16-byte strings; a run
   of windows with one such hash is a *piece*. Equal windows have equal hashes, so
   pieces meet in buckets by that hash. A piece met whole in a smaller key goes. Where
   pieces differ, the first holder of each form is asked for its bytes.
3. The bytes asked for meet in the same buckets. Pieces of which no window's hash is met in
   another owner stay as they are. The suffix array of the others, with previous and
   next smaller owners in suffix order, gives the longest previous factors: windows
   whose factor reaches 50 bytes go. A hash of which very many forms are asked for (the
   edge of a passage that stands in very many texts) is left out of this: its windows
   meet by a hash of their own, the smallest owner of each stays.
4. The spans go back to the packs, which are cut.

Only 13 bytes and a position travel for a piece, about every eighteenth byte. Copies
within a pack are settled there, so a frequent piece sends one row a pack at most.

Defined results: a null text is empty; texts of equal key never remove each other, so
repeated rows are cut alike; rows with a null key neither lose nor remove anything;
other columns are not read. Cut texts are bytes: a cut may split a character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldrec.llm.suffixes import (
    covered,
    longest_previous_factor,
    neighbour_lcp,
    runs_of,
    suffix_order,
    sums_by,
)
from goldrec.plans.durable import durable

LEAST = 50
GRAM = 16
#: Window starts that are hashed at once.
CHUNK = 1 << 19
PACK_BYTES = 2 << 20
#: Pieces in one bucket, about.
BUCKET_PIECES = 1 << 18
#: Rows that are handed on at once.
ROWS = 1 << 10
#: Pieces of one hash whose bytes may meet in one bucket.
HOT_PIECES = 1 << 15
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP = _powers(_BASE, CHUNK + 2 * LEAST)
_DOWN = _powers(pow(_BASE, -1, 1 << 64), CHUNK + 2 * LEAST)


def _words_at(x: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on, as one number."""
    out = np.empty(len(x) - 7, np.uint64)
    for r in range(min(8, len(out))):
        n = (len(x) - r) // 8
        out[r::8] = x[r : r + 8 * n].view("<u8")
    return out


def _window_least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    reach = 1
    while 2 * reach <= width:
        x, reach = np.minimum(x[:-reach], x[reach:]), 2 * reach
    rest = width - reach
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def pieces(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, content hash, first window and number of windows of every piece.

    ``data``: texts end to end, as bytes; ``ends``: where each ends.
    """
    found = []
    for first in range(0, len(data) - LEAST + 1, CHUNK):
        x = np.ascontiguousarray(data[first : first + CHUNK + LEAST - 1])
        word = _words_at(x)
        gram = _mixed(word[: len(x) - GRAM + 1] + _mixed(word[8:]))
        least = _window_least(gram, LEAST - GRAM + 1)
        start = np.arange(len(least))
        text = np.searchsorted(ends, first + start, "right")
        inside = first + start + LEAST <= ends[text]
        new = np.r_[True, (least[1:] != least[:-1]) | (text[1:] != text[:-1]) | ~inside[:-1]] & inside
        run = np.maximum.accumulate(np.where(new, start, 0))
        new |= inside & ((start - run) % (LEAST - GRAM + 1) == 0)
        begin = start[new]
        upto = np.r_[begin[1:], len(least)]
        number = sums_by(np.r_[begin, len(least)], inside.astype(np.int64))
        assert (number <= upto - begin).all()
        # the content: words at begin .. begin + number + LEAST - 9
        total = np.r_[np.uint64(0), np.cumsum(_mixed(word) * _UP[: len(word)], dtype=np.uint64)]
        content = (total[begin + number + LEAST - 8] - total[begin]) * _DOWN[begin] + number.astype(np.uint64)
        found.append((least[begin], content, first + begin, number))
    if not found:
        return tuple(np.empty(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


# ---- packs ----------------------------------------------------------------


def _pack(docs: DataFrame, key: str, text: str) -> DataFrame:
    rows = docs.select(docs[key].cast("long").alias("key"), docs[text].cast("string").alias("text"))

    def packed(number: int, keys: pa.Array, texts: list[bytes]) -> pa.RecordBatch:
        data = b"".join(texts)
        row = {
            "pack": pa.array([number], pa.int64()),
            "keys": pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys),
            "sizes": pa.array([[len(t) for t in texts]], pa.list_(pa.int64())),
            "data": pa.array([pa.compress(data, "zstd", asbytes=True)], pa.binary()),
        }
        return pa.RecordBatch.from_pydict(row)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts, size, first = [], 0, 0
            for i, text in enumerate(batch.column(1)):
                raw = (text.as_py() or "").encode()
                if texts and size + len(raw) > PACK_BYTES:
                    yield packed(number, batch.column(0).slice(first, i - first), texts)
                    number, texts, size, first = number + 1, [], 0, i
                texts.append(raw)
                size += len(raw)
            if texts:
                yield packed(number, batch.column(0).slice(first), texts)
                number += 1

    schema = "pack long, keys array<long>, sizes array<long>, data binary"
    return durable(rows.mapInArrow(run, schema), "packs")


class _Texts:
    """The texts of one pack, end to end."""

    def __init__(self, row: dict):
        self.sizes = np.array(row["sizes"], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.known = np.array([k is not None for k in row["keys"]], bool)
        self.keys = np.array([k or 0 for k in row["keys"]], np.int64)
        size = int(self.sizes.sum())
        self.data = np.frombuffer(pa.decompress(row["data"], size, "zstd", asbytes=True), np.uint8)

    def owner(self, at: np.ndarray) -> np.ndarray:
        """Which text holds each position."""
        return np.searchsorted(self.ends, at, "right")


# ---- whole pieces ---------------------------------------------------------

_TYPES = {"h": "<u4", "content": "<u8", "owner": "<i8", "start": "<i4", "number": "<u1"}
_PIECE_BLOBS = ", ".join(f"{c} binary" for c in _TYPES)
_TYPES |= {"w1": "<u8", "w2": "<u8"}
_PIECE = ("h", "content", "owner", "start", "number")


def _offsets(ordered: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin, and the end."""
    n = len(ordered)
    return np.r_[0, np.flatnonzero(ordered[1:] != ordered[:-1]) + 1, n] if n else np.zeros(1, np.int64)


def _blob(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A cell of bytes for the values between neighbouring offsets."""
    values = np.ascontiguousarray(values)
    at = (offsets * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(values)])


def _blobs(columns: dict[str, np.ndarray], order: np.ndarray, offsets: np.ndarray, names: tuple[str, ...]) -> dict:
    return {c: _blob(columns[c][order].astype(_TYPES[c]), offsets) for c in names}


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions of all runs of ``size`` from ``begin`` on, end to end."""
    return np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)


def _pieces_of_packs(packs: DataFrame, buckets: int) -> DataFrame:
    """Pieces by ``bucket``; from ``buckets`` on stand those already met in their pack."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                texts = _Texts(row)
                h, content, start, number = pieces(texts.data, texts.ends)
                text = texts.owner(start)
                use = texts.known[text]
                h, content, start, number = (x[use] for x in (h, content, start, number))
                columns = {
                    "h": h >> np.uint64(32),
                    "content": content,
                    "owner": texts.keys[text[use]],
                    "start": start,
                    "number": number,
                }
                bucket = ((h & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.int64)
                later = _later(bucket, columns)
                bucket[later] = buckets + row["pack"] % buckets
                order = np.argsort(bucket, kind="stable")
                offsets = _offsets(bucket[order])
                first = bucket[order[offsets[:-1]]]
                out = {"bucket": pa.array(first), "pack": pa.array(np.full(len(first), row["pack"], np.int64))}
                found = pa.RecordBatch.from_pydict(out | _blobs(columns, order, offsets, _PIECE))
                for at in range(0, len(first), ROWS):
                    yield found.slice(at, ROWS)

    return packs.mapInArrow(run, f"bucket long, pack long, {_PIECE_BLOBS}")


def _later(bucket: np.ndarray, columns: dict[str, np.ndarray]) -> np.ndarray:
    """Pieces of which the same pack holds a copy with a smaller owner."""
    order = np.lexsort((columns["owner"], columns["content"], columns["h"], bucket))
    form = _starts(bucket[order], columns["h"][order], columns["content"][order])
    owner = columns["owner"][order]
    out = np.zeros(len(order), bool)
    out[order] = owner > owner[form]
    return out


def _starts(*ordered: np.ndarray) -> np.ndarray:
    """For rows in order: where the run of equal rows begins that each is in."""
    n = len(ordered[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for x in ordered:
        new[1:] |= x[1:] != x[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(n), 0)) if n else np.arange(0)


def _settle(buckets: int, most: int):
    """Per bucket: pieces that go (``ask`` false), and those whose bytes are needed; ``hot``
    if more than ``most`` of their hash are."""

    def run(table: pa.Table) -> pa.Table:
        out = []

        def give(ask: bool, hot: bool, pack: np.ndarray, columns: dict[str, np.ndarray]) -> None:
            order = np.argsort(pack, kind="stable")
            offsets = _offsets(pack[order])
            n = len(offsets) - 1
            head = {
                "bucket": pa.array(np.full(n, number_of_bucket, np.int64)),
                "pack": pa.array(pack[order[offsets[:-1]]].astype(np.int64)),
                "ask": pa.array(np.full(n, ask)),
                "hot": pa.array(np.full(n, hot)),
            }
            out.append(pa.table(head | _blobs(columns, order, offsets, ("h", "start", "number"))))

        number_of_bucket = table.column("bucket")[0].as_py()
        columns = _blobs_by(table, *_PIECE)
        pack = np.repeat(table.column("pack").to_numpy(), _sizes(table))
        if number_of_bucket >= buckets:
            give(False, False, pack, columns)
        else:
            order = np.lexsort((columns["owner"], columns["content"], columns["h"]))
            columns, pack = {c: v[order] for c, v in columns.items()}, pack[order]
            h, owner = columns["h"], columns["owner"]
            same_h = _starts(h)
            form = _starts(h, columns["content"])
            later = owner > owner[form]
            give(False, False, pack[later], {c: columns[c][later] for c in ("h", "start", "number")})
            ask = np.flatnonzero(~later & _undecided(same_h, owner, form))
            of = _starts(same_h[ask])
            hot = np.bincount(of, minlength=len(of))[of] > most
            for some in (False, True):
                mine = ask[hot == some]
                give(True, some, pack[mine], {c: columns[c][mine] for c in ("h", "start", "number")})
        return pa.concat_tables(out)

    return run


def _undecided(same_h: np.ndarray, owner: np.ndarray, form: np.ndarray) -> np.ndarray:
    """Rows whose hash has two forms and two owners."""
    n = len(same_h)
    forms = np.zeros(n, bool)
    np.logical_or.at(forms, same_h, form != same_h)
    owners = np.zeros(n, bool)
    np.logical_or.at(owners, same_h, owner != owner[same_h])
    return forms[same_h] & owners[same_h]


# ---- bytes asked for ------------------------------------------------------


def _blobs_by(rows: pa.Table, *names: str) -> dict[str, np.ndarray]:
    return {c: np.frombuffer(b"".join(rows.column(c).to_pylist()), _TYPES[c]) for c in names}


def _sizes(rows: pa.Table) -> np.ndarray:
    """How many pieces each row has."""
    return pc.binary_length(rows.column("number")).to_numpy()


_FETCHED = "bucket long, pack long, data binary, owner binary, start binary, number binary, w1 binary, w2 binary"


def _fetch(buckets: int, spread: int):
    """The bytes of the pieces asked for, by bucket; of hot ones the windows, in the next
    ``spread`` buckets by their hash. From ``buckets + spread`` on stand windows of which
    the pack holds a copy with a smaller owner."""

    names = ("data", "owner", "start", "number", "w1", "w2")
    schema = pa.schema([("bucket", pa.int64()), ("pack", pa.int64()), *((c, pa.binary()) for c in names)])

    def rows(bucket: np.ndarray, pack: int, blobs: dict) -> pa.Table:
        n = len(bucket)
        head = {"bucket": pa.array(bucket, pa.int64()), "pack": pa.array(np.full(n, pack, np.int64))}
        return pa.table(head | {c: blobs[c] if c in blobs else pa.nulls(n, pa.binary()) for c in names}, schema)

    def run(packs: pa.Table, asked: pa.Table) -> pa.Table:
        if not packs.num_rows or not asked.num_rows:
            return schema.empty_table()
        pack = packs.to_pylist()[0]
        texts = _Texts(pack)
        some = asked.filter(pc.invert(asked.column("hot")))
        piece = _blobs_by(some, "start", "number")
        start, size = piece["start"].astype(np.int64), piece["number"].astype(np.int64) + LEAST - 1
        cuts = np.r_[0, np.cumsum(_sizes(some))]
        blobs = {
            "data": _blob(texts.data[_ranges(start, size)], np.r_[0, np.cumsum(size)][cuts]),
            "owner": _blob(texts.keys[texts.owner(start)].astype(_TYPES["owner"]), cuts),
            "start": _blob(piece["start"], cuts),
            "number": _blob(piece["number"], cuts),
        }
        out = [rows(some.column("bucket").to_numpy(), pack["pack"], blobs)]
        hot = asked.filter(asked.column("hot"))
        columns, later = _windows(texts, _blobs_by(hot, "start", "number"))
        columns["number"] = np.ones(len(later), np.int64)
        bucket = buckets + (columns["w1"] % np.uint64(spread)).astype(np.int64)
        bucket[later] = buckets + spread + pack["pack"] % buckets
        for mine, kept in ((~later, ("start", "number", "owner", "w1", "w2")), (later, ("start", "number"))):
            order = np.flatnonzero(mine)
            order = order[np.argsort(bucket[order], kind="stable")]
            offsets = _offsets(bucket[order])
            out.append(rows(bucket[order[offsets[:-1]]], pack["pack"], _blobs(columns, order, offsets, kept)))
        return pa.concat_tables(out)

    return run


def window_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of the ``LEAST`` bytes from every ``at`` on."""
    one, two = np.zeros(len(at), np.uint64), np.full(len(at), _ODD)
    if len(at):
        word = _words_at(data)
        for step in (*range(0, LEAST - 8, 8), LEAST - 8):
            w = word[at + step]
            one, two = _mixed(one + w), _mixed((two ^ w) * np.uint64(_BASE) + _ODD)
    return one, two


def _windows(texts: _Texts, piece: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The windows of pieces, and of which the pack holds a copy with a smaller owner."""
    at = _ranges(piece["start"].astype(np.int64), piece["number"].astype(np.int64))
    w1, w2 = window_hashes(texts.data, at)
    owner = texts.keys[texts.owner(at)]
    order = np.lexsort((owner, w2, w1))
    columns = {"w1": w1[order], "w2": w2[order], "owner": owner[order], "start": at[order]}
    return columns, columns["owner"] > columns["owner"][_starts(columns["w1"], columns["w2"])]


def _eight(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as a number in text order, zero past the end."""
    word = _words_at(np.r_[data, np.zeros(8, np.uint8)])[: len(data)].byteswap()
    missing = np.clip(8 - (ends - np.arange(len(data))), 0, 8).astype(np.uint64) * np.uint64(8)
    return np.where(missing > 56, word & ~np.uint64(0) << np.uint64(56), word >> missing << missing)


def previous_factors(data: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Positions whose longest previous factor (what also starts in a smaller owner's
    sequence) has at least ``LEAST`` bytes."""
    word = _eight(data, ends)
    order, levels = suffix_order(word, ends, 8, LEAST)
    order = order[(ends - np.arange(len(data)))[order] >= LEAST]
    lcp = neighbour_lcp(order, levels, ends, 8)
    # the shared part of the first word that differs
    a, b = (np.minimum(x + lcp[1:], len(data) - 1) for x in (order[:-1], order[1:]))
    apart = word[a] ^ word[b]
    for k in range(1, 8):
        lcp[1:] += apart < np.uint64(1 << 8 * k)
    room = (ends - np.arange(len(data)))[order]
    lcp[1:] = np.minimum(lcp[1:], np.minimum(room[:-1], room[1:]))
    return np.flatnonzero(longest_previous_factor(order, lcp, owner, LEAST))


def _by_pack(pack: np.ndarray, start: np.ndarray) -> pa.Table:
    """Single windows as spans, a row for each pack."""
    order = np.argsort(pack, kind="stable")
    offsets = _offsets(pack[order])
    out = {"pack": pa.array(pack[order[offsets[:-1]]].astype(np.int64))}
    columns = {"start": start, "number": np.ones(len(start), np.int64)}
    return pa.table(out | _blobs(columns, order, offsets, ("start", "number")))


def _meeting(data: np.ndarray, begin: np.ndarray, number: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Pieces with a window of which another owner has one of equal hash. No other piece
    can lose bytes or make others lose them, so no other one needs a place in suffix order."""
    which = np.repeat(np.arange(len(number)), number)
    w = window_hashes(data, _ranges(begin, number))[0]
    order = np.argsort(w)
    run = _starts(w[order])
    mine = owner[which[order]]
    apart = np.zeros(len(run), bool)
    np.logical_or.at(apart, run, mine != mine[run])
    return np.unique(which[order[apart[run]]])


def _previous_factors(table: pa.Table) -> pa.Table:
    """Windows of the fetched pieces that also start in a smaller owner, by pack."""
    piece = _blobs_by(table, "owner", "start", "number")
    data = np.frombuffer(b"".join(table.column("data").to_pylist()), np.uint8)
    pack = np.repeat(table.column("pack").to_numpy(), _sizes(table))
    number = piece["number"].astype(np.int64)
    size = number + LEAST - 1
    begin = np.cumsum(size) - size
    some = _meeting(data, begin, number, piece["owner"])
    data, size = data[_ranges(begin[some], size[some])], size[some]
    hit = previous_factors(data, np.repeat(np.cumsum(size), size), np.repeat(piece["owner"][some], size))
    begin = np.cumsum(size) - size
    which = np.repeat(np.arange(len(size)), size)[hit]
    return _by_pack(pack[some][which], piece["start"][some][which] + hit - begin[which])


def _later_windows(table: pa.Table) -> pa.Table:
    """Windows that also start in a smaller owner, by pack."""
    window = _blobs_by(table, "w1", "w2", "owner", "start")
    pack = np.repeat(table.column("pack").to_numpy(), _sizes(table))
    order = np.lexsort((window["owner"], window["w2"], window["w1"]))
    owner = window["owner"][order]
    later = order[owner > owner[_starts(window["w1"][order], window["w2"][order])]]
    return _by_pack(pack[later], window["start"][later])


def _meet(buckets: int, spread: int, factors):
    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        if bucket < buckets:
            return factors(table)
        return _later_windows(table) if bucket < buckets + spread else table.select(["pack", "start", "number"])

    return run


# ---- cutting --------------------------------------------------------------


def _cut(packs: pa.Table, spans: pa.Table) -> pa.Table:
    out = {c: [] for c in ("key", "n_bytes", "spans", "kept")}
    for row in packs.to_pylist():
        texts = _Texts(row)
        gone = np.zeros(len(texts.data), bool)
        if spans.num_rows:
            piece = _blobs_by(spans, "start", "number")
            reach = piece["number"].astype(np.int64) + LEAST - 1
            gone = covered(piece["start"].astype(np.int64), reach, len(gone))
        first = texts.ends - texts.sizes
        for key, a, e in zip(row["keys"], first.tolist(), texts.ends.tolist(), strict=True):
            own = gone[a:e]
            starts, ends = runs_of(own)
            out["key"].append(key)
            out["n_bytes"].append(e - a)
            out["spans"].append([{"s": s, "e": f} for s, f in zip(starts.tolist(), ends.tolist(), strict=True)])
            out["kept"].append(texts.data[a:e][~own].tobytes())
    spans_type = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
    kinds = (pa.int64(), pa.int64(), spans_type, pa.binary())
    return pa.table({c: pa.array(v, t) for (c, v), t in zip(out.items(), kinds, strict=True)})


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: ``key``, ``n_bytes``, the removed ``spans`` (bytes ``[s, e)``)
    and the ``kept`` bytes."""
    packs = _pack(docs, key, text)
    size = packs.select(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0]
    spread = (LEAST - GRAM + 2) // 2
    buckets = max(1, -(-(size or 0) // (spread * BUCKET_PIECES)))
    settled = durable(
        _pieces_of_packs(packs, buckets)
        .groupBy("bucket")
        .applyInArrow(
            _settle(buckets, HOT_PIECES),
            "bucket long, pack long, ask boolean, hot boolean, h binary, start binary, number binary",
        ),
        "settled",
    )
    hot = settled.filter("hot").select(F.sum(F.length("number"))).first()[0] or 0
    windows = max(1, -(-hot * spread // BUCKET_PIECES))
    asked = settled.filter("ask").select("bucket", "pack", "hot", "start", "number")
    fetched = (
        packs.groupBy("pack").cogroup(asked.groupBy("pack")).applyInArrow(_fetch(buckets, windows), _FETCHED)
    )
    factors = fetched.groupBy("bucket").applyInArrow(
        _meet(buckets, windows, _previous_factors), "pack long, start binary, number binary"
    )
    spans = settled.filter("not ask").select("pack", "start", "number").unionByName(factors)
    return (
        packs.groupBy("pack")
        .cogroup(spans.groupBy("pack"))
        .applyInArrow(_cut, "key long, n_bytes long, spans array<struct<s: long, e: long>>, kept binary")
    )
