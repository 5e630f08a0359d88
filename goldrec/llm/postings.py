"""Benchmark decontamination with a positional inverted index.

``build_index`` stores the postings of every word of every document, one row per
segment of about ``SEGMENT_WORDS`` words, as a table in the shared folder. Searches
read the segments where they lie: no document is shuffled, and a frequent word or a
frequent passage is spread over all segments that hold it.

A phrase is looked up by its rarest word (counts over the whole index); the list of
start positions is then intersected with the offset-adjusted list of the next rarest
word, and so on. Proximity search starts from the rarest word as well: of every other
word only the nearest places on both sides of it decide which windows are left.

Defined results: a null text has no words; rows are judged one by one, equal rows
alike; items without words match nothing; a null item id marks hits but is not
listed; items of one id or one text are all listed; empty tables give no hits; columns
other than key and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldrec.llm.suffixes import covered, runs_of
from goldrec.plans.durable import durable

WINDOW = 13
SEGMENT_WORDS = 1 << 19
#: Start positions that one step of an intersection holds at once.
STARTS = 1 << 19
#: The widest proximity: where a window may begin is a set of bits in one long.
MOST_NEAR = 62
#: Bytes of benchmark text in one broadcast; a larger benchmark is searched in slices.
SLICE_BYTES = 4 << 20

_LOWER = bytes(
    x + 32 if 0x41 <= x <= 0x5A else x if 0x30 <= x <= 0x39 or 0x61 <= x <= 0x7A or x > 0x7F else 0x20
    for x in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words: runs of ASCII letters and digits and non-ASCII characters."""
    return (text or "").encode().translate(_LOWER).split()


# ---- the index ------------------------------------------------------------


def _segment(number: int, keys: pa.Array, words: list[bytes], sizes: list[int]) -> pa.RecordBatch:
    at = np.arange(len(words)) + np.repeat(np.arange(len(sizes)), sizes)
    coded = pa.array(words, pa.binary()).dictionary_encode()
    terms = coded.dictionary
    by_term = pc.array_sort_indices(terms).to_numpy()
    place = np.empty(len(by_term), np.int32)
    place[by_term] = np.arange(len(by_term))
    numbers = place[coded.indices.to_numpy(zero_copy_only=False)] if words else np.empty(0, np.int32)
    order = np.argsort(numbers, kind="stable")
    row = {
        "segment": pa.array([number], pa.int64()),
        "keys": pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys),
        "sizes": pa.array([sizes], pa.list_(pa.int64())),
        "terms": pa.array([b" ".join(terms.take(pa.array(by_term)).to_pylist())]),
        "counts": pa.array([np.bincount(numbers, minlength=len(terms)).astype("<i4").tobytes()]),
        "positions": pa.array([at[order].astype("<i4").tobytes()]),
    }
    return pa.RecordBatch.from_pydict(row)


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The stored index: ``segment``, ``keys`` and ``sizes`` (words) of its rows, sorted
    ``terms``, their ``counts`` and ``positions``. Rows lie end to end, one place apart."""
    rows = docs.select(docs[key].alias("_key"), docs[text].cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            words, sizes, first = [], [], 0
            for i, text in enumerate(batch.column(1)):
                found = words_of(text.as_py())
                if words and len(words) + len(found) > SEGMENT_WORDS:
                    yield _segment(number, batch.column(0).slice(first, i - first), words, sizes)
                    number, words, sizes, first = number + 1, [], [], i
                words += found
                sizes.append(len(found))
            if sizes:
                yield _segment(number, batch.column(0).slice(first), words, sizes)
                number += 1

    kind = rows.schema[0].dataType.simpleString()
    schema = (
        f"segment long, keys array<{kind}>, sizes array<long>, "
        "terms binary, counts binary, positions binary"
    )
    return durable(rows.mapInArrow(run, schema), "postings")


def indexed_rows(index: DataFrame) -> DataFrame:
    """``segment, ordinal, key, n_words`` of every indexed row; reads no postings."""
    rows = index.select("segment", F.posexplode(F.arrays_zip("keys", "sizes")))
    return rows.select(
        "segment",
        F.col("pos").alias("ordinal"),
        F.col("col.keys").alias("key"),
        F.col("col.sizes").alias("n_words"),
    )


def _starts(sizes: list[int]) -> np.ndarray:
    """Where each row starts; the last one is the end."""
    return np.r_[0, np.cumsum(np.array(sizes, np.int64) + 1)]


def term_counts(index: DataFrame, terms: list[bytes]) -> np.ndarray:
    """How often each of ``terms`` stands in the whole index."""
    wanted = index.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted.value), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                at = _places(wanted.value, row["terms"])
                here = np.flatnonzero(at >= 0)
                total[here] += np.frombuffer(row["counts"], "<i4")[at[here]]
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": pa.array(seen), "n": pa.array(total[seen])})

    parts = index.select("terms", "counts").mapInArrow(run, "term long, n long")
    out = np.zeros(len(terms), np.int64)
    for term, n in parts.groupBy("term").agg(F.sum("n")).collect():  # at most one row per wanted term
        out[term] = n
    return out


def _places(wanted: list[bytes], terms: bytes) -> np.ndarray:
    """The place of each wanted term among a segment's terms, else -1."""
    there = pa.array(terms.split(b" "), pa.binary())
    found = pc.index_in(pa.array(wanted, pa.binary()), value_set=there)
    return found.fill_null(-1).to_numpy(zero_copy_only=False)


# ---- phrases --------------------------------------------------------------


@dataclass(frozen=True)
class Phrases:
    """Distinct phrases over a list of terms, and the items that hold each.

    Row ``i`` of ``terms_of`` holds the phrase's term numbers, rarest first, and the
    same row of ``offset_of`` where in the phrase they stand (-1: no more).
    """

    terms: list[bytes]
    terms_of: np.ndarray
    offset_of: np.ndarray
    length: np.ndarray
    items: list[list[str]]


def phrases(index: DataFrame, texts: list[tuple[object, str | None]], window: int = WINDOW) -> Phrases:
    """The windows of ``window`` words of each text; a shorter text is one window."""
    found: dict[tuple[bytes, ...], set[str]] = {}
    for item, text in texts:
        words = words_of(text)
        for i in range(max(len(words) - window, 0) + 1 if words else 0):
            holders = found.setdefault(tuple(words[i : i + window]), set())
            if item is not None:
                holders.add(str(item))
    terms = sorted({w for phrase in found for w in phrase})
    place = {w: i for i, w in enumerate(terms)}
    counts = term_counts(index, terms)
    terms_of = np.full((len(found), window), -1, np.int64)
    offset_of = np.zeros((len(found), window), np.int64)
    for row, phrase in enumerate(found):
        numbers = np.array([place[w] for w in phrase])
        order = np.argsort(counts[numbers], kind="stable")
        terms_of[row, : len(order)], offset_of[row, : len(order)] = numbers[order], order
    length = np.array([len(p) for p in found], np.int64)
    return Phrases(terms, terms_of, offset_of, length, [sorted(x) for x in found.values()])


class _Lists:
    """The posting lists of wanted terms in one segment, as one sorted array."""

    def __init__(self, terms: list[bytes], row: dict):
        at = _places(terms, row["terms"])
        counts = np.frombuffer(row["counts"], "<i4").astype(np.int64)
        positions = np.frombuffer(row["positions"], "<i4")
        first = np.r_[0, np.cumsum(counts)]
        here = np.flatnonzero(at >= 0)
        size = np.zeros(len(terms), np.int64)
        size[here] = counts[at[here]]
        self.size = size
        self.first = np.r_[0, np.cumsum(size)]
        places = _spread(first[at[here]], size[here])
        self.entries = (np.repeat(here, size[here]) << 32) | positions[places]

    def has(self, terms: np.ndarray, positions: np.ndarray) -> np.ndarray:
        wanted = (terms << 32) | positions
        at = np.searchsorted(self.entries, wanted)
        return self.entries[np.minimum(at, len(self.entries) - 1)] == wanted

    def of(self, term: int) -> np.ndarray:
        return self.entries[self.first[term] : self.first[term + 1]] & 0xFFFFFFFF


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``first[i] .. first[i] + size[i] - 1`` for all i, end to end."""
    before = np.cumsum(size) - size
    return np.arange(int(size.sum())) + np.repeat(first - before, size)


def _candidates(lists: _Lists, wanted: Phrases) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of phrases all whose words are there and the places of their rarest word,
    some phrases at a time."""
    there = (wanted.terms_of < 0) | (lists.size[wanted.terms_of] > 0)
    rows = np.flatnonzero(there.all(axis=1))
    sizes = lists.size[wanted.terms_of[rows, 0]]
    part = (np.cumsum(sizes) - 1) // STARTS
    for p in np.unique(part):
        mine, n = rows[part == p], sizes[part == p]
        rarest = wanted.terms_of[mine, 0]
        yield np.repeat(mine, n), lists.entries[_spread(lists.first[rarest], n)] & 0xFFFFFFFF


def _exact(
    lists: _Lists, wanted: Phrases, phrase: np.ndarray, anchor: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Phrase numbers and start positions of exact occurrences around the anchors."""
    start = anchor - wanted.offset_of[phrase, 0]
    ok = start >= 0
    phrase, start = phrase[ok], start[ok]
    for k in range(1, wanted.terms_of.shape[1]):
        terms = wanted.terms_of[phrase, k]
        ok = (terms < 0) | lists.has(np.maximum(terms, 0), start + wanted.offset_of[phrase, k])
        phrase, start = phrase[ok], start[ok]
    return phrase, start


def _near(
    lists: _Lists, starts: np.ndarray, wanted: Phrases, phrase: np.ndarray, anchor: np.ndarray, near: int
) -> tuple[np.ndarray, np.ndarray]:
    """Phrases and anchors with all words of the phrase, in any order, within ``near``
    neighbouring words of one row.

    A window may begin 0 to ``near - 1`` words before the anchor. A word whose nearest
    places are ``back`` before and ``ahead`` after the anchor bars the beginnings that lie
    too late for the one and too early for the other: a run of bits.
    """
    own = np.searchsorted(starts, anchor, "right") - 1
    room_back, room_ahead = anchor - starts[own], starts[own + 1] - anchor
    barred = np.zeros(len(anchor), np.int64)
    last = len(lists.entries) - 1
    for k in range(1, wanted.terms_of.shape[1]):
        terms = wanted.terms_of[phrase, k]
        here = (np.maximum(terms, 0) << 32) | anchor
        at = np.searchsorted(lists.entries, here)
        ahead = lists.entries[np.minimum(at, last)] - here
        ahead = np.where((ahead >= 0) & (ahead < room_ahead), np.minimum(ahead, near), near)
        back = here - lists.entries[np.maximum(at - 1, 0)]
        back = np.where((back >= 0) & (back <= room_back), np.minimum(back, near), near)
        bits = (1 << back) - (1 << np.minimum(near - ahead, back))
        barred |= np.where(terms < 0, 0, bits)
        left = barred != (1 << near) - 1
        phrase, anchor, barred = phrase[left], anchor[left], barred[left]
        room_back, room_ahead = room_back[left], room_ahead[left]
    return phrase, anchor


def phrase_hits(index: DataFrame, wanted: Phrases, near: int = 0) -> DataFrame:
    """Rows with matches: ``segment, ordinal``, the ``spans`` of words hit by exact ones
    (``[start, end)`` within the row), the ``items`` that hold a phrase matched exactly and
    ``near_items``, whose phrase has all its words, in any order, within ``near``
    neighbouring words (0: none are looked for; at most 62)."""
    if not 0 <= near <= MOST_NEAR:
        raise ValueError(f"near must be 0 to {MOST_NEAR}")
    shared: Broadcast = index.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                hits = _hits(batch.slice(i, 1).to_pylist()[0], shared.value, near)
                if hits["ordinal"]:
                    yield pa.RecordBatch.from_pylist(_rows(hits), schema=_HITS)

    return index.drop("keys").mapInArrow(
        run,
        "segment long, ordinal int, spans array<struct<s: long, e: long>>, "
        "items array<string>, near_items array<string>",
    )


_HITS = pa.schema(
    [
        ("segment", pa.int64()),
        ("ordinal", pa.int32()),
        ("spans", pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))),
        ("items", pa.list_(pa.string())),
        ("near_items", pa.list_(pa.string())),
    ]
)


def _rows(hits: dict) -> list[dict]:
    return [
        {
            "segment": hits["segment"],
            "ordinal": o,
            "spans": hits["spans"].get(o, []),
            "items": sorted(hits["items"].get(o, ())),
            "near_items": sorted(hits["near_items"].get(o, ())),
        }
        for o in hits["ordinal"]
    ]


def _hits(row: dict, wanted: Phrases, near: int) -> dict:
    starts = _starts(row["sizes"])
    lists = _Lists(wanted.terms, row)
    mark = np.zeros(int(starts[-1]), bool)
    items: dict[int, set[str]] = {}
    near_items: dict[int, set[str]] = {}

    def note(found: dict[int, set[str]], phrase: np.ndarray, at: np.ndarray) -> None:
        holder = np.searchsorted(starts, at, "right") - 1
        for pair in np.unique(holder * len(wanted.items) + phrase):
            o, p = divmod(int(pair), len(wanted.items))
            found.setdefault(o, set()).update(wanted.items[p])

    if len(lists.entries):
        for phrase, anchor in _candidates(lists, wanted):
            if near:
                close = _near(lists, starts, wanted, phrase, anchor, near)
                note(near_items, *close)
                if near >= wanted.terms_of.shape[1]:  # then exact matches are among the near ones
                    phrase, anchor = close
            phrase, start = _exact(lists, wanted, phrase, anchor)
            mark |= covered(start, wanted.length[phrase], len(mark))
            note(items, phrase, start)
    spans: dict[int, list[dict]] = {}
    first, last = runs_of(mark)
    for s, e, o in zip(first, last, np.searchsorted(starts, first, "right") - 1, strict=True):
        spans.setdefault(int(o), []).append({"s": int(s - starts[o]), "e": int(e - starts[o])})
    ordinal = sorted(spans.keys() | near_items.keys())
    return {"segment": row["segment"], "ordinal": ordinal, "spans": spans, "items": items, "near_items": near_items}


# ---- proximity ------------------------------------------------------------


def near_matches(index: DataFrame, texts: list[tuple[object, str | None]], width: int) -> DataFrame:
    """``segment, ordinal, item, position`` where all distinct words of a text stand, in
    any order, within ``width`` neighbouring words; position: of the rarest word."""
    if not 0 < width <= MOST_NEAR:
        raise ValueError(f"width must be 1 to {MOST_NEAR}")
    longest = max((len(words_of(text)) for _, text in texts), default=0)
    shared = index.sparkSession.sparkContext.broadcast(phrases(index, texts, max(longest, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                lists, starts = _Lists(wanted.terms, row), _starts(row["sizes"])
                for phrase, anchor in _candidates(lists, wanted) if len(lists.entries) else ():
                    phrase, at = _near(lists, starts, wanted, phrase, anchor, width)
                    own = np.searchsorted(starts, at, "right") - 1
                    items = pa.array([wanted.items[p] for p in phrase], pa.list_(pa.string()))
                    of = pc.list_parent_indices(items).to_numpy()
                    out = {
                        "segment": pa.array([row["segment"]] * len(of), pa.int64()),
                        "ordinal": pa.array(own[of].astype(np.int32)),
                        "item": items.flatten(),
                        "position": pa.array((at - starts[own])[of]),
                    }
                    yield pa.RecordBatch.from_pydict(out)

    schema = "segment long, ordinal int, item string, position long"
    return index.drop("keys").mapInArrow(run, schema)


# ---- contamination --------------------------------------------------------


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    window: int = WINDOW,
    percent: int = 5,
    near: int = 0,
) -> DataFrame:
    """Per row of ``docs``: ``n_words``, ``n_hit`` words inside windows of the benchmark,
    the sorted ``items`` met, and ``contaminated``: at least ``percent`` of the words hit.
    ``near_items``: with a window of which all words stand, in any order, within ``near``
    neighbouring words (0: not looked for); they do not make a row contaminated."""
    index = build_index(docs, key, text)
    test = benchmark.select(benchmark[item].alias("item"), benchmark["text"].alias("text"))
    n_bytes = test.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = -(-n_bytes // SLICE_BYTES)
    part = F.pmod(F.xxhash64("item", "text"), F.lit(max(slices, 1)))
    hits = None
    for i in range(slices):
        texts = [tuple(r) for r in test.filter(part == i).collect()]  # about SLICE_BYTES
        found = phrase_hits(index, phrases(index, texts, window), near)
        hits = found if hits is None else hits.unionByName(found)
    rows = indexed_rows(index)
    kinds = {"spans": "array<struct<s: long, e: long>>", "items": "array<string>", "near_items": "array<string>"}
    empty = {c: F.array().cast(kind) for c, kind in kinds.items()}
    if hits is None:
        rows = rows.withColumns(empty)
    else:
        if slices > 1:
            both = (F.array_sort(F.flatten(F.collect_list(c))).alias(c) for c in kinds)
            hits = hits.groupBy("segment", "ordinal").agg(*both)
        rows = rows.join(hits, ["segment", "ordinal"], "left")
        rows = rows.withColumns({c: F.coalesce(c, e) for c, e in empty.items()})
        rows = rows.withColumns({c: F.array_distinct(c) for c in ("items", "near_items")})
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))
    n_hit = F.aggregate(
        "spans",
        zero,
        lambda a, x: F.struct(
            (a["n"] + F.greatest(x["e"] - F.greatest(x["s"], a["upto"]), F.lit(0))).alias("n"),
            F.greatest(a["upto"], x["e"]).alias("upto"),
        ),
        lambda a: a["n"],
    )
    lists = (F.array_sort(c).alias(c) for c in ("items", "near_items"))
    return rows.select(
        F.col("key").alias(key), "n_words", n_hit.alias("n_hit"), *lists
    ).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 100 >= F.col("n_words") * percent)
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, all columns unchanged.

    Rows are judged by key and text, so equal keys with different texts stay apart.
    """
    print_of = F.xxhash64(docs[text].cast("string"))
    row = F.struct(docs[key].alias("k"), print_of.alias("h"))
    found = contamination(docs.select(row.alias("row"), docs[text].alias("text")), benchmark, "row", "text")
    bad = found.filter("contaminated").select("row.k", "row.h").distinct()
    return docs.join(bad, docs[key].eqNullSafe(bad["k"]) & (print_of == bad["h"]), "left_anti")
