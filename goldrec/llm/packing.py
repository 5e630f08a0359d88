"""Best-fit packing of documents into sequences by exact-complement hashing.

Every text is read and tokenized once; what goes on is a row per piece. A plan needs only
how many pieces have each length, so it is made from a histogram of at most ``capacity``
numbers. From the longest length down, the gap that a piece leaves is looked up among the
lengths, the sums of two and the sums of three; combinations that fill it exactly are
consumed as often as their counts allow. What has no exact partner is packed best-fit. The
plan is a list of patterns, each with the number of sequences made like it; its size
depends on the capacity, not on the table.

Pieces of one length are exchangeable, so a piece finds its sequence by its number among
the pieces of its length. Tasks number their own pieces while tokenizing, and a prefix sum
over the tasks' counts makes the numbers global: no group of rows meets in one task.

Defined results: a null or empty text is one piece, the end id alone; a row with a null key
and repeated rows are packed one by one; texts over the capacity are cut into full pieces
and a rest; other columns are not looked at; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from goldrec.llm.batches import slices
from goldrec.plans.durable import durable

CAPACITY = 4096

# ---- tokens ----------------------------------------------------------------

#: Size of the memory of a worker: characters of its chunks, and 16 for each.
MOST_KNOWN = 32 << 20
#: Signs behind a run of letters that never join it in one token, and letters of which
#: normal forms and lower case are known: those of Latin-1.
STOPS = ".,;:!?"
LETTERS = r"[a-z\x{df}-\x{f6}\x{f8}-\x{ff}]"
BEYOND = r"[^\x{00}-\x{ff}]"


class Tokens:
    """Token ids of whole texts through a memory of chunks.

    The tokenizer lower-cases, splits at white space and between letters and other signs,
    and merges within what is left; none of its steps looks across white space. So the ids
    of a text are those of its chunks in order, and those of letters before a stop are the
    letters' and the stop's. A batch is split and counted as a column, and only chunks that
    the worker has not met are tokenized: runs of letters many at a time, as each ends with
    its first token that marks the end of a word.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = Tokenizer.from_file(path)  # for text on which normalizing has no effect
        self.plain.normalizer = None
        suffix = self.tokenizer.model.end_of_word_suffix
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith(suffix)
        self._forget()

    def _forget(self) -> None:
        self.known, self.size = {"": 0}, 0
        self.pool, self.upto = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def _each(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of any chunks, and where each chunk's end."""
        found = [x.ids for x in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
        return _joined(found), np.cumsum([len(x) for x in found], dtype=np.int64)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for runs of lower-case letters."""
        lines = [" ".join(words[i : i + 64]) for i in range(0, len(words), 64)]
        ids = _joined([x.ids for x in self.plain.encode_batch_fast(lines, add_special_tokens=False)])
        upto = np.flatnonzero(self.ends[ids]) + 1
        return (ids, upto) if len(upto) == len(words) else self._each(words)

    def _places(self, chunks: pa.Array, letters: pa.Array) -> np.ndarray:
        """Where in the memory different chunks are; ``letters`` marks runs of letters."""
        names = chunks.to_numpy(zero_copy_only=False).tolist()
        at = np.fromiter(map(self.known.get, names, repeat(-1)), np.int64, len(names))
        letters = letters.to_numpy(zero_copy_only=False)
        for mask, tokenized in ((letters, self._words), (~letters, self._each)):
            places = np.flatnonzero(mask & (at < 0))
            new = [names[i] for i in places.tolist()]
            ids, upto = tokenized(new)
            first = len(self.upto)
            at[places] = range(first, first + len(new))
            self.known.update(zip(new, range(first, first + len(new)), strict=True))
            self.upto = np.concatenate([self.upto, upto + len(self.pool)])
            self.pool = np.concatenate([self.pool, ids])
            self.size += sum(map(len, new)) + 16 * len(new)
        return at

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all ``texts`` (without nulls), and where each text's end."""
        if self.size > MOST_KNOWN:
            self._forget()
        # within Latin-1 lower case can come before the normal form: nothing there composes
        beyond = pc.match_substring_regex(texts, BEYOND)
        lists = pc.ascii_split_whitespace(pc.if_else(beyond, texts, pc.utf8_lower(texts)))
        flat = lists.flatten().dictionary_encode()
        chunks = flat.dictionary
        ending = pc.match_substring_regex(chunks, f"^{LETTERS}+[{STOPS}]+$")
        stems = pc.if_else(ending, pc.utf8_rtrim(chunks, STOPS), chunks).dictionary_encode()
        names = stems.dictionary
        found = self._places(names, pc.match_substring_regex(names, f"^{LETTERS}+$"))
        units = np.zeros((len(chunks), 2), np.int64)
        units[:, 0] = found[stems.indices.to_numpy()]
        at = np.flatnonzero(ending.to_numpy(zero_copy_only=False))
        stops = pc.utf8_ltrim(chunks.take(pa.array(at)), _LETTERS).dictionary_encode()
        places = self._places(stops.dictionary, pc.match_substring_regex(stops.dictionary, "^$"))
        units[at, 1] = places[stops.indices.to_numpy()]

        units = units[flat.indices.to_numpy()].ravel()
        starts = np.concatenate([[0], self.upto])[units]
        lengths = self.upto[units] - starts
        ends = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.pool[np.repeat(starts - ends[:-1], lengths) + np.arange(ends[-1])]
        offsets = lists.offsets.to_numpy()
        return ids, ends[2 * (offsets[1:] - offsets[0])]


_LETTERS = "".join(map(chr, [*range(0x61, 0x7B), *range(0xDF, 0xF7), *range(0xF8, 0x100)]))


def _joined(parts: list[list[int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(parts), np.uint32)


_TOKENS: dict[str, Tokens] = {}


def tokens(path: str) -> Tokens:
    """One per Python worker, kept from task to task."""
    if path not in _TOKENS:
        _TOKENS[path] = Tokens(path)
    return _TOKENS[path]


PIECES = T.StructType(
    [
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("task", T.IntegerType()),
        T.StructField("nth", T.LongType()),
    ]
)
SLICE = 4 << 20


def pieces(
    docs: DataFrame,
    tokenizer: str,
    key: str = "doc_id",
    text: str = "text",
    end: int = 1,
    capacity: int = CAPACITY,
    ids: bool = False,
) -> DataFrame:
    """One row per piece: ``key, piece, start, length, ids_crc32``, with ``ids`` the ids
    themselves, and ``task, nth``: a number among the task's pieces of this length."""
    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), *PIECES.fields])
    if ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), Counter()
        encoder = tokens(tokenizer)
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                rows, out, before = [], [], 0
                found, upto = encoder.encode(pc.fill_null(part.column(1), ""))
                found = np.insert(found, upto, end).astype("<u4")
                for row, after in enumerate((upto + np.arange(1, len(upto) + 1)).tolist()):
                    for k, at in enumerate(range(before, after, capacity)):
                        own = found[at : min(at + capacity, after)]
                        n = len(own)
                        rows.append(row)
                        out.append((k, at - before, n, zlib.crc32(own), task, seen[n], own))
                        seen[n] += 1
                    before = after
                columns = list(zip(*out, strict=True))
                arrays = [part.column(0).take(pa.array(rows, pa.int64()))]
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                arrays += [pa.array(c, t) for c, t in zip(columns, kinds, strict=False)]
                if ids:
                    arrays.append(pa.array([x.astype(np.int32) for x in columns[-1]], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return docs.select(docs[key], docs[text].cast("string")).mapInArrow(cut, schema)


# ---- the plan --------------------------------------------------------------


@dataclass(frozen=True)
class Pattern:
    """``n`` sequences that hold ``lengths``, in this order."""

    n: int
    lengths: tuple[int, ...]


def _sums(a: np.ndarray, b: np.ndarray, upto: int) -> np.ndarray:
    """Which sums up to ``upto`` a member of set ``a`` and one of set ``b`` make."""
    size = 1 << (len(a) + len(b)).bit_length()
    found = np.fft.irfft(np.fft.rfft(a, size) * np.fft.rfft(b, size), size)
    return found[: upto + 1] > 0.5


def _complements(counts: np.ndarray, capacity: int) -> Iterator[Pattern]:
    """Combinations that fill a sequence exactly: a length with one, two or three more.

    ``counts`` are the available pieces per length and are used up. Lengths are looked at
    from the longest. Among the partners those with a longer first member come first, as
    long pieces are the harder to place. An index of the sums of two and of three available
    lengths, made anew for every length, says which gaps can be filled.
    """
    lengths = np.arange(capacity + 1)

    def take(chosen: tuple[int, ...]) -> Iterator[Pattern]:
        need = Counter(chosen)
        n = min(int(counts[x]) // k for x, k in need.items())
        if n:
            for x, k in need.items():
                counts[x] -= n * k
            yield Pattern(n, chosen)

    def pairs(total: int, most: int) -> list[int]:
        """The longer members, longest first, of available pairs of this sum."""
        high = lengths[(total + 1) // 2 : min(total - 1, most) + 1]
        return high[(counts[high] > 0) & (counts[total - high] > 0)][::-1].tolist()

    for long in range(capacity, 0, -1):
        if not counts[long]:
            continue
        gap = capacity - long
        if gap <= long:
            yield from take((long, gap) if gap else (long,))
        if not counts[long]:
            continue
        have = (counts > 0) & (lengths <= long)
        two = _sums(have, have, gap)
        if two[gap]:
            for a in pairs(gap, long):
                if not counts[long]:
                    break
                yield from take((long, a, gap - a))
        if not counts[long] or not _sums(two, have, gap)[gap]:
            continue
        third = lengths[(gap + 2) // 3 : min(long, gap - 2) + 1]
        for a in third[have[third] & two[gap - third]][::-1].tolist():
            for b in pairs(gap - a, a) if counts[long] and counts[a] else ():
                if not (counts[long] and counts[a]):
                    break
                yield from take((long, a, b, gap - a - b))


def _best_fit(counts: np.ndarray, capacity: int) -> Iterator[Pattern]:
    """Best-fit decreasing over counts: sequences that look alike are filled together. A
    length splits one group of sequences at most, so groups are few."""
    groups: dict[int, list[Pattern]] = {}

    def add(gap: int, n: int, held: tuple[int, ...]) -> None:
        if n:
            groups.setdefault(gap, []).append(Pattern(n, held))

    for length in range(capacity, 0, -1):
        left = int(counts[length])
        for gap in sorted(g for g in groups if g >= length) if left else ():
            fit = gap // length
            for p in groups.pop(gap):
                full = min(p.n, left // fit)
                rest = left - full * fit if full < p.n else 0
                add(gap - fit * length, full, p.lengths + (length,) * fit)
                add(gap - rest * length, int(rest > 0), p.lengths + (length,) * rest)
                add(gap, p.n - full - int(rest > 0), p.lengths)
                left -= full * fit + rest
        fit = capacity // length
        full, rest = divmod(left, fit)
        add(capacity - fit * length, full, (length,) * fit)
        add(capacity - rest * length, int(rest > 0), (length,) * rest)
    for alike in groups.values():
        yield from alike


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns that use every piece once."""
    free = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        free[length] = n
    found = list(_complements(free, capacity))
    return found + list(_best_fit(free, capacity))


def places(patterns: list[Pattern], capacity: int = CAPACITY) -> np.ndarray:
    """Columns ``length, first, each, sequence, offset``, sorted: of the pieces of a length,
    those from number ``first`` go ``each`` to a sequence, from ``sequence`` and ``offset``."""
    used = np.zeros(capacity + 1, np.int64)
    rows, sequence = [], 0
    for p in patterns:
        offset = 0
        for length, k in Counter(p.lengths).items():
            rows.append((length, used[length], k, sequence, offset))
            used[length] += k * p.n
            offset += k * length
        sequence += p.n
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return table


# ---- packing ---------------------------------------------------------------


def pack(
    docs: DataFrame,
    tokenizer: str,
    key: str = "doc_id",
    text: str = "text",
    end: int = 1,
    capacity: int = CAPACITY,
    ids: bool = False,
) -> DataFrame:
    """Pieces of all documents with ``sequence_id`` and ``offset``, the place in it."""
    rows = durable(pieces(docs, tokenizer, key, text, end, capacity, ids), "pieces")
    by_task = rows.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    along = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    before = by_task.select("length", "task", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("before"))
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = places(plan(counts, capacity), capacity)  # counts: a row a length

    numbered = rows.join(before, ["length", "task"]).withColumn("number", F.col("nth") + F.col("before"))
    numbered = numbered.select(*(c for c in rows.columns if c not in ("task", "nth")), "number")
    schema = T.StructType(
        [f for f in numbered.schema.fields if f.name != "number"]
        + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    )
    wide = np.int64(1) << 40  # numbers of pieces of one length stay below
    starts = table[:, 0] * wide + table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            number = batch.column("number").to_numpy()
            found = table[np.searchsorted(starts, length * wide + number, "right") - 1]
            own = number - found[:, 1]
            arrays = [batch.column(f.name) for f in schema.fields[:-2]]
            arrays.append(pa.array(found[:, 3] + own // found[:, 2]))
            arrays.append(pa.array(found[:, 4] + own % found[:, 2] * length))
            yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return numbered.mapInArrow(place, schema)
