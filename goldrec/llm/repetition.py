"""Quality rules: repetition within a text, from a suffix array of its words.

Longest-common-prefix intervals give the maximal repeated word sequences. The union
of their spans gives the covered fraction; it and the longest repeat are limited,
beside the base rules on length and repeated three-word windows.

Defined results: a null text counts as empty and fails the base rules; equal rows
are judged alike, each for itself; other columns pass through untouched; an empty
table gives an empty table. Texts are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from goldrec.llm.batches import slices
from goldrec.llm.suffixes import (
    covered,
    longest_repeat_at,
    neighbour_lcp,
    suffix_order,
    sums_by,
)

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
WINDOW = 3
#: Words whose suffixes are sorted at once; a longer text is sorted by itself.
CHUNK_WORDS = 1 << 19

MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_covered_words long, longest_repeat long"
)


@dataclass(frozen=True)
class Limits:
    """``least_repeat``: words from which a repeat counts as covering. A longest repeat
    of under three words is reported as 0."""

    least_words: int = 50
    repeat_percent: int = 50
    least_repeat: int = 10
    covered_percent: int = 40
    longest_repeat: int = 200


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all texts end to end, and where each text starts."""
    words: list[bytes] = []
    offsets = [0]
    for text in texts:
        words += text.split()
        offsets.append(len(words))
    numbers = pa.array(words, pa.binary()).dictionary_encode().indices
    return numbers.to_numpy(zero_copy_only=False).astype(np.int64), np.array(offsets)


def repeats(numbers: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the maximal repeated sequences within each text."""
    sizes = np.diff(offsets)
    text = np.repeat(np.arange(len(sizes)), sizes)
    ends = np.repeat(offsets[1:], sizes)
    most = int(numbers.max()) + 1 if len(numbers) else 1
    order, levels = suffix_order(text * most + numbers, ends)
    length = longest_repeat_at(order, neighbour_lcp(order, levels, ends))
    # one that is the end of the repeat before it is not maximal to the left
    inner = np.r_[False, (length[:-1] == length[1:] + 1) & (text[:-1] == text[1:])][: len(length)]
    starts = np.flatnonzero((length >= least) & ~inner)
    return starts, length[starts]


def _measure(texts: list[str], limits: Limits) -> dict[str, np.ndarray]:
    raw = [t.encode() for t in texts]
    numbers, offsets = _words(raw)
    n = len(numbers)
    n_words = np.diff(offsets)
    starts, lengths = repeats(numbers, offsets, WINDOW)
    n_repeat = sums_by(offsets, covered(starts, lengths, n))
    wide = lengths >= limits.least_repeat
    n_covered = sums_by(offsets, covered(starts[wide], lengths[wide], n))
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, np.searchsorted(offsets, starts, "right") - 1, lengths)
    dup_lines = []
    for text in raw:
        lines = [x for x in text.split(b"\n") if x.strip()]
        dup_lines.append(len(lines) - len(set(lines)))
    failed = (n_words < limits.least_words) | (100 * n_repeat > limits.repeat_percent * n_words)
    over = (100 * n_covered > limits.covered_percent * n_words) | (longest > limits.longest_repeat)
    return {
        "n_words": n_words,
        "word_chars": np.array([len(t) - sum(map(t.count, SPACES)) for t in texts], np.int64),
        "n_symbols": np.array([sum(map(t.count, SYMBOLS)) for t in texts], np.int64),
        "n_dup_lines": np.array(dup_lines, np.int64),
        "n_repeat_words": n_repeat,
        "base_failed": failed,
        "kept": ~failed & ~over,
        "n_covered_words": n_covered,
        "longest_repeat": longest,
    }


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    chunk, size = [], 0
    for text in texts:
        if chunk and size + len(text) // 4 > CHUNK_WORDS:
            yield chunk
            chunk, size = [], 0
        chunk.append(text)
        size += len(text) // 4
    if chunk:
        yield chunk


def _measured(column: pa.Array, limits: Limits) -> dict[str, np.ndarray]:
    texts = column.fill_null("").to_pylist()
    parts = [_measure(chunk, limits) for chunk in _chunks(texts)]
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def repetition(
    docs: DataFrame, key: str = "doc_id", text: str = "text", limits: Limits = Limits()
) -> DataFrame:
    """One row per row of ``docs``: its key, the measures and the verdict."""
    rows = docs.select(docs[key], docs[text].cast("string").alias("_text"))
    kind = rows.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                out = _measured(part.column(1), limits)
                columns = [part.column(0), *map(pa.array, out.values())]
                yield pa.RecordBatch.from_arrays(columns, [key, *out])

    return rows.mapInArrow(run, f"`{key}` {kind}, {MEASURES}")


def keep_unrepetitive(docs: DataFrame, text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """The rows of ``docs`` that pass the rules, all columns unchanged; no shuffle."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                yield part.filter(pa.array(_measured(part.column(at), limits)["kept"]))

    return docs.mapInArrow(run, docs.schema)
