"""Quality classifier: nearest-neighbour voting among latent-semantic vectors.

Texts become hashed term vectors (words as they stand, runs of punctuation, and a few
terms for the text's shape), weighted by inverse document frequency over all texts. The
right singular vectors of a bounded sample of labelled texts give the latent space. The
sample's vectors and labels are broadcast; every text meets all of them in products with
blocks of them, and its nearest ones vote by similarity.

Bounds: ``SAMPLE`` labelled texts (smallest hashes of their keys), ``TERMS`` hashed
terms, ``LATENT`` dimensions; the broadcast is about two megabytes whatever the input.

Defined results: a null or empty text has the shape terms of an empty one and is scored
by them; where there is nothing to go by the score is the labels' mean, 0.5 without
labels; keys labelled both ways are left out; equal rows score alike; other columns are
not read. Texts are taken whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldrec.llm.batches import slices
from goldrec.plans.durable import durable

TERMS = 2048
LATENT = 64
SAMPLE = 4096
NEIGHBOURS = 15
#: Weight of a shape term beside the unit-length word part.
SHAPE = 0.5
#: Texts whose term vectors are dense at once, and labelled vectors in one product.
BLOCK = 512
#: Similarities count to so many digits; of equal ones the smaller key is nearer.
LIKE_DIGITS = 6
SHAPE_STEPS = 8
SHAPES = ("fresh", "upper", "marks", "long", "letters", "lines")
WIDTH = TERMS + len(SHAPES) * SHAPE_STEPS

_MARKS = bytes(range(0x21, 0x30)) + bytes(range(0x3A, 0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x7F))
_TO_WORDS = bytes(0x20 if x in _MARKS else x for x in range(256))
_TO_MARKS = bytes(x if x in _MARKS else 0x20 for x in range(256))


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _shape(raw: bytes, words: list[bytes], marks: int) -> list[float]:
    """Numbers from 0 to 1 that tell what kind of text it is."""
    n = max(len(words), 1)
    letters = sum(map(len, words))
    upper = sum(w.isupper() and len(w) > 1 for w in words)
    lines = raw.split(b"\n")
    return [
        len(set(words)) / n,
        upper / n,
        min(marks / n, 1.0),
        min(letters / n / 16, 1.0),
        letters / max(len(raw), 1),
        len(set(lines)) / len(lines),
    ]


def term_counts(texts: list[str | None]) -> np.ndarray:
    """Counts of hashed terms, and after them the shape terms (0 or 1): a row per text."""
    terms: list[bytes] = []
    sizes = []
    shapes = np.zeros((len(texts), len(SHAPES)))
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        words, marks = raw.translate(_TO_WORDS).split(), raw.translate(_TO_MARKS).split()
        shapes[i] = _shape(raw, words, len(marks))
        terms += words
        terms += marks
        sizes.append(len(words) + len(marks))
    coded = pa.array(terms, pa.binary()).dictionary_encode()
    place = np.array([zlib.crc32(t) % TERMS for t in coded.dictionary.to_pylist()], np.int64)
    numbers = place[coded.indices.to_numpy(zero_copy_only=False)] if terms else np.empty(0, np.int64)
    at = np.repeat(np.arange(len(texts)), sizes) * WIDTH + numbers
    out = np.bincount(at, minlength=len(texts) * WIDTH).reshape(len(texts), WIDTH).astype(np.float32)
    step = np.minimum((shapes * SHAPE_STEPS).astype(int), SHAPE_STEPS - 1)
    rows = np.arange(len(texts))[:, None]
    out[rows, TERMS + np.arange(len(SHAPES)) * SHAPE_STEPS + step] = 1
    return out


def _blocks(texts: list[str | None]) -> Iterator[np.ndarray]:
    for i in range(0, len(texts), BLOCK):
        yield term_counts(texts[i : i + BLOCK])


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    out = np.log1p(counts) * idf
    words = out[:, :TERMS]
    words /= np.maximum(np.linalg.norm(words, axis=1, keepdims=True), 1e-12)
    out[:, TERMS:] = np.where(counts[:, TERMS:] > 0, SHAPE, 0)
    return out


def inverse_frequencies(docs: DataFrame, text: str = "text") -> np.ndarray:
    """``log((1 + n) / (1 + texts with the term))`` over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(WIDTH, np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for part in slices(batch, 0):
                for counts in _blocks(part.column(0).to_pylist()):
                    total += (counts > 0).sum(axis=0)
        both = np.r_[total, n]
        yield pa.RecordBatch.from_pydict({"term": pa.array(np.arange(WIDTH + 1, dtype=np.int32)), "n": pa.array(both)})

    parts = docs.select(docs[text].cast("string")).mapInArrow(run, "term int, n long")
    out = np.zeros(WIDTH + 1)
    for term, n in parts.groupBy("term").agg(F.sum("n")).collect():  # WIDTH + 1 rows
        out[term] = n
    return np.log((1 + out[-1]) / (1 + out[:-1])).astype(np.float32)


@dataclass(frozen=True)
class Model:
    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def score(self, row: np.ndarray) -> float:
        """The vote on one text, a row of weighted terms. The labelled vectors are what is
        blocked: in a product of many texts the last bits would depend on the texts beside."""
        terms = np.flatnonzero(row)
        latent = row[terms] @ self.basis[terms]
        latent = latent / max(float(np.linalg.norm(latent)), 1e-12)
        blocks = range(0, len(self.vectors), BLOCK)
        like = np.concatenate([self.vectors[i : i + BLOCK] @ latent for i in blocks])
        like = np.round(like, LIKE_DIGITS)
        near = nearest(like, min(NEIGHBOURS, len(like)))
        weight = np.maximum(like[near], 0).astype(np.float64) ** 4
        vote = (weight * self.labels[near]).sum() + 1e-6 * self.prior
        return float(np.clip(vote / (weight.sum() + 1e-6), 0, 1))

    def scores(self, counts: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(counts), self.prior)
        return np.array([self.score(row) for row in weighted(counts, self.idf)], np.float64)


def nearest(like: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest values; of equal ones the first count."""
    least = np.partition(like, len(like) - k)[len(like) - k]
    above = np.flatnonzero(like > least)
    return np.concatenate([above, np.flatnonzero(like == least)[: k - len(above)]])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """The latent space and the labelled vectors, from rows that are not held out."""
    idf = inverse_frequencies(docs, text)
    known = labels.select(labels[key].alias("key"), labels[label].cast("int").alias("label"))
    known = known.filter(F.col("label").isNotNull() & F.col("key").isNotNull() & ~held_out(F.col("key")))
    known = known.groupBy("key").agg(F.min("label").alias("label"), F.max("label").alias("other"))
    order = F.xxhash64("key")
    # rows of copied keys: one text each
    texts = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text"))
    wanted = known.filter("label = other").select("key", "label").orderBy(order, "key").limit(SAMPLE)
    sample = texts.join(F.broadcast(wanted), "key").groupBy("key", "label").agg(F.min("text").alias("text"))
    rows = sample.orderBy("key").mapInArrow(_sample_vectors, "key string, label int, counts binary")
    rows = durable(rows, "labelled").collect()  # at most SAMPLE rows of WIDTH counts
    rows.sort(key=lambda r: (r.key is None, r.key))
    labels_of = np.array([r.label for r in rows], np.float64)
    prior = float(labels_of.mean()) if len(rows) else 0.5
    if not rows:
        return Model(idf, np.zeros((WIDTH, 1), np.float32), np.zeros((0, 1), np.float32), labels_of, prior)
    matrix = weighted(np.stack([np.frombuffer(r.counts, "<f4") for r in rows]), idf)
    # right singular vectors from the small square of the matrix
    _, basis = np.linalg.eigh((matrix.T @ matrix).astype(np.float64))
    basis = np.ascontiguousarray(basis[:, ::-1][:, :LATENT], dtype=np.float32)
    model = Model(idf, basis, np.zeros((0, 1)), labels_of, prior)
    latent = matrix @ basis
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
    return Model(idf, model.basis, latent.astype(np.float32), labels_of, prior)


def _sample_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for i in range(0, len(texts), BLOCK):
            part = batch.slice(i, BLOCK)
            counts = term_counts(texts[i : i + BLOCK])
            out = {
                "key": part.column("key").cast(pa.string()),
                "label": part.column("label"),
                "counts": pa.array([row.astype("<f4").tobytes() for row in counts], pa.binary()),
            }
            yield pa.RecordBatch.from_pydict(out)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, held_out, score, predicted`` of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text"))
    kind = rows.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                scores = [shared.value.scores(c) for c in _blocks(part.column(1).to_pylist())]
                out = {"key": part.column(0), "score": pa.array(np.concatenate(scores))}
                yield pa.RecordBatch.from_pydict(out)

    scored = rows.mapInArrow(run, f"key {kind}, score double")
    return scored.select(
        F.col("key").alias(key),
        held_out(F.col("key")).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )
