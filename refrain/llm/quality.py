"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

Terms of a text are its words (hashed), the shapes of its tokens, and marks of
tokens that repeat the one before. Counts enter by their logarithm times an
inverse document frequency; a truncated singular value decomposition of the
labelled texts' matrix gives the latent space. Every document is projected into
it and compared by exact cosine, a block of documents at a time, with all
labelled vectors; the ``neighbours`` most similar (all that tie for the last
place included) vote with their similarity as weight.

The fit reads a bounded sample: at most ``max_labelled`` labelled rows, half of
each class, those with the least hash of id. What is broadcast is that many
vectors of ``dims`` numbers, whatever the size of the corpus. Scoring is one
pass without a shuffle.

Defined results: null, empty and blank texts score 0 and are rejected. A text
none of whose terms is known has no similar neighbour and scores 0.5; it is
kept. Without labelled rows of both classes every text with a word scores 1.
Rows are scored one by one: repeated rows get equal scores, ids may be null, and
other columns pass through. Labels name documents by doc_id; an id with several
labels has the least, and labels other than 0 and 1 are none. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytekit as B
from .common import col, fresh

MAX_LABELLED = 2000
DIMS = 48
NEIGHBOURS = 15
THRESHOLD = 0.5
SHAPE_WEIGHT = 2.0
MARK_WEIGHT = 8.0
#: Percentage of tokens that repeat the one before in ordinary prose.
CHANCE = 5.0
_WORDS = 1 << 12
_SHAPES = 1 << 10
TERMS = _WORDS + _SHAPES
#: Bytes of documents handled at once, and documents in a block of cosines.
_BLOCK = 1 << 20
_ROWS = 512

# classes of bytes: 1 lower-case letter or part of a longer character, 2 capital, 3 digit, 4 full stop or comma, 5 other signs
_CLASS = np.full(256, 5, np.uint8)
_CLASS[97:123] = _CLASS[128:] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[44, 46]] = 4


def term_counts(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of terms before idf (a row for each text), and how many tokens each text has.

    Words weigh the logarithm of their count, shapes SHAPE_WEIGHT times that. The
    mark weighs MARK_WEIGHT times the logarithm of the percentage of tokens that
    repeat the one before, as far as it exceeds CHANCE."""
    n = len(offs) - 1
    starts, ends, row = B.tokens(data, offs)
    tokens = np.bincount(row, minlength=n) if len(row) else np.zeros(n, np.int64)
    if not len(starts):
        return np.zeros((n, TERMS), np.float32), tokens
    words = B.spans(B.lower(data), starts, ends)
    kind = _CLASS[data]
    size = ends - starts
    # the shape: classes of the first two and last two bytes, and whether it is one byte, a few or many
    shape = (kind[starts].astype(np.int64) * 6 + kind[np.minimum(starts + 1, ends - 1)]) * 36 + kind[ends - 1] * 6 + kind[np.maximum(ends - 2, starts)]
    shape = shape * 4 + (size > 1) + (size > 3) + (size > 16)
    again = np.zeros(len(row), bool)
    again[1:] = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
    terms = np.concatenate(((words % np.uint64(_WORDS)).astype(np.int64), _WORDS + (B.mix(shape.astype(np.uint64)) % np.uint64(_SHAPES - 1)).astype(np.int64)))
    weight = np.bincount(np.concatenate((row, row)) * TERMS + terms, minlength=n * TERMS).reshape(n, TERMS).astype(np.float32)
    np.log1p(weight, out=weight)
    weight[:, _WORDS:] *= SHAPE_WEIGHT
    weight[:, TERMS - 1] = MARK_WEIGHT * np.log1p(np.maximum(0, 100 * np.bincount(row[again], minlength=n) / (tokens + 10) - CHANCE))
    return weight, tokens


@dataclass
class Model:
    """idf (terms), projection (terms by dims), labelled vectors (dims by rows) and their labels."""

    idf: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int = NEIGHBOURS

    def embed(self, counts: np.ndarray) -> np.ndarray:
        v = (counts * self.idf) @ self.projection
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)

    def vote(self, vectors: np.ndarray) -> np.ndarray:
        k = min(self.neighbours, len(self.labels))
        near = np.maximum(vectors @ self.vectors, 0)
        least = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k]
        near[near < least[:, None]] = 0
        total = near.sum(1)
        return np.divide(near @ self.labels, total, out=np.full(len(near), 0.5, np.float32), where=total > 0)

    def score(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        counts, tokens = term_counts(data, offs)
        return np.where(tokens > 0, self.vote(self.embed(counts)), 0).astype(np.float64)


def _sampled(labels: DataFrame, label: str, bound: int) -> DataFrame:
    """At most bound labelled ids, half of each class; an id with several labels has the least of them."""
    one = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    half = [one.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound // 2) for y in (0, 1)]
    return half[0].unionAll(half[1])


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, bound: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, label, text) of the sample; its size is at most bound, so it is broadcast."""
    texts = docs.select(col(docs, id_col).cast("long").alias("doc_id"), col(docs, text_col).alias("text")).where("text is not null")
    return texts.join(F.broadcast(_sampled(labels.select(F.col("doc_id").cast("long").alias("doc_id"), label), label, bound)), "doc_id").select("doc_id", "label", "text")


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 64):
            piece = batch.slice(a, 64)
            counts, _ = term_counts(*B.flat(piece.column(2)))
            at = [np.flatnonzero(c) for c in counts]
            yield pa.RecordBatch.from_arrays([
                piece.column(0), piece.column(1), pa.array([x.astype("<i4").tobytes() for x in at], pa.binary()), pa.array([c[x].astype("<f4").tobytes() for c, x in zip(counts, at)], pa.binary()),
            ], ["doc_id", "label", "at", "n"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_labelled: int = MAX_LABELLED, dims: int = DIMS, neighbours: int = NEIGHBOURS, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """The model of a bounded sample of labelled rows; None without rows of both classes."""
    rows = labelled_texts(docs, labels, label, max_labelled, id_col, text_col).mapInArrow(_sparse, "doc_id long, label int, at binary, n binary").toPandas()
    rows = rows[rows.n.str.len() > 0].drop_duplicates(["doc_id", "at", "n"]).sort_values(["doc_id", "at", "n"])
    if rows.label.nunique() < 2:
        return None
    x = np.zeros((len(rows), TERMS), np.float32)  # bounded by max_labelled
    for i, (at, n) in enumerate(zip(rows["at"], rows["n"])):
        x[i, np.frombuffer(at, "<i4")] = np.frombuffer(n, "<f4")
    return trained(x, rows.label.to_numpy(np.float32), dims, neighbours)


def trained(x: np.ndarray, labels: np.ndarray, dims: int = DIMS, neighbours: int = NEIGHBOURS) -> Model:
    """The model of term weights x, a row for each label; x is overwritten."""
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32)
    x *= idf
    # right singular vectors by subspace iteration from a fixed start
    k = min(dims, len(x), TERMS)
    q = np.linalg.qr(np.random.default_rng(7).standard_normal((TERMS, min(k + 8, len(x)))).astype(np.float32))[0]
    for _ in range(6):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    projection = np.ascontiguousarray((q @ vt.T)[:, :k], np.float32)
    model = Model(idf, projection, np.zeros((k, 0), np.float32), labels, neighbours)
    v = x @ projection
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    model.vectors = np.ascontiguousarray(np.divide(v, norm, out=np.zeros_like(v), where=norm > 0).T)
    return model


def scored(text: Column, model: Model | None) -> Column:
    """The score of a text as a column."""
    shared = model

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = np.zeros(len(texts))
            sizes = np.diff(B.flat(texts)[1])
            group = np.cumsum(sizes) // _BLOCK
            cuts = np.unique(np.concatenate((np.flatnonzero(np.diff(group, prepend=-1)), np.arange(0, len(texts), _ROWS), [len(texts)])))
            for a, b in zip(cuts[:-1], cuts[1:]):
                data, offs = B.flat(texts.slice(int(a), int(b - a)))
                if shared is None:
                    _, _, row = B.tokens(data, offs)
                    out[a:b][np.unique(row)] = 1
                else:
                    out[a:b] = shared.score(data, offs)
            yield pa.array(out)

    return score(text)


def classify(docs: DataFrame, labels: DataFrame, training_docs: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, quality_score, kept) for each row of docs."""
    model = fit(training_docs if training_docs is not None else docs, labels, max_labelled=max_labelled, id_col=id_col, text_col=text_col)
    out = docs.select(col(docs, id_col).cast("long").alias("doc_id"), scored(col(docs, text_col), model).alias("quality_score"))
    return out.withColumn("kept", F.col("quality_score") >= threshold)


def keep_good(docs: DataFrame, labels: DataFrame, training_docs: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """docs without the rows that score below the threshold, all columns as they were."""
    model = fit(training_docs if training_docs is not None else docs, labels, max_labelled=max_labelled, id_col=id_col, text_col=text_col)
    score = fresh(docs, "quality_score")
    return docs.withColumn(score, scored(col(docs, text_col), model)).where(F.col(score) >= threshold).drop(score)
