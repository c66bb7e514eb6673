"""Quality: similarity-weighted votes of the nearest labelled documents in a latent-semantic space.

A text is described by its words (hashed, lower-cased, without marks around them) and, weighing as much, by its shape:
trigrams of character classes (case, digits, marks) and how often a word equals one of the words just before it. The
idf of each feature is taken over all documents. The tf-idf vectors of a bounded labelled sample give the latent axes
(a truncated SVD); the sample's vectors are broadcast, and each block of documents is compared with all of them by one
exact matrix product. The votes of the nearest are weighted by cosine.

Defined results: a null or empty text, as any without a feature, scores 0; labels are learnt from a bounded sample
(MAX_TRAIN_ROWS); without labels every score is 0; equally near neighbours are taken in the order of their ids;
repeated rows get equal scores; an empty table gives no rows; extra columns do not matter.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship
from .labelled import fold, training_sample
from .toxicity import in_slices

ship(__name__)

MAX_TRAIN_ROWS = 4_000
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7
AXES = 48
NEIGHBOURS = 15
WORDS = 8192  # hashed words
TERMS = 2048  # hashed shape trigrams
LAGS = 8  # how many words back a repetition is looked for
BLOCK = 256  # documents compared at once
SPARE, ROUNDS = 16, 8  # of the subspace iteration: axes beside those kept, products
CHUNKS = 16  # rows in which the document counts are added up

# Marks that are cut off a word.
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())

# Character classes: letters and digits by kind, white space by kind, marks as they are.
SHAPE = bytes(
    ord("A") if 65 <= c <= 90 else ord("0") if 48 <= c <= 57 else ord("a") if 97 <= c <= 122 or c >= 128 else
    ord(" ") if c in (9, 11, 12, 13) else c for c in range(256))


def term_shares(texts: list[str]) -> np.ndarray:
    """Per text the shares of its shape trigrams, of its words that repeat (LAGS columns), and of its hashed words."""
    out = np.zeros((len(texts), TERMS + LAGS + WORDS), np.float32)
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    for i, data in enumerate(raw):
        for begin in range(0, len(data), 1 << 20):  # long texts in parts that share two bytes
            shape = np.frombuffer(data[begin:begin + (1 << 20) + 2].translate(SHAPE), np.uint8).astype(np.uint32)
            if len(shape) > 2:
                codes = (shape[:-2] << 16 | shape[1:-1] << 8 | shape[2:]) * np.uint32(0x9E3779B1) >> np.uint32(21)
                out[i, :TERMS] += np.bincount(codes, minlength=TERMS)
        out[i, :TERMS] /= max(1.0, out[i, :TERMS].sum())
    words = [d.split() for d in raw]
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in itertools.chain.from_iterable(words)], np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    text = np.repeat(np.arange(len(texts)), sizes)
    for lag in range(1, LAGS + 1):
        same = (ids[lag:] == ids[:-lag]) & (text[lag:] == text[:-lag])
        out[:, TERMS + lag - 1] = np.bincount(text[lag:][same], minlength=len(texts)) / np.maximum(1, sizes)
    # Lower-cased as text: bytes.lower() knows ASCII alone.
    plain = [w.strip(MARKS).decode("utf-8", "surrogatepass").lower().encode("utf-8", "surrogatepass") for w in number]
    column = np.array([TERMS + LAGS + xxhash.xxh32_intdigest(w) % WORDS if w else -1 for w in plain], np.int64)[ids]
    word = column >= 0
    cells, times = np.unique(text[word] * out.shape[1] + column[word], return_counts=True)
    out.reshape(-1)[cells] = times
    out[:, TERMS + LAGS:] /= np.maximum(1, out[:, TERMS + LAGS:].sum(axis=1, keepdims=True))
    return out


def weighted(shares: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit vectors in which the shape and the words of a text weigh alike; shares is overwritten."""
    np.sqrt(shares, out=shares)
    shares *= idf
    for part in (shares[:, :TERMS + LAGS], shares[:, TERMS + LAGS:]):
        _to_unit(part)
    return _to_unit(shares)


def leading_axes(rows: np.ndarray) -> np.ndarray:
    """Right singular vectors of the AXES greatest singular values, by subspace iteration from a fixed start."""
    width = min(AXES + SPARE, *rows.shape)
    basis = np.random.default_rng(0).standard_normal((rows.shape[1], width)).astype(np.float32)
    for _ in range(ROUNDS):
        basis = np.linalg.qr(rows.T @ (rows @ np.linalg.qr(basis)[0]))[0]
    image = (rows @ basis).astype(np.float64)
    _, turn = np.linalg.eigh(image.T @ image)
    return basis @ turn[:, ::-1][:, :AXES].astype(np.float32)


class Space:
    """idf weights, axes, and the labelled vectors (unit length) with their labels."""

    def __init__(self, idf, axes, vectors, labels):
        self.idf, self.axes, self.vectors, self.labels = idf, axes, vectors, labels

    @classmethod
    def fit(cls, shares: np.ndarray, labels: np.ndarray, idf: np.ndarray | None = None) -> Space:
        """idf: over all documents, else over these."""
        if idf is None:
            idf = idf_of((shares > 0).sum(axis=0), len(shares))
        rows = weighted(shares, idf)
        axes = leading_axes(rows)
        return cls(idf, axes, _to_unit(rows @ axes), labels.astype(np.float32))

    def score(self, texts: list[str]) -> np.ndarray:
        if not len(self.labels):
            return np.zeros(len(texts))
        out = np.zeros(len(texts))
        near = min(NEIGHBOURS, len(self.labels))
        for begin in range(0, len(texts), BLOCK):
            vectors = _to_unit(weighted(term_shares(texts[begin:begin + BLOCK]), self.idf) @ self.axes)
            cosine = vectors @ self.vectors.T
            level = np.partition(cosine, -near, axis=1)[:, -near]
            weight = np.where(cosine > level[:, None], cosine, 0)
            tied = cosine == level[:, None]
            free = near - (cosine > level[:, None]).sum(axis=1)
            weight += np.where(tied & (np.cumsum(tied, axis=1) <= free[:, None]), cosine, 0)
            weight = np.maximum(weight, 0).astype(np.float64)
            total = weight.sum(axis=1)
            out[begin:begin + BLOCK] = np.divide(weight @ self.labels, total, out=np.zeros(len(total)), where=total > 0)
        return np.clip(out, 0, 1)


def _to_unit(rows: np.ndarray) -> np.ndarray:
    """Scales the rows in place; those without a feature stay 0."""
    norm = np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]
    return np.divide(rows, norm, out=rows, where=norm > 1e-12)


def idf_of(n_with: np.ndarray, n_texts: int) -> np.ndarray:
    return (np.log((1 + n_texts) / (1 + n_with)) + 1).astype(np.float32)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of all texts of a task: how many there are, and how many have each feature."""
    n_texts, n_with = 0, np.zeros(TERMS + LAGS + WORDS, np.int64)
    for batch in in_slices(batches):
        texts = [t or "" for t in batch.column("text").to_pylist()]
        for begin in range(0, len(texts), BLOCK):
            n_with += (term_shares(texts[begin:begin + BLOCK]) > 0).sum(axis=0)
        n_texts += len(texts)
    parts = [x.tobytes() for x in np.array_split(n_with, CHUNKS)]
    yield pa.RecordBatch.from_arrays(
        [pa.array(range(CHUNKS), pa.int32()), pa.array([n_texts] * CHUNKS, pa.int64()), pa.array(parts, pa.binary())],
        names=["chunk", "n_texts", "n_with"])


def _summed(parts):
    import pandas as pd

    total = sum(np.frombuffer(b, np.int64) for b in parts["n_with"])
    return pd.DataFrame({"chunk": parts["chunk"].iloc[:1], "n_texts": [parts["n_texts"].sum()], "n_with": [total.tobytes()]})


def document_idf(docs: DataFrame) -> np.ndarray:
    """The idf of every feature over all documents, a table of fixed size."""
    counted = docs.select("text").mapInArrow(_counts, "chunk int, n_texts bigint, n_with binary")
    rows = sorted(counted.groupBy("chunk").applyInPandas(_summed, counted.schema).collect())
    if not rows:
        return idf_of(np.zeros(TERMS + LAGS + WORDS), 0)
    return idf_of(np.concatenate([np.frombuffer(r.n_with, np.int64) for r in rows]), rows[0].n_texts)


def train(sample: DataFrame, idf: np.ndarray) -> Space:
    """The space of a bounded sample (at most MAX_TRAIN_ROWS rows); the shares are taken in tasks, the SVD here."""

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 1_000_000):
            found = term_shares(batch.column("text").to_pylist())
            cells = [np.flatnonzero(r).astype(np.uint16) for r in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array([c.tobytes() for c in cells], pa.binary()),
                 pa.array([r[c].tobytes() for r, c in zip(found, cells)], pa.binary())],
                names=["doc_id", "label", "cells", "shares"])

    rows = sorted(sample.select("doc_id", "label", "text").mapInArrow(
        shares, "doc_id bigint, label int, cells binary, shares binary").collect(), key=lambda r: r.doc_id)
    known = np.zeros((len(rows), TERMS + LAGS + WORDS), np.float32)
    for into, r in zip(known, rows):
        into[np.frombuffer(r.cells, np.uint16)] = np.frombuffer(r.shares, np.float32)
    return Space.fit(known, np.array([r.label for r in rows]) > 0, idf)


def score(docs: DataFrame, space: Space) -> DataFrame:
    """doc_id and score of every row; a narrow pass, the space goes along as one broadcast of about 2.8 MB."""
    shared = docs.sparkSession.sparkContext.broadcast((space.idf, space.axes, space.vectors, space.labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Space(*shared.value)
        for batch in in_slices(batches):
            values = known.score([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values)], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    sample = training_sample(docs, labels, "quality", FOLDS, HELD_OUT, MAX_TRAIN_ROWS)
    scored = score(docs, train(sample, document_idf(docs)))
    return scored.select(
        "doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
