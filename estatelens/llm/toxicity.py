"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the hashed character n-grams that a lower-cased text contains (presence, not counts). Their document
counts per class give log-count ratios; the features that separate the classes best enter a logistic regression in
which each is scaled by its ratio. Scoring reads every character of every text; the model is a table of fixed size.

Defined results: a null text is an empty one and is scored by the intercept; labels are learnt from a bounded sample
(MAX_TRAIN_ROWS); without labels of both classes every score is the share of label 1, or 0 without any label;
repeated rows get equal scores; an empty table gives no rows; extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship
from .labelled import fold, training_sample

ship(__name__)

ORDERS = (5, 6, 7)
BUCKET_BITS = 20
FEATURES = 2048  # of the buckets, those that enter the regression
MAX_TRAIN_ROWS = 20_000
FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
CHUNKS = 16
WINDOW = 1 << 21  # bytes hashed at once


def texts_to_bytes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All lower-cased texts as one byte array, each between two spaces; first and last position of each."""
    raw = [b" " + t.lower().encode("utf-8", "surrogatepass") + b" " for t in texts]
    ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
    return np.frombuffer(b"".join(raw), np.uint8), np.append(0, ends[:-1]), ends


def occurrences(data: np.ndarray, ends: np.ndarray, wanted: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, bucket or wanted[bucket]) of the n-grams, per window; where wanted is given, of the non-zero ones."""
    longest = max(ORDERS)
    for begin in range(0, len(data), WINDOW):
        part = data[begin:begin + WINDOW + longest - 1].astype(np.uint64)
        state = part.copy()
        for n in range(2, longest + 1):
            size = len(part) - n + 1
            if size <= 0:
                break
            state = state[:size] * np.uint64(0x100000001B3) + part[n - 1:]
            if n not in ORDERS:
                continue
            count = min(size, WINDOW)
            codes = ((state[:count] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BUCKET_BITS))
            codes = codes.astype(np.int32)
            if wanted is None:
                at = np.arange(count)
            else:
                codes = wanted[codes]
                at = np.flatnonzero(codes)
                codes = codes[at]
            text = np.searchsorted(ends, at + begin, "right")
            inside = at + begin + n <= ends[text]  # an n-gram belongs to one text alone
            yield text[inside], codes[inside]


def present(texts: list[str], wanted: np.ndarray | None, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, feature) pairs, sorted."""
    data, _, ends = texts_to_bytes(texts)
    keys = [distinct(text * width + code) for text, code in occurrences(data, ends, wanted)]
    keys = distinct(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    return keys // width, keys % width


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values; plain sorting is many times as fast as hashing them."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])[:len(values)]]


def in_slices(batches: Iterator[pa.RecordBatch], chars: int = 4_000_000, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches cut so that a part holds about `chars` of the column, or one longer text."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < batch.num_rows:
            base = sizes[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(sizes, base + chars, "right")))
            yield batch.slice(begin, end - begin)
            begin = end


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, 1 << BUCKET_BITS), np.int64)
    rows = np.zeros(2, np.int64)
    for batch in in_slices(batches, 1_000_000):
        label = (batch.column("label").to_numpy() > 0).astype(np.int64)
        text, bucket = present(batch.column("text").to_pylist(), None, 1 << BUCKET_BITS)
        for side in (0, 1):
            counts[side] += np.bincount(bucket[label[text] == side], minlength=1 << BUCKET_BITS)
        rows += np.bincount(label, minlength=2)
    blobs = [c.astype(np.int32).tobytes() for c in np.split(counts, CHUNKS, axis=1)]
    yield pa.RecordBatch.from_arrays(
        [pa.array(range(CHUNKS), pa.int32()), pa.array(blobs, pa.binary()), pa.array([rows.tolist()] * CHUNKS, pa.list_(pa.int64()))],
        names=["chunk", "counts", "rows"])


def _summed(parts):
    import pandas as pd

    total = sum(np.frombuffer(b, np.int32).astype(np.int64) for b in parts["counts"])
    rows = np.sum(np.stack(parts["rows"].to_list()), axis=0)
    return pd.DataFrame({"chunk": parts["chunk"].iloc[:1], "counts": [total.tobytes()], "rows": [rows.tolist()]})


def fit_logistic(first: np.ndarray, feature: np.ndarray, scale: np.ndarray, label: np.ndarray,
                 penalty: float = 1e-5, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights (scaled back to presence) and intercept by accelerated gradient descent; classes weigh alike.

    first: of each row the first of its entries in `feature`, and at the end the number of entries.
    """
    n, width = len(label), len(scale)
    weight = np.where(label > 0, 0.5 / max(1, (label > 0).sum()), 0.5 / max(1, (label == 0).sum()))
    row = np.repeat(np.arange(n), np.diff(first))
    values = scale[feature]
    norms = np.bincount(row, values * values, n)
    rate = 4 / (np.average(norms, weights=weight) + 1)  # an estimate of the curvature; steps are halved if too long
    w, b = np.zeros(width), 0.0

    def loss_of(w, b):
        margin = np.bincount(row, values * w[feature], n) + b
        sign = np.where(label > 0, 1.0, -1.0)
        return margin, float((weight * np.logaddexp(0, -sign * margin)).sum() + penalty / 2 * (w @ w))

    ahead, ahead_b, last_loss = w, b, np.inf
    for step in range(steps):
        margin, loss = loss_of(ahead, ahead_b)
        if loss > last_loss + 1e-12:
            rate, ahead, ahead_b, last_loss = rate / 2, w, b, np.inf
            continue
        last_loss = loss
        residual = weight * (1 / (1 + np.exp(-np.clip(margin, -60, 60))) - (label > 0))
        gradient = np.bincount(feature, residual[row] * values, width) + penalty * ahead
        new, new_b = ahead - rate * gradient, ahead_b - rate * residual.sum()
        push = step / (step + 3)
        ahead, ahead_b, w, b = new + push * (new - w), new_b + push * (new_b - b), new, new_b
    return w * scale, b


class Model:
    """wanted: number (from 1) of the feature in a bucket, or 0; weights by that number."""

    def __init__(self, wanted: np.ndarray, weights: np.ndarray, intercept: float):
        self.wanted, self.weights, self.intercept = wanted, weights, intercept

    def score(self, texts: list[str]) -> np.ndarray:
        text, feature = present(texts, self.wanted, len(self.weights))
        return 1 / (1 + np.exp(-np.clip(np.bincount(text, self.weights[feature], len(texts)) + self.intercept, -60, 60)))


def _features_of(wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            text, feature = present(batch.column("text").to_pylist(), wanted, FEATURES + 1)
            cut = np.searchsorted(text, np.arange(batch.num_rows + 1))
            found = [feature[a:b].astype(np.uint16).tobytes() for a, b in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(found, pa.binary())], names=["label", "features"])

    return run


def train(sample: DataFrame) -> Model:
    """sample: text, label; a bounded number of rows."""
    counted = sample.select("text", "label").mapInArrow(_class_counts, "chunk int, counts binary, rows array<bigint>")
    chunks = sorted(counted.groupBy("chunk").applyInPandas(_summed, counted.schema).collect())  # a table of fixed size
    wanted = np.zeros(1 << BUCKET_BITS, np.uint16)
    rows = np.array(chunks[0].rows) if chunks else np.zeros(2)
    if not rows.all():
        share = rows[1] / rows.sum() if rows.sum() else 0.0
        return Model(wanted, np.zeros(1), 60.0 if share == 1 else -60.0)
    counts = np.concatenate([np.frombuffer(c.counts, np.int64).reshape(2, -1) for c in chunks], axis=1)
    share = (counts + 1.0) / (rows[:, None] + 2.0)
    ratio = np.log(share[1] / share[0])
    gain = np.abs(share[1] - share[0]) * np.abs(ratio)
    best = np.sort(np.argsort(-gain, kind="stable")[:FEATURES])
    wanted[best] = np.arange(1, len(best) + 1)
    scale = np.append(0.0, ratio[best])
    known = sample.select("text", "label").mapInArrow(_features_of(wanted), "label int, features binary").collect()
    feature = [np.frombuffer(r.features, np.uint16) for r in known]
    first = np.append(0, np.cumsum([len(x) for x in feature]))
    weights, intercept = fit_logistic(
        first, np.concatenate(feature).astype(np.int64), scale, np.array([r.label for r in known]))
    return Model(wanted, weights, intercept)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row; a narrow pass, the model goes along as one broadcast of about 2 MB."""
    shared = docs.sparkSession.sparkContext.broadcast((model.wanted, model.weights, model.intercept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model(*shared.value)
        for batch in in_slices(batches):
            values = known.score([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values)], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    sample = training_sample(docs, labels, "toxic", FOLDS, HELD_OUT, MAX_TRAIN_ROWS)
    scored = score(docs, train(sample))
    return scored.select(
        "doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
