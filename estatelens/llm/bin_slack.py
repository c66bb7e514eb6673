"""Packing of tokenised documents into sequences by minimum bin slack.

Only the counts of piece lengths (at most one number per length) decide the packing: per bin the longest piece left
is taken, a bitset subset-sum over the lengths left finds what fills the rest best, and that combination is removed,
as often as the counts allow. The documents are tokenised in tasks; pieces find their place through their rank among
pieces of equal length, which is added up from counts per block. No group of equal lengths meets in one task.

Defined results: a null text is an empty one, that is the end token alone; repeated rows are packed one by one; an
empty table gives no rows; other columns of the input, whatever their names, do not matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, stored
from .tokens import Encoder

ship(__name__)

CAPACITY = 2048
END_ID = 0
VOCABULARY = "byte_bpe_50k.tiktoken"  # the ids of byte_bpe_50k.json, as ranks
SLICE_CHARS = 4_000_000  # text that is held as strings and ids at once, unless one text is longer

PIECES = ("doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, block bigint, nth bigint, ids binary")
_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
    ("ids_crc32", pa.int64()), ("block", pa.int64()), ("nth", pa.int64()), ("ids", pa.binary())])


def cuts(n_ids: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; all but the first are full."""
    first = (n_ids - 1) % capacity + 1
    return [(0, first), *((at, capacity) for at in range(first, n_ids, capacity))]


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Spans of texts of the given sizes; a span ends with the text that fills it."""
    begin = size = 0
    for i, chars in enumerate(sizes.tolist()):
        size += chars
        if size >= SLICE_CHARS:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(sizes):
        yield begin, len(sizes)


def _to_pieces(capacity: int, vocabulary: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            sizes = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            for a, b in _slices(sizes):
                doc_ids, texts = (batch.column(i).slice(a, b - a).to_pylist() for i in (0, 1))
                rows = []
                met = np.zeros(capacity + 1, np.int64)
                for doc_id, text in zip(doc_ids, texts):
                    ids = encoder.encode(text or "", END_ID)
                    for piece, (start, length) in enumerate(cuts(len(ids), capacity)):
                        raw = ids[start:start + length].astype("<u4").tobytes()
                        rows.append((doc_id, piece, start, length, zlib.crc32(raw), block, int(met[length]),
                                     raw if with_ids else None))
                        met[length] += 1
                block += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t.type) for c, t in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)

    return run


def fullest(gap: int, counts: dict[int, int], lengths: list[int]) -> dict[int, int]:
    """The lengths (with multiplicity) whose sum is the largest that is at most gap; long ones are tried first."""
    mask, reach, steps = (1 << gap + 1) - 1, 1, []
    for length in lengths:
        if length > gap or not counts[length]:
            continue
        steps.append((length, reach))
        for _ in range(min(counts[length], gap // length)):
            wider = (reach | reach << length) & mask
            if wider == reach:
                break
            reach = wider
        if reach >> gap & 1:
            break
    left, used = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        while not before >> left & 1:
            used[length] = used.get(length, 0) + 1
            left -= length
    return used


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, last rank + 1, first sequence, pieces per sequence, offset) of each run of equal places.

    A combination is used until one of its lengths runs short, so there are at most capacity * (ln capacity + 2)
    combinations however many pieces there are.
    """
    counts = {k: v for k, v in histogram.items() if v}
    lengths = sorted(counts, reverse=True)
    taken = dict.fromkeys(counts, 0)
    places, sequence = [], 0
    for longest in lengths:
        while counts[longest]:
            counts[longest] -= 1
            combination = fullest(capacity - longest, counts, lengths)
            counts[longest] += 1
            combination[longest] = combination.get(longest, 0) + 1
            times = min(counts[k] // m for k, m in combination.items())
            offset = 0
            for length, m in combination.items():
                places.append((length, taken[length], taken[length] + m * times, sequence, m, offset))
                counts[length] -= m * times
                taken[length] += m * times
                offset += m * length
            sequence += times
    return places


_AT = ["block", "length", "nth"]  # names a piece


def _placed(places: list[tuple]):
    table = np.array(sorted(places), np.int64).reshape(-1, 6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = int(table[:, 2].max(initial=0)) + 1
        keys = table[:, 0] * base + table[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            _, first, _, sequence, many, offset = table[np.searchsorted(keys, length * base + rank, "right") - 1].T
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in _AT),
                 pa.array(sequence + (rank - first) // many), pa.array(offset + (rank - first) % many * length)],
                names=[*_AT, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, ids (32-bit little endian), sequence_id, offset.

    Places are found for the names of pieces alone; the ids join them in the JVM and pass no Python worker again.
    """
    pieces = stored(docs.select("doc_id", "text").mapInArrow(_to_pieces(capacity, vocabulary, with_ids), PIECES))
    per_block = pieces.groupBy("block", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_block.select("block", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # <= capacity rows
    ranked = pieces.select(_AT).join(starts, ["block", "length"]).withColumn("rank", F.col("before") + F.col("nth"))
    placed = ranked.select(*_AT, "rank").mapInArrow(
        _placed(plan(histogram, capacity)), "block bigint, length bigint, nth bigint, sequence_id bigint, offset bigint")
    return pieces.join(placed, _AT).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset")
