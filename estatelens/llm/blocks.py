"""Documents as written blocks, and questions from blocks to shards of a key space.

A block row holds the words of some documents, compressed; it is written once, so that later passes meet the same
blocks however often tasks are repeated. A block asks shards (ranges of 64-bit hashes) about its distinct keys in one
packed row per shard, and gets one packed row back; no row per key is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions_for, ship
from .toxicity import in_slices

ship(__name__)

DOC_END = b"\x01"
BLOCK_CHARS = 4_000_000
BLOCKS_PER_SHARD = 8  # blocks whose distinct keys make up a shard, at most
TEXT_LEVEL = 4  # blocks are written once, and shuffled once more


def pack(data: bytes, level: int = 1) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=level).compress(data)


def unpack(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def to_blocks(docs: DataFrame, carry: str, carry_type: str, table: bytes) -> DataFrame:
    """Rows (block, n_docs, carry, words): the column `carry` of the block's documents, and their words as bytes.

    `table` maps bytes: what separates words becomes a space, what is folded becomes its lower case.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in in_slices(batches, BLOCK_CHARS):
            texts = ((t or "").encode("utf-8", "surrogatepass").translate(table) for t in batch.column("text").to_pylist())
            words = b" ".join(t + b" " + DOC_END for t in texts)
            carried = batch.column(carry)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.array([batch.num_rows], pa.int64()),
                 pa.ListArray.from_arrays(pa.array([0, len(carried)], pa.int32()), carried), pa.array([pack(words, TEXT_LEVEL)], pa.binary())],
                names=["block", "n_docs", "carry", "words"])
            block += 1

    return docs.select(carry, F.col("text")).mapInArrow(
        run, f"block bigint, n_docs bigint, carry array<{carry_type}>, words binary")


def text_blocks(docs: DataFrame, carry: str, carry_type: str, table: bytes | None = None, chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows (block, carry, sizes, data): the column `carry` of the block's documents, and their texts as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in in_slices(batches, chars):
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
            data = b"".join(texts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()),
                 pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), batch.column(carry)),
                 pa.array([list(map(len, texts))], pa.list_(pa.int64())),
                 pa.array([pack(data.translate(table) if table else data, TEXT_LEVEL)], pa.binary())],
                names=["block", "carry", "sizes", "data"])
            block += 1

    return docs.select(carry, F.col("text")).mapInArrow(
        run, f"block bigint, carry array<{carry_type}>, sizes array<bigint>, data binary")


def texts_of(row) -> tuple[list, list[bytes]]:
    """What a block carries, and the texts, in order."""
    data, sizes = unpack(row["data"].as_py()), row["sizes"].as_py()
    ends = np.cumsum(sizes).tolist()
    return row["carry"].as_py(), [data[e - n:e] for e, n in zip(ends, sizes)]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of a block in order, the ends of documents left out, and words per document."""
    words = data.split()
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    of = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in number), np.uint64, len(number))
    ends = np.flatnonzero(ids == number.get(DOC_END, -1))
    sizes = np.diff(ends, prepend=-1) - 1
    return of[np.delete(ids, ends)], sizes


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ x >> np.uint64(31)
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ x >> np.uint64(29)
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


def shard_bounds(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's keys begin in sorted keys; shards are equal ranges of the 64-bit space."""
    edges = np.array([(i << 64) // shards for i in range(1, shards)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def shards_for(blocks: DataFrame) -> int:
    """Shards that written blocks ask: as many as shuffle partitions, or as the blocks call for."""
    return max(partitions_for(blocks.sparkSession), -(-blocks.count() // BLOCKS_PER_SHARD))


def ask_shards(blocks: DataFrame, question: Callable, answer: Callable) -> DataFrame:
    """Rows (block, replies): replies is an array of (shard, reply) of the answers to a block's questions.

    question(row, shards) gives (shard, bytes) pairs; answer(list of such bytes of one shard) gives as many byte
    strings. A shard is a part of the hash space; there are as many as the session has shuffle partitions, and more
    where the (written) blocks are many, so that a shard holds what some BLOCKS_PER_SHARD blocks ask, however large the
    input is and whatever that setting says.
    """
    spark, shards = blocks.sparkSession, shards_for(blocks)

    def questions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                packed = question(row, shards)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["block"].as_py()] * len(packed), pa.int64()), pa.array([p[0] for p in packed], pa.int32()),
                     pa.array([p[1] for p in packed], pa.binary())], names=["block", "shard", "question"])

    def answers(part):
        part = part.sort_values("block")
        return part.assign(question=answer(part["question"].to_list())).rename(columns={"question": "reply"})

    asked = blocks.mapInArrow(questions, "block bigint, shard int, question binary")
    if shards > partitions_for(spark):
        asked = asked.repartition(shards, "shard")
    replies = asked.groupBy("shard").applyInPandas(answers, "block bigint, shard int, reply binary")
    return replies.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("shard", "reply"))).alias("replies"))


def planes(values: np.ndarray, width: int) -> bytes:
    """The low bytes of unsigned numbers, one plane after the other; each as it is or compressed, whatever is shorter."""
    out = []
    for plane in np.ascontiguousarray(values.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :width].T):
        raw, small = plane.tobytes(), pack(plane.tobytes())
        kept = min(raw, small, key=len)
        out.append(len(kept).to_bytes(8, "little") + kept)
    return b"".join(out)


def from_planes(data: bytes, n: int, width: int) -> tuple[np.ndarray, int]:
    """The numbers, and where the planes end."""
    out, at = np.zeros((n, 8), np.uint8), 0
    for i in range(width):
        size = int.from_bytes(data[at:at + 8], "little")
        plane = data[at + 8:at + 8 + size]
        out[:, i] = np.frombuffer(plane if size == n else unpack(plane), np.uint8, n)
        at += 8 + size
    return out.view(np.uint64).ravel(), at


def packed_keys(keys: np.ndarray, beside: bytes) -> bytes:
    """Ascending keys, by the steps between them, and other bytes, compressed."""
    steps = np.diff(keys, prepend=keys[:1])
    width = max(1, (int(steps.max(initial=0)).bit_length() + 7) // 8)
    small = pack(beside)
    head = np.array([len(keys), int(keys[0]) if len(keys) else 0, width, len(small)], np.uint64).tobytes()
    return b"".join([head, small, planes(steps, width)])


def unpacked_keys(question: bytes) -> tuple[np.ndarray, bytes, int]:
    """The keys, the bytes beside them, and where the question goes on."""
    n, first, width, size = np.frombuffer(question, np.uint64, 4).tolist()
    steps, end = from_planes(question[32 + size:], n, width)
    return np.cumsum(steps, dtype=np.uint64) + np.uint64(first), unpack(question[32:32 + size]), 32 + size + end


def ask(blocks: DataFrame, question: Callable, answer: Callable) -> DataFrame:
    """ask_shards for plain keys: question(row) gives (keys ascending, list of arrays beside them)."""

    def by_shard(row, shards: int) -> list[tuple[int, bytes]]:
        keys, beside = question(row)
        cut = shard_bounds(keys, shards).tolist()
        return [(s, packed_keys(keys[a:b], b"".join(x[a:b].tobytes() for x in beside)))
                for s, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]

    return ask_shards(blocks, by_shard, answer)


def unpacked(question: bytes, *types) -> list[np.ndarray]:
    """The keys and the arrays beside them."""
    keys, beside, _ = unpacked_keys(question)
    out, at = [keys], 0
    for t in types:
        out.append(np.frombuffer(beside, t, len(keys), at))
        at += out[-1].nbytes
    return out
