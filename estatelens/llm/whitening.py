"""Embedding whitening with Spark MLlib's BlockMatrix.

Entries become integers, x = floor(256 * entry), so counts, sums and deviations are exact. The fit list holds every
distinct x once. Its centred rows are indexed into blocks of BLOCK rows (the last block of a task is filled with rows of
zeros, which add nothing), the transposed matrix times the matrix gives the scatter, whose eigenvectors are found in the
driver (dimensions squared, whatever the number of rows), and the matrix of all rows times the whitening matrix projects
them.

The product that gives the scatter has one block as its result, so its middle dimension is split: every group of
GROUP blocks is multiplied in a task of its own, and only products are added up. Blocks are written once, packed, to the
shared folder; every pass and every repeated task reads the same ones. No row meets a row of the same value but in the
distinct step, which drops copies before the shuffle.

Defined results: rows whose vector is null, empty or holds null or non-finite entries are dropped; so are vectors of
another length than the most frequent one (the greater of equally frequent ones), which have no place in one covariance.
Integers beyond 64 bits stop at the ends of that range. A deviation beyond 64 bits is null. A component without variance
(eigenvalue at rounding level) is whitened to 0 and not part of the identity error. Repeated rows are rows of their own;
a null vec_id is kept. No row left: an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import pack, unpack
from .common import ship, stored

ship(__name__)

BLOCK = 1024  # rows of a block
GROUP = 16  # blocks that one task multiplies for the scatter
TASK_BYTES = 32_000_000  # doubles of a task's blocks in the projection
SCALE = 256
_LOW = np.int64(0xFFFFFFFF)


@dataclass(frozen=True)
class Fit:
    """What the fit list says: rows, sums per dimension, components, and how well they whiten."""

    n: int
    sums: list[int]
    matrix: np.ndarray  # dimensions x components
    explained: list[float]
    identity_error: float


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id and x of the rows that have a whole vector of the most frequent length."""
    known = F.forall("embedding", lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) != float("inf")), F.lit(False)))
    whole = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(
        (F.size("embedding") > 0) & known)
    length = whole.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    x = F.transform("embedding", lambda e: F.floor(e * SCALE))
    return whole.where(F.size("embedding") == (length[0]["size"] if length else 0)).select("vec_id", x.alias("x"))


def _blocks(rows: DataFrame, carried: str | None = None) -> DataFrame:
    """Rows (part, number, n, x, high, low): packed blocks of up to BLOCK vectors, with sums of both halves of the numbers.

    With a column to carry, its values come along, and ids are a list in the order of the rows.
    """

    def block(part: int, number: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        x = np.concatenate([b.column("x").flatten().to_numpy() for b in held]).reshape(sum(b.num_rows for b in held), -1)
        out = {
            "part": pa.array([part], pa.int64()), "number": pa.array([number], pa.int64()), "n": pa.array([len(x)], pa.int64()),
            "x": pa.array([pack(np.ascontiguousarray(x.T).tobytes())], pa.binary()),
            "high": pa.array([(x >> 32).sum(0)], pa.list_(pa.int64())), "low": pa.array([(x & _LOW).sum(0)], pa.list_(pa.int64()))}
        if carried:
            ids = pa.concat_arrays([b.column(carried) for b in held])
            out["ids"] = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        return pa.RecordBatch.from_pydict(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                piece = batch.slice(at, BLOCK - size)
                held.append(piece)
                at, size = at + piece.num_rows, size + piece.num_rows
                if size == BLOCK:
                    yield block(part, number, held)
                    number, held, size = number + 1, [], 0
        if held:
            yield block(part, number, held)

    ids = f", ids array<{rows.schema[carried].dataType.simpleString()}>" if carried else ""
    return rows.mapInArrow(run, f"part bigint, number bigint, n bigint, x binary, high array<bigint>, low array<bigint>{ids}")


def _numbered(blocks: DataFrame) -> tuple[DataFrame, int]:
    """Blocks with a gapless `block` from 0, and how many there are; the driver sees one count per task that wrote some."""
    counts = sorted((r["part"], r["count"]) for r in blocks.groupBy("part").count().collect())
    starts, total = [], 0
    for part, n in counts:
        starts.append((part, total))
        total += n
    offsets = blocks.sparkSession.createDataFrame(starts or [(-1, 0)], "part bigint, start bigint")
    return blocks.join(F.broadcast(offsets), "part").withColumn("block", F.col("start") + F.col("number")), total


def exact_centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums per row, as 64-bit integers where they fit for sure, else as Python's."""
    reach = n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + max((abs(s) for s in sums), default=0)
    if reach < 1 << 62:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The sum of squares of n * x - sums, exact; None beyond 64 bits."""
    far = exact_centred(x, n, sums)
    if far.dtype != object:
        reach = int(np.abs(far).max(initial=0))
        if reach * reach * far.shape[1] < 1 << 63:
            return (far * far).sum(1).tolist()
        far = far.astype(object)
    return [d if d < 1 << 63 else None for d in (far * far).sum(1).tolist()]


def _matrix(blocks: DataFrame, total: int, n: int, sums: list[int]) -> BlockMatrix:
    """The centred rows of numbered blocks as a BlockMatrix of one column of blocks."""
    size = len(sums)
    wide = max(1, -(-total * BLOCK * size * 8 // TASK_BYTES))
    rows = blocks.select("block", "n", "x")
    if rows.rdd.getNumPartitions() < wide:
        rows = rows.repartition(wide, "block")

    def centred(row):
        x = np.frombuffer(unpack(row["x"]), np.int64).reshape(size, row["n"]).T
        values = np.zeros((BLOCK, size))
        values[:row["n"]] = exact_centred(x, n, sums).astype(np.float64) / n
        return (row["block"], 0), DenseMatrix(BLOCK, size, values.ravel("F"))

    return BlockMatrix(rows.rdd.map(centred), BLOCK, size, total * BLOCK, size)


def _scatter(matrix: BlockMatrix, total: int) -> np.ndarray:
    """The transposed matrix times the matrix, its middle dimension split, as a local matrix."""
    left, right = matrix.transpose(), matrix
    product = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, -(-total // GROUP))
    out = BlockMatrix(product, left.rowsPerBlock, right.colsPerBlock).toLocalMatrix().toArray()
    return (out + out.T) / 2


def _projected(matrix: BlockMatrix, whitening: np.ndarray) -> BlockMatrix:
    size, k = whitening.shape
    local = matrix._java_matrix_wrapper._sc.parallelize([((0, 0), DenseMatrix(size, k, whitening.ravel("F")))], 1)
    return matrix.multiply(BlockMatrix(local, size, k, size, k))


def whitening_matrix(covariance: np.ndarray, components: int) -> tuple[np.ndarray, list[float], np.ndarray]:
    """Unit eigenvectors over the root of their eigenvalue, by falling eigenvalue; shares of the trace; which have variance."""
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components].clip(0), vectors[:, ::-1][:, :components]
    live = values > len(covariance) * np.finfo(float).eps * values.max(initial=0)
    scaled = np.where(live, vectors / np.sqrt(np.where(live, values, 1)), 0)
    trace = np.trace(covariance)
    return scaled, [float(v / trace) if trace > 0 else 0.0 for v in values], live


def fit(vectors: DataFrame, components: int) -> Fit | None:
    """Components of the distinct vectors; None if there are none."""
    blocks, total = _numbered(stored(_blocks(vectors.select("x").distinct())))
    if not total:
        return None
    wide = "decimal(38,0)"
    halves = blocks.select("n", F.posexplode(F.arrays_zip("high", "low")).alias("dimension", "s")).groupBy("dimension").agg(
        F.sum("n").alias("n"), F.sum(F.col("s.high").cast(wide)).alias("high"), F.sum(F.col("s.low").cast(wide)).alias("low"))
    rows = sorted(halves.collect(), key=lambda r: r["dimension"])
    n, sums = rows[0]["n"], [(int(r["high"]) << 32) + int(r["low"]) for r in rows]
    matrix = _matrix(blocks, total, n, sums)
    scaled, explained, live = whitening_matrix(_scatter(matrix, total) / n, components)
    again = _scatter(_projected(matrix, scaled), total) / n
    off = np.abs(again - np.eye(len(live)))[np.ix_(live, live)]
    return Fit(n, sums, scaled, explained, float(off.max(initial=0)))


def whiten(embeddings: DataFrame, components: int = 4) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per vector and component."""
    vectors = integer_vectors(embeddings)
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    schema = (f"vec_id {id_type}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    found = fit(vectors, components)
    if found is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    blocks, total = _numbered(stored(_blocks(vectors, "vec_id")))
    projected = _projected(_matrix(blocks, total, found.n, found.sums), found.matrix)
    k = found.matrix.shape[1]
    whitened = embeddings.sparkSession.createDataFrame(
        projected.blocks.map(lambda b: (int(b[0][0]), b[1].toArray().tobytes())), "block bigint, y binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            for i, (n, x, y) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("n", "x", "y")))):
                far = deviations(np.frombuffer(unpack(x), np.int64).reshape(-1, n).T, found.n, found.sums)
                values = np.frombuffer(y, np.float64).reshape(BLOCK, k)[:n]
                rows = np.repeat(np.arange(n), k)
                yield pa.RecordBatch.from_arrays(
                    [ids[i].values.take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                     pa.array(np.full(n * k, found.n)), pa.array(far, pa.int64()).take(pa.array(rows)), pa.array(values.ravel()),
                     pa.array(np.tile(found.explained, n)), pa.array(np.full(n * k, found.identity_error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return blocks.select("block", "n", "x", "ids").join(whitened, "block").mapInArrow(run, schema)
