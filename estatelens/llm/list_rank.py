"""List ranking on Spark: sums from every element of a linked list to its end.

An element is known by two columns, points to the next one by two more, and carries weights. One element in RULERS is a
ruler, by a hash of its name; every other element halves its way to the ruler ahead of it (its pointer becomes its
pointer's pointer), which takes a few rounds, since a stretch without a ruler is short. Only the rulers go on to the
next level, as a list a sixteenth as long, until it has at most SMALL elements, a constant; that list is walked in one
task. On the way back every element adds its ruler's sum. Every round is written to the shared folder, so no plan grows
and a lost executor costs one round.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, stored

ship(__name__)

RULERS = 16
SMALL = 4096


def _is_ruler(level: int, a: Column, b: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(level), a, b), F.lit(RULERS)) == 0


def _to_rulers(arcs: DataFrame, level: int, weights: list[str]) -> DataFrame:
    """Every element with the ruler ahead of it (NULL at the end of the list) and the sums up to that ruler."""
    state = stored(arcs.withColumn("done", F.col("next_a").isNull() | _is_ruler(level, F.col("next_a"), F.col("next_b"))))
    while not state.where(~F.col("done")).isEmpty():
        ahead = state.select(
            F.col("a").alias("next_a"), F.col("b").alias("next_b"), F.col("next_a").alias("far_a"), F.col("next_b").alias("far_b"),
            F.col("done").alias("far_done"), *[F.col(w).alias(f"far_{w}") for w in weights])
        jumped = state.where(~F.col("done")).join(ahead, ["next_a", "next_b"]).select(
            "a", "b", F.col("far_a").alias("next_a"), F.col("far_b").alias("next_b"),
            *[(F.col(w) + F.col(f"far_{w}")).alias(w) for w in weights], F.col("far_done").alias("done"))
        state = stored(state.where("done").unionByName(jumped))
    return state.drop("done")


def _walked(arcs: DataFrame, weights: list[str], small: int) -> DataFrame:
    """The sums of a list of at most `small` elements, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in batch.to_pylist()]
        if len(rows) > small:
            raise ValueError("the list is longer than one task may take")
        before = {(r["next_a"], r["next_b"]): r for r in rows}
        sums, at = [], before.get((None, None))
        total = dict.fromkeys(weights, 0)
        while at is not None:
            total = {w: total[w] + at[w] for w in weights}
            sums.append({"a": at["a"], "b": at["b"], **total})
            at = before.get((at["a"], at["b"]))
        if sums:
            yield pa.RecordBatch.from_pylist(sums, schema=pa.schema(
                [("a", pa.int64()), ("b", pa.int64()), *((w, pa.int64()) for w in weights)]))

    return arcs.repartition(1).mapInArrow(run, ", ".join(f"{c} bigint" for c in ("a", "b", *weights)))


def sums_to_end(arcs: DataFrame, weights: list[str], small: int = SMALL) -> DataFrame:
    """a, b and the sum of each weight from the element (itself included) to the end of the list.

    `arcs` has a, b, next_a, next_b (both NULL for the last element) and the weights, all bigint; it is one list.
    """
    levels, rest = [], stored(arcs.select("a", "b", "next_a", "next_b", *weights))
    while not rest.limit(small + 1).count() <= small:
        level = len(levels)
        state = _to_rulers(rest, level, weights)
        levels.append(state)
        rest = state.where(_is_ruler(level, F.col("a"), F.col("b")))
    ranked = stored(_walked(rest, weights, small))
    for state in reversed(levels):
        of_ruler = ranked.select(
            F.col("a").alias("next_a"), F.col("b").alias("next_b"), *[F.col(w).alias(f"far_{w}") for w in weights])
        ranked = stored(state.join(of_ruler, ["next_a", "next_b"], "left").select(
            "a", "b", *[(F.col(w) + F.coalesce(f"far_{w}", F.lit(0))).alias(w) for w in weights]))
    return ranked
