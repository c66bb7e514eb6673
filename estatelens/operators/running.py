"""Running sums over long histories without one task per key.

A plain window brings all rows of a key to one task. Before the window is laid, a bounded sample of the rows (those of
the smallest hashes, so the same ones each time) shows which keys are long. The order of a long key is cut into ranges
at sampled rows; rows are placed by (key, range), each range is summed where it lies, and the totals of earlier ranges
give it its starting value. The ranges follow the whole order, so neither a busy month nor many rows of one instant are
left in one task. Keys shorter than a range stay whole, and where no key is long the plan is one plain window.
"""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import leading

SAMPLE_ROWS = 4096  # bounds the cuts, and so the totals that are sent to all tasks
RANGE_ROWS = 100_000  # rows of a key that one task may take


def same_keys(keys: list[str]) -> Column:
    """``k`` equals ``_at_k`` for all keys; NULL is a key like any other."""
    return reduce(operator.and_, [F.col(k).eqNullSafe(F.col(f"_at_{k}")) for k in keys])


def _renamed(keys: list[str]) -> list[Column]:
    return [F.col(k).alias(f"_at_{k}") for k in keys]


def cut_points(df: DataFrame, keys: list[str], order: list[str], range_rows: int = RANGE_ROWS):
    """A table of (key, place in the order) at which long keys are cut, or None if no key is long.

    Runs one job over the key and order columns; SAMPLE_ROWS rows at most come back.
    """
    row = F.xxhash64(*keys, *order)
    sample = df.select(*keys, *order, row.alias("_row")).orderBy("_row").limit(SAMPLE_ROWS).toArrow()
    if sample.num_rows == 0:
        return None
    last = sample.column("_row")[-1].as_py() + (1 << 63) + 1
    total = sample.num_rows if sample.num_rows < SAMPLE_ROWS else sample.num_rows * (1 << 64) / last
    stride = max(1, -(-range_rows * sample.num_rows // int(total)))
    sample = sample.drop_columns("_row").sort_by([(c, "ascending") for c in (*keys, *order)])
    seen: dict[tuple, int] = {}
    chosen = []
    for i, key in enumerate(zip(*(sample.column(k).to_pylist() for k in keys))):
        seen[key] = seen.get(key, 0) + 1
        if seen[key] % stride == 0:
            chosen.append(i)
    if not chosen:
        return None
    types = [F.col(f.name).cast(f.dataType).alias(f.name) for f in df.select(*keys, *order).schema]
    return df.sparkSession.createDataFrame(sample.take(chosen)).select(*types)


def in_ranges(df: DataFrame, keys: list[str], order: list[str], range_rows: int = RANGE_ROWS) -> tuple[DataFrame, bool]:
    """The rows with ``_range``, the number of their range (NULL for keys that stay whole), and whether any key is cut."""
    points = cut_points(df, keys, order, range_rows)
    if points is None:
        return df.withColumn("_range", F.lit(None).cast("int")), False
    cuts = points.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order))).alias("_cuts")).select(
        *_renamed(keys), "_cuts")
    here = ", ".join(f"`{c}`" for c in order)
    before = leading("_cuts", lambda cut: f"{cut} <= struct({here})", SAMPLE_ROWS.bit_length())
    number = F.when(F.col("_cuts").isNotNull(), F.expr(before))
    placed = df.join(F.broadcast(cuts), same_keys(keys), "left").withColumn("_range", number)
    return placed.drop("_cuts", *[f"_at_{k}" for k in keys]), True


def with_earlier(rows: DataFrame, keys: list[str], totals: dict[str, Column], over: dict[str, Column], bounded: bool = True) -> DataFrame:
    """Rows with columns made of the totals of their key's ranges; NULL for keys that stay whole.

    ``totals`` are aggregates of one range, ``over`` window expressions over a key's ranges (``earlier()``, ``upto()``,
    ``whole()`` give the windows). The ranges number 2 * SAMPLE_ROWS at most; with keys besides the cut ones (not
    ``bounded``) they may be more, and nothing is broadcast on request.
    """
    placed = [*keys, "_range"]
    per_range = rows.filter(F.col("_range").isNotNull()).groupBy(*placed).agg(*[v.alias(k) for k, v in totals.items()])
    starts = per_range.select(*_renamed(placed), *[v.alias(k) for k, v in over.items()])
    return rows.join(F.broadcast(starts) if bounded else starts, same_keys(placed), "left").drop(*[f"_at_{k}" for k in placed])


def whole(keys: list[str]):
    return Window.partitionBy(*keys)


def earlier(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)


def upto(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def within(keys: list[str], order: list[str], cut: bool):
    """The rows of a key (of a range, if cut) up to the current one."""
    placed = [*keys, "_range"] if cut else keys
    return Window.partitionBy(*placed).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def sums_in_ranges(
    rows: DataFrame, cut: bool, keys: list[str], order: list[str], sums: dict[str, Column], total=F.sum, plus=operator.add
) -> DataFrame:
    """Running sums over rows that ``in_ranges`` has placed.

    ``total`` and ``plus`` may be another aggregate and how two of its results become one, with 0 as the neutral value.
    """
    frame = within(keys, order, cut)
    if not cut:
        return rows.withColumns({out: total(v).over(frame) for out, v in sums.items()})
    valued = rows.withColumns({f"_v_{out}": v for out, v in sums.items()})
    totals = {f"_t_{out}": total(f"_v_{out}") for out in sums}
    starts = {f"_s_{out}": total(f"_t_{out}").over(earlier(keys)) for out in sums}
    summed = with_earlier(valued, keys, totals, starts).withColumns({
        out: plus(total(f"_v_{out}").over(frame), F.coalesce(F.col(f"_s_{out}"), F.lit(0))) for out in sums})
    return summed.drop(*[f"{p}{out}" for p in ("_v_", "_s_") for out in sums])


def carried(
    rows: DataFrame, cut: bool, keys: list[str], order: list[str], values: dict[str, Column], back: bool = False, strict: bool = False
) -> DataFrame:
    """The last non-NULL value up to each row, over rows that ``in_ranges`` has placed; ``back``: the next one from it on.

    ``strict`` leaves the row itself out. An as-of join is this over the union of both sides: time follows the rows,
    however many of one side meet how many of the other.
    """
    places = [F.col(c).desc_nulls_last() if back else F.col(c).asc_nulls_first() for c in order]
    frame = Window.partitionBy(*keys, *(["_range"] if cut else [])).orderBy(*places).rowsBetween(
        Window.unboundedPreceding, -1 if strict else Window.currentRow)
    inside = {out: F.last(v, ignorenulls=True).over(frame) for out, v in values.items()}
    if not cut:
        return rows.withColumns(inside)
    pick = F.min_by if back else F.max_by
    totals = {f"_t_{out}": pick(v, F.when(v.isNotNull(), F.struct(*order))) for out, v in values.items()}
    before = Window.partitionBy(*keys).orderBy(F.col("_range").desc() if back else F.col("_range").asc()).rowsBetween(
        Window.unboundedPreceding, -1)
    over = {f"_s_{out}": F.last(f"_t_{out}", ignorenulls=True).over(before) for out in values}
    found = with_earlier(rows, keys, totals, over)
    return found.withColumns({out: F.coalesce(v, F.col(f"_s_{out}")) for out, v in inside.items()}).drop(*over)


def running_sums(
    df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column], range_rows: int = RANGE_ROWS
) -> DataFrame:
    """Sums of the given values over the key's rows up to and including this one.

    ``order`` must be unique per key; its columns are numbers, times or text.
    """
    rows, cut = in_ranges(df, keys, order, range_rows)
    return sums_in_ranges(rows, cut, keys, order, sums).drop("_range")


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    return running_sums(df, keys, order, {out: value}, range_rows)


def running_count(df: DataFrame, keys: list[str], order: list[str], out: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """1, 2, 3, ... per key in ``order``."""
    return running_sum(df, keys, order, F.lit(1).cast("bigint"), out, range_rows)
