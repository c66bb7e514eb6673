"""Array helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CHUNK = 256
_MAX_BITS = 30


def explode_each(df: DataFrame, keys, array: Column, position: str, value: str) -> DataFrame:
    """One row per element with its position; empty and NULL arrays give none.

    A plain explode makes the optimizer add a size filter below it, which would
    compute a parsed array twice per row. The outer form has no such filter.
    """
    rows = df.select(*keys, F.posexplode_outer(array).alias(position, value))
    return rows.filter(F.col(position).isNotNull())


# --- expressions as SQL text -------------------------------------------------------
# Nested lambdas built call by call take seconds; as text they are parsed at once. Arguments are SQL text too, and the
# names that a helper binds begin with its own prefix, so that they hide nothing an argument means.


def literal(value: str) -> str:
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` for the value, which is computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _totals(values: str) -> str:
    """Running totals of a short array; every step copies what is there."""
    return (f"aggregate({values}, named_struct('sum', 0L, 'out', cast(array() as array<bigint>)), (tot_acc, tot_x) -> "
            "named_struct('sum', tot_acc.sum + tot_x, 'out', array_append(tot_acc.out, tot_acc.sum + tot_x)), tot_acc -> tot_acc.out)")


def running_totals(values: str) -> str:
    """The sum of the elements up to and including each one, in time linear in the array.

    Chunks are summed apart, then shifted by the totals of the chunks before them.
    """
    starts = f"sequence(1, greatest(size(run_all), 1), {_CHUNK})"
    chunks = f"transform({starts}, run_at -> {_totals(f'slice(run_all, run_at, {_CHUNK})')})"
    shifted = ("flatten(transform(run_chunks, (run_chunk, run_i) -> "
               "transform(run_chunk, run_x -> run_x + coalesce(get(run_ends, run_i - 1), 0L))))")
    ends = _totals("transform(run_chunks, run_chunk -> element_at(run_chunk, -1))")
    summed = let("run_chunks", chunks, let("run_ends", ends, shifted))
    return let("run_all", values, f"if(size(run_all) > 0, {summed}, cast(array() as array<bigint>))")


def matches(text: str, pattern: str, group: int = 0) -> str:
    """(start, end, value) of every match of a pattern that is never empty, in order; value is the group.

    Offsets count code points from 0, ``end`` is behind the match. They are running totals of what lies between the
    matches and of the matches themselves.
    """
    found = literal(pattern)
    held = (f"struct(split({text}, {found}, -1) as gaps, regexp_extract_all({text}, {found}, 0) as whole, "
            f"regexp_extract_all({text}, {found}, {group}) as vals)")
    steps = "transform(mat.whole, (mat_m, mat_i) -> cast(length(mat_m) + length(get(mat.gaps, mat_i)) as bigint))"
    placed = ("transform(mat.whole, (mat_m, mat_i) -> struct(get(mat_ends, mat_i) - length(mat_m) as start, "
              "get(mat_ends, mat_i) as end, get(mat.vals, mat_i) as value))")
    return let("mat", held, let("mat_ends", running_totals(steps), placed))


def leading(found: str, fits, bits: int = _MAX_BITS) -> str:
    """How many elements of an array fit, if those that do come first; found by halving, up to 2 ** bits of them.

    ``fits`` makes a condition out of the text for an element; ``found`` should be a name.
    """
    steps = ", ".join(str(1 << b) for b in reversed(range(bits)))
    condition = fits(f"get({found}, lead_n + lead_step - 1)")
    return f"aggregate(array({steps}), 0, (lead_n, lead_step) -> if({condition}, lead_n + lead_step, lead_n))"


def first_from(found: str, at: str) -> str:
    """The first of the matches that starts at ``at`` or later."""
    return f"get({found}, {leading(found, lambda m: f'{m}.start < {at}')})"
