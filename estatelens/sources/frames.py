"""Partition and expression frames whose column names vary by library version."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

# --- fixed values: accepted column names and partition types ------------------
PARTITION_COLUMNS = {
    "expression": ["source expression", "source_expression", "expression"],
    "type": ["source type", "source_type"],
    "name": ["partition name", "name"],
    "table": ["table name", "table"],
}
SHARED_COLUMNS = {"expression": ["expression", "m", "expression text"], "name": ["name"]}
M_PARTITION_TYPES = ["m", "mashup", "powerquery"]


def resolve(df: DataFrame, candidates: dict) -> dict:
    """Role -> actual column, matched without regard to case, first candidate wins."""
    by_lower = {c.lower(): c for c in df.columns}
    return {
        role: next((F.col(f"`{by_lower[n]}`") for n in names if n in by_lower), None)
        for role, names in candidates.items()
    }


def partition_expressions(partitions: DataFrame, keys) -> DataFrame:
    """M partitions with a non-blank expression, named table.partition."""
    cols = resolve(partitions, PARTITION_COLUMNS)
    out = partitions
    if cols["expression"] is None:
        return _empty(out, keys)
    if cols["type"] is not None:
        out = out.filter(F.lower(cols["type"]).isin(M_PARTITION_TYPES))
    table = F.lit("?") if cols["table"] is None else cols["table"]
    name = F.lit("") if cols["name"] is None else F.coalesce(cols["name"], F.lit(""))
    return out.filter(strip(cols["expression"]) != "").select(
        *keys,
        F.regexp_replace(F.concat_ws(".", table, name), r"\.+$", "").alias("expr_name"),
        cols["expression"].alias("expression"),
    )


def shared_expressions(shared: DataFrame, keys) -> DataFrame:
    cols = resolve(shared, SHARED_COLUMNS)
    if cols["expression"] is None:
        return _empty(shared, keys)
    name = F.lit("?") if cols["name"] is None else cols["name"]
    return shared.filter(strip(cols["expression"]) != "").select(
        *keys,
        F.concat(F.lit("shared:"), name).alias("expr_name"),
        cols["expression"].alias("expression"),
    )


def frame_expressions(partitions: DataFrame, shared: DataFrame, keys) -> DataFrame:
    """Partition rows and shared rows together; either may have no usable column."""
    return partition_expressions(partitions, keys).unionByName(shared_expressions(shared, keys))


def _empty(df: DataFrame, keys) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(*keys, none.alias("expr_name"), none.alias("expression")).filter(F.lit(False))
