"""Dimension DataFrames built from the fixed values.

Each is a local relation of at most a few dozen rows, so the optimizer knows
its size and a broadcast hint on it is safe at any data volume. Callers who
extend a catalog pass their own rows; ``bounded`` gives lists too long to
broadcast no hint, and joins on them go through the plain join path.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixed_values as fv

MAX_BROADCAST_ROWS = 10_000


def bounded(spark: SparkSession, table: pa.Table) -> DataFrame:
    """A broadcastable dimension; longer tables come back without the hint."""
    df = spark.createDataFrame(table)
    return F.broadcast(df) if table.num_rows <= MAX_BROADCAST_ROWS else df


def function_catalog(spark: SparkSession, rules=None) -> DataFrame:
    """(fn_key, rule_kind, rule_migration): one row per catalogued function."""
    rules = fv.CONNECTOR_RULES if rules is None else rules
    flat = [(fn.lower(), kind, bucket) for kind, fns, _, bucket in rules for fn in fns]
    return bounded(spark, pa.table({
        "fn_key": [r[0] for r in flat],
        "rule_kind": [r[1] for r in flat],
        "rule_migration": [r[2] for r in flat],
    }))


def prefix_names(spark: SparkSession, names=None) -> DataFrame:
    """(prefix_key, friendly_name)."""
    names = fv.PREFIX_NAMES if names is None else names
    return bounded(spark, pa.table({
        "prefix_key": list(names.keys()),
        "friendly_name": list(names.values()),
    }))


def error_rules(spark: SparkSession, contact: str = fv.DEFAULT_CONTACT, rules=None) -> DataFrame:
    """(rule_no, issue, likely_cause, suggested_actions, docs); the fallback is rule 0."""
    rules = fv.ERROR_RULES if rules is None else rules
    rows = [(0, fv.UNCATEGORIZED_ISSUE, fv.UNCATEGORIZED_CAUSE_PREFIX, fv.UNCATEGORIZED_ACTIONS, fv.DOCS_URL)]
    rows += [(i, r[1], r[2], r[3], r[4]) for i, r in enumerate(rules, start=1)]
    return _advice_table(spark, "rule_no", pa.int32(), rows, contact)


def scan_advice(spark: SparkSession, contact: str = fv.DEFAULT_CONTACT) -> DataFrame:
    """(advice_id, issue, likely_cause, suggested_actions, docs) for scan-time advice."""
    rows = [(key, *text, fv.DOCS_URL) for key, text in fv.SCAN_ADVICE.items()]
    return _advice_table(spark, "advice_id", pa.string(), rows, contact)


def validation_advice(spark: SparkSession, contact: str = fv.DEFAULT_CONTACT) -> DataFrame:
    """(advice_id, ...) for outcomes that are not matched from an error text."""
    rows = [
        ("regression", fv.REGRESSION_ISSUE, "", fv.REGRESSION_ACTIONS, fv.DOCS_URL),
        ("not_triggered", *fv.NOT_TRIGGERED),
        ("not_finished", *fv.NOT_FINISHED),
        ("no_new_refresh", *fv.NO_NEW_REFRESH),
    ]
    return _advice_table(spark, "advice_id", pa.string(), rows, contact)


def _advice_table(spark, key, key_type, rows, contact) -> DataFrame:
    return bounded(spark, pa.table({
        key: pa.array([r[0] for r in rows], key_type),
        "issue": [r[1] for r in rows],
        "likely_cause": [r[2] for r in rows],
        "suggested_actions": [[a.replace("{contact}", contact) for a in r[3]] for r in rows],
        "docs": [r[4] for r in rows],
    }))
