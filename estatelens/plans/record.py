"""From a report to scan records: the rows that run state, events and dashboards start from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import fixed_values as fv
from ..operators import impact
from .estate import ImpactReport


def _counts(rows: DataFrame, key: str, out: str) -> DataFrame:
    """Per workspace a map key -> rows; at most one entry per connector kind or reason."""
    cells = rows.groupBy("workspace_id", key).agg(F.count("*").alias("n"))
    return cells.groupBy("workspace_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, "n")))).alias(out), F.sum("n").alias(f"_{out}"))


def scan_records(report: ImpactReport, run_id: Column, ts: Column, tenant_hash: Column) -> DataFrame:
    """One row per workspace of the inventory: counters, connector and skip counts, coverage, listed connections.

    The row has the columns of the ``scans`` table; ``runstate.with_state`` and
    ``runstate.scan_facts`` take it from there. Each input is reduced to
    workspaces before the joins.
    """
    risks = [F.count_if(F.col("worst_risk") == r).alias(f"risk_{r}") for r in fv.RISK_RANK]
    totals = [
        F.count("*").alias("artifacts_scanned"), F.sum("calls").alias("total_calls"),
        F.count_if("has_migrating").alias("migrating_artifacts"),
        *[F.sum(c).alias(c) for c in ("pinned_odbc", "pinned_at_risk", "custom_dsn")],
    ]
    per_workspace = report.artifacts.groupBy("workspace_id").agg(*risks, *totals)
    counters = [c for c in per_workspace.columns if c != "workspace_id"]
    kinds = _counts(report.calls, "connector_kind", "counts_by_connector")
    skipped = _counts(report.skips.filter("skip_reason IS NOT NULL"), "skip_reason", "skipped_by_reason")
    none = F.create_map().cast("map<string,bigint>")
    rows = impact.coverage(report.items, ["workspace_id"])
    for part in (per_workspace, kinds, skipped):
        rows = rows.join(part, "workspace_id", "left")
    listed = report.connections.agg(F.count("*")).scalar()
    served = F.lit(0).cast("bigint")
    if report.served is not None:
        hits = report.served.groupBy("workspace_id").agg(F.count_distinct("item_id").alias("_hits"))
        rows, served = rows.join(hits, "workspace_id", "left"), F.coalesce("_hits", F.lit(0))
    return rows.select(
        "workspace_id", tenant_hash.alias("tenant_hash"), ts.alias("ts"), run_id.alias("run_id"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in counters],
        F.coalesce("counts_by_connector", none).alias("counts_by_connector"),
        F.coalesce("skipped_by_reason", none).alias("skipped_by_reason"),
        F.coalesce("_skipped_by_reason", F.lit(0)).alias("skipped_count"),
        F.col("inspected_items").alias("inspected_artifacts"),
        F.col("score_pct").cast("double").alias("coverage_score_pct"),
        listed.alias("fabric_connection_count"),
        F.lit(report.connections_error).alias("fabric_connections_error"),
        F.lit(report.scope).alias("scope"),
        served.alias("sempy_hits"),
    )
