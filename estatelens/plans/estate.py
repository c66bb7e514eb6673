"""Whole-report plans: from exported tables to report tables, lazily."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import fixed_values as fv
from ..operators import activities, calls, extract, impact, validation
from ..sources import scanner
from ..sources.items import gateway_states

KEYS = impact.KEYS
CALL_ORDER = ["part_idx", "expr_idx", "call_pos"]


@dataclass(frozen=True)
class ImpactReport:
    """The tables of one scan. ``calls`` feeds most outputs: persist it when
    several are asked for. ``served`` holds the items that partition frames
    answered; ``connections_error`` says why a listing is missing."""

    items: DataFrame
    calls: DataFrame
    artifacts: DataFrame
    skips: DataFrame
    connections: DataFrame
    served: DataFrame | None = None
    scope: str = "workspace"
    connections_error: str = ""

    def summary(self) -> DataFrame:
        return impact.scan_totals(self.artifacts, self.skips, self.connections)

    def filtered(self, risk) -> ImpactReport:
        """The report of the calls of the requested risks; items left without calls fall out of its artifacts."""
        calls = impact.filtered_calls(self.calls, risk)
        gateways = calls.select(*KEYS, "has_gateway").distinct()
        return replace(self, calls=calls, artifacts=impact.artifacts(calls, gateways))

    def table(self) -> DataFrame:
        return impact.call_table(self.items, self.calls)

    def validate(self, history: DataFrame, cutover: Column, only_migrating: bool = False, **options) -> DataFrame:
        scope = impact_scope(self, only_migrating)
        return validation.validate(scope, history, cutover, **options)


def impact_scope(report: ImpactReport, only_migrating: bool) -> DataFrame:
    scoped = validation.validation_scope(report.artifacts, only_migrating)
    return scoped.join(report.items.select(*KEYS, "item_type"), KEYS).select(*KEYS, "item_type")


def scan_items(
    items: DataFrame,
    definitions: DataFrame,
    connections: DataFrame,
    datasources: DataFrame,
    frame_expressions: DataFrame | None = None,
    include_non_migrating: bool = False,
) -> ImpactReport:
    """Inventory and impact scan of exported items.

    ``items``: workspace_id, item_id, item_name, item_type, fetch_status.
    ``definitions``: workspace_id, item_id, item_type, definition (envelope JSON).
    ``connections``: flattened listing; ``datasources``: see ``gateway_states``.
    ``frame_expressions``: partition-frame rows, preferred where present.
    """
    keyed = definitions.select(*KEYS, "item_type", "definition")
    readable = keyed.join(items.filter("fetch_status = 'ok'").select(*KEYS), KEYS, "left_semi")
    documents = readable.filter(F.col("item_type").isin("SemanticModel", "Dataset", "Dataflow"))
    orchestration = readable.filter("item_type = 'DataPipeline'")
    parsed = extract.definition_expressions(documents)
    if frame_expressions is not None:
        parsed = extract.prefer_fast_source(frame_expressions, parsed, KEYS)
    m_calls = calls.scan_expressions(parsed).drop("path", "source")
    refs = activities.ref_connections(
        activities.activity_refs(activities.flatten_activities(activities.activity_documents(orchestration)))
    )
    ref_calls = activities.refs_to_calls(activities.resolve_connections(refs, connections))
    every = m_calls.unionByName(ref_calls, allowMissingColumns=True)
    gateways = gateway_states(items, datasources, fv.DATASET_TYPES)
    yielded = parsed.select(*KEYS).unionByName(refs.select(*KEYS))
    skips = impact.skip_reasons(items, yielded, every, include_non_migrating, frame_expressions, extract.too_deep(readable))
    kept = impact.relevant(every, include_non_migrating)
    return ImpactReport(
        items, impact.with_risk(kept, gateways), impact.artifacts(kept, gateways), skips, connections,
        None if frame_expressions is None else frame_expressions.select(*KEYS).distinct(),
    )


def scan_export(payloads: DataFrame, include_non_migrating: bool = False) -> DataFrame:
    """Tenant export (workspace documents) to calls per item."""
    expressions = scanner.export_expressions(scanner.export_items(payloads))
    return impact.tenant_rollup(calls.scan_expressions(expressions, excerpts=False), include_non_migrating)


def scan_tenant(
    exported: DataFrame, connections: DataFrame, include_non_migrating: bool = False
) -> ImpactReport:
    """A tenant export as the same report as a scan of items.

    ``exported``: one row per item with its ``node`` (``scanner.export_items`` makes
    them of workspace documents; exports by item bring them along). The export
    names no bound gateways, so every gateway is unknown; every item was read.
    """
    items = exported.drop("node").withColumn("fetch_status", F.lit("ok"))
    expressions = scanner.export_expressions(exported)
    every = calls.scan_expressions(expressions, excerpts=False)
    gateways = items.select(*KEYS, F.lit(None).cast("boolean").alias("has_gateway"))
    skips = impact.skip_reasons(items, expressions, every, include_non_migrating)
    kept = impact.relevant(every, include_non_migrating)
    return ImpactReport(
        items, impact.with_risk(kept, gateways), impact.artifacts(kept, gateways), skips, connections, scope="tenant"
    )
