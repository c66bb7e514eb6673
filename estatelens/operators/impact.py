"""Impact report: skip reasons, artifact roll-ups, counts, groups, previews.

Inputs are flat tables: ``items`` (one row per item), ``calls`` (one row per
call, keyed by workspace_id and item_id) and ``gateways``. Every roll-up is a
partial aggregation; item rows never carry their calls as a list.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import dimensions
from ..catalog import fixed_values as fv
from ..functions import classify
from ..functions.numbers import half_even_pct

KEYS = ["workspace_id", "item_id"]


# --- calls with risk ---------------------------------------------------------------


def relevant(calls: DataFrame, include_non_migrating: bool = False) -> DataFrame:
    """Migrating or custom-DSN calls, unless everything is asked for."""
    return calls if include_non_migrating else calls.filter(is_relevant())


def is_relevant() -> Column:
    return (F.col("migration") != "none") | F.col("custom_dsn")


def with_risk(calls: DataFrame, gateways: DataFrame) -> DataFrame:
    """Adds ``has_gateway`` (NULL = unknown), ``risk`` and ``risk_rank``."""
    return add_risk(calls.join(gateways.select(*KEYS, "has_gateway"), KEYS, "left"))


def add_risk(calls: DataFrame) -> DataFrame:
    risk = classify.call_risk(
        F.col("migration"), F.col("implementation"), F.col("custom_dsn"), F.col("has_gateway")
    )
    return calls.withColumn("risk", risk).withColumn("risk_rank", classify.risk_rank(F.col("risk")))


# --- skips --------------------------------------------------------------------------


def skip_reasons(
    items: DataFrame,
    expressions: DataFrame,
    calls: DataFrame,
    include_non_migrating: bool = False,
    served: DataFrame | None = None,
    too_deep: DataFrame | None = None,
) -> DataFrame:
    """Items with ``skip_reason``; NULL means the item is part of the report.

    ``items.fetch_status`` is ok, denied, deleted, unavailable, too_deep or error:<type>.
    ``expressions`` holds one row or more per item that yielded something to
    inspect (M expressions or references). ``served`` holds the items a frame
    answered: whether their definition could be fetched does not matter.
    ``too_deep`` holds the items with a document that cannot be read.
    """
    rows = expressions.select(*KEYS, F.lit(False).alias("is_call"), F.lit(False).alias("is_relevant")).unionByName(
        calls.select(*KEYS, F.lit(True).alias("is_call"), is_relevant().alias("is_relevant")))
    return skip_reasons_of(items, rows, include_non_migrating, served, too_deep)


def skip_reasons_of(
    items: DataFrame,
    yields: DataFrame,
    include_non_migrating: bool = False,
    served: DataFrame | None = None,
    too_deep: DataFrame | None = None,
) -> DataFrame:
    """``skip_reasons`` from rows (keys, ``is_call``, ``is_relevant``) of everything that was inspected.

    ``calls.expression_yields`` makes them in one pass over the texts; they are
    reduced to items, map-side, and meet the inventory in one join.
    """
    inspected = F.col("item_type").isin(fv.INSPECTED_TYPES)
    found = yields.groupBy(*KEYS).agg(
        F.lit(True).alias("_has_expr"),
        F.when(F.bool_or("is_call"), F.lit(True)).alias("_has_calls"),
        F.bool_or("is_relevant").alias("_relevant"),
    )
    found = items.select(*KEYS).distinct().join(found, KEYS, "left") if served is not None or too_deep is not None else found
    status = F.col("fetch_status")
    if served is not None:
        found = found.join(served.select(*KEYS).distinct().withColumn("_served", F.lit(True)), KEYS, "left")
        status = F.when(F.col("_served"), F.lit("ok")).otherwise(status)
    if too_deep is not None:
        found = found.join(too_deep.select(*KEYS).withColumn("_deep", F.lit(True)), KEYS, "left")
        status = F.when(F.col("_deep") & (status == "ok"), F.lit("too_deep")).otherwise(status)
    reason = (
        F.when(~inspected, F.lit("type_not_inspected"))
        .when(status == "denied", F.lit("permission_denied"))
        .when(status == "deleted", F.lit("deleted_during_scan"))
        .when(status == "unavailable", F.lit("definition_unavailable"))
        .when(status.startswith("error:"), F.concat(F.lit("error: "), F.substring(status, F.lit(7), F.length(status))))
        .when((status == "too_deep") & F.col("_has_calls").isNull(), F.lit("definition_nested_too_deeply"))
        .when(F.col("_has_expr").isNull(), F.lit("definition_parsed_but_no_expressions"))
        .when(F.col("_has_calls").isNull(), F.lit("no_external_connectors"))
    )
    if not include_non_migrating:
        reason = reason.when(~F.col("_relevant"), F.lit("no_migrating_connectors"))
    return items.join(found, KEYS, "left").select(*items.columns, reason.alias("skip_reason"))


def skipped_by_reason(skips: DataFrame) -> DataFrame:
    return (
        skips.filter("skip_reason IS NOT NULL")
        .groupBy("skip_reason")
        .agg(F.count("*").alias("items"))
        .orderBy(F.desc("items"), "skip_reason")
    )


# --- artifacts ----------------------------------------------------------------------


def artifacts(calls: DataFrame, gateways: DataFrame) -> DataFrame:
    """One row per item with calls: worst risk and its totals.

    The gateway belongs to the item, so calls are first reduced to one row per
    item with the worst risk under each gateway state, map-side, and the state is
    joined to items, not to calls. An item with very many calls stays cheap.
    """
    def worst_if(gateway):
        risk = classify.call_risk(
            F.col("migration"), F.col("implementation"), F.col("custom_dsn"), F.lit(gateway).cast("boolean")
        )
        return F.max(classify.risk_rank(risk))

    per_item = calls.groupBy(*KEYS).agg(
        worst_if(True).alias("_with"),
        worst_if(False).alias("_without"),
        worst_if(None).alias("_unknown"),
        F.bool_or("is_migrating").alias("has_migrating"),
        F.count("*").alias("calls"),
        F.count_if("is_pinned_odbc").alias("pinned_odbc"),
        F.count_if("custom_dsn").alias("custom_dsn"),
    )
    gateway = F.col("has_gateway")
    rank = F.when(gateway, F.col("_with")).when(~gateway, F.col("_without")).otherwise(F.col("_unknown"))
    return per_item.join(gateways.select(*KEYS, "has_gateway"), KEYS, "left").select(
        *KEYS, "has_gateway", classify.risk_of_rank(rank).alias("worst_risk"), "has_migrating",
        "calls", "pinned_odbc", "custom_dsn",
        F.when(~gateway, F.col("pinned_odbc")).otherwise(0).alias("pinned_at_risk"),
    )


def connectors_in_order(calls: DataFrame, order: list[str]) -> DataFrame:
    """Distinct kinds per artifact with their first-seen position (1, 2, ...).

    Reduced to one row per (artifact, kind) before any ordering.
    """
    first = calls.groupBy(*KEYS, "connector_kind").agg(F.min(F.struct(*order)).alias("_first"))
    w = Window.partitionBy(*KEYS).orderBy("_first")
    return first.withColumn("position", F.row_number().over(w)).drop("_first")


def connector_lists(calls: DataFrame, order: list[str]) -> DataFrame:
    """Kinds per artifact joined with ', ' in first-seen order."""
    first = calls.groupBy(*KEYS, "connector_kind").agg(F.min(F.struct(*order)).alias("_first"))
    return first.groupBy(*KEYS).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("_first", "connector_kind"))),
                lambda s: s["connector_kind"],
            ),
            ", ",
        ).alias("connectors")
    )


def counts_by_risk(per_artifact: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Artifacts per worst risk; all five buckets are present."""
    levels = list(fv.RISK_RANK)
    grouped = per_artifact.groupBy(*(by or []))
    wide = grouped.agg(*[F.count_if(F.col("worst_risk") == r).alias(r) for r in levels])
    rows = F.array(*[F.struct(F.lit(r).alias("risk"), F.col(r).alias("artifacts")) for r in levels])
    return wide.select(*(by or []), F.explode(rows).alias("r")).select(*(by or []), "r.*")


def counts_by_connector(calls: DataFrame) -> DataFrame:
    return calls.groupBy("connector_kind").agg(F.count("*").alias("calls"))


def counts_by_migration(calls: DataFrame) -> DataFrame:
    return calls.groupBy("migration").agg(F.count("*").alias("calls"))


def counts_by_both(calls: DataFrame) -> DataFrame:
    """Both call counts from one pass: one row per connector and one per bucket."""
    kind, bucket = F.col("connector_kind"), F.col("migration")
    return (
        calls.groupingSets([[kind], [bucket]], kind, bucket)
        .agg(F.grouping("connector_kind").alias("_g"), F.count("*").alias("calls"))
        .select(
            F.when(F.col("_g") == 0, F.lit("connector")).otherwise("migration").alias("dimension"),
            F.coalesce("connector_kind", "migration").alias("name"),
            "calls",
        )
    )


def scan_totals(per_artifact: DataFrame, skips: DataFrame, connections: DataFrame) -> DataFrame:
    """One row of totals; the three inputs are aggregated apart, then put side by side."""
    main = per_artifact.agg(
        F.count("*").alias("artifacts"),
        F.count_if("has_migrating").alias("migrating_artifacts"),
        F.coalesce(F.sum("calls"), F.lit(0)).alias("total_calls"),
        F.coalesce(F.sum("pinned_odbc"), F.lit(0)).alias("pinned_odbc"),
        F.coalesce(F.sum("pinned_at_risk"), F.lit(0)).alias("pinned_at_risk"),
        F.coalesce(F.sum("custom_dsn"), F.lit(0)).alias("custom_dsn"),
    )
    return main.withColumns({
        "skipped": skips.agg(F.count("skip_reason")).scalar(),
        "connections": connections.agg(F.count("*")).scalar(),
    })


def pinned_at_risk(per_artifact: DataFrame) -> DataFrame:
    """Pinned calls on artifacts known to have no gateway, per workspace."""
    return per_artifact.groupBy("workspace_id").agg(F.sum("pinned_at_risk").alias("pinned_at_risk"))


# --- coverage ----------------------------------------------------------------------


def inventory_by_type(items: DataFrame, by: list[str] | None = None) -> DataFrame:
    return items.groupBy(
        *(by or []), F.coalesce("item_type", F.lit("Unknown")).alias("item_type")
    ).agg(F.count("*").alias("items"))


def type_class(item_type: Column) -> Column:
    return (
        F.when(item_type.isin(fv.INSPECTED_TYPES), F.lit("inspected"))
        .when(item_type.isin(fv.KNOWN_UNINSPECTED_TYPES), F.lit("not_inspected"))
        .otherwise("other")
    )


def coverage(items: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Inspected share of the items, whole percent rounded half to even."""
    kind = type_class(F.col("item_type"))
    grouped = items.groupBy(*by) if by else items.groupBy()
    return grouped.agg(
        F.count("*").alias("total_items"),
        F.count_if(kind == "inspected").alias("inspected_items"),
        F.count_if(kind == "not_inspected").alias("not_inspected_items"),
        F.count_if(kind == "other").alias("other_items"),
    ).withColumn("score_pct", half_even_pct(F.col("inspected_items"), F.col("total_items")))


# --- views -------------------------------------------------------------------------


def wanted_risks(risk) -> list[str]:
    """Risk levels named by levels or by the friendlier aliases."""
    names = [risk] if isinstance(risk, str) else list(risk)
    return sorted({level for n in names for level in fv.RISK_ALIASES.get(n, [n])})


def filtered_calls(calls: DataFrame, risk) -> DataFrame:
    """Calls of the requested risks; artifacts left without calls fall away."""
    return calls.filter(F.col("risk").isin(wanted_risks(risk)))


def filtered_artifacts(items: DataFrame, calls: DataFrame, risk) -> DataFrame:
    return items.join(filtered_calls(calls, risk), KEYS, "left_semi")


def toolbar_counts(calls: DataFrame, show_non_migrating: bool = False) -> DataFrame:
    """Visible calls per filter button; unknown counts as needing review."""
    risk = F.col("risk")
    return relevant(calls, show_non_migrating).agg(
        F.count("*").alias("all_calls"),
        F.count_if(risk == "high").alias("will_fail"),
        F.count_if(risk.isin("medium", "unknown")).alias("needs_review"),
        F.count_if(risk == "low").alias("ready"),
        F.count_if(risk == "na").alias("other"),
    )


def hidden_count(calls: DataFrame) -> DataFrame:
    return calls.agg(F.count_if(~is_relevant()).alias("hidden_calls"))


def kpi_cards(per_artifact: DataFrame, items: DataFrame) -> DataFrame:
    """Headline numbers of the report, counted on artifacts, with their tone."""
    risk = F.col("worst_risk")
    head = per_artifact.agg(
        F.count("*").alias("artifacts_scanned"),
        F.count_if("has_migrating").alias("migrating_artifacts"),
        F.coalesce(F.sum("calls"), F.lit(0)).alias("connections"),
        F.coalesce(F.sum("pinned_odbc"), F.lit(0)).alias("pinned_odbc"),
        F.coalesce(F.sum("custom_dsn"), F.lit(0)).alias("custom_dsn"),
        F.count_if(risk == "high").alias("will_fail"),
        F.count_if(risk.isin("medium", "unknown")).alias("needs_review"),
    )
    cover = coverage(items).select(F.struct("total_items", "inspected_items", "score_pct")).scalar()
    return (
        head.withColumn("_cover", cover)
        .select(*head.columns, "_cover.*")
        .withColumns({
            "will_fail_tone": F.when(F.col("will_fail") > 0, F.lit("high")).otherwise("low"),
            "needs_review_tone": F.when(F.col("needs_review") > 0, F.lit("medium")).otherwise("low"),
            "coverage_tone": F.when(F.col("score_pct") >= 80, F.lit("low")).otherwise("medium"),
        })
    )


def connector_groups(calls: DataFrame, show_non_migrating: bool = False) -> DataFrame:
    """Calls per connector with status counts, migrating groups first."""
    kind = F.col("status_kind")
    return (
        relevant(calls, show_non_migrating)
        .withColumn("status_kind", classify.status_kind(F.col("risk")))
        .groupBy("connector_kind")
        .agg(
            F.bool_or("is_migrating").alias("any_migrating"),
            F.count("*").alias("calls"),
            *[F.count_if(kind == k).alias(k) for k in ("ok", "warn", "fail")],
            F.count_if(kind == "none").alias("na"),
        )
        .orderBy(*_group_order())
    )


def connector_groups_of_items(calls: DataFrame, gateways: DataFrame) -> DataFrame:
    """``connector_groups`` of calls that have no risk yet.

    Calls are first counted per item and connector under each gateway state,
    map-side; the gateway, which belongs to the item, is joined to those counts.
    """
    states = {"with": F.lit(True), "without": F.lit(False), "unknown": F.lit(None).cast("boolean")}
    kinds = {"ok": "ok", "warn": "warn", "fail": "fail", "na": "none"}
    counts = []
    for state, gateway in states.items():
        kind = classify.status_kind(classify.call_risk(F.col("migration"), F.col("implementation"), F.col("custom_dsn"), gateway))
        counts += [F.count_if(kind == value).alias(f"_{out}_{state}") for out, value in kinds.items()]
    per_item = calls.groupBy(*KEYS, "connector_kind").agg(
        F.bool_or("is_migrating").alias("any_migrating"), F.count("*").alias("calls"), *counts)
    gateway = F.col("has_gateway")

    def known(out: str) -> Column:
        return F.when(gateway, F.col(f"_{out}_with")).when(~gateway, F.col(f"_{out}_without")).otherwise(F.col(f"_{out}_unknown"))

    return per_item.join(gateways.select(*KEYS, "has_gateway"), KEYS, "left").groupBy("connector_kind").agg(
        F.bool_or("any_migrating").alias("any_migrating"), F.sum("calls").alias("calls"),
        *[F.sum(known(out)).alias(out) for out in kinds],
    ).orderBy(*_group_order())


def _group_order():
    return [F.desc("any_migrating"), F.desc("calls"), F.asc("connector_kind")]


def preview(
    calls: DataFrame,
    order: list[str],
    per_group: int = 25,
    in_all: int = 400,
    show_non_migrating: bool = False,
) -> DataFrame:
    """The report's capped row list: a preview, next to the complete call table.

    The first rows of each group by ``order``; groups follow the report's group
    order until ``in_all`` rows are listed. ``more`` on each row is what its
    group leaves out. The per-group cap is applied before rows are exchanged,
    and only groups that can still be listed (each lists a row) are placed.
    """
    visible = relevant(calls, show_non_migrating)
    groups = connector_groups(calls, show_non_migrating).limit(in_all)
    listed = F.least("calls", F.lit(per_group))
    before = Window.orderBy(*_group_order()).rowsBetween(Window.unboundedPreceding, -1)
    placed = groups.select(
        "connector_kind",
        "calls",
        F.coalesce(F.sum(listed).over(before), F.lit(0)).alias("_start"),
    )
    top = visible.withColumn(
        "row_no",
        F.row_number().over(Window.partitionBy("connector_kind").orderBy(*order)),
    ).filter(F.col("row_no") <= per_group)
    shown = F.greatest(
        F.lit(0), F.least(F.least("calls", F.lit(per_group)), F.lit(in_all) - F.col("_start"))
    )
    return (
        top.join(placed, "connector_kind")
        .withColumn("list_no", F.col("_start") + F.col("row_no"))
        .filter(F.col("list_no") <= in_all)
        .withColumn("more", F.col("calls") - shown)
        .drop("calls", "_start")
    )


def connections_top(connections: DataFrame, n: int = 10) -> DataFrame:
    """The report's short connection list, with how many it leaves out."""
    left_out = connections.agg(F.greatest(F.lit(0), F.count("*") - n)).scalar()
    return connections.orderBy("connection_id").limit(n).withColumn("more", left_out)


def call_table(items: DataFrame, calls: DataFrame) -> DataFrame:
    """The full report table: one row per call, fifteen columns."""
    named = items.select(*KEYS, "workspace_name", "item_name", "item_type")
    own = [c for c in calls.columns if c not in ("workspace_name", "item_name", "item_type")]
    return calls.select(*own).join(named, KEYS).select(
        "workspace_id", "workspace_name", "item_id", "item_name", "item_type",
        "connector_kind", "m_function", "migration", "is_migrating",
        F.coalesce("implementation", F.lit("")).alias("implementation"),
        "custom_dsn",
        F.coalesce("endpoint_hint", F.lit("")).alias("endpoint_hint"),
        "has_gateway", "risk", "excerpt",
    )


def scan_diagnoses(calls: DataFrame, contact: str = fv.DEFAULT_CONTACT) -> DataFrame:
    """Calls with their scan-time advice (issue, cause, actions, docs)."""
    spark = calls.sparkSession
    advice = dimensions.scan_advice(spark, contact)
    family = classify.family_of(F.col("migration"))
    keyed = calls.withColumn("advice_id", classify.scan_advice_id(
        F.col("migration"), F.col("implementation"), F.col("custom_dsn"), F.col("has_gateway")
    ))

    def fill(col):
        swaps = [("{Family}", F.initcap(family)), ("{family}", family)]
        return reduce(lambda c, s: F.replace(c, F.lit(s[0]), s[1]), swaps, F.col(col))

    return keyed.join(advice, "advice_id", "left").withColumns({
        "issue": fill("issue"), "likely_cause": fill("likely_cause"),
    })


def tenant_rollup(calls: DataFrame, include_non_migrating: bool = False) -> DataFrame:
    """Calls per exported item and workspace; items without calls do not appear."""
    return relevant(calls, include_non_migrating).groupBy(
        "workspace_id", "workspace_name", "item_id", "item_name", "item_type"
    ).agg(
        F.count("*").alias("calls"),
        F.count_if("is_migrating").alias("migrating_calls"),
        F.count_if("is_pinned_odbc").alias("pinned_odbc"),
    )
