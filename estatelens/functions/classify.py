"""Row-level classification: pins, risk, statuses, links, diagnoses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..catalog import fixed_values as fv
from .text import non_empty, read_json


def any_match(text: Column, patterns) -> Column:
    """True when any of the literal patterns is found."""
    return reduce(lambda a, b: a | b, [text.rlike("(?iU)" + p) for p in patterns])


def lookup(col: Column, mapping: dict, default: Column) -> Column:
    """Constant lookup as a CASE, kept inside code generation."""
    out = reduce(lambda acc, kv: acc.when(col == kv[0], F.lit(kv[1])), mapping.items(), F)
    return out.otherwise(default)


# --- pins and risk -------------------------------------------------------------


def is_migrating(migration: Column) -> Column:
    return migration != "none"


def is_pinned_odbc(implementation: Column) -> Column:
    return F.coalesce(implementation.startswith("1"), F.lit(False))


def is_pinned_adbc(implementation: Column) -> Column:
    return F.coalesce(implementation.startswith("2"), F.lit(False))


def call_risk(
    migration: Column, implementation: Column, custom_dsn: Column, has_gateway: Column
) -> Column:
    """Risk of one call; a NULL gateway means unknown, never absent."""
    pinned = is_pinned_odbc(implementation)
    return (
        F.when(~is_migrating(migration), F.when(custom_dsn, F.lit("medium")).otherwise("na"))
        .when(migration.startswith("deprecation:"), F.when(pinned, F.lit("high")).otherwise("medium"))
        .when(is_pinned_adbc(implementation), F.lit("low"))
        .when(pinned & has_gateway, F.lit("medium"))
        .when(pinned & ~has_gateway, F.lit("high"))
        .when(pinned, F.lit("unknown"))
        .when(custom_dsn, F.lit("medium"))
        .otherwise("low")
    )


def risk_rank(risk: Column) -> Column:
    return lookup(risk, fv.RISK_RANK, F.lit(0))


def risk_of_rank(rank: Column) -> Column:
    return lookup(rank, {v: k for k, v in fv.RISK_RANK.items()}, F.lit("na"))


def status_kind(risk: Column) -> Column:
    return lookup(risk, fv.STATUS_OF_RISK, F.lit("ok"))


def status_label(kind: Column) -> Column:
    return lookup(kind, fv.STATUS_LABELS, F.lit(""))


def status_filter(kind: Column) -> Column:
    return lookup(kind, fv.STATUS_FILTERS, F.lit("other"))


def gateway_chip(migration: Column, has_gateway: Column) -> Column:
    return F.when(
        is_migrating(migration),
        F.when(has_gateway, F.lit("via gateway"))
        .when(~has_gateway, F.lit("no gateway"))
        .otherwise("gateway: unknown"),
    )


# --- links -----------------------------------------------------------------------


def portal_link(
    workspace_id: Column,
    item_id: Column,
    item_type: Column,
    cloud: Column | None = None,
    is_personal: Column | None = None,
    base_override: str | None = None,
) -> Column:
    """Deep link of an item; NULL whenever the link could not work.

    A named cloud wins over ``base_override``; with neither it is the
    commercial address.
    """
    commercial = F.lit(fv.PORTAL_BASES["commercial"])
    unnamed = F.lit(base_override.rstrip("/")) if base_override else commercial
    if cloud is None:
        base = unnamed
    else:
        base = F.when(non_empty(cloud).isNull(), unnamed).otherwise(
            lookup(F.lower(cloud), fv.PORTAL_BASES, commercial)
        )
    personal = F.lit(False) if is_personal is None else F.coalesce(is_personal, F.lit(False))
    segment = lookup(item_type, fv.PORTAL_SEGMENTS, F.lit(None))
    ws, item = non_empty(workspace_id), non_empty(item_id)
    return (
        F.when(personal & segment.isNotNull(), F.concat(base, F.lit("/me/"), segment, F.lit("/"), item))
        .when(personal, F.concat(base, F.lit("/me/list")))
        .when(segment.isNotNull(), F.concat(base, F.lit("/groups/"), ws, F.lit("/"), segment, F.lit("/"), item))
        .otherwise(F.concat(base, F.lit("/groups/"), ws, F.lit("/list")))
    )


# --- diagnoses --------------------------------------------------------------------


def error_rule_no(error_text: Column, rules=None) -> Column:
    """Number of the first matching rule, 0 for no match, NULL for no text."""
    rules = fv.ERROR_RULES if rules is None else rules
    case = F.when(non_empty(error_text).isNull(), F.lit(None).cast("int"))
    for i, rule in enumerate(rules, start=1):
        case = case.when(error_text.rlike("(?iUd)" + rule[0]), F.lit(i))
    return case.otherwise(0)


def uncategorized_cause(error_text: Column) -> Column:
    head = F.regexp_replace(error_text, "\n", " ")
    return F.concat(F.lit(fv.UNCATEGORIZED_CAUSE_PREFIX), head)


def is_regression(delta_pct: Column) -> Column:
    return F.coalesce(delta_pct > fv.REGRESSION_THRESHOLD_PCT, F.lit(False))


def regression_cause(delta_pct: Column) -> Column:
    head, tail = fv.REGRESSION_CAUSE.split("{delta}")
    whole = F.format_string("%+d", F.bround(delta_pct, 0).cast("bigint"))
    return F.concat(F.lit(head), whole, F.lit(tail))


def scan_advice_id(
    migration: Column, implementation: Column, custom_dsn: Column, has_gateway: Column
) -> Column:
    """Key of the scan-time advice; NULL when a call needs no action."""
    moving = is_migrating(migration)
    pinned = is_pinned_odbc(implementation) & moving
    return (
        F.when(migration.startswith("deprecation:"), F.lit("deprecation"))
        .when(custom_dsn, F.lit("custom_dsn"))
        .when(pinned & (has_gateway == F.lit(False)), F.lit("pinned_no_gateway"))
        .when(pinned, F.lit("pinned"))
        .when(moving & ~is_pinned_adbc(implementation), F.lit("ready"))
    )


def family_of(migration: Column) -> Column:
    return F.substring_index(migration, ":", -1)


# --- delivery ---------------------------------------------------------------------


def delivery_status(
    first_status: Column, retry_status: Column, body: Column
) -> Column:
    """Outcome of one delivery: up to two attempts and the last response body.

    NULL status = no response. A missing response or 429/503 is tried once more;
    the retry columns are read only then.
    """
    retried = first_status.isNull() | first_status.isin(429, 503)
    no_retry_answer = retried & retry_status.isNull()
    final = F.when(retried, retry_status).otherwise(first_status)
    answered = F.lower(F.coalesce(body, F.lit("")))
    html = answered.contains("<html") | answered.contains("<!doctype html")
    answer = read_json(body, "itemsReceived INT, itemsAccepted INT, errors ARRAY<STRING>")
    received = F.coalesce(answer["itemsReceived"], F.lit(0))
    accepted_n = F.coalesce(answer["itemsAccepted"], F.lit(0))
    errors = F.coalesce(F.size(answer["errors"]), F.lit(0))
    accepted = (accepted_n >= 1) & (accepted_n == received) & (errors <= 0)
    return (
        F.when(no_retry_answer & first_status.isNull(), F.lit("network"))
        .when(no_retry_answer, F.concat(F.lit("http_"), first_status.cast("string")))
        .when((final < 200) | (final >= 300), F.concat(F.lit("http_"), final.cast("string")))
        .when(html, F.lit("captive_portal"))
        .when(F.coalesce(accepted, F.lit(False)), F.when(retried, F.lit("retried_ok")).otherwise("ok"))
        .otherwise("ingest_drop")
    )


def identity_select(user_id: Column, alt_user_id: Column, env_user_id: Column, has_runtime: Column):
    """(user id, provenance): object ids only; the env id counts only without a runtime."""
    from .text import strip

    aad = F.coalesce(non_empty(strip(user_id)), non_empty(strip(alt_user_id)))
    env = non_empty(strip(env_user_id))
    chosen = F.when(has_runtime, aad).otherwise(env)
    source = F.when(chosen.isNull(), F.lit("")).when(has_runtime, F.lit("aad")).otherwise("env")
    return F.coalesce(chosen, F.lit("")), source
