"""Before/after refresh comparison around a cutover time.

``history`` is the normalised refresh table. Picking one entry per item is an
aggregation with map-side reduction, so an item with a long history is reduced
before anything is exchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import dimensions
from ..catalog import fixed_values as fv
from ..functions import classify
from ..functions.numbers import pct_change, seconds_between
from ..functions.text import non_empty
from .running import RANGE_ROWS, carried, in_ranges

KEYS = ["workspace_id", "item_id"]
_ENTRY = ["request_id", "status", "start_time", "end_time", "error_text"]


def _entry() -> Column:
    return F.struct(*_ENTRY)


def _when(col: str = "start_time") -> Column:
    return F.struct(col, "request_id")


def validation_scope(per_artifact: DataFrame, only_migrating: bool = False) -> DataFrame:
    return per_artifact.filter("has_migrating") if only_migrating else per_artifact


def last_refresh_before(history: DataFrame, cutover: Column) -> DataFrame:
    """(keys, pre): the latest entry that started before the cutover."""
    return (
        history.filter(F.col("start_time") < cutover)
        .groupBy(*KEYS)
        .agg(F.max_by(_entry(), _when()).alias("pre"))
    )


def first_terminal_after(
    history: DataFrame, before: DataFrame, cutover: Column, max_wait_minutes: int = 30
) -> DataFrame:
    """(keys, post): the first finished entry in the wait window that is a new request."""
    deadline = cutover + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(max_wait_minutes))
    finished = history.filter(
        (F.col("start_time") >= cutover)
        & (F.col("start_time") <= deadline)
        & F.col("status").isin(fv.TERMINAL_STATUSES)
    )
    previous = before.select(*KEYS, F.col("pre.request_id").alias("_previous"))
    return (
        finished.join(previous, KEYS, "left")
        .filter(~F.col("request_id").eqNullSafe(F.col("_previous")))
        .groupBy(*KEYS)
        .agg(F.min_by(_entry(), _when()).alias("post"))
    )


def new_refresh_since(history: DataFrame, cutover: Column) -> DataFrame:
    """(keys, pre, post): passive mode in one pass.

    ``post`` is the newest entry unless it is the same request as the one before
    the cutover; NULL means there is no new refresh to look at.
    """
    is_before = F.col("start_time") < cutover
    picked = history.groupBy(*KEYS).agg(
        F.max_by(F.when(is_before, _entry()), F.when(is_before, _when())).alias("pre"),
        F.max_by(_entry(), _when()).alias("latest"),
    )
    same = F.col("latest.request_id").eqNullSafe(F.col("pre.request_id"))
    return picked.select(*KEYS, "pre", F.when(~same, F.col("latest")).alias("post"))


def refreshes_around(
    cutovers: DataFrame, history: DataFrame, max_wait_minutes: int = 30, range_rows: int = RANGE_ROWS
) -> DataFrame:
    """(keys, cutover, pre, post) for any number of cutovers per item, in one sweep.

    ``pre`` and ``post`` are those of ``last_refresh_before`` and
    ``first_terminal_after``. Cutovers (keys, ``cutover``) and entries are laid
    into one order per item; what came last and what comes next is carried along,
    so no cutover is paired with every entry of its item.
    """
    marks = cutovers.select(*KEYS, F.col("cutover").alias("start_time"), F.lit(0).alias("_kind"))
    rows = history.select(*KEYS, *_ENTRY, F.lit(1).alias("_kind")).unionByName(marks, allowMissingColumns=True)
    order = ["start_time", "_kind", "request_id"]  # an entry of the very time of a cutover comes after it
    placed, cut = in_ranges(rows, KEYS, order, range_rows)
    entry = F.when(F.col("_kind") == 1, _entry())
    finished = F.when((F.col("_kind") == 1) & F.col("status").isin(fv.TERMINAL_STATUSES), _entry())
    swept = carried(placed, cut, KEYS, order, {"pre": entry})
    swept = carried(swept, cut, KEYS, order, {"_next": finished}, back=True)
    # The next finished entry of another request, noted where the request changes.
    swept = carried(swept, cut, KEYS, order, {"_after": finished}, back=True, strict=True)
    changes = F.when(finished.isNotNull() & ~F.col("_after.request_id").eqNullSafe(F.col("request_id")), F.col("_after"))
    swept = carried(swept, cut, KEYS, order, {"_other": changes}, back=True)
    first = F.when(F.col("_next.request_id").eqNullSafe(F.col("pre.request_id")), F.col("_other")).otherwise(F.col("_next"))
    deadline = F.col("start_time") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(max_wait_minutes))
    found = swept.filter("_kind = 0").withColumn("_first", first)
    return found.select(
        *KEYS, F.col("start_time").alias("cutover"), "pre",
        F.when(F.col("_first.start_time") <= deadline, F.col("_first")).alias("post"))


def refresh_seconds(entry: str) -> Column:
    return seconds_between(F.col(f"{entry}.start_time"), F.col(f"{entry}.end_time"))


def duration_delta(entry_before: str = "pre", entry_after: str = "post") -> Column:
    """Percent change of the duration; the earlier entry's status is not looked at."""
    return pct_change(refresh_seconds(entry_before), refresh_seconds(entry_after))


def validate(
    scope: DataFrame,
    history: DataFrame,
    cutover: Column,
    max_wait_minutes: int = 30,
    trigger_refresh: bool = True,
    triggers: DataFrame | None = None,
    include_dataflows: bool = False,
    contact: str = fv.DEFAULT_CONTACT,
) -> DataFrame:
    """One validation row per item of ``scope`` (keys and ``item_type``).

    ``triggers`` (keys, ``accepted``) says which refresh requests were refused;
    an item without a row counts as accepted.
    """
    if trigger_refresh:
        before = last_refresh_before(history, cutover)
        after = first_terminal_after(history, before, cutover, max_wait_minutes)
        entries = before.join(after, KEYS, "full_outer")
    else:
        entries = new_refresh_since(history, cutover)
    rows = scope.join(entries, KEYS, "left")
    if triggers is not None and trigger_refresh:
        rows = rows.join(triggers.select(*KEYS, "accepted"), KEYS, "left")
    else:
        rows = rows.withColumn("accepted", F.lit(True))
    return with_diagnosis(judge(rows, trigger_refresh, include_dataflows), contact)


def judge(rows: DataFrame, trigger_refresh: bool = True, include_dataflows: bool = False) -> DataFrame:
    """Status, reason, delta and the key of the diagnosis for each row."""
    types = fv.DATASET_TYPES + (["Dataflow"] if include_dataflows else [])
    automated = F.col("item_type").isin(types)
    refused = F.coalesce(~F.col("accepted"), F.lit(False))
    rows = rows.withColumn(
        "duration_delta_pct",
        F.when(automated & ~refused & (F.col("post.status") == "Completed"), duration_delta()),
    )
    delta = F.col("duration_delta_pct")
    slower = classify.is_regression(delta)
    status = (
        F.when(~automated, F.lit("skipped"))
        .when(refused, F.lit("refresh_not_triggered"))
        .when(F.col("post").isNull(), F.lit("no_new_refresh"))
        .when((F.col("post.status") == "Completed") & slower, F.lit("passed_with_regression"))
        .when(F.col("post.status") == "Completed", F.lit("passed"))
        .otherwise("failed")
    )
    rows = rows.withColumn("status", status).withColumn(
        "_error", F.when(F.col("status") == "failed", failure_text(F.col("post")))
    )
    none_new = fv.REASON_NOT_FINISHED if trigger_refresh else fv.REASON_NO_NEW_REFRESH
    reason = (
        F.when(F.col("status") == "skipped",
               F.concat(F.lit("validation for "), "item_type", F.lit(" not automated")))
        .when(F.col("status") == "refresh_not_triggered", F.lit(fv.REASON_NOT_TRIGGERED))
        .when(F.col("status") == "no_new_refresh", F.lit(none_new))
        .when(F.col("status") == "passed", F.lit(fv.REASON_COMPLETED))
        .when(F.col("status") == "passed_with_regression", F.concat(
            F.lit(fv.REASON_COMPLETED),
            F.format_string(" (regression: %+.1f%% slower than baseline)", delta)))
        .otherwise(F.col("_error"))
    )
    advice = (
        F.when(F.col("status") == "refresh_not_triggered", F.lit("not_triggered"))
        .when(F.col("status") == "no_new_refresh",
              F.lit("not_finished" if trigger_refresh else "no_new_refresh"))
        .when(F.col("status") == "passed_with_regression", F.lit("regression"))
    )
    return rows.withColumns({
        "reason": reason,
        "advice_id": advice,
        "rule_no": classify.error_rule_no(F.col("_error")),
        "pre": F.when(automated, F.col("pre")),
        "post": F.when(F.col("status").isin("passed", "passed_with_regression", "failed"), F.col("post")),
    })


def failure_text(entry: Column) -> Column:
    return F.coalesce(
        non_empty(entry["error_text"]),
        F.concat(F.lit("Refresh status: "), F.coalesce(entry["status"], F.lit("None"))),
    )


def with_diagnosis(rows: DataFrame, contact: str = fv.DEFAULT_CONTACT) -> DataFrame:
    """Fills the diagnosis columns from the two fixed advice tables."""
    spark = rows.sparkSession
    cols = ["issue", "likely_cause", "suggested_actions", "docs"]

    def renamed(df, prefix):
        return df.withColumnsRenamed({c: prefix + c for c in cols})

    joined = rows.join(
        renamed(dimensions.error_rules(spark, contact), "_r_"), "rule_no", "left"
    ).join(renamed(dimensions.validation_advice(spark, contact), "_v_"), "advice_id", "left")
    cause = (
        F.when(F.col("rule_no") == 0, classify.uncategorized_cause(F.col("_error")))
        .when(F.col("advice_id") == "regression", classify.regression_cause(F.col("duration_delta_pct")))
        .otherwise(F.coalesce("_r_likely_cause", "_v_likely_cause"))
    )
    return joined.withColumns({
        "diagnosis_issue": F.coalesce("_r_issue", "_v_issue"),
        "diagnosis_likely_cause": cause,
        "diagnosis_suggested_actions": F.coalesce("_r_suggested_actions", "_v_suggested_actions"),
        "diagnosis_docs": F.coalesce("_r_docs", "_v_docs"),
    }).drop("_error", *["_r_" + c for c in cols], *["_v_" + c for c in cols])


def validation_table(results: DataFrame, connectors: DataFrame, items: DataFrame) -> DataFrame:
    """The full validation table: one row per item, fourteen columns of plain values."""
    def text(name):
        return F.coalesce(F.col(name), F.lit(""))

    named = items.select(*KEYS, "item_name")
    return (
        results.drop("item_name").join(named, KEYS).join(connectors, KEYS, "left").select(
            *KEYS, "item_name", "item_type",
            text("connectors").alias("connectors"),
            "status",
            "reason",
            "duration_delta_pct",
            F.col("pre.end_time").alias("pre_refresh_end"),
            F.col("post.end_time").alias("post_refresh_end"),
            text("diagnosis_issue").alias("diagnosis_issue"),
            text("diagnosis_likely_cause").alias("diagnosis_likely_cause"),
            F.coalesce(F.array_join("diagnosis_suggested_actions", "; "), F.lit("")).alias(
                "diagnosis_suggested_actions"),
            text("diagnosis_docs").alias("diagnosis_docs"),
        )
    )


# --- history look-ups ------------------------------------------------------------


def recent_refreshes(history: DataFrame, top: int = 5) -> DataFrame:
    """The newest ``top`` entries per item with their rank; capped before the exchange."""
    newest = Window.partitionBy(*KEYS).orderBy(F.desc("start_time"), F.desc("request_id"))
    return history.withColumn("entry_no", F.row_number().over(newest)).filter(
        F.col("entry_no") <= top
    )


def refresh_errors(history: DataFrame, requests: DataFrame) -> DataFrame:
    """Error text of each asked-for request.

    Looked up in the item's whole history; without a match (or without a request
    id) the newest entry answers. A failed entry without text says so.
    """
    entry = F.struct("error_text", "status", "end_time")
    age = F.struct("start_time", "request_id")
    newest = history.groupBy(*KEYS).agg(F.max_by(entry, age).alias("_newest"))
    asked = requests.select(*KEYS, "request_id").distinct()
    own = history.groupBy(*KEYS, "request_id").agg(F.max_by(entry, age).alias("_own"))
    picked = asked.join(newest, KEYS).join(own, [*KEYS, "request_id"], "left").withColumn(
        "e", F.coalesce("_own", "_newest"))
    at = F.date_format("e.end_time", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    fallback = F.when(
        F.col("e.status") == "Failed",
        F.concat(F.lit("Refresh failed at "), F.coalesce(at, F.lit("None")), F.lit(" (no detail returned)")),
    )
    return picked.select(
        *KEYS, "request_id", F.coalesce(non_empty(F.col("e.error_text")), fallback).alias("error")
    )


# --- counts and groups --------------------------------------------------------------


def status_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count("*").alias("items"))


def issue_counts(results: DataFrame) -> DataFrame:
    return (
        results.filter("diagnosis_issue IS NOT NULL")
        .groupBy(F.col("diagnosis_issue").alias("issue"))
        .agg(F.count("*").alias("items"))
    )


def preferred_calls(calls: DataFrame, order: list[str]) -> DataFrame:
    """One call per (artifact, kind): the first migrating one, else the first."""
    best = Window.partitionBy(*KEYS, "connector_kind").orderBy(F.desc("is_migrating"), *order)
    return (
        calls.withColumn("_no", F.row_number().over(best)).filter(F.col("_no") == 1).drop("_no")
    )


def validation_status_kind(status: Column) -> Column:
    return (
        F.when(status == "passed", F.lit("ok"))
        .when(status == "passed_with_regression", F.lit("warn"))
        .when(status == "failed", F.lit("fail"))
        .when(status.isin("no_new_refresh", "refresh_not_triggered"), F.lit("warn"))
        .otherwise("none")
    )


def validation_rows(results: DataFrame, preferred: DataFrame) -> DataFrame:
    """Outcome per (artifact, kind); advice is shown for migrating connectors only."""
    outcome = results.select(
        *KEYS, "status", "duration_delta_pct",
        validation_status_kind(F.col("status")).alias("status_kind"), "diagnosis_issue",
    )
    return preferred.select(*KEYS, "connector_kind", "m_function", "endpoint_hint", "is_migrating").join(
        outcome, KEYS
    ).withColumn("diagnosis_issue", F.when(F.col("is_migrating"), F.col("diagnosis_issue")))


def validation_groups(rows: DataFrame) -> DataFrame:
    """Per connector: outcomes, failed groups first, then warned, then by size."""
    kind = F.col("status_kind")
    return (
        rows.groupBy("connector_kind")
        .agg(
            F.count("*").alias("connections"),
            F.count_if(kind == "ok").alias("ok"),
            F.count_if(kind == "warn").alias("warn"),
            F.count_if(kind == "fail").alias("fail"),
            F.count_if(kind == "none").alias("skipped"),
        )
        .withColumn("group_rank", F.when(F.col("fail") > 0, 0).when(F.col("warn") > 0, 1).otherwise(2))
        .orderBy("group_rank", F.desc("connections"), "connector_kind")
    )
