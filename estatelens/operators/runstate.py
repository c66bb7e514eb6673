"""Run state: first-scan baselines, run counts, resolved deltas, events.

The state files of a single-machine tool become columns derived from an
append-only ``scans`` table: (workspace_id, tenant_hash, ts, run_id, counters,
counts_by_connector map).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import fixed_values as fv
from ..functions.numbers import rounded
from ..functions.text import safe_key
from .running import (
    RANGE_ROWS, earlier, in_ranges, running_count, running_sum, sums_in_ranges, upto, whole, with_earlier, within,
)

KEYS = ["workspace_id", "tenant_hash"]
ORDER = ["ts", "run_id"]
COUNTERS = [
    "risk_high", "risk_medium", "risk_low", "risk_unknown", "risk_na", "custom_dsn",
    "total_calls", "migrating_artifacts", "pinned_odbc",
]
RESOLVED = {
    "resolved_risk_high": "risk_high",
    "resolved_risk_medium": "risk_medium",
    "resolved_pinned_odbc": "pinned_odbc",
    "resolved_custom_dsn": "custom_dsn",
    "resolved_migrating_artifacts": "migrating_artifacts",
}


# --- baselines ----------------------------------------------------------------------


def real_scans(scans: DataFrame) -> DataFrame:
    """Stubs without counters are no scans."""
    return scans.filter(F.col("risk_high").isNotNull())


def _first_values() -> Column:
    return F.struct(
        F.col("ts").alias("first_run_at"),
        F.col("run_id").alias("first_run_id"),
        *[F.col(c).alias(f"first_{c}") for c in COUNTERS],
        F.col("counts_by_connector").alias("first_counts_by_connector"),
    )


def first_run_baseline(scans: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The first real scan per key locks every ``first_*`` value."""
    by = by or KEYS
    return (
        real_scans(scans)
        .groupBy(*by)
        .agg(F.min_by(_first_values(), F.struct(*ORDER)).alias("b"), F.max("ts").alias("last_run_at"))
        .select(*by, "b.*", "last_run_at")
    )


def with_run_count(scans: DataFrame, by: list[str] | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``run_count`` 1, 2, 3, ... and ``is_first_run``."""
    counted = running_count(real_scans(scans), by or KEYS, ORDER, "run_count", range_rows)
    return counted.withColumn("is_first_run", F.col("run_count") == 1)


def _with_marks(scans: DataFrame, resets: DataFrame) -> DataFrame:
    """Scans and reset markers in one table; a marker comes before the scan of the same place."""
    marks = resets.select(*KEYS, *ORDER, F.lit(1).cast("bigint").alias("_reset"))
    return scans.withColumn("_reset", F.lit(0).cast("bigint")).unionByName(
        marks, allowMissingColumns=True
    ).withColumn("_after", 1 - F.col("_reset"))


def _without_marks(summed: DataFrame) -> DataFrame:
    return summed.filter(F.col("_reset") == 0).drop("_reset", "_after")


def with_epochs(scans: DataFrame, resets: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``epoch`` counts the resets before each scan; a reset starts a new baseline.

    ``resets`` carries the keys, ``ts`` and ``run_id`` (its place in the order;
    a reset with the id of a scan takes effect just before it).
    """
    rows = _with_marks(scans, resets)
    return _without_marks(running_sum(rows, KEYS, [*ORDER, "_after"], F.col("_reset"), "epoch", range_rows))


def with_state(scans: DataFrame, by: list[str] | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Every scan with its run count and its baseline, in one exchange of the scans.

    The order of a key with many scans is cut into ranges (``running.in_ranges``).
    Per range, map-side, come the scan count and the earliest scan; over a key's
    ranges these become the range's starting count and the key's baseline.
    """
    by = by or KEYS
    rows, cut = in_ranges(real_scans(scans), by, ORDER, range_rows)
    return _state_of(rows, cut, by, scans.columns)


def with_reset_state(scans: DataFrame, resets: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``with_state`` per key and ``epoch``, in the same single exchange.

    The scans of an epoch follow each other, so ranges of a key are ranges of its epochs too.
    """
    order = [*ORDER, "_after"]
    rows, cut = in_ranges(_with_marks(scans, resets), KEYS, order, range_rows)
    epochs = _without_marks(sums_in_ranges(rows, cut, KEYS, order, {"epoch": F.col("_reset")}))
    return _state_of(real_scans(epochs), cut, [*KEYS, "epoch"], [*scans.columns, "epoch"])


def _state_of(rows: DataFrame, cut: bool, by: list[str], columns: list[str]) -> DataFrame:
    frame = within(by, ORDER, cut)
    if cut:
        totals = {"_n": F.count("*"), "_f": F.min_by(_first_values(), F.struct(*ORDER)), "_l": F.max("ts")}
        over = {
            "_start": F.sum("_n").over(earlier(by)),
            "_key_first": F.first("_f").over(upto(by)),
            "_key_last": F.max("_l").over(whole(by)),
        }
        rows = with_earlier(rows, by, totals, over, bounded="epoch" not in by)
    else:
        rows = rows.withColumns({"_start": F.lit(0).cast("bigint"), "_key_first": F.lit(None), "_key_last": F.lit(None)})
    last = F.max("ts").over(Window.partitionBy(*by, *(["_range"] if cut else [])))
    counted = rows.withColumns({
        "run_count": F.coalesce("_start", F.lit(0)) + F.count("*").over(frame),
        "_first": F.coalesce("_key_first", F.first(_first_values()).over(frame)),
        "last_run_at": F.coalesce("_key_last", last),
    })
    return counted.withColumn("is_first_run", F.col("run_count") == 1).select(
        *columns, "run_count", "is_first_run", "_first.*", "last_run_at")


def guard_states(states: DataFrame, schema_version: int = fv.STATE_SCHEMA_VERSION) -> DataFrame:
    """Stored states that may be used for the asked-for workspace and tenant.

    A state of another schema version, workspace or tenant reads as no baseline;
    a side that names none is not compared.
    """
    def agrees(asked, stored):
        a, s = F.coalesce(F.col(asked), F.lit("")), F.coalesce(F.col(stored), F.lit(""))
        return (a == "") | (s == "") | (a == s)

    return states.filter(
        (F.col("schema_version") == schema_version)
        & agrees("asked_workspace_id", "workspace_id")
        & agrees("asked_tenant_hash", "tenant_hash")
    )


def merge_states(stored: DataFrame, written: DataFrame) -> DataFrame:
    """Upsert of states per key; an older schema version never replaces a newer one."""
    rows = stored.withColumn("_new", F.lit(0)).unionByName(written.withColumn("_new", F.lit(1)))
    rest = [c for c in stored.columns if c not in KEYS]
    return (
        rows.groupBy(*KEYS)
        .agg(F.max_by(F.struct(*rest), F.struct("schema_version", "_new", "last_run_at")).alias("s"))
        .select(*KEYS, "s.*")
    )


# --- deltas -------------------------------------------------------------------------


def resolved(states: DataFrame) -> DataFrame:
    """Signed first - current deltas; negative means the estate grew."""
    return states.withColumns({
        out: F.col(f"first_{c}") - F.col(c) for out, c in RESOLVED.items()
    })


def resolved_map(first: Column, current: Column) -> Column:
    """kind -> first - current over the union of kinds, inside the row."""
    def minus(kind):
        return F.coalesce(F.try_element_at(first, kind), F.lit(0)) - F.coalesce(
            F.try_element_at(current, kind), F.lit(0)
        )

    kinds = F.array_union(F.map_keys(first), F.map_keys(current))
    return _once(kinds, lambda names: F.map_from_arrays(names, F.transform(names, minus)))


def resolved_by_connector(states: DataFrame) -> DataFrame:
    """One row per scan and kind of either scan."""
    deltas = resolved_map(F.col("first_counts_by_connector"), F.col("counts_by_connector"))
    return states.select(*KEYS, "run_id", F.explode(deltas).alias("connector_kind", "resolved"))


def days_since_first(first: Column, now: Column, is_first: Column) -> Column:
    """Days with two decimals, never negative; NULL on a first run."""
    days = F.timestamp_diff("SECOND", first, now) / F.lit(86400.0)
    return F.when(~is_first, rounded(F.greatest(days, F.lit(0.0)), 2))


def hours_saved(inspected: Column) -> Column:
    """Only inspected items earn manual-triage time."""
    return rounded(inspected * fv.MANUAL_MINUTES_PER_ITEM / F.lit(60.0), 2)


# --- events -------------------------------------------------------------------------


# The maps of a fact row and the property prefix each has in the event log.
FACT_MAPS = {
    "impacts_by_connector": "impacts_by_connector_",
    "first_impacts_by_connector": "first_impacts_by_connector_",
    "resolved_by_connector": "resolved_by_connector_",
    "skipped_by_reason": "skipped_by_reason_",
}


def scan_facts(states: DataFrame) -> DataFrame:
    """Scans with state as typed fact rows: ``timestamp``, one column per property,
    four map columns. Stored as a table, each question reads only its columns.
    """
    first, current = F.col("first_counts_by_connector"), F.col("counts_by_connector")
    no_counts = F.create_map().cast("map<string,bigint>")
    skipped = F.col("skipped_by_reason") if "skipped_by_reason" in states.columns else no_counts
    rows = resolved(states).withColumns({
        "time_since_first_scan_days": days_since_first(
            F.col("first_run_at"), F.col("ts"), F.col("is_first_run")),
        "estimated_manual_hours_saved": hours_saved(F.col("inspected_artifacts")),
        "current_risk_high": F.col("risk_high"),
        "current_risk_medium": F.col("risk_medium"),
        "current_pinned_odbc": F.col("pinned_odbc"),
        "current_custom_dsn": F.col("custom_dsn"),
        "impacted_count": F.col("migrating_artifacts"),
        "odbc_pinned_count": F.col("pinned_odbc"),
        "odbc_pinned_at_risk_count": F.col("pinned_at_risk"),
        "run_id": F.col("run_id").cast("string"),
        "impacts_by_connector": _safe_keys(current),
        "first_impacts_by_connector": _safe_keys(first),
        "resolved_by_connector": _safe_keys(resolved_map(first, current)),
        "skipped_by_reason": _safe_keys(skipped),
    }).withColumnRenamed("ts", "timestamp")
    flags = {
        c: F.when(F.col(c), F.lit("True")).otherwise("False")
        for c in ("is_first_run", "sempy_used") if c in rows.columns
    }
    internal = [
        "last_run_at", "first_run_id", "pinned_at_risk", *COUNTERS, "first_risk_low",
        "first_risk_unknown", "first_risk_na", "counts_by_connector", "first_counts_by_connector",
    ]
    return rows.withColumns(flags).drop(*internal)


def _once(value: Column, body) -> Column:
    """body(value) with the value computed once per row, however often body, or a lambda inside it, uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _safe_keys(counts: Column) -> Column:
    """Keys made safe for property names; of names that collide the later wins.

    The names are made once; only a map in which some collide looks for the later ones.
    """
    def last_ones(m):
        entries = F.arrays_zip(m["names"].alias("key"), m["amounts"].alias("value"))

        def is_last(name, i):
            return ~F.array_contains(F.slice(m["names"], i + 2, F.size(m["names"])), name)

        kept = F.filter(F.transform(m["names"], lambda n, i: F.when(is_last(n, i), i)), lambda i: i.isNotNull())
        return _once(entries, lambda e: F.map_from_entries(F.transform(kept, lambda i: F.get(e, i))))

    def named(m):
        differ = F.size(F.array_distinct(m["names"])) == F.size(m["names"])
        return F.when(differ, F.map_from_arrays(m["names"], m["amounts"])).otherwise(last_ones(m))

    return _once(counts, lambda c: _once(F.struct(
        F.transform(F.map_keys(c), safe_key).alias("names"), F.map_values(c).alias("amounts")), named))


def _prefixed(column: str, prefix: str) -> Column:
    return F.map_from_arrays(
        F.transform(F.map_keys(column), lambda k: F.concat(F.lit(prefix), k)),
        F.transform(F.map_values(column), lambda v: v.cast("string")))


def _text(value: Column) -> Column:
    """Values as the event log writes them: text, NULL as ''."""
    return F.coalesce(value.cast("string"), F.lit(""))


def scan_events(facts: DataFrame, name: str = fv.SCAN_EVENT) -> DataFrame:
    """Fact rows to log events: (timestamp, name, custom_dimensions of text)."""
    flat = [c for c in facts.columns if c != "timestamp" and c not in FACT_MAPS]
    bag = F.create_map(*[part for c in flat for part in (F.lit(c), _text(F.col(c)))])
    none = F.create_map().cast("map<string,string>")
    maps = [F.coalesce(_prefixed(c, p), none) for c, p in FACT_MAPS.items()]
    bag = F.map_concat(bag, *maps)
    # As the one element of an array the bag is made once per row: conditions on it do not carry its expression downwards.
    return facts.select("timestamp", F.lit(name).alias("name"), F.explode_outer(F.array(bag)).alias("custom_dimensions"))


def validation_events(results: DataFrame, base: DataFrame) -> DataFrame:
    """One event per validated workspace with its status and issue counts.

    ``base`` has one row per workspace: ``workspace_id``, ``ts`` and any base
    properties. Counts are reduced per (workspace, status, issue) first.
    """
    cells = results.groupBy("workspace_id", "status", "diagnosis_issue").agg(F.count("*").alias("n"))
    status = F.col("status")
    wide = cells.groupBy("workspace_id").agg(
        F.sum("n").alias("validated_count"),
        *[F.coalesce(F.sum(F.when(status == s, F.col("n"))), F.lit(0)).alias(s)
          for s in fv.VALIDATION_STATUSES],
    )
    issues = (
        cells.filter("diagnosis_issue IS NOT NULL")
        .groupBy("workspace_id", F.concat(F.lit("issue_"), safe_key(F.col("diagnosis_issue"))).alias("k"))
        .agg(F.sum("n").alias("n"))
        .groupBy("workspace_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("k", F.col("n").cast("string")))).alias("issues"))
    )
    rows = base.join(wide, "workspace_id").join(issues, "workspace_id", "left")
    flat = [f for f in rows.schema.fields if f.name not in ("ts", "issues")]
    props = F.create_map(*[
        part for f in flat
        for part in (F.lit(f.name), _text(F.col(f.name)))
    ])
    none = F.create_map().cast("map<string,string>")
    return rows.select(
        F.col("ts").alias("timestamp"),
        F.lit(fv.VALIDATION_EVENT).alias("name"),
        F.map_concat(props, F.coalesce("issues", none)).alias("custom_dimensions"),
    )


def without_opted_out(scans: DataFrame, *opt_outs: DataFrame) -> DataFrame:
    """Drops workspaces opted out in any store."""
    flagged = reduce(
        DataFrame.unionByName,
        [o.filter("telemetry_opt_out").select("workspace_id") for o in opt_outs],
    )
    return scans.join(flagged, "workspace_id", "left_anti")


def session_rollup(events: DataFrame) -> DataFrame:
    """Scans per session: several phases of one session share its id."""
    return events.groupBy("session_id").agg(
        F.count("*").alias("scans"),
        F.count_distinct("workspace_id").alias("workspaces"),
        F.min("ts").alias("started_at"),
        F.max("ts").alias("ended_at"),
    )
