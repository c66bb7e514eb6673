"""Questions over scan events.

Input is the typed fact table (``runstate.scan_facts``): one column per property,
so a question reads the few columns it needs. ``typed_scans`` brings an event log
of property bags, (timestamp, name, custom_dimensions MAP<STRING,STRING>), into
that shape. ``as_of`` stands for "now" and defaults to the newest event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import fixed_values as fv
from ..functions.arrays import leading, let, literal, running_totals
from .running import same_keys
from .runstate import FACT_MAPS

# --- fixed values: scan properties read as numbers ----------------------------
WHOLE = [
    "run_count", "first_risk_high", "first_pinned_odbc", "first_custom_dsn", "first_total_calls",
    "current_risk_high", "current_pinned_odbc", "resolved_risk_high", "resolved_risk_medium",
    "resolved_pinned_odbc", "resolved_custom_dsn", "resolved_migrating_artifacts",
    "odbc_pinned_at_risk_count", "inspected_artifacts", "coverage_score_pct",
]
REAL = ["estimated_manual_hours_saved", "duration_seconds", "time_since_first_scan_days"]
TEXT = [
    "workspace_id", "tenant_hash", "tenant_id", "user_hash", "version", "state_backend",
    "is_first_run", "sempy_used", "session_id", "run_id",
]


def prop(name: str) -> Column:
    """A property as text; a missing one reads as ''."""
    return F.coalesce(F.try_element_at("custom_dimensions", F.lit(name)), F.lit(""))


def whole(name: str) -> Column:
    return F.try_element_at("custom_dimensions", F.lit(name)).try_cast("bigint")


def real(name: str) -> Column:
    return F.try_element_at("custom_dimensions", F.lit(name)).try_cast("double")


def typed_scans(log: DataFrame, name: str = fv.SCAN_EVENT) -> DataFrame:
    """Scan events with typed columns; unused ones are pruned by the optimizer."""
    return log.filter(F.col("name") == name).select(
        "timestamp",
        *[prop(c).alias(c) for c in TEXT],
        *[whole(c).alias(c) for c in WHOLE],
        *[real(c).alias(c) for c in REAL],
        *[counts_at(prefix).alias(c) for c, prefix in FACT_MAPS.items()],
    )


def counts_at(prefix: str) -> Column:
    """The properties whose key starts with ``prefix``, as a map rest-of-key -> number."""
    wanted = F.map_filter("custom_dimensions", lambda k, v: F.lower(k).startswith(prefix))
    bare = F.transform_keys(wanted, lambda k, v: F.substring(k, F.lit(len(prefix) + 1), F.length(k)))
    return F.transform_values(bare, lambda k, v: v.try_cast("bigint"))


def since(rows: DataFrame, days: int, as_of=None) -> DataFrame:
    """Rows newer than ``days`` before ``as_of``.

    By default that is the time of the newest row, which costs a pass over the
    rows' inputs; a stored table's own newest time is cheaper to give.
    """
    if as_of is None:
        now = rows.agg(F.max("timestamp")).scalar()
    else:
        now = as_of if isinstance(as_of, Column) else F.lit(as_of)
    return rows.filter(F.col("timestamp") > now - F.make_dt_interval(F.lit(days)))


def day() -> Column:
    return F.date_trunc("day", "timestamp").alias("day")


def distinct_counts(
    rows: DataFrame, by: list[str], exact: bool = True, **columns: str
) -> DataFrame:
    """Row count and distinct counts, one output per keyword.

    Exact counts first reduce the rows to one per combination, map-side, so that
    the distinct stage works on combinations and not on events. Sketches need no
    such step: they are merged from one per task.
    """
    if not exact:
        return rows.groupBy(*by).agg(
            F.count("*").alias("scans"),
            *[F.approx_count_distinct(c).alias(out) for out, c in columns.items()],
        )
    keys = list(dict.fromkeys(columns.values()))
    cells = rows.groupBy(*by, *keys).agg(F.count("*").alias("_n"))
    return cells.groupBy(*by).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("scans"),
        *[F.count_distinct(c).alias(out) for out, c in columns.items()],
    )


def daily_sketches(rows: DataFrame, lg_size: int = 12, **columns: str) -> DataFrame:
    """Per day the scans and a HyperLogLog sketch of each column's values: a table to store, some KB a day.

    Sketches of days (or of parts of a day that came later) add up, so a question over any span reads days, not events.
    """
    return rows.groupBy(day()).agg(
        F.count("*").alias("scans"),
        *[F.hll_sketch_agg(F.coalesce(F.col(c), F.lit("")), F.lit(lg_size)).alias(out) for out, c in columns.items()])


def counts_from_sketches(sketches: DataFrame, columns: list[str], days: int | None = None, as_of=None) -> DataFrame:
    """Scans and approximate distinct values of the last ``days`` days (all, if none), from stored sketches."""
    wanted = sketches
    if days is not None:
        now = sketches.agg(F.max("day")).scalar() if as_of is None else F.date_trunc("day", F.lit(as_of))
        wanted = sketches.filter(F.col("day") > now - F.make_dt_interval(F.lit(days)))
    return wanted.agg(
        F.coalesce(F.sum("scans"), F.lit(0)).alias("scans"),
        *[F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(c)), F.lit(0)).alias(c) for c in columns])


def percentiles(rows: DataFrame, by: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact discrete percentiles per group, by rank selection over value ranges.

    Rows are reduced to (group, value, count) first. Some values, chosen by a hash, cut the values of a group into
    ranges of about RANGE_VALUES values; counts per range tell which range holds a wanted rank, and only the values of
    that range are put in order. No task sees more of a group than its range counts and one range of values per
    percentile, also if there is one group only. All three steps read the same exchange of reduced rows.
    """
    cells = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n")).select(
        *by, F.col(value).alias("_value"), "_n")
    is_cut = F.pmod(F.xxhash64(*by, "_value", "_n"), F.lit(RANGE_VALUES)) == 0
    cuts = _grouped(cells.filter(is_cut), by).agg(F.sort_array(F.collect_list("_value")).alias("_cuts"))
    cut = _joined(cells, cuts, by) if by else cells.withColumn("_cuts", cuts.scalar())
    ranged = cut.withColumn("_range", F.expr(leading("_cuts", lambda c: f"{c} <= _value"))).drop("_cuts")
    counts = ranged.groupBy(*by, "_range").agg(F.sum("_n").alias("_n"))
    per_group = _grouped(counts, by).agg(_sorted_counts("_range"))
    ranks = ", ".join(
        f"struct({literal(out)} as _out, greatest(1, cast(ceil(element_at(_ends, -1) * {p}D) as bigint)) as _rank)" for out, p in probs.items())
    targets = per_group.filter(F.size("_cells") > 0).withColumn("_ends", _running("_cells")).select(
        *by, "_cells", "_ends", F.expr(f"inline(array({ranks}))")).withColumn("_t", _holding("_range", "_rank")).select(*by, "_out", "_t.*")
    held = _joined(ranged, targets if by else F.broadcast(targets), [*by, "_range"], "inner")
    found = held.groupBy(*by, "_out", "_rest").agg(_sorted_counts("_value")).withColumn("_ends", _running("_cells")).select(
        *by, "_out", _holding("_value", "_rest")["_value"].cast("double").alias("_value"))
    return _grouped(found, by).agg(*[F.max(F.when(F.col("_out") == out, F.col("_value"))).alias(out) for out in probs])


RANGE_VALUES = 4096


def _grouped(rows: DataFrame, by: list[str]):
    return rows.groupBy(*by) if by else rows.groupBy()


def _joined(rows: DataFrame, side: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """An equi-join in which NULL is a key like any other; the keys of ``side`` go."""
    renamed = side.withColumnsRenamed({k: f"_at_{k}" for k in keys})
    return rows.join(renamed, same_keys(keys), how).drop(*[f"_at_{k}" for k in keys])


def _sorted_counts(name: str) -> Column:
    return F.sort_array(F.collect_list(F.struct(name, "_n"))).alias("_cells")


def _running(cells: str) -> Column:
    return F.expr(running_totals(f"transform({cells}, c -> c._n)"))


def _holding(name: str, rank: str) -> Column:
    """Of sorted ``_cells`` with running counts ``_ends`` the one that holds a rank, and the rank within it."""
    at = leading("_ends", lambda end: f"{end} < {rank}")
    place = f"struct(get(_cells, at).{name} as {name}, cast({rank} - if(at > 0, get(_ends, at - 1), 0) as bigint) as _rest)"
    return F.expr(let("at", at, place))


def map_rollup(rows: DataFrame, counts: Column, name: str, total: str) -> DataFrame:
    """Sums of a map column's values per key.

    The outer explode keeps the optimizer from adding a size filter, which
    would compute the map twice.
    """
    return (
        rows.select(F.explode_outer(counts).alias("_k", "_v"))
        .filter("_k IS NOT NULL")
        .groupBy(F.col("_k").alias(name))
        .agg(F.sum("_v").alias(total))
        .orderBy(F.desc(total), name)
    )


def latest_per(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key; reduced to one per key before the exchange."""
    newest = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_no", F.row_number().over(newest)).filter(F.col("_no") == 1).drop("_no")


# --- adoption -----------------------------------------------------------------------


def adoption(scans: DataFrame, days: int = 30, as_of=None, exact: bool = True) -> DataFrame:
    return distinct_counts(
        since(scans, days, as_of), [], exact, tenants="tenant_hash", workspaces="workspace_id"
    )


def tenant_usage(scans: DataFrame) -> DataFrame:
    """Per tenant: scans, workspaces, first and last scan.

    Raw tenant ids are not stored with facts; old logs may carry some.
    """
    if "tenant_id" not in scans.columns:
        scans = scans.withColumn("tenant_id", F.lit(""))
    cells = scans.groupBy("tenant_hash", "tenant_id", "workspace_id").agg(
        F.count("*").alias("n"), F.min("timestamp").alias("a"), F.max("timestamp").alias("z")
    )
    return cells.groupBy("tenant_hash", "tenant_id").agg(
        F.sum("n").alias("scans"),
        F.count_distinct("workspace_id").alias("workspaces"),
        F.min("a").alias("first_seen"),
        F.max("z").alias("last_seen"),
    ).orderBy(F.desc("scans"), "tenant_hash")


def first_run_impact(scans: DataFrame) -> DataFrame:
    return scans.filter("is_first_run = 'True'").select(
        "timestamp", "tenant_hash", "workspace_id",
        F.col("first_risk_high").alias("high_risk"),
        F.col("first_pinned_odbc").alias("pinned_odbc"),
        F.col("first_custom_dsn").alias("custom_dsn"),
        F.col("first_total_calls").alias("total_calls"),
    ).orderBy(F.desc("pinned_odbc"), "tenant_hash", "workspace_id", "timestamp")


def improvement(scans: DataFrame) -> DataFrame:
    """Latest run of each workspace that was scanned again, against its first."""
    latest = latest_per(scans, ["tenant_hash", "workspace_id"], ["run_count", "timestamp", "run_id"])
    return latest.filter("run_count >= 2").select(
        "tenant_hash", "workspace_id",
        F.col("run_count").alias("run_number"),
        F.col("first_risk_high").alias("first_high"),
        F.col("current_risk_high").alias("current_high"),
        (F.col("first_risk_high") - F.col("current_risk_high")).alias("delta_high"),
        F.col("first_pinned_odbc").alias("first_pinned"),
        F.col("current_pinned_odbc").alias("current_pinned"),
        (F.col("first_pinned_odbc") - F.col("current_pinned_odbc")).alias("delta_pinned"),
        F.col("timestamp").alias("latest_scan"),
    ).orderBy(F.desc("delta_pinned"), F.desc("delta_high"), "tenant_hash", "workspace_id")


def connector_mix(scans: DataFrame, days: int | None = 30, as_of=None) -> DataFrame:
    rows = scans if days is None else since(scans, days, as_of)
    return map_rollup(rows, F.col("impacts_by_connector"), "connector", "total_calls")


def stay_at_risk(scans: DataFrame, days: int = 30, as_of=None) -> DataFrame:
    latest = latest_per(since(scans, days, as_of), ["workspace_id"], ["timestamp", "run_id"])
    return latest.filter("odbc_pinned_at_risk_count > 0").select(
        "tenant_hash", "workspace_id", F.col("odbc_pinned_at_risk_count").alias("pinned_at_risk")
    ).orderBy(F.desc("pinned_at_risk"), "tenant_hash", "workspace_id")


def top_issues(validations: DataFrame, days: int | None = 30, as_of=None) -> DataFrame:
    rows = validations if days is None else since(validations, days, as_of)
    return map_rollup(rows, counts_at("issue_"), "issue", "occurrences")


def reach(scans: DataFrame) -> DataFrame:
    """Scans, known users, workspaces, tenants and versions; an empty user is no user."""
    known = scans.withColumn("user_hash", F.nullif("user_hash", F.lit("")))
    return distinct_counts(
        known, [], users="user_hash", workspaces="workspace_id", tenants="tenant_hash", versions="version"
    )


# --- progress -----------------------------------------------------------------------


def return_scans(scans: DataFrame) -> DataFrame:
    return scans.filter("is_first_run = 'False'")


def resolution_rollup(scans: DataFrame) -> DataFrame:
    return return_scans(scans).agg(
        F.sum("resolved_pinned_odbc").alias("resolved_pinned"),
        F.sum("resolved_risk_high").alias("resolved_high"),
        F.sum("resolved_risk_medium").alias("resolved_medium"),
        F.sum("resolved_custom_dsn").alias("resolved_custom_dsn"),
        F.sum("resolved_migrating_artifacts").alias("resolved_artifacts"),
        F.count("*").alias("return_scans"),
    )


def value_rollup(scans: DataFrame) -> DataFrame:
    """Hours saved, items inspected, median coverage, share of scans on the fast path."""
    median = percentiles(scans, [], "coverage_score_pct", {"median_coverage": 0.5})
    return scans.agg(
        F.sum(F.col("estimated_manual_hours_saved").cast("decimal(18,2)")).cast("double").alias("hours_saved"),
        F.sum("inspected_artifacts").alias("inspected"),
        (100.0 * F.count_if(F.col("sempy_used") == "True") / F.count("*")).alias("sempy_used_pct"),
    ).withColumn("median_coverage", median.scalar())


def daily_trend(scans: DataFrame, days: int | None = 60, as_of=None) -> DataFrame:
    rows = scans if days is None else since(scans, days, as_of)
    return distinct_counts(
        rows.withColumn("day", day()), ["day"], workspaces="workspace_id"
    ).orderBy("day")


def version_adoption(scans: DataFrame) -> DataFrame:
    return distinct_counts(
        scans, ["version"], workspaces="workspace_id", tenants="tenant_hash"
    ).orderBy(F.desc("version"))


def workspace_progress(scans: DataFrame, returning: bool = False) -> DataFrame:
    """Latest scan of each workspace, best progress first."""
    rows = return_scans(scans) if returning else scans
    latest = latest_per(rows, ["workspace_id"], ["timestamp", "run_id"])
    cols = [
        "timestamp", F.col("workspace_id").alias("workspace"),
        F.col("is_first_run").alias("is_first"), "run_count",
        F.col("first_pinned_odbc").alias("first_pinned"),
        F.col("current_pinned_odbc").alias("current_pinned"),
        F.col("resolved_pinned_odbc").alias("resolved_pinned"),
        F.col("coverage_score_pct").alias("coverage"), "version",
    ]
    if returning:
        cols += [
            F.col("tenant_hash").alias("tenant"),
            F.col("first_risk_high").alias("baseline_high"),
            F.col("current_risk_high").alias("current_high"),
            F.col("resolved_risk_high").alias("resolved_high"),
            F.col("time_since_first_scan_days").alias("days_since_first"),
        ]
    return latest.select(*cols).orderBy(F.desc("resolved_pinned"), "workspace")


def skip_reason_rollup(scans: DataFrame) -> DataFrame:
    return map_rollup(scans, F.col("skipped_by_reason"), "reason", "items")


def backend_split(scans: DataFrame) -> DataFrame:
    return scans.groupBy(F.col("state_backend").alias("backend")).agg(F.count("*").alias("scans"))


def first_vs_return(scans: DataFrame, by_version: bool = False) -> DataFrame:
    keys = ["version", "is_first_run"] if by_version else ["is_first_run"]
    return scans.groupBy(*keys).agg(F.count("*").alias("scans")).orderBy(*keys)


def pins_resolved_daily(scans: DataFrame) -> DataFrame:
    return return_scans(scans).groupBy(day()).agg(
        F.sum("resolved_pinned_odbc").alias("cleaned_up")
    ).orderBy("day")


def resolved_connector_rollup(scans: DataFrame) -> DataFrame:
    rolled = map_rollup(return_scans(scans), F.col("resolved_by_connector"), "connector", "resolved")
    return rolled.filter("resolved <> 0")


def hours_daily(scans: DataFrame) -> DataFrame:
    return scans.groupBy(day()).agg(_hours()).orderBy("day")


def _hours() -> Column:
    exact = F.col("estimated_manual_hours_saved").cast("decimal(18,2)")
    return F.sum(exact).cast("double").alias("hours")


def hours_30d(scans: DataFrame) -> DataFrame:
    """Per 30-day bin since the epoch: scans, workspaces and hours saved."""
    window = F.window(F.col("timestamp").cast("timestamp"), "30 days")["start"].alias("bin_start")
    cells = scans.groupBy(window, "workspace_id").agg(
        F.count("*").alias("n"),
        F.sum(F.col("estimated_manual_hours_saved").cast("decimal(18,2)")).alias("h"),
    )
    return cells.groupBy("bin_start").agg(
        F.sum("n").alias("scans"),
        F.count_distinct("workspace_id").alias("workspaces"),
        F.sum("h").cast("double").alias("hours"),
    ).orderBy(F.desc("bin_start"))


def duration_percentiles(scans: DataFrame) -> DataFrame:
    return percentiles(
        scans.withColumn("day", day()), ["day"], "duration_seconds", {"p50": 0.5, "p90": 0.9, "p99": 0.99}
    ).orderBy("day")


def validation_outcomes(validations: DataFrame) -> DataFrame:
    return validations.agg(*[
        F.sum(whole(p)).alias(out) for out, p in (
            ("validated", "validated_count"), ("passed", "passed"),
            ("passed_with_regression", "passed_with_regression"), ("failed", "failed"),
        )
    ])


def days_to_return(scans: DataFrame) -> DataFrame:
    rows = return_scans(scans).filter("time_since_first_scan_days > 0")
    return percentiles(rows, [], "time_since_first_scan_days", {"p50": 0.5, "p90": 0.9})


def volume(scans: DataFrame, days: int = 30, as_of=None) -> DataFrame:
    return since(scans, days, as_of).groupBy(day()).agg(F.count("*").alias("scans")).orderBy("day")


# --- repository traffic ------------------------------------------------------------

_TRAFFIC = {
    "clones_14d": "clones", "unique_cloners_14d": "unique_cloners",
    "views_14d": "views", "unique_viewers_14d": "unique_viewers",
}


def traffic_events(log: DataFrame) -> DataFrame:
    return log.filter(F.col("name") == fv.TRAFFIC_EVENT)


def traffic_trend(log: DataFrame) -> DataFrame:
    return traffic_events(log).select(
        "timestamp", *[whole(p).alias(out) for p, out in _TRAFFIC.items()]
    ).orderBy("timestamp")


def traffic_latest(log: DataFrame) -> DataFrame:
    """The newest traffic event with typed columns."""
    return _newest_traffic(log).select(
        "timestamp",
        *[whole(p).alias(out) for p, out in _TRAFFIC.items()],
        whole("total_release_downloads").alias("total_release_downloads"),
        whole("stargazers").alias("stargazers"),
    )


def _newest_traffic(log: DataFrame) -> DataFrame:
    return traffic_events(log).orderBy(F.desc("timestamp")).limit(1)


def release_downloads(log: DataFrame) -> DataFrame:
    """Downloads per release as the newest event lists them."""
    rolled = map_rollup(_newest_traffic(log), counts_at("release_downloads_"), "release", "downloads")
    return rolled.orderBy(F.desc("release"))


def release_totals(releases: DataFrame) -> DataFrame:
    """Nested releases (tag_name, assets[].download_count) to downloads per tag."""
    downloads = F.aggregate(
        "assets", F.lit(0).cast("bigint"), lambda acc, a: acc + F.coalesce(a["download_count"], F.lit(0))
    )
    downloads = F.coalesce(downloads, F.lit(0))
    return releases.select("tag_name", downloads.alias("d")).groupBy(
        F.regexp_replace("tag_name", "[.-]", "_").alias("tag")
    ).agg(F.sum("d").alias("downloads"))


def release_list(releases: DataFrame) -> DataFrame:
    """Each release with its name, date, link and downloads."""
    downloads = F.aggregate(
        "assets", F.lit(0).cast("bigint"), lambda acc, a: acc + F.coalesce(a["download_count"], F.lit(0))
    )
    return releases.select(
        F.col("tag_name").alias("tag"), "name", F.col("published_at").alias("published"),
        F.coalesce(downloads, F.lit(0)).alias("downloads"), F.col("html_url").alias("url"),
    )


def top_referrers(referrers: DataFrame, n: int = 3) -> DataFrame:
    """The strongest referrers as numbered rows (referrer, count)."""
    first = referrers.orderBy(F.desc("count"), "referrer").limit(n)
    rank = F.row_number().over(Window.orderBy(F.desc("count"), "referrer"))
    return first.select(rank.alias("position"), "referrer", "count")


def referrers_wide(referrers: DataFrame, n: int = 3) -> DataFrame:
    """The same as one wide row: top_referrer_1, top_referrer_1_count, ..."""
    top = top_referrers(referrers, n)
    at = F.col("position")
    cols = []
    for i in range(1, n + 1):
        cols += [
            F.max(F.when(at == i, F.col("referrer"))).alias(f"top_referrer_{i}"),
            F.max(F.when(at == i, F.col("count"))).alias(f"top_referrer_{i}_count"),
        ]
    return top.agg(*cols)


def referrers_long(wide: DataFrame, n: int = 3) -> DataFrame:
    """The wide row read back as rows."""
    rows = F.array(*[
        F.struct(
            F.lit(i).alias("position"),
            F.col(f"top_referrer_{i}").alias("referrer"),
            F.col(f"top_referrer_{i}_count").alias("count"),
        ) for i in range(1, n + 1)
    ])
    return wide.select(F.explode(rows).alias("r")).select("r.*").filter("referrer IS NOT NULL")


def clones_wide(daily: DataFrame, days: int = 14) -> DataFrame:
    """The last daily entries (day, count, uniques) as one row of indexed columns."""
    last = daily.orderBy(F.desc("day")).limit(days)
    place = F.row_number().over(Window.orderBy("day")) - 1
    at = F.col("_i")
    cols = []
    for i in range(days):
        cols += [
            F.max(F.when(at == i, F.date_format("day", "yyyy-MM-dd"))).alias(f"clones_day_{i}_date"),
            F.max(F.when(at == i, F.col("count"))).alias(f"clones_day_{i}_count"),
            F.max(F.when(at == i, F.col("uniques"))).alias(f"clones_day_{i}_unique"),
        ]
    return last.withColumn("_i", place).agg(*cols, F.count("*").alias("clones_days"))


def clones_patch(latest: DataFrame, direct: DataFrame) -> DataFrame:
    """Newer direct aggregates (one row; the largest of several) override what the newest event says."""
    newer = direct.agg(F.max_by(F.struct("count", "uniques"), F.struct("count", "uniques"))).scalar()
    return latest.withColumn("_direct", newer).withColumns({
        "clones": F.coalesce("_direct.count", "clones"),
        "unique_cloners": F.coalesce("_direct.uniques", "unique_cloners"),
    }).drop("_direct")
