"""Impact report, validation, run state, events, deliveries on small tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from estatelens.catalog import fixed_values as fv
from estatelens.sinks import committed
from estatelens.operators import delivery, events, impact, running, runstate, validation
from estatelens.plans import estate
from estatelens.sources.items import gateway_states

T0 = dt.datetime(2024, 1, 10)
ADBC = "odbc_to_adbc:snowflake"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


# --- impact -------------------------------------------------------------------------


@pytest.fixture(scope="module")
def risky(spark):
    rows = [  # item, kind, migration, implementation, dsn, gateway
        ("a", "Snowflake", ADBC, "1.0", False, False), ("a", "SQL Server", "none", None, False, False),
        ("a", "Snowflake", ADBC, None, False, False), ("b", "Snowflake", ADBC, "1.0", False, None),
        ("c", "SQL Server", "none", None, False, True), ("d", "Generic ODBC", "none", None, True, None),
        ("e", "Hive LLAP", "deprecation:hive", None, False, None), ("e", "Snowflake", ADBC, "2.0", False, None),
    ]
    df = spark.createDataFrame(
        [("w", i, n, *rest) for n, (i, *rest) in enumerate(rows)],
        "workspace_id string, item_id string, call_pos int, connector_kind string, migration string, implementation string,"
        " custom_dsn boolean, has_gateway boolean",
    ).withColumns({
        "is_migrating": F.col("migration") != "none",
        "is_pinned_odbc": F.coalesce(F.col("implementation").startswith("1"), F.lit(False)),
    })
    return impact.add_risk(df)


def test_worst_risk_and_counts(risky):
    gateways = risky.select("workspace_id", "item_id", "has_gateway").distinct()
    arts = impact.artifacts(risky.drop("has_gateway"), gateways)
    assert {r.item_id: r.pinned_at_risk for r in arts.collect()}["a"] == 1
    worst = {r.item_id: r.worst_risk for r in arts.collect()}
    assert worst == {"a": "high", "b": "unknown", "c": "na", "d": "medium", "e": "medium"}
    counts = {r.risk: r.artifacts for r in impact.counts_by_risk(arts).collect()}
    assert counts == {"high": 1, "medium": 2, "unknown": 1, "low": 0, "na": 1}
    none = impact.counts_by_risk(arts.filter("false")).collect()
    assert {r.risk: r.artifacts for r in none} == dict.fromkeys(fv.RISK_RANK, 0)


def test_toolbar_hidden_and_filters(risky):
    assert impact.toolbar_counts(risky).first().asDict() == {
        "all_calls": 6, "will_fail": 1, "needs_review": 3, "ready": 2, "other": 0}
    assert impact.toolbar_counts(risky, True).first().other == 2
    assert impact.hidden_count(risky).first()[0] == 2
    assert {r.item_id for r in impact.filtered_calls(risky, "needs_review").collect()} == {"b", "d", "e"}
    assert impact.wanted_risks(["ready", "high"]) == ["high", "low"]
    assert [r.connector_kind for r in impact.connector_groups(risky, True).collect()] == [
        "Snowflake", "Hive LLAP", "SQL Server", "Generic ODBC"]


def test_connectors_in_first_seen_order(risky):
    lists = {r.item_id: r.connectors for r in impact.connector_lists(risky, ["call_pos"]).collect()}
    assert lists["a"] == "Snowflake, SQL Server" and lists["e"] == "Hive LLAP, Snowflake"


def test_preview_caps_against_brute_force(spark, risky):
    rng = random.Random(3)
    rows = [("w", "i", n, f"K{min(rng.randint(0, 9), rng.randint(0, 9))}", ADBC, None, False, None, True, False, "low", 1) for n in range(300)]
    df = spark.createDataFrame(rows, risky.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ").replace(",", ", "))
    got = sorted((r.list_no, r.connector_kind, r.call_pos, r.more) for r in impact.preview(df, ["call_pos"], 20, 70).collect())
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r[2])
    want, listed = [], 0
    for kind, pos in sorted(groups.items(), key=lambda kv: (-len(kv[1]), kv[0])):
        shown = pos[:20][:max(0, 70 - listed)]
        want += [(listed + n + 1, kind, p, len(pos) - len(shown)) for n, p in enumerate(shown)]
        listed += len(shown)
    assert got == want


def test_skip_reason_precedence(spark, risky):
    items = spark.createDataFrame(
        [("w", i, t, s) for i, t, s in [
            ("n", "Notebook", "denied"), ("x", "Dataflow", "denied"), ("y", "Dataset", "error:Timeout"), ("z", "Dataset", "ok"),
            ("a", "Dataset", "ok"), ("c", "Dataset", "ok"), ("q", "Dataset", "ok")]],
        "workspace_id string, item_id string, item_type string, fetch_status string")
    found = spark.createDataFrame([("w", i) for i in "acq"], "workspace_id string, item_id string")
    reasons = {r.item_id: r.skip_reason for r in impact.skip_reasons(items, found, risky).collect()}
    assert reasons == {"n": "type_not_inspected", "x": "permission_denied", "y": "error: Timeout",
                       "z": "definition_parsed_but_no_expressions", "a": None, "c": "no_migrating_connectors",
                       "q": "no_external_connectors"}
    everything = impact.skip_reasons(items, found, risky, include_non_migrating=True)
    assert everything.filter("item_id = 'c'").first().skip_reason is None


def test_gateway_is_three_valued(spark):
    items = spark.createDataFrame([("w", i, t) for i, t in [("a", "Dataset"), ("b", "Dataset"), ("c", "Dataset"), ("d", "Dataset"), ("e", "Dataflow")]],
                                  "workspace_id string, item_id string, item_type string")
    sources = spark.createDataFrame([("w", "a", None, True), ("w", "a", "g", True), ("w", "b", "", True), ("w", "c", None, False), ("w", "e", "g", True)],
                                    "workspace_id string, item_id string, gateway_id string, readable boolean")
    states = {r.item_id: r.has_gateway for r in gateway_states(items, sources, fv.DATASET_TYPES).collect()}
    assert states == {"a": True, "b": False, "c": None, "d": None, "e": None}


def test_coverage(spark):
    rows = [("SemanticModel",)] * 5 + [("Dataflow",)] * 2 + [("Report",)] * 12 + [("Mystery",), ]
    df = spark.createDataFrame(rows, "item_type string")
    assert impact.coverage(df).first().asDict() == {
        "total_items": 20, "inspected_items": 7, "not_inspected_items": 12, "other_items": 1, "score_pct": 35}
    assert impact.coverage(df.filter("false")).first().score_pct == 100


# --- validation ---------------------------------------------------------------------

HISTORY = "workspace_id string, item_id string, request_id string, status string, start_time timestamp_ntz, end_time timestamp_ntz, error_text string"


def entry(item, request, status, start, seconds, error=None):
    return ("w", item, request, status, at(start), at(start) + dt.timedelta(seconds=seconds), error)


@pytest.fixture(scope="module")
def history(spark):
    return spark.createDataFrame([
        entry("ok", "1", "Failed", -50, 10), entry("ok", "2", "Completed", -10, 100), entry("ok", "3", "InProgress", 1, 5),
        entry("ok", "4", "Completed", 5, 120), entry("ok", "5", "Failed", 8, 1),
        entry("slow", "1", "Completed", -10, 100), entry("slow", "2", "Completed", 2, 200),
        entry("bad", "1", "Completed", -10, 100), entry("bad", "2", "Failed", 2, 3, "HTTP 401"),
        entry("late", "1", "Completed", -10, 100), entry("late", "2", "Completed", 45, 3),
        entry("same", "1", "Completed", -10, 100), entry("same", "1", "Completed", 3, 100),
        entry("off", "1", "Disabled", 2, 3), entry("flow", "1", "Completed", 2, 3),
    ], HISTORY)


def statuses(df):
    return {r.item_id: r.status for r in df.collect()}


def scope_of(spark, items):
    return spark.createDataFrame([("w", i, "Dataflow" if i == "flow" else "SemanticModel") for i in items],
                                 "workspace_id string, item_id string, item_type string")


def test_validation_outcomes(spark, history):
    scope = scope_of(spark, ["ok", "slow", "bad", "late", "same", "off", "flow", "none", "refused"])
    triggers = spark.createDataFrame([("w", "refused", False), ("w", "ok", True)], "workspace_id string, item_id string, accepted boolean")
    cut = F.lit(T0).cast("timestamp_ntz")
    rows = validation.validate(scope, history, cut, triggers=triggers).collect()
    by = {r.item_id: r for r in rows}
    assert {i: r.status for i, r in by.items()} == {
        "ok": "passed", "slow": "passed_with_regression", "bad": "failed", "late": "no_new_refresh", "same": "no_new_refresh",
        "off": "failed", "flow": "skipped", "none": "no_new_refresh", "refused": "refresh_not_triggered"}
    assert by["ok"].duration_delta_pct == 20.0 and by["ok"].post.request_id == "4"
    assert by["slow"].reason.endswith("(regression: +100.0% slower than baseline)")
    assert "took +100% longer" in by["slow"].diagnosis_likely_cause
    assert by["bad"].diagnosis_issue == "ADBC authentication failed" and by["bad"].reason == "HTTP 401"
    assert by["off"].reason == "Refresh status: Disabled" and by["off"].diagnosis_issue == fv.UNCATEGORIZED_ISSUE
    assert by["none"].diagnosis_issue == fv.NOT_FINISHED[0] and by["flow"].reason == "validation for Dataflow not automated"
    flows = validation.validate(scope, history, cut, include_dataflows=True)
    assert statuses(flows)["flow"] == "passed"


def test_passive_validation(spark, history):
    rows = validation.validate(scope_of(spark, ["ok", "late", "same", "none"]), history, F.lit(T0).cast("timestamp_ntz"), trigger_refresh=False)
    assert statuses(rows) == {"ok": "failed", "late": "passed", "same": "no_new_refresh", "none": "no_new_refresh"}


def test_refresh_errors(spark):
    rows = [entry("i", str(n), "Failed" if n % 2 else "Completed", n, 1, f"e{n}" if n in (1, 5) else None) for n in range(8)]
    history = spark.createDataFrame(rows, HISTORY)
    asked = spark.createDataFrame([("w", "i", r) for r in ("5", "1", "3", None)], "workspace_id string, item_id string, request_id string")
    got = {r.request_id: r.error for r in validation.refresh_errors(history, asked).collect()}
    assert got == {"5": "e5", "1": "e1",  # an old request has its own error
                   "3": "Refresh failed at 2024-01-10T00:03:01Z (no detail returned)", None: "Refresh failed at 2024-01-10T00:07:01Z (no detail returned)"}


def test_preferred_call_is_the_first_migrating(spark):
    calls = spark.createDataFrame([("w", "a", "K", False, 0), ("w", "a", "K", True, 1), ("w", "a", "K", True, 2), ("w", "a", "L", False, 3)],
                                  "workspace_id string, item_id string, connector_kind string, is_migrating boolean, call_pos int")
    rows = validation.preferred_calls(calls, ["call_pos"]).collect()
    assert sorted((r.connector_kind, r.call_pos) for r in rows) == [("K", 1), ("L", 3)]


# --- run state ----------------------------------------------------------------------

SCAN = ("workspace_id string, tenant_hash string, ts timestamp_ntz, run_id bigint, "
        + ", ".join(f"{c} bigint" for c in runstate.COUNTERS) + ", counts_by_connector map<string,bigint>")


def scan_row(ws, minute, run, pinned, counts, high=0):
    values = {"risk_high": high, "pinned_odbc": pinned}
    return (ws, "t", at(minute), run, *[values.get(c, 0) for c in runstate.COUNTERS], counts)


def test_baseline_deltas_and_growth(spark):
    stub = ("w", "t", at(-5), 0, *[None] * len(runstate.COUNTERS), None)
    scans = spark.createDataFrame([
        stub, scan_row("w", 0, 1, 6, {"A": 3, "B": 2, "C": 1}), scan_row("w", 60 * 36, 2, 2, {"A": 1, "C": 1, "D": 4}, 2),
        scan_row("v", 0, 3, 1, {})], SCAN)
    states = runstate.with_state(scans)
    rows = {r.run_id: r for r in runstate.resolved(states).collect()}
    assert [(rows[i].run_count, rows[i].is_first_run) for i in (1, 2, 3)] == [(1, True), (2, False), (1, True)]
    assert (rows[2].resolved_pinned_odbc, rows[2].resolved_risk_high) == (4, -2)
    kinds = {r.connector_kind: r.resolved for r in runstate.resolved_by_connector(states).filter("run_id = 2").collect()}
    assert kinds == {"A": 2, "B": 2, "C": 0, "D": -4}
    days = states.select("run_id", runstate.days_since_first(F.col("first_run_at"), F.col("ts"), F.col("is_first_run")).alias("d"))
    assert {r.run_id: r.d for r in days.collect()} == {1: None, 2: 1.5, 3: None}


def test_reset_starts_a_new_baseline(spark):
    scans = spark.createDataFrame([scan_row("w", m, m, 10 - m, {}) for m in range(6)], SCAN)
    resets = scans.filter("run_id = 3").select("workspace_id", "tenant_hash", "ts", "run_id")
    keys = ["workspace_id", "tenant_hash", "epoch"]
    want = runstate.with_state(runstate.with_epochs(scans, resets, 2), keys, 2).orderBy("run_id").collect()
    rows = runstate.with_reset_state(scans, resets).orderBy("run_id").collect()
    assert [r.asDict() for r in rows] == [r.asDict() for r in want]
    assert [(r.epoch, r.run_count, r.first_run_id) for r in rows] == [(0, 1, 0), (0, 2, 0), (0, 3, 0), (1, 1, 3), (1, 2, 3), (1, 3, 3)]


def test_running_sum_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(rng.choice("aaab"), at(rng.randint(0, 4000)), n, rng.randint(-3, 3)) for n in range(800)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, id int, v bigint")
    got = {r.id: r.s for r in running.running_sum(df, ["k"], ["ts", "id"], F.col("v"), "s", 20).collect()}
    total = {"a": 0, "b": 0}
    for k, _, n, v in sorted(rows, key=lambda r: (r[1], r[2])):
        total[k] += v
        assert got[n] == total[k]


def test_states_are_guarded_and_merged(spark):
    schema = "asked_workspace_id string, asked_tenant_hash string, workspace_id string, tenant_hash string, schema_version int"
    rows = [("w", "t", "w", "t", 1), ("w", "t", "v", "t", 1), ("w", "t", "w", "u", 1), ("w", "t", "", None, 1), ("w", "t", "w", "t", 2), ("", None, "w", "t", 1)]
    assert runstate.guard_states(spark.createDataFrame(rows, schema)).count() == 3
    state = "workspace_id string, tenant_hash string, v int, schema_version int, last_run_at timestamp_ntz"
    stored = spark.createDataFrame([("a", "t", 1, 2, at(0)), ("b", "t", 1, 1, at(9))], state)
    new = spark.createDataFrame([("a", "t", 2, 1, at(5)), ("b", "t", 2, 1, at(5)), ("c", "t", 2, 1, at(5))], state)
    assert {r.workspace_id: r.v for r in runstate.merge_states(stored, new).collect()} == {"a": 1, "b": 2, "c": 2}


def test_opt_out_in_any_store(spark):
    scans = spark.createDataFrame([("a",), ("b",), ("c",)], "workspace_id string")
    one = spark.createDataFrame([("a", True), ("b", False)], "workspace_id string, telemetry_opt_out boolean")
    two = spark.createDataFrame([("c", True)], one.schema)
    assert [r.workspace_id for r in runstate.without_opted_out(scans, one, two).collect()] == ["b"]


# --- events -------------------------------------------------------------------------


@pytest.fixture(scope="module")
def facts(spark):
    scans = spark.createDataFrame([
        scan_row("w", 0, 1, 6, {"Google BigQuery": 3, "A/B": 1}), scan_row("w", 1440, 2, 2, {"Google BigQuery": 1}), scan_row("v", 2000, 3, 1, {})], SCAN)
    return runstate.scan_facts(runstate.with_state(scans.withColumns({
        "inspected_artifacts": F.lit(30).cast("bigint"), "pinned_at_risk": F.col("pinned_odbc"), "version": F.lit("1"),
        "user_hash": F.when(F.col("run_id") == 1, F.lit("u")).otherwise(""), "state_backend": F.lit("home"),
        "coverage_score_pct": F.col("run_id") * 10, "sempy_used": F.col("run_id") == 1, "duration_seconds": F.lit(1.5),
        "session_id": F.lit("s")})))


def test_log_round_trip(facts):
    back = events.typed_scans(runstate.scan_events(facts))
    shared = [c for c in back.columns if c in facts.columns]
    assert {"impacts_by_connector", "is_first_run", "resolved_pinned_odbc", "estimated_manual_hours_saved"} <= set(shared)

    def rows(df):
        return sorted((tuple(sorted(r.items()) if isinstance(r, dict) else r for r in x) for x in df.select(*shared).collect()), key=str)
    assert rows(back) == rows(facts)
    first = facts.filter("run_id = '1'").first()
    assert first.impacts_by_connector == {"Google_BigQuery": 3, "A_B": 1} and first.estimated_manual_hours_saved == 1.5


def test_names_that_collide_once_safe_give_one_property(spark):
    row = spark.range(1).select(runstate._safe_keys(F.create_map(F.lit("A B"), F.lit(1), F.lit("A/B"), F.lit(2), F.lit("C"), F.lit(3))))
    assert row.first()[0] == {"A_B": 2, "C": 3}


def test_missing_properties_read_as_empty(spark):
    log = spark.createDataFrame([(T0, fv.SCAN_EVENT, {"workspace_id": "w", "run_count": "x"}), (T0, "other", {})],
                                "timestamp timestamp_ntz, name string, custom_dimensions map<string,string>")
    row = events.typed_scans(log).first()
    assert (row.tenant_hash, row.run_count, row.impacts_by_connector) == ("", None, {})
    assert events.reach(events.typed_scans(log)).first().asDict() == {"scans": 1, "users": 0, "workspaces": 1, "tenants": 1, "versions": 1}


def test_questions(facts):
    assert events.reach(facts).first().asDict() == {"scans": 3, "users": 1, "workspaces": 2, "tenants": 1, "versions": 1}
    imp = events.improvement(facts).collect()
    assert [(r.workspace_id, r.run_number, r.delta_pinned) for r in imp] == [("w", 2, 4)]
    assert [r.connector for r in events.resolved_connector_rollup(facts).collect()] == ["Google_BigQuery", "A_B"]
    assert events.since(facts, 1, at(2001)).count() == 2
    assert events.value_rollup(facts).first().median_coverage == 20.0


def test_tenant_usage_and_snapshot(facts, tmp_path):
    from estatelens.plans import snapshot
    row = events.tenant_usage(facts).first()
    assert (row.tenant_hash, row.tenant_id, row.scans, row.workspaces) == ("t", "", 3, 2)
    cells = snapshot.snapshot(facts)
    folder = str(tmp_path / "snap")
    snapshot.write_snapshot(cells, folder, "monday")
    back = committed.read(facts.sparkSession, folder)
    assert {r.section for r in back.select("section").distinct().collect()} >= {"reach", "trend", "per_workspace", "versions"}
    assert sorted(map(str, back.collect())) == sorted(map(str, cells.collect()))
    found = {(r.section, r.entry, r.name): (r.number, r.text) for r in back.collect()}
    assert found["reach", "", "scans"] == (3.0, None) and found["per_workspace", "w", "is_first"] == (None, "False")


def test_percentiles_against_brute_force(spark):
    rng = random.Random(8)
    rows = [(rng.choice("ab"), float(rng.randint(0, 30))) for _ in range(500)]
    got = {r.g: r for r in events.percentiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", {"p50": .5, "p99": .99, "p0": 0.0}).collect()}
    for g in "ab":
        values = sorted(v for k, v in rows if k == g)
        for name, p in (("p50", .5), ("p99", .99), ("p0", 0)):
            assert got[g][name] == values[max(1, -(-int(len(values) * p * 100) // 100)) - 1 if (len(values) * p) % 1 == 0 else int(len(values) * p)]


def test_approximate_distinct_is_close(spark):
    df = spark.range(20000).select(F.concat(F.lit("w"), F.col("id") % 5000).alias("workspace_id"), F.lit("t").alias("tenant_hash"),
                                   F.lit(T0).cast("timestamp_ntz").alias("timestamp"))
    row = events.adoption(df, exact=False).first()
    assert row.scans == 20000 and abs(row.workspaces - 5000) < 250


# --- deliveries ---------------------------------------------------------------------


def test_retries_and_health(spark):
    rows = [(n, env, at(n), status, body) for n, (env, status, body) in enumerate([
        ("a", "network", "x"), ("b", "ok", "x"), ("a", "retried_ok", "x"), ("c", "http_500", "x"), ("c", "network", "x"),
        ("d", "ingest_drop", ""), ("e", "network", "x")])]
    log = spark.createDataFrame(rows, "attempt_id int, envelope_id string, at timestamp_ntz, status string, envelope string")
    assert [(r.envelope_id, r.attempt_id) for r in delivery.pending_retries(log).collect()] == [("c", 4), ("e", 6)]
    assert [r.envelope_id for r in delivery.pending_retries(log, cap=1).collect()] == ["c"]
    health = delivery.delivery_health(log).first()
    assert (health.attempts, health.delivered, health.failed, health.last_ok_at, health.last_failure_status, health.backlog) == (7, 2, 5, at(2), "network", 3)
    assert [r.attempt_id for r in delivery.last_n(log, 2).collect()] == [6, 5]


# --- the whole plan -----------------------------------------------------------------


def test_estate_scan_keeps_every_item(spark):
    from queryset import fixtures as fx
    sf = "/root/testdata/sf0.001"
    items = fx.plain_items(spark, sf)
    definitions = fx.definitions(spark, sf).unionByName(fx.activity_definitions(spark, sf, readable_only=False))
    from estatelens.sources.connections import flatten_connections
    report = estate.scan_items(items, definitions, flatten_connections(fx.raw_connections(spark, sf)), fx.datasources(spark, sf))
    totals = report.summary().first()
    assert totals.artifacts + totals.skipped == items.count()
    failing = report.filtered("will_fail")
    assert failing.calls.filter("risk <> 'high'").count() == 0 and failing.artifacts.filter("worst_risk <> 'high'").count() == 0
    assert failing.artifacts.count() == failing.calls.select("workspace_id", "item_id").distinct().count()
