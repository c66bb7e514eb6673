"""The registered queries: (spark, folder) -> DataFrame, one per operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelens.catalog import fixed_values as fv
from estatelens.functions import classify, text
from estatelens.functions.arrays import explode_each
from estatelens.functions.numbers import seconds_between
from estatelens.operators import (
    activities, calls, delivery, events, extract, impact, rules, runstate, validation,
)
from estatelens.plans import estate, record, snapshot
from estatelens.sources import connections, frames, refreshes, scanner
from estatelens.session import work_folder
from estatelens.sinks import committed
from estatelens.sources import items as item_sources
from estatelens.streaming import metrics, streams

from . import fixtures as fx

QUERIES: dict = {}
ITEM = ["workspace_id", "item_id"]
ORDER = ["expr_name", "call_pos"]
REF = [*ITEM, "activity_name", "activity_type", "role", "connection_id", "inline_type"]


def query(fn):
    """Registers a function under its own name."""
    QUERIES[fn.__name__] = fn
    return fn


def _long(*names):
    return [F.col(n).cast("bigint").alias(n) for n in names]


def _ntz(*names):
    return [F.col(n).cast("timestamp_ntz").alias(n) for n in names]


# --- shared intermediate tables ------------------------------------------------------


def m_calls(spark, sf, excerpts=False) -> DataFrame:
    return calls.scan_expressions(fx.expressions(spark, sf), excerpts)


def flat_connections(spark, sf) -> DataFrame:
    return connections.flatten_connections(fx.raw_connections(spark, sf))


def flat_activities(spark, sf) -> DataFrame:
    return activities.flatten_activities(
        activities.activity_documents(fx.activity_definitions(spark, sf)))


def refs(spark, sf) -> DataFrame:
    return activities.ref_connections(activities.activity_refs(flat_activities(spark, sf)))


def ref_calls(spark, sf) -> DataFrame:
    return activities.refs_to_calls(
        activities.resolve_connections(refs(spark, sf), flat_connections(spark, sf)))


def all_calls(spark, sf, excerpts=False) -> DataFrame:
    found = m_calls(spark, sf, excerpts)
    from_refs = ref_calls(spark, sf)
    return found.unionByName(from_refs if excerpts else from_refs.drop("excerpt"), allowMissingColumns=True)


def risky(spark, sf, everything=False, excerpts=False) -> DataFrame:
    return impact.with_risk(
        impact.relevant(all_calls(spark, sf, excerpts), everything), fx.gateways(spark, sf))


def artifact_rows(spark, sf, everything=False) -> DataFrame:
    return impact.artifacts(impact.relevant(all_calls(spark, sf), everything), fx.gateways(spark, sf))


def skips(spark, sf) -> DataFrame:
    of_refs = ref_calls(spark, sf).select(*ITEM, F.lit(True).alias("is_call"), impact.is_relevant().alias("is_relevant"))
    yields = calls.expression_yields(fx.expressions(spark, sf), ITEM).unionByName(of_refs)
    return impact.skip_reasons_of(fx.plain_items(spark, sf), yields)


# --- 2.1 sources and sinks --------------------------------------------------------


@query
def src_items(spark, sf):
    return item_sources.list_items(fx.plain_items(spark, sf), "SemanticModel")


@query
def src_workspaces(spark, sf):
    return item_sources.list_workspaces(fx.workspaces(spark, sf))


@query
def src_workspaces_by_id(spark, sf):
    ids = fx.workspaces(spark, sf).filter("is_personal").select("workspace_id")
    return item_sources.list_workspaces(fx.workspaces(spark, sf), ids=ids)


@query
def src_definition_parts(spark, sf):
    return extract.definition_parts(fx.definitions(spark, sf)).select(
        *ITEM, *_long("part_idx"), "path", "text")


@query
def src_scanner(spark, sf):
    return scanner.export_items(fx.scanner_payloads(spark, sf)).drop("node")


@query
def src_connections(spark, sf):
    return flat_connections(spark, sf)


@query
def src_connection_listing(spark, sf):
    raw = fx.raw_connections(spark, sf)
    errors = fx.table(spark, sf, "nation").select(
        F.concat(F.lit("tenant-"), "n_nationkey").alias("tenant_id"),
        F.when(F.col("n_nationkey") > 1, F.lit("http 403")).alias("error"))
    return connections.connection_listing(raw, errors)


@query
def src_refresh_history(spark, sf):
    history = refreshes.refresh_history(
        fx.dataset_feed(spark, sf), fx.job_feed(spark, sf), fx.plain_items(spark, sf))
    return history.withColumns({"start_time": F.col("start_time").cast("timestamp_ntz"),
                                "end_time": F.col("end_time").cast("timestamp_ntz")})


@query
def src_partitions_frame(spark, sf):
    return frames.frame_expressions(fx.partition_frame(spark, sf), fx.shared_frame(spark, sf), ITEM)


@query
def sink_calls(spark, sf):
    """Written, committed and read back."""
    folder = work_folder(spark)
    snapshot.write_calls(impact.call_table(fx.plain_items(spark, sf), risky(spark, sf, excerpts=True)), folder)
    return committed.read(spark, folder)


@query
def sink_validation(spark, sf):
    """Written, committed and read back."""
    folder = work_folder(spark)
    kinds = impact.connector_lists(impact.relevant(all_calls(spark, sf)), ORDER)
    snapshot.write_validation(validation.validation_table(
        fx.validation_results(spark, sf), kinds, fx.plain_items(spark, sf)), folder)
    return committed.read(spark, folder)


@query
def sink_snapshot(spark, sf):
    """Facts are stored once, every section reads them; the snapshot is written, committed and read back."""
    folder = work_folder(spark)
    fx.facts(spark, sf).write.parquet(f"{folder}-facts")
    facts = spark.read.parquet(f"{folder}-facts")
    rows = snapshot.snapshot(facts, fx.traffic_log(spark, sf), fx.daily_clones(spark, sf), fx.releases(spark, sf))
    snapshot.write_snapshot(rows, folder)
    return committed.read(spark, folder)


@query
def preview_capped(spark, sf):
    return impact.preview(risky(spark, sf, everything=True), [*ITEM, *ORDER]).select(
        "connector_kind", *ITEM, "m_function", *_long("row_no", "list_no", "more"))


# --- 2.2 definitions to expressions ----------------------------------------------


def _parsed(spark, sf):
    return extract.definition_expressions(fx.definitions(spark, sf))


def _bim_docs(spark, sf):
    parts = extract.definition_parts(fx.definitions(spark, sf)).filter("path LIKE '%.bim'")
    return parts.select(*ITEM, extract.model_json(F.col("text")).alias("doc"))


@query
def expr_tmsl_partitions(spark, sf):
    return _bim_docs(spark, sf).select(
        *ITEM, F.explode(extract.tmsl_partition_entries(F.col("doc"))).alias("e")).select(*ITEM, "e.*")


@query
def expr_tmsl_shared(spark, sf):
    return _bim_docs(spark, sf).select(
        *ITEM, F.explode(extract.tmsl_shared_entries(F.col("doc"))).alias("e")).select(*ITEM, "e.*")


@query
def expr_join_lines(spark, sf):
    """Every partition and every shared expression of every model, as a list of lines or as one text."""
    return explode_each(
        _bim_docs(spark, sf), ITEM, extract.written_expressions(F.col("doc")), "_no", "e").select(*ITEM, "e.*")


@query
def expr_tmdl_blocks(spark, sf):
    return _parsed(spark, sf).filter("path LIKE '%.tmdl'").select(*ITEM, "expr_name", "expression")


@query
def expr_dataflow_text(spark, sf):
    return _parsed(spark, sf).filter("lower(path) LIKE '%.pq'").select(*ITEM, "expr_name", "expression")


@query
def expr_dataflow_json_walk(spark, sf):
    return _parsed(spark, sf).filter("lower(path) LIKE '%model.json'").select(*ITEM, "expr_name", "expression")


@query
def looks_like_m(spark, sf):
    return fx.documents(spark, sf).select("doc_id", text.looks_like_m(F.col("text")).alias("is_m"))


@query
def expr_generic(spark, sf):
    generic = fx.definitions(spark, sf).withColumn("item_type", F.lit("Notebook"))
    return extract.definition_expressions(generic).select(*ITEM, "expr_name", "expression")


@query
def expr_scanner_dataset(spark, sf):
    rows = scanner.export_items(fx.scanner_payloads(spark, sf)).filter("item_type = 'SemanticModel'")
    return scanner.export_expressions(rows).select(*ITEM, "expr_name", "expression")


@query
def expr_scanner_dataflow(spark, sf):
    rows = scanner.export_items(fx.scanner_payloads(spark, sf)).filter("item_type = 'Dataflow'")
    return scanner.export_expressions(rows).select(*ITEM, "expr_name", "expression")


@query
def strings_for_key(spark, sf):
    parts = extract.definition_parts(fx.definitions(spark, sf)).filter("path LIKE '%.bim'")
    return extract.strings_for_key(parts.select(*ITEM, "text"), "text", "name").select(
        *ITEM, *_long("hit_idx"), "value")


@query
def expr_route_by_type(spark, sf):
    return _parsed(spark, sf).groupBy("item_type", F.lower("path").alias("path")).agg(
        F.count("*").alias("expressions"), F.count_distinct("item_id").alias("items"))


@query
def expr_prefer_fast_source(spark, sf):
    fast = frames.frame_expressions(fx.partition_frame(spark, sf), fx.shared_frame(spark, sf), ITEM)
    models = _parsed(spark, sf).filter("item_type = 'SemanticModel'").select(*ITEM, "expr_name", "expression")
    return extract.fast_hits(extract.prefer_fast_source(fast, models, ITEM), ITEM)


# --- 2.3 the expression scan ---------------------------------------------------------


@query
def mask_comments(spark, sf):
    return fx.expressions(spark, sf).select(
        *ITEM, text.mask_comments(F.col("expression")).alias("code"))


@query
def mask_strings(spark, sf):
    return fx.expressions(spark, sf).select(
        *ITEM, text.mask_strings(F.col("expression")).alias("masked"))


@query
def find_calls(spark, sf):
    return calls.call_sites(fx.expressions(spark, sf), excerpts=False).select(
        *ITEM, *_long("call_pos"), "m_function", "prefix")


@query
def arg_window(spark, sf):
    return calls.call_sites(fx.expressions(spark, sf), excerpts=False).select(
        *ITEM, *_long("call_pos"), "window")


@query
def implementation(spark, sf):
    return m_calls(spark, sf).select(*ITEM, "m_function", "implementation")


@query
def endpoint_hint(spark, sf):
    return m_calls(spark, sf).select(*ITEM, "m_function", "endpoint_hint")


@query
def custom_dsn(spark, sf):
    return m_calls(spark, sf).select(*ITEM, "m_function", "custom_dsn")


@query
def excerpt(spark, sf):
    return m_calls(spark, sf, excerpts=True).select(*ITEM, "m_function", "excerpt")


@query
def redact_secrets(spark, sf):
    return fx.documents(spark, sf).select("doc_id", text.redact_secrets(F.col("text")).alias("text"))


@query
def redact_pages(spark, sf):
    return fx.table(spark, sf, "pages").select("page_id", text.redact_secrets(F.col("html")).alias("html"))


@query
def truncate_marked(spark, sf):
    return fx.documents(spark, sf).select(
        "doc_id", text.truncate_marked(F.col("text"), fv.EXCERPT_CAP).alias("text"))


@query
def drop_builtins(spark, sf):
    return calls.call_sites(fx.expressions(spark, sf), excerpts=False).groupBy("prefix").agg(
        F.count("*").alias("calls"))


@query
def classify_migration(spark, sf):
    return m_calls(spark, sf).select(*ITEM, "m_function", "migration")


@query
def friendly_name(spark, sf):
    return m_calls(spark, sf).select(*ITEM, "m_function", "connector_kind")


@query
def calls_migrating(spark, sf):
    return calls.migrating_calls(m_calls(spark, sf)).select(*ITEM, "m_function", "connector_kind", "migration")


@query
def calls_all(spark, sf):
    return m_calls(spark, sf, excerpts=True).select(
        *ITEM, "expr_name", *_long("call_pos"), "connector_kind", "m_function", "migration",
        "implementation", "endpoint_hint", "excerpt", "custom_dsn")


@query
def kinds_summary(spark, sf):
    return calls.kinds_summary(m_calls(spark, sf))


# --- 2.4 activity documents ---------------------------------------------------------


@query
def activities_flat(spark, sf):
    return flat_activities(spark, sf).select(
        *ITEM, F.concat_ws(".", F.transform("path", lambda i: i.cast("string"))).alias("path"),
        scanner.text_at(F.col("node"), "$.name").alias("activity_name"),
        scanner.text_at(F.col("node"), "$.type").alias("activity_type"))


@query
def activity_refs(spark, sf):
    return activities.activity_refs(flat_activities(spark, sf)).select(
        *ITEM, "activity_name", "activity_type", *_long("role_idx"), "role")


@query
def ref_connection_id(spark, sf):
    return refs(spark, sf).select(*REF)


@query
def resolve_connection(spark, sf):
    return activities.resolve_connections(refs(spark, sf), flat_connections(spark, sf)).select(
        *REF, "connector_prefix", "connector_kind")


@query
def ref_migration(spark, sf):
    return ref_calls(spark, sf).select(*ITEM, "connector_kind", "migration")


@query
def ref_migration_table(spark, sf):
    """The same buckets from a table of rules: the catalog's, then thousands of others that name customers."""
    others = fx.table(spark, sf, "customer").select(
        (F.col("c_custkey") + 1000).alias("rule_no"), F.lit("_kind").alias("field"),
        F.concat(F.lit("customer "), "c_custkey").alias("needle"), F.lit("other").alias("bucket"))
    table = activities.migration_rules(spark).unionByName(others)
    resolved = activities.resolve_connections(refs(spark, sf), flat_connections(spark, sf))
    return activities.ref_migrations(resolved, table).select(*ITEM, "connector_kind", "migration")


@query
def first_rules(spark, sf):
    """The first of some thousand phrases (three words of a benchmark item) that a document contains."""
    words = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")
    phrases = fx.table(spark, sf, "benchmark").select("item_id", words.alias("w")).filter(F.size("w") >= 3).select(
        "item_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.array_join(F.slice("w", i, 3), " "))).alias("needle"))
    table = phrases.select(F.col("item_id").cast("bigint").alias("rule_no"), F.lit("text").alias("field"), "needle")
    docs = fx.table(spark, sf, "documents").select("doc_id", F.lower("text").alias("text"))
    return rules.first_rules(docs, ["text"], table).select("doc_id", "rule_no")


@query
def activity_calls(spark, sf):
    return ref_calls(spark, sf).select(
        *ITEM, "expr_name", *_long("call_pos"), "connector_kind", "m_function", "migration",
        "implementation", "endpoint_hint", "custom_dsn", "excerpt")


# --- 2.5 row-level classification ---------------------------------------------------


@query
def pin_flags(spark, sf):
    return m_calls(spark, sf).select(
        *ITEM, "m_function", "implementation", "is_pinned_odbc", "is_pinned_adbc", "is_migrating")


@query
def call_risk(spark, sf):
    return risky(spark, sf, everything=True).select(*ITEM, *ORDER[:1], "m_function", "has_gateway", "risk")


@query
def gateway_tristate(spark, sf):
    return fx.gateways(spark, sf)


@query
def scan_diagnosis(spark, sf):
    return impact.scan_diagnoses(risky(spark, sf, everything=True)).select(
        *ITEM, "m_function", "issue", "likely_cause",
        F.array_join("suggested_actions", "; ").alias("actions"), "docs")


@query
def status_kind(spark, sf):
    kind = classify.status_kind(F.col("risk"))
    return risky(spark, sf, everything=True).select(
        *ITEM, "m_function", "risk", kind.alias("kind"), classify.status_label(kind).alias("label"),
        classify.status_filter(kind).alias("bucket"))


@query
def gateway_chip(spark, sf):
    return risky(spark, sf, everything=True).select(
        *ITEM, "m_function", classify.gateway_chip(F.col("migration"), F.col("has_gateway")).alias("chip"))


@query
def portal_link(spark, sf):
    k = F.col("k")
    cloud = F.element_at(F.array(*[F.lit(c) for c in [*fv.PORTAL_BASES, "Mars", ""]]), (k % 7 + 1).cast("int"))
    ws = F.when(k % 13 != 0, F.col("workspace_id"))
    item = F.when(k % 19 != 0, F.col("item_id")).otherwise("")
    link = classify.portal_link(ws, item, F.col("item_type"), cloud, k % 9 == 0)
    return fx.items(spark, sf).select(k.alias("k"), link.alias("url"))


@query
def diagnose_error(spark, sf):
    h = fx.refresh_history(spark, sf).withColumn("rule_no", classify.error_rule_no(F.col("error_text")))
    from estatelens.catalog import dimensions
    rules = dimensions.error_rules(spark)
    cause = F.when(F.col("rule_no") == 0, classify.uncategorized_cause(F.col("error_text"))).otherwise(
        F.col("likely_cause"))
    return h.join(rules, "rule_no", "left").select(
        "request_id", *_long("rule_no"), "issue", cause.alias("likely_cause"),
        F.array_join("suggested_actions", "; ").alias("actions"), "docs")


@query
def regression_diagnosis(spark, sf):
    return fx.validation_results(spark, sf).filter("duration_delta_pct IS NOT NULL").select(
        *ITEM, "duration_delta_pct", classify.is_regression(F.col("duration_delta_pct")).alias("is_regression"),
        F.when(classify.is_regression(F.col("duration_delta_pct")),
               classify.regression_cause(F.col("duration_delta_pct"))).alias("cause"))


@query
def refresh_duration(spark, sf):
    feed = refreshes.dataset_refreshes(fx.dataset_feed(spark, sf))
    return feed.select("request_id", seconds_between(F.col("start_time"), F.col("end_time")).alias("seconds"))


@query
def safe_key(spark, sf):
    return fx.table(spark, sf, "part").select("p_partkey", text.safe_key(F.concat_ws(" / ", "p_name", "p_brand")).alias("key"))


@query
def identity_hash(spark, sf):
    padded = F.concat(F.lit(" "), "c_name", F.lit("  "))
    return fx.table(spark, sf, "customer").select(
        "c_custkey", text.identity_hash(padded, trim=True).alias("user_hash"),
        text.identity_hash(padded).alias("tenant_hash"))


@query
def identity_select(spark, sf):
    k = F.col("c_custkey")
    user, source = classify.identity_select(
        F.when(k % 3 == 0, F.col("c_name")).otherwise(" "), F.when(k % 3 == 1, F.concat("c_name", F.lit(" "))),
        F.when(k % 2 == 0, F.lit("env-user")), k % 5 != 0)
    return fx.table(spark, sf, "customer").select(k, user.alias("user_id"), source.alias("source"))


@query
def delivery_status(spark, sf):
    return delivery.attempts_with_status(fx.attempts(spark, sf)).select("attempt_id", "status")


# --- 2.6 the impact report ------------------------------------------------------------


@query
def skip_reason(spark, sf):
    return skips(spark, sf).select(*ITEM, "item_type", "skip_reason")


@query
def filter_migrating(spark, sf):
    return impact.relevant(all_calls(spark, sf)).select(*ITEM, "m_function", "connector_kind", "migration", "custom_dsn")


@query
def artifact_worst_risk(spark, sf):
    return artifact_rows(spark, sf).select(*ITEM, "worst_risk")


@query
def artifact_connectors(spark, sf):
    return impact.connectors_in_order(all_calls(spark, sf), ORDER).select(
        *ITEM, "connector_kind", *_long("position"))


@query
def artifact_migrating(spark, sf):
    return artifact_rows(spark, sf, everything=True).select(*ITEM, "has_migrating", "calls")


@query
def counts_by_risk(spark, sf):
    return impact.counts_by_risk(artifact_rows(spark, sf))


@query
def counts_by_risk_per_workspace(spark, sf):
    return impact.counts_by_risk(artifact_rows(spark, sf), ["workspace_id"])


@query
def counts_by_connector(spark, sf):
    return impact.counts_by_connector(all_calls(spark, sf))


@query
def counts_by_migration(spark, sf):
    return impact.counts_by_migration(all_calls(spark, sf))


@query
def counts_grouping_sets(spark, sf):
    return impact.counts_by_both(all_calls(spark, sf))


@query
def scan_totals(spark, sf):
    return impact.scan_totals(artifact_rows(spark, sf), skips(spark, sf), flat_connections(spark, sf))


@query
def pinned_at_risk(spark, sf):
    return impact.pinned_at_risk(artifact_rows(spark, sf))


@query
def skipped_by_reason(spark, sf):
    return impact.skipped_by_reason(skips(spark, sf))


@query
def coverage(spark, sf):
    return impact.coverage(fx.plain_items(spark, sf), ["workspace_id"]).withColumn(
        "score_pct", F.col("score_pct").cast("bigint"))


@query
def filtered_report(spark, sf):
    return impact.filtered_calls(risky(spark, sf, everything=True), ["needs_review", "will_fail"]).select(
        *ITEM, "m_function", "risk")


@query
def filtered_items(spark, sf):
    return impact.filtered_artifacts(
        fx.plain_items(spark, sf), risky(spark, sf, everything=True), "ready").select(*ITEM, "item_type")


@query
def toolbar_counts(spark, sf):
    return impact.toolbar_counts(risky(spark, sf, everything=True))


@query
def kpi_cards(spark, sf):
    return impact.kpi_cards(artifact_rows(spark, sf), fx.plain_items(spark, sf)).withColumn(
        "score_pct", F.col("score_pct").cast("bigint"))


@query
def connector_groups(spark, sf):
    return impact.connector_groups_of_items(all_calls(spark, sf), fx.gateways(spark, sf))


@query
def hidden_count(spark, sf):
    return impact.hidden_count(all_calls(spark, sf))


@query
def connections_top10(spark, sf):
    return impact.connections_top(flat_connections(spark, sf))


@query
def tenant_rollup(spark, sf):
    return estate.scan_export(fx.scanner_payloads(spark, sf))


@query
def inventory_by_type(spark, sf):
    return impact.inventory_by_type(fx.plain_items(spark, sf))


# --- 2.7 validation -------------------------------------------------------------------


@query
def validation_scope(spark, sf):
    return validation.validation_scope(
        artifact_rows(spark, sf, everything=True), only_migrating=True).select(*ITEM)


@query
def last_refresh_before(spark, sf):
    return validation.last_refresh_before(fx.refresh_history(spark, sf), fx.cutover()).select(
        *ITEM, "pre.request_id", "pre.status", "pre.start_time")


@query
def first_terminal_after(spark, sf):
    h = fx.refresh_history(spark, sf)
    before = validation.last_refresh_before(h, fx.cutover())
    return validation.first_terminal_after(h, before, fx.cutover(), fx.WAIT_MINUTES).select(
        *ITEM, "post.request_id", "post.status", "post.start_time")


@query
def refreshes_around(spark, sf):
    """Ten cutovers per item, a day apart."""
    cutovers = fx.validation_items(spark, sf).select(
        "workspace_id", "item_id", F.explode(F.sequence(F.lit(-4), F.lit(5))).alias("d")).select(
        "workspace_id", "item_id", (fx.cutover() + F.make_dt_interval(F.col("d"))).alias("cutover"))
    rows = validation.refreshes_around(cutovers, fx.refresh_history(spark, sf), fx.WAIT_MINUTES)
    return rows.select(*ITEM, "cutover", F.col("pre.request_id").alias("pre_request"), F.col("post.request_id").alias("post_request"),
                       F.col("post.status").alias("post_status"))


@query
def no_new_refresh(spark, sf):
    return validation.validate(
        fx.validation_items(spark, sf), fx.refresh_history(spark, sf), fx.cutover(), trigger_refresh=False,
    ).select(*ITEM, "status", "reason", F.col("post.request_id").alias("request_id"))


@query
def validation_status(spark, sf):
    return fx.validation_results(spark, sf).select(*ITEM, "item_type", "status")


@query
def duration_delta(spark, sf):
    return fx.validation_results(spark, sf).select(*ITEM, "duration_delta_pct")


@query
def failure_reason(spark, sf):
    return fx.validation_results(spark, sf).select(*ITEM, "reason", "diagnosis_issue")


@query
def refresh_error_lookup(spark, sf):
    h = fx.refresh_history(spark, sf)
    asked = h.filter("status = 'Failed'").select(*ITEM, "request_id")
    return validation.refresh_errors(h, asked)


@query
def status_counts(spark, sf):
    return validation.status_counts(fx.validation_results(spark, sf))


@query
def issue_counts(spark, sf):
    return validation.issue_counts(fx.validation_results(spark, sf))


@query
def preferred_call(spark, sf):
    return validation.preferred_calls(all_calls(spark, sf), ORDER).select(
        *ITEM, "connector_kind", "m_function", "is_migrating")


@query
def validation_groups(spark, sf):
    preferred = validation.preferred_calls(all_calls(spark, sf), ORDER)
    return validation.validation_groups(
        validation.validation_rows(fx.validation_results(spark, sf), preferred)
    ).withColumn("group_rank", F.col("group_rank").cast("bigint"))


@query
def recent_refreshes(spark, sf):
    return validation.recent_refreshes(fx.refresh_history(spark, sf), 5).select(
        *ITEM, "request_id", *_long("entry_no"))


# --- 2.8 run state ----------------------------------------------------------------------

STATE = ["workspace_id", "tenant_hash"]


@query
def first_run_baseline(spark, sf):
    return runstate.first_run_baseline(fx.scans(spark, sf)).drop("first_counts_by_connector")


@query
def run_count(spark, sf):
    return runstate.with_run_count(fx.scans(spark, sf)).select(*STATE, "run_id", "run_count", "is_first_run")


@query
def baseline_identity_guard(spark, sf):
    o = F.col("o_orderkey")
    stored = fx.table(spark, sf, "orders").select(
        o.alias("state_id"), (o % 3).alias("schema_version"),
        F.concat(F.lit("ws-"), "o_custkey").alias("asked_workspace_id"),
        F.when(o % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("ws-"), F.col("o_custkey") + F.when(o % 7 == 0, 1).otherwise(0))).alias("workspace_id"),
        F.lit("t").alias("asked_tenant_hash"), F.when(o % 11 == 0, F.lit("u")).otherwise("t").alias("tenant_hash"))
    return runstate.guard_states(stored).select("state_id", "schema_version", "workspace_id")


@query
def baseline_merge(spark, sf):
    base = runstate.first_run_baseline(fx.scans(spark, sf)).select(*STATE, "first_run_id", "last_run_at")
    wrote = base.filter(F.col("first_run_id") % 4 != 0).select(
        *STATE, F.lit(-1).cast("bigint").alias("first_run_id"), "last_run_at", (F.col("first_run_id") % 3).alias("schema_version"))
    return runstate.merge_states(base.withColumn("schema_version", F.lit(1).cast("bigint")), wrote)


@query
def resolved_deltas(spark, sf):
    return runstate.resolved(fx.states(spark, sf)).select(*STATE, "run_id", *runstate.RESOLVED)


@query
def resolved_by_connector(spark, sf):
    return runstate.resolved_by_connector(fx.states(spark, sf))


@query
def days_since_first(spark, sf):
    days = runstate.days_since_first(F.col("first_run_at"), F.col("ts"), F.col("is_first_run"))
    return fx.states(spark, sf).select(*STATE, "run_id", days.alias("days"))


@query
def hours_saved(spark, sf):
    return fx.scans(spark, sf).select("run_id", runstate.hours_saved(F.col("inspected_artifacts")).alias("hours"))


@query
def scan_event(spark, sf):
    """The run id is read before the bag is taken apart, so that no bag travels with each of its properties."""
    log = fx.scan_log(spark, sf).select(F.element_at("custom_dimensions", F.lit("run_id")).alias("run_id"), "custom_dimensions")
    return log.select("run_id", F.explode_outer("custom_dimensions").alias("key", "value")).filter("key IS NOT NULL")


@query
def validation_event(spark, sf):
    return fx.validation_log(spark, sf).select(
        F.element_at("custom_dimensions", F.lit("workspace_id")).alias("workspace_id"),
        F.explode("custom_dimensions").alias("key", "value"))


@query
def opt_out_filter(spark, sf):
    return runstate.without_opted_out(
        fx.scans(spark, sf), fx.opt_outs(spark, sf, 50), fx.opt_outs(spark, sf, 75)).select("workspace_id", "run_id")


@query
def last_n_log(spark, sf):
    log = delivery.attempts_with_status(fx.attempts(spark, sf))
    return delivery.last_n(log, fv.SEND_HISTORY_CAP, by=["store"]).select("store", "attempt_id", "status")


@query
def last_n_log_all(spark, sf):
    log = delivery.attempts_with_status(fx.attempts(spark, sf))
    return delivery.last_n(log, fv.SEND_LOG_CAP).select("attempt_id", "status")


@query
def pending_retries(spark, sf):
    log = delivery.attempts_with_status(fx.attempts(spark, sf))
    return delivery.pending_retries(log).select("envelope_id", "attempt_id", "status")


@query
def delivery_health(spark, sf):
    return delivery.delivery_health(delivery.attempts_with_status(fx.attempts(spark, sf)))


@query
def baseline_reset(spark, sf):
    states = runstate.with_reset_state(fx.scans(spark, sf), fx.resets(spark, sf))
    return states.select(*STATE, "epoch", "run_id", "run_count", "first_run_id")


@query
def session_rollup(spark, sf):
    return runstate.session_rollup(fx.scans(spark, sf))


# --- 2.9 event-log questions ---------------------------------------------------------


@query
def adoption_30d(spark, sf):
    return events.adoption(fx.facts(spark, sf), as_of=fx.newest_scan(spark, sf))


@query
def adoption_approx(spark, sf):
    """Spans answered from a stored table of daily sketches, beside the exact counts: within 5 % or not."""
    kinds = {"tenants": "tenant_hash", "workspaces": "workspace_id"}
    facts, folder = fx.facts(spark, sf).select("timestamp", *kinds.values()), work_folder(spark)
    committed.write(events.daily_sketches(facts, **kinds), folder)
    sketches = committed.read(spark, folder)
    last_day = F.date_trunc("day", facts.agg(F.max("timestamp")).scalar())
    spans = []
    for days in (30, 365, 20000):
        exact = events.distinct_counts(facts.filter(F.date_trunc("day", "timestamp") > last_day - F.make_dt_interval(F.lit(days))), [], **kinds)
        near = events.counts_from_sketches(sketches, list(kinds), days)
        both = near.select(F.lit(days).cast("bigint").alias("days"), "scans", *[
            (F.abs(F.col(c) - exact.select(c).scalar()) <= 0.05 * exact.select(c).scalar()).alias(f"{c}_close") for c in kinds])
        spans.append(both.withColumn("tenants", exact.select("tenants").scalar()).withColumn("workspaces", exact.select("workspaces").scalar()))
    return spans[0].unionByName(spans[1]).unionByName(spans[2])


@query
def tenant_usage(spark, sf):
    return events.tenant_usage(fx.facts(spark, sf))


@query
def first_run_impact(spark, sf):
    return events.first_run_impact(fx.facts(spark, sf))


@query
def improvement(spark, sf):
    return events.improvement(fx.facts(spark, sf))


@query
def connector_mix(spark, sf):
    return events.connector_mix(fx.facts(spark, sf), as_of=fx.newest_scan(spark, sf))


@query
def stay_at_risk(spark, sf):
    return events.stay_at_risk(fx.facts(spark, sf), as_of=fx.newest_scan(spark, sf))


@query
def top_issues(spark, sf):
    log = fx.validation_log(spark, sf)
    return events.top_issues(log.filter(F.col("name") == fv.VALIDATION_EVENT))


@query
def reach_from_log(spark, sf):
    return events.reach(events.typed_scans(fx.scan_log(spark, sf)))


@query
def resolved_connectors_from_log(spark, sf):
    return events.resolved_connector_rollup(events.typed_scans(fx.scan_log(spark, sf)))


@query
def reach(spark, sf):
    return events.reach(fx.facts(spark, sf))


@query
def resolution_rollup(spark, sf):
    return events.resolution_rollup(fx.facts(spark, sf))


@query
def value_rollup(spark, sf):
    return events.value_rollup(fx.facts(spark, sf))


@query
def daily_trend(spark, sf):
    return events.daily_trend(fx.facts(spark, sf), as_of=fx.newest_scan(spark, sf)).withColumn("day", F.col("day").cast("timestamp_ntz"))


@query
def version_adoption(spark, sf):
    return events.version_adoption(fx.facts(spark, sf))


@query
def workspace_progress(spark, sf):
    return events.workspace_progress(fx.facts(spark, sf))


@query
def workspace_progress_returning(spark, sf):
    return events.workspace_progress(fx.facts(spark, sf), returning=True)


@query
def skip_reason_rollup(spark, sf):
    return events.skip_reason_rollup(fx.facts(spark, sf))


@query
def backend_split(spark, sf):
    return events.backend_split(fx.facts(spark, sf))


@query
def first_vs_return(spark, sf):
    return events.first_vs_return(fx.facts(spark, sf))


@query
def first_vs_return_by_version(spark, sf):
    return events.first_vs_return(fx.facts(spark, sf), by_version=True)


@query
def pins_resolved_daily(spark, sf):
    return events.pins_resolved_daily(fx.facts(spark, sf)).withColumn("day", F.col("day").cast("timestamp_ntz"))


@query
def resolved_connector_rollup(spark, sf):
    return events.resolved_connector_rollup(fx.facts(spark, sf))


@query
def hours_daily(spark, sf):
    return events.hours_daily(fx.facts(spark, sf)).withColumn("day", F.col("day").cast("timestamp_ntz"))


@query
def hours_30d(spark, sf):
    return events.hours_30d(fx.facts(spark, sf)).withColumn("bin_start", F.col("bin_start").cast("timestamp_ntz"))


@query
def duration_percentiles(spark, sf):
    return events.duration_percentiles(fx.facts(spark, sf)).withColumn("day", F.col("day").cast("timestamp_ntz"))


@query
def validation_outcomes(spark, sf):
    return events.validation_outcomes(fx.validation_log(spark, sf))


@query
def days_to_return(spark, sf):
    return events.days_to_return(fx.facts(spark, sf))


@query
def volume_30d(spark, sf):
    return events.volume(fx.facts(spark, sf), as_of=fx.newest_scan(spark, sf)).withColumn("day", F.col("day").cast("timestamp_ntz"))


@query
def traffic_latest(spark, sf):
    return events.traffic_latest(fx.traffic_log(spark, sf))


@query
def traffic_trend(spark, sf):
    return events.traffic_trend(fx.traffic_log(spark, sf))


@query
def release_downloads(spark, sf):
    return events.release_downloads(fx.traffic_log(spark, sf))


@query
def release_totals(spark, sf):
    return events.release_totals(fx.releases(spark, sf))


@query
def top_referrers(spark, sf):
    wide = events.referrers_wide(fx.referrers(spark, sf))
    return events.referrers_long(wide).select(*_long("position"), "referrer", "count")


@query
def clones_wide(spark, sf):
    return events.clones_wide(fx.daily_clones(spark, sf))


@query
def clones_patch(spark, sf):
    direct = fx.daily_clones(spark, sf).agg(F.sum("count").alias("count"), F.max("uniques").alias("uniques"))
    return events.clones_patch(events.traffic_latest(fx.traffic_log(spark, sf)), direct)


# --- 2.11 streams -----------------------------------------------------------------------


def _order_events(spark: SparkSession, sf) -> DataFrame:
    return streams.read_table(spark, sf, "orders").select(
        F.col("o_orderdate").cast("timestamp").alias("timestamp"),
        F.concat(F.lit("ws-"), "o_custkey").alias("workspace_id"),
        F.col("o_orderkey").alias("run_id"),
        "o_orderpriority")


@query
def stream_daily_trend(spark, sf):
    return streams.drain(streams.daily_trend(_order_events(spark, sf), "1 day"), "update", ["day"]).select(
        *_ntz("day"), "scans")


@query
def stream_dedup_events(spark, sf):
    sent = _order_events(spark, sf).withColumn("attempt", F.explode(F.sequence(F.lit(0), (F.col("run_id") % 3).cast("int"))))
    return streams.drain(streams.dedup_events(sent.drop("attempt"))).select("run_id", "workspace_id")


@query
def stream_latest_run(spark, sf):
    """Stored states of the older scans, the newer ones as a stream on top of them."""
    keys, payload = ["workspace_id"], ["run_id", "o_orderpriority"]
    scans = _order_events(spark, sf).withColumnRenamed("timestamp", "ts")
    older = fx.table(spark, sf, "orders").select(
        F.concat(F.lit("ws-"), "o_custkey").alias("workspace_id"), F.col("o_orderkey").alias("run_id"), "o_orderpriority",
        F.col("o_orderdate").cast("timestamp").alias("ts")).filter(F.year("ts") < 1995)
    folder = work_folder(spark)
    streams.upsert_states(scans.filter(F.year("ts") >= 1995), folder, keys, payload)
    states = streams.stored_states(spark, folder, keys, streams.run_states(older, keys, payload))
    return streams.latest_run(states, keys).select(
        "workspace_id", "run_id", "o_orderpriority", *_ntz("first_run_at", "last_run_at"), "run_count")


@query
def stream_first_terminal(spark, sf):
    rows = streams.read_table(spark, sf, "events")
    switches = rows.filter("event_type = 'purchase'").select(
        "user_id", F.col("ts").cast("timestamp").alias("switch_time"))
    finished = rows.select(
        "user_id", F.col("ts").cast("timestamp").alias("start_time"), F.col("event_id").alias("request_id"),
        F.when(F.col("event_type") == "error", F.lit("Failed")).when(F.col("event_type") == "signup", F.lit("Disabled"))
        .when(F.col("event_type") == "click", F.lit("Completed")).otherwise("InProgress").alias("status"))
    clock, ticks = streams.start_clock(spark)
    out = streams.first_terminal(switches, finished, ["user_id"], wait_minutes=720, clock=clock)
    until = fx.table(spark, sf, "events").agg(F.max("ts") + F.make_dt_interval(F.lit(1))).first()[0]
    return streams.drain(out, ticks=ticks, until=until).select("user_id", *_ntz("switch_time", "start_time"), "request_id", "outcome")


@query
def stream_late_rows(spark, sf):
    """Newer scans come first, then older ones: those behind the watermark are dropped, and counted."""
    arrived = f"{work_folder(spark)}/arrived"
    schema = "timestamp timestamp, run_id bigint"
    scans = fx.table(spark, sf, "orders").select(F.col("o_orderdate").cast("timestamp").alias("timestamp"), F.col("o_orderkey").alias("run_id"))
    scans.limit(0).write.parquet(arrived)
    reports = f"{work_folder(spark)}/reports"
    listener = metrics.LateRows(spark, reports)
    sent = spark.readStream.schema(schema).parquet(arrived)
    spark.streams.addListener(listener)
    try:
        for part in (F.year("timestamp") >= 1996, F.year("timestamp") < 1996):
            scans.filter(part).write.mode("append").parquet(arrived)
            run = streams.dedup_events(sent, lateness="500 days").writeStream.queryName("scans").format("noop").option(
                "checkpointLocation", f"{reports}-progress").trigger(availableNow=True).start()
            run.awaitTermination()
            listener.wait_for(str(run.runId))
    finally:
        spark.streams.removeListener(listener)
    return metrics.late_rows(spark, reports).select("stream", "input_rows", "dropped_rows")


@query
def stream_scan_calls(spark, sf):
    arriving = streams.read_table(spark, sf, "part").select(
        F.concat(F.lit("item-"), "p_partkey").alias("item_id"),
        fx.expression_text(F.col("p_partkey"), F.col("p_size"), F.col("p_brand")).alias("expression"))
    return streams.drain(streams.scan_calls(arriving)).select(
        "item_id", "m_function", "connector_kind", "migration", "implementation", "endpoint_hint")


# --- the whole report -----------------------------------------------------------------


@query
def estate_scan(spark, sf):
    """Definitions to risk counts per workspace, end to end."""
    definitions = fx.definitions(spark, sf).unionByName(
        fx.activity_definitions(spark, sf, readable_only=False))
    report = estate.scan_items(
        fx.plain_items(spark, sf), definitions, flat_connections(spark, sf), fx.datasources(spark, sf))
    return impact.counts_by_risk(report.artifacts, ["workspace_id"])


def scan_records(spark, sf) -> DataFrame:
    report = estate.ImpactReport(
        fx.plain_items(spark, sf), risky(spark, sf), artifact_rows(spark, sf), skips(spark, sf), flat_connections(spark, sf),
        served=frames.frame_expressions(fx.partition_frame(spark, sf), fx.shared_frame(spark, sf), ITEM))
    return record.scan_records(
        report, F.concat(F.lit("run-"), "workspace_id"), F.lit("2024-05-01").cast("timestamp"), F.lit("t1"))


@query
def scan_record(spark, sf):
    """A report as the scan record of each workspace; maps as sorted text."""
    def shown(name):
        pairs = F.transform(F.sort_array(F.map_entries(name)), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
        return F.array_join(pairs, ";").alias(name)

    return scan_records(spark, sf).select(
        "workspace_id", "run_id", "artifacts_scanned", "risk_high", "risk_medium", "risk_low", "risk_unknown", "risk_na",
        "total_calls", "migrating_artifacts", "pinned_odbc", "pinned_at_risk", "custom_dsn", "skipped_count",
        *_long("inspected_artifacts"), "coverage_score_pct", "fabric_connection_count",
        "scope", "sempy_hits", "fabric_connections_error", shown("counts_by_connector"), shown("skipped_by_reason"))


@query
def scan_record_events(spark, sf):
    """The same records through run state to log events: properties as rows."""
    facts = runstate.scan_facts(runstate.with_state(scan_records(spark, sf)))
    bags = runstate.scan_events(facts)
    wanted = ["workspace_id", "run_count", "is_first_run", "current_risk_high", "first_risk_high", "resolved_risk_high",
              "impacted_count", "skipped_count", "scope", "sempy_hits"]
    kept = F.map_filter("custom_dimensions", lambda k, v: k.isin(wanted))
    return bags.select(F.explode_outer(kept).alias("k", "v")).filter("k IS NOT NULL").groupBy(
        "k", "v").agg(F.count("*").alias("n"))


def tenant_report(spark, sf):
    return estate.scan_tenant(
        scanner.export_items(fx.scanner_payloads(spark, sf)), flat_connections(spark, sf))


@query
def tenant_scan(spark, sf):
    """The export's items with their worst risk and totals."""
    return tenant_report(spark, sf).artifacts.drop("has_gateway", "pinned_at_risk")


@query
def tenant_skips(spark, sf):
    return tenant_report(spark, sf).skips.select(*ITEM, "skip_reason")


@query
def tenant_coverage(spark, sf):
    return impact.coverage(tenant_report(spark, sf).items, ["workspace_id"]).withColumn(
        "score_pct", F.col("score_pct").cast("bigint"))
