"""Inputs in the library's shapes, derived by Spark from the given tables.

Every rule is integer arithmetic on keys, so the SQL twins can state the
expected rows without reading any derived text. Whole tables are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelens.catalog import fixed_values as fv
from estatelens.functions.numbers import rounded
from estatelens.functions.text import identity_hash
from estatelens.operators import runstate, validation
from estatelens.sources.items import gateway_states
from estatelens.sources.spread import spread

FUNCTIONS = [fn for _, fns, _, _ in fv.CONNECTOR_RULES for fn in fns] + [
    "Sql.Database", "Web.Contents", "Excel.Workbook", "Salesforce.Reports", "Odbc.DataSource",
]
KINDS = [kind for kind, _, _, _ in fv.CONNECTOR_RULES][:7]
ERROR_TEXTS = [
    "DataSource.Error: ADBC: driver not found",
    "ModelRefreshFailed_CredentialsNotSpecified",
    "HTTP 401 unauthorized",
    "Expression.Error: Type mismatch in step",
    "connection string is malformed",
    "The gateway is not reachable",
    "gateway driver mismatch",
    "DataSource.Error in ODBC layer",
    "proxy refused the tunnel",
    "Command timed out",
    "TLS handshake broke",
    "429 too many requests",
    "Dremio refused port 31010",
    "Unable to connect to the host",
    "something odd\nhappened",
    "",
]
CUTOVER = "2024-01-16 00:00:00"
WAIT_MINUTES = 2880


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def cutover():
    return F.lit(CUTOVER).cast("timestamp_ntz")


def _pick(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def documents(spark, sf) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")


# --- items and expressions -------------------------------------------------------


def items(spark, sf) -> DataFrame:
    k = F.col("p_partkey")
    kind = k % 10
    status = k % 37
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_size", "p_brand")
    return spread(part, "p_partkey").select(
        F.concat(F.lit("ws-"), k % 23).alias("workspace_id"),
        F.concat(F.lit("Workspace "), k % 23).alias("workspace_name"),
        F.concat(F.lit("item-"), k).alias("item_id"),
        F.col("p_name").alias("item_name"),
        F.when(kind <= 4, F.lit("SemanticModel")).when(kind <= 6, F.lit("Dataflow"))
        .when(kind == 7, F.lit("DataPipeline")).when(kind == 8, F.lit("Report"))
        .otherwise("Notebook").alias("item_type"),
        F.when(status == 0, F.lit("denied")).when(status == 1, F.lit("deleted"))
        .when(status == 2, F.lit("unavailable")).otherwise("ok").alias("fetch_status"),
        k.alias("k"),
        "p_size",
        "p_brand",
    )


def plain_items(spark, sf) -> DataFrame:
    return items(spark, sf).drop("k", "p_size", "p_brand")


def workspaces(spark, sf) -> DataFrame:
    return items(spark, sf).select("workspace_id", "workspace_name", ((F.col("k") % 23) % 5 == 0).alias("is_personal")).distinct()


def datasources(spark, sf) -> DataFrame:
    """Bound sources per dataset: two, one unbound, or an unreadable list."""
    k = F.col("k")
    rows = (
        F.when(k % 3 == 0, F.array(
            F.struct(F.lit(None).cast("string").alias("gateway_id"), F.lit(True).alias("readable")),
            F.struct(F.concat(F.lit("gw-"), k % 7).alias("gateway_id"), F.lit(True).alias("readable"))))
        .when(k % 3 == 1, F.array(
            F.struct(F.when(k % 2 == 0, F.lit("")).alias("gateway_id"), F.lit(True).alias("readable"))))
        .otherwise(F.array(
            F.struct(F.lit(None).cast("string").alias("gateway_id"), F.lit(False).alias("readable"))))
    )
    return items(spark, sf).select("workspace_id", "item_id", F.explode(rows).alias("d")).select(
        "workspace_id", "item_id", "d.*"
    )


def gateways(spark, sf) -> DataFrame:
    return gateway_states(plain_items(spark, sf), datasources(spark, sf), fv.DATASET_TYPES)


def expression_text(k, size, brand):
    """One M expression: a connector call with a pin and, by key, a trap."""
    pin, trap = F.floor(k / 10) % 3, F.floor(k / 30) % 4
    endpoint = F.when(k % 11 == 0, F.concat(F.lit("server="), brand, F.lit(";pwd=s3cret"))).otherwise(brand)
    head = (
        F.when(trap == 1, F.lit('// Snowflake.Databases("old", [Implementation = "1.0"])\n/* Oracle.Database("gone") */ let\n'))
        .when(trap == 2, F.lit('let\n    Note = "Sql.Database(""x"", [Implementation=""1.0""]) // kept",\n'))
        .otherwise("let\n")
    )
    first = F.when(
        trap == 3, F.concat(F.lit('SomeHelper.Get("'), endpoint, F.lit('", [Implementation = "2.0"])'))
    ).otherwise(F.concat(F.lit('"'), endpoint, F.lit('"')))
    option = F.when(pin == 0, F.lit("")).otherwise(
        F.concat(F.lit(', [Implementation = "'), pin, F.lit('.0"]'))
    )
    return F.concat(
        head, F.lit("    Source = "), _pick(FUNCTIONS, size % 26), F.lit("("), first, F.lit(', "db"'),
        option, F.lit("),\n    Rows = Table.SelectRows(Source, each [x] > 1)\nin\n    Rows"),
    )


def _with_text(spark, sf) -> DataFrame:
    k = F.col("k")
    return items(spark, sf).filter("item_type IN ('SemanticModel', 'Dataflow')").withColumn(
        "expression",
        F.when(k % 41 != 0, expression_text(k, F.col("p_size"), F.col("p_brand"))),
    )


def expressions(spark, sf) -> DataFrame:
    """One expression per readable model or dataflow."""
    return _with_text(spark, sf).filter("fetch_status = 'ok' AND expression IS NOT NULL").select(
        "workspace_id", "item_id", "item_type", F.lit(0).alias("part_idx"), F.lit(0).alias("expr_idx"),
        F.lit("Query").alias("expr_name"), "expression",
    )


# --- definitions ------------------------------------------------------------------


def _b64(text):
    return F.regexp_replace(F.base64(F.encode(text, "UTF-8")), "\\s", "")


def _envelope(path, payload):
    def part(p, body):
        return F.struct(p.alias("path"), body.alias("payload"), F.lit("InlineBase64").alias("payloadType"))

    parts = F.array(part(F.lit(".platform"), F.lit("e30=")), part(path, payload))
    return F.to_json(F.struct(F.struct(parts.alias("parts")).alias("definition")))


def _tmsl(table_name, expr, has_shared):
    def doc(expression, shared):
        m = F.struct(F.lit("P").alias("name"), F.struct(F.lit("m").alias("type"), expression.alias("expression")).alias("source"))
        t = F.struct(table_name.alias("name"), F.array(m).alias("partitions"))
        calc = F.struct(F.lit("C").alias("name"), F.array(F.struct(
            F.lit("Calc").alias("name"),
            F.struct(F.lit("calculated").alias("type"), F.lit("Sql.Database(1)").alias("expression")).alias("source"),
        )).alias("partitions"))
        shared_rows = F.array(F.struct(
            F.lit("Param").alias("name"),
            F.lit('"x" meta [IsParameterQuery=true]').alias("expression"),
        ))
        tables = F.to_json(F.array(t))
        calcs = F.to_json(F.array(calc))
        body = F.concat(
            F.lit('{"model":{"tables":['), F.substring(tables, F.lit(2), F.length(tables) - 2),
            F.lit(","), F.substring(calcs, F.lit(2), F.length(calcs) - 2), F.lit("]"),
        )
        tail = F.concat(F.lit(',"expressions":'), F.to_json(shared_rows), F.lit("}}")) if shared else F.lit("}}")
        return F.concat(body, tail)

    empty = F.lit('{"model":{"tables":[]}}')
    return F.when(expr.isNull(), empty).when(has_shared, doc(F.split(expr, "\n"), True)).otherwise(doc(expr, False))


def definitions(spark, sf) -> DataFrame:
    """Envelope JSON per model or dataflow, in four document forms."""
    k, expr = F.col("k"), F.col("expression")
    kind = k % 10
    table_name = F.concat(F.lit("T"), k)
    tmdl = F.concat(
        F.lit("table "), table_name, F.lit("\n\n\tpartition P = m\n\t\tmode: import\n\t\tsource =\n"),
        F.regexp_replace(expr, "(?m)^", "\t\t\t\t"), F.lit("\n\nannotation X = 1\n"),
    )
    tmdl = F.coalesce(tmdl, F.concat(F.lit("table "), table_name, F.lit("\n")))
    pq = F.coalesce(F.concat(F.lit("section Section1;\nshared Query = "), expr, F.lit(";")), F.lit(""))
    mashup = F.struct(F.when(k % 4 == 2, _b64(expr)).otherwise(expr).alias("document"))
    gen1 = F.to_json(F.struct(
        F.lit("m").alias("name"), F.struct(mashup.alias("inner")).alias("pbi:mashup"),
        F.array(F.lit("let x = Source")).alias("list"), F.lit(1).alias("n"),
    ))
    is_bim = kind.isin(0, 2, 4)
    path = (
        F.when(is_bim, F.lit("model.bim")).when(kind < 5, F.lit("definition/T.tmdl"))
        .when(kind == 5, F.lit("Mashup.pq")).otherwise("Model.json")
    )
    text = (
        F.when(is_bim, _tmsl(table_name, expr, k % 4 == 0)).when(kind < 5, tmdl)
        .when(kind == 5, pq).otherwise(gen1)
    )
    docs = _with_text(spark, sf).select("workspace_id", "item_id", "item_type", path.alias("path"), text.alias("text"))
    return docs.select("workspace_id", "item_id", "item_type", _envelope(F.col("path"), _b64(F.col("text"))).alias("definition"))


def scanner_payloads(spark, sf) -> DataFrame:
    """Export documents: at most a hundred items of one workspace per document."""
    k, expr = F.col("k"), F.col("expression")
    named = F.struct(F.lit("q").alias("name"), F.when(k % 4 == 1, expr).alias("mCode"), F.when(k % 4 != 1, expr).alias("M"))
    dataset = F.to_json(F.struct(
        F.col("item_id").alias("id"), F.col("item_name").alias("name"),
        F.array(F.struct(F.lit("T").alias("name"), F.array(F.struct(expr.alias("expression"))).alias("source"))).alias("tables"),
        F.array(F.struct(F.lit("P").alias("name"), F.lit("").alias("expression"))).alias("expressions"),
    ))
    dataflow = F.to_json(F.struct(
        F.col("item_id").alias("objectId"), F.col("item_name").alias("name"), F.array(named).alias("queries"),
    ))
    is_flow = F.col("item_type") == "Dataflow"
    per_doc = _with_text(spark, sf).groupBy(
        "workspace_id", "workspace_name", F.floor(k / 2300).alias("chunk")
    ).agg(
        F.array_join(F.collect_list(F.when(~is_flow, dataset)), ",").alias("ds"),
        F.array_join(F.collect_list(F.when(is_flow, dataflow)), ",").alias("df"),
    )
    return per_doc.select(F.concat(
        F.lit('{"id":"'), "workspace_id", F.lit('","name":"'), "workspace_name",
        F.lit('","datasets":['), "ds", F.lit('],"dataflows":['), "df", F.lit("]}"),
    ).alias("payload"))


def partition_frame(spark, sf) -> DataFrame:
    """Partition rows as one library version names them; one in three models has some."""
    return _with_text(spark, sf).filter("item_type = 'SemanticModel' AND k % 3 = 0").select(
        "workspace_id", "item_id", "item_type",
        F.concat(F.lit("T"), "k").alias("Table Name"),
        F.when(F.col("k") % 2 == 0, F.lit("P")).otherwise("").alias("Partition Name"),
        F.when(F.col("k") % 5 == 0, F.lit("Calculated")).otherwise("M").alias("Source Type"),
        F.col("expression").alias("Source Expression"),
    )


def shared_frame(spark, sf) -> DataFrame:
    return _with_text(spark, sf).filter("item_type = 'SemanticModel' AND k % 6 = 0").select(
        "workspace_id", "item_id", "item_type", F.lit("Param").alias("Name"),
        F.when(F.col("k") % 12 == 0, F.lit("  ")).otherwise(F.lit('"x" meta []')).alias("Expression"),
    )


# --- activity documents and connections -----------------------------------------

_WRAPS = 9


def activity_definitions(spark, sf, readable_only=True) -> DataFrame:
    """Documents of orchestration items: copy, lookup, or nested containers."""
    j = F.floor(F.col("k") / 10)
    cid = F.when(j % 6 == 0, F.concat(F.lit("missing-"), "k")).otherwise((j % 10).cast("string"))

    def text(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    copy = text(
        '{"name":"Copy1","type":"Copy","typeProperties":{"source":{"type":"T","datasetSettings":'
        '{"externalReferences":{"connection":"', cid,
        '"}}},"sink":{"connectionReference":{"connectionId":"', cid, '"}}}}',
    )
    lookup = text(
        '{"name":"Lookup1","type":"Lookup","typeProperties":{"dataset":{"linkedService":{"properties":'
        '{"type":"AzureDatabricks.Tables","typeProperties":{}}}},"linkedService":{"referenceName":"', cid, '"}}}',
    )
    script = text('{"name":"Script1","type":"Script","typeProperties":{"connectionReference":{"connectionId":"', cid, '"}}}')
    web = '{"name":"Web1","type":"WebActivity","typeProperties":{"url":"x"}}'
    nested = text(
        '{"name":"Each","type":"ForEach","typeProperties":{"activities":[{"name":"If","type":"IfCondition",'
        '"typeProperties":{"ifTrueActivities":[', script, '],"ifFalseActivities":[', web, ',7]}}]}},'
        '{"name":"Pick","type":"Switch","typeProperties":{"cases":[{"activities":[', script,
        ']}],"defaultActivities":[', web, "]}}",
    )
    wrap = '{"name":"Deep","type":"Until","typeProperties":{"activities":['
    deep = text(wrap * _WRAPS, script, "]}}" * _WRAPS)
    body = F.when(j % 3 == 0, copy).when(j % 3 == 1, lookup).when(j % 4 == 0, deep).otherwise(nested)
    doc = text('{"properties":{"activities":[', body, "]}}")
    kept = "item_type = 'DataPipeline'" + (" AND fetch_status = 'ok'" if readable_only else "")
    return items(spark, sf).filter(kept).select(
        "workspace_id", "item_id", "item_type",
        _envelope(F.lit("pipeline-content.json"), _b64(doc)).alias("definition"),
    )


def raw_connections(spark, sf) -> DataFrame:
    s = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        s.cast("string").alias("id"),
        F.col("s_name").alias("displayName"),
        F.when(s % 3 == 0, F.lit("OnPremisesGateway")).when(s % 3 == 1, F.lit("ShareableCloud")).alias("connectivityType"),
        F.when(F.col("s_nationkey") % 2 == 0, F.concat(F.lit("gw-"), "s_nationkey")).alias("gatewayId"),
        F.struct(
            F.when(s % 10 != 9, _pick(FUNCTIONS, s % 26)).alias("type"),
            F.concat(F.lit("host-"), s).alias("path"),
        ).alias("connectionDetails"),
        F.concat(F.lit("tenant-"), s % 4).alias("tenant_id"),
    )


# --- refreshes ----------------------------------------------------------------------


def refresh_history(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    n = F.get_json_object("props", "$.k").cast("int")
    status = (
        F.when(F.col("event_type") == "error", F.lit("Failed")).when(F.col("event_type") == "signup", F.lit("Disabled"))
        .when(F.col("event_type") == "view", F.lit("InProgress")).otherwise("Completed")
    )
    return e.select(
        F.concat(F.lit("ws-"), F.col("user_id") % 23).alias("workspace_id"),
        F.concat(F.lit("item-"), "user_id").alias("item_id"),
        F.col("event_id").cast("string").alias("request_id"),
        status.alias("status"),
        F.col("ts").alias("start_time"),
        F.timestamp_add("SECOND", F.floor("value").cast("int"), F.col("ts")).alias("end_time"),
        F.when(F.col("event_type") == "error", _pick(ERROR_TEXTS, n % 16)).alias("error_text"),
    )


def dataset_feed(spark, sf) -> DataFrame:
    iso = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
    return refresh_history(spark, sf).select(
        "workspace_id", "item_id", F.col("request_id").alias("requestId"), "status",
        F.date_format("start_time", iso).alias("startTime"), F.date_format("end_time", iso).alias("endTime"),
        F.col("error_text").alias("serviceExceptionJson"),
    )


def job_feed(spark, sf) -> DataFrame:
    """The same entries as the job feed writes them: failure as object or bare string."""
    iso = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
    n = F.col("request_id").cast("bigint") % 3
    reason = (
        F.when(n == 0, F.to_json(F.struct(F.col("error_text").alias("message"), F.lit("E1").alias("errorCode"))))
        .when(n == 1, F.to_json(F.struct(F.lit("").alias("message"), F.lit("E2").alias("errorCode"))))
        .otherwise(F.col("error_text"))
    )
    return refresh_history(spark, sf).select(
        "workspace_id", "item_id", F.col("request_id").alias("id"), "status",
        F.date_format("start_time", iso).alias("startTimeUtc"), F.date_format("end_time", iso).alias("endTimeUtc"),
        F.when(F.col("status") == "Failed", reason).alias("failureReason"),
    )


def validation_items(spark, sf) -> DataFrame:
    return items(spark, sf).select("workspace_id", "item_id", "item_type")


def triggers(spark, sf) -> DataFrame:
    return items(spark, sf).select("workspace_id", "item_id", (F.col("k") % 17 != 0).alias("accepted"))


def validation_results(spark, sf) -> DataFrame:
    return validation.validate(
        validation_items(spark, sf), refresh_history(spark, sf), cutover(), WAIT_MINUTES,
        triggers=triggers(spark, sf),
    )


# --- scans and events -------------------------------------------------------------


def scans(spark, sf) -> DataFrame:
    """Append-only scan table: one scan per order, counters from its lines."""
    flag, line_status, number = F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_linenumber")
    per_order = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.count_if(flag == "R").alias("risk_high"),
        F.count_if(flag == "A").alias("risk_medium"),
        F.count_if(flag == "N").alias("risk_low"),
        F.count_if((flag == "R") & (line_status == "O")).alias("pinned_at_risk"),
        F.count_if(line_status == "O").alias("pinned_odbc"),
        F.count_if(line_status == "F").alias("custom_dsn"),
        F.count_if(number <= 3).alias("migrating_artifacts"),
        F.count("*").alias("total_calls"),
        *[F.count_if(number == i).alias(f"n{i}") for i in range(1, 8)],
    )
    o, c = F.col("o_orderkey"), F.col("o_custkey")

    def count(name):
        return F.coalesce(F.col(name), F.lit(0).cast("bigint"))

    kinds = F.create_map(*[x for i, kind in enumerate(KINDS, start=1) for x in (F.lit(kind), count(f"n{i}"))])
    skipped = F.create_map(F.lit("permission_denied"), o % 4, F.lit("type_not_inspected"), o % 3)
    user = F.when(c % 97 == 0, F.lit("")).otherwise(
        F.concat(F.lit("user-"), c % 97, F.when(o % 5 == 0, F.lit("  ")).otherwise(""))
    )
    rows = (
        table(spark, sf, "orders")
        .join(per_order, o == F.col("l_orderkey"), "left")
        .join(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), c == F.col("c_custkey"))
    )
    return rows.select(
        F.concat(F.lit("ws-"), c).alias("workspace_id"),
        identity_hash(F.concat(F.lit("tenant-"), "c_nationkey")).alias("tenant_hash"),
        F.col("o_orderdate").alias("ts"),
        o.alias("run_id"),
        identity_hash(user, trim=True).alias("user_hash"),
        F.concat(F.lit("s-"), F.floor(o / 2)).alias("session_id"),
        F.col("o_orderpriority").alias("version"),
        F.when(F.col("o_orderstatus") == "O", F.lit("lakehouse")).when(F.col("o_orderstatus") == "F", F.lit("home"))
        .otherwise("memory").alias("state_backend"),
        rounded(F.col("o_totalprice") / 1000.0, 2).alias("duration_seconds"),
        *[count(x).alias(x) for x in (
            "risk_high", "risk_medium", "risk_low", "pinned_at_risk", "pinned_odbc", "custom_dsn",
            "migrating_artifacts", "total_calls")],
        F.lit(0).cast("bigint").alias("risk_unknown"),
        F.lit(0).cast("bigint").alias("risk_na"),
        F.map_filter(kinds, lambda k, v: v > 0).alias("counts_by_connector"),
        F.map_filter(skipped, lambda k, v: v > 0).alias("skipped_by_reason"),
        (count("total_calls") + o % 7).alias("inspected_artifacts"),
        ((o * 7) % 101).alias("coverage_score_pct"),
        (o % 3 == 0).alias("sempy_used"),
    )


def states(spark, sf) -> DataFrame:
    return runstate.with_state(scans(spark, sf))


def newest_scan(spark, sf):
    """The time of the newest scan, read from the one column that holds it."""
    return table(spark, sf, "orders").agg(F.max("o_orderdate")).scalar()


def resets(spark, sf) -> DataFrame:
    """Reset markers: a few scans of some workspaces."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    marked = table(spark, sf, "orders").filter((c % 29 == 0) & (o % 7 == 3))
    return marked.join(customers, c == F.col("c_custkey")).select(
        F.concat(F.lit("ws-"), c).alias("workspace_id"),
        identity_hash(F.concat(F.lit("tenant-"), "c_nationkey")).alias("tenant_hash"),
        F.col("o_orderdate").alias("ts"),
        o.alias("run_id"),
    )


def opt_outs(spark, sf, step: int) -> DataFrame:
    return table(spark, sf, "customer").select(
        F.concat(F.lit("ws-"), "c_custkey").alias("workspace_id"),
        (F.col("c_custkey") % step == 0).alias("telemetry_opt_out"),
    )


def facts(spark, sf) -> DataFrame:
    return runstate.scan_facts(states(spark, sf))


def scan_log(spark, sf) -> DataFrame:
    return runstate.scan_events(facts(spark, sf))


def validation_log(spark, sf) -> DataFrame:
    base = validation_items(spark, sf).select("workspace_id").distinct().select(
        "workspace_id", cutover().alias("ts"), F.lit("1").alias("version")
    )
    return runstate.validation_events(validation_results(spark, sf), base)


# --- deliveries ---------------------------------------------------------------------


def attempts(spark, sf) -> DataFrame:
    """Delivery attempts: one per event; several attempts share an envelope."""
    n = F.get_json_object("props", "$.k").cast("int")
    good, bad, html = '{"itemsReceived":1,"itemsAccepted":1,"errors":[]}', '{"itemsReceived":1,"itemsAccepted":0,"errors":[]}', "<!DOCTYPE html><html>"
    first = (
        F.when(n % 10 == 0, F.lit(None).cast("int")).when(n % 10 == 1, F.lit(429)).when(n % 10 == 2, F.lit(503))
        .when(n % 10 == 3, F.lit(500)).otherwise(200)
    )
    retry = F.when(n % 4 == 0, F.lit(None).cast("int")).when(n % 4 == 1, F.lit(429)).otherwise(200)
    body = (
        F.when(n % 7 == 0, F.lit(bad)).when(n % 7 == 1, F.lit(html)).when(n % 7 == 2, F.lit("not json"))
        .when(n % 7 == 3, F.lit('{"itemsReceived":2,"itemsAccepted":2,"errors":[{"index":0}]}')).otherwise(good)
    )
    return table(spark, sf, "events").select(
        F.col("event_id").alias("attempt_id"),
        F.floor(F.col("event_id") / 3).alias("envelope_id"),
        F.col("ts").alias("at"),
        first.alias("first_status"),
        retry.alias("retry_status"),
        body.alias("body"),
        F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("{"), "event_id", F.lit("}"))).alias("envelope"),
        F.concat(F.lit("home-"), F.col("user_id") % 5).alias("store"),
    )


# --- repository traffic ---------------------------------------------------------


def traffic_log(spark, sf) -> DataFrame:
    kind = F.col("event_type")
    per_day = table(spark, sf, "events").groupBy(F.date_trunc("day", "ts").alias("timestamp")).agg(
        F.count_if(kind == "click").alias("clones_14d"),
        F.count_distinct(F.when(kind == "click", F.col("user_id"))).alias("unique_cloners_14d"),
        F.count_if(kind == "view").alias("views_14d"),
        F.count_distinct(F.when(kind == "view", F.col("user_id"))).alias("unique_viewers_14d"),
        F.count_if(kind == "purchase").alias("release_downloads_v1_0"),
        F.count_if(kind == "error").alias("release_downloads_v1_1"),
        F.count_if(kind.isin("purchase", "error")).alias("total_release_downloads"),
        F.count_if(kind == "signup").alias("stargazers"),
    )
    names = [c for c in per_day.columns if c != "timestamp"]
    bag = F.create_map(*[x for c in names for x in (F.lit(c), F.col(c).cast("string"))])
    return per_day.select(
        F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), F.lit(fv.TRAFFIC_EVENT).alias("name"),
        bag.alias("custom_dimensions"),
    )


def daily_clones(spark, sf) -> DataFrame:
    return table(spark, sf, "events").filter("event_type = 'click'").groupBy(
        F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")
    ).agg(F.count("*").alias("count"), F.count_distinct("user_id").alias("uniques"))


def referrers(spark, sf) -> DataFrame:
    host = F.regexp_extract("url", r"^https?://([^/]+)", 1)
    return table(spark, sf, "pages").groupBy(host.alias("referrer")).agg(F.count("*").alias("count"))


def releases(spark, sf) -> DataFrame:
    """Nested releases: one per order, its lines as assets."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.collect_list(F.struct(
            F.col("l_linenumber").alias("id"), F.col("l_quantity").cast("bigint").alias("download_count")
        )).alias("assets")
    )
    o = table(spark, sf, "orders")
    tag = F.concat(F.lit("v"), F.year("o_orderdate"), F.lit("."), F.month("o_orderdate"))
    return o.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        tag.alias("tag_name"), F.concat(F.lit("release "), "o_orderkey").alias("name"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("published_at"),
        F.concat(F.lit("https://releases.test/"), "o_orderkey").alias("html_url"), "assets",
    )
