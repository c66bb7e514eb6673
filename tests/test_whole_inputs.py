"""Long documents, old entries, NULL keys, repeated ids: nothing is cut or lost."""

import base64
import datetime as dt
import json

from pyspark.sql import functions as F

from estatelens.functions import classify
from estatelens.operators import activities, extract, impact, running, validation
from estatelens.sources import scanner
from queryset import queries

LONG = 24_000_000


def test_long_payloads_keep_all_parts(spark):
    small = base64.b64encode(b"let a = 1").decode()
    envelope = F.concat(
        F.lit('{"definition": {"parts": [{"path": "a.m", "payload": "'), F.repeat(F.lit("QUFB"), LONG // 4),
        F.lit(f'"}}, {{"path": "b.m", "payload": "{small}"}}]}}}}'))
    df = spark.range(1).select("id", envelope.alias("definition"))
    rows = extract.definition_parts(df).select("path", F.length("text").alias("n")).collect()
    assert {r.path: r.n for r in rows} == {"a.m": LONG // 4 * 3, "b.m": 9}


def test_long_strings_in_models_walks_exports_and_activities(spark):
    long = F.repeat(F.lit("x"), LONG)
    df = spark.range(1)
    model = F.concat(F.lit('{"model": {"tables": [], "expressions": [{"name": "e", "expression": "'), long, F.lit('"}]}}'))
    entries = extract.tmsl_shared_entries(extract.model_json(model))
    assert df.select(F.length(entries[0]["expression"]).alias("n")).first().n == LONG
    walked = extract.keyed_strings(F.concat(F.lit('{"a": "'), long, F.lit('", "b": "let\\n"}')))
    assert df.select(F.transform(walked, lambda p: F.length(p["value"])).alias("n")).first().n == [LONG, 4]
    payload = F.concat(F.lit('{"id": "w", "dataflows": [{"objectId": "d", "queries": [{"name": "q", "mCode": "'), long, F.lit('"}]}]}'))
    items = scanner.export_items(df.select(payload.alias("payload")))
    assert [(r.item_id, r.n) for r in scanner.export_expressions(items).select(
        "item_id", F.length("expression").alias("n")).collect()] == [("d", LONG)]


def test_deep_activities_are_read(spark):
    node = {"name": "leaf", "type": "Script"}
    for i in range(300):
        node = {"name": f"n{i}", "type": "ForEach", "typeProperties": {"activities": [node]}}
    text = json.dumps({"properties": {"activities": [node]}})
    payload = base64.b64encode(text.encode()).decode()
    envelope = json.dumps({"definition": {"parts": [{"path": "pipeline-content.json", "payload": payload}]}})
    df = spark.createDataFrame([("i", envelope)], "item_id string, definition string")
    assert activities.flatten_activities(activities.activity_documents(df)).count() == 301


def containers(levels):
    node = {"name": "leaf", "type": "Script"}
    text = json.dumps(node)
    for i in range(levels):
        text = f'{{"name": "n{i}", "type": "ForEach", "typeProperties": {{"activities": [{text}]}}}}'
    return f'{{"properties": {{"activities": [{text}]}}}}'


def envelope_of(path, text):
    return json.dumps({"definition": {"parts": [{"path": path, "payload": base64.b64encode(text.encode()).decode()}]}})


def test_documents_nested_too_deeply_have_their_own_reason(spark):
    model = '{"model": {"expressions": [{"name": "e", "expression": ' + "[" * 5000 + "]" * 5000 + "}]}}"
    rows = [("w", "p400", "DataPipeline", envelope_of("pipeline-content.json", containers(400))),
            ("w", "p5000", "DataPipeline", envelope_of("pipeline-content.json", containers(5000))),
            ("w", "m5000", "SemanticModel", envelope_of("model.bim", model)),
            ("w", "bad", "DataPipeline", envelope_of("pipeline-content.json", "[" * 5000))]
    definitions = spark.createDataFrame(rows, "workspace_id string, item_id string, item_type string, definition string")
    assert activities.flatten_activities(activities.activity_documents(definitions)).groupBy("item_id").count().collect() == [("p400", 401)]
    assert sorted(r.item_id for r in extract.too_deep(definitions).collect()) == ["m5000", "p5000"]
    items = definitions.select("workspace_id", "item_id", F.col("item_id").alias("item_name"), "item_type", F.lit("ok").alias("fetch_status"))
    skips = impact.skip_reasons(items, definitions.limit(0), definitions.limit(0).select(
        "workspace_id", "item_id", F.lit("none").alias("migration"), F.lit(False).alias("custom_dsn")), too_deep=extract.too_deep(definitions))
    assert {r.item_id: r.skip_reason for r in skips.collect()} == {
        "p400": "definition_parsed_but_no_expressions", "bad": "definition_parsed_but_no_expressions",
        "p5000": "definition_nested_too_deeply", "m5000": "definition_nested_too_deeply"}


def test_a_deep_item_of_an_export_costs_nothing(spark):
    deep = "[" * 5000 + "]" * 5000
    payload = ('{"id": "w", "name": "ws", "datasets": [{"id": "a", "name": "A", "x": ' + deep + '}, {"id": "b", "expressions": '
               '[{"name": "e", "expression": "let x = 1"}]}], "dataflows": [{"objectId": "c", "name": "C", "queries": [{"name": "q", "M": "let y = 2"}]}]}')
    items = scanner.export_items(spark.createDataFrame([(payload,)], "payload string"))
    assert [(r.workspace_id, r.item_id, r.item_name, r.item_type) for r in items.collect()] == [
        ("w", "a", "A", "SemanticModel"), ("w", "b", "", "SemanticModel"), ("w", "c", "C", "Dataflow")]
    assert [(r.item_id, r.expr_name, r.expression) for r in scanner.export_expressions(items).collect()] == [
        ("b", "shared:e", "let x = 1"), ("c", "q", "let y = 2")]


def test_error_of_an_old_request(spark):
    day = dt.datetime(2024, 1, 1)
    history = spark.createDataFrame(
        [("w", "i", f"r{n}", day + dt.timedelta(days=n), day, "Failed", f"err{n}") for n in range(8)],
        "workspace_id string, item_id string, request_id string, start_time timestamp, end_time timestamp, status string, error_text string")
    asked = spark.createDataFrame([("w", "i", "r0"), ("w", "i", None), ("w", "i", "other")],
                                  "workspace_id string, item_id string, request_id string")
    got = {r.request_id: r.error for r in validation.refresh_errors(history, asked).collect()}
    assert got == {"r0": "err0", None: "err7", "other": "err7"}


def test_null_keys_are_keys(spark):
    rows = [("w", None, 1), ("w", None, 2), ("w", "t", 1), (None, None, 5)]
    df = spark.createDataFrame(rows, "workspace_id string, tenant_hash string, n int").withColumn(
        "ts", F.make_timestamp(F.lit(2024), F.lit(1), F.col("n"), F.lit(0), F.lit(0), F.lit(0)))
    got = running.running_count(df, ["workspace_id", "tenant_hash"], ["ts"], "c").collect()
    assert sorted((str(r.workspace_id), str(r.tenant_hash), r.c) for r in got) == [
        ("None", "None", 1), ("w", "None", 1), ("w", "None", 2), ("w", "t", 1)]


def test_repeated_connection_ids_and_missing_names(spark):
    refs = spark.createDataFrame([("1", None), ("2", None), ("3", None)], "connection_id string, inline_type string")
    listed = spark.createDataFrame(
        [("1", "Snowflake.Databases", "a"), ("1", "Snowflake.Databases", "b"), ("2", "", "")],
        "connection_id string, connector_type string, display_name string")
    got = {r.connection_id: r.connector_kind for r in activities.resolve_connections(refs, listed).collect()}
    assert got == {"1": "Snowflake", "2": "Connection", "3": "Unresolved connection"}
    assert activities.resolve_connections(refs, listed).count() == 3


def test_html_anywhere_in_the_body(spark):
    body = F.concat(F.repeat(F.lit(" "), 3000), F.lit("<HTML>"))
    got = spark.range(1).select(classify.delivery_status(F.lit(200), F.lit(None).cast("int"), body).alias("s")).first().s
    assert got == "captive_portal"


def test_join_lines_keeps_models_with_long_strings(spark, monkeypatch):
    source = F.concat(F.lit('{"model": {"tables": [{"name": "T", "partitions": [{"name": "P", "source": {"type": "m", "expression": "'),
                      F.repeat(F.lit("x"), LONG), F.lit('"}}]}]}}'))
    payload = F.regexp_replace(F.base64(source.cast("binary")), r"\s", "")
    envelope = F.concat(F.lit('{"definition": {"parts": [{"path": "model.bim", "payload": "'), payload, F.lit('"}]}}'))
    df = spark.range(1).select(F.lit("w").alias("workspace_id"), F.lit("i").alias("item_id"), F.lit("SemanticModel").alias("item_type"),
                               envelope.alias("definition"))
    monkeypatch.setattr(queries.fx, "definitions", lambda spark, sf: df)
    rows = queries.expr_join_lines(spark, "").select("is_list", F.length("expression").alias("n")).collect()
    assert [(r.is_list, r.n) for r in rows] == [(False, LONG)]
