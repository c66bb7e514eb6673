"""Definitions, exports, frames and activity documents."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from estatelens.operators import activities, extract
from estatelens.sources import frames, scanner


def envelope(*parts):
    def body(p, t):
        data = t if isinstance(t, bytes) else t.encode()
        return {"path": p, "payload": base64.b64encode(data).decode(), "payloadType": "InlineBase64"}
    return json.dumps({"definition": {"parts": [body(p, t) for p, t in parts]}})


def parse(spark, item_type, *parts):
    df = spark.createDataFrame([("w", "i", item_type, envelope(*parts))],
                               "workspace_id string, item_id string, item_type string, definition string")
    rows = extract.definition_expressions(df).orderBy("part_idx", "expr_idx").collect()
    return [(r.expr_name, r.expression) for r in rows]


def test_model_json_partitions_lists_and_shared(spark):
    doc = {"model": {"tables": [
        {"name": "T", "partitions": [
            {"name": "P", "source": {"type": "m", "expression": ["let", "  x"]}},
            {"name": "C", "source": {"type": "calculated", "expression": "ROW()"}},
            {"name": "N", "source": {"type": "m"}}]},
        {"partitions": [{"source": {"type": "m", "expression": "[a = 1]"}}]}],
        "expressions": [{"name": "S", "expression": "1"}, {"expression": '["x"]'}]}}
    want = [("T.P", "let\n  x"), ("?.", "[a = 1]"), ("shared:S", "1"), ("shared:?", '["x"]')]
    assert parse(spark, "SemanticModel", ("model.bim", json.dumps(doc))) == want
    assert parse(spark, "Dataset", ("x.bim", json.dumps(doc["model"]))) == want
    assert parse(spark, "SemanticModel", ("model.bim", "{broken")) == []


def test_indented_model_text(spark):
    doc = ("table A\n\tpartition P = m\n\t\tsource =\n\t\t\tlet x\n\n\t\t\tin x\n\t\tkind: y\ntable B\n\tsource = one\r\n"
           "\tsource =  two  \n\t\tthree\nend\n  source =\n")
    assert parse(spark, "SemanticModel", ("d/t.tmdl", doc)) == [
        ("d/t.tmdl", "\t\t\tlet x\n\n\t\t\tin x\n\t\tkind: y"),
        ("d/t.tmdl", "one"),
        ("d/t.tmdl", "two\n\t\tthree"),
    ]


def test_dataflow_forms(spark):
    inner = base64.b64encode(b"let Source = 1").decode()
    doc = {"a": {"b": ["let direct = Source", {"c": 'say "let x" \\ Source', "d": "no"}]}, "e": inner, "f": "a:b, Sourceé"}
    got = parse(spark, "Dataflow", ("X.PQ", "anything"), ("Model.json", json.dumps(doc)), ("other.txt", "let Source"))
    assert got[0] == ("x.pq", "anything")
    assert sorted(e for _, e in got[1:]) == sorted(['say "let x" \\ Source', "let Source = 1", "a:b, Sourceé"])


def test_bad_payloads_and_bytes(spark):
    df = spark.createDataFrame([(json.dumps({"definition": {"parts": [
        {"path": "a", "payload": "aGk"}, {"path": "b", "payload": "aG k="}, {"path": "c", "payload": "/w=="}, {"path": "d"}]}}),)],
        "definition string")
    assert [r.text for r in extract.definition_parts(df).orderBy("part_idx").collect()] == ["", "hi", "�", ""]


def test_generic_items(spark):
    assert parse(spark, "Notebook", ("n.py", "outlet"), ("m.py", "nothing")) == [("n.py", "outlet")]


def test_strings_for_key(spark):
    doc = json.dumps({"name": "a", "x": [{"name": "b\n"}, {"name": 5}, "name"], "y": {"z": {"name": ""}}})
    df = spark.createDataFrame([(1, doc), (2, "{bad")], "id int, t string")
    assert [(r.id, r.value) for r in extract.strings_for_key(df, "t", "name").orderBy("hit_idx").collect()] == [
        (1, "a"), (1, "b\n"), (1, "")]


def test_export_items_and_expressions(spark):
    ws = {"id": "w", "name": "W", "datasets": [
        {"id": "d", "name": "D", "tables": [{"name": "T", "source": [{"expression": "e1"}, {"expression": ""}]}],
         "expressions": [{"name": "S", "expression": "e2"}]}],
        "dataflows": [{"objectId": "f", "id": "no", "name": "F",
                       "queries": [{"name": "q", "mCode": "", "m": "e3", "M": "e4"}, {"name": "r", "M": "e5"}, {"name": "s", "expression": 7}],
                       "entities": [{"name": "E", "partitions": [{"expression": "e6"}, {}]}],
                       "document": "let x = 1"}]}
    df = spark.createDataFrame([(json.dumps(ws),), (json.dumps({"id": "v", "name": "V"}),)], "payload string")
    rows = scanner.export_expressions(scanner.export_items(df)).orderBy("item_type", "expr_idx").collect()
    assert [(r.item_id, r.expr_name, r.expression) for r in rows] == [
        ("f", "q", "e3"), ("f", "r", "e5"), ("f", "E", "e6"), ("f", "document", "let x = 1"),
        ("d", "T", "e1"), ("d", "shared:S", "e2")]


def test_frames_with_varying_columns(spark):
    parts = spark.createDataFrame(
        [("i", "T", "P", "M", "e"), ("i", "T", "", "PowerQuery", "f"), ("i", "T", "C", "Calculated", "g"), ("i", "T", "D", "m", " ")],
        "item_id string, `Table Name` string, `Partition Name` string, `SOURCE TYPE` string, `Source Expression` string")
    shared = spark.createDataFrame([("i", "S", "h")], "item_id string, name string, m string")
    rows = frames.frame_expressions(parts, shared, ["item_id"]).collect()
    assert sorted((r.expr_name, r.expression) for r in rows) == [("T", "f"), ("T.P", "e"), ("shared:S", "h")]
    bare = spark.createDataFrame([("i", 1)], "item_id string, other int")
    assert frames.frame_expressions(bare, bare, ["item_id"]).count() == 0


def test_fast_source_is_preferred_per_item(spark):
    fast = spark.createDataFrame([("a", "x", "1")], "item_id string, expr_name string, expression string")
    parsed = spark.createDataFrame([("a", "y", "2"), ("b", "z", "3")], fast.schema)
    rows = extract.prefer_fast_source(fast, parsed, ["item_id"])
    assert sorted((r.item_id, r.expr_name, r.source) for r in rows.collect()) == [("a", "x", "sempy"), ("b", "z", "rest")]


# --- activities ---------------------------------------------------------------------


@pytest.fixture(scope="module")
def act_calls(spark):
    conns = spark.createDataFrame(
        [("c1", "Snowflake.Databases", "My flake"), ("c2", "", "Shared one"), ("c3", "AzureDatabricks", "x")],
        "connection_id string, connector_type string, display_name string")

    def run(doc, path="Pipeline-content.json"):
        text = doc if isinstance(doc, str) else json.dumps(doc)
        df = spark.createDataFrame([("w", "i", envelope(("other.json", "{}"), (path, text)))],
                                   "workspace_id string, item_id string, definition string")
        rows = activities.activity_calls(df, conns).orderBy("expr_name", "call_pos").collect()
        return [(r.m_function, r.connector_kind, r.migration, r.endpoint_hint) for r in rows]
    return run


def doc_of(*acts):
    return {"properties": {"activities": list(acts)}}


def test_reference_shapes(act_calls):
    copy = {"name": "c", "type": "Copy", "typeProperties": {
        "source": {"datasetSettings": {"externalReferences": {"connection": "c1"}}},
        "sink": {"connectionReference": {"connectionId": "gone"}}}}
    inline = {"name": "l", "type": "Lookup", "typeProperties": {
        "dataset": {"linkedServiceName": {}, "linkedService": {"properties": {"type": "GoogleBigQuery"}}},
        "linkedService": {"referenceName": "c2"}, "connectionReference": {"connection": 5}}}
    got = act_calls(doc_of(copy, inline, {"name": "w", "type": "WebActivity", "typeProperties": {"url": "x"}}))
    assert got == [
        ("Copy", "Snowflake", "odbc_to_adbc:snowflake", "c1"),
        ("Copy", "Unresolved connection", "none", "gone"),
        ("Lookup", "Google BigQuery", "odbc_to_adbc:bigquery", None),
        ("Lookup", "Shared one", "none", "c2"),
    ]


def test_containers_at_any_depth(act_calls):
    leaf = {"name": "s", "type": "Script", "typeProperties": {"connectionReference": {"connectionId": "c3"}}}
    nest = leaf
    for i in range(30):
        kind, key = [("ForEach", "activities"), ("IfCondition", "ifFalseActivities"), ("Until", "activities"),
                     ("Switch", "defaultActivities")][i % 4]
        nest = {"name": str(i), "type": kind, "typeProperties": {key: [nest, "junk"]}}
    switch = {"name": "sw", "type": "Switch", "typeProperties": {"cases": [{"activities": [leaf]}, {}]}}
    other = {"name": "o", "type": "Copy", "typeProperties": {"activities": [leaf]}}
    assert act_calls(doc_of(nest, switch, other)) == [("Script", "Azure Databricks", "odbc_to_adbc:databricks", "c3")] * 2


def test_unreadable_documents_give_nothing(act_calls):
    assert act_calls("{bad") == []
    assert act_calls({"properties": {}}) == []
    assert act_calls(doc_of({"name": "x"}), path="else.json") == []


def test_flatten_order(spark):
    doc = doc_of({"name": "a", "type": "ForEach", "typeProperties": {"activities": [{"name": "b"}, {"name": "c"}]}}, {"name": "d"})
    df = spark.createDataFrame([("w", "i", envelope(("pipeline-content.json", json.dumps(doc))))],
                               "workspace_id string, item_id string, definition string")
    flat = activities.flatten_activities(activities.activity_documents(df)).orderBy("path")
    names = flat.select(F.try_variant_get("node", "$.name", "string").alias("n")).collect()
    assert [r.n for r in names] == ["a", "b", "c", "d"]
