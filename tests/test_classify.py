"""Risk, diagnoses, links, identities, delivery outcomes."""

import pytest
from pyspark.sql import functions as F

from estatelens.catalog import fixed_values as fv
from estatelens.functions import classify, numbers, text
from estatelens.operators import impact


def col(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


CALL = "migration string, implementation string, custom_dsn boolean, has_gateway boolean"
ADBC, GONE = "odbc_to_adbc:snowflake", "deprecation:hive"


@pytest.fixture(scope="module")
def args():
    return [F.col(c) for c in ("migration", "implementation", "custom_dsn", "has_gateway")]


def test_risk_table(spark, args):
    cases = [
        (("none", None, False, None), "na"), (("none", "1.0", True, False), "medium"),
        ((GONE, "1.0", False, True), "high"), ((GONE, None, False, False), "medium"), ((GONE, "2.0", False, None), "medium"),
        ((ADBC, "2.0", True, False), "low"), ((ADBC, "1.0", False, True), "medium"),
        ((ADBC, "1.0", False, False), "high"), ((ADBC, "1.0", False, None), "unknown"),
        ((ADBC, None, True, None), "medium"), ((ADBC, None, False, False), "low"), ((ADBC, "x", False, None), "low"),
    ]
    got = col(spark, [c for c, _ in cases], CALL, classify.call_risk(*args))
    assert got == [r for _, r in cases]


def test_scan_advice(spark, args):
    cases = [
        ((GONE, "1.0", True, None), "deprecation"), (("none", None, True, None), "custom_dsn"),
        ((ADBC, "1.0", False, False), "pinned_no_gateway"), ((ADBC, "1.0", False, None), "pinned"),
        ((ADBC, "1.0", False, True), "pinned"), ((ADBC, None, False, None), "ready"),
        ((ADBC, "2.0", False, None), None), (("none", "1.0", False, False), None),
    ]
    assert col(spark, [c for c, _ in cases], CALL, classify.scan_advice_id(*args)) == [r for _, r in cases]
    row = impact.scan_diagnoses(spark.createDataFrame([(GONE, None, False, None)], CALL), "help@here").first()
    assert row.issue.startswith("Hive connector") and "The hive connector" in row.likely_cause
    row = impact.scan_diagnoses(spark.createDataFrame([("none", None, True, None)], CALL), "help@here").first()
    assert "help@here" in " ".join(row.suggested_actions)


ERRORS = [
    ("DataSource.Error: ADBC: driver not found", 1), ("ADBC something driver is NOT yet Installed", 1),
    ("ModelRefreshFailed_CredentialsNotSpecified", 2), ("no credentials configured for x", 2),
    ("HTTP 401", 3), ("Access to the resource was denied", 3), ("MSAL failure", 3),
    ("ModelRefresh_ShortMessage_ProcessingError: something", 0),
    ("The key didn't match any rows in the table", 4), ("schema has drifted", 4), ("schema drift seen", 4),
    ("invalid DSN", 5), ("gateway is offline", 6), ("gateway uses ODBC", 7),
    ('pinned Implementation="1.0" here', 8), ("407 from HTTPS_PROXY", 9), ("it took too long", 10),
    ("self-signed", 11), ("Too Many Requests", 12), ("Dremio connection refused", 13), ("port 32010 closed", 13),
    ("connection was refused", 14), ("odd", 0), ("first line\nADBC driver\nnot found", 0), ("", None), (None, None),
]


def test_error_rules_first_match_wins(spark):
    got = col(spark, [(t,) for t, _ in ERRORS], "t string", classify.error_rule_no(F.col("t")))
    assert dict(zip([t for t, _ in ERRORS], got)) == dict(ERRORS)
    long = "x\n" + "y" * 300
    cause = col(spark, [(long,)], "t string", classify.uncategorized_cause(F.col("t")))[0]
    assert cause == fv.UNCATEGORIZED_CAUSE_PREFIX + "x " + "y" * 300  # the whole text


def test_portal_links(spark):
    schema = "w string, i string, t string, c string, p boolean"
    base = fv.PORTAL_BASES
    cases = [
        (("w", "i", "SemanticModel", None, None), base["commercial"] + "/groups/w/datasets/i"),
        (("w", "i", "Dataflow", "GCC", False), base["gcc"] + "/groups/w/dataflows/i"),
        (("w", "i", "Report", "nowhere", False), base["commercial"] + "/groups/w/list"),
        (("w", "", "Dataset", "dod", False), None), ((None, "i", "Dataset", None, False), None),
        ((None, "i", "DataPipeline", "china", True), base["china"] + "/me/pipelines/i"),
        ((None, None, "DataPipeline", None, True), None), ((None, None, "Report", None, True), base["commercial"] + "/me/list"),
    ]
    expr = classify.portal_link(*[F.col(c) for c in "witcp"])
    assert col(spark, [c for c, _ in cases], schema, expr) == [u for _, u in cases]
    own = classify.portal_link(F.col("w"), F.col("i"), F.col("t"), base_override="https://own/")
    assert col(spark, [("w", "i", "Dataset", None, None)], schema, own) == ["https://own/groups/w/datasets/i"]


def test_delivery_outcomes(spark):
    ok, drop = '{"itemsReceived":1,"itemsAccepted":1,"errors":[]}', '{"itemsReceived":1,"itemsAccepted":0}'
    cases = [
        ((200, None, ok), "ok"), ((206, None, drop), "ingest_drop"), ((200, None, None), "ingest_drop"), ((200, None, "[]"), "ingest_drop"),
        ((200, None, '{"itemsReceived":2,"itemsAccepted":1,"errors":[]}'), "ingest_drop"),
        ((200, None, '{"itemsReceived":1,"itemsAccepted":1,"errors":[{"i":0}]}'), "ingest_drop"),
        ((200, None, " <HTML><body>login"), "captive_portal"), ((404, None, ok), "http_404"),
        ((429, 200, ok), "retried_ok"), ((503, None, ok), "http_503"), ((429, 500, ""), "http_500"),
        ((None, None, None), "network"), ((None, 200, ok), "retried_ok"), ((None, 302, ok), "http_302"),
    ]
    expr = classify.delivery_status(F.col("f"), F.col("r"), F.col("b"))
    assert col(spark, [c for c, _ in cases], "f int, r int, b string", expr) == [s for _, s in cases]


def test_identity(spark):
    rows = [(" a ", "b", "e", True), ("", " b", "e", True), (None, None, "e", True), ("a", None, " e ", False), (None, None, None, False)]
    user, source = classify.identity_select(*[F.col(c) for c in "abch"])
    got = spark.createDataFrame(rows, "a string, b string, c string, h boolean").select(user, source).collect()
    assert [tuple(r) for r in got] == [("a", "aad"), ("b", "aad"), ("", ""), ("e", "env"), ("", "")]
    hashed = col(spark, [("x ",), ("",), (None,)], "v string", text.identity_hash(F.col("v"), trim=True))
    assert hashed == ["2d711642b726", "", ""]


def test_numbers(spark):
    assert col(spark, [(1, 40), (0, 0), (3, 40), (7, 20)], "a int, b int", numbers.half_even_pct(F.col("a"), F.col("b"))) == [2, 100, 8, 35]
    pairs = [(10.0, 15.0), (0.5, 2.0), (0.0, 5.0), (None, 5.0), (100.0, 150.04)]
    assert col(spark, pairs, "a double, b double", numbers.pct_change(F.col("a"), F.col("b"))) == [50.0, 150.0, None, None, 50.0]
    assert col(spark, [("a b-c_é1",)], "t string", text.safe_key(F.col("t"))) == ["a_b_c_é1"]
