"""Scan events as property bags: names, counts and bags are made once per row."""

from pyspark.sql import functions as F

from estatelens.operators import events, runstate


def plan(df, which="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), which)().toString()


def scans(spark):
    kinds = F.create_map(F.lit("A B"), F.col("id"), F.lit("C"), F.lit(2).cast("bigint"))
    return spark.range(6).select(
        F.concat(F.lit("ws-"), F.col("id") % 2).alias("workspace_id"), F.lit("t").alias("tenant_hash"),
        F.timestamp_add("DAY", F.col("id").cast("int"), F.lit("2024-01-01").cast("timestamp")).alias("ts"), F.col("id").alias("run_id"),
        *[F.col("id").alias(c) for c in runstate.COUNTERS], F.col("id").alias("pinned_at_risk"),
        kinds.alias("counts_by_connector"), F.lit(3).alias("inspected_artifacts"))


def log(spark):
    return runstate.scan_events(runstate.scan_facts(runstate.with_state(scans(spark))))


def test_names_are_made_safe_once(spark):
    entries = [([("A B", 1), ("A/B", 2), ("C", None), ("A_B", 3)],), ([],), (None,), ([("x y", 1), ("z", 2)],)]
    rows = spark.createDataFrame(entries, "e array<struct<k string, v bigint>>").select(F.map_from_entries("e").alias("m"))
    out = rows.select(runstate._safe_keys(F.col("m")).alias("m"))
    assert [r.m for r in out.collect()] == [{"C": None, "A_B": 3}, {}, None, {"x_y": 1, "z": 2}]
    assert plan(out).count("regexp_replace") == 1


def test_differences_name_their_kinds_once(spark):
    rows = spark.createDataFrame([({"a": 3, "b": 1}, {"b": 4, "c": 2}), ({}, {})], "f map<string,bigint>, c map<string,bigint>")
    out = rows.select(runstate.resolved_map(F.col("f"), F.col("c")).alias("r"))
    assert [r.r for r in out.collect()] == [{"a": 3, "b": -3, "c": -2}, {}]
    assert plan(out).count("array_union") == 1


def test_a_condition_on_the_log_does_not_make_the_bag_again(spark):
    out = events.resolved_connector_rollup(events.typed_scans(log(spark)))
    assert plan(out).count("map_concat") == 1
    assert sorted(map(tuple, out.collect())) == [("A_B", -12)]


def test_no_bag_travels_with_its_properties(spark, monkeypatch):
    from queryset import fixtures, queries

    monkeypatch.setattr(fixtures, "scan_log", lambda spark, sf: log(spark))
    out = queries.QUERIES["scan_event"](spark, "")
    assert plan(out).count("map_concat") == 1
    top = plan(out, "executedPlan").split("Generate explode(custom_dimensions", 1)[1].split("\n")[0]
    assert "[run_id#" in top and "[custom_dimensions#" not in top
    found = {(r.run_id, r.key): r.value for r in out.collect()}
    assert found["4", "impacts_by_connector_A_B"] == "4" and found["5", "run_count"] == "3" and found["0", "is_first_run"] == "True"
