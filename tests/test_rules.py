"""Ordered substring rules as a table; sketches per day."""

import random

import pytest
from pyspark.sql import functions as F

from estatelens.operators import activities, events, rules

SCHEMA = "rule_no bigint, field string, needle string"


@pytest.mark.parametrize("block_chars", [40, rules.BLOCK_CHARS])
def test_first_rule_against_a_plain_walk(spark, monkeypatch, block_chars):
    monkeypatch.setattr(rules, "BLOCK_CHARS", block_chars)
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcé") for _ in range(n))
    table = [(i, rng.choice(["a", "b"]), word(rng.randint(2, 4))) for i in rng.sample(range(1000), 60)]
    table += [(5000, "a", ""), (5001, "a", None), (1, "other", "a"), (7, "b", table[0][2]), (6, "b", table[0][2])]
    rows = [(i, rng.choice([None, word(12)]), rng.choice([None, word(5)])) for i in range(200)]
    got = rules.first_rules(spark.createDataFrame(rows, "id int, a string, b string"), ["a", "b"], spark.createDataFrame(table, SCHEMA))
    for r in got.collect():
        hits = [n for n, field, needle in table if field in "ab" and needle is not None and r[field] is not None and needle in r[field]]
        assert r.rule_no == min(hits, default=None)


def test_five_thousand_rules_and_the_catalog(spark):
    many = spark.range(5000).select((F.col("id") + 100).alias("rule_no"), F.lit("_kind").alias("field"),
                                    F.concat(F.lit("thing "), F.col("id")).alias("needle"), F.lit("new").alias("bucket"))
    table = activities.migration_rules(spark).unionByName(many)
    kinds = ["Snowflake", "My Thing 77 store", "Azure Databricks", "x", None]
    df = spark.createDataFrame([(k, None) for k in kinds], "connector_kind string, connector_prefix string")
    got = {r.connector_kind: r.migration for r in activities.ref_migrations(df, table).collect()}
    old = {r.connector_kind: r.m for r in df.withColumn("m", activities.ref_migration(F.col("connector_kind"), F.col("connector_prefix"))).collect()}
    assert got == {**old, "My Thing 77 store": "new"}
    assert activities.ref_migrations(df, table.limit(0)).filter("migration <> 'none'").count() == 0


def test_sketches_of_days_add_up(spark):
    rows = spark.range(20_000).select(
        F.timestamp_add("HOUR", F.pmod("id", F.lit(240)).cast("int"), F.lit("2024-01-01").cast("timestamp")).alias("timestamp"),
        F.concat(F.lit("t"), F.col("id") % 3000).alias("tenant"))
    parts = events.daily_sketches(rows.filter("tenant < 't2'"), tenants="tenant").unionByName(
        events.daily_sketches(rows.filter("tenant >= 't2'"), tenants="tenant"))
    whole = events.counts_from_sketches(parts, ["tenants"]).first()
    assert whole.scans == 20_000 and abs(whole.tenants - 3000) < 150
    week = events.counts_from_sketches(parts, ["tenants"], days=7).first()
    exact = rows.filter("timestamp >= '2024-01-04'").agg(F.count("*"), F.count_distinct("tenant")).first()
    assert week.scans == exact[0] and abs(week.tenants - exact[1]) <= 0.05 * exact[1]
    assert tuple(events.counts_from_sketches(parts.limit(0), ["tenants"]).first()) == (0, 0)


def test_many_blocks_of_rules_are_one_python_step(spark, monkeypatch):
    """A step per block would have as many workers, each with its automaton, at work in one task."""
    monkeypatch.setattr(rules, "BLOCK_CHARS", 200)
    table = spark.range(300).select("id", F.lit("text"), F.concat(F.lit("no "), "id", F.lit(";"))).toDF("rule_no", "field", "needle")
    rows = spark.createDataFrame([(1, "no 7; no 3;"), (2, "no 299;"), (2, "no 299;"), (3, None), (4, "no")], "id int, text string")
    out = rules.first_rules(rows, ["text"], table)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert sorted(map(tuple, out.collect()), key=str) == [
        (1, "no 7; no 3;", 3), (2, "no 299;", 299), (2, "no 299;", 299), (3, None, None), (4, "no", None)]
