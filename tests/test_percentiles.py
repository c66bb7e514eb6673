"""Exact percentiles by rank selection."""

import math
import random

import pytest
from pyspark.sql import functions as F

from estatelens.operators import events

PROBS = {"p0": 0.0, "p50": 0.5, "p90": 0.9, "p99": 0.99, "max": 1.0}


def plain(values):
    ordered = sorted(v for v in values if v is not None)
    return tuple(ordered[max(1, math.ceil(len(ordered) * p)) - 1] if ordered else None for p in PROBS.values())


@pytest.mark.parametrize("range_values", [1, 3, 50, 4096])
def test_against_sorting(spark, monkeypatch, range_values):
    monkeypatch.setattr(events, "RANGE_VALUES", range_values)
    rng = random.Random(range_values)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, 0.0, 7.25, round(rng.gauss(0, 100), 2)])) for _ in range(3000)]
    rows += [("one", 1.5), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: tuple(r[p] for p in PROBS) for r in events.percentiles(df, ["k"], "v", PROBS).collect()}
    assert got == {k: plain([v for j, v in rows if j == k]) for k in ("a", "b", None, "one")}
    assert [tuple(r) for r in events.percentiles(df, [], "v", PROBS).collect()] == [plain([v for _, v in rows])]


def test_no_rows(spark):
    empty = spark.createDataFrame([], "k string, v double")
    assert events.percentiles(empty, ["k"], "v", PROBS).count() == 0
    assert [tuple(r) for r in events.percentiles(empty, [], "v", PROBS).collect()] == [(None,) * 5]


def test_no_task_orders_a_whole_group(spark, monkeypatch):
    monkeypatch.setattr(events, "RANGE_VALUES", 100)
    df = spark.range(50_000).select((F.col("id") * 7919 % 50_000).cast("double").alias("v"))
    out = events.percentiles(df, [], "v", {"p50": 0.5, "p90": 0.9})
    assert [tuple(r) for r in out.collect()] == [(24_999.0, 44_999.0)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
