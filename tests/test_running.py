"""Running sums and run state with keys that are cut into ranges."""

import datetime as dt
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from estatelens.operators import running, runstate

START = dt.datetime(2024, 1, 31, 23)


def history(spark, n, seed, hot_share=0.9):
    """One key with most rows in one month, many of them at one instant; other keys and times small or NULL."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        hot = rng.random() < hot_share
        ts = START if rng.random() < 0.4 else START + dt.timedelta(seconds=rng.randint(0, 2_000_000))
        if rng.random() < 0.02:
            ts = None
        rows.append(("hot" if hot else rng.choice(["a", "b", None]), ts, i, rng.randint(-5, 5)))
    return rows, spark.createDataFrame(rows, "k string, ts timestamp, id bigint, v bigint").repartition(7)


def place(r):
    return r[1] is not None, r[1] or START, r[2]


@pytest.mark.parametrize("range_rows", [1, 17, 200, 100_000])
def test_sums_against_a_plain_walk(spark, range_rows):
    rows, df = history(spark, 1500, range_rows)
    got = {r.id: (r.s, r.n) for r in running.running_sums(
        df, ["k"], ["ts", "id"], {"s": F.col("v"), "n": F.lit(1)}, range_rows).collect()}
    totals = defaultdict(lambda: [0, 0])
    for r in sorted(rows, key=place):
        totals[r[0]][0] += r[3]
        totals[r[0]][1] += 1
        assert got[r[2]] == tuple(totals[r[0]])
    assert len(got) == len(rows)


def test_a_hot_key_is_spread_evenly(spark):
    _, df = history(spark, 60_000, 5)
    placed, cut = running.in_ranges(df, ["k"], ["ts", "id"], 1000)
    sizes = Counter({(r.k, r._range): r["count"] for r in placed.groupBy("k", "_range").count().collect()})
    hot = sorted(n for (k, _), n in sizes.items() if k == "hot")
    assert cut and len(hot) > 40 and hot[-1] < 3 * hot[len(hot) // 2]


def test_short_keys_need_one_window(spark):
    _, df = history(spark, 500, 3)
    out = running.running_count(df, ["k"], ["ts", "id"], "n")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_no_rows_and_the_bound_of_the_sample(spark):
    _, df = history(spark, 10, 1)
    assert running.running_count(df.limit(0), ["k"], ["ts", "id"], "n").count() == 0
    many = spark.range(30_000).select(F.lit("k").alias("k"), F.col("id"))
    assert running.cut_points(many, ["k"], ["id"], 1).count() <= running.SAMPLE_ROWS
    assert running.cut_points(many, ["k"], ["id"], 1_000_000) is None


SCAN = ("workspace_id string, tenant_hash string, ts timestamp, run_id bigint, "
        + ", ".join(f"{c} bigint" for c in runstate.COUNTERS) + ", counts_by_connector map<string,bigint>")


@pytest.mark.parametrize("range_rows", [3, 50, 100_000])
def test_state_after_resets_against_a_plain_walk(spark, range_rows):
    rng = random.Random(range_rows)
    rows = []
    for i in range(400):
        ws = "hot" if i % 10 else rng.choice("ab")
        rows.append((ws, "t", START + dt.timedelta(minutes=rng.randint(0, 60)), i, *[i] * len(runstate.COUNTERS), {"A": i}))
    scans = spark.createDataFrame(rows, SCAN)
    chosen = [r[:4] for r in rows if rng.random() < 0.05]
    resets = spark.createDataFrame(chosen, "workspace_id string, tenant_hash string, ts timestamp, run_id bigint")
    marks = {r[3] for r in chosen}
    got = {r.run_id: r for r in runstate.with_reset_state(scans, resets, range_rows).collect()}
    state, last = {}, {}
    for r in sorted(rows, key=lambda r: (r[2], r[3])):
        epoch, n, first = state.get(r[0], (0, 0, None))
        if r[3] in marks:
            epoch, n = epoch + 1, 0
        n, first = n + 1, r if n == 0 else first
        state[r[0]] = epoch, n, first
        row = got[r[3]]
        assert (row.epoch, row.run_count, row.first_run_id, row.first_counts_by_connector, row.is_first_run) == (
            epoch, n, first[3], first[-1], n == 1)
        last[r[0], epoch] = r[2]
    assert all(got[r[3]].last_run_at == last[r[0], got[r[3]].epoch] for r in rows) and len(got) == len(rows)
    plain = {r.run_id: (r.run_count, r.first_run_id, r.last_run_at) for r in runstate.with_state(scans, range_rows=range_rows).collect()}
    for ws in ("hot", "a", "b"):
        own = sorted((r for r in rows if r[0] == ws), key=lambda r: (r[2], r[3]))
        for n, r in enumerate(own, 1):
            assert plain[r[3]] == (n, own[0][3], own[-1][2])


@pytest.mark.parametrize("range_rows", [1, 9, 100_000])
def test_refreshes_around_many_cutovers_against_pairs(spark, range_rows):
    from estatelens.operators import validation

    rng = random.Random(range_rows)
    history = [("w", rng.choice(["hot", "hot", "hot", "b"]), f"r{rng.randint(0, 40)}", rng.choice(["Completed", "Failed", "InProgress"]),
                START + dt.timedelta(minutes=rng.randint(0, 200)), None, None) for _ in range(300)]
    history = list({(h[1], h[2], h[4]): h for h in history}.values())
    cuts = [("w", i, START + dt.timedelta(minutes=m)) for i in ("hot", "b", "none") for m in rng.sample(range(-5, 210), 10)]
    entry = "workspace_id string, item_id string, request_id string, status string, start_time timestamp, end_time timestamp, error_text string"
    got = validation.refreshes_around(
        spark.createDataFrame(cuts, "workspace_id string, item_id string, cutover timestamp"), spark.createDataFrame(history, entry), 30, range_rows)
    rows = got.collect()
    assert len(rows) == len(cuts)
    for r in rows:
        own = sorted((h for h in history if h[1] == r.item_id), key=lambda h: (h[4], h[2]))
        before = [h for h in own if h[4] < r.cutover]
        previous = before[-1][2] if before else None
        after = [h for h in own if r.cutover <= h[4] <= r.cutover + dt.timedelta(minutes=30)
                 and h[3] != "InProgress" and h[2] != previous]
        assert (r.pre and r.pre.request_id) == previous
        assert (r.post and (r.post.request_id, r.post.start_time)) == (after and (after[0][2], after[0][4]) or None)
