"""Streams: answers without later rows, stored states, late rows."""

import datetime as dt

from pyspark.sql import functions as F

from estatelens.session import work_folder
from estatelens.streaming import metrics, streams

START = dt.datetime(2024, 5, 1, 10)


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def stored(spark, rows, schema):
    folder = f"{work_folder(spark)}/in"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).parquet(folder), folder


SWITCH = "item string, switch_time timestamp"
REFRESH = "item string, start_time timestamp, request_id string, status string"


def test_a_clock_answers_what_no_later_row_would(spark):
    switches, _ = stored(spark, [("a", at(0)), ("b", at(1)), ("c", at(2)), ("d", at(29)), (None, at(3))], SWITCH)
    refreshes, _ = stored(spark, [
        ("a", at(5), "r1", "Completed"), ("a", at(4), "r0", "InProgress"), ("a", at(3), "r2", "Failed"), ("b", at(0), "r3", "Failed"),
        ("c", at(33), "r4", "Completed"), ("d", at(30), "r5", "Disabled"), (None, at(3), "r6", "Completed")], REFRESH)
    clock, ticks = streams.start_clock(spark)
    out = streams.first_terminal(switches, refreshes, ["item"], 30, clock=clock)
    got = {r.item: (r.request_id, r.outcome) for r in streams.drain(out, ticks=ticks, until=at(600)).collect()}
    assert got == {"a": ("r2", "Failed"), "b": (None, "no_new_refresh"), "c": (None, "no_new_refresh"),
                   "d": ("r5", "Disabled"), None: ("r6", "Completed")}


def test_without_a_clock_the_tail_waits(spark):
    switches, _ = stored(spark, [("a", at(0)), ("z", at(100))], SWITCH)
    refreshes, _ = stored(spark, [("a", at(5), "r1", "Completed"), ("y", at(100), "r2", "Completed")], REFRESH)
    got = streams.drain(streams.first_terminal(switches, refreshes, ["item"], 30)).collect()
    assert [(r.item, r.outcome) for r in got] == [("a", "Completed")]


SCAN = "ws string, ts timestamp, run_id bigint, note string"


def test_stream_on_stored_states_equals_the_batch(spark):
    rows = [("w" + str(i % 3), at(i * 7 % 50), i, f"n{i}") for i in range(40)]
    old, new = rows[:15], rows[15:]
    stream, arriving = stored(spark, new[:10], SCAN)
    folder = work_folder(spark)
    before = streams.run_states(spark.createDataFrame(old, SCAN), ["ws"], ["run_id", "note"])
    streams.upsert_states(stream, folder, ["ws"], ["run_id", "note"])
    spark.createDataFrame(new[10:], SCAN).write.mode("append").parquet(arriving)
    streams.upsert_states(stream, folder, ["ws"], ["run_id", "note"])
    streams.upsert_states(stream, folder, ["ws"], ["run_id", "note"])  # nothing new: nothing counted twice
    # a batch that is repeated after a failure replaces its own states
    streams.run_states(spark.createDataFrame(new[:10], SCAN), ["ws"], ["run_id", "note"]).write.mode("overwrite").parquet(f"{folder}/batch=0")
    got = streams.latest_run(streams.stored_states(spark, folder, ["ws"], before), ["ws"]).collect()
    want = streams.latest_run(streams.run_states(spark.createDataFrame(rows, SCAN), ["ws"], ["run_id", "note"]), ["ws"]).collect()
    assert sorted(got) == sorted(want)


def test_late_rows_are_counted(spark):
    schema = "timestamp timestamp, run_id bigint"
    stream, folder = stored(spark, [(at(0), 1), (at(5000), 2), (at(5000), 2)], schema)
    reports = f"{work_folder(spark)}/reports"
    listener = metrics.LateRows(spark, reports)
    spark.streams.addListener(listener)
    try:
        for late in ([], [(at(1), 3), (at(2), 4), (at(4990), 5)]):
            if late:
                spark.createDataFrame(late, schema).coalesce(1).write.mode("append").parquet(folder)
            run = streams.dedup_events(stream, lateness="1 hour").writeStream.queryName("sent").format("noop").option(
                "checkpointLocation", f"{reports}-progress").trigger(availableNow=True).start()
            run.awaitTermination()
            assert listener.wait_for(str(run.runId))
    finally:
        spark.streams.removeListener(listener)
    rows = metrics.late_rows(spark, reports).collect()
    assert [(r.stream, r.input_rows, r.dropped_rows) for r in rows] == [("sent", 6, 2)]
    assert spark.read.option("recursiveFileLookup", "true").parquet(reports).filter(F.col("dropped_rows") > 0).count() == 1
