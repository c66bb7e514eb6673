"""Streaming twins of the batch operators.

Each function maps a streaming DataFrame to a streaming DataFrame; ``drain``
runs one to the end of its available input and reads the result back as a table.

A watermark moves only when rows come, so what a stream still waits for after its
last row would never be answered. A clock (``start_clock``) is one more stream that
carries nothing but times; a scheduler ticks it, or ``drain`` does at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import fixed_values as fv
from ..operators.calls import scan_expressions
from ..session import work_folder

_TICK = "at timestamp"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Files of ``<folder>/<name>.parquet`` (a file or a directory of files) as a stream."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", "*.parquet")
        .option("recursiveFileLookup", "true")
        .parquet(f"{folder}/{name}.parquet*")
    )


def daily_trend(events: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Scans per day; in append mode a day comes once the watermark has passed it, in update mode at every change."""
    return (
        events.withWatermark("timestamp", lateness)
        .groupBy(F.window("timestamp", "1 day"))
        .agg(F.count("*").alias("scans"))
        .select(F.col("window.start").alias("day"), "scans")
    )


def dedup_events(events: DataFrame, key: str = "run_id", lateness: str = "1 day") -> DataFrame:
    """A retried event counts once, within the lateness bound."""
    return events.withWatermark("timestamp", lateness).dropDuplicatesWithinWatermark([key])


# --- clock ----------------------------------------------------------------------------


def start_clock(spark: SparkSession, folder: str | None = None) -> tuple[DataFrame, str]:
    """A stream of ticks and the shared folder its ticks are written to."""
    folder = folder or f"{work_folder(spark)}/ticks"
    spark.createDataFrame([], _TICK).write.mode("append").parquet(folder)
    return spark.readStream.schema(_TICK).parquet(folder), folder


def tick(spark: SparkSession, folder: str, at) -> None:
    """Tells every stream on the clock that all rows up to ``at`` have come."""
    spark.range(1).select(F.lit(at).cast("timestamp").alias("at")).write.mode("append").parquet(folder)


def _on_clock(rows: DataFrame, time: str, clock: DataFrame | None, mark: str, of_tick: int) -> DataFrame:
    """The rows, with ticks that move the watermark of ``time`` too; ``mark`` is 0 for rows and ``of_tick`` for ticks.

    Ticks must not be filtered by a condition that Spark can move below the watermark.
    """
    marked = rows.withColumn(mark, F.lit(0))
    if clock is None:
        return marked
    return marked.unionByName(clock.select(F.col("at").alias(time), F.lit(of_tick).alias(mark)), allowMissingColumns=True)


# --- run state ------------------------------------------------------------------------


def run_states(scans: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    """Per key: the newest scan's columns with its place, first and last time, number of scans.

    States of parts of the scans add up (``merged_states``), so a stream needs no
    state of its own: every batch leaves the states of its rows.
    """
    place = F.struct("ts", "run_id")
    return scans.groupBy(*keys).agg(
        F.max_by(F.struct(*payload), place).alias("latest"),
        F.max(place).alias("place"),
        F.min("ts").alias("first_run_at"),
        F.max("ts").alias("last_run_at"),
        F.count("*").alias("run_count"),
    )


def merged_states(states: DataFrame, keys: list[str]) -> DataFrame:
    """States of parts of the scans, from any number of batches and stored tables, as one state per key."""
    return states.groupBy(*keys).agg(
        F.max_by("latest", "place").alias("latest"),
        F.max("place").alias("place"),
        F.min("first_run_at").alias("first_run_at"),
        F.max("last_run_at").alias("last_run_at"),
        F.sum("run_count").alias("run_count"),
    )


def upsert_states(scans: DataFrame, folder: str, keys: list[str], payload: list[str]) -> None:
    """Adds the scans that are available to the stored states below ``folder``.

    Every batch writes its own states to its own folder, so a batch that is
    repeated after a failure replaces itself, and the cost of a batch does not
    depend on how many states there are.
    """
    def add(batch: DataFrame, batch_id: int) -> None:
        run_states(batch, keys, payload).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    query = scans.writeStream.option("checkpointLocation", f"{folder}/_progress").trigger(availableNow=True)
    query.foreachBatch(add).start().awaitTermination()


def stored_states(spark: SparkSession, folder: str, keys: list[str], before: DataFrame | None = None) -> DataFrame:
    """The states below ``folder``, on top of the states the stream started from."""
    parts = spark.read.option("basePath", folder).parquet(f"{folder}/batch=*").drop("batch")
    return merged_states(parts if before is None else before.unionByName(parts), keys)


def latest_run(states: DataFrame, keys: list[str]) -> DataFrame:
    """Newest scan and run count per key."""
    return states.select(*keys, "latest.*", "first_run_at", "last_run_at", "run_count")


# --- first finished refresh -----------------------------------------------------------


def first_terminal(
    switches: DataFrame, refreshes: DataFrame, keys: list[str], wait_minutes: int = 30,
    lateness: str = "10 minutes", clock: DataFrame | None = None,
) -> DataFrame:
    """First finished refresh after each switch, or no_new_refresh once the wait is over.

    ``switches`` (keys, ``switch_time``) and ``refreshes`` (keys, ``start_time``,
    ``request_id``, ``status``) meet in a time-bounded left outer join; the bound
    lets Spark drop join state, and its end emits the items that saw nothing.
    With a clock that end comes when the clock says so, also without new rows.
    Equal switches are one; NULL is a key like any other.
    """
    left = _on_clock(switches.withColumn("_switch", F.unix_micros("switch_time")), "switch_time", clock, "_mark", 1)
    right = _on_clock(
        refreshes.filter(F.col("status").isin(fv.TERMINAL_STATUSES))
        .select(*[F.col(k).alias(f"_{k}") for k in keys], "start_time", "request_id", F.col("status").alias("refresh_status")),
        "start_time", clock, "_right_mark", 2,
    )
    there = F.struct(F.col("_right_mark").alias("_mark"), *[F.col(f"_{k}").alias(k) for k in keys])
    same: Column = F.struct("_mark", *keys) == there
    in_time = (F.col("start_time") >= F.col("switch_time")) & (
        F.col("start_time") <= F.col("switch_time") + F.expr(f"INTERVAL {wait_minutes} MINUTES")
    )
    joined = left.withWatermark("switch_time", lateness).join(
        right.withWatermark("start_time", lateness), same & in_time, "leftOuter")
    return (
        joined.groupBy(*keys, "_switch", F.window("switch_time", "1 minute"))
        .agg(
            F.min(F.when(F.col("start_time").isNotNull(),
                         F.struct("start_time", "request_id", "refresh_status"))).alias("r"),
            F.min("_mark").alias("_mark"),
        )
        .filter("_mark = 0")
        .select(
            *keys, F.timestamp_micros("_switch").alias("switch_time"), "r.start_time", "r.request_id",
            F.coalesce("r.refresh_status", F.lit("no_new_refresh")).alias("outcome"),
        )
    )


def scan_calls(expressions: DataFrame) -> DataFrame:
    """The expression scan on newly arriving definitions: stateless, fixed catalogs.

    Texts arrive in any number of files, one large one at worst, so they are dealt out before they are parsed.
    """
    spark = expressions.sparkSession
    width = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return scan_expressions(expressions.repartition(width))


def drain(
    stream: DataFrame, mode: str = "append", keys: list[str] | None = None, ticks: str | None = None, until=None
) -> DataFrame:
    """Runs the stream over what is available and returns its output as a table.

    Output and progress are written to the shared work folder, so a lost
    executor or driver restarts from the last finished batch. In update mode the
    newest version of each key is kept (batch number decides). With the folder of
    a clock, the clock then ticks at ``until`` and the stream goes on from its
    progress, so that everything that waits for that time is answered.
    """
    spark = stream.sparkSession
    folder = work_folder(spark)
    out, progress = f"{folder}/out", f"{folder}/progress"
    schema = stream.schema

    def upsert(batch: DataFrame, batch_id: int) -> None:
        # Overwriting the batch's own folder makes a repeated batch harmless.
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/b={batch_id}")

    def run() -> None:
        writer = stream.writeStream.option("checkpointLocation", progress).trigger(availableNow=True)
        if mode == "append":
            query = writer.format("parquet").outputMode("append").start(out)
        else:
            query = writer.outputMode("update").foreachBatch(upsert).start()
        query.awaitTermination()

    run()
    if ticks is not None:
        tick(spark, ticks, until)
        run()
    if mode == "append":
        return spark.read.schema(schema).parquet(out)
    versions = spark.read.option("basePath", out).parquet(out).drop("b")
    rest = [c for c in schema.names if c not in (keys or [])]
    return (
        versions.groupBy(*(keys or []))
        .agg(F.max_by(F.struct(*rest), "_batch").alias("s"))
        .select(*(keys or []), "s.*")
    )
