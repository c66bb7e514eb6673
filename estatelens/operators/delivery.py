"""Delivery log of events: ring buffers, retries, health."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import fixed_values as fv
from ..functions import classify

OK = ["ok", "retried_ok"]


def attempts_with_status(attempts: DataFrame) -> DataFrame:
    """Raw attempts (first_status, retry_status, body) with their outcome."""
    return attempts.withColumn("status", classify.delivery_status(
        F.col("first_status"), F.col("retry_status"), F.col("body")
    ))


def last_n(log: DataFrame, n: int = fv.SEND_LOG_CAP, by: list[str] | None = None) -> DataFrame:
    """The newest ``n`` entries (of each store): the ring buffer as a query.

    Order is (at, attempt_id). Both forms cut to ``n`` before rows are exchanged.
    """
    newest = [F.desc("at"), F.desc("attempt_id")]
    if not by:
        return log.orderBy(*newest).limit(n)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*newest))
    return log.withColumn("_no", rank).filter(F.col("_no") <= n).drop("_no")


def pending_retries(
    attempts: DataFrame, cap: int = fv.RETRY_FLUSH_CAP, buffered: int | None = None
) -> DataFrame:
    """Failed envelopes not accepted since: the next flush, oldest first.

    On request only the newest ``buffered`` failures are kept; one without a body to
    send (``envelope`` NULL or '') takes a place in the flush but is dropped.
    """
    accepted = attempts.filter(F.col("status").isin(OK)).select("envelope_id")
    failed = attempts.filter(~F.col("status").isin(OK)).join(accepted, "envelope_id", "left_anti")
    waiting = failed.groupBy("envelope_id").agg(
        F.max_by(F.struct("at", "attempt_id", "status", "envelope"), F.struct("at", "attempt_id")).alias("e")
    ).select("envelope_id", "e.*")
    if buffered is not None:
        waiting = last_n(waiting, buffered)
    flush = waiting.orderBy("at", "attempt_id").limit(cap)
    return flush.filter(F.coalesce(F.col("envelope"), F.lit("")) != "")


def delivery_health(attempts: DataFrame) -> DataFrame:
    """One row: counts, last good time, last failure and the backlog."""
    ok = F.col("status").isin(OK)
    at = F.struct("at", "attempt_id")
    failure = F.struct("at", "status")
    head = attempts.agg(
        F.count("*").alias("attempts"),
        F.count_if(ok).alias("delivered"),
        F.count_if(~ok).alias("failed"),
        F.max(F.when(ok, F.col("at"))).alias("last_ok_at"),
        F.max_by(failure, F.when(~ok, at)).alias("_last"),
    )
    backlog = pending_envelopes(attempts).agg(F.count("*")).scalar()
    return head.withColumn("backlog", backlog).select(
        "attempts", "delivered", "failed", "last_ok_at",
        F.col("_last.at").alias("last_failure_at"),
        F.col("_last.status").alias("last_failure_status"),
        "backlog",
    )


def pending_envelopes(attempts: DataFrame) -> DataFrame:
    """Envelopes with no accepted attempt at all."""
    return attempts.groupBy("envelope_id").agg(
        F.bool_or(F.col("status").isin(OK)).alias("_done")
    ).filter(~F.col("_done")).select("envelope_id")
