"""Refresh histories of datasets and dataflows in one shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import fixed_values as fv
from ..functions.text import non_empty

COLUMNS = ["workspace_id", "item_id", "request_id", "status", "start_time", "end_time", "error_text"]


def dataset_refreshes(feed: DataFrame) -> DataFrame:
    """Dataset feed: requestId, status, startTime, endTime, serviceExceptionJson."""
    return feed.select(
        "workspace_id",
        "item_id",
        F.col("requestId").alias("request_id"),
        "status",
        iso_time(F.col("startTime")).alias("start_time"),
        iso_time(F.col("endTime")).alias("end_time"),
        F.col("serviceExceptionJson").alias("error_text"),
    )


def job_refreshes(feed: DataFrame) -> DataFrame:
    """Dataflow job feed; ``failureReason`` is JSON text of an object, or plain text."""
    return feed.select(
        "workspace_id",
        "item_id",
        F.col("id").alias("request_id"),
        "status",
        iso_time(F.col("startTimeUtc")).alias("start_time"),
        iso_time(F.col("endTimeUtc")).alias("end_time"),
        failure_text(F.col("failureReason")).alias("error_text"),
    )


def failure_text(reason: Column) -> Column:
    """Message, else error code, of an object; plain text as it is."""
    is_object = reason.startswith("{")
    return F.when(
        is_object,
        F.coalesce(
            non_empty(F.get_json_object(reason, "$.message")),
            non_empty(F.get_json_object(reason, "$.errorCode")),
        ),
    ).otherwise(non_empty(reason))


def iso_time(text: Column) -> Column:
    """ISO-8601 text to a timestamp; unreadable text gives NULL."""
    return F.try_to_timestamp(text)


def refresh_history(datasets: DataFrame, jobs: DataFrame, items: DataFrame) -> DataFrame:
    """One history, each feed kept only for the item types it serves."""
    keys = ["workspace_id", "item_id"]
    of_type = items.select(*keys, "item_type")
    dataset_items = of_type.filter(F.col("item_type").isin(fv.DATASET_TYPES))
    dataflow_items = of_type.filter(F.col("item_type") == "Dataflow")
    return (
        dataset_refreshes(datasets).join(dataset_items, keys)
        .unionByName(job_refreshes(jobs).join(dataflow_items, keys))
        .select(*COLUMNS, "item_type")
    )
