"""Shared connections, flattened."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flatten_connections(connections: DataFrame) -> DataFrame:
    """Six text columns per connection; a missing field reads as ''."""
    def text(name):
        return F.coalesce(F.col(name), F.lit(""))

    return connections.select(
        text("id").alias("connection_id"),
        text("displayName").alias("display_name"),
        text("connectivityType").alias("connectivity_type"),
        text("connectionDetails.type").alias("connector_type"),
        text("gatewayId").alias("gateway_id"),
        text("connectionDetails.path").alias("path"),
    )


def connection_listing(connections: DataFrame, errors: DataFrame) -> DataFrame:
    """Per tenant: how many connections were listed and why the listing failed, if it did.

    An empty list with an error is a blocked listing, not an empty estate.
    """
    counts = connections.groupBy("tenant_id").agg(F.count("*").alias("connections"))
    return (
        errors.join(counts, "tenant_id", "full_outer")
        .select(
            "tenant_id",
            F.coalesce("connections", F.lit(0)).alias("connections"),
            F.col("error").alias("listing_error"),
            F.col("error").isNull().alias("readable"),
        )
    )
