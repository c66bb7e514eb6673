"""Item, workspace and gateway inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import non_empty


def list_items(items: DataFrame, item_type: str | None = None) -> DataFrame:
    """Items, filtered by type at the scan."""
    return items if item_type is None else items.filter(F.col("item_type") == item_type)


def list_workspaces(
    workspaces: DataFrame, exclude_personal: bool = True, ids: DataFrame | None = None
) -> DataFrame:
    """Workspaces, personal ones left out by default, or only those in ``ids``."""
    if ids is not None:
        return workspaces.join(ids.select("workspace_id"), "workspace_id", "left_semi")
    return workspaces.filter(~F.col("is_personal")) if exclude_personal else workspaces


def gateway_states(items: DataFrame, datasources: DataFrame, dataset_types) -> DataFrame:
    """(workspace_id, item_id, has_gateway): true, false, or NULL for unknown.

    ``datasources`` has one row per bound source of a dataset with ``gateway_id``
    and ``readable`` (false when the list could not be read). A readable empty
    list is a row with a NULL gateway. Only datasets can have a known state.
    """
    keys = ["workspace_id", "item_id"]
    bound = datasources.groupBy(*keys).agg(
        F.bool_or(non_empty(F.col("gateway_id")).isNotNull()).alias("_bound"),
        F.bool_and("readable").alias("_readable"),
    )
    return items.join(bound, keys, "left").select(
        *keys,
        F.when(F.col("item_type").isin(dataset_types) & F.col("_readable"), F.col("_bound")).alias(
            "has_gateway"
        ),
    )
