"""The dashboard snapshot, and the writers of the report tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import events
from ..sinks import committed

_NUMBERS = ("bigint", "int", "double", "decimal", "float")


def _cells(rows: DataFrame, section: str, entry: str | None) -> DataFrame:
    """(section, entry, name, number, text): one typed row per cell; ``entry`` is the column that tells rows apart."""
    def cell(name: str, kind: str) -> Column:
        value = F.col(name)
        number = value.cast("double") if kind.startswith(_NUMBERS) else F.lit(None).cast("double")
        text = F.lit(None).cast("string") if kind.startswith(_NUMBERS) else _text(value, kind)
        return F.struct(F.lit(name).alias("name"), number.alias("number"), text.alias("text"))

    named = F.lit("") if entry is None else F.coalesce(_text(F.col(entry), dict(rows.dtypes)[entry]), F.lit(""))
    cells = F.array(*[cell(name, kind) for name, kind in rows.dtypes if name != entry])
    return rows.select(F.lit(section).alias("section"), named.alias("entry"), F.inline(cells))


def _text(value: Column, kind: str) -> Column:
    return F.date_format(value, "yyyy-MM-dd HH:mm:ss") if kind.startswith("timestamp") else value.cast("string")


def snapshot(
    scans: DataFrame, traffic: DataFrame | None = None, clones: DataFrame | None = None, releases: DataFrame | None = None
) -> DataFrame:
    """Every section of the dashboard as typed cells: (section, entry, name, number, text).

    ``scans`` is the fact table, stored, since every section reads some of its
    columns; ``traffic`` the event log, ``clones`` (day, count, uniques) and
    ``releases`` (tag_name, name, published_at, html_url, assets) come straight
    from the code host. Clones that are newer than the log override its sums.
    """
    parts = [
        ("reach", None, events.reach(scans)),
        ("resolution", None, events.resolution_rollup(scans)),
        ("value", None, events.value_rollup(scans)),
        ("trend", "day", events.daily_trend(scans)),
        ("versions", "version", events.version_adoption(scans)),
        ("per_workspace", "workspace", events.workspace_progress(scans)),
        ("skip_reasons", "reason", events.skip_reason_rollup(scans)),
        ("state_backends", "backend", events.backend_split(scans)),
        ("first_vs_return", "is_first_run", events.first_vs_return(scans)),
    ]
    if traffic is not None:
        latest = events.traffic_latest(traffic)
        if clones is not None:
            latest = events.clones_patch(latest, clones.agg(F.sum("count").alias("count"), F.max("uniques").alias("uniques")))
        parts.append(("github", None, latest))
    if clones is not None:
        parts.append(("clones_history", "day", clones))
    if releases is not None:
        parts.append(("releases", "url", events.release_list(releases)))
    return reduce(DataFrame.unionByName, [_cells(rows, section, entry) for section, entry, rows in parts])


def write_snapshot(snapshot_rows: DataFrame, folder: str, version: str | None = None) -> int:
    """The snapshot as a committed table, in files of an even size, few where it is small.

    The sections are made in as many tasks as they have; only their cells are dealt anew for writing.
    """
    return committed.write(snapshot_rows.hint("rebalance"), folder, version)


def write_calls(call_table: DataFrame, folder: str, version: str | None = None) -> int:
    """The report table as a committed table, in ranges of (workspace, item).

    A file covers few workspaces, so its statistics let readers skip it; a big
    workspace is cut into several ranges, and small ones share a file.
    """
    ranged = call_table.repartitionByRange("workspace_id", "item_id", "m_function")
    return committed.write(ranged.sortWithinPartitions("workspace_id", "item_id"), folder, version)


def write_validation(validation_table: DataFrame, folder: str, version: str | None = None) -> int:
    """The validation table as a committed table, one folder per status."""
    ranged = validation_table.repartitionByRange("status", "workspace_id", "item_id")
    return committed.write(ranged.sortWithinPartitions("workspace_id", "item_id"), folder, version, ["status"])
