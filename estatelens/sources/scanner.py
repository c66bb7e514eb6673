"""Tenant export: nested workspaces to flat item and expression rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import explode_each
from ..functions.text import VARIANT_DEPTH, looks_like_m, non_empty, read_json

# Items stay VARIANT: their shape differs between export versions, and keys
# that differ only in case (m, M) must stay apart.
EXPORT_SCHEMA = "id STRING, name STRING, datasets ARRAY<VARIANT>, dataflows ARRAY<VARIANT>"
# The fields that are looked at, for documents that nest too deeply for VARIANT elsewhere.
_FIELDS = (
    "id STRING, name STRING,"
    " datasets ARRAY<STRUCT<id STRING, name STRING, tables ARRAY<STRUCT<name STRING, source ARRAY<STRUCT<expression STRING>>>>,"
    " expressions ARRAY<STRUCT<name STRING, expression STRING>>>>,"
    " dataflows ARRAY<STRUCT<id STRING, objectId STRING, name STRING, document STRING, queries ARRAY<MAP<STRING, STRING>>,"
    " entities ARRAY<STRUCT<name STRING, partitions ARRAY<STRUCT<expression STRING>>>>>>"
)


def text_at(node: Column, path: str) -> Column:
    """The string at a path; NULL when the value is missing or no string."""
    value = F.try_variant_get(node, path, "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(node, path, "string"))


def array_at(node: Column, path: str) -> Column:
    """The array at a path, empty when missing."""
    empty = F.array().cast("array<variant>")
    return F.coalesce(F.try_variant_get(node, path, "array<variant>"), empty)


def export_items(payloads: DataFrame) -> DataFrame:
    """Workspace documents (``payload`` JSON text) to one row per dataset or dataflow.

    A document that nests too deeply for VARIANT is read by the fields that are
    looked at; its nodes have no others.
    """
    payload = F.col("payload")
    may_be_deep = F.regexp_count(payload, F.lit(r"[\[{]")) > VARIANT_DEPTH
    unread = F.col("w.datasets").isNull() | F.col("w.dataflows").isNull()
    ws = payloads.select("payload", read_json(payload, EXPORT_SCHEMA).alias("w")).select(
        "w", F.when(unread & may_be_deep, read_json(payload, _FIELDS)).alias("f"))
    keys = [
        F.coalesce("w.id", "f.id", F.lit("")).alias("workspace_id"),
        F.coalesce("w.name", "f.name", F.lit("")).alias("workspace_name"),
    ]

    def item(kind):
        def shape(node):
            id_ = text_at(node, "$.id")
            if kind == "Dataflow":
                id_ = F.coalesce(text_at(node, "$.objectId"), id_)
            return F.struct(
                F.coalesce(id_, F.lit("")).alias("item_id"),
                F.coalesce(text_at(node, "$.name"), F.lit("")).alias("item_name"),
                F.lit(kind).alias("item_type"),
                node.alias("node"),
            )
        return shape

    def listed(name, kind):
        nodes = F.coalesce(F.col(f"w.{name}"), F.transform(F.col(f"f.{name}"), F.to_variant_object))
        none = F.array().cast(
            "array<struct<item_id:string,item_name:string,item_type:string,node:variant>>"
        )
        return F.coalesce(F.transform(nodes, item(kind)), none)

    both = F.concat(listed("datasets", "SemanticModel"), listed("dataflows", "Dataflow"))
    return explode_each(ws, keys, both, "_no", "i").select("workspace_id", "workspace_name", "i.*")


def _named(name: Column, expression: Column) -> Column:
    return F.struct(name.alias("expr_name"), expression.alias("expression"))


def _name(node: Column) -> Column:
    return F.coalesce(text_at(node, "$.name"), F.lit("?"))


def dataset_entries(node: Column) -> Column:
    """Table sources with an expression, then shared expressions."""
    tables = F.flatten(F.transform(
        array_at(node, "$.tables"),
        lambda t: F.transform(
            array_at(t, "$.source"),
            lambda s: _named(_name(t), non_empty(text_at(s, "$.expression"))),
        ),
    ))
    shared = F.transform(
        array_at(node, "$.expressions"),
        lambda e: _named(
            F.concat(F.lit("shared:"), _name(e)),
            F.coalesce(text_at(e, "$.expression"), F.lit("")),
        ),
    )
    return F.concat(F.filter(tables, lambda x: x["expression"].isNotNull()), shared)


def dataflow_entries(node: Column) -> Column:
    """Query code by the first key that has some, entity partitions, an M-like document."""
    queries = F.transform(
        array_at(node, "$.queries"),
        lambda q: _named(_name(q), F.coalesce(
            *[non_empty(text_at(q, f"$.{k}")) for k in ("mCode", "expression", "m", "M")]
        )),
    )
    entities = F.flatten(F.transform(
        array_at(node, "$.entities"),
        lambda e: F.transform(
            array_at(e, "$.partitions"),
            lambda p: _named(_name(e), non_empty(text_at(p, "$.expression"))),
        ),
    ))
    document = text_at(node, "$.document")
    whole = F.array(_named(F.lit("document"), F.when(looks_like_m(document), document)))
    return F.filter(F.concat(queries, entities, whole), lambda x: x["expression"].isNotNull())


def export_expressions(items: DataFrame) -> DataFrame:
    """Every expression of every exported item, in document order."""
    entries = F.when(F.col("item_type") == "Dataflow", dataflow_entries(F.col("node"))).otherwise(
        dataset_entries(F.col("node"))
    )
    keys = [c for c in items.columns if c != "node"]
    return explode_each(items, keys, entries, "expr_idx", "e").select(*keys, "expr_idx", "e.*")
