"""Connection references of activity documents (orchestration items).

A document's activity tree is flattened inside its row, level by level, with
array functions over VARIANT nodes, then exploded once. A document that nests
deeper than ``text.VARIANT_DEPTH`` JSON levels (some 500 containers) is not read;
``extract.too_deep`` names its item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import dimensions
from ..catalog import fixed_values as fv
from ..functions.arrays import explode_each
from ..functions.text import base64_alphabet, decode_base64, non_empty, read_json
from ..sources.scanner import array_at, text_at
from .extract import ENVELOPE
from .rules import first_rules

_NODES = "array<struct<path:array<int>,node:variant>>"


def activity_documents(definitions: DataFrame) -> DataFrame:
    """One document per item: its first part named ...pipeline-content.json."""
    keys = [c for c in definitions.columns if c != "definition"]
    parts = read_json(F.col("definition"), ENVELOPE)["definition"]["parts"]
    matching = F.filter(parts, lambda p: F.lower(p["path"]).endswith("pipeline-content.json"))
    return (
        definitions.select(*keys, base64_alphabet(F.get(matching, F.lit(0))["payload"]).alias("_kept"))
        .withColumn("text", decode_base64(F.col("_kept")))
        .withColumn("doc", read_json(F.col("text"), "variant"))
        .filter(F.col("doc").isNotNull())
        .drop("_kept")
    )


def _is_object(node: Column) -> Column:
    return F.try_variant_get(node, "$", "map<string,variant>").isNotNull()


def _objects(nodes: Column) -> Column:
    return F.filter(nodes, _is_object)


def _children(node: Column) -> Column:
    """Direct child activities, in walking order."""
    direct = [array_at(node, f"$.typeProperties.{k}") for k in fv.CHILD_KEYS]
    cases = F.flatten(
        F.transform(array_at(node, "$.typeProperties.cases"), lambda c: array_at(c, "$.activities"))
    )
    default = array_at(node, "$.typeProperties.defaultActivities")
    nested = _objects(F.concat(*direct, cases, default))
    return F.when(text_at(node, "$.type").isin(fv.CONTAINER_TYPES), nested).otherwise(
        F.array().cast("array<variant>")
    )


def _next_level(level: Column) -> Column:
    return F.flatten(F.transform(level, lambda parent: F.transform(
        _children(parent["node"]),
        lambda child, i: F.struct(
            F.concat(parent["path"], F.array(i)).alias("path"), child.alias("node")
        ),
    )))


def flatten_activities(documents: DataFrame) -> DataFrame:
    """One row per activity, containers included, ordered by ``path`` (pre-order).

    ``path`` holds the position at every level; sorting by it gives the order in
    which the document lists its activities. Level follows level until no child
    is left; a level opens at least one object, so the braces bound the depth.
    """
    keys = [c for c in documents.columns if c not in ("text", "doc")]
    roots = F.transform(
        _objects(array_at(F.col("doc"), "$.properties.activities")),
        lambda node, i: F.struct(F.array(i).alias("path"), node.alias("node")),
    )
    start = F.struct(F.array().cast(_NODES).alias("done"), roots.cast(_NODES).alias("level"))

    def step(acc, _):
        deeper = F.struct(
            F.concat(acc["done"], acc["level"]).alias("done"),
            _next_level(acc["level"]).cast(_NODES).alias("level"),
        )
        return F.when(F.size(acc["level"]) > 0, deeper).otherwise(acc)

    levels = F.sequence(F.lit(0), F.regexp_count("text", F.lit(r"\{")))
    nodes = F.aggregate(levels, start, step, lambda acc: acc["done"])
    return explode_each(documents, keys, nodes, "_no", "a").select(*keys, "a.*")


# --- references --------------------------------------------------------------------


def activity_refs(activities: DataFrame) -> DataFrame:
    """One row per (activity, role) that carries a reference object."""
    keys = [c for c in activities.columns if c != "node"]
    node = F.col("node")

    def role(name, path):
        return F.struct(
            F.lit(name).alias("role"),
            F.try_variant_get(node, f"$.typeProperties.{path}", "variant").alias("ref"),
        )

    roles = []
    for side in ("source", "sink"):
        roles += [role(side, side), role(f"{side}.datasetSettings", f"{side}.datasetSettings")]
    roles += [role(name, name) for name in fv.ROOT_REF_ROLES]
    objects = F.filter(F.array(*roles), lambda r: _is_object(r["ref"]))
    named = [
        F.coalesce(text_at(node, "$.name"), F.lit("?")).alias("activity_name"),
        F.coalesce(text_at(node, "$.type"), F.lit("?")).alias("activity_type"),
    ]
    return explode_each(activities, [*keys, *named], objects, "role_idx", "r").select(
        *keys, "activity_name", "activity_type", "role_idx", "r.*"
    )


def ref_connections(refs: DataFrame) -> DataFrame:
    """Connection id and inline type of each reference; rows with neither go."""
    ref = F.col("ref")

    def at(path):
        return non_empty(text_at(ref, path))

    named = F.try_variant_get(ref, "$.linkedServiceName", "variant")
    empty = F.schema_of_variant(named).isin("VOID", "OBJECT<>", "ARRAY<VOID>") | F.coalesce(
        text_at(ref, "$.linkedServiceName") == "", F.lit(False))
    service = F.when(named.isNotNull() & ~empty, named).otherwise(F.try_variant_get(ref, "$.linkedService", "variant"))
    with_service = refs.withColumn("_service", service)
    svc = F.col("_service")
    return with_service.select(
        *[c for c in refs.columns if c != "ref"],
        F.coalesce(
            at("$.connectionId"),
            at("$.connectionReference.connectionId"),
            at("$.externalReferences.connection"),
            at("$.connection"),
            at("$.referenceName"),
            non_empty(text_at(svc, "$.referenceName")),
            non_empty(text_at(svc, "$.properties.typeProperties.connectionId")),
        ).alias("connection_id"),
        non_empty(text_at(svc, "$.properties.type")).alias("inline_type"),
    ).filter(F.col("connection_id").isNotNull() | F.col("inline_type").isNotNull())


def resolve_connections(refs: DataFrame, connections: DataFrame, names=None) -> DataFrame:
    """Connector prefix and display name of each reference.

    ``connections`` is the flattened listing; of rows with one id the greatest
    (type, name) counts. An id that is not listed stays visible as an unresolved connection. The listing is
    joined without a hint: its size is the estate's, and Spark picks the strategy.
    """
    spark = refs.sparkSession
    listed = (
        connections.filter(F.col("connection_id") != "")
        .groupBy("connection_id")
        .agg(F.max(F.struct(F.col("connector_type").alias("_type"), F.col("display_name").alias("_title"))).alias("_c"))
        .select("connection_id", "_c.*", F.lit(True).alias("_listed"))
    )
    friendly = dimensions.prefix_names(spark, names)
    joined = refs.join(listed, "connection_id", "left").withColumn(
        "_written",
        F.when(F.col("_listed"), non_empty(F.substring_index("_type", ".", 1)))
        .otherwise(non_empty(F.substring_index("inline_type", ".", 1))),
    )
    resolved = joined.join(friendly, F.lower("_written") == F.col("prefix_key"), "left")
    return resolved.select(
        *refs.columns,
        F.lower("_written").alias("connector_prefix"),
        F.when(F.col("_written").isNotNull(), F.coalesce("friendly_name", "_written"))
        .when(F.col("_listed"), F.coalesce(non_empty(F.col("_title")), F.lit("Connection")))
        .when(F.col("connection_id").isNotNull(), F.lit("Unresolved connection"))
        .otherwise("Unknown")
        .alias("connector_kind"),
    )


def ref_migration(kind: Column, prefix: Column, rules=None) -> Column:
    """Bucket of the first rule whose kind or family is contained in the connector."""
    rules = fv.CONNECTOR_RULES if rules is None else rules
    kind, prefix = F.lower(kind), F.coalesce(F.lower(prefix), F.lit(""))
    case = F
    for rule_kind, _, family, bucket in rules:
        case = case.when(kind.contains(rule_kind.lower()) | prefix.contains(family), F.lit(bucket))
    return case.otherwise("none")


def migration_rules(spark, rules=None) -> DataFrame:
    """The catalog's containment rules as rows: (rule_no, field, needle, bucket)."""
    rules = fv.CONNECTOR_RULES if rules is None else rules
    rows = [(i, field, needle, bucket) for i, (kind, _, family, bucket) in enumerate(rules, start=1)
            for field, needle in (("_kind", kind.lower()), ("_prefix", family))]
    return spark.createDataFrame(rows, "rule_no bigint, field string, needle string, bucket string")


def ref_migrations(resolved: DataFrame, rules: DataFrame) -> DataFrame:
    """``ref_migration`` by a table of rules of any length; adds ``migration``."""
    seen = resolved.withColumns({
        "_kind": F.lower("connector_kind"), "_prefix": F.coalesce(F.lower("connector_prefix"), F.lit(""))})
    buckets = rules.groupBy("rule_no").agg(F.min("bucket").alias("migration"))
    return first_rules(seen, ["_kind", "_prefix"], rules, "rule_no").join(buckets, "rule_no", "left").select(
        *resolved.columns, F.coalesce("migration", F.lit("none")).alias("migration"))


def refs_to_calls(resolved: DataFrame, rules=None) -> DataFrame:
    """References as call rows: never pinned, no custom DSN, gateway unknown."""
    where = F.concat(
        "activity_type", F.lit(" activity '"), "activity_name", F.lit("' (role="), "role", F.lit(")")
    )
    target = F.when(
        F.col("connection_id").isNotNull(), F.concat(F.lit(" -> connectionId="), "connection_id")
    ).otherwise(F.concat(F.lit(" -> inline linkedService.type="), "inline_type"))
    dropped = {
        "activity_name", "activity_type", "role", "role_idx", "path", "connection_id",
        "inline_type", "connector_prefix", "connector_kind",
    }
    keys = [c for c in resolved.columns if c not in dropped]
    migration = ref_migration(F.col("connector_kind"), F.col("connector_prefix"), rules)
    return resolved.select(
        *keys,
        F.concat_ws(".", F.transform("path", lambda i: F.lpad(i.cast("string"), 10, "0"))).alias("expr_name"),
        F.col("role_idx").alias("call_pos"),
        F.col("activity_type").alias("m_function"),
        "connector_kind",
        migration.alias("migration"),
        F.lit(None).cast("string").alias("implementation"),
        F.col("connection_id").alias("endpoint_hint"),
        F.lit(False).alias("custom_dsn"),
        F.concat(where, target).alias("excerpt"),
    ).withColumns({
        "is_migrating": F.col("migration") != "none",
        "is_pinned_odbc": F.lit(False),
        "is_pinned_adbc": F.lit(False),
    })


def activity_calls(definitions: DataFrame, connections: DataFrame, rules=None, names=None) -> DataFrame:
    """Definitions of orchestration items to call rows, end to end."""
    refs = ref_connections(activity_refs(flatten_activities(activity_documents(definitions))))
    return refs_to_calls(resolve_connections(refs, connections, names), rules)
