"""Definition documents to M expressions.

Each document is handled inside its own row with array functions and one
explode, so extraction neither shuffles nor reads its input twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import fixed_values as fv
from ..functions.arrays import explode_each
from ..functions.text import (
    base64_alphabet,
    decode_base64,
    looks_like_m,
    is_too_deep,
    read_json,
    strip,
)

ENVELOPE = "definition STRUCT<parts ARRAY<STRUCT<path STRING, payload STRING>>>"
_TABLES = (
    "tables ARRAY<STRUCT<name STRING, partitions ARRAY<STRUCT<name STRING,"
    " source STRUCT<type STRING, expression VARIANT>>>>>,"
    " expressions ARRAY<STRUCT<name STRING, expression VARIANT>>"
)
_MODEL = f"model STRUCT<{_TABLES}>, {_TABLES}"
_ENTRY = "array<struct<expr_name:string,expression:string>>"

# A JSON string value that sits under a key: the key is skipped with it, and a
# string without a key is consumed whole so that its content cannot match.
_JSON_STRING = r'"(?:[^"\\]++|\\.)*+"'
_KEYED_STRING = rf"(?s)({_JSON_STRING})\s*+:\s*+({_JSON_STRING})|{_JSON_STRING}"

_NEWLINES = r"\r\n|[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
_SOURCE_BLOCK = (
    r"(?mUd)^[^\S\n]*+source =([^\n]*+"
    r"(?:\n(?![^\S\n]*+source =)(?:[ \t][^\n]*+|[^\S\n]*+(?=\n|\z)))*+)"
)


# --- parts -----------------------------------------------------------------------


def definition_parts(definitions: DataFrame) -> DataFrame:
    """Envelope JSON to one decoded text per part, in part order."""
    keys = [c for c in definitions.columns if c != "definition"]
    parts = read_json(F.col("definition"), ENVELOPE)["definition"]["parts"]
    return (
        explode_each(definitions, keys, parts, "part_idx", "p")
        .select(
            *keys,
            "part_idx",
            F.coalesce("p.path", F.lit("")).alias("path"),
            base64_alphabet(F.col("p.payload")).alias("_kept"),
        )
        .withColumn("text", decode_base64(F.col("_kept")))
        .drop("_kept")
    )


# --- one document to entries ------------------------------------------------------


def _entry(name: Column, expression: Column) -> Column:
    return F.struct(name.alias("expr_name"), expression.alias("expression"))


def join_lines(value: Column) -> Column:
    """A list of lines joined with newlines, or the text itself."""
    lines = F.try_variant_get(value, "$", "array<string>")
    return F.when(
        F.schema_of_variant(value).startswith("ARRAY"), F.array_join(lines, "\n", "None")
    ).otherwise(F.try_variant_get(value, "$", "string"))


def model_json(text: Column) -> Column:
    """Parsed model document; invalid JSON is NULL and yields nothing."""
    return read_json(text, _MODEL)


def _model(doc: Column, field: str) -> Column:
    return F.when(doc["model"].isNotNull(), doc["model"][field]).otherwise(doc[field])


def tmsl_partition_entries(doc: Column) -> Column:
    """Partitions whose source is M, named table.partition."""
    def of_table(t):
        m_only = F.filter(
            t["partitions"],
            lambda p: (p["source"]["type"] == "m") & p["source"]["expression"].isNotNull(),
        )
        return F.transform(m_only, lambda p: _entry(
            F.concat(F.coalesce(t["name"], F.lit("?")), F.lit("."), F.coalesce(p["name"], F.lit(""))),
            join_lines(p["source"]["expression"]),
        ))
    tables = F.filter(_model(doc, "tables"), lambda t: t["partitions"].isNotNull())
    return _or_none(F.flatten(F.transform(tables, of_table)))


def tmsl_shared_entries(doc: Column) -> Column:
    return _or_none(F.transform(_model(doc, "expressions"), lambda e: _entry(
        F.concat(F.lit("shared:"), F.coalesce(e["name"], F.lit("?"))),
        F.coalesce(join_lines(e["expression"]), F.lit("")),
    )))


def written_expressions(doc: Column) -> Column:
    """(expr_name, is_list, expression) of every partition of every table and every shared expression, whatever its kind."""
    def entry(name, value):
        return F.struct(name.alias("expr_name"), F.schema_of_variant(value).startswith("ARRAY").alias("is_list"),
                        join_lines(value).alias("expression"))

    def of_table(t):
        return F.transform(t["partitions"], lambda p: entry(
            F.concat(F.coalesce(t["name"], F.lit("?")), F.lit("."), F.coalesce(p["name"], F.lit(""))), p["source"]["expression"]))

    none = F.array().cast("array<struct<expr_name:string,is_list:boolean,expression:string>>")
    tables = F.filter(_model(doc, "tables"), lambda t: t["partitions"].isNotNull())
    shared = F.transform(_model(doc, "expressions"), lambda e: entry(
        F.concat(F.lit("shared:"), F.coalesce(e["name"], F.lit("?"))), e["expression"]))
    every = F.concat(F.coalesce(F.flatten(F.transform(tables, of_table)), none), F.coalesce(shared, none))
    return F.filter(every, lambda e: e["expression"].isNotNull())


def tmdl_entries(text: Column, path: Column) -> Column:
    """Blocks from a ``source =`` line to the next one or the next unindented line."""
    lines = F.regexp_replace(F.regexp_replace(text, _NEWLINES, "\n"), r"\n\z", "")
    blocks = F.regexp_extract_all(lines, F.lit(_SOURCE_BLOCK), F.lit(1))

    def shape(b):
        first = strip(F.regexp_extract(b, r"\A[^\n]*", 0))
        rest = F.regexp_replace(b, r"\A[^\n]*\n?", "")
        body = F.when(~b.contains("\n"), first).when(first == "", rest).otherwise(
            F.concat(first, F.lit("\n"), rest)
        )
        return _entry(path, body)

    kept = F.filter(blocks, lambda b: b.contains("\n") | (strip(b) != ""))
    return F.transform(kept, shape)


def keyed_strings(text: Column) -> Column:
    """array<struct<key, value>>: every string under a key, at any depth of a JSON text."""
    keys = F.regexp_extract_all(text, F.lit(_KEYED_STRING), F.lit(1))
    values = F.regexp_extract_all(text, F.lit(_KEYED_STRING), F.lit(2))
    pairs = F.filter(
        F.arrays_zip(keys.alias("key"), values.alias("value")), lambda p: p["value"] != ""
    )
    valid = read_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>").isNotNull()
    return F.when(valid, F.transform(pairs, lambda p: F.struct(
        _unquote(p["key"]).alias("key"), _unquote(p["value"]).alias("value")
    )))


def _unquote(literal: Column) -> Column:
    plain = F.substring(literal, F.lit(2), F.length(literal) - 2)
    escaped = F.get(read_json(F.concat(F.lit("["), literal, F.lit("]")), "array<string>"), F.lit(0))
    return F.when(literal.contains("\\"), escaped).otherwise(plain)


def dataflow_json_entries(text: Column, path: Column) -> Column:
    """M-like strings of a JSON document, read as they are or base64-decoded."""
    def candidate(p):
        decoded = decode_base64(base64_alphabet(p["value"]))
        return F.when(looks_like_m(p["value"]), p["value"]).when(looks_like_m(decoded), decoded)

    found = F.filter(F.transform(keyed_strings(text), candidate), lambda x: x.isNotNull())
    return _or_none(F.transform(found, lambda x: _entry(path, x)))


def strings_for_key(documents: DataFrame, text: str, key: str) -> DataFrame:
    """Every string stored under ``key`` at any depth, in document order."""
    keys = [c for c in documents.columns if c != text]
    hits = F.filter(keyed_strings(F.col(text)), lambda p: p["key"] == key)
    return explode_each(documents, keys, hits, "hit_idx", "h").select(
        *keys, "hit_idx", F.col("h.value").alias("value")
    )


def _or_none(entries: Column) -> Column:
    return F.coalesce(entries, F.array().cast(_ENTRY))


# --- routing ----------------------------------------------------------------------


def part_entries(item_type: Column, path: Column, text: Column, doc: Column) -> Column:
    """The expressions of one part, by item type and file name."""
    low = F.lower(path)
    none = F.array().cast(_ENTRY)
    of_model = (
        F.when(path.endswith(".bim"), F.concat(tmsl_partition_entries(doc), tmsl_shared_entries(doc)))
        .when(path.endswith(".tmdl"), tmdl_entries(text, path))
        .otherwise(none)
    )
    of_dataflow = (
        F.when(low.rlike(r"\.(pq|m)$"), F.array(_entry(low, text)))
        .when(low.endswith("model.json"), dataflow_json_entries(text, low))
        .otherwise(none)
    )
    generic = F.when(
        text.contains("let") | text.contains("Source"), F.array(_entry(path, text))
    ).otherwise(none)
    return (
        F.when(text == "", none)
        .when(item_type.isin(fv.DATASET_TYPES), of_model)
        .when(item_type == "Dataflow", of_dataflow)
        .otherwise(generic)
    )


def definition_expressions(definitions: DataFrame) -> DataFrame:
    """Every M expression of every definition.

    Input: key columns, ``item_type``, ``definition`` (envelope JSON). Output:
    keys, ``part_idx``, ``path``, ``expr_idx``, ``expr_name``, ``expression``.
    """
    parts = definition_parts(definitions)
    keys = [c for c in parts.columns if c != "text"]
    is_model = F.col("item_type").isin(fv.DATASET_TYPES) & F.col("path").endswith(".bim")
    parsed = parts.withColumn("_doc", model_json(F.when(is_model, F.col("text"))))
    entries = part_entries(F.col("item_type"), F.col("path"), F.col("text"), F.col("_doc"))
    return explode_each(parsed, keys, entries, "expr_idx", "e").select(*keys, "expr_idx", "e.*")


def too_deep(definitions: DataFrame) -> DataFrame:
    """Items with a model or activity document that nests too deeply to be read; they yield nothing."""
    keys = [c for c in definitions.columns if c not in ("definition", "item_type")]
    path = F.col("path")
    is_model = F.col("item_type").isin(fv.DATASET_TYPES) & path.endswith(".bim")
    read = is_model | F.lower(path).endswith("pipeline-content.json")
    return definition_parts(definitions).filter(read).filter(is_too_deep(F.col("text"))).select(*keys).distinct()


def prefer_fast_source(fast: DataFrame, parsed: DataFrame, keys) -> DataFrame:
    """Frame rows of a model where there are any, else its parsed definition."""
    fallback = parsed.join(fast.select(*keys).distinct(), keys, "left_anti")
    return fast.withColumn("source", F.lit("sempy")).unionByName(
        fallback.withColumn("source", F.lit("rest")), allowMissingColumns=True
    )


def fast_hits(expressions: DataFrame, keys) -> DataFrame:
    """How many items each source served."""
    return (
        expressions.select(*keys, "source").distinct().groupBy("source").agg(F.count("*").alias("items"))
    )
