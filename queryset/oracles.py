"""SQL twins of the registered queries.

Expected rows are stated from the keys of the given tables, never by reading
derived text, wherever the inputs are derived documents. ``PARTS`` holds named
sub-queries; a twin pulls in those it names.
"""

from __future__ import annotations

import re

from estatelens.catalog import fixed_values as fv

from .fixtures import CUTOVER, ERROR_TEXTS, KINDS, WAIT_MINUTES

PARTS: dict[str, str] = {}
ORACLES: dict[str, str] = {}


def _needed(body: str) -> list[str]:
    """Sub-queries named in the text, in order of definition, with their own needs."""
    wanted: set[str] = set()
    todo = [body]
    while todo:
        words = set(re.findall(r"\b[a-z]\w*\b", todo.pop()))
        for name in PARTS:
            if name in words and name not in wanted:
                wanted.add(name)
                todo.append(PARTS[name])
    return [n for n in PARTS if n in wanted]


def oracle(name: str, body: str) -> None:
    ctes = ",\n".join(f"{n} AS ({PARTS[n]})" for n in _needed(body))
    inner = body.strip()
    if ctes and inner.startswith("WITH "):
        ORACLES[name] = f"WITH {ctes},\n{inner[5:]}"
    else:
        ORACLES[name] = f"WITH {ctes}\n{body}" if ctes else body


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _values(rows, columns: str) -> str:
    body = ", ".join("(" + ", ".join(_lit(v) if isinstance(v, str) else ("NULL" if v is None else str(v)) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) t({columns})"


def _case(expr: str, mapping: dict, default: str) -> str:
    whens = " ".join(f"WHEN {_lit(k)} THEN {_lit(v)}" for k, v in mapping.items())
    return f"CASE {expr} {whens} ELSE {default} END"


# --- items --------------------------------------------------------------------------

PARTS["base"] = """
SELECT p_partkey AS k, 'ws-' || (p_partkey % 23) AS workspace_id,
  'Workspace ' || (p_partkey % 23) AS workspace_name, 'item-' || p_partkey AS item_id, p_name AS item_name,
  CASE WHEN p_partkey % 10 <= 4 THEN 'SemanticModel' WHEN p_partkey % 10 <= 6 THEN 'Dataflow'
       WHEN p_partkey % 10 = 7 THEN 'DataPipeline' WHEN p_partkey % 10 = 8 THEN 'Report' ELSE 'Notebook' END AS item_type,
  CASE p_partkey % 37 WHEN 0 THEN 'denied' WHEN 1 THEN 'deleted' WHEN 2 THEN 'unavailable' ELSE 'ok' END AS fetch_status,
  p_size, p_brand
FROM part"""

PARTS["gw"] = """
SELECT workspace_id, item_id, k, CASE WHEN item_type = 'SemanticModel' THEN
  CASE k % 3 WHEN 0 THEN true WHEN 1 THEN false END END AS has_gateway FROM base"""

_FUNCTION_ROWS = [
    (i, fn, kind, bucket) for i, (fn, kind, bucket) in enumerate(
        [(fn, kind, bucket) for kind, fns, _, bucket in fv.CONNECTOR_RULES for fn in fns]
        + [("Sql.Database", "SQL Server", "none"), ("Web.Contents", "Web", "none"),
           ("Excel.Workbook", "Excel", "none"), ("Salesforce.Reports", "Salesforce", "none"),
           ("Odbc.DataSource", "Generic ODBC", "none")])
]
PARTS["fns"] = _values(_FUNCTION_ROWS, "i, fn, kind, migration")

_COMMENT = '// Snowflake.Databases("old", [Implementation = "1.0"])'
_BLOCK = '/* Oracle.Database("gone") */'
_NOTE = '    Note = "Sql.Database(""x"", [Implementation=""1.0""]) // kept",'

# Every piece of an expression; pre / post are what stands before and after the call head.
PARTS["pieces"] = f"""
SELECT b.*, f.fn, f.kind, f.migration, (k // 10) % 3 AS pin, (k // 30) % 4 AS trap,
  CASE WHEN k % 11 = 0 THEN 'server=' || p_brand || ';pwd=s3cret' ELSE p_brand END AS ep,
  CASE (k // 30) % 4 WHEN 1 THEN {_lit(_COMMENT)} || chr(10) || {_lit(_BLOCK)} || ' let' || chr(10)
    WHEN 2 THEN 'let' || chr(10) || {_lit(_NOTE)} || chr(10) ELSE 'let' || chr(10) END AS head,
  CASE (k // 30) % 4 WHEN 1 THEN repeat(' ', {len(_COMMENT)}) || chr(10) || repeat(' ', {len(_BLOCK)}) || ' let' || chr(10)
    WHEN 2 THEN 'let' || chr(10) || {_lit(_NOTE)} || chr(10) ELSE 'let' || chr(10) END AS code_head,
  CASE (k // 10) % 3 WHEN 0 THEN '' ELSE ', [Implementation = "' || ((k // 10) % 3) || '.0"]' END AS opt,
  ',' || chr(10) || '    Rows = Table.SelectRows(Source, each [x] > 1)' || chr(10) || 'in' || chr(10) || '    Rows' AS tail
FROM base b JOIN fns f ON f.i = p_size % 26
WHERE item_type IN ('SemanticModel', 'Dataflow')"""

PARTS["texts"] = """
SELECT *, CASE WHEN k % 41 <> 0 THEN head || '    Source = ' || fn || '(' || arg || ', "db"' || opt || ')' || tail END AS expression,
  CASE WHEN k % 41 <> 0 THEN code_head || '    Source = ' || fn || '(' || arg || ', "db"' || opt || ')' || tail END AS code
FROM (SELECT *, CASE WHEN trap = 3 THEN inner_call ELSE '"' || ep || '"' END AS arg
      FROM (SELECT *, 'SomeHelper.Get("' || ep || '", [Implementation = "2.0"])' AS inner_call FROM pieces))"""

PARTS["exprs"] = "SELECT * FROM texts WHERE fetch_status = 'ok' AND expression IS NOT NULL"

_REDACT = "regexp_replace({x}, '(?i)\\b(pwd)\\s*=\\s*(\"[^\"]*\"|''[^'']*''|[^;\\s]+)', '\\1=***REDACTED***', 'g')"


def _excerpt(pre: str, fn: str, post: str) -> str:
    joined = f"right({pre}, 40) || {fn} || '(' || left({post}, 160)"
    return _REDACT.format(x=f"trim(replace({joined}, chr(10), ' '))")


PARTS["mcalls"] = f"""
SELECT workspace_id, item_id, item_type, k, 'Query' AS expr_name, 0 AS call_pos, kind AS connector_kind, fn AS m_function,
  migration, CASE WHEN trap = 3 THEN '2.0' WHEN pin = 0 THEN NULL ELSE pin || '.0' END AS implementation,
  {_REDACT.format(x="ep")} AS endpoint_hint, fn = 'Odbc.DataSource' AS custom_dsn,
  {_excerpt("(code_head || '    Source = ')", "fn", "(arg || ', \"db\"' || opt || ')' || tail)")} AS excerpt,
  '(' || arg || ', "db"' || opt || ')' AS win
FROM exprs
UNION ALL
SELECT workspace_id, item_id, item_type, k, 'Query', 1, 'SomeHelper', 'SomeHelper.Get', 'none', '2.0',
  {_REDACT.format(x="ep")}, false,
  {_excerpt("(code_head || '    Source = ' || fn || '(')", "'SomeHelper.Get'",
            "(substring(inner_call, 16) || ', \"db\"' || opt || ')' || tail)")},
  substring(inner_call, 15)
FROM exprs WHERE trap = 3"""

# --- activity documents ----------------------------------------------------------

PARTS["docs"] = """
SELECT *, k // 10 AS j, CASE WHEN (k // 10) % 6 = 0 THEN 'missing-' || k ELSE ((k // 10) % 10)::VARCHAR END AS cid,
  CASE WHEN (k // 10) % 3 = 0 THEN 'copy' WHEN (k // 10) % 3 = 1 THEN 'lookup'
       WHEN (k // 10) % 4 = 0 THEN 'deep' ELSE 'nested' END AS shape
FROM base WHERE item_type = 'DataPipeline' AND fetch_status = 'ok'"""

_DEEP_ROWS = [("deep", ".".join(["0"] * (d + 1)), "Deep", "Until") for d in range(9)]
_SHAPES = (
    [("copy", "0", "Copy1", "Copy"), ("lookup", "0", "Lookup1", "Lookup")]
    + _DEEP_ROWS + [("deep", ".".join(["0"] * 10), "Script1", "Script")]
    + [("nested", "0", "Each", "ForEach"), ("nested", "0.0", "If", "IfCondition"),
       ("nested", "0.0.0", "Script1", "Script"), ("nested", "0.0.1", "Web1", "WebActivity"),
       ("nested", "1", "Pick", "Switch"), ("nested", "1.0", "Script1", "Script"),
       ("nested", "1.1", "Web1", "WebActivity")])
PARTS["shape_rows"] = _values(
    [(*row, ".".join(step.zfill(10) for step in row[1].split("."))) for row in _SHAPES],
    "shape, path, activity_name, activity_type, padded_path")
PARTS["acts"] = """
SELECT d.workspace_id, d.item_id, d.item_type, d.k, d.j, d.cid, s.* FROM docs d JOIN shape_rows s USING (shape)"""
PARTS["ref_objects"] = """
SELECT a.*, r.role_idx, r.role, r.has_ref, r.inline_type FROM acts a JOIN (VALUES
  ('Copy', 0, 'source', false, NULL), ('Copy', 1, 'source.datasetSettings', true, NULL), ('Copy', 2, 'sink', true, NULL),
  ('Lookup', 0, 'dataset', true, 'AzureDatabricks.Tables'), ('Lookup', 1, 'linkedService', true, NULL),
  ('Script', 0, 'connectionReference', true, NULL)) r(activity_type, role_idx, role, has_ref, inline_type)
ON a.activity_type = r.activity_type"""
PARTS["conn_kinds"] = _values([
    ("0", "snowflake", "Snowflake", "odbc_to_adbc:snowflake"),
    ("1", "googlebigquery", "Google BigQuery", "odbc_to_adbc:bigquery"),
    ("2", "googlebigqueryaad", "Google BigQuery (AAD)", "odbc_to_adbc:bigquery"),
    ("3", "databricks", "Databricks", "odbc_to_adbc:databricks"),
    ("4", "databricks", "Databricks", "odbc_to_adbc:databricks"),
    ("5", "databricks", "Databricks", "odbc_to_adbc:databricks"),
    ("6", "databricksmulticloud", "DatabricksMultiCloud", "odbc_to_adbc:databricks"),
    ("7", "databricksmulticloud", "DatabricksMultiCloud", "odbc_to_adbc:databricks"),
    ("8", "dremio", "Dremio", "odbc_to_adbc:dremio"),
    ("9", None, "Supplier#000000009", "none"),
], "id, prefix, kind, migration")
PARTS["found_refs"] = """
SELECT o.* EXCLUDE (cid), CASE WHEN inline_type IS NULL THEN cid END AS connection_id FROM ref_objects o WHERE has_ref"""
PARTS["resolved_refs"] = """
SELECT r.*, CASE WHEN inline_type IS NOT NULL THEN 'azuredatabricks' ELSE c.prefix END AS connector_prefix,
  CASE WHEN inline_type IS NOT NULL THEN 'Azure Databricks' ELSE coalesce(c.kind, 'Unresolved connection') END AS connector_kind,
  CASE WHEN inline_type IS NOT NULL THEN 'odbc_to_adbc:databricks' ELSE coalesce(c.migration, 'none') END AS migration
FROM found_refs r LEFT JOIN conn_kinds c ON c.id = r.connection_id"""
PARTS["rcalls"] = """
SELECT workspace_id, item_id, item_type, k,
  padded_path AS expr_name,
  role_idx AS call_pos, connector_kind, activity_type AS m_function, migration, NULL::VARCHAR AS implementation,
  connection_id AS endpoint_hint, false AS custom_dsn,
  activity_type || ' activity ''' || activity_name || ''' (role=' || role || ')' ||
  CASE WHEN connection_id IS NOT NULL THEN ' -> connectionId=' || connection_id
       ELSE ' -> inline linkedService.type=' || inline_type END AS excerpt
FROM resolved_refs"""

PARTS["calls"] = "SELECT * EXCLUDE (win) FROM mcalls UNION ALL BY NAME SELECT * FROM rcalls"
PARTS["risks"] = """
SELECT c.*, g.has_gateway, migration <> 'none' AS is_migrating,
  coalesce(implementation LIKE '1%', false) AS pinned, coalesce(implementation LIKE '2%', false) AS pinned_new,
  CASE WHEN migration = 'none' THEN CASE WHEN custom_dsn THEN 'medium' ELSE 'na' END
    WHEN migration LIKE 'deprecation:%' THEN CASE WHEN coalesce(implementation LIKE '1%', false) THEN 'high' ELSE 'medium' END
    WHEN implementation LIKE '2%' THEN 'low'
    WHEN implementation LIKE '1%' THEN CASE WHEN has_gateway IS NULL THEN 'unknown' WHEN has_gateway THEN 'medium' ELSE 'high' END
    WHEN custom_dsn THEN 'medium' ELSE 'low' END AS risk
FROM calls c LEFT JOIN (SELECT workspace_id, item_id, has_gateway FROM gw) g USING (workspace_id, item_id)"""
PARTS["rel"] = "SELECT * FROM risks WHERE is_migrating OR custom_dsn"
_RANK = "CASE risk WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'unknown' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"
PARTS["arts"] = f"""
SELECT workspace_id, item_id, max({_RANK}) AS rank, bool_or(is_migrating) AS has_migrating, count(*)::BIGINT AS calls,
  (count(*) FILTER (pinned))::BIGINT AS pinned_odbc, (count(*) FILTER (custom_dsn))::BIGINT AS custom_dsn,
  (count(*) FILTER (pinned AND has_gateway = false))::BIGINT AS pinned_at_risk,
  CASE max({_RANK}) WHEN 4 THEN 'high' WHEN 3 THEN 'medium' WHEN 2 THEN 'unknown' WHEN 1 THEN 'low' ELSE 'na' END AS worst_risk
FROM rel GROUP BY ALL"""
PARTS["skip_rows"] = """
SELECT b.workspace_id, b.item_id, b.item_type,
  CASE WHEN item_type IN ('Report', 'Notebook') THEN 'type_not_inspected'
    WHEN fetch_status = 'denied' THEN 'permission_denied' WHEN fetch_status = 'deleted' THEN 'deleted_during_scan'
    WHEN fetch_status = 'unavailable' THEN 'definition_unavailable'
    WHEN item_type <> 'DataPipeline' AND k % 41 = 0 THEN 'definition_parsed_but_no_expressions'
    WHEN NOT any_relevant THEN 'no_migrating_connectors' END AS skip_reason
FROM base b LEFT JOIN (SELECT item_id, bool_or(is_migrating OR custom_dsn) AS any_relevant FROM risks GROUP BY 1) r USING (item_id)"""

# --- 2.1 ------------------------------------------------------------------------------

_ITEM_COLS = "workspace_id, workspace_name, item_id, item_name, item_type, fetch_status"
oracle("src_items", f"SELECT {_ITEM_COLS} FROM base WHERE item_type = 'SemanticModel'")
_WS = "SELECT DISTINCT workspace_id, workspace_name, (k % 23) % 5 = 0 AS is_personal FROM base"
oracle("src_workspaces", f"SELECT * FROM ({_WS}) WHERE NOT is_personal")
oracle("src_workspaces_by_id", f"SELECT * FROM ({_WS}) WHERE is_personal")

_ESC = "replace(replace({x}, '\"', '\\\"'), chr(10), '\\n')"
PARTS["doc_texts"] = f"""
SELECT *, CASE WHEN k % 10 IN (0, 2, 4) THEN 'model.bim' WHEN k % 10 < 5 THEN 'definition/T.tmdl'
    WHEN k % 10 = 5 THEN 'Mashup.pq' ELSE 'Model.json' END AS path,
  CASE WHEN k % 10 IN (0, 2, 4) THEN
      CASE WHEN expression IS NULL THEN '{{"model":{{"tables":[]}}}}' ELSE
        '{{"model":{{"tables":[{{"name":"T' || k || '","partitions":[{{"name":"P","source":{{"type":"m","expression":' ||
        CASE WHEN k % 4 = 0 THEN '["' || replace({_ESC.format(x="expression")}, '\\n', '","') || '"]'
             ELSE '"' || {_ESC.format(x="expression")} || '"' END ||
        '}}}}]}},{{"name":"C","partitions":[{{"name":"Calc","source":{{"type":"calculated","expression":"Sql.Database(1)"}}}}]}}]' ||
        CASE WHEN k % 4 = 0 THEN ',"expressions":[{{"name":"Param","expression":"\\"x\\" meta [IsParameterQuery=true]"}}]' ELSE '' END ||
        '}}}}' END
    WHEN k % 10 < 5 THEN 'table T' || k || chr(10) || CASE WHEN expression IS NULL THEN '' ELSE
        chr(10) || chr(9) || 'partition P = m' || chr(10) || chr(9) || chr(9) || 'mode: import' || chr(10) ||
        chr(9) || chr(9) || 'source =' || chr(10) || indented || chr(10) || chr(10) || 'annotation X = 1' || chr(10) END
    WHEN k % 10 = 5 THEN coalesce('section Section1;' || chr(10) || 'shared Query = ' || expression || ';', '')
    ELSE '{{"name":"m","pbi:mashup":{{"inner":{{' || coalesce('"document":"' ||
        CASE WHEN k % 4 = 2 THEN base64(encode(expression)) ELSE {_ESC.format(x="expression")} END || '"', '') ||
        '}}}},"list":["let x = Source"],"n":1}}' END AS text
FROM (SELECT *, repeat(chr(9), 4) || replace(expression, chr(10), chr(10) || repeat(chr(9), 4)) AS indented FROM texts)"""
oracle("src_definition_parts", """
SELECT workspace_id, item_id, 0::BIGINT AS part_idx, '.platform' AS path, '{}' AS text FROM doc_texts
UNION ALL SELECT workspace_id, item_id, 1, path, text FROM doc_texts""")
oracle("src_scanner", "SELECT workspace_id, workspace_name, item_id, item_name, item_type FROM texts")
PARTS["conns"] = """
SELECT s_suppkey::VARCHAR AS connection_id, s_name AS display_name,
  CASE s_suppkey % 3 WHEN 0 THEN 'OnPremisesGateway' WHEN 1 THEN 'ShareableCloud' ELSE '' END AS connectivity_type,
  CASE WHEN s_suppkey % 10 = 9 THEN '' ELSE f.fn END AS connector_type,
  CASE WHEN s_nationkey % 2 = 0 THEN 'gw-' || s_nationkey ELSE '' END AS gateway_id, 'host-' || s_suppkey AS path
FROM supplier JOIN fns f ON f.i = s_suppkey % 26"""
oracle("src_connections", "SELECT * FROM conns")
oracle("src_connection_listing", """
SELECT 'tenant-' || n_nationkey AS tenant_id, coalesce(n, 0)::BIGINT AS connections,
  CASE WHEN n_nationkey > 1 THEN 'http 403' END AS listing_error, n_nationkey <= 1 AS readable
FROM nation LEFT JOIN (SELECT s_suppkey % 4 AS t, count(*) AS n FROM supplier GROUP BY 1) ON t = n_nationkey""")

PARTS["err_texts"] = _values([(i, t) for i, t in enumerate(ERROR_TEXTS)], "i, error_text")
# Rule that each template is written for, in order; then none matching, then no text.
PARTS["err_rules"] = _values([(i, i + 1 if i < 14 else 0) for i in range(15)], "i, rule_no")
PARTS["refreshes"] = """
SELECT 'ws-' || (user_id % 23) AS workspace_id, 'item-' || user_id AS item_id, user_id, event_id, event_id::VARCHAR AS request_id,
  CASE event_type WHEN 'error' THEN 'Failed' WHEN 'signup' THEN 'Disabled' WHEN 'view' THEN 'InProgress' ELSE 'Completed' END AS status,
  ts AS start_time, ts + to_seconds(floor(value)::INTEGER) AS end_time,
  CASE WHEN event_type = 'error' THEN t.error_text END AS error_text, floor(value) AS seconds,
  (props->>'$.k')::INTEGER % 16 AS tpl
FROM events JOIN err_texts t ON t.i = (props->>'$.k')::INTEGER % 16"""
oracle("src_refresh_history", """
SELECT r.workspace_id, r.item_id, request_id, status, start_time, end_time,
  CASE WHEN b.item_type = 'SemanticModel' THEN error_text WHEN status = 'Failed' THEN
    CASE event_id % 3 WHEN 0 THEN CASE WHEN error_text = '' THEN 'E1' ELSE error_text END WHEN 1 THEN 'E2'
         ELSE nullif(error_text, '') END END AS error_text, b.item_type
FROM refreshes r JOIN base b USING (workspace_id, item_id) WHERE b.item_type IN ('SemanticModel', 'Dataflow')""")
oracle("src_partitions_frame", """
SELECT workspace_id, item_id, 'T' || k || CASE WHEN k % 2 = 0 THEN '.P' ELSE '' END AS expr_name, expression
FROM texts WHERE item_type = 'SemanticModel' AND k % 3 = 0 AND k % 5 <> 0 AND expression IS NOT NULL
UNION ALL SELECT workspace_id, item_id, 'shared:Param', '"x" meta []' FROM texts
WHERE item_type = 'SemanticModel' AND k % 6 = 0 AND k % 12 <> 0""")
oracle("sink_calls", """
SELECT r.workspace_id, b.workspace_name, r.item_id, b.item_name, r.item_type, connector_kind, m_function, migration, is_migrating,
  coalesce(implementation, '') AS implementation, custom_dsn, coalesce(endpoint_hint, '') AS endpoint_hint, has_gateway, risk, excerpt
FROM rel r JOIN base b USING (item_id)""")
_GROUP_ORDER = "any_migrating DESC, calls DESC, connector_kind"
PARTS["groups"] = """
SELECT connector_kind, bool_or(is_migrating) AS any_migrating, count(*)::BIGINT AS calls,
  (count(*) FILTER (risk = 'low'))::BIGINT AS ok, (count(*) FILTER (risk IN ('medium', 'unknown')))::BIGINT AS warn,
  (count(*) FILTER (risk = 'high'))::BIGINT AS fail, (count(*) FILTER (risk = 'na'))::BIGINT AS na
FROM {src} GROUP BY 1""".replace("{src}", "risks")
oracle("preview_capped", f"""
SELECT connector_kind, workspace_id, item_id, m_function, row_no::BIGINT AS row_no, list_no::BIGINT AS list_no,
  (calls - greatest(0, least(least(calls, 25), 400 - start)))::BIGINT AS more
FROM (SELECT *, start + row_no AS list_no FROM (
  SELECT r.*, row_number() OVER (PARTITION BY connector_kind ORDER BY workspace_id, item_id, expr_name, call_pos) AS row_no
  FROM rel r) JOIN (SELECT connector_kind, calls, coalesce(sum(least(calls, 25)) OVER (ORDER BY {_GROUP_ORDER}
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
    FROM (SELECT connector_kind, bool_or(is_migrating) AS any_migrating, count(*) AS calls FROM rel GROUP BY 1)) USING (connector_kind)
) WHERE row_no <= 25 AND list_no <= 400""")

# --- 2.2 ------------------------------------------------------------------------------

_BIM = "k % 10 IN (0, 2, 4) AND expression IS NOT NULL"
oracle("expr_tmsl_partitions", f"SELECT workspace_id, item_id, 'T' || k || '.P' AS expr_name, expression FROM texts WHERE {_BIM}")
_SHARED = "'\"x\" meta [IsParameterQuery=true]'"
oracle("expr_tmsl_shared", f"SELECT workspace_id, item_id, 'shared:Param' AS expr_name, {_SHARED} AS expression FROM texts WHERE {_BIM} AND k % 4 = 0")
oracle("expr_join_lines", f"""SELECT workspace_id, item_id, 'T' || k || '.P' AS expr_name, k % 4 = 0 AS is_list, expression FROM texts WHERE {_BIM}
UNION ALL SELECT workspace_id, item_id, 'C.Calc', false, 'Sql.Database(1)' FROM texts WHERE {_BIM}
UNION ALL SELECT workspace_id, item_id, 'shared:Param', false, {_SHARED} FROM texts WHERE {_BIM} AND k % 4 = 0""")
_TMDL = """SELECT workspace_id, item_id, 'definition/T.tmdl' AS expr_name,
  repeat(chr(9), 4) || replace(expression, chr(10), chr(10) || repeat(chr(9), 4)) || chr(10) AS expression
FROM texts WHERE k % 10 IN (1, 3) AND expression IS NOT NULL"""
oracle("expr_tmdl_blocks", _TMDL)
_PQ = """SELECT workspace_id, item_id, 'mashup.pq' AS expr_name,
  'section Section1;' || chr(10) || 'shared Query = ' || expression || ';' AS expression
FROM texts WHERE k % 10 = 5 AND expression IS NOT NULL"""
oracle("expr_dataflow_text", _PQ)
_GEN1 = "SELECT workspace_id, item_id, 'model.json' AS expr_name, expression FROM texts WHERE k % 10 = 6 AND expression IS NOT NULL"
oracle("expr_dataflow_json_walk", _GEN1)
oracle("looks_like_m", """SELECT doc_id, length(text) >= 4 AND
  (contains(text, 'let ') OR contains(text, 'Source') OR contains(text, 'shared ')) AS is_m FROM documents""")
oracle("expr_generic", """
SELECT workspace_id, item_id, path AS expr_name, text AS expression FROM doc_texts
WHERE contains(text, 'let') OR contains(text, 'Source')""")
oracle("expr_scanner_dataset", """
SELECT workspace_id, item_id, 'T' AS expr_name, expression FROM texts WHERE item_type = 'SemanticModel' AND expression IS NOT NULL
UNION ALL SELECT workspace_id, item_id, 'shared:P', '' FROM texts WHERE item_type = 'SemanticModel'""")
oracle("expr_scanner_dataflow", """
SELECT workspace_id, item_id, 'q' AS expr_name, expression FROM texts WHERE item_type = 'Dataflow' AND expression IS NOT NULL""")
oracle("strings_for_key", f"""
SELECT workspace_id, item_id, (row_number() OVER (PARTITION BY item_id ORDER BY n) - 1)::BIGINT AS hit_idx, value FROM (
  SELECT workspace_id, item_id, n, CASE n WHEN 0 THEN 'T' || k WHEN 1 THEN 'P' WHEN 2 THEN 'C' WHEN 3 THEN 'Calc' ELSE 'Param' END AS value
  FROM texts, range(5) r(n) WHERE {_BIM} AND (n < 4 OR k % 4 = 0))""")
PARTS["parsed"] = f"""
SELECT workspace_id, item_id, 'SemanticModel' AS item_type, 'model.bim' AS path, expression FROM texts WHERE {_BIM}
UNION ALL SELECT workspace_id, item_id, 'SemanticModel', 'model.bim', 'shared' FROM texts WHERE {_BIM} AND k % 4 = 0
UNION ALL SELECT workspace_id, item_id, 'SemanticModel', 'definition/t.tmdl', expression FROM texts WHERE k % 10 IN (1, 3) AND expression IS NOT NULL
UNION ALL SELECT workspace_id, item_id, 'Dataflow', 'mashup.pq', expression FROM texts WHERE k % 10 = 5 AND expression IS NOT NULL
UNION ALL SELECT workspace_id, item_id, 'Dataflow', 'model.json', expression FROM texts WHERE k % 10 = 6 AND expression IS NOT NULL"""
oracle("expr_route_by_type", """
SELECT item_type, path, count(*)::BIGINT AS expressions, count(DISTINCT item_id)::BIGINT AS items FROM parsed GROUP BY 1, 2""")
oracle("expr_prefer_fast_source", """
WITH fast AS (SELECT DISTINCT item_id FROM texts WHERE item_type = 'SemanticModel' AND
  ((k % 3 = 0 AND k % 5 <> 0 AND expression IS NOT NULL) OR (k % 6 = 0 AND k % 12 <> 0)))
SELECT 'sempy' AS source, count(*)::BIGINT AS items FROM fast
UNION ALL SELECT 'rest', count(DISTINCT item_id)::BIGINT FROM parsed
WHERE item_type = 'SemanticModel' AND item_id NOT IN (SELECT item_id FROM fast)""".replace("WITH fast", "SELECT * FROM (WITH fast") + ")")

# --- 2.3 ------------------------------------------------------------------------------

oracle("mask_comments", "SELECT workspace_id, item_id, code FROM exprs")
_BLANK_ARG = "repeat(' ', length(ep) + 2)"
oracle("mask_strings", f"""
SELECT workspace_id, item_id, CASE trap WHEN 2 THEN 'let' || chr(10) || '    Note = ' || repeat(' ', {len(_NOTE) - 12}) || ',' || chr(10)
    ELSE code_head END || '    Source = ' || fn || '(' ||
  CASE WHEN trap = 3 THEN 'SomeHelper.Get(' || {_BLANK_ARG} || ', [Implementation =      ])' ELSE {_BLANK_ARG} END ||
  ',     ' || CASE pin WHEN 0 THEN '' ELSE ', [Implementation =      ]' END || ')' || tail AS masked
FROM exprs""")
oracle("find_calls", """
SELECT workspace_id, item_id, call_pos::BIGINT AS call_pos, m_function, lower(split_part(m_function, '.', 1)) AS prefix FROM mcalls""")
oracle("arg_window", "SELECT workspace_id, item_id, call_pos::BIGINT AS call_pos, win AS \"window\" FROM mcalls")
for _name, _col in {"implementation": "implementation", "endpoint_hint": "endpoint_hint", "custom_dsn": "custom_dsn",
                    "excerpt": "excerpt", "classify_migration": "migration", "friendly_name": "connector_kind"}.items():
    oracle(_name, f"SELECT workspace_id, item_id, m_function, {_col} FROM mcalls")


def _redacted(col: str) -> str:
    kv = f"regexp_replace({col}, '(?i)\\b({fv.SECRET_KEYS})\\s*=\\s*(\"[^\"]*\"|''[^'']*''|[^;\\s]+)', '\\1=***REDACTED***', 'g')"
    shared = f"regexp_replace({kv}, '(?i)\\b(shared\\s+({fv.SECRET_KEYS})[A-Za-z0-9_]*)\\s*=\\s*\"([^\"]+)\"', '\\1 = \"***REDACTED***\"', 'g')"
    return f"regexp_replace({shared}, '{fv.JWT_PATTERN}', '***REDACTED***', 'g')"


oracle("redact_secrets", f"SELECT doc_id, {_redacted('text')} AS text FROM documents")
oracle("redact_pages", f"SELECT page_id, {_redacted('html')} AS html FROM pages")
oracle("truncate_marked", """SELECT doc_id, CASE WHEN length(text) > 500 THEN substring(text, 1, 500) || ' ...(truncated)' ELSE text END AS text
FROM documents""")
oracle("drop_builtins", "SELECT lower(split_part(m_function, '.', 1)) AS prefix, count(*)::BIGINT AS calls FROM mcalls GROUP BY 1")
oracle("calls_migrating", "SELECT workspace_id, item_id, m_function, connector_kind, migration FROM mcalls WHERE migration <> 'none'")
_CALL_COLS = "workspace_id, item_id, expr_name, call_pos::BIGINT AS call_pos, connector_kind, m_function, migration, implementation, endpoint_hint, excerpt, custom_dsn"
oracle("calls_all", f"SELECT {_CALL_COLS} FROM mcalls")
oracle("kinds_summary", "SELECT connector_kind, count(*)::BIGINT AS calls FROM mcalls GROUP BY 1")

# --- 2.4 ------------------------------------------------------------------------------

oracle("activities_flat", "SELECT workspace_id, item_id, path, activity_name, activity_type FROM acts")
oracle("activity_refs", "SELECT workspace_id, item_id, activity_name, activity_type, role_idx::BIGINT AS role_idx, role FROM ref_objects")
_REF = "workspace_id, item_id, activity_name, activity_type, role, connection_id, inline_type"
oracle("ref_connection_id", f"SELECT {_REF} FROM found_refs")
oracle("resolve_connection", f"SELECT {_REF}, connector_prefix, connector_kind FROM resolved_refs")
oracle("ref_migration", "SELECT workspace_id, item_id, connector_kind, migration FROM rcalls")
ORACLES["ref_migration_table"] = ORACLES["ref_migration"]
oracle("first_rules", r"""
WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM benchmark),
p AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS needle FROM w WHERE len(w) >= 3),
r AS (SELECT needle, min(item_id)::BIGINT AS rule_no FROM p GROUP BY 1)
SELECT d.doc_id, (SELECT min(rule_no) FROM r WHERE contains(lower(d.text), needle))::BIGINT AS rule_no FROM documents d""")
oracle("activity_calls", f"SELECT {_CALL_COLS} FROM rcalls")

# --- 2.5 ------------------------------------------------------------------------------

oracle("pin_flags", """SELECT workspace_id, item_id, m_function, implementation, coalesce(implementation LIKE '1%', false) AS is_pinned_odbc,
  coalesce(implementation LIKE '2%', false) AS is_pinned_adbc, migration <> 'none' AS is_migrating FROM mcalls""")
oracle("call_risk", "SELECT workspace_id, item_id, expr_name, m_function, has_gateway, risk FROM risks")
oracle("gateway_tristate", "SELECT workspace_id, item_id, has_gateway FROM gw")


def _advice_rows():
    rows = []
    for key, (issue, cause, actions) in fv.SCAN_ADVICE.items():
        joined = "; ".join(actions).replace("{contact}", fv.DEFAULT_CONTACT)
        rows.append((key, issue.replace("{Family}", "Hive"), cause.replace("{family}", "hive"), joined))
    return rows


PARTS["advice"] = _values(_advice_rows(), "id, issue, likely_cause, actions")
oracle("scan_diagnosis", f"""
SELECT workspace_id, item_id, m_function, issue, likely_cause, actions, CASE WHEN a.id IS NOT NULL THEN {_lit(fv.DOCS_URL)} END AS docs
FROM (SELECT *, CASE WHEN migration LIKE 'deprecation:%' THEN 'deprecation' WHEN custom_dsn THEN 'custom_dsn'
  WHEN pinned AND is_migrating AND has_gateway = false THEN 'pinned_no_gateway' WHEN pinned AND is_migrating THEN 'pinned'
  WHEN is_migrating AND NOT pinned_new THEN 'ready' END AS id FROM risks) LEFT JOIN advice a USING (id)""")
_KIND_OF = _case("risk", fv.STATUS_OF_RISK, "'ok'")
oracle("status_kind", f"""SELECT *, {_case('kind', fv.STATUS_LABELS, "''")} AS label, {_case('kind', fv.STATUS_FILTERS, "'other'")} AS bucket
FROM (SELECT workspace_id, item_id, m_function, risk, {_KIND_OF} AS kind FROM risks)""")
oracle("gateway_chip", """SELECT workspace_id, item_id, m_function, CASE WHEN is_migrating THEN CASE WHEN has_gateway THEN 'via gateway'
  WHEN has_gateway = false THEN 'no gateway' ELSE 'gateway: unknown' END END AS chip FROM risks""")
_BASES = list(fv.PORTAL_BASES.values()) + [fv.PORTAL_BASES["commercial"]] * 2
oracle("portal_link", f"""
SELECT k, CASE WHEN k % 9 = 0 THEN CASE WHEN seg IS NULL THEN host || '/me/list' WHEN item <> '' THEN host || '/me/' || seg || '/' || item END
  WHEN ws IS NULL THEN NULL WHEN seg IS NULL THEN host || '/groups/' || ws || '/list'
  WHEN item <> '' THEN host || '/groups/' || ws || '/' || seg || '/' || item END AS url
FROM (SELECT k, {_case('item_type', fv.PORTAL_SEGMENTS, 'NULL')} AS seg, CASE WHEN k % 13 <> 0 THEN workspace_id END AS ws,
  CASE WHEN k % 19 <> 0 THEN item_id ELSE '' END AS item,
  list_extract([{", ".join(_lit(b) for b in _BASES)}], (k % 7 + 1)::BIGINT) AS host FROM base)""")


def _rule_rows():
    rows = [(0, fv.UNCATEGORIZED_ISSUE, fv.UNCATEGORIZED_CAUSE_PREFIX + ERROR_TEXTS[14].replace("\n", " "),
             "; ".join(fv.UNCATEGORIZED_ACTIONS).replace("{contact}", fv.DEFAULT_CONTACT), fv.DOCS_URL)]
    for i, (_, issue, cause, actions, docs) in enumerate(fv.ERROR_RULES, start=1):
        rows.append((i, issue, cause, "; ".join(actions).replace("{contact}", fv.DEFAULT_CONTACT), docs))
    return rows


PARTS["rules"] = _values(_rule_rows(), "rule_no, issue, likely_cause, actions, docs")
oracle("diagnose_error", """
SELECT request_id, u.rule_no::BIGINT AS rule_no, issue, likely_cause, actions, docs
FROM refreshes r LEFT JOIN err_rules u ON u.i = r.tpl AND r.status = 'Failed' LEFT JOIN rules d USING (rule_no)""")
oracle("refresh_duration", "SELECT request_id, seconds::DOUBLE AS seconds FROM refreshes")
oracle("safe_key", "SELECT p_partkey, regexp_replace(p_name || ' / ' || p_brand, '[^A-Za-z0-9_]', '_', 'g') AS key FROM part")
oracle("identity_hash", """SELECT c_custkey, left(sha256(c_name), 12) AS user_hash, left(sha256(' ' || c_name || '  '), 12) AS tenant_hash
FROM customer""")
oracle("identity_select", """
SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN CASE WHEN c_custkey % 3 IN (0, 1) THEN c_name ELSE '' END
    WHEN c_custkey % 2 = 0 THEN 'env-user' ELSE '' END AS user_id,
  CASE WHEN c_custkey % 5 <> 0 THEN CASE WHEN c_custkey % 3 IN (0, 1) THEN 'aad' ELSE '' END
    WHEN c_custkey % 2 = 0 THEN 'env' ELSE '' END AS source FROM customer""")
PARTS["sent"] = """
SELECT *, CASE
    WHEN n % 10 IN (0, 1, 2) AND n % 4 = 0 THEN CASE n % 10 WHEN 0 THEN 'network' WHEN 1 THEN 'http_429' ELSE 'http_503' END
    WHEN n % 10 IN (0, 1, 2) AND n % 4 = 1 THEN 'http_429' WHEN n % 10 = 3 THEN 'http_500'
    WHEN n % 7 = 1 THEN 'captive_portal' WHEN n % 7 IN (0, 2, 3) THEN 'ingest_drop'
    WHEN n % 10 IN (0, 1, 2) THEN 'retried_ok' ELSE 'ok' END AS status
FROM (SELECT event_id AS attempt_id, event_id // 3 AS envelope_id, ts AS sent_at, 'home-' || (user_id % 5) AS store,
  (props->>'$.k')::INTEGER AS n, event_id % 5 <> 0 AS has_envelope FROM events)"""
oracle("delivery_status", "SELECT attempt_id, status FROM sent")

# --- 2.6 ------------------------------------------------------------------------------

oracle("skip_reason", "SELECT workspace_id, item_id, item_type, skip_reason FROM skip_rows")
oracle("filter_migrating", "SELECT workspace_id, item_id, m_function, connector_kind, migration, custom_dsn FROM rel")
oracle("artifact_worst_risk", "SELECT workspace_id, item_id, worst_risk FROM arts")
PARTS["kinds_in_order"] = """
SELECT workspace_id, item_id, connector_kind, row_number() OVER (PARTITION BY item_id ORDER BY first)::BIGINT AS position
FROM (SELECT workspace_id, item_id, connector_kind, min(expr_name || lpad(call_pos::VARCHAR, 4, '0')) AS first FROM risks GROUP BY 1, 2, 3)"""
oracle("artifact_connectors", "SELECT * FROM kinds_in_order")
oracle("artifact_migrating", """SELECT workspace_id, item_id, bool_or(is_migrating) AS has_migrating, count(*)::BIGINT AS calls
FROM risks GROUP BY 1, 2""")
_BUCKETS = "(VALUES ('high'), ('medium'), ('unknown'), ('low'), ('na')) v(risk)"
oracle("counts_by_risk", f"""SELECT risk, coalesce(n, 0)::BIGINT AS artifacts FROM {_BUCKETS}
LEFT JOIN (SELECT worst_risk AS risk, count(*) AS n FROM arts GROUP BY 1) USING (risk)""")
_PER_WS = f"""SELECT workspace_id, risk, coalesce(n, 0)::BIGINT AS artifacts
FROM (SELECT DISTINCT workspace_id FROM arts), {_BUCKETS}
LEFT JOIN (SELECT workspace_id AS w, worst_risk AS r, count(*) AS n FROM arts GROUP BY 1, 2) ON w = workspace_id AND r = risk"""
oracle("counts_by_risk_per_workspace", _PER_WS)
oracle("counts_by_connector", "SELECT connector_kind, count(*)::BIGINT AS calls FROM calls GROUP BY 1")
oracle("counts_by_migration", "SELECT migration, count(*)::BIGINT AS calls FROM calls GROUP BY 1")
oracle("counts_grouping_sets", """
SELECT 'connector' AS dimension, connector_kind AS name, count(*)::BIGINT AS calls FROM calls GROUP BY 2
UNION ALL SELECT 'migration', migration, count(*)::BIGINT FROM calls GROUP BY 2""")
oracle("scan_totals", """
SELECT count(*)::BIGINT AS artifacts, (count(*) FILTER (has_migrating))::BIGINT AS migrating_artifacts, sum(calls)::BIGINT AS total_calls,
  sum(pinned_odbc)::BIGINT AS pinned_odbc, sum(pinned_at_risk)::BIGINT AS pinned_at_risk, sum(custom_dsn)::BIGINT AS custom_dsn,
  (SELECT count(skip_reason) FROM skip_rows)::BIGINT AS skipped, (SELECT count(*) FROM supplier)::BIGINT AS connections FROM arts""")
oracle("pinned_at_risk", """SELECT workspace_id, (count(*) FILTER (pinned AND has_gateway = false))::BIGINT AS pinned_at_risk
FROM rel GROUP BY 1""")
oracle("skipped_by_reason", "SELECT skip_reason, count(*)::BIGINT AS items FROM skip_rows WHERE skip_reason IS NOT NULL GROUP BY 1")
PARTS["cover"] = """
SELECT workspace_id, count(*) AS total, count(*) FILTER (item_type IN ('SemanticModel', 'Dataflow', 'DataPipeline')) AS inspected FROM base GROUP BY 1"""
oracle("coverage", """SELECT workspace_id, total::BIGINT AS total_items, inspected::BIGINT AS inspected_items, (total - inspected)::BIGINT AS not_inspected_items,
  0::BIGINT AS other_items, round_even(100.0 * inspected / total, 0)::BIGINT AS score_pct FROM cover""")
oracle("filtered_report", "SELECT workspace_id, item_id, m_function, risk FROM risks WHERE risk IN ('high', 'medium', 'unknown')")
oracle("filtered_items", """SELECT workspace_id, item_id, item_type FROM base
WHERE item_id IN (SELECT item_id FROM risks WHERE risk = 'low')""")
oracle("toolbar_counts", """SELECT count(*)::BIGINT AS all_calls, (count(*) FILTER (risk = 'high'))::BIGINT AS will_fail,
  (count(*) FILTER (risk IN ('medium', 'unknown')))::BIGINT AS needs_review, (count(*) FILTER (risk = 'low'))::BIGINT AS ready,
  (count(*) FILTER (risk = 'na'))::BIGINT AS other FROM rel""")
oracle("kpi_cards", """
SELECT a.*, c.*, CASE WHEN will_fail > 0 THEN 'high' ELSE 'low' END AS will_fail_tone,
  CASE WHEN needs_review > 0 THEN 'medium' ELSE 'low' END AS needs_review_tone,
  CASE WHEN score_pct >= 80 THEN 'low' ELSE 'medium' END AS coverage_tone
FROM (SELECT count(*)::BIGINT AS artifacts_scanned, (count(*) FILTER (has_migrating))::BIGINT AS migrating_artifacts,
  sum(calls)::BIGINT AS connections, sum(pinned_odbc)::BIGINT AS pinned_odbc, sum(custom_dsn)::BIGINT AS custom_dsn,
  (count(*) FILTER (worst_risk = 'high'))::BIGINT AS will_fail,
  (count(*) FILTER (worst_risk IN ('medium', 'unknown')))::BIGINT AS needs_review FROM arts) a,
  (SELECT sum(total)::BIGINT AS total_items, sum(inspected)::BIGINT AS inspected_items,
    round_even(100.0 * sum(inspected) / sum(total), 0)::BIGINT AS score_pct FROM cover) c""")
oracle("connector_groups", "SELECT * FROM groups")
oracle("hidden_count", "SELECT count(*)::BIGINT AS hidden_calls FROM risks WHERE NOT (is_migrating OR custom_dsn)")
oracle("connections_top10", """SELECT *, greatest(0, (SELECT count(*) FROM supplier) - 10)::BIGINT AS more
FROM (SELECT * FROM conns ORDER BY connection_id LIMIT 10)""")
oracle("tenant_rollup", """
SELECT workspace_id, workspace_name, item_id, item_name, item_type, count(*)::BIGINT AS calls,
  (count(*) FILTER (migration <> 'none'))::BIGINT AS migrating_calls, (count(*) FILTER (implementation LIKE '1%'))::BIGINT AS pinned_odbc
FROM (SELECT workspace_id, workspace_name, item_id, item_name, item_type, migration, fn,
        CASE WHEN trap = 3 THEN '2.0' WHEN pin > 0 THEN pin || '.0' ELSE '' END AS implementation
      FROM texts WHERE expression IS NOT NULL) WHERE migration <> 'none' OR fn = 'Odbc.DataSource' GROUP BY ALL""")
oracle("inventory_by_type", "SELECT item_type, count(*)::BIGINT AS items FROM base GROUP BY 1")

# --- 2.7 ------------------------------------------------------------------------------

oracle("validation_scope", "SELECT DISTINCT workspace_id, item_id FROM risks WHERE is_migrating")
_CUT = f"TIMESTAMP '{CUTOVER}'"
PARTS["pre"] = f"""
SELECT * FROM refreshes WHERE start_time < {_CUT}
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY start_time DESC, request_id DESC) = 1"""
PARTS["post"] = f"""
SELECT r.* FROM refreshes r LEFT JOIN pre ON pre.item_id = r.item_id
WHERE r.start_time >= {_CUT} AND r.start_time <= {_CUT} + INTERVAL {WAIT_MINUTES} MINUTE
  AND r.status IN ('Completed', 'Failed', 'Disabled') AND r.request_id IS DISTINCT FROM pre.request_id
QUALIFY row_number() OVER (PARTITION BY r.item_id ORDER BY r.start_time, r.request_id) = 1"""
PARTS["newest"] = """
SELECT * FROM refreshes QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY start_time DESC, request_id DESC) = 1"""
_CHOSEN = "workspace_id, item_id, request_id, status, start_time"
oracle("last_refresh_before", f"SELECT {_CHOSEN} FROM pre")
oracle("refreshes_around", f"""
WITH cuts AS (SELECT workspace_id, item_id, {_CUT} + to_days(d::INTEGER) AS cutover FROM base, (SELECT unnest(range(-4, 6)) AS d)),
befores AS (SELECT c.*, r.request_id AS pre_request FROM cuts c LEFT JOIN refreshes r ON r.item_id = c.item_id AND r.start_time < c.cutover
  QUALIFY row_number() OVER (PARTITION BY c.item_id, c.cutover ORDER BY r.start_time DESC NULLS LAST, r.request_id DESC) = 1)
SELECT b.workspace_id, b.item_id, b.cutover, pre_request, r.request_id AS post_request, r.status AS post_status
FROM befores b LEFT JOIN refreshes r ON r.item_id = b.item_id AND r.start_time >= b.cutover AND r.start_time <= b.cutover + INTERVAL {WAIT_MINUTES} MINUTE
  AND r.status IN ('Completed', 'Failed', 'Disabled') AND r.request_id IS DISTINCT FROM pre_request
QUALIFY row_number() OVER (PARTITION BY b.item_id, b.cutover ORDER BY r.start_time NULLS LAST, r.request_id) = 1""")
oracle("first_terminal_after", f"SELECT {_CHOSEN} FROM post")
PARTS["outcomes"] = f"""
SELECT *, CASE WHEN outcome = 'failed' THEN coalesce(nullif(error_text, ''), 'Refresh status: ' || post_status) END AS failure,
  CASE outcome WHEN 'refresh_not_triggered' THEN {_lit(fv.NOT_TRIGGERED[0])} WHEN 'no_new_refresh' THEN {_lit(fv.NOT_FINISHED[0])}
    WHEN 'passed_with_regression' THEN {_lit(fv.REGRESSION_ISSUE)} WHEN 'failed' THEN
      CASE WHEN coalesce(error_text, '') = '' THEN {_lit(fv.UNCATEGORIZED_ISSUE)} ELSE (SELECT d.issue FROM err_rules u JOIN rules d USING (rule_no) WHERE u.i = tpl) END
  END AS issue
FROM (SELECT *, CASE WHEN item_type <> 'SemanticModel' THEN 'skipped' WHEN k % 17 = 0 THEN 'refresh_not_triggered'
    WHEN post_status IS NULL THEN 'no_new_refresh' WHEN post_status <> 'Completed' THEN 'failed'
    WHEN delta > 50 THEN 'passed_with_regression' ELSE 'passed' END AS outcome
  FROM (SELECT b.workspace_id, b.item_id, b.item_name, b.item_type, k, post.status AS post_status, post.error_text, post.tpl,
      pre.end_time AS pre_end, post.end_time AS post_end,
      CASE WHEN b.item_type = 'SemanticModel' AND k % 17 <> 0 AND post.status = 'Completed' AND pre.seconds > 0 AND post.seconds > 0 THEN
        round(((post.seconds - pre.seconds) / greatest(pre.seconds, 1) * 100)::DECIMAL(28, 6), 1)::DOUBLE END AS delta
    FROM base b LEFT JOIN pre USING (item_id) LEFT JOIN post USING (item_id)))"""
_REASON = f"""CASE outcome WHEN 'skipped' THEN 'validation for ' || item_type || ' not automated'
  WHEN 'refresh_not_triggered' THEN {_lit(fv.REASON_NOT_TRIGGERED)} WHEN 'no_new_refresh' THEN {_lit(fv.REASON_NOT_FINISHED)}
  WHEN 'passed' THEN {_lit(fv.REASON_COMPLETED)} WHEN 'passed_with_regression' THEN
    {_lit(fv.REASON_COMPLETED)} || printf(' (regression: %+.1f%% slower than baseline)', delta) ELSE failure END"""
oracle("no_new_refresh", f"""
SELECT b.workspace_id, b.item_id, CASE WHEN b.item_type <> 'SemanticModel' THEN 'skipped' WHEN n.request_id IS NULL OR n.request_id = pre.request_id THEN 'no_new_refresh'
    WHEN n.status <> 'Completed' THEN 'failed' WHEN d > 50 THEN 'passed_with_regression' ELSE 'passed' END AS status,
  CASE WHEN b.item_type <> 'SemanticModel' THEN 'validation for ' || b.item_type || ' not automated'
    WHEN n.request_id IS NULL OR n.request_id = pre.request_id THEN {_lit(fv.REASON_NO_NEW_REFRESH)}
    WHEN n.status <> 'Completed' THEN coalesce(nullif(n.error_text, ''), 'Refresh status: ' || n.status)
    WHEN d > 50 THEN {_lit(fv.REASON_COMPLETED)} || printf(' (regression: %+.1f%% slower than baseline)', d) ELSE {_lit(fv.REASON_COMPLETED)} END AS reason,
  CASE WHEN b.item_type = 'SemanticModel' AND n.request_id IS DISTINCT FROM pre.request_id THEN n.request_id END AS request_id
FROM base b LEFT JOIN pre USING (item_id) LEFT JOIN newest n USING (item_id)
LEFT JOIN (SELECT n.item_id, round(((n.seconds - pre.seconds) / greatest(pre.seconds, 1) * 100)::DECIMAL(28, 6), 1)::DOUBLE AS d
  FROM newest n JOIN pre USING (item_id) WHERE n.seconds > 0 AND pre.seconds > 0) q USING (item_id)""")
oracle("validation_status", "SELECT workspace_id, item_id, item_type, outcome AS status FROM outcomes")
oracle("duration_delta", "SELECT workspace_id, item_id, delta AS duration_delta_pct FROM outcomes")
oracle("failure_reason", f"SELECT workspace_id, item_id, {_REASON} AS reason, issue AS diagnosis_issue FROM outcomes")
_CAUSE_HEAD, _CAUSE_TAIL = fv.REGRESSION_CAUSE.split("{delta}")
_CAUSE = f"{_lit(_CAUSE_HEAD)} || printf('%+d', round_even(delta::DECIMAL(28, 6), 0)::BIGINT) || {_lit(_CAUSE_TAIL)}"
oracle("regression_diagnosis", f"""SELECT workspace_id, item_id, delta AS duration_delta_pct, delta > 50 AS is_regression,
  CASE WHEN delta > 50 THEN {_CAUSE} END AS cause FROM outcomes WHERE delta IS NOT NULL""")
PARTS["outcome_advice"] = _values(
    [(outcome, cause, "; ".join(actions).replace("{contact}", fv.DEFAULT_CONTACT)) for outcome, cause, actions in (
        ("refresh_not_triggered", *fv.NOT_TRIGGERED[1:3]), ("no_new_refresh", *fv.NOT_FINISHED[1:3]),
        ("passed_with_regression", "", fv.REGRESSION_ACTIONS))], "outcome, cause, actions")
PARTS["kind_lists"] = """
SELECT item_id, string_agg(connector_kind, ', ' ORDER BY first) AS connectors FROM (
  SELECT item_id, connector_kind, min(expr_name || lpad(call_pos::VARCHAR, 4, '0')) AS first FROM rel GROUP BY 1, 2) GROUP BY 1"""
oracle("sink_validation", f"""
SELECT workspace_id, item_id, item_name, item_type, coalesce(connectors, '') AS connectors, outcome AS status,
  {_REASON} AS reason, delta AS duration_delta_pct,
  CASE WHEN item_type = 'SemanticModel' THEN pre_end END AS pre_refresh_end,
  CASE WHEN outcome IN ('passed', 'passed_with_regression', 'failed') THEN post_end END AS post_refresh_end,
  coalesce(o.issue, '') AS diagnosis_issue,
  CASE WHEN outcome = 'passed_with_regression' THEN {_CAUSE}
    WHEN outcome = 'failed' AND d.rule_no = 0 THEN {_lit(fv.UNCATEGORIZED_CAUSE_PREFIX)} || replace(failure, chr(10), ' ')
    ELSE coalesce(d.likely_cause, a.cause, '') END AS diagnosis_likely_cause,
  coalesce(d.actions, a.actions, '') AS diagnosis_suggested_actions,
  coalesce(d.docs, CASE WHEN a.actions IS NOT NULL THEN {_lit(fv.DOCS_URL)} END, '') AS diagnosis_docs
FROM outcomes o LEFT JOIN kind_lists USING (item_id) LEFT JOIN rules d ON outcome = 'failed' AND d.issue = o.issue
LEFT JOIN outcome_advice a USING (outcome)""")
oracle("refresh_error_lookup", """
SELECT q.workspace_id, q.item_id, q.request_id, coalesce(nullif(e.error_text, ''), CASE WHEN e.status = 'Failed' THEN
  'Refresh failed at ' || strftime(e.end_time, '%Y-%m-%dT%H:%M:%SZ') || ' (no detail returned)' END) AS error
FROM refreshes q JOIN (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY start_time DESC, request_id DESC) AS n FROM refreshes) e USING (item_id)
WHERE q.status = 'Failed'
QUALIFY row_number() OVER (PARTITION BY q.request_id ORDER BY e.request_id = q.request_id DESC, e.n) = 1""")
oracle("status_counts", "SELECT outcome AS status, count(*)::BIGINT AS items FROM outcomes GROUP BY 1")
oracle("issue_counts", "SELECT issue, count(*)::BIGINT AS items FROM outcomes WHERE issue IS NOT NULL GROUP BY 1")
PARTS["preferred"] = """
SELECT * FROM risks QUALIFY row_number() OVER (PARTITION BY item_id, connector_kind ORDER BY is_migrating DESC, expr_name, call_pos) = 1"""
oracle("preferred_call", "SELECT workspace_id, item_id, connector_kind, m_function, is_migrating FROM preferred")
oracle("validation_groups", """
SELECT connector_kind, count(*)::BIGINT AS connections, (count(*) FILTER (outcome = 'passed'))::BIGINT AS ok,
  (count(*) FILTER (outcome IN ('passed_with_regression', 'no_new_refresh', 'refresh_not_triggered')))::BIGINT AS warn,
  (count(*) FILTER (outcome = 'failed'))::BIGINT AS fail, (count(*) FILTER (outcome = 'skipped'))::BIGINT AS skipped,
  CASE WHEN bool_or(outcome = 'failed') THEN 0 WHEN bool_or(outcome IN ('passed_with_regression', 'no_new_refresh', 'refresh_not_triggered')) THEN 1 ELSE 2 END::BIGINT AS group_rank
FROM preferred JOIN outcomes USING (item_id) GROUP BY 1""")
oracle("recent_refreshes", """
SELECT workspace_id, item_id, request_id, n::BIGINT AS entry_no FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY start_time DESC, request_id DESC) AS n FROM refreshes) WHERE n <= 5""")

# --- 2.8 ------------------------------------------------------------------------------

PARTS["line_counts"] = """
SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS risk_high, count(*) FILTER (l_returnflag = 'A') AS risk_medium,
  count(*) FILTER (l_returnflag = 'N') AS risk_low, count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'O') AS pinned_at_risk,
  count(*) FILTER (l_linestatus = 'O') AS pinned_odbc, count(*) FILTER (l_linestatus = 'F') AS custom_dsn,
  count(*) FILTER (l_linenumber <= 3) AS migrating_artifacts, count(*) AS total_calls FROM lineitem GROUP BY 1"""
PARTS["scans"] = """
SELECT 'ws-' || o_custkey AS workspace_id, left(sha256('tenant-' || c_nationkey), 12) AS tenant_hash, o_orderdate AS ts, o_orderkey AS run_id,
  o_custkey, CASE WHEN o_custkey % 97 = 0 THEN '' ELSE left(sha256('user-' || (o_custkey % 97)), 12) END AS user_hash,
  's-' || (o_orderkey // 2) AS session_id, o_orderpriority AS version,
  CASE o_orderstatus WHEN 'O' THEN 'lakehouse' WHEN 'F' THEN 'home' ELSE 'memory' END AS state_backend,
  round((o_totalprice / 1000)::DECIMAL(28, 6), 2)::DOUBLE AS duration_seconds,
  coalesce(risk_high, 0)::BIGINT AS risk_high, coalesce(risk_medium, 0)::BIGINT AS risk_medium, coalesce(risk_low, 0)::BIGINT AS risk_low,
  coalesce(pinned_at_risk, 0)::BIGINT AS pinned_at_risk, coalesce(pinned_odbc, 0)::BIGINT AS pinned_odbc, coalesce(custom_dsn, 0)::BIGINT AS custom_dsn,
  coalesce(migrating_artifacts, 0)::BIGINT AS migrating_artifacts, coalesce(total_calls, 0)::BIGINT AS total_calls,
  (coalesce(total_calls, 0) + o_orderkey % 7)::BIGINT AS inspected, ((o_orderkey * 7) % 101)::BIGINT AS coverage, o_orderkey % 3 = 0 AS sempy_used
FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN line_counts ON l_orderkey = o_orderkey"""
PARTS["firsts"] = """
SELECT workspace_id, tenant_hash, ts AS first_run_at, run_id AS first_run_id, risk_high AS first_risk_high, risk_medium AS first_risk_medium,
  risk_low AS first_risk_low, 0::BIGINT AS first_risk_unknown, 0::BIGINT AS first_risk_na, custom_dsn AS first_custom_dsn, total_calls AS first_total_calls,
  migrating_artifacts AS first_migrating_artifacts, pinned_odbc AS first_pinned_odbc,
  max(ts) OVER (PARTITION BY workspace_id) AS last_run_at
FROM scans QUALIFY row_number() OVER (PARTITION BY workspace_id ORDER BY ts, run_id) = 1"""
PARTS["states"] = """
SELECT s.*, f.* EXCLUDE (workspace_id, tenant_hash, last_run_at), row_number() OVER (PARTITION BY s.workspace_id ORDER BY ts, run_id)::BIGINT AS run_count
FROM scans s JOIN firsts f USING (workspace_id)"""
PARTS["progress"] = """
SELECT *, run_count = 1 AS is_first, first_risk_high - risk_high AS resolved_risk_high, first_risk_medium - risk_medium AS resolved_risk_medium,
  first_pinned_odbc - pinned_odbc AS resolved_pinned_odbc, first_custom_dsn - custom_dsn AS resolved_custom_dsn,
  first_migrating_artifacts - migrating_artifacts AS resolved_migrating_artifacts,
  CASE WHEN run_count > 1 THEN round((greatest(epoch(ts) - epoch(first_run_at), 0) / 86400)::DECIMAL(28, 6), 2)::DOUBLE END AS days,
  round((inspected * 3 / 60)::DECIMAL(28, 6), 2)::DOUBLE AS hours FROM states"""
oracle("first_run_baseline", "SELECT * FROM firsts")
oracle("run_count", "SELECT workspace_id, tenant_hash, run_id, run_count, run_count = 1 AS is_first_run FROM states")
oracle("baseline_identity_guard", """
SELECT * FROM (SELECT o_orderkey AS state_id, o_orderkey % 3 AS schema_version,
  CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'ws-' || (o_custkey + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END) END AS workspace_id FROM orders)
WHERE schema_version = 1 AND (state_id % 5 = 0 OR state_id % 7 <> 0) AND state_id % 11 <> 0""")
oracle("baseline_merge", """
SELECT workspace_id, tenant_hash, CASE WHEN first_run_id % 4 <> 0 AND first_run_id % 3 >= 1 THEN -1 ELSE first_run_id END::BIGINT AS first_run_id,
  last_run_at, CASE WHEN first_run_id % 4 <> 0 AND first_run_id % 3 >= 1 THEN first_run_id % 3 ELSE 1 END::BIGINT AS schema_version FROM firsts""")
oracle("resolved_deltas", """SELECT workspace_id, tenant_hash, run_id, resolved_risk_high, resolved_risk_medium, resolved_pinned_odbc,
  resolved_custom_dsn, resolved_migrating_artifacts FROM progress""")
PARTS["kind_names"] = _values([(i, k, re.sub("[^A-Za-z0-9_]", "_", k)) for i, k in enumerate(KINDS, start=1)], "i, kind, key")
PARTS["kind_counts"] = """
SELECT l_orderkey AS run_id, kind, key, count(*) AS n FROM lineitem JOIN kind_names ON i = l_linenumber GROUP BY 1, 2, 3"""
PARTS["kind_deltas"] = """
SELECT run_id, workspace_id, tenant_hash, is_first, kind, key, sum(n)::BIGINT AS resolved FROM (
  SELECT p.run_id, workspace_id, tenant_hash, is_first, kind, key, n FROM progress p JOIN kind_counts c ON c.run_id = p.first_run_id
  UNION ALL SELECT p.run_id, workspace_id, tenant_hash, is_first, kind, key, -n FROM progress p JOIN kind_counts c ON c.run_id = p.run_id) GROUP BY ALL"""
oracle("resolved_by_connector", "SELECT workspace_id, tenant_hash, run_id, kind AS connector_kind, resolved FROM kind_deltas")
oracle("days_since_first", "SELECT workspace_id, tenant_hash, run_id, days FROM progress")
oracle("hours_saved", "SELECT run_id, hours FROM progress")
PARTS["event_values"] = """
SELECT run_id::VARCHAR AS run_id, key, value FROM (
  UNPIVOT (SELECT run_id, workspace_id, tenant_hash, user_hash, session_id, version, state_backend, duration_seconds::VARCHAR AS duration_seconds,
    run_id::VARCHAR AS rid, CASE WHEN sempy_used THEN 'True' ELSE 'False' END AS sempy_used, CASE WHEN is_first THEN 'True' ELSE 'False' END AS is_first_run,
    inspected::VARCHAR AS inspected_artifacts, coverage::VARCHAR AS coverage_score_pct, run_count::VARCHAR AS run_count,
    strftime(first_run_at, '%Y-%m-%d %H:%M:%S') AS first_run_at, first_risk_high::VARCHAR AS first_risk_high, first_risk_medium::VARCHAR AS first_risk_medium,
    first_custom_dsn::VARCHAR AS first_custom_dsn, first_total_calls::VARCHAR AS first_total_calls,
    first_migrating_artifacts::VARCHAR AS first_migrating_artifacts, first_pinned_odbc::VARCHAR AS first_pinned_odbc,
    resolved_risk_high::VARCHAR AS resolved_risk_high, resolved_risk_medium::VARCHAR AS resolved_risk_medium, resolved_pinned_odbc::VARCHAR AS resolved_pinned_odbc,
    resolved_custom_dsn::VARCHAR AS resolved_custom_dsn, resolved_migrating_artifacts::VARCHAR AS resolved_migrating_artifacts,
    coalesce(days::VARCHAR, '') AS time_since_first_scan_days, hours::VARCHAR AS estimated_manual_hours_saved, risk_high::VARCHAR AS current_risk_high,
    risk_medium::VARCHAR AS current_risk_medium, pinned_odbc::VARCHAR AS current_pinned_odbc, custom_dsn::VARCHAR AS current_custom_dsn,
    migrating_artifacts::VARCHAR AS impacted_count, pinned_odbc::VARCHAR AS odbc_pinned_count, pinned_at_risk::VARCHAR AS odbc_pinned_at_risk_count FROM progress)
  ON COLUMNS(* EXCLUDE (run_id)) INTO NAME key VALUE value)"""
oracle("scan_event", """
SELECT run_id, CASE key WHEN 'rid' THEN 'run_id' ELSE key END AS key, value FROM event_values
UNION ALL SELECT run_id::VARCHAR, 'impacts_by_connector_' || key, n::VARCHAR FROM kind_counts JOIN (SELECT run_id FROM progress) USING (run_id)
UNION ALL SELECT p.run_id::VARCHAR, 'first_impacts_by_connector_' || key, n::VARCHAR FROM progress p JOIN kind_counts c ON c.run_id = p.first_run_id
UNION ALL SELECT run_id::VARCHAR, 'resolved_by_connector_' || key, resolved::VARCHAR FROM kind_deltas
UNION ALL SELECT run_id::VARCHAR, 'skipped_by_reason_permission_denied', (run_id % 4)::VARCHAR FROM progress WHERE run_id % 4 > 0
UNION ALL SELECT run_id::VARCHAR, 'skipped_by_reason_type_not_inspected', (run_id % 3)::VARCHAR FROM progress WHERE run_id % 3 > 0""")
_STATUS_LIST = ", ".join(f"('{s}')" for s in fv.VALIDATION_STATUSES)
_ISSUE_KEY = "'issue_' || regexp_replace(issue, '[^\\p{L}\\p{N}_]', '_', 'g')"
oracle("validation_event", f"""
SELECT workspace_id, 'workspace_id' AS key, workspace_id AS value FROM (SELECT DISTINCT workspace_id FROM outcomes)
UNION ALL SELECT DISTINCT workspace_id, 'version', '1' FROM outcomes
UNION ALL SELECT workspace_id, 'validated_count', count(*)::VARCHAR FROM outcomes GROUP BY 1
UNION ALL SELECT workspace_id, s, (count(*) FILTER (outcome = s))::VARCHAR FROM outcomes, (VALUES {_STATUS_LIST}) v(s) GROUP BY 1, 2
UNION ALL SELECT workspace_id, {_ISSUE_KEY}, count(*)::VARCHAR FROM outcomes WHERE issue IS NOT NULL GROUP BY 1, 2""")
oracle("opt_out_filter", "SELECT workspace_id, run_id FROM scans WHERE o_custkey % 50 <> 0 AND o_custkey % 75 <> 0")
oracle("last_n_log", """SELECT store, attempt_id, status FROM sent
QUALIFY row_number() OVER (PARTITION BY store ORDER BY sent_at DESC, attempt_id DESC) <= 20""")
oracle("last_n_log_all", "SELECT attempt_id, status FROM sent ORDER BY sent_at DESC, attempt_id DESC LIMIT 500")
PARTS["undelivered"] = """
SELECT * FROM sent WHERE envelope_id NOT IN (SELECT envelope_id FROM sent WHERE status IN ('ok', 'retried_ok'))"""
oracle("pending_retries", """
SELECT envelope_id, attempt_id, status FROM (
  SELECT * FROM (SELECT * FROM undelivered QUALIFY row_number() OVER (PARTITION BY envelope_id ORDER BY sent_at DESC, attempt_id DESC) = 1)
  ORDER BY sent_at, attempt_id LIMIT 50) WHERE has_envelope""")
oracle("delivery_health", """
SELECT count(*)::BIGINT AS attempts, (count(*) FILTER (status IN ('ok', 'retried_ok')))::BIGINT AS delivered,
  (count(*) FILTER (status NOT IN ('ok', 'retried_ok')))::BIGINT AS failed, max(sent_at) FILTER (status IN ('ok', 'retried_ok')) AS last_ok_at,
  max(sent_at) FILTER (status NOT IN ('ok', 'retried_ok')) AS last_failure_at,
  arg_max(status, sent_at) FILTER (status NOT IN ('ok', 'retried_ok')) AS last_failure_status,
  (SELECT count(DISTINCT envelope_id) FROM undelivered)::BIGINT AS backlog FROM sent""")
PARTS["epochs"] = """
SELECT *, coalesce(sum(CASE WHEN o_custkey % 29 = 0 AND run_id % 7 = 3 THEN 1 ELSE 0 END) OVER (PARTITION BY workspace_id ORDER BY ts, run_id), 0)::BIGINT AS epoch FROM scans"""
oracle("baseline_reset", """
SELECT workspace_id, tenant_hash, epoch, run_id, row_number() OVER w::BIGINT AS run_count, first_value(run_id) OVER w AS first_run_id
FROM epochs WINDOW w AS (PARTITION BY workspace_id, epoch ORDER BY ts, run_id)""".replace("row_number() OVER w::BIGINT", "(row_number() OVER w)::BIGINT"))
oracle("session_rollup", """SELECT session_id, count(*)::BIGINT AS scans, count(DISTINCT workspace_id)::BIGINT AS workspaces,
  min(ts) AS started_at, max(ts) AS ended_at FROM scans GROUP BY 1""")

# --- 2.9 ------------------------------------------------------------------------------


def _recent(days: int) -> str:
    return f"ts > (SELECT max(ts) FROM progress) - INTERVAL {days} DAY"


oracle("adoption_30d", f"""SELECT count(*)::BIGINT AS scans, count(DISTINCT tenant_hash)::BIGINT AS tenants,
  count(DISTINCT workspace_id)::BIGINT AS workspaces FROM progress WHERE {_recent(30)}""")
oracle("adoption_approx", """SELECT span::BIGINT AS days, count(*)::BIGINT AS scans, true AS tenants_close, true AS workspaces_close,
  count(DISTINCT tenant_hash)::BIGINT AS tenants, count(DISTINCT workspace_id)::BIGINT AS workspaces
FROM progress, (SELECT unnest([30, 365, 20000]) AS span)
WHERE date_trunc('day', ts) > (SELECT max(date_trunc('day', ts)) FROM progress) - to_days(span) GROUP BY 1""")
oracle("tenant_usage", """SELECT tenant_hash, '' AS tenant_id, count(*)::BIGINT AS scans, count(DISTINCT workspace_id)::BIGINT AS workspaces,
  min(ts) AS first_seen, max(ts) AS last_seen FROM progress GROUP BY 1""")
oracle("first_run_impact", """SELECT ts AS timestamp, tenant_hash, workspace_id, first_risk_high AS high_risk, first_pinned_odbc AS pinned_odbc,
  first_custom_dsn AS custom_dsn, first_total_calls AS total_calls FROM progress WHERE is_first""")
# Event properties are text, so the tie between two scans of a day is broken by text order.
PARTS["last_scans"] = "SELECT * FROM progress QUALIFY row_number() OVER (PARTITION BY workspace_id ORDER BY ts DESC, run_id::VARCHAR DESC) = 1"
oracle("improvement", """SELECT tenant_hash, workspace_id, run_count AS run_number, first_risk_high AS first_high, risk_high AS current_high,
  resolved_risk_high AS delta_high, first_pinned_odbc AS first_pinned, pinned_odbc AS current_pinned, resolved_pinned_odbc AS delta_pinned,
  ts AS latest_scan FROM progress QUALIFY run_count = max(run_count) OVER (PARTITION BY workspace_id) AND run_count >= 2""")
oracle("connector_mix", f"""SELECT key AS connector, sum(n)::BIGINT AS total_calls FROM kind_counts JOIN progress USING (run_id)
WHERE {_recent(30)} GROUP BY 1""")
oracle("stay_at_risk", f"""SELECT tenant_hash, workspace_id, pinned_at_risk FROM (SELECT * FROM progress WHERE {_recent(30)}
  QUALIFY row_number() OVER (PARTITION BY workspace_id ORDER BY ts DESC, run_id::VARCHAR DESC) = 1) WHERE pinned_at_risk > 0""")
oracle("top_issues", f"SELECT substring({_ISSUE_KEY}, 7) AS issue, count(*)::BIGINT AS occurrences FROM outcomes WHERE issue IS NOT NULL GROUP BY 1")
oracle("reach", """SELECT count(*)::BIGINT AS scans, count(DISTINCT nullif(user_hash, ''))::BIGINT AS users, count(DISTINCT workspace_id)::BIGINT AS workspaces,
  count(DISTINCT tenant_hash)::BIGINT AS tenants, count(DISTINCT version)::BIGINT AS versions FROM progress""")
ORACLES["reach_from_log"] = ORACLES["reach"]
oracle("resolution_rollup", """SELECT sum(resolved_pinned_odbc)::BIGINT AS resolved_pinned, sum(resolved_risk_high)::BIGINT AS resolved_high,
  sum(resolved_risk_medium)::BIGINT AS resolved_medium, sum(resolved_custom_dsn)::BIGINT AS resolved_custom_dsn,
  sum(resolved_migrating_artifacts)::BIGINT AS resolved_artifacts, count(*)::BIGINT AS return_scans FROM progress WHERE NOT is_first""")
oracle("value_rollup", """SELECT sum(hours::DECIMAL(18, 2))::DOUBLE AS hours_saved, sum(inspected)::BIGINT AS inspected,
  100.0::DOUBLE * (count(*) FILTER (sempy_used))::DOUBLE / count(*)::DOUBLE AS sempy_used_pct,
  quantile_disc(coverage, 0.5)::DOUBLE AS median_coverage FROM progress""")
oracle("daily_trend", f"""SELECT date_trunc('day', ts)::TIMESTAMP AS day, count(*)::BIGINT AS scans, count(DISTINCT workspace_id)::BIGINT AS workspaces
FROM progress WHERE {_recent(60)} GROUP BY 1""")
oracle("version_adoption", """SELECT version, count(*)::BIGINT AS scans, count(DISTINCT workspace_id)::BIGINT AS workspaces,
  count(DISTINCT tenant_hash)::BIGINT AS tenants FROM progress GROUP BY 1""")
_PROGRESS_COLS = """ts AS timestamp, workspace_id AS workspace, CASE WHEN is_first THEN 'True' ELSE 'False' END AS is_first, run_count,
  first_pinned_odbc AS first_pinned, pinned_odbc AS current_pinned, resolved_pinned_odbc AS resolved_pinned, coverage, version"""
oracle("workspace_progress", f"SELECT {_PROGRESS_COLS} FROM last_scans")
oracle("workspace_progress_returning", f"""SELECT {_PROGRESS_COLS}, tenant_hash AS tenant, first_risk_high AS baseline_high, risk_high AS current_high,
  resolved_risk_high AS resolved_high, days AS days_since_first FROM last_scans WHERE NOT is_first""")
oracle("skip_reason_rollup", """SELECT 'permission_denied' AS reason, sum(run_id % 4)::BIGINT AS items FROM progress
UNION ALL SELECT 'type_not_inspected', sum(run_id % 3)::BIGINT FROM progress""")
oracle("backend_split", "SELECT state_backend AS backend, count(*)::BIGINT AS scans FROM progress GROUP BY 1")
_FIRST = "CASE WHEN is_first THEN 'True' ELSE 'False' END AS is_first_run"
oracle("first_vs_return", f"SELECT {_FIRST}, count(*)::BIGINT AS scans FROM progress GROUP BY 1")
oracle("first_vs_return_by_version", f"SELECT version, {_FIRST}, count(*)::BIGINT AS scans FROM progress GROUP BY 1, 2")
oracle("pins_resolved_daily", """SELECT date_trunc('day', ts)::TIMESTAMP AS day, sum(resolved_pinned_odbc)::BIGINT AS cleaned_up
FROM progress WHERE NOT is_first GROUP BY 1""")
oracle("resolved_connector_rollup", """SELECT key AS connector, sum(resolved)::BIGINT AS resolved FROM kind_deltas WHERE NOT is_first
GROUP BY 1 HAVING sum(resolved) <> 0""")
ORACLES["resolved_connectors_from_log"] = ORACLES["resolved_connector_rollup"]
oracle("hours_daily", "SELECT date_trunc('day', ts)::TIMESTAMP AS day, sum(hours::DECIMAL(18, 2))::DOUBLE AS hours FROM progress GROUP BY 1")
oracle("hours_30d", """SELECT make_timestamp((epoch(ts)::BIGINT // 2592000) * 2592000 * 1000000) AS bin_start, count(*)::BIGINT AS scans,
  count(DISTINCT workspace_id)::BIGINT AS workspaces, sum(hours::DECIMAL(18, 2))::DOUBLE AS hours FROM progress GROUP BY 1""")
oracle("duration_percentiles", """SELECT date_trunc('day', ts)::TIMESTAMP AS day, quantile_disc(duration_seconds, 0.5) AS p50,
  quantile_disc(duration_seconds, 0.9) AS p90, quantile_disc(duration_seconds, 0.99) AS p99 FROM progress GROUP BY 1""")
oracle("validation_outcomes", """SELECT count(*)::BIGINT AS validated, (count(*) FILTER (outcome = 'passed'))::BIGINT AS passed,
  (count(*) FILTER (outcome = 'passed_with_regression'))::BIGINT AS passed_with_regression,
  (count(*) FILTER (outcome = 'failed'))::BIGINT AS failed FROM outcomes""")
oracle("days_to_return", """SELECT quantile_disc(days, 0.5) AS p50, quantile_disc(days, 0.9) AS p90 FROM progress WHERE NOT is_first AND days > 0""")
oracle("volume_30d", f"SELECT date_trunc('day', ts)::TIMESTAMP AS day, count(*)::BIGINT AS scans FROM progress WHERE {_recent(30)} GROUP BY 1")
PARTS["traffic"] = """
SELECT date_trunc('day', ts)::TIMESTAMP AS timestamp, (count(*) FILTER (event_type = 'click'))::BIGINT AS clones,
  (count(DISTINCT user_id) FILTER (event_type = 'click'))::BIGINT AS unique_cloners, (count(*) FILTER (event_type = 'view'))::BIGINT AS views,
  (count(DISTINCT user_id) FILTER (event_type = 'view'))::BIGINT AS unique_viewers, (count(*) FILTER (event_type = 'purchase'))::BIGINT AS v1_0,
  (count(*) FILTER (event_type = 'error'))::BIGINT AS v1_1, (count(*) FILTER (event_type = 'signup'))::BIGINT AS stargazers
FROM events GROUP BY 1"""
PARTS["last_traffic"] = "SELECT * FROM traffic ORDER BY timestamp DESC LIMIT 1"
_TRAFFIC = "timestamp, clones, unique_cloners, views, unique_viewers"
oracle("traffic_latest", f"SELECT {_TRAFFIC}, v1_0 + v1_1 AS total_release_downloads, stargazers FROM last_traffic")
oracle("traffic_trend", f"SELECT {_TRAFFIC} FROM traffic")
oracle("release_downloads", "SELECT 'v1_0' AS release, v1_0 AS downloads FROM last_traffic UNION ALL SELECT 'v1_1', v1_1 FROM last_traffic")
oracle("release_totals", """SELECT 'v' || year(o_orderdate) || '_' || month(o_orderdate) AS tag, coalesce(sum(l_quantity), 0)::BIGINT AS downloads
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
oracle("top_referrers", """SELECT row_number() OVER (ORDER BY n DESC, referrer)::BIGINT AS position, referrer, n::BIGINT AS count FROM (
  SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS referrer, count(*) AS n FROM pages GROUP BY 1 ORDER BY n DESC, referrer LIMIT 3)""".replace("row_number() OVER (ORDER BY n DESC, referrer)::BIGINT", "(row_number() OVER (ORDER BY n DESC, referrer))::BIGINT"))
_DAYS = ", ".join(
    f"max(CASE WHEN i = {i} THEN strftime(timestamp, '%Y-%m-%d') END) AS clones_day_{i}_date, max(CASE WHEN i = {i} THEN clones END) AS clones_day_{i}_count, "
    f"max(CASE WHEN i = {i} THEN unique_cloners END) AS clones_day_{i}_unique" for i in range(14))
oracle("clones_wide", f"""SELECT {_DAYS}, count(*)::BIGINT AS clones_days FROM (SELECT *, row_number() OVER (ORDER BY timestamp) - 1 AS i
  FROM (SELECT * FROM traffic WHERE clones > 0 ORDER BY timestamp DESC LIMIT 14))""")
oracle("clones_patch", """SELECT timestamp, (SELECT sum(clones) FROM traffic)::BIGINT AS clones, (SELECT max(unique_cloners) FROM traffic)::BIGINT AS unique_cloners,
  views, unique_viewers, v1_0 + v1_1 AS total_release_downloads, stargazers FROM last_traffic""")

# --- 2.11 -----------------------------------------------------------------------------

oracle("stream_dedup_events", "SELECT o_orderkey AS run_id, 'ws-' || o_custkey AS workspace_id FROM orders")
oracle("stream_daily_trend", "SELECT date_trunc('day', o_orderdate)::TIMESTAMP AS day, count(*)::BIGINT AS scans FROM orders GROUP BY 1")
oracle("stream_first_terminal", """
SELECT s.user_id, s.ts AS switch_time, r.ts AS start_time, r.event_id AS request_id,
  CASE r.event_type WHEN 'error' THEN 'Failed' WHEN 'signup' THEN 'Disabled' WHEN 'click' THEN 'Completed' ELSE 'no_new_refresh' END AS outcome
FROM events s LEFT JOIN events r ON r.user_id = s.user_id AND r.event_type IN ('error', 'signup', 'click')
  AND r.ts >= s.ts AND r.ts <= s.ts + INTERVAL 720 MINUTE
WHERE s.event_type = 'purchase'
QUALIFY row_number() OVER (PARTITION BY s.event_id ORDER BY r.ts, r.event_id) = 1""")
oracle("stream_late_rows", """SELECT 'scans' AS stream, count(*)::BIGINT AS input_rows, (count(*) FILTER (year(o_orderdate) < 1996
  AND o_orderdate <= (SELECT max(o_orderdate) FROM orders) - INTERVAL 500 DAY))::BIGINT AS dropped_rows FROM orders""")
oracle("stream_latest_run", """SELECT 'ws-' || o_custkey AS workspace_id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS run_id,
  arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS o_orderpriority, min(o_orderdate) AS first_run_at, max(o_orderdate) AS last_run_at,
  count(*)::BIGINT AS run_count FROM orders GROUP BY 1""")


def _cells(section: str, entry: str, body: str, numbers: str, texts: str = "") -> str:
    """One row per cell of a section: numbers as DOUBLE, texts as they are."""
    cells = [f"{{'name': '{c}', 'number': {c}::DOUBLE, 'text': NULL::VARCHAR}}" for c in numbers.split()]
    cells += [f"{{'name': '{c}', 'number': NULL::DOUBLE, 'text': {_shown(c)}}}" for c in texts.split()]
    return (f"SELECT '{section}' AS section, {entry} AS entry, r.name AS name, r.number AS number, r.text AS text "
            f"FROM (SELECT *, unnest([{', '.join(cells)}]) AS r FROM ({body}))")


def _shown(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')" if column in ("timestamp", "day", "published") else f"{column}::VARCHAR"


ORACLES["sink_snapshot"] = "\nUNION ALL ".join([
    _cells("reach", "''", ORACLES["reach"], "scans users workspaces tenants versions"),
    _cells("resolution", "''", ORACLES["resolution_rollup"],
           "resolved_pinned resolved_high resolved_medium resolved_custom_dsn resolved_artifacts return_scans"),
    _cells("value", "''", ORACLES["value_rollup"], "hours_saved inspected sempy_used_pct median_coverage"),
    _cells("trend", _shown("day"), ORACLES["daily_trend"], "scans workspaces"),
    _cells("versions", "version", ORACLES["version_adoption"], "scans workspaces tenants"),
    _cells("per_workspace", "workspace", ORACLES["workspace_progress"],
           "run_count first_pinned current_pinned resolved_pinned coverage", "timestamp is_first version"),
    _cells("skip_reasons", "reason", ORACLES["skip_reason_rollup"], "items"),
    _cells("state_backends", "backend", ORACLES["backend_split"], "scans"),
    _cells("first_vs_return", "is_first_run", ORACLES["first_vs_return"], "scans"),
    _cells("github", "''", ORACLES["clones_patch"], "clones unique_cloners views unique_viewers total_release_downloads stargazers", "timestamp"),
    _cells("clones_history", _shown("day"), """SELECT date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS count, count(DISTINCT user_id) AS uniques
FROM events WHERE event_type = 'click' GROUP BY 1""", "count uniques"),
    _cells("releases", "url", """SELECT 'v' || year(o_orderdate) || '.' || month(o_orderdate) AS tag, 'release ' || o_orderkey AS name, o_orderdate AS published,
  (SELECT coalesce(sum(l_quantity::BIGINT), 0) FROM lineitem WHERE l_orderkey = o_orderkey) AS downloads, 'https://releases.test/' || o_orderkey AS url FROM orders""",
           "downloads", "tag name published"),
])
PARTS["every_piece"] = PARTS["pieces"].replace("WHERE item_type IN ('SemanticModel', 'Dataflow')", "")
PARTS["every_expr"] = PARTS["texts"].replace("FROM pieces", "FROM every_piece")
PARTS["every_call"] = PARTS["mcalls"].replace("FROM exprs", "FROM every_expr")
oracle("stream_scan_calls", "SELECT item_id, m_function, connector_kind, migration, implementation, endpoint_hint FROM every_call")
oracle("estate_scan", _PER_WS)
PARTS["record_rows"] = """
SELECT c.workspace_id, 'run-' || c.workspace_id AS run_id, coalesce(a.artifacts_scanned, 0)::BIGINT AS artifacts_scanned,
  coalesce(risk_high, 0)::BIGINT AS risk_high, coalesce(risk_medium, 0)::BIGINT AS risk_medium, coalesce(risk_low, 0)::BIGINT AS risk_low,
  coalesce(risk_unknown, 0)::BIGINT AS risk_unknown, coalesce(risk_na, 0)::BIGINT AS risk_na,
  coalesce(total_calls, 0)::BIGINT AS total_calls, coalesce(migrating, 0)::BIGINT AS migrating_artifacts,
  coalesce(po, 0)::BIGINT AS pinned_odbc, coalesce(pr, 0)::BIGINT AS pinned_at_risk, coalesce(cd, 0)::BIGINT AS custom_dsn,
  coalesce(s.n, 0)::BIGINT AS skipped_count, c.inspected::BIGINT AS inspected_artifacts,
  round_even(100.0 * c.inspected / c.total, 0)::DOUBLE AS coverage_score_pct, (SELECT count(*) FROM supplier)::BIGINT AS fabric_connection_count,
  'workspace' AS scope, coalesce(f.hits, 0)::BIGINT AS sempy_hits, '' AS fabric_connections_error,
  coalesce(k.pairs, '') AS counts_by_connector, coalesce(s.pairs, '') AS skipped_by_reason
FROM cover c LEFT JOIN (
  SELECT workspace_id, count(DISTINCT item_id) AS hits FROM texts WHERE item_type = 'SemanticModel' AND
    ((k % 3 = 0 AND k % 5 <> 0 AND expression IS NOT NULL) OR (k % 6 = 0 AND k % 12 <> 0)) GROUP BY 1) f USING (workspace_id)
LEFT JOIN (
  SELECT workspace_id, count(*) AS artifacts_scanned, count(*) FILTER (worst_risk = 'high') AS risk_high,
    count(*) FILTER (worst_risk = 'medium') AS risk_medium, count(*) FILTER (worst_risk = 'low') AS risk_low,
    count(*) FILTER (worst_risk = 'unknown') AS risk_unknown, count(*) FILTER (worst_risk = 'na') AS risk_na,
    sum(calls) AS total_calls, count(*) FILTER (has_migrating) AS migrating, sum(pinned_odbc) AS po, sum(pinned_at_risk) AS pr,
    sum(custom_dsn) AS cd FROM arts GROUP BY 1) a USING (workspace_id)
LEFT JOIN (SELECT workspace_id, string_agg(connector_kind || '=' || n, ';' ORDER BY connector_kind) AS pairs FROM (
  SELECT workspace_id, connector_kind, count(*) AS n FROM rel GROUP BY 1, 2) GROUP BY 1) k USING (workspace_id)
LEFT JOIN (SELECT workspace_id, sum(n) AS n, string_agg(skip_reason || '=' || n, ';' ORDER BY skip_reason) AS pairs FROM (
  SELECT workspace_id, skip_reason, count(*) AS n FROM skip_rows WHERE skip_reason IS NOT NULL GROUP BY 1, 2) GROUP BY 1) s USING (workspace_id)"""
oracle("scan_record", "SELECT * FROM record_rows")
oracle("scan_record_events", """SELECT k, v, count(*)::BIGINT AS n FROM (
  SELECT 'workspace_id' AS k, workspace_id AS v FROM record_rows UNION ALL SELECT 'run_count', '1' FROM record_rows
  UNION ALL SELECT 'is_first_run', 'True' FROM record_rows UNION ALL SELECT 'current_risk_high', risk_high::VARCHAR FROM record_rows
  UNION ALL SELECT 'first_risk_high', risk_high::VARCHAR FROM record_rows UNION ALL SELECT 'resolved_risk_high', '0' FROM record_rows
  UNION ALL SELECT 'impacted_count', migrating_artifacts::VARCHAR FROM record_rows
  UNION ALL SELECT 'skipped_count', skipped_count::VARCHAR FROM record_rows UNION ALL SELECT 'scope', scope FROM record_rows
  UNION ALL SELECT 'sempy_hits', sempy_hits::VARCHAR FROM record_rows) GROUP BY 1, 2""")
PARTS["exported_calls"] = """
SELECT workspace_id, item_id, migration, fn = 'Odbc.DataSource' AS custom_dsn,
  CASE WHEN trap = 3 THEN '2.0' WHEN pin > 0 THEN pin || '.0' ELSE '' END AS implementation
FROM texts WHERE expression IS NOT NULL"""
PARTS["exported_risks"] = """
SELECT *, CASE WHEN migration = 'none' THEN 3 WHEN migration LIKE 'deprecation:%' THEN CASE WHEN implementation LIKE '1%' THEN 4 ELSE 3 END
  WHEN implementation LIKE '2%' THEN 1 WHEN implementation LIKE '1%' THEN 2 WHEN custom_dsn THEN 3 ELSE 1 END AS r
FROM exported_calls WHERE migration <> 'none' OR custom_dsn"""
oracle("tenant_scan", """
SELECT workspace_id, item_id, CASE max(r) WHEN 4 THEN 'high' WHEN 3 THEN 'medium' WHEN 2 THEN 'unknown' ELSE 'low' END AS worst_risk,
  bool_or(migration <> 'none') AS has_migrating, count(*)::BIGINT AS calls,
  (count(*) FILTER (implementation LIKE '1%'))::BIGINT AS pinned_odbc, (count(*) FILTER (custom_dsn))::BIGINT AS custom_dsn
FROM exported_risks GROUP BY 1, 2""")
oracle("tenant_skips", """
SELECT t.workspace_id, t.item_id, CASE WHEN e.item_id IS NULL AND item_type = 'Dataflow' THEN 'definition_parsed_but_no_expressions'
  WHEN e.item_id IS NULL THEN 'no_external_connectors' WHEN e.migration = 'none' AND NOT e.custom_dsn THEN 'no_migrating_connectors' END AS skip_reason
FROM texts t LEFT JOIN exported_calls e USING (item_id)""")
oracle("tenant_coverage", """
SELECT workspace_id, count(*)::BIGINT AS total_items, count(*)::BIGINT AS inspected_items, 0::BIGINT AS not_inspected_items,
  0::BIGINT AS other_items, 100::BIGINT AS score_pct FROM texts GROUP BY 1""")
