"""Lookup data whose exact text decides the results.

Everything in this file is data, stated plainly: catalog rows, word lists,
patterns, labels, message texts, event and field names. ``{contact}`` in an
advice text is filled with the support contact a caller passes in.
"""

from __future__ import annotations

# --- fixed values: migration catalog (kind, M functions, family, bucket) ------
CONNECTOR_RULES = [
    ("Snowflake", ["Snowflake.Databases"], "snowflake", "odbc_to_adbc:snowflake"),
    ("Google BigQuery", ["GoogleBigQuery.Database", "GoogleBigQueryAad.Database"],
     "bigquery", "odbc_to_adbc:bigquery"),
    ("Databricks",
     ["Databricks.Catalogs", "Databricks.Contents", "Databricks.Query",
      "DatabricksMultiCloud.Catalogs", "DatabricksMultiCloud.Query"],
     "databricks", "odbc_to_adbc:databricks"),
    ("Dremio",
     ["Dremio.Databases", "Dremio.DatabasesV300", "Dremio.DatabasesV370",
      "DremioCloud.DatabasesByServer", "DremioCloud.DatabasesByServerV330",
      "DremioCloud.DatabasesByServerV370"],
     "dremio", "odbc_to_adbc:dremio"),
    ("Amazon Redshift", ["AmazonRedshift.Database"], "redshift", "odbc_to_adbc:redshift"),
    ("Spark / HDInsight", ["Spark.Tables", "AzureSpark.Tables", "ApacheSpark.Tables"],
     "spark", "odbc_to_adbc:spark"),
    ("Impala", ["Impala.Database"], "impala", "odbc_to_adbc:impala"),
    ("Hive LLAP", ["AzureHiveLLAP.Database", "ApacheHiveLLAP.Database"],
     "hive", "deprecation:hive"),
]

# --- fixed values: display name per function prefix ---------------------------
PREFIX_NAMES = {
    "sql": "SQL Server",
    "postgresql": "PostgreSQL",
    "mysql": "MySQL",
    "oracle": "Oracle",
    "teradata": "Teradata",
    "sybase": "Sybase",
    "db2": "IBM Db2",
    "informix": "IBM Informix",
    "sqlite": "SQLite",
    "access": "Microsoft Access",
    "excel": "Excel",
    "csv": "CSV",
    "text": "Text / CSV",
    "json": "JSON",
    "xml": "XML",
    "html": "HTML",
    "web": "Web",
    "odata": "OData",
    "sharepoint": "SharePoint",
    "onedrive": "OneDrive",
    "azurestorage": "Azure Storage",
    "azuredatalake": "Azure Data Lake",
    "azureblob": "Azure Blob Storage",
    "azuretables": "Azure Tables",
    "azurequeues": "Azure Queues",
    "azurecosmosdb": "Azure Cosmos DB",
    "azuredatabricks": "Azure Databricks",
    "databricks": "Databricks",
    "azuresynapse": "Azure Synapse",
    "azureml": "Azure ML",
    "kusto": "Azure Data Explorer (Kusto)",
    "azuredataexplorer": "Azure Data Explorer",
    "azurepostgresql": "Azure PostgreSQL",
    "azuremysql": "Azure MySQL",
    "amazons3": "Amazon S3",
    "amazonathena": "Amazon Athena",
    "amazonredshift": "Amazon Redshift",
    "googleanalytics": "Google Analytics",
    "googlesheets": "Google Sheets",
    "googlebigquery": "Google BigQuery",
    "googlebigqueryaad": "Google BigQuery (AAD)",
    "snowflake": "Snowflake",
    "salesforce": "Salesforce",
    "sap": "SAP",
    "saphana": "SAP HANA",
    "sapbw": "SAP BW",
    "dynamics": "Dynamics 365",
    "commondataservice": "Dataverse (CDS)",
    "dataverse": "Dataverse",
    "exchange": "Exchange",
    "hive": "Hive",
    "impala": "Impala",
    "vertica": "Vertica",
    "spark": "Spark",
    "hdinsight": "HDInsight",
    "azurehdinsightspark": "Azure HDInsight Spark",
    "odbc": "Generic ODBC",
    "oledb": "Generic OLE DB",
    "folder": "Folder",
    "file": "File",
}

# --- fixed values: prefixes of built-in library functions ---------------------
BUILTIN_PREFIXES = [
    "table", "record", "list", "text", "number", "datetime", "date",
    "duration", "time", "value", "type", "function", "expression",
    "diagnostics", "binary", "logical", "any", "iterator", "combiner",
    "splitter", "replacer", "comparer", "geometry",
    "json", "xml", "csv", "html", "uri",
    "character", "guid", "byteorder", "hash", "cryptography", "base64",
    "section",
]

# --- fixed values: item types --------------------------------------------------
DATASET_TYPES = ["SemanticModel", "Dataset"]
INSPECTED_TYPES = ["SemanticModel", "Dataset", "Dataflow", "DataPipeline"]
KNOWN_UNINSPECTED_TYPES = [
    "Notebook", "KQLQueryset", "Lakehouse", "Warehouse", "MirroredDatabase",
    "Report", "PaginatedReport", "MLModel", "MLExperiment", "Environment",
    "SparkJobDefinition",
]

# --- fixed values: risk levels, their rank, their display --------------------
RISK_RANK = {"high": 4, "medium": 3, "unknown": 2, "low": 1, "na": 0}
RISK_ALIASES = {
    "will_fail": ["high"],
    "needs_review": ["medium", "unknown"],
    "ready": ["low"],
    "other": ["na"],
}
STATUS_OF_RISK = {"high": "fail", "medium": "warn", "unknown": "warn", "na": "none", "low": "ok"}
STATUS_LABELS = {"ok": "Ready", "fail": "Will fail", "warn": "Needs review", "none": "Not in migration"}
STATUS_FILTERS = {"fail": "will_fail", "warn": "needs_review", "ok": "ready", "none": "other"}

# --- fixed values: portal links ------------------------------------------------
PORTAL_SEGMENTS = {
    "SemanticModel": "datasets",
    "Dataset": "datasets",
    "Dataflow": "dataflows",
    "DataPipeline": "pipelines",
}
PORTAL_BASES = {
    "commercial": "https://app.fabric.microsoft.com",
    "gcc": "https://app.powerbigov.us",
    "gcc-high": "https://app.high.powerbigov.us",
    "dod": "https://app.mil.powerbigov.us",
    "china": "https://app.powerbi.cn",
}

# --- fixed values: secret patterns (Java regex flags added where used) -------
SECRET_KEYS = (
    r"password|pwd|pass|token|secret|apikey|api[_\- ]?key|accountkey|"
    r"account[_\- ]?key|shared[_\- ]?access[_\- ]?signature|sas|authorization|bearer"
)
JWT_PATTERN = r"\beyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{5,}\b"
REDACTED = "***REDACTED***"
EXCERPT_CAP = 500
ENDPOINT_CAP = 300
TRUNCATION_MARK = " ...(truncated)"

# --- fixed values: raw-connection-string patterns ------------------------------
CUSTOM_DSN_PATTERNS = [
    r"\bOdbc\.DataSource\s*\(",
    r"\bOdbc\.Query\s*\(",
    r"\bDSN\s*=\s*[\"']",
    r"\bDriver\s*=\s*\{",
]
CUSTOM_DSN_PREFIXES = ["odbc", "oledb"]
# A dotted name before an opening parenthesis, and a pin inside the arguments.
CALL_NAME = r"\b([A-Za-z][A-Za-z0-9]*+(?:\.[A-Za-z][A-Za-z0-9]*+)++)\s*+"
IMPLEMENTATION_HEAD = r"""(?iU)Implementation\s*=\s*['"]"""
IMPLEMENTATION_VALUE = r"""[^'"]+"""

# --- fixed values: where activities and references sit in an activity doc -----
CONTAINER_TYPES = ["IfCondition", "ForEach", "Until", "Switch"]
CHILD_KEYS = ["activities", "ifTrueActivities", "ifFalseActivities"]
ROOT_REF_ROLES = ["dataset", "linkedService", "externalReferences", "connectionReference"]

# --- fixed values: run-state and event constants -------------------------------
STATE_SCHEMA_VERSION = 1
MANUAL_MINUTES_PER_ITEM = 3
SCAN_EVENT = "scan_complete"
VALIDATION_EVENT = "validation_complete"
TRAFFIC_EVENT = "github_traffic"
TERMINAL_STATUSES = ["Completed", "Failed", "Disabled"]
VALIDATION_STATUSES = [
    "passed", "passed_with_regression", "failed", "no_new_refresh",
    "refresh_not_triggered", "skipped",
]
SEND_HISTORY_CAP = 20
RETRY_BUFFER_CAP = 200
SEND_LOG_CAP = 500
RETRY_FLUSH_CAP = 50

# --- fixed values: advice links ------------------------------------------------
DOCS_URL = "https://learn.microsoft.com/power-query/transition-to-adbc"
REFRESH_DOCS_URL = "https://learn.microsoft.com/power-bi/connect-data/refresh-data"
GATEWAY_DOCS_URL = "https://learn.microsoft.com/data-integration/gateway/service-gateway-manage"
INCREMENTAL_DOCS_URL = "https://learn.microsoft.com/power-bi/connect-data/incremental-refresh-overview"
DEFAULT_CONTACT = "your support contact"

# --- fixed values: refresh-error rules, first match wins -----------------------
# (pattern, issue, likely cause, suggested actions, docs)
ERROR_RULES = [
    (
        r"(DataSource\.Error:\s*ADBC:\s*driver\s*not\s*found|ADBC.*driver.*not.*(found|installed|available))",
        "ADBC driver not found",
        "Power BI Desktop or the on-prem gateway is on a build older than the release that ships the ADBC driver for this connector.",
        [
            "Update Power BI Desktop to the latest release.",
            "For gateway-backed refreshes: install the gateway release that contains ADBC support (check the gateway's release notes for the connector).",
            "As a temporary workaround, disable ADBC at the workspace level so this workload stays on ODBC.",
        ],
        DOCS_URL,
    ),
    (
        r"(ModelRefreshFailed_CredentialsNotSpecified|credentials.*not.*(specified|configured|set)|missing.*credentials|no.*credentials.*(configured|for))",
        "Data source credentials not configured",
        "The dataset has no stored credentials for the data source. Common right after creating a model, or after switching auth types (e.g. ODBC username/password to ADBC OAuth2).",
        [
            "Open Dataset settings → Data source credentials and click 'Edit credentials' for each source.",
            "Choose the auth method the ADBC driver supports (OAuth2 for Snowflake/BigQuery, key-based for Redshift, etc.).",
            "Enter valid credentials and save. Then retry the refresh.",
        ],
        REFRESH_DOCS_URL,
    ),
    (
        r"(DataSource\.Error:\s*ADBC:\s*authentication\s*failed|unauthorized|401|invalid.*credential|authentication.*failed|MSAL|OAuth2Failed|access.*was.*denied)",
        "ADBC authentication failed",
        "Cached credentials were created against the ODBC-era shape and the metadata no longer aligns with what ADBC expects (e.g. OAuth2 flow vs ODBC DSN username/password).",
        [
            "Clear permissions for this source: Dataset settings → Data source credentials → Edit → sign out.",
            "Re-authenticate using the auth method the ADBC driver supports.",
            "For Snowflake/BigQuery: verify the OAuth2 client ID / service account is still authorized and hasn't been revoked.",
            "For SP-based auth (Access Denied): confirm the SP still has read access on the data source (roles/shares can be revoked).",
        ],
        DOCS_URL,
    ),
    (
        r"(Expression\.Error:\s*Type\s*mismatch|schema.*(drift|mismatch|changed)|column.*not.*found|The key didn't match any rows|wide decimal|timestamp.*(different|coerced|type))",
        "Type mismatch or schema difference (ADBC vs ODBC)",
        "ADBC exposes data types differently than ODBC. Wide decimals, timestamps, and BigQuery record/geography columns are the common offenders. Downstream M steps that assumed the ODBC-coerced type now fail.",
        [
            "Use Table.TransformColumnTypes(...) to convert types explicitly rather than relying on implicit coercion.",
            "For BigQuery: handle record/geography columns explicitly.",
            "For Snowflake: cast VARIANT/OBJECT columns before downstream steps.",
            "Re-detect the schema in Power Query Online: Home → Refresh preview.",
        ],
        DOCS_URL,
    ),
    (
        r"(DSN|Odbc\.DataSource|Odbc\.Query|connection.*string.*(invalid|malformed|unrecognized))",
        "Custom DSN-style M query incompatible with ADBC",
        "The query builds a DSN-style ODBC connection string in M code. ADBC uses a URI-style connection object instead. The standard connectors abstract this away but custom M does not.",
        [
            "Rewrite the source step to use the standard connector (e.g. Snowflake.Databases, not Odbc.DataSource).",
            "If the query must stay on a raw DSN, keep the workspace-level ADBC override off for this workspace.",
            "Escalate to {contact} if the standard connector doesn't cover your scenario.",
        ],
        DOCS_URL,
    ),
    (
        r"(gateway.*not.*(reach|online|available)|OnPremisesGatewayNotReachable|Cluster URI|gateway.*offline)",
        "Gateway offline or unreachable",
        "The on-premises data gateway that this dataset depends on is not reachable.",
        [
            "Check the gateway service is running on the gateway machine.",
            "In the Fabric portal → Settings → Manage gateways, confirm the gateway shows 'Online'.",
            "If this dataset was moved to ADBC (cloud path), you may no longer need the gateway — remove the gateway binding.",
        ],
        GATEWAY_DOCS_URL,
    ),
    (
        r"(gateway.*ODBC|OnPremises.*driver|gateway.*driver.*(mismatch|not.*support))",
        "Service vs gateway driver mismatch",
        "The service and the gateway can be on different driver stacks. The gateway path may still be on ODBC while the service is on ADBC, and vice versa. This is expected during rollout and does not invalidate the test.",
        [
            "Verify which driver each path uses: Fabric portal for service, gateway release notes for gateway build.",
            "If the gateway path is failing, update the gateway to a release that includes ADBC.",
            "Consult connector-specific gateway guidance in the FAQ.",
        ],
        DOCS_URL,
    ),
    (
        r"(DataSource\.Error.*ODBC|ODBC.*driver.*not.*(found|installed)|Implementation\s*=\s*[\"']1\.0)",
        "Legacy ODBC path still pinned in M",
        "The M source step still references the legacy ODBC driver (usually a connector pinned to Implementation=\"1.0\").",
        [
            "Remove the [Implementation=\"1.0\"] option from the M source step, or replace it with \"2.0\".",
            "If the query must stay on ODBC during validation, keep the workspace-level ADBC override off.",
            "Remember: at cutover the legacy ODBC path is removed. Implementation=\"1.0\" pins will stop working.",
        ],
        DOCS_URL,
    ),
    (
        r"(proxy|HTTP_PROXY|HTTPS_PROXY|407|proxy.*authentication|Unable to.*(proxy|tunnel))",
        "Proxy configuration issue",
        "ADBC drivers may require additional proxy configuration beyond what ODBC needed.",
        [
            "Validate proxy behavior first: confirm the gateway or service can reach the data source through the proxy.",
            "For BigQuery specifically: proxy support for BigQuery ADBC is in progress. Contact {contact} for BigQuery proxy scenarios; custom binaries may be available.",
            "Check HTTP_PROXY / HTTPS_PROXY environment variables on the gateway machine.",
        ],
        DOCS_URL,
    ),
    (
        r"(timeout|timed out|Command timeout expired|took too long)",
        "Query timeout",
        "The refresh exceeded the connection or command timeout. ADBC streams results differently which can extend end-to-end refresh time in some workloads.",
        [
            "Increase CommandTimeout in the source step: e.g. Source = Snowflake.Databases(..., [CommandTimeout=#duration(0,1,0,0)]).",
            "Reduce the volume in the initial refresh (folding filters, incremental refresh).",
            "For very large fact tables, enable incremental refresh instead of full refresh.",
        ],
        INCREMENTAL_DOCS_URL,
    ),
    (
        r"(SSL|TLS|certificate|self.signed)",
        "TLS / certificate error",
        "The ADBC driver's TLS validation is stricter than the legacy ODBC driver.",
        [
            "Confirm the server certificate is trusted by the machine running the gateway.",
            "If using a private endpoint / self-signed cert, install the CA into the trust store on the gateway.",
            "As a last resort, set TrustServerCertificate=true in the connection string (not recommended for production).",
        ],
        DOCS_URL,
    ),
    (
        r"(rate.limit|429|too many requests|quota)",
        "Backend rate limit / quota",
        "The data source rejected the refresh due to a quota or rate limit.",
        [
            "Stagger scheduled refreshes across the tenant.",
            "Reduce parallelism (Table.Buffer, disable parallel loading in dataset settings).",
            "Check your Snowflake warehouse / BigQuery slot quota.",
        ],
        DOCS_URL,
    ),
    (
        r"(Dremio.*(connection|port|refused|31010|32010)|31010|32010)",
        "Dremio port change (ODBC 31010 → ADBC 32010)",
        "ODBC used Dremio port 31010; ADBC uses 32010. The connector switches the port automatically, but firewall rules that only allowed 31010 will now block traffic.",
        [
            "Confirm firewall/network policy allows outbound to Dremio on port 32010.",
            "Verify the Dremio server exposes ADBC/Arrow Flight on 32010.",
            "No M edits are required - the port switch is automatic once ADBC is enabled.",
        ],
        DOCS_URL,
    ),
    (
        r"(network|DNS|connection.*refused|Unable to connect)",
        "Network / connectivity failure",
        "The refresh couldn't reach the data source endpoint.",
        [
            "Confirm the endpoint hostname and port are reachable from the gateway (or from the Fabric service in cloud-only setups).",
            "If using a private endpoint, verify the VNet gateway / private link is healthy.",
            "Check firewall allowlists include the ADBC driver's outbound IPs.",
        ],
        DOCS_URL,
    ),
]
UNCATEGORIZED_ISSUE = "Uncategorized refresh error"
UNCATEGORIZED_CAUSE_PREFIX = "No known pattern matched. Raw error: "
UNCATEGORIZED_ACTIONS = [
    "Check the Power Query ADBC transition guide (" + DOCS_URL + ") for known issues.",
    "If this occurs on ADBC-migrated datasets, forward the full error to {contact} with tenant ID, connector, query, and the error text.",
]

# --- fixed values: validation outcomes (issue, cause, actions, docs) ----------
REGRESSION_THRESHOLD_PCT = 50
REGRESSION_ISSUE = "Refresh regression - ADBC noticeably slower than ODBC baseline"
REGRESSION_CAUSE = (
    "Refresh completed but took {delta}% longer than the pre-migration baseline. Possible causes: query folding regression, DirectQuery translation difference, or streaming pattern change in the ADBC driver."
)
REGRESSION_ACTIONS = [
    "Capture a repro: baseline duration, ADBC duration, connector, and the M query.",
    "For DirectQuery: run View native query on a representative visual and compare folded SQL between ODBC and ADBC.",
    "Try Table.Buffer or explicit type conversion on hot-path columns to isolate the cause.",
    "Escalate to {contact} with tenant ID and repro details.",
]
NOT_TRIGGERED = (
    "Insufficient permissions to trigger refresh",
    "Your identity doesn't have Build/Write on this dataset.",
    [
        "Ask a workspace admin to run this notebook, or grant Build permission on the dataset.",
        "Alternatively, trigger the refresh manually from the Fabric portal and re-run validate_migration(trigger_refresh=False).",
    ],
    DOCS_URL,
)
NOT_FINISHED = (
    "Refresh did not finish in time",
    "The refresh took longer than max_wait_minutes, or was still queued when we stopped polling.",
    [
        "Re-run validate_migration with a larger max_wait_minutes.",
        "Check the refresh history in the Fabric portal to see if it eventually completed.",
        "For very large models, consider validating with only_migrating=True first.",
    ],
    DOCS_URL,
)
NO_NEW_REFRESH = (
    "No new refresh to validate",
    "You passed trigger_refresh=False, but the most recent refresh in history is the same one recorded when the baseline was taken.",
    [
        "Trigger a refresh manually from the Fabric portal, or",
        "Re-run with trigger_refresh=True (default).",
    ],
    DOCS_URL,
)
REASON_COMPLETED = "Refresh completed successfully after ADBC switch"
REASON_NOT_TRIGGERED = "POST to /refreshes was rejected (check permissions)"
REASON_NOT_FINISHED = "No refresh completed within the wait window"
REASON_NO_NEW_REFRESH = (
    "trigger_refresh=False was used but no refresh newer than the baseline has completed yet. "
    "Trigger a refresh in Fabric, then re-run validate_migration."
)

# --- fixed values: scan-time advice (issue, cause, actions) --------------------
SCAN_ADVICE = {
    "deprecation": (
        "{Family} connector being deprecated — no ADBC replacement",
        "The {family} connector is scheduled for deprecation. Unlike the ODBC→ADBC migration, there is no drop-in modern driver — the connector is being retired entirely. Every query using it will need to move to a supported alternative.",
        [
            "Identify a supported target connector for this workload (Databricks, Fabric SQL Endpoint, or another modern engine).",
            "Rewrite the source step against the target connector in a copy of the dataset.",
            "Validate row counts + refresh duration vs. baseline before cutting over production.",
            "Coordinate the switch with your capacity plan since backing store may change.",
        ],
    ),
    "custom_dsn": (
        "Custom DSN-style M — needs review before ADBC flip",
        "This query builds a DSN-style ODBC connection string in M. ADBC uses a URI-style connection object instead; the standard connectors abstract this away but custom M does not.",
        [
            "Rewrite the source step to use the standard connector (e.g. Snowflake.Databases, not Odbc.DataSource).",
            "If the query must stay on ODBC, keep the workspace-level ADBC override off.",
            "Escalate to {contact} if the standard connector doesn't cover your scenario.",
        ],
    ),
    "pinned_no_gateway": (
        "Implementation=\"1.0\" pinned, no gateway — will fail at cutover",
        "This connection explicitly pins the legacy ODBC driver via Implementation=\"1.0\". At cutover the ODBC path is removed; without a gateway, this refresh will fail.",
        [
            "Remove [Implementation=\"1.0\"] from the source step (or replace with \"2.0\").",
            "Validate the refresh works on ADBC before the cutover date.",
            "Alternatively, bind a gateway to this dataset so the ODBC path is available via the gateway.",
        ],
    ),
    "pinned": (
        "Implementation=\"1.0\" pinned — validate ADBC path",
        "The connection pins the legacy ODBC driver. Refreshes continue to work through the gateway during the validation window, but at cutover the ODBC path is removed.",
        [
            "Test removing [Implementation=\"1.0\"] in a copy of the dataset.",
            "Compare row counts, refresh duration, and query results between ODBC and ADBC.",
            "Roll the change out to production before the cutover date.",
        ],
    ),
    "ready": (
        "Ready for ADBC — no action needed unless validation reveals issues",
        "This connection uses the standard connector without an Implementation pin. The tenant/workspace ADBC switch will handle the migration automatically.",
        [
            "Enable the tenant setting 'Use ADBC drivers for supported connectors' in a test workspace.",
            "Refresh this dataset and compare row counts, duration, and results to baseline.",
            "If everything matches, roll the switch out to production workspaces.",
        ],
    ),
}
