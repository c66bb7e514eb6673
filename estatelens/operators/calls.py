"""Connector-call scan: expressions in, one row per external call out.

The scan is a narrow transformation: regular expressions over each whole text,
one explode, two joins with fixed catalogs. It never shuffles, and its time
follows the length of the text, also where calls nest deeply or never close.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import dimensions
from ..catalog import fixed_values as fv
from ..functions import classify, text
from ..functions.arrays import explode_each, first_from, let, literal, matches, running_totals

_NAME = fv.CALL_NAME
_CALL = r"(?U)" + _NAME + r"\("

# Balanced parentheses to a fixed nesting depth, matched without backtracking.
# Calls that nest deeper or never close are windowed by pairing all parentheses.
_DEPTH = 12


def _balanced(depth: int) -> str:
    inner = r"\([^()]*+\)"
    for _ in range(depth - 1):
        inner = r"\((?:[^()]++|" + inner + r")*+\)"
    return inner


_CALL_WINDOW = r"(?U)" + _NAME + r"(?=(" + _balanced(_DEPTH) + r")?)\("
_CALL_BEFORE = r"(?Us)(?=" + _NAME + r"\()(?<=(\A.{0,39}|.{40}))" + _NAME + r"\("
_CALL_AFTER = r"(?Us)" + _NAME + r"\((?=(.{0,160}))"
_IMPLEMENTATION = fv.IMPLEMENTATION_HEAD + "(" + fv.IMPLEMENTATION_VALUE + ")['\"]"
_DSN = "(?iU)" + "|".join(fv.CUSTOM_DSN_PATTERNS)
# The same facts as places in a whole text: the value is looked at, not consumed, so that matches never hide others.
_LITERAL_AT = r'"(?=([^"]+)")'
_IMPLEMENTATION_AT = fv.IMPLEMENTATION_HEAD + r"(?=(" + fv.IMPLEMENTATION_VALUE + r")['\"])"


def paired_parentheses(source: str) -> str:
    """(start, end) of every opening parenthesis, in order; ``end`` is behind its partner, NULL if it never closes.

    One pass gives the running depth; on one level opening and closing parentheses take turns, so after a sort by
    level and place the partner is the next one. Time follows the length of the text. SQL text in and out.
    """
    depth = running_totals("transform(par, par_p -> if(par_p.value = '(', 1L, -1L))")
    levels = ("transform(par, (par_p, par_i) -> struct(get(par_depth, par_i) + if(par_p.value = '(', 0, 1) as level, "
              "par_p.start as at, par_p.value = '(' as opens))")
    partner = "if(get(par_by, par_i + 1).level = par_p.level, get(par_by, par_i + 1).at + 1, null)"
    paired = f"transform(par_by, (par_p, par_i) -> struct(par_p.at as start, {partner} as end, par_p.opens as opens))"
    ordered = let("par_by", f"sort_array({let('par_depth', depth, levels)})", f"sort_array(filter({paired}, par_p -> par_p.opens))")
    return let("par", matches(source, "[()]"), ordered)


def deep_sites(source: str) -> str:
    """Per call of a text the place of its arguments and what the scan wants to know of them, without their texts.

    Windows of calls that nest or never close overlap, so their texts together would grow with the square of their
    number. What is found in the whole text is found once, and each call takes the first that starts inside it.
    SQL text in and out.
    """
    shown = f"translate({source}, {literal(text.HIDDEN)}, '()')"
    known = ", ".join(f"{value} as {name}" for name, value in {
        "heads": matches(source, _CALL), "pairs": paired_parentheses(source), "size": f"length({source})",
        "literals": matches(shown, _LITERAL_AT, 1), "implementations": matches(shown, _IMPLEMENTATION_AT, 1),
        "dsn": matches(shown, _DSN)}.items())

    def inside(kind: str, beyond: str) -> str:
        return let("deep_m", first_from(f"deep.{kind}", "deep_begin"), f"if({beyond} <= deep_end, deep_m.value, null)")

    closed = "deep_m.end + length(deep_m.value) + 1"
    facts = (f"struct(deep_begin as start, deep_end as end, {inside('literals', closed)} as endpoint, "
             f"{inside('implementations', closed)} as implementation, {inside('dsn', 'deep_m.end')} is not null as custom_dsn)")
    end = f"coalesce({first_from('deep.pairs', 'deep_begin')}.end, deep.size)"
    site = let("deep_begin", "deep_head.end - 1", let("deep_end", end, facts))
    return let("deep", f"struct({known})", f"transform(deep.heads, deep_head -> {site})")


def _found_sites(expressions: DataFrame, excerpts: bool, keep_all: bool = False) -> DataFrame:
    """Call sites with ``_tail`` (argument text; NULL for calls that nest deeply or never close, which have ``_deep``).

    With ``keep_all`` every expression leaves a row, and ``_is_call`` says which rows are external calls.
    """
    may_call = F.col("expression").contains(".") & F.col("expression").contains("(")
    source = F.col("_hidden")
    tails = F.regexp_extract_all(source, F.lit(_CALL_WINDOW), F.lit(2))
    hidden = (expressions if keep_all else expressions.filter(may_call)).withColumn(
        "_hidden", text.hide_strings(F.col("expression"))
    ).withColumn("_tails", tails)
    is_hard = F.exists("_tails", lambda t: t == "")
    found = [
        F.regexp_extract_all(source, F.lit(_CALL), F.lit(0)).alias("head"),
        F.col("_tails").alias("tail"),
        F.when(is_hard, F.expr(deep_sites("_hidden"))).otherwise(F.array()).alias("deep"),
    ]
    if excerpts:
        found += [
            F.regexp_extract_all(source, F.lit(_CALL_BEFORE), F.lit(2)).alias("before"),
            F.regexp_extract_all(source, F.lit(_CALL_AFTER), F.lit(2)).alias("after"),
        ]
    base = [c for c in expressions.columns if c != "expression"]
    site = F.col("_site")
    sites = F.arrays_zip(*found)
    if keep_all:
        exploded = hidden.select(*base, "_hidden", F.posexplode_outer(F.when(may_call, sites)).alias("_pos", "_site"))
    else:
        exploded = explode_each(hidden, [*base, "_hidden"], sites, "_pos", "_site")
    rows = exploded.withColumn("m_function", F.regexp_extract(site["head"], r"^[A-Za-z0-9.]+", 0)).withColumn(
        "prefix", F.lower(F.substring_index("m_function", ".", 1)))
    is_call = ~F.col("prefix").isin(fv.BUILTIN_PREFIXES)
    if not keep_all:
        rows = rows.filter(is_call)
    out = [*base, F.col("_pos").alias("call_pos"), "m_function", "prefix", "_hidden",
           text.reveal_strings(text.non_empty(site["tail"])).alias("_tail"), site["deep"].alias("_deep")]
    if keep_all:
        out.append(F.coalesce(is_call, F.lit(False)).alias("_is_call"))
    if excerpts:
        around = F.concat(site["before"], site["head"], site["after"])
        out.append(text.reveal_strings(around).alias("around"))
    return rows.select(*out)


def call_sites(expressions: DataFrame, excerpts: bool = True) -> DataFrame:
    """One row per external call site, in order of appearance.

    Adds ``call_pos`` (position in the expression), ``m_function``, ``prefix``,
    ``window`` (argument text, comments blanked) and, on request, ``around``
    (the text 40 characters before to 160 after the call head).
    """
    deep = F.col("_deep")
    cut = F.substring(F.col("_hidden"), (deep["start"] + 1).cast("int"), (deep["end"] - deep["start"]).cast("int"))
    window = F.coalesce("_tail", text.reveal_strings(cut))
    return _found_sites(expressions, excerpts).withColumn("window", window).drop("_hidden", "_tail", "_deep")


def classify_sites(sites: DataFrame, rules=None, names=None) -> DataFrame:
    """Connector kind and migration bucket of every call site."""
    spark = sites.sparkSession
    catalog = dimensions.function_catalog(spark, rules)
    friendly = dimensions.prefix_names(spark, names)
    written_prefix = F.substring_index("m_function", ".", 1)
    return (
        sites.join(catalog, F.lower("m_function") == F.col("fn_key"), "left")
        .join(friendly, F.col("prefix") == F.col("prefix_key"), "left")
        .withColumn("connector_kind", F.coalesce("rule_kind", "friendly_name", written_prefix))
        .withColumn("migration", F.coalesce("rule_migration", F.lit("none")))
        .drop("fn_key", "rule_kind", "rule_migration", "prefix_key", "friendly_name")
    )


def site_details(sites: DataFrame) -> DataFrame:
    """Pin, endpoint, raw-DSN flag and excerpt read from the call's own arguments."""
    tail, deep = F.col("_tail"), F.col("_deep")
    whole = tail.isNotNull()
    endpoint = F.when(whole, text.non_empty(F.regexp_extract(tail, '"([^"]+)"', 1))).otherwise(deep["endpoint"])
    pinned = F.when(whole, text.non_empty(F.regexp_extract(tail, _IMPLEMENTATION, 1))).otherwise(deep["implementation"])
    out = sites.withColumns({
        "implementation": pinned,
        "endpoint_hint": text.truncate_marked(text.redact_secrets(endpoint), fv.ENDPOINT_CAP),
        "custom_dsn": F.col("prefix").isin(fv.CUSTOM_DSN_PREFIXES)
        | F.when(whole, classify.any_match(tail, fv.CUSTOM_DSN_PATTERNS)).otherwise(deep["custom_dsn"]),
    })
    if "around" in sites.columns:
        out = out.withColumn("excerpt", excerpt(F.col("around")))
    return out.drop("_hidden", "_tail", "_deep")


def excerpt(around: Column) -> Column:
    one_line = text.strip(F.translate(around, "\n", " "))
    return text.truncate_marked(text.redact_secrets(one_line), fv.EXCERPT_CAP)


def scan_expressions(
    expressions: DataFrame, excerpts: bool = True, rules=None, names=None
) -> DataFrame:
    """Every external connector call of every expression.

    ``expressions`` carries key columns of any kind plus ``expression``; the key
    columns come back on each call row with ``call_pos`` giving the order.
    """
    sites = classify_sites(_found_sites(expressions, excerpts), rules, names)
    calls = site_details(sites).drop("around", "prefix")
    return calls.withColumns({
        "is_migrating": classify.is_migrating(F.col("migration")),
        "is_pinned_odbc": classify.is_pinned_odbc(F.col("implementation")),
        "is_pinned_adbc": classify.is_pinned_adbc(F.col("implementation")),
    })


def expression_yields(expressions: DataFrame, keys: list[str], rules=None, names=None) -> DataFrame:
    """Per expression and call (keys, ``is_call``, ``is_relevant``), expressions without calls included, in one pass.

    What asks both which items have expressions and what their calls are reads the texts once.
    """
    sites = classify_sites(_found_sites(expressions, False, keep_all=True), rules, names)
    wanted = (F.col("migration") != "none") | F.col("custom_dsn")
    return site_details(sites).select(
        *keys, F.col("_is_call").alias("is_call"), (F.col("_is_call") & F.coalesce(wanted, F.lit(False))).alias("is_relevant"))


def migrating_calls(calls: DataFrame) -> DataFrame:
    return calls.filter("migration <> 'none'")


def kinds_summary(calls: DataFrame) -> DataFrame:
    return calls.groupBy("connector_kind").agg(F.count("*").alias("calls"))
