"""Quality rules per document and per host, in DataFrame functions only.

Rule failures are averaged by host, the rates are shrunk towards the corpus with an empirical beta prior, and
hosts whose shrunk rate is too high take all their documents with them.

Defined results: a null or empty text has no words and fails; a null host has no verdict, so its documents stand
on their own rules; repeated rows are judged one by one and all count for their host; an empty table gives no
rows; extra columns pass through (measure names of this module must not be among them, see `measure`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, own_columns, SPACE, stored

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_SHARE = 0.5
MAX_SYMBOL_SHARE = 0.1
MAX_DUP_LINE_SHARE = 0.3
MAX_HOST_RATE = 0.5
PRIOR_STRENGTH = (2.0, 1000.0)  # documents the prior may count as


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that the array holds twice or more, first ones included."""

    def covered(starts: Column) -> Column:
        # Starts ascend: each adds 3 words less the overlap with the one before.
        return F.aggregate(
            starts, F.struct(F.lit(-3).alias("last"), F.lit(0).cast("bigint").alias("sum")),
            lambda acc, p: F.struct(p.alias("last"), (acc["sum"] + F.least(F.lit(3), p - acc["last"])).alias("sum")),
            lambda acc: acc["sum"])

    def repeated(ordered: Column) -> Column:
        twice = F.filter(ordered, lambda x, i: (x["k"] == F.get(ordered, i - 1)["k"]) | (x["k"] == F.get(ordered, i + 1)["k"]))
        return F.sort_array(F.transform(twice, lambda x: x["p"]))

    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.struct(F.concat_ws(" ", F.slice(words, i + 1, F.lit(3))).alias("k"), i.alias("p")))
    return F.when(F.size(words) < 4, F.lit(0).cast("bigint")).otherwise(
        let(F.sort_array(windows), lambda ordered: let(repeated(ordered), covered)))


def _measures(text: Column) -> Column:
    words = F.regexp_extract_all(text, F.lit(f"([^{SPACE}]+)"), F.lit(1))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(f"[^{SPACE}]"))
    of_words = let(words, lambda w: F.struct(
        F.size(w).cast("bigint").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    n_dup = let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint"))
    return F.struct(
        of_words.alias("w"), n_dup.alias("n_dup_lines"), F.size(lines).cast("bigint").alias("n_lines"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of docs and one struct `rules` of measures and failures."""
    m = F.col("m")
    own, columns = own_columns(docs, "rules")
    counts = docs.select(own, _measures(F.coalesce(F.col(text), F.lit(""))).alias("m"))
    base = (m["w"]["n_words"] < MIN_WORDS) | (100 * m["w"]["n_repeat_words"] > int(100 * MAX_REPEAT_SHARE) * m["w"]["n_words"])
    return counts.select(*columns, F.struct(
        m["w"]["n_words"].alias("n_words"), m["word_chars"].alias("word_chars"), m["n_symbols"].alias("n_symbols"),
        m["n_dup_lines"].alias("n_dup_lines"), m["w"]["n_repeat_words"].alias("n_repeat_words"),
        base.alias("base_failed"),
        (m["n_symbols"] > MAX_SYMBOL_SHARE * m["word_chars"]).alias("symbols_failed"),
        (m["n_dup_lines"] > MAX_DUP_LINE_SHARE * m["n_lines"]).alias("lines_failed"),
    ).alias("rules"))


def host_rates(measured: DataFrame, host: str) -> DataFrame:
    """One row per host: documents, failures and the failure rate shrunk by the empirical beta prior.

    The prior is fitted by moments: its mean is the corpus rate, its strength follows from how much more the host
    rates scatter than documents drawn at that rate would. The counts are summed before the shuffle, so a host
    with a third of all rows costs as little as any other.
    """
    failed = F.col("rules.base_failed") | F.col("rules.symbols_failed") | F.col("rules.lines_failed")
    hosts = stored(
        measured.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("host"))
        .agg(F.count("*").alias("n_docs"), F.count_if(failed).alias("n_failed")))
    rate, n = F.col("n_failed") / F.col("n_docs"), F.col("n_docs")
    total = hosts.agg(F.sum("n_failed").alias("f"), F.sum("n_docs").alias("n"), F.count("*").alias("h")).first()
    if not total.n:
        return hosts.withColumn("rate", F.lit(None).cast("double"))
    mean = total.f / total.n
    spread = hosts.agg(
        (F.sum(n * (rate - mean) * (rate - mean)) / F.sum(n)).alias("v"), F.avg(F.lit(mean * (1 - mean)) / n).alias("noise")
    ).first()
    between = spread.v - min(spread.noise, mean * (1 - mean) * total.h / total.n)
    low, high = PRIOR_STRENGTH
    strength = high if between <= 0 else min(high, max(low, mean * (1 - mean) / between - 1))
    return hosts.withColumn("rate", (F.col("n_failed") + mean * strength) / (n + strength))


def judge(docs: DataFrame, text: str = "text", host: str = "source", keep_text: bool = False) -> DataFrame:
    """Columns of docs, on request with the text, with `rules` and `kept`; one narrow pass over the texts.

    What is measured (a few bytes a document besides a kept text) is written once and read twice: for the hosts
    and for the join back.
    """
    measured = measure(docs, text)
    measured = stored(measured if keep_text else measured.drop(text))
    bad = host_rates(measured, host).where(F.col("rate") > MAX_HOST_RATE).select(
        F.col("host").alias("bad_host"), F.lit(True).alias("bad"))
    own, columns = own_columns(measured, "kept")
    joined = measured.select(own, F.col(host).alias("of_host"), F.col("rules.base_failed").alias("failed")).join(
        bad, F.col("of_host") == F.col("bad_host"), "left")
    return joined.select(*columns, (~F.col("failed") & F.col("bad").isNull()).alias("kept"))
