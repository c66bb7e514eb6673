"""The corpus pipeline: quality rules, near-dedup, repeated strings, decontamination, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next stage's
documents. All but the last return the columns of documents; the last one returns packed pieces with their ids.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelens.llm import bin_slack, fm_index, host_rules, icws, suffix_dedup
from estatelens.llm.common import SPACE, drop_tables, let_go, noted_tables, shared_folder, table

ORACLE_SQL = None  # stages 2 to 5 have no SQL form; tests/llm/test_pipeline.py runs them against plain versions


_TABLES: list[str] = []  # intermediate tables of the stages so far


def stage(function):
    """A stage that first lets go of what earlier ones needed, whose results are written by then.

    Their shuffle files and, but for the first stage, which may begin another run, their intermediate tables go; tables
    that the documents still read (a result that was not written) stay.
    """

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if function is not quality_rules.__wrapped__:
            _TABLES[:] = drop_tables(spark, _TABLES, docs)
        else:
            _TABLES.clear()
        let_go(spark)
        with noted_tables() as begun:
            result = function(spark, docs, sf_dir)
        _TABLES.extend(begun)
        return result

    return run_stage


def _with_length(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Documents whose texts changed: n_chars follows the text."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast("bigint"))
    return docs.select(columns)


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, of hosts that pass them."""
    return host_rules.judge(docs, keep_text=True).where("kept").select(docs.columns)


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return icws.without_near_duplicates(docs)


@stage
def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 400-byte strings and the passages of over 50 words that start elsewhere too; bytes of cut
    characters go as well.

    A document of which nothing is left has no text to train on and goes.
    """
    cut = suffix_dedup.dedup(docs, keep_text=True, passages="cut").drop("n_passages")
    gone = (F.col("n_removed") > 0) & ~F.col("kept_text").rlike(rf"[^{SPACE}]")
    return _with_length(cut.where(~gone).withColumnRenamed("kept_text", "text"), docs.columns)


@stage
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the benchmark's passages; a document of nothing else goes."""
    cut = fm_index.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    gone = (F.size("spans") > 0) & (F.trim("text") == "")
    return _with_length(cut.where(~gone), docs.columns)


@stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids in sequences."""
    return bin_slack.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near-dedup", near_dedup),
    ("suffix-array dedup", repeated_strings),
    ("decontamination", decontaminated),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, apply in STAGES:
        path = shared_folder(spark)
        apply(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
