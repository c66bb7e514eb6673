"""Labelled documents as a bounded training sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def training_sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, held_out: int, bound: int) -> DataFrame:
    """doc_id, text, label of at most `bound` labelled documents outside the held-out fold, chosen by a hash of the id.

    Only training uses the bound. An id with contradicting labels teaches nothing; of rows that repeat an id the
    least text is taken. The ids (8 bytes each, `bound` at most) are broadcast, so the texts of the other documents stay in place.
    """
    agreed = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.min(label).alias("label"), F.max(label).alias("_max")).where(F.col("label") == F.col("_max"))
    chosen = agreed.where(fold(F.col("doc_id"), parts) != held_out).orderBy(
        F.xxhash64("doc_id"), "doc_id").limit(bound).select("doc_id", F.col("label").cast("int").alias("label"))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    known = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(
        F.min("text").alias("text"), F.min("label").alias("label"))
    return stored(known.repartition(16))
