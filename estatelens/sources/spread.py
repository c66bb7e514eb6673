"""Spreading small-file inputs over the cores."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of a table in few splits, rehashed by key so that every core parses.

    Text parsing is bound by CPU, and a table exported as a handful of files
    gives only as many tasks. A table that already has a split per core (any
    large one) comes back untouched, without a shuffle. No job is run for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)
