"""Writes that die, repeat or overlap."""

import pytest
from pyspark.sql import functions as F

from estatelens.plans import snapshot
from estatelens.session import work_folder
from estatelens.sinks import committed


def rows(df):
    return sorted(map(tuple, df.collect()))


def table(spark, n):
    return spark.range(n).select("id", (F.col("id") % 3).cast("string").alias("kind"))


def test_nothing_is_read_before_the_commit(spark):
    folder = work_folder(spark)
    with pytest.raises(ValueError):
        committed.read(spark, folder)
    dying = table(spark, 1000).repartition(4).withColumn("x", F.when(F.col("id") == 999, F.raise_error(F.lit("killed"))).otherwise(F.lit("a")))
    with pytest.raises(Exception, match="killed"):
        committed.write(dying, folder, "run-1")
    with pytest.raises(ValueError):
        committed.read(spark, folder)
    committed.write(table(spark, 1000).withColumn("x", F.lit("a")), folder, "run-1")
    assert committed.read(spark, folder).count() == 1000
    assert committed.history(spark, folder).select("version", "rows").collect() == [("run-1", 1000)]


def test_a_dead_write_leaves_the_last_version(spark):
    folder = work_folder(spark)
    committed.write(table(spark, 5), folder, "a", ["kind"])
    before = rows(committed.read(spark, folder))
    with pytest.raises(Exception, match="killed"):
        committed.write(table(spark, 6).withColumn("kind", F.when(F.col("id") >= 0, F.raise_error(F.lit("killed")))), folder, "b")
    assert rows(committed.read(spark, folder)) == before == rows(table(spark, 5))
    committed.write(table(spark, 6), folder, "b")
    committed.write(table(spark, 7), folder, "b")  # repeated: the newest of a version counts
    assert rows(committed.read(spark, folder, "b")) == rows(table(spark, 7))
    assert rows(committed.read(spark, folder, "a")) == before
    # data that is there but that no manifest row names: a writer that died before its commit
    table(spark, 9).write.parquet(f"{folder}/data/lost")
    assert rows(committed.read(spark, folder)) == rows(table(spark, 7))
    assert "lost" in committed.vacuum(spark, folder, keep=2)
    assert committed.unlisted(spark, folder, keep=2) == []
    assert rows(committed.read(spark, folder)) == rows(table(spark, 7))


def test_empty_tables_and_report_writers(spark):
    folder = work_folder(spark)
    empty = spark.createDataFrame([], "workspace_id string, item_id string, m_function string, status string")
    snapshot.write_calls(empty, folder)
    assert committed.read(spark, folder).columns == empty.columns and committed.read(spark, folder).count() == 0
    full = spark.createDataFrame([("w", "i", "f", "passed"), ("w", "j", "g", "failed")], empty.schema)
    snapshot.write_validation(full, folder)
    assert rows(committed.read(spark, folder)) == rows(full)
    assert committed.history(spark, folder).count() == 2
