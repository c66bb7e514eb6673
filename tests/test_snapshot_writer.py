"""The writer of the dashboard snapshot."""

from pyspark.sql import functions as F

from estatelens.plans import snapshot
from estatelens.session import work_folder
from estatelens.sinks import committed


def test_snapshot_cells_are_made_in_all_tasks(spark):
    wide = spark.range(1000).repartition(8).select(
        F.lit("s").alias("section"), F.col("id").cast("string").alias("entry"), F.lit("n").alias("name"),
        F.col("id").cast("double").alias("number"), F.lit(None).cast("string").alias("text"))
    folder, seen = work_folder(spark), []
    keep = committed.write
    committed.write = lambda rows, *more: seen.append(rows._jdf.queryExecution().optimizedPlan().toString()) or keep(rows, *more)
    try:
        snapshot.write_snapshot(wide, folder)
    finally:
        committed.write = keep
    assert "Repartition 4, false" not in seen[0]
    assert committed.read(spark, folder).agg(F.count("*"), F.sum("number")).first()[:] == (1000, 499500.0)
