"""The streaming scan of definitions."""

from pyspark.sql import functions as F

from estatelens.session import work_folder
from estatelens.streaming import streams


def test_one_arriving_file_is_scanned_by_many_tasks(spark):
    folder = work_folder(spark)
    spark.range(200).select("id", F.lit('let Source = Snowflake.Databases("h") in Source').alias("expression")).coalesce(1).write.parquet(f"{folder}/texts")
    arriving = spark.readStream.schema("id bigint, expression string").parquet(f"{folder}/texts")
    out = streams.drain(streams.scan_calls(arriving))
    assert len(out.inputFiles()) > 1
    assert out.filter("m_function = 'Snowflake.Databases'").count() == 200
