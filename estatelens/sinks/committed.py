"""Tables that are replaced as a whole: data first, a manifest row last.

Every write puts its files into a folder of its own; only then one manifest row names that folder. Readers follow the
manifest, so a write that dies leaves nothing that anyone reads, and a write that is repeated replaces itself. Earlier
versions stay readable until ``vacuum`` is asked to drop what no kept version names. All of it lies below one folder
that the cluster shares, and is written by Spark's own committers.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_MANIFEST = "number bigint, version string, part string, rows bigint, schema string, partitions array<string>"


def _manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")


def _entries(spark: SparkSession, folder: str) -> list:
    """Manifest rows, newest last; a few numbers and names per write."""
    spark.createDataFrame([], _MANIFEST).write.mode("append").parquet(f"{folder}/manifest")
    return _manifest(spark, folder).orderBy("number", "part").collect()


def write(table: DataFrame, folder: str, version: str | None = None, partition_by: list[str] | None = None) -> int:
    """Replaces the table below ``folder``; returns the number of the write.

    ``version`` names what is written (a run id, a day). Writing a version again
    gives it a new folder, and the newest one counts.
    """
    spark, seen, part = table.sparkSession, Observation(), uuid.uuid4().hex
    writer = table.observe(seen, F.count(F.lit(1)).alias("rows")).write
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{folder}/data/{part}")
    number = max([e["number"] for e in _entries(spark, folder)], default=0) + 1
    row = (number, version or part, part, seen.get["rows"], table.schema.json(), partition_by or [])
    spark.createDataFrame([row], _MANIFEST).coalesce(1).write.mode("append").parquet(f"{folder}/manifest")
    return number


def read(spark: SparkSession, folder: str, version: str | None = None) -> DataFrame:
    """The newest table, or the newest of a version."""
    entries = [e for e in _entries(spark, folder) if version is None or e["version"] == version]
    if not entries:
        raise ValueError(f"nothing is committed below {folder}" + ("" if version is None else f" as {version}"))
    schema = StructType.fromJson(json.loads(entries[-1]["schema"]))
    found = spark.read.schema(schema).parquet(f"{folder}/data/{entries[-1]['part']}")
    return found.select(schema.fieldNames())


def history(spark: SparkSession, folder: str) -> DataFrame:
    """number, version, part and rows of every committed write."""
    _entries(spark, folder)
    return _manifest(spark, folder).drop("schema", "partitions")


def unlisted(spark: SparkSession, folder: str, keep: int = 1) -> list[str]:
    """Data folders that none of the ``keep`` newest writes names: leftovers of dead writes and old versions."""
    listed = {e["part"] for e in _entries(spark, folder)[-keep:]}
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/data")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in files.listStatus(path)] if files.exists(path) else []
    return sorted(set(names) - listed)


def vacuum(spark: SparkSession, folder: str, keep: int = 1) -> list[str]:
    """Deletes what ``unlisted`` names; not while another write is under way."""
    gone = unlisted(spark, folder, keep)
    for name in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/data/{name}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return gone
