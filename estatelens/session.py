"""Session defaults and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Call-site capture per column expression takes longer than planning itself.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cores: str = "8", **settings: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster use its own session."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("estatelens")
    options = {
        **SETTINGS,
        "spark.sql.shuffle.partitions": cores,
        # One partition per core already: merging them would idle cores.
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.driver.memory": "12g",
        **settings,
    }
    for key, value in options.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_folder(spark: SparkSession) -> str:
    """A new folder below the shared one the cluster names in spark.checkpoint.dir.

    Only a local master may go without that setting (tests, local runs): it gets a
    folder of its own. On a cluster a missing setting is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="estatelens-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"
