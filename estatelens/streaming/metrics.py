"""Late rows: what streams drop behind their watermark, kept as a table."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = ("stream string, run string, batch bigint, operator int, input_rows bigint, dropped_rows bigint, "
          "state_rows bigint, watermark string")


class LateRows(StreamingQueryListener):
    """Writes one row per batch and stateful operator to a table, a file per batch.

    A batch's rows replace those of an earlier report of the same run, so a repeated report counts once. Register it
    with ``spark.streams.addListener``; ``late_rows`` reads the table.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.ended = threading.Condition()
        self.finished: set[str] = set()

    def onQueryStarted(self, event) -> None:
        """Nothing to note before the first batch."""

    def onQueryProgress(self, event) -> None:
        p = event.progress
        rows = [
            (p.name or str(p.id), str(p.runId), p.batchId, i, p.numInputRows, op.numRowsDroppedByWatermark, op.numRowsTotal,
             p.eventTime.get("watermark"))
            for i, op in enumerate(p.stateOperators)
        ]
        if rows:
            path = f"{self.folder}/run={p.runId}/batch={p.batchId}"
            self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)

    def onQueryTerminated(self, event) -> None:
        with self.ended:
            self.finished.add(str(event.runId))
            self.ended.notify_all()

    def wait_for(self, run: str, seconds: float = 60.0) -> bool:
        """Until the reports of a run are written; they come a little after the run itself."""
        with self.ended:
            return self.ended.wait_for(lambda: run in self.finished, seconds)


def late_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Per stream: batches, rows read (by its largest count per batch), rows dropped by the watermark."""
    reports = spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(folder)
    per_batch = reports.groupBy("stream", "run", "batch").agg(
        F.max("input_rows").alias("input_rows"), F.sum("dropped_rows").alias("dropped_rows"))
    return per_batch.groupBy("stream").agg(
        F.count("*").alias("batches"), F.sum("input_rows").alias("input_rows"), F.sum("dropped_rows").alias("dropped_rows"))
