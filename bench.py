"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is run once to warm up and then timed; the result goes to the noop
sink, so every row is computed and none is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from estatelens.session import local_session
from queryset.queries import QUERIES

HEADLINE = [
    "calls_all", "kinds_summary", "activity_calls", "expr_route_by_type", "counts_by_risk_per_workspace",
    "connector_groups", "skip_reason", "tenant_rollup", "validation_status", "run_count", "baseline_reset",
    "resolved_by_connector", "reach", "workspace_progress", "connector_mix", "duration_percentiles", "redact_secrets",
]


def timed(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        timed(spark, name, folder)
        seconds[name] = round(statistics.median(timed(spark, name, folder) for _ in range(runs)), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    texts = spark.read.parquet(f"{folder}/part.parquet").count()
    documents = spark.read.parquet(f"{folder}/documents.parquet").count()
    rates = {"expressions_per_sec": round(texts / seconds["calls_all"]),
             "redacted_documents_per_sec": round(documents / seconds["redact_secrets"])}
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "rates": rates, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
