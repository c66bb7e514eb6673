"""Compares registered queries with their SQL twins.

    python -m queryset.check [folder] [query ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

from estatelens.session import local_session

from .oracles import ORACLES
from .queries import QUERIES


def sql_engine(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if value is None or value != value:
        return None
    if isinstance(value, float):
        return round(value, 6)
    return str(value) if not isinstance(value, (int, bool, str)) else value


def rows_of(table) -> list:
    names = sorted(table.column_names)
    return sorted(
        (tuple(_cell(r[n]) for n in names) for r in table.to_pylist()), key=lambda r: [(v is None, str(v)) for v in r]
    )


def compare(spark, con, folder: str, name: str) -> str:
    """'' when equal, else what differs first."""
    got = QUERIES[name](spark, folder).toArrow()
    want = con.sql(ORACLES[name]).to_arrow_table()
    if sorted(got.column_names) != sorted(want.column_names):
        return f"columns {sorted(set(got.column_names) ^ set(want.column_names))}"
    for n in got.column_names:
        a, b = str(got.schema.field(n).type), str(want.schema.field(n).type)
        if a.replace("large_", "") != b.replace("large_", "") and not (a.startswith("timestamp") and b.startswith("timestamp")):
            return f"type of {n}: {a} / {b}"
    left, right = rows_of(got), rows_of(want)
    if left == right:
        return ""
    extra = [r for r in left if r not in set(right)][:2]
    missing = [r for r in right if r not in set(left)][:2]
    return f"{len(left)} / {len(right)} rows\n   got  {extra}\n   want {missing}\n   {sorted(got.column_names)}"


def main(argv: list[str]) -> int:
    folder = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(QUERIES)
    spark, con = local_session(), sql_engine(folder)
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name in names:
        start = time.time()
        try:
            if name in ORACLES:
                verdict = compare(spark, con, folder, name)
            else:
                verdict = f"rows only: {QUERIES[name](spark, folder).count()}"
        except Exception as error:  # noqa: BLE001 - reported per query
            verdict = f"ERROR {str(error)[:700]}"
        failed = bool(verdict) and not verdict.startswith("rows only")
        bad += failed
        print(f"{'BAD' if failed else 'ok ':4s}{name:30s}{time.time() - start:7.2f}s {verdict}", flush=True)
    print(f"{bad} differ of {len(names)}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
