"""Shared helpers: tables, the shared folder, let-bindings, byte blocks."""

from __future__ import annotations

import gc
import sys
import tempfile
import uuid
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"\x20\x09-\x0D"  # white space of the word contracts, inside a regex class
NOT_ALNUM = r"\x00-\x2F\x3A-\x60\x7B-\x7F"  # ASCII that is no word character once A-Z are lower-cased
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ship(module: str) -> None:
    """Sends the functions of a module to the workers with the tasks, so that no worker needs the package installed."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship(__name__)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; only a local master may do without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"
    for held in _NOTED:
        held.append(path)
    return path


_NOTED: list[list[str]] = []


@contextmanager
def noted_tables():
    """The paths of the intermediate tables that are begun inside, as a list."""
    held: list[str] = []
    _NOTED.append(held)
    try:
        yield held
    finally:
        _NOTED.remove(held)


def drop_tables(spark: SparkSession, paths: list[str], needed: DataFrame) -> list[str]:
    """Deletes intermediate tables, but those that `needed` reads; returns what stays."""
    files = needed.inputFiles()
    stay = [p for p in paths if any(p.rsplit("/", 1)[-1] in f for f in files)]
    for p in paths:
        if p not in stay:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return stay


def stored(df: DataFrame) -> DataFrame:
    """The rows as a written table in the shared folder: lineage ends here, and lost executors cost nothing."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let_go(spark: SparkSession) -> None:
    """Executors drop the shuffle files of finished steps now, not when the driver happens to collect garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def own_columns(docs: DataFrame, *without: str) -> tuple[Column, list[Column]]:
    """The columns of docs but some, as one struct `own` that nothing can clash with, and those columns out of it."""
    names = [c for c in docs.columns if c not in without]
    held = [F.col("`" + c.replace("`", "``") + "`").alias(f"c{i}") for i, c in enumerate(names)]
    own = F.struct(*held) if held else F.struct(F.lit(None).cast("int").alias("none"))
    return own.alias("own"), [F.col(f"own.c{i}").alias(c) for i, c in enumerate(names)]


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def partitions_for(spark: SparkSession) -> int:
    """Shuffle width of the session; operators scale with it."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
