"""Lineage cuts in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the cluster names it; a local folder only where it is unset, as in tests."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            found = held.get()
        elif not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        else:
            found = "file://" + tempfile.mkdtemp(prefix="siftwork-")
            spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: With it Spark deletes the shuffle files of an execution when that ends, instead of when the driver's garbage happens to be collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def without_leftovers(spark: SparkSession):
    """Executions within leave no shuffle files behind."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def cut(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back: what follows survives the loss of any executor and never runs
    df's plan again. The shuffle files of the execution go with its end."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut/{name}-{uuid.uuid4().hex}"
    with without_leftovers(spark):
        df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one, for tables that belong together."""
    return f"{shared_dir(spark)}/cut/{name}-{uuid.uuid4().hex}"


def finished_or_written(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at the path if an earlier run finished it, else make()'s rows, written there. What a write that broke off left is replaced."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    if not target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(target):
        with without_leftovers(spark):
            make().write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def drop(*tables: DataFrame | None) -> None:
    """Delete tables that cut() wrote, once nothing reads them any more; what cut() didn't write is left alone."""
    for df in tables:
        path = vars(df).get("_written_to") if df is not None else None
        if path:
            jvm = df.sparkSession._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(target, True)
