"""Intermediate tables that survive the loss of an executor.

A staged table is written once to the folder that the cluster names in
``spark.checkpoint.dir`` and read back, which cuts lineage, lets adaptive
execution see exact sizes and never depends on a local disk.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Temporary folders of applications with a local master, which may lack the setting.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder in ``spark.checkpoint.dir``; a temporary one only where that is unset and the master is local (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        named = _OWN.get(app) or "file://" + tempfile.mkdtemp(prefix="popgraph-")
        _OWN[app] = named
    return named.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def passing(spark: SparkSession, path: str) -> str:
    """``path``, which exists, to be deleted when the driver ends: tables read from it may be used until then."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back; it lasts as long as the driver, unless it is released."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    passing(df.sparkSession, path)
    held = df.sparkSession.read.schema(df.schema).parquet(path)
    held._stage_path = path
    return held


def release(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing will read again: loops keep only the tables of their last round."""
    for t in tables:
        where = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._stage_path)
        where.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def counted_broadcast(df: DataFrame, max_rows: int = 100_000, label: str = "small") -> DataFrame:
    """``df`` written as a table, marked for broadcast only if it has at most ``max_rows`` rows."""
    table = stage(df, label)
    return F.broadcast(table) if small_enough(table, max_rows) else table


def small_enough(df: DataFrame, max_rows: int) -> bool:
    """True if a staged table has at most ``max_rows`` rows (its footers are counted)."""
    return df.count() <= max_rows
