"""A history table kept by a stream: versions that readers see whole or not at all.

Data files of a version are written to a folder of their own. A version is a small file
under ``_versions`` that names, for every partition value, the folder that holds it, and
says which batch of which stream it has taken in. It comes to be by one creation that
fails if it is there already; what was written for a version that never came to be is
never read. A batch that is replayed is known by its number and changes nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from popgraph.plans.stage import stage
from popgraph.sources.sinks import merge_history


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _version(spark: SparkSession, path: str) -> tuple[int, dict]:
    """Number and content of the latest version; 0 and an empty one of a table that has none."""
    files, where = _files(spark, f"{path}/_versions")
    if not files.exists(where):
        return 0, {"parts": {}, "batches": {}}
    numbers = [int(f.getPath().getName()) for f in files.listStatus(where)]
    if not numbers:
        return 0, {"parts": {}, "batches": {}}
    told = spark.read.text(f"{path}/_versions/{max(numbers):012d}", wholetext=True).first()
    return max(numbers), json.loads(told[0])


def _commit(spark: SparkSession, path: str, number: int, content: dict) -> None:
    """Makes version ``number``, unless another writer has."""
    files, where = _files(spark, f"{path}/_versions/{number:012d}")
    draft_files, draft = _files(spark, f"{path}/_drafts/{uuid.uuid4().hex}")
    out = draft_files.create(draft, False)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    files.mkdirs(where.getParent())
    if files.exists(where) or not files.rename(draft, where):
        raise RuntimeError(f"version {number} of {path} was made by another writer")


def read_history(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table as of its latest version."""
    _, now = _version(spark, path)
    folders = sorted(set(now["parts"].values()))
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/{f}" for f in folders])


def merge_batch(batch: DataFrame, path: str, keys: list[str], by: str, stream: str, number: int) -> None:
    """Takes batch ``number`` of ``stream`` into the history; a batch that it has, or an earlier one, changes nothing."""
    spark = batch.sparkSession
    new = stage(batch, "history-batch")  # even if it is known: operators with state have to see every batch
    version, now = _version(spark, path)
    if now["batches"].get(stream, -1) >= number:
        return
    parts = {str(r[0]): r[0] for r in new.select(by).distinct().collect()}  # the days of one batch
    if not parts:
        return
    held = sorted({now["parts"][p] for p in parts if p in now["parts"]})
    if held:
        old = spark.read.schema(batch.schema).parquet(*[f"{path}/{f}" for f in held])
        new = merge_history(old, new, keys)
    folder = f"data/{version + 1:012d}-{uuid.uuid4().hex}"
    # one folder for each part, so that a later version replaces one without the others
    new.withColumn("_part", F.coalesce(F.col(by).cast("string"), F.lit("None"))).write.partitionBy("_part").parquet(f"{path}/{folder}")
    told = {p: f"{folder}/_part={p}" for p in parts}
    _commit(spark, path, version + 1, {"parts": now["parts"] | told, "batches": now["batches"] | {stream: number}})


def start_history_sink(stream: DataFrame, path: str, checkpoint: str, keys: list[str], by: str = "day") -> StreamingQuery:
    """Keeps the latest row per key under ``path``, in parts by ``by``, which ``keys`` hold; read it with ``read_history``.

    A batch rewrites the parts that it touches, and nothing is seen of it until all are
    written. If it fails at any point, the history stays as it was and the batch runs again.
    """
    spark = stream.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        told = json.loads(spark.read.text(f"{checkpoint}/metadata", wholetext=True).first()[0])  # the lasting id of the stream
        merge_batch(batch, path, keys, by, told["id"], number)

    return stream.writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def vacuum(spark: SparkSession, path: str) -> int:
    """Deletes data folders that the latest version doesn't name, for times without writers and readers of older ones; returns their number."""
    _, now = _version(spark, path)
    used = {f.split("/")[1] for f in now["parts"].values()}
    files, where = _files(spark, f"{path}/data")
    gone = [f.getPath() for f in files.listStatus(where) if f.getPath().getName() not in used] if files.exists(where) else []
    for p in gone:
        files.delete(p, True)
    return len(gone)
