"""Sinks: result tables, logs and replay-safe histories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def write_results(tables: dict[str, DataFrame], path: str, by_day: tuple = ("history", "panel")) -> None:
    """Each table as Parquet; panels partitioned by day."""
    for name, df in tables.items():
        out = df.write.mode("overwrite")
        (out.partitionBy("day") if name in by_day and "day" in df.columns else out).parquet(f"{path}/{name}")


def write_logs(transitions: DataFrame, path: str) -> None:
    """JSON lines of transitions and a summary per day, partitioned by day."""
    transitions.write.mode("overwrite").partitionBy("day").json(f"{path}/transitions")
    daily = transitions.groupBy("day", "from_state", "to_state").agg(F.count(F.lit(1)).alias("n"))
    daily.write.mode("overwrite").partitionBy("day").json(f"{path}/daily")


def latest_snapshot(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of largest ``order`` per key."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return best.select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def merge_history(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both, one per key; a new row replaces an old one."""
    both = old.withColumn("_n", F.lit(0)).unionByName(new.withColumn("_n", F.lit(1)))
    first = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("_n")))
    return both.withColumn("_f", first).where("_f = 1").drop("_n", "_f")
