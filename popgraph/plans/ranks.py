"""Ranks over whole tables without a single task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from popgraph.plans.stage import stage


def dealt_in_ranges(df: DataFrame, order: list) -> DataFrame:
    """``df`` as a written table with ``_range``, the number of the range of ``order`` that a row is in.

    Ranges are about equal in rows, whatever the values. They are written, since they are
    drawn anew whenever they are computed.
    """
    return stage(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranks")


def global_rank(df: DataFrame, order: list, out: str) -> DataFrame:
    """``df`` with ``out``: place from 0 in the order of columns ``order``.

    Rows are dealt to ranges and ranked inside them; the rows of earlier ranges are
    counted in a table with one row per range.
    """
    dealt = dealt_in_ranges(df, order)
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = F.coalesce(F.sum("_size").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = dealt.join(F.broadcast(sizes.select("_range", before.alias("_before"))), "_range")  # one row per range
    place = F.row_number().over(W.partitionBy("_range").orderBy(*order)) - 1 + F.col("_before")
    return ranked.withColumn(out, place).drop("_range", "_before")


def rank_in_groups(df: DataFrame, keys: list[str], id_col: str, out: str, size: str) -> DataFrame:
    """``df`` with ``out``, place from 0 in the order of ``id_col`` within ``keys``, and ``size`` of the group.

    The rows are dealt to ranges of (keys, id), so a group with a third of them is spread
    over as many ranges as its rows need, and a window over the ranges of a group has at
    most one row for each of them. Rows with a null key are left out.
    """
    ranged = dealt_in_ranges(df.dropna(subset=keys), [*keys, id_col])
    sizes = ranged.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_size"))
    of = W.partitionBy(*keys)
    before = F.coalesce(F.sum("_size").over(of.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*keys, "_range", before.alias("_before"), F.sum("_size").over(of).alias(size))
    place = F.row_number().over(W.partitionBy(*keys, "_range").orderBy(id_col)) - 1 + F.col("_before")
    return ranged.join(sizes, [*keys, "_range"]).withColumn(out, place).drop("_range", "_before")


def exact_percentiles(df: DataFrame, col: str, points: list[float]) -> DataFrame:
    """One row with ``p0``, ``p1``, ...: interpolated percentiles of ``col`` (nulls left out), without holding the values in one task."""
    ranked = global_rank(df.where(F.col(col).isNotNull()).select(F.col(col).cast("double").alias("_x")), ["_x"], "_at")
    n = ranked.agg((F.count(F.lit(1)) - 1).alias("_n"))
    at = lambda p: F.col("_n") * F.lit(p)
    wanted = F.array(*[f(at(p)) for p in points for f in (F.floor, F.ceil)])
    few = ranked.crossJoin(F.broadcast(n)).where(F.array_contains(wanted, F.col("_at").cast("long")))  # two rows a point at most
    value = lambda place: F.max(F.when(F.col("_at") == place, F.col("_x")))
    part = lambda p: at(p) - F.floor(at(p))
    return few.groupBy("_n").agg(*[c for i, p in enumerate(points) for c in (value(F.floor(at(p))).alias(f"_a{i}"), value(F.ceil(at(p))).alias(f"_b{i}"))]).select(
        *[(F.col(f"_a{i}") + part(p) * (F.col(f"_b{i}") - F.col(f"_a{i}"))).alias(f"p{i}") for i, p in enumerate(points)]
    )
