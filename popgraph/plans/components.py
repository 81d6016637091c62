"""Connected components by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popgraph.plans.stage import release, stage


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 100) -> DataFrame:
    """(node, component) for every node that has an edge to another node.

    ``component`` is the smallest node reachable. Self-loops, repeated edges and
    edges with a null end are ignored; nodes without edges are absent. Each round
    writes its minima as a table, so a hub is an ordinary skewed join that adaptive
    execution can split, and no round keeps lineage.
    """
    e = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
    e = e.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).distinct()
    e = stage(e, "cc-edges")
    for _ in range(max_rounds):
        parent = stage(e.groupBy("u").agg(F.min("v").alias("m")), "cc-parent")
        up = parent.select(F.col("u").alias("x"), F.col("m").alias("mx"))
        large = e.join(up, F.col("v") == F.col("x"), "left").select("u", F.coalesce("mx", "v").alias("v")).distinct()
        large = stage(large, "cc-large")
        release(e, parent)
        parent = stage(large.groupBy("u").agg(F.min("v").alias("m")), "cc-parent")
        roots = parent.select(F.col("u").alias("x"))
        if large.count() == parent.count() and large.join(roots, F.col("v") == F.col("x"), "left_semi").isEmpty():
            leaves = parent.select(F.col("u").alias("node"), F.col("m").alias("component"))
            own = parent.select(F.col("m").alias("node"), F.col("m").alias("component")).distinct()
            found = stage(leaves.unionByName(own), "cc")
            release(large, parent)
            return found
        down = large.join(parent, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stage(down.union(parent.select("u", F.col("m").alias("v"))).distinct(), "cc-edges")
        release(large, parent)
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
