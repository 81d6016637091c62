"""Cluster quality, profiles and embeddings without all-pairs work."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popgraph.operators.retrieval import cosine, top_per_group
from popgraph.functions.draws import uniform
from popgraph.operators.ward import ward_labels
from popgraph.plans.stage import counted_broadcast, stage


def long_vectors(df: DataFrame, id_col: str, vec: str, *keep: str) -> DataFrame:
    return df.select(id_col, *keep, F.posexplode(vec).alias("pos", "x")).withColumn("x", F.col("x").cast("double"))


def centroids(df: DataFrame, label: str, vec: str, id_col: str) -> DataFrame:
    """(label, pos, c): mean of each dimension per cluster."""
    return long_vectors(df, id_col, vec, label).groupBy(label, "pos").agg(F.avg("x").alias("c"))


def centroid_arrays(df: DataFrame, label: str, vec: str, id_col: str) -> DataFrame:
    c = centroids(df, label, vec, id_col)
    return c.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "c"))), lambda p: p["c"]).alias("centroid"))


def block_stats(df: DataFrame, label: str, vec: str, id_col: str) -> DataFrame:
    """(label, block_mean, block_std) over all entries of a cluster's vectors."""
    return long_vectors(df, id_col, vec, label).groupBy(label).agg(F.round(F.avg("x"), 6).alias("block_mean"), F.round(F.stddev_pop("x"), 6).alias("block_std"))


def distance(a, b):
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def centroid_distances(df: DataFrame, label: str, vec: str, id_col: str) -> DataFrame:
    """(a, b, distance) of all pairs of centroids; a table of clusters squared."""
    c = counted_broadcast(centroid_arrays(df, label, vec, id_col), label="centroids")
    a, b = c.select(F.col(label).alias("a"), F.col("centroid").alias("_x")), c.select(F.col(label).alias("b"), F.col("centroid").alias("_y"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(distance("_x", "_y"), 6).alias("distance"))


def intra_distance(df: DataFrame, label: str, vec: str, id_col: str) -> DataFrame:
    j = df.withColumn("_v", F.col(vec).cast("array<double>")).join(centroid_arrays(df, label, vec, id_col), label)
    return j.groupBy(label).agg(F.count(F.lit(1)).alias("size"), F.round(F.avg(distance("_v", "centroid")), 6).alias("mean_distance"))


def representatives(df: DataFrame, label: str, vec: str, id_col: str) -> DataFrame:
    """The row of each cluster nearest its centroid."""
    j = df.withColumn("_v", F.col(vec).cast("array<double>")).join(centroid_arrays(df, label, vec, id_col), label)
    return j.withColumn("_d", F.round(distance("_v", "centroid"), 9)).groupBy(label).agg(F.min_by(id_col, F.struct("_d", id_col)).alias("representative"))


def select_anchors(df: DataFrame, label: str, vec: str, id_col: str) -> DataFrame:
    """The row of each cluster with the highest cosine to its profile."""
    j = df.join(centroid_arrays(df, label, vec, id_col), label).withColumn("_c", F.round(cosine(vec, "centroid"), 9))
    return j.groupBy(label).agg(F.min_by(id_col, F.struct(-F.col("_c"), id_col)).alias("anchor"))


def ch_index(df: DataFrame, label: str, vec: str, id_col: str) -> DataFrame:
    """Calinski-Harabasz from sums per cluster and dimension."""
    v = long_vectors(df, id_col, vec, label)
    by = v.groupBy(label, "pos").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    whole = by.groupBy("pos").agg((F.sum("s") / F.sum("n")).alias("m"))
    t = by.join(F.broadcast(whole), "pos").agg(
        F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("w"), F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col("m"), 2)).alias("b"), F.countDistinct(label).alias("k"),
        F.sum(F.when(F.col("pos") == 0, F.col("n"))).alias("n"),
    )
    score = F.try_divide(F.try_divide(F.col("b"), F.col("k") - 1), F.try_divide(F.col("w"), F.col("n") - F.col("k")))  # null for one cluster or one row each
    return t.select(F.round(score, 6).alias("calinski_harabasz"))


def db_index(df: DataFrame, label: str, vec: str, id_col: str) -> DataFrame:
    """Davies-Bouldin: the mean, over clusters, of the largest ratio of two clusters' mean distances to their centroids and the distance of these."""
    c = centroid_arrays(df, label, vec, id_col)
    j = df.withColumn("_v", F.col(vec).cast("array<double>")).join(c, label)
    s = j.groupBy(label).agg(F.avg(distance("_v", "centroid")).alias("_s"))
    table = counted_broadcast(c.join(s, label), label="clusters")
    a, b = table.select(F.col(label).alias("a"), F.col("centroid").alias("_x"), F.col("_s").alias("_sa")), table.select(F.col(label).alias("b"), F.col("centroid").alias("_y"), F.col("_s").alias("_sb"))
    worst = a.join(b, F.col("a") != F.col("b")).groupBy("a").agg(F.max(F.try_divide(F.col("_sa") + F.col("_sb"), distance("_x", "_y"))).alias("_r"))
    return worst.agg(F.round(F.avg("_r"), 6).alias("davies_bouldin"))


def silhouette(df: DataFrame, label: str, vec: str, id_col: str) -> DataFrame:
    """(id, label, silhouette_sq) with squared Euclidean distances, from cluster sums: linear in rows times clusters."""
    v = df.withColumn("_v", F.col(vec).cast("array<double>"))
    sq = F.aggregate("_v", F.lit(0.0), lambda s, x: s + x * x)
    c = centroid_arrays(df, label, vec, id_col).select(F.col(label).alias("_l"), "centroid")
    q = v.groupBy(F.col(label).alias("_l")).agg(F.count(F.lit(1)).alias("_n"), F.sum(sq).alias("_q"))
    table = c.join(q, "_l")
    j = v.withColumn("_sq", sq).crossJoin(counted_broadcast(table, label="clusters"))
    dot = F.aggregate(F.zip_with("_v", "centroid", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    mean = F.col("_sq") + F.col("_q") / F.col("_n") - 2 * dot
    own = F.col(label) == F.col("_l")
    g = j.groupBy(id_col, label).agg(
        F.max(F.when(own, F.when(F.col("_n") > 1, mean * F.col("_n") / (F.col("_n") - 1)))).alias("a"), F.min(F.when(~own, mean)).alias("b")
    )
    return g.select(id_col, label, F.round(F.coalesce((F.col("b") - F.col("a")) / F.greatest("a", "b"), F.lit(0.0)), 6).alias("silhouette_sq"))


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Weighted modularity of ``labels`` (agent_id, cluster_id)."""
    l1 = labels.select(F.col("agent_id").alias("agent_1"), F.col("cluster_id").alias("c1"))
    l2 = labels.select(F.col("agent_id").alias("agent_2"), F.col("cluster_id").alias("c2"))
    e = edges.join(l1, "agent_1").join(l2, "agent_2")
    inside = e.where("c1 = c2").groupBy(F.col("c1").alias("c")).agg(F.sum("contact_rate").alias("w"))
    ends = e.select(F.explode(F.array("c1", "c2")).alias("c"), "contact_rate").groupBy("c").agg(F.sum("contact_rate").alias("d"))
    m = ends.agg((F.sum("d") / 2).alias("m"))
    q = F.coalesce("w", F.lit(0.0)) / F.col("m") - F.pow(F.col("d") / (2 * F.col("m")), 2)
    return ends.join(inside, "c", "left").crossJoin(F.broadcast(m)).agg(F.round(F.sum(q), 6).alias("modularity"))


def conductance(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges that leave a cluster over its edge ends, unweighted."""
    l1 = labels.select(F.col("agent_id").alias("agent_1"), F.col("cluster_id").alias("c1"))
    l2 = labels.select(F.col("agent_id").alias("agent_2"), F.col("cluster_id").alias("c2"))
    e = edges.join(l1, "agent_1").join(l2, "agent_2")
    ends = e.select(F.explode(F.array(F.struct(F.col("c1").alias("c"), F.col("c2").alias("o")), F.struct(F.col("c2").alias("c"), F.col("c1").alias("o")))).alias("x")).select("x.c", "x.o")
    by = ends.groupBy("c").agg(F.count(F.lit(1)).alias("v"), F.count_if(F.col("c") != F.col("o")).alias("cut"))
    return by.select(F.col("c").alias("cluster_id"), F.round(F.col("cut") / F.col("v"), 6).alias("conductance"))


def cluster_edge_matrix(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b, edges, density): edges between and (twice in density) within clusters; density is relative to the largest entry."""
    l1 = labels.select(F.col("agent_id").alias("agent_1"), F.col("cluster_id").alias("c1"))
    l2 = labels.select(F.col("agent_id").alias("agent_2"), F.col("cluster_id").alias("c2"))
    e = edges.join(l1, "agent_1").join(l2, "agent_2")
    m = e.groupBy(F.least("c1", "c2").alias("a"), F.greatest("c1", "c2").alias("b")).agg(F.count(F.lit(1)).alias("edges"))
    entry = F.when(F.col("a") == F.col("b"), 2 * F.col("edges")).otherwise(F.col("edges"))
    return m.crossJoin(F.broadcast(m.agg(F.max(entry).alias("_m")))).select("a", "b", "edges", F.round(entry / F.col("_m"), 6).alias("density"))


def edge_density(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(cluster_id, intra, inter): edges within a cluster over its pairs, and edges that leave it over the pairs with others."""
    l1 = labels.select(F.col("agent_id").alias("agent_1"), F.col("cluster_id").alias("c1"))
    l2 = labels.select(F.col("agent_id").alias("agent_2"), F.col("cluster_id").alias("c2"))
    e = edges.join(l1, "agent_1").join(l2, "agent_2")
    ends = e.select(F.explode(F.array_distinct(F.array("c1", "c2"))).alias("cluster_id"), (F.col("c1") == F.col("c2")).alias("_in"))
    by = ends.groupBy("cluster_id").agg(F.count_if("_in").alias("_intra"), F.count_if(~F.col("_in")).alias("_inter"))
    n = labels.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("_n"))
    j = n.join(by, "cluster_id", "left").na.fill(0, ["_intra", "_inter"]).crossJoin(F.broadcast(n.agg(F.sum("_n").alias("_all"))))
    rate = lambda x, pairs: F.round(F.coalesce(F.try_divide(x, pairs), F.lit(0.0)), 9)
    return j.select("cluster_id", rate(F.col("_intra"), F.col("_n") * (F.col("_n") - 1) / 2).alias("intra"), rate(F.col("_inter"), F.col("_n") * (F.col("_all") - F.col("_n"))).alias("inter"))


def cluster_balance(labels: DataFrame) -> DataFrame:
    by = labels.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    total = by.agg(F.sum("n").alias("t"))
    p = F.col("n") / F.col("t")
    return by.crossJoin(F.broadcast(total)).agg(F.count(F.lit(1)).alias("clusters"), F.min("n").alias("smallest"), F.max("n").alias("largest"), F.round(F.min("n") / F.max("n"), 6).alias("balance"), F.round(-F.sum(p * F.log(p)), 6).alias("entropy"))


def ari(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labelings of the same rows."""
    c = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    two = lambda x: x * (x - 1) / 2
    s = c.agg(F.sum(two(F.col("n"))).alias("i"), F.sum("n").alias("n"))
    r = c.groupBy("a").agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("r"))
    k = c.groupBy("b").agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("k"))
    e = F.col("r") * F.col("k") / two(F.col("n"))
    return s.crossJoin(r).crossJoin(k).select(F.round((F.col("i") - e) / ((F.col("r") + F.col("k")) / 2 - e), 6).alias("ari"))


def feature_variance(df: DataFrame, id_col: str, vec: str) -> DataFrame:
    return long_vectors(df, id_col, vec).groupBy("pos").agg(F.round(F.avg("x"), 6).alias("mean"), F.round(F.var_pop("x"), 6).alias("variance"))


def top_features_per_group(df: DataFrame, label: str, vec: str, id_col: str, k: int) -> DataFrame:
    """The ``k`` dimensions of largest absolute mean per cluster."""
    c = centroids(df, label, vec, id_col).withColumn("c", F.round("c", 6))
    return top_per_group(c, [label], [F.desc(F.abs("c")), "pos"], k)


def embedding_stats(df: DataFrame, vec: str, id_col: str) -> DataFrame:
    """Mean norm and mean pairwise cosine, from the sum of unit vectors: linear, not quadratic."""
    v = df.withColumn("_n", F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))).where("_n > 0")
    s = v.select(F.posexplode(vec).alias("pos", "x"), "_n").groupBy("pos").agg(F.sum(F.col("x").cast("double") / F.col("_n")).alias("s"))
    total = s.agg(F.sum(F.col("s") * F.col("s")).alias("q"))
    n = v.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("_n"), 6).alias("mean_norm"), F.round(F.stddev_pop("_n"), 6).alias("std_norm"))
    return n.crossJoin(total).select("n", "mean_norm", "std_norm", F.round((F.col("q") - F.col("n")) / (F.col("n") * (F.col("n") - 1)), 6).alias("mean_cosine"))


def _spread(df: DataFrame, id_col: str, k: int) -> DataFrame:
    """``df`` dealt to tasks by rows times centres, in the order of ids.

    A round of k-means is as parallel as its table, and a table that few tasks wrote has
    few parts. What one task does in a moment stays as it is.
    """
    parts = math.ceil(df.count() * max(k, 64) / 2**22)
    return df if parts < 2 else df.repartition(parts, id_col).sortWithinPartitions(id_col)


def coarse_cluster(df: DataFrame, vec: str, id_col: str, k: int, seed: int = 7, bisecting: bool = False) -> DataFrame:
    """(id, cluster_id) by k-means on standardized vectors."""
    from pyspark.ml.clustering import BisectingKMeans, KMeans
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import array_to_vector

    v = df.select(id_col, array_to_vector(F.col(vec).cast("array<double>")).alias("_raw"))
    v = StandardScaler(inputCol="_raw", outputCol="features", withMean=True).fit(v).transform(v)
    model = (BisectingKMeans if bisecting else KMeans)(k=k, seed=seed).fit(_spread(v, id_col, k))
    return model.transform(v).select(id_col, F.col("prediction").alias("cluster_id"))


def with_balance(labels: DataFrame) -> DataFrame:
    """``labels`` with ``balance``: the smallest over the largest cluster size, the same in every row."""
    n = labels.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("_n"))
    return labels.crossJoin(F.broadcast(n.agg(F.round(F.min("_n") / F.max("_n"), 6).alias("balance"))))


#: Micro-clusters that are linked at most; their linkage is one task's work.
MICRO = 1024


def _labels(df: DataFrame, vec: str, id_col: str, k: int, seed: int) -> DataFrame:
    """(id, cluster_id) by k-means on the vectors as they are."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = df.select(id_col, array_to_vector(F.col(vec).cast("array<double>")).alias("features"))
    return KMeans(k=k, seed=seed).fit(_spread(v, id_col, k)).transform(v).select(id_col, F.col("prediction").alias("cluster_id"))


def ward_cluster(df: DataFrame, vec: str, id_col: str, k: int, seed: int = 42, micro: int = MICRO) -> DataFrame:
    """(id, cluster_id) by Ward linkage, labels dense from 0.

    Up to ``micro`` rows each row is a point of its own, in the order of ids, and the
    result is that of the plain method. A larger table is first put into ``micro`` groups
    by k-means; their centres, weighed by size, are linked, and a row has the label of its
    group. Null vectors and an empty table give no rows.
    """
    rows = df.where(F.col(vec).isNotNull()).select(id_col, F.col(vec).cast("array<double>").alias("_v"))
    if rows.count() <= micro:
        groups = rows.select(id_col, F.col(id_col).alias("_g"))
    else:
        groups = _labels(rows, "_v", id_col, micro, seed).withColumnRenamed("cluster_id", "_g")
    groups = stage(groups, "ward-groups")
    member = rows.join(groups, id_col)
    size = member.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    points = stage(centroid_arrays(member, "_g", "_v", id_col).join(size, "_g"), "ward-points")  # ``micro`` rows at most

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.concat(list(batches))
        if len(held):
            held = held.sort_values("_g")
            held["cluster_id"] = ward_labels(np.stack(held["centroid"].to_numpy()), held["_n"].to_numpy(), k)
        yield held[["_g", "cluster_id"]] if len(held) else pd.DataFrame({"_g": [], "cluster_id": []})

    kind = groups.schema["_g"].dataType.simpleString()
    linked = points.coalesce(1).mapInPandas(link, f"_g {kind}, cluster_id int") if points.take(1) else groups.select("_g", F.lit(0).alias("cluster_id"))
    return groups.join(F.broadcast(stage(linked, "ward-labels")), "_g").select(id_col, "cluster_id")


def fine_cluster(df: DataFrame, vec: str, id_col: str, k: int, least_balance: float = 0.2, seed: int = 42, micro: int = MICRO) -> DataFrame:
    """(id, cluster_id) by Ward linkage; by k-means where cluster sizes are too far apart, and by Ward linkage into three where fewer than two come out."""
    sizes = lambda labels: [r[0] for r in labels.groupBy("cluster_id").count().select("count").collect()]  # noqa: E731  at most k rows
    labels = stage(ward_cluster(df, vec, id_col, k, seed, micro), "fine")
    n = sizes(labels)
    if n and min(n) / max(n) < least_balance:
        labels = stage(_labels(df.where(F.col(vec).isNotNull()), vec, id_col, k, seed), "fine")
        n = sizes(labels)
    if len(n) == 1:
        labels = stage(ward_cluster(df, vec, id_col, 3, seed, micro), "fine")
    return labels


def power_iteration(df: DataFrame, links: DataFrame, vec: str, id_col: str, k: int, rounds: int = 20) -> DataFrame:
    """(id, cluster_id) by power iteration over ``links`` (src, dst), each weighed by exp(-distance) of its ends.

    Either direction of a link counts once, loops do not; entities without links get no
    label. The start is random: from the degrees, groups of like structure end at one
    value and can't be told apart. It is seeded by partition, so labels may change with
    the partitioning.
    """
    from pyspark.ml.clustering import PowerIterationClustering

    pairs = links.select(F.least("src", "dst").cast("long").alias("src"), F.greatest("src", "dst").cast("long").alias("dst")).where("src <> dst")
    for name in ("src", "dst"):  # links of others are left out before they are told apart
        pairs = pairs.join(df.select(F.col(id_col).cast("long").alias(name)), name, "left_semi")
    pairs = pairs.distinct()
    end = lambda name, v: df.select(F.col(id_col).cast("long").alias(name), F.col(vec).cast("array<double>").alias(v))
    w = pairs.join(end("src", "_a"), "src").join(end("dst", "_b"), "dst").select("src", "dst", F.exp(-distance("_a", "_b")).alias("weight"))
    w = stage(w, "power-iteration")
    if w.isEmpty():
        return df.select(id_col, F.lit(0).alias("cluster_id")).limit(0)
    w = w.repartition(math.ceil(w.count() / 2**15), "src")  # the rounds are as parallel as this table
    model = PowerIterationClustering(k=k, maxIter=rounds, initMode="random", srcCol="src", dstCol="dst", weightCol="weight")
    return model.assignClusters(w).select(F.col("id").alias(id_col), F.col("cluster").alias("cluster_id"))


def compare_clusterings(df: DataFrame, vec: str, id_col: str, k: int, links: DataFrame | None = None) -> DataFrame:
    """(method, clusters, silhouette, calinski_harabasz) of k-means, bisecting k-means, random labels and, with ``links``, power iteration."""
    labels = {
        "kmeans": coarse_cluster(df, vec, id_col, k), "bisecting": coarse_cluster(df, vec, id_col, k, bisecting=True),
        "random": df.select(id_col, F.floor(uniform(F.col(id_col), "labels") * k).cast("int").alias("cluster_id")),
    }
    if links is not None:
        labels["power_iteration"] = power_iteration(df, links, vec, id_col, k)
    out = None
    for method, told in labels.items():
        x = df.select(id_col, vec).join(told, id_col)
        scores = silhouette(x, "cluster_id", vec, id_col).agg(F.avg("silhouette_sq").alias("silhouette"), F.countDistinct("cluster_id").alias("clusters"))
        row = scores.crossJoin(ch_index(x, "cluster_id", vec, id_col)).select(F.lit(method).alias("method"), "clusters", "silhouette", "calinski_harabasz")
        out = row if out is None else out.unionByName(row)
    return out
