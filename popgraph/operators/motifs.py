"""Motif profiles and their quality, anchors, boundaries and fused embeddings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from popgraph.functions.draws import uniform
from popgraph.operators.clusters import centroid_arrays, distance, long_vectors
from popgraph.operators.retrieval import cosine, top_per_group
from popgraph.plans.ranks import exact_percentiles, global_rank
from popgraph.plans.stage import counted_broadcast, release, stage


def pattern_profile(df: DataFrame, key: str, label: str) -> DataFrame:
    """(key, label, share): how often an entity shows each pattern, shares of one entity add to 1."""
    c = df.groupBy(key, label).agg(F.count(F.lit(1)).alias("_c"))
    return c.join(c.groupBy(key).agg(F.sum("_c").alias("_t")), key).select(key, label, (F.col("_c") / F.col("_t")).alias("share"))


def motif_catalogue(profile: DataFrame, key: str, label: str) -> DataFrame:
    """(label, size, mean, variance) over all entities; absent shares count as zero."""
    n = F.broadcast(profile.agg(F.countDistinct(key).alias("_n")))
    s = profile.groupBy(label).agg(F.count(F.lit(1)).alias("size"), F.sum("share").alias("_s"), F.sum(F.col("share") * F.col("share")).alias("_q")).crossJoin(n)
    mean = F.col("_s") / F.col("_n")
    return s.select(label, "size", F.round(mean, 6).alias("mean"), F.round(F.col("_q") / F.col("_n") - mean * mean, 6).alias("variance"))


def motif_coherence(profile: DataFrame, clusters: DataFrame, key: str, label: str) -> DataFrame:
    """(cluster_id, entropy, coherence) of the mean profile; one motif alone gives coherence 1."""
    j = profile.join(clusters.select(key, "cluster_id"), key)
    part = j.groupBy("cluster_id", label).agg(F.sum("share").alias("_s")).where("_s > 0")
    total = part.groupBy("cluster_id").agg(F.sum("_s").alias("_t"))
    p = part.join(total, "cluster_id").withColumn("_p", F.col("_s") / F.col("_t"))
    e = p.groupBy("cluster_id").agg((-F.sum(F.col("_p") * F.log("_p"))).alias("_e"), F.count(F.lit(1)).alias("_k"))
    return e.select("cluster_id", F.round("_e", 6).alias("entropy"), F.round(F.when(F.col("_k") > 1, 1 - F.col("_e") / F.log("_k")).otherwise(1.0), 6).alias("coherence"))


def motif_frequency(profile: DataFrame, label: str, k: int = 15) -> DataFrame:
    """(label, frequency, rank): the ``k`` motifs of largest summed share, ties by name."""
    f = profile.groupBy(label).agg(F.round(F.sum("share"), 6).alias("frequency"))
    return f.orderBy(F.desc("frequency"), label).limit(k).withColumn("rank", F.row_number().over(W.orderBy(F.desc("frequency"), label)))  # k rows


def top_motifs(profile: DataFrame, clusters: DataFrame, key: str, label: str, k: int = 3) -> DataFrame:
    """(cluster_id, label, share, rank): the ``k`` motifs of largest mean share per cluster; absent shares count as zero."""
    size = clusters.groupBy("cluster_id").agg(F.countDistinct(key).alias("_n"))
    s = profile.join(clusters.select(key, "cluster_id"), key).groupBy("cluster_id", label).agg(F.sum("share").alias("_s")).join(size, "cluster_id")
    return top_per_group(s.select("cluster_id", label, F.round(F.col("_s") / F.col("_n"), 6).alias("share")), ["cluster_id"], [F.desc("share"), label], k)


def motif_cooccurrence(profile: DataFrame, key: str, label: str, least: float = 0.1) -> DataFrame:
    """(a, b, entities): entities in which both motifs have a share above ``least``; the pairs of one entity are bounded by the motifs."""
    sets = profile.where(F.col("share") > least).groupBy(key).agg(F.sort_array(F.collect_set(label)).alias("_m"))
    a = sets.select("_m", F.explode("_m").alias("a"))
    return a.select("a", F.explode("_m").alias("b")).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("entities"))


def top_variance_features(df: DataFrame, id_col: str, vec: str, k: int) -> DataFrame:
    """(pos, variance, rank) of the ``k`` dimensions of highest variance."""
    v = long_vectors(df, id_col, vec).groupBy("pos").agg(F.round(F.var_pop("x"), 9).alias("variance"))
    return top_per_group(v.withColumn("_all", F.lit(1)), ["_all"], [F.desc("variance"), "pos"], k).select("pos", "variance", "rank")  # one row per dimension


def feature_examples(df: DataFrame, id_col: str, vec: str, k: int = 5) -> DataFrame:
    """(pos, id, x, rank): per dimension the ``k`` rows of largest absolute value."""
    x = long_vectors(df, id_col, vec)
    return top_per_group(x.withColumn("_a", F.abs("x")), ["pos"], [F.desc("_a"), id_col], k).select("pos", id_col, "x", "rank")


def _with_centroids(df: DataFrame, label: str, vec: str, id_col: str, own: bool) -> DataFrame:
    c = centroid_arrays(df, label, vec, id_col).withColumnRenamed(label, "_label")
    c = c if own else counted_broadcast(c, label="centroids")
    on = F.col(label) == F.col("_label") if own else F.lit(True)
    return df.select(id_col, label, F.col(vec).cast("array<double>").alias("_v")).join(c, on)


def boundary_entities(df: DataFrame, label: str, vec: str, id_col: str, margin: float = 0.95) -> DataFrame:
    """Rows whose own centroid is farther than ``margin`` times the nearest other one (centroids are few)."""
    d = _with_centroids(df, label, vec, id_col, own=False).withColumn("_d", distance("_v", "centroid"))
    own = F.col(label) == F.col("_label")
    g = d.groupBy(id_col, label).agg(F.min(F.when(own, F.col("_d"))).alias("_own"), F.min(F.when(~own, F.col("_d"))).alias("_other"))
    return g.where(F.col("_own") > margin * F.col("_other")).select(id_col, label)


def anchor_quality(df: DataFrame, anchors: DataFrame, label: str, vec: str, id_col: str) -> DataFrame:
    """(representativeness): inverse mean distance of the anchors to their centroids."""
    rows = _with_centroids(df, label, vec, id_col, own=True)
    j = rows.join(anchors.select(F.col("anchor").alias(id_col)), id_col, "left_semi")
    return j.agg(F.round(1 / (F.avg(distance("_v", "centroid")) + 1e-9), 6).alias("representativeness"))


def anchor_loss(df: DataFrame, anchors: DataFrame, label: str, vec: str, id_col: str, temperature: float = 0.5) -> DataFrame:
    """(loss): mean of log-sum-exp over anchors minus the own anchor's similarity, each over the temperature."""
    a = anchors.join(df.select(F.col(id_col).alias("anchor"), F.col(vec).alias("_a")), "anchor").select(F.col(label).alias("_label"), "_a")
    j = df.select(id_col, label, F.col(vec).alias("_v")).crossJoin(counted_broadcast(a, label="anchors")).withColumn("_s", cosine("_v", "_a") / temperature)
    g = j.groupBy(id_col).agg(F.max("_s").alias("_m"), F.collect_list("_s").alias("_all"), F.max(F.when(F.col(label) == F.col("_label"), F.col("_s"))).alias("_own"))
    total = F.aggregate("_all", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("_m")))
    return g.agg(F.round(F.avg(F.col("_m") + F.log(total) - F.col("_own")), 6).alias("loss"))


def adaptive_threshold(df: DataFrame, id_col: str, vec: str, pairs: int = 4) -> DataFrame:
    """(threshold, median, mad) of cosine distances over ``pairs`` drawn partners of each row (dense ids)."""
    n = F.broadcast(df.agg(F.count(F.lit(1)).alias("_n"), F.min(id_col).alias("_low")))
    r = df.select(F.col(id_col).alias("_i"), F.col(vec).alias("_v"), F.explode(F.sequence(F.lit(1), F.lit(pairs))).alias("_k")).crossJoin(n)
    partner = F.floor(uniform(F.concat_ws("-", "_i", "_k"), "pair") * F.col("_n")) + F.col("_low")
    j = r.withColumn("_j", partner).where("_i <> _j").join(df.select(F.col(id_col).alias("_j"), F.col(vec).alias("_w")), "_j")
    d = j.select((1 - cosine("_v", "_w")).alias("d"))
    d = stage(d, "pair-distances")
    mid = exact_percentiles(d, "d", [0.5, 0.4, 0.8]).toDF("median", "_lo", "_hi")
    off = exact_percentiles(d.crossJoin(F.broadcast(mid)).select(F.abs(F.col("d") - F.col("median")).alias("o")), "o", [0.5]).toDF("mad")
    m = mid.crossJoin(off)  # one row each
    threshold = F.greatest(F.col("_lo"), F.least(F.col("_hi"), F.col("median") + 0.75 * (F.col("mad") + 1e-8)))
    return m.select(F.round(threshold, 6).alias("threshold"), F.round("median", 6).alias("median"), F.round("mad", 6).alias("mad"))


def quality_score(modularity: DataFrame, coherence: DataFrame, silhouette: DataFrame, unknown: float | None = None) -> DataFrame:
    """(score): 0.45 modularity, 0.35 mean coherence and 0.20 mean silhouette; a part that is null counts as ``unknown``."""
    m = modularity.select(F.col("modularity").alias("_m"))
    j = m.crossJoin(coherence.agg(F.avg("coherence").alias("_c"))).crossJoin(silhouette.agg(F.avg(F.col("silhouette_sq")).alias("_s")))
    part = lambda c: F.col(c) if unknown is None else F.coalesce(c, F.lit(unknown))
    return j.select(F.round(0.45 * part("_m") + 0.35 * part("_c") + 0.20 * part("_s"), 5).alias("score"))


def dashboard(modularity: DataFrame, coherence: DataFrame, silhouette: DataFrame, ch: DataFrame, db: DataFrame, balance: DataFrame) -> DataFrame:
    """One row of metrics brought to [0, 1] and their mean quality. The scales of the two indices."""
    j = modularity.select(F.col("modularity").alias("_m")).crossJoin(coherence.agg(F.avg("coherence").alias("_c"))).crossJoin(silhouette.agg(F.avg(F.col("silhouette_sq")).alias("_s")))
    j = j.crossJoin(ch).crossJoin(db).crossJoin(balance)  # one row each
    inverted = F.greatest(F.lit(0.0), 1 - F.col("davies_bouldin") / 3)
    return j.select(
        F.round("_s", 5).alias("silhouette"), F.round(inverted, 5).alias("davies_bouldin"), F.round("_m", 5).alias("modularity"), F.round(F.when(F.col("clusters") > 1, F.col("entropy") / F.log("clusters")), 5).alias("balance"),
        F.round("_c", 5).alias("coherence"), F.round(F.least(F.lit(1.0), F.col("calinski_harabasz") / 1000), 5).alias("calinski_harabasz"), F.round((F.col("_s") + inverted + F.col("_m") + F.col("_c")) / 4, 5).alias("overall"),
    )


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once and not again for each entry of an array."""
    return F.transform(F.array(value), body)[0]


def _norm(x: Column) -> Column:
    return F.greatest(F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, e: s + F.coalesce(e * e, F.lit(0.0)))), F.lit(1e-12))


def fuse_embeddings(df: DataFrame, id_col: str, parts: dict[str, float], width: int) -> DataFrame:
    """(id, fused): parts standardized per dimension, padded to ``width``, normalized, weighed and normalized.

    Weights are divided by their sum; a constant dimension is only centred. A part wider
    than ``width`` raises: nothing is cut off. Vectors stay whole, only the mean and the
    deviation of each dimension come from single entries. Rows that repeat an id are added up.
    """
    total = sum(parts.values())
    rows = df.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(*[F.collect_list(F.col(name).cast("array<double>")).alias(f"_{i}") for i, name in enumerate(parts)])
    zeros = F.array_repeat(F.lit(0.0), width)
    plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + F.coalesce(y, F.lit(0.0)))

    def weighed(vectors: str, scales: str, share: float) -> Column:
        z = F.transform(vectors, lambda v: F.zip_with(v, F.col(scales), lambda x, s: (x - s["m"]) / s["s"]))
        return bound(z, lambda zs: bound(_norm(F.flatten(zs)), lambda n: F.transform(F.aggregate(zs, zeros, plus), lambda e: e / n * share)))

    fused, some = zeros, F.lit(False)
    for i, (name, weight) in enumerate(parts.items()):
        s = long_vectors(df, id_col, name).groupBy("pos").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
        scale = F.struct("pos", "m", F.when(F.col("s") < 1e-9, 1.0).otherwise(F.col("s")).alias("s"))
        rows = rows.crossJoin(F.broadcast(s.agg(F.array_sort(F.collect_list(scale)).alias(f"_s{i}"))))  # one row
        wide = F.exists(f"_{i}", lambda v: F.size(v) > width)
        fused = plus(fused, F.when(~wide, weighed(f"_{i}", f"_s{i}", weight / total)).otherwise(F.raise_error(F.lit(f"{name} is wider than {width}"))))
        some = some | F.exists(f"_{i}", lambda v: F.size(v) > 0)
    unit = bound(fused, lambda f: bound(_norm(f), lambda n: F.transform(f, lambda e: F.round(e / n, 5))))
    return rows.where(some).select(id_col, unit.alias("fused"))


def fusion_contribution(df: DataFrame, id_col: str, parts: dict[str, float]) -> DataFrame:
    """(part, contribution, share): weight times the mean deviation of a part's dimensions."""
    out = None
    for name, weight in parts.items():
        s = long_vectors(df, id_col, name).groupBy("pos").agg(F.stddev_pop("x").alias("_s"))
        row = s.agg((F.avg("_s") * weight).alias("_c")).select(F.lit(name).alias("part"), "_c")
        out = row if out is None else out.unionByName(row)
    total = out.agg(F.sum("_c").alias("_t"))  # one row
    return out.crossJoin(total).select("part", F.round("_c", 6).alias("contribution"), F.round(F.try_divide("_c", "_t"), 6).alias("share"))


def shared_pca(df: DataFrame, id_col: str, vec: str) -> DataFrame:
    """(id, pc1, pc2) on one basis for all rows; the basis comes from a covariance of dimensions squared."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = df.select(id_col, array_to_vector(F.col(vec).cast("array<double>")).alias("_v"))
    p = PCA(k=2, inputCol="_v", outputCol="_p").fit(v).transform(v).select(id_col, vector_to_array("_p").alias("_p"))
    return p.select(id_col, F.col("_p")[0].alias("pc1"), F.col("_p")[1].alias("pc2"))


def prediction_report(df: DataFrame, keys: list[str], p: str, y: str) -> DataFrame:
    """Mean, deviation and range of predictions and targets, share of targets above 0.001."""
    both = [(p, "pred"), (y, "target")]
    stats = [f(c).alias(f"{n}_{name}") for c, n in both for name, f in (("mean", lambda c: F.round(F.avg(c), 6)), ("std", lambda c: F.round(F.stddev_pop(c), 6)), ("min", F.min), ("max", F.max))]
    return df.groupBy(*keys).agg(*stats, F.round(F.avg(F.when(F.col(y) > 0.001, 1.0).otherwise(0.0)), 6).alias("target_nonzero"), F.round(F.var_pop(y), 6).alias("target_variance"))


#: Clusters whose pairs are looked at; more raise, since merging follows one order of all pairs.
MOST_CLUSTERS = 2000


def _few_clusters(table: DataFrame) -> DataFrame:
    """``table``, one row a cluster, written; more than ``MOST_CLUSTERS`` rows raise."""
    held = stage(table, "clusters")
    if (n := held.count()) > MOST_CLUSTERS:
        raise ValueError(f"{n} clusters: pairs of more than {MOST_CLUSTERS} are not compared")
    return held


def cluster_divergence(profile: DataFrame, clusters: DataFrame, key: str, label: str) -> DataFrame:
    """(a, b, divergence): Jensen-Shannon divergence (nats) of the motif shares of every pair of clusters."""
    s = profile.join(clusters.select(key, "cluster_id"), key).groupBy("cluster_id", label).agg(F.sum("share").alias("_s"))
    p = s.join(s.groupBy("cluster_id").agg(F.sum("_s").alias("_t")), "cluster_id").select("cluster_id", F.struct(F.col(label).alias("m"), (F.col("_s") / F.col("_t")).alias("p")).alias("e"))
    m = _few_clusters(p.groupBy("cluster_id").agg(F.map_from_entries(F.collect_list("e")).alias("_m")))
    a, b = m.select(F.col("cluster_id").alias("a"), F.col("_m").alias("_x")), m.select(F.col("cluster_id").alias("b"), F.col("_m").alias("_y"))
    part = lambda own, other: F.aggregate(
        F.map_entries(own), F.lit(0.0), lambda t, e: t + F.when(e["value"] > 0, e["value"] * F.log(2 * e["value"] / (e["value"] + F.coalesce(other[e["key"]], F.lit(0.0))))).otherwise(0.0)
    )
    d = (part(F.col("_x"), F.col("_y")) + part(F.col("_y"), F.col("_x"))) / 2
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(d, 9).alias("divergence"))


def merge_clusters(clusters: DataFrame, divergence: DataFrame, key: str, theta: float) -> DataFrame:
    """(key, cluster_id): clusters closer than ``theta`` joined, closest first, at least two kept, labels dense from 0.

    A pair counts while both its clusters are left; the second goes into the first. The
    pairs of at most ``MOST_CLUSTERS`` clusters reach the driver, entities do not.
    """
    ids = [r[0] for r in _few_clusters(clusters.select("cluster_id").distinct()).orderBy("cluster_id").collect()]
    left, into = set(ids), {}
    for a, b in divergence.where(F.col("divergence") < theta).orderBy("divergence", "a", "b").select("a", "b").collect():
        if len(left) > 2 and a in left and b in left:
            left.remove(b)
            into[b] = a
    dense = {c: i for i, c in enumerate(sorted(left))}

    def last(c):
        while c in into:
            c = into[c]
        return c

    kind = clusters.schema["cluster_id"].dataType.simpleString()
    table = clusters.sparkSession.createDataFrame([(c, dense[last(c)]) for c in ids], f"cluster_id {kind}, _new int")
    return clusters.select(key, "cluster_id").join(F.broadcast(table), "cluster_id").select(key, F.col("_new").alias("cluster_id"))


def split_flags(profile: DataFrame, clusters: DataFrame, key: str, label: str, motifs: int, theta: float, variance: float = 0.1) -> DataFrame:
    """(cluster_id, n, entropy, spread, split) with ``split`` for clusters of 6 or more, mixed and spread out."""
    c = clusters.select(key, "cluster_id")
    n = c.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    s = profile.join(c, key).groupBy("cluster_id", label).agg(F.sum("share").alias("_s"), F.sum(F.col("share") * F.col("share")).alias("_q")).join(n, "cluster_id")
    total = s.groupBy("cluster_id").agg(F.sum("_s").alias("_t"))
    p = F.col("_s") / F.col("_t")
    var = F.col("_q") / F.col("n") - F.pow(F.col("_s") / F.col("n"), 2)
    g = s.join(total, "cluster_id").groupBy("cluster_id", "n").agg((-F.sum(p * F.log(p)) / F.log(F.lit(float(motifs)))).alias("e"), (F.sum(var) / motifs).alias("v"))
    return g.select("cluster_id", "n", F.round("e", 6).alias("entropy"), F.round("v", 6).alias("spread"), ((F.col("n") >= 6) & (F.col("e") > theta) & (F.col("v") > variance)).alias("split"))


def reassign(df: DataFrame, nb: DataFrame, boundary: DataFrame, label: str, vec: str, motif: str, id_col: str) -> DataFrame:
    """(id, label) of boundary rows after the pull 0.5 motif cosine + 0.3 exp(-distance) + 0.2 connectivity; ties to the smaller label."""
    size = df.groupBy(F.col(label).alias("_label")).agg(F.count(F.lit(1)).alias("_n"))
    near = lambda c, name: centroid_arrays(df, label, c, id_col).select(F.col(label).alias("_label"), F.col("centroid").alias(name))
    table = counted_broadcast(size.join(near(vec, "_cv"), "_label").join(near(motif, "_cm"), "_label"), label="clusters")  # one row per cluster
    rows = df.join(boundary.select(id_col), id_col, "left_semi").select(id_col, F.col(vec).cast("array<double>").alias("_v"), F.col(motif).cast("array<double>").alias("_w"))
    ends = df.select(F.col(id_col).alias("_other"), F.col(label).alias("_label"))
    links = nb.join(boundary.select(F.col(id_col).alias("agent_id")), "agent_id", "left_semi").join(ends, F.col("other_id") == F.col("_other"))
    links = links.groupBy(F.col("agent_id").alias(id_col), "_label").agg(F.count(F.lit(1)).alias("_c"))
    j = rows.crossJoin(table).join(links, [id_col, "_label"], "left")
    pull = 0.5 * cosine("_w", "_cm") + 0.3 * F.exp(-distance("_v", "_cv")) + 0.2 * F.coalesce("_c", F.lit(0)) / F.col("_n")
    return j.groupBy(id_col).agg(F.min_by("_label", F.struct(-F.round(pull, 9), "_label")).alias(label))


def split_clusters(df: DataFrame, flagged: DataFrame, label: str, vec: str, id_col: str, rounds: int = 10) -> DataFrame:
    """(id, label): each flagged cluster divided by 2-means, the second half under the next free label.

    All clusters are divided at once by joins: the first centre is the row farthest from
    the cluster's centre, the second the row farthest from that one (ties to the smaller
    id), and up to ``rounds`` rounds move both to the means of their rows; a row as near
    to both goes with the first. The half of the cluster's smallest id keeps the label.
    Clusters of fewer than two rows or of equal rows stay whole.
    """
    v = F.col(vec).cast("array<double>")
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    chosen = stage(sizes.where("_n > 1").join(flagged.select(label).distinct(), label, "left_semi").select(label), "split-chosen")
    rows = stage(df.join(chosen, label, "left_semi").select(F.col(label).alias("_l"), F.col(id_col).alias("_i"), v.alias("_v")), "split-rows")
    farthest = lambda to: F.min_by("_v", F.struct(-F.round(distance("_v", to), 9), "_i"))
    first = rows.join(centroid_arrays(rows, "_l", "_v", "_i"), "_l").groupBy("_l").agg(farthest("centroid").alias("_a"))
    centres = stage(rows.join(first, "_l").groupBy("_l", "_a").agg(farthest("_a").alias("_b")), "split-centres")
    second = distance("_v", "_b") < distance("_v", "_a")
    for _ in range(rounds):
        told = rows.join(centres, "_l").withColumn("_h", second).select("_l", "_h", F.posexplode("_v").alias("_p", "_x"))
        means = told.groupBy("_l", "_h", "_p").agg(F.avg("_x").alias("_x")).groupBy("_l", "_h").agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_x"))), lambda e: e["_x"]).alias("_c"))
        means = means.groupBy("_l").agg(F.max(F.when(~F.col("_h"), F.col("_c"))).alias("_na"), F.max(F.when(F.col("_h"), F.col("_c"))).alias("_nb"))
        na, nb = F.coalesce("_na", "_a"), F.coalesce("_nb", "_b")
        moved = (na != F.col("_a")) | (nb != F.col("_b"))
        last, centres = centres, stage(centres.join(means, "_l").select("_l", na.alias("_a"), nb.alias("_b"), moved.alias("_moved")), "split-centres")
        release(last)
        if centres.where("_moved").isEmpty():
            break
    centres = centres.select("_l", "_a", "_b")
    halves = stage(rows.join(centres, "_l").select("_l", "_i", second.alias("_h")), "split-halves")
    keeps = halves.groupBy("_l").agg(F.min_by("_h", "_i").alias("_keeps"))
    top = sizes.agg(F.max(label).alias("_top"))  # one row
    number = global_rank(chosen, [label], "_k").select(F.col(label).alias("_l"), (F.col("_k") + 1).alias("_k"))
    moved = halves.join(keeps, "_l").where("_h <> _keeps").join(number, "_l").crossJoin(F.broadcast(top))
    moved = moved.select(F.col("_i").alias(id_col), (F.col("_top") + F.col("_k")).cast(df.schema[label].dataType).alias("_moved"))
    return df.select(id_col, label).join(moved, id_col, "left").select(id_col, F.coalesce("_moved", label).alias(label))
