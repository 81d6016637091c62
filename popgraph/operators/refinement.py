"""The refinement loop: from coarse groups over motifs, anchors and fused vectors to optimised clusters."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popgraph.operators import clusters as K
from popgraph.operators import motifs as M
from popgraph.operators.retrieval import dot
from popgraph.plans.stage import stage

#: Weights of the parts of the fused vectors (graph, contrast with anchors, motifs).
WEIGHTS = {"graph": 0.4, "contrast": 0.3, "motif": 0.3}


@dataclass
class Refinement:
    """Best round and the tables of all rounds: ``stages[r][name]`` for the names of ``STAGES``."""

    labels: DataFrame
    score: float
    best: int
    scores: list[float] = field(default_factory=list)
    stages: list[dict[str, DataFrame]] = field(default_factory=list)


STAGES = ("coarse", "catalogue", "anchors", "hybrid", "fine", "boundary", "reassigned", "merged", "labels")


def anchor_contrast(df: DataFrame, anchors: DataFrame, vec: str, id_col: str, temperature: float = 0.5) -> DataFrame:
    """(id, contrast): softmax over the cosines to all anchors, in the order of their clusters."""
    length = lambda x: F.sqrt(dot(x, x))
    a = anchors.join(df.select(F.col(id_col).alias("anchor"), F.col(vec).alias("_a")), "anchor").select("cluster_id", "_a", length("_a").alias("_n"))
    every = stage(a.agg(F.array_sort(F.collect_list(F.struct("cluster_id", "_a", "_n"))).alias("_all")), "anchors")  # one row, as each row of the result holds an entry for each anchor
    e = M.bound(length("_v"), lambda n: F.transform("_all", lambda x: F.exp(dot("_v", x["_a"]) / (n * x["_n"]) / temperature)))
    total = lambda s: F.aggregate(s, F.lit(0.0), lambda t, x: t + x)
    j = df.select(id_col, F.col(vec).alias("_v")).crossJoin(F.broadcast(every))
    return j.select(id_col, M.bound(e, lambda s: M.bound(total(s), lambda t: F.transform(s, lambda x: x / t))).alias("contrast"))


def refine_clusters(
    df: DataFrame,
    profile: DataFrame,
    edges: DataFrame,
    id_col: str,
    graph: str,
    motif: str,
    pattern: str,
    k_coarse: int,
    k_fine: int,
    threshold: float,
    rounds: int = 3,
    weights: dict[str, float] | None = None,
    theta_merge: float = 0.05,
    theta_split: float = 0.8,
) -> Refinement:
    """Clusters of ``df`` (id, vectors ``graph`` and ``motif``) by rounds of stages, until the quality reaches ``threshold``.

    A round groups the graph vectors coarsely, catalogues the motifs of ``profile`` (id,
    ``pattern``, share), picks an anchor of each group, fuses graph vectors, contrasts with
    the anchors and motifs, clusters the fused vectors finely, moves boundary rows, merges
    clusters of like motifs and splits mixed ones. The next round has one coarse group
    more, up to a third of the rows. The quality is 0.45 modularity of ``edges``, 0.35
    motif coherence and 0.20 silhouette; without edges or links inside, the first is 0.
    The best round is returned, the earliest of equals; every table of every round is
    written and can be read. Rows without a vector are left out.
    """
    df = stage(df.where(F.col(graph).isNotNull() & F.col(motif).isNotNull()).select(id_col, F.col(graph).cast("array<double>").alias("graph"), F.col(motif).cast("array<double>").alias("motif")), "refine-rows")
    n = df.count()
    if not n:
        raise ValueError("no rows with both vectors")
    weights = weights or WEIGHTS
    profile = stage(profile.select(id_col, pattern, "share"), "refine-profile")
    patterns = profile.select(pattern).distinct().count()
    wide = df.agg(F.greatest(F.max(F.size("graph")), F.max(F.size("motif")))).first()[0]
    for end in ("agent_1", "agent_2"):  # other edges count nowhere
        edges = edges.join(df.select(F.col(id_col).alias(end)), end, "left_semi")
    edges = stage(edges.select("agent_1", "agent_2", "contact_rate"), "refine-edges")
    nb = edges.select(F.col("agent_1").alias("agent_id"), F.col("agent_2").alias("other_id")).unionByName(edges.select(F.col("agent_2").alias("agent_id"), F.col("agent_1").alias("other_id")))
    out = Refinement(df, float("-inf"), -1)
    for r in range(rounds):
        k = min(k_coarse + r, max(n // 3, 2))
        t: dict[str, DataFrame] = {}

        def keep(name: str, table: DataFrame, t=t, r=r) -> DataFrame:
            t[name] = stage(table, f"refine-{r}-{name}")
            return t[name]

        coarse = keep("coarse", K.coarse_cluster(df, "graph", id_col, k))
        keep("catalogue", M.motif_catalogue(profile, id_col, pattern))
        grouped = df.join(coarse, id_col)
        anchors = keep("anchors", K.select_anchors(grouped, "cluster_id", "graph", id_col))
        parts = stage(df.join(anchor_contrast(df, anchors, "graph", id_col), id_col), "refine-parts")
        hybrid = keep("hybrid", M.fuse_embeddings(parts, id_col, weights, max(wide, k)))
        fine = keep("fine", K.fine_cluster(hybrid, "fused", id_col, k_fine))
        placed = hybrid.join(fine, id_col).join(df, id_col)
        edge = keep("boundary", M.boundary_entities(placed, "cluster_id", "fused", id_col))
        pulled = M.reassign(placed, nb, edge, "cluster_id", "fused", "motif", id_col).withColumnRenamed("cluster_id", "_new")
        moved = keep("reassigned", fine.join(pulled, id_col, "left").select(id_col, F.coalesce("_new", "cluster_id").alias("cluster_id")))
        merged = keep("merged", M.merge_clusters(moved, M.cluster_divergence(profile, moved, id_col, pattern), id_col, theta_merge))
        flagged = M.split_flags(profile, merged, id_col, pattern, max(patterns, 2), theta_split).where("split")
        labels = keep("labels", M.split_clusters(hybrid.join(merged, id_col), flagged, "cluster_id", "fused", id_col))
        ends = labels.select(F.col(id_col).alias("agent_id"), "cluster_id")
        quality = M.quality_score(K.modularity(edges, ends), M.motif_coherence(profile, labels, id_col, pattern), K.silhouette(hybrid.join(labels, id_col), "cluster_id", "fused", id_col), unknown=0.0)
        score = quality.first()[0]
        out.stages.append(t)
        out.scores.append(score)
        if score > out.score:
            out.labels, out.score, out.best = labels, score, r
        if score >= threshold:
            break
    return out
