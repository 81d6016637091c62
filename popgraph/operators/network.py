"""Contact networks as edge tables (agent_1 < agent_2, edge_type, contact_rate)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from popgraph.functions.draws import uniform
from popgraph.plans.components import connected_components as components
from popgraph.plans.ranks import global_rank, rank_in_groups
from popgraph.plans.stage import stage

EDGE = ["agent_1", "agent_2", "edge_type", "contact_rate"]
LAYERS = ("household", "contact", "cluster", "work", "school", "community")


def canonical_pairs(df: DataFrame, a: str = "agent_1", b: str = "agent_2") -> DataFrame:
    """Unordered pairs, each once, without self-pairs."""
    return df.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("agent_1"), F.greatest(a, b).alias("agent_2")).distinct()


def household_edges(agents: DataFrame, key: str = "household_id", rate: float = 0.95, block: int = 50) -> DataFrame:
    """Complete graph in each household; one of more than ``block`` members is dealt out in blocks of about so many."""
    n = agents.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_n"))
    sized = agents.select("agent_id", key).join(n, key)
    a = sized.withColumn("_at", F.pmod(F.xxhash64("agent_id"), F.col("_n")).cast("int"))
    b = sized.select(F.col("agent_id").alias("_b"), F.col(key).alias("_k"), F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_block"))
    pairs = a.join(b, (F.col(key) == F.col("_k")) & (F.col("_at") == F.col("_block")) & (F.col("agent_id") < F.col("_b")))
    return pairs.select(F.col("agent_id").alias("agent_1"), F.col("_b").alias("agent_2"), F.lit("household").alias("edge_type"), F.lit(rate).alias("contact_rate"))


def _meet(ranked: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """Canonical pairs of ``asked`` (agent_id, keys, _to) and the members of rank ``_to``."""
    peer = ranked.select(F.col("agent_id").alias("_peer"), F.col("_r").alias("_to"), *keys)
    return canonical_pairs(asked.join(peer, [*keys, "_to"]), "agent_id", "_peer")


def _drawn_peers(ranked: DataFrame, salt: str) -> DataFrame:
    """``ranked`` with ``_to``: the ranks of two to four different peers of each member, all others in smaller groups."""
    others = F.col("_n") - 1
    how_many = F.least(F.floor(uniform(F.col("agent_id"), salt + "-n") * 3) + 2, others)
    first = F.floor(uniform(F.col("agent_id"), salt + "-first") * others)
    stride = F.greatest(F.floor(others / 4), F.lit(1))
    offsets = F.transform(F.sequence(F.lit(0).cast("long"), how_many - 1), lambda k: F.pmod(first + k * stride, others) + 1)
    return ranked.where("_n > 1").withColumn("_to", F.explode(offsets)).withColumn("_to", F.pmod(F.col("_r") + F.col("_to"), F.col("_n")))


def network_edges(agents: DataFrame, keys: list[str], edge_type: str, rate: float) -> DataFrame:
    """Two to four drawn peers for every member of a work or school network."""
    ranked = rank_in_groups(agents.select("agent_id", *keys), keys, "agent_id", "_r", "_n")
    return _meet(ranked, _drawn_peers(ranked, edge_type), keys).withColumn("edge_type", F.lit(edge_type)).withColumn("contact_rate", F.lit(rate))


#: Members up to which all pairs of a named group are looked at.
SMALL_GROUP = 20


def _dense_pairs(few: DataFrame, keys: list[str]) -> DataFrame:
    """Each pair of a small group with chance 0.4."""
    pairs = few.select("agent_id", *keys).join(few.select(F.col("agent_id").alias("_peer"), *keys), keys).where("agent_id < _peer")
    kept = pairs.where(uniform(F.concat_ws("-", "agent_id", "_peer"), "cluster") < 0.4)
    return canonical_pairs(kept, "agent_id", "_peer").select("agent_1", "agent_2", F.lit("cluster").alias("edge_type"), F.lit(0.60).alias("contact_rate"))


def group_edges(agents: DataFrame, keys: list[str], small: int = SMALL_GROUP) -> DataFrame:
    """Contacts in a named group: up to ``small`` members each pair with chance 0.4, larger ones two to four drawn peers a member."""
    ranked = rank_in_groups(agents.select("agent_id", *keys), keys, "agent_id", "_r", "_n")
    few, many = ranked.where(F.col("_n") <= small), ranked.where(F.col("_n") > small)
    sparse = _meet(many, _drawn_peers(many, "cluster"), keys).select("agent_1", "agent_2", F.lit("cluster").alias("edge_type"), F.lit(PEER_RATES["cluster"]).alias("contact_rate"))
    return _dense_pairs(few, keys).unionByName(sparse)


def link_edges(cases: DataFrame) -> DataFrame:
    """Explicit links: every integer word in a case's ``link`` text that is a case; first mention wins."""
    said = cases.select("case", "link", F.posexplode(F.regexp_extract_all("link", F.lit(r"\b(\d+)\b"), F.lit(1))).alias("pos", "_n"))
    said = said.withColumn("_other", F.expr("try_cast(_n as bigint)")).join(cases.select(F.col("case").alias("_other")), "_other", "left_semi")
    low = F.lower("link")
    kind = F.when(low.contains("family") | low.contains("household"), "household").when(low.contains("work"), "work").otherwise("contact")
    typed = said.where("case <> _other").select(F.least("case", "_other").alias("agent_1"), F.greatest("case", "_other").alias("agent_2"), kind.alias("edge_type"), "case", "pos")
    first = F.row_number().over(W.partitionBy("agent_1", "agent_2").orderBy("case", "pos"))
    rate = F.when(F.col("edge_type") == "household", 0.95).when(F.col("edge_type") == "work", 0.70).otherwise(0.60)
    return typed.withColumn("_f", first).where("_f = 1").select("agent_1", "agent_2", "edge_type", rate.alias("contact_rate"))


def resolve_layers(edges: DataFrame, layers: tuple = LAYERS) -> DataFrame:
    """One edge per pair, of the layer that comes first in ``layers``."""
    rank = F.array_position(F.array(*[F.lit(x) for x in layers]), F.col("edge_type"))
    best = edges.groupBy("agent_1", "agent_2").agg(F.min_by(F.struct("edge_type", "contact_rate"), F.struct(rate_key(rank), "edge_type")).alias("_e"))
    return best.select("agent_1", "agent_2", "_e.edge_type", "_e.contact_rate")


def rate_key(rank: Column) -> Column:
    return F.when(rank == 0, 99).otherwise(rank)


def without(edges: DataFrame, existing: DataFrame) -> DataFrame:
    """Edges whose pair is not there yet."""
    return edges.join(existing.select("agent_1", "agent_2"), ["agent_1", "agent_2"], "left_anti")


def repair_isolated(agents: DataFrame, edges: DataFrame, rate: float = 0.40) -> DataFrame:
    """Two community edges for every entity without edges, to entities of lowest degree.

    All entities stand in order of degree and id, so the isolated come first; the r-th of
    them takes those at places 2r + 1 and 2r + 2, from the start again beyond the last.
    """
    pool = stage(global_rank(degrees(agents, edges), ["degree", "agent_id"], "_c"), "network-degrees")
    size = pool.agg(F.count(F.lit(1)).alias("_m"))  # one row
    lone = pool.where("degree = 0").crossJoin(F.broadcast(size))
    picks = lone.withColumn("_c", F.explode(F.array(F.pmod(2 * F.col("_c") + 1, F.col("_m")), F.pmod(2 * F.col("_c") + 2, F.col("_m"))))).select("agent_id", "_c")
    pairs = canonical_pairs(picks.join(pool.select("_c", F.col("agent_id").alias("_other")), "_c"), "agent_id", "_other")
    return pairs.withColumn("edge_type", F.lit("community")).withColumn("contact_rate", F.lit(rate))


#: Contact rates of drawn peers by layer.
PEER_RATES = {"cluster": 0.50, "work": 0.70, "school": 0.65}


def build_contact_network(agents: DataFrame, links: DataFrame, household: str = "household_id", groups: dict[str, str] | None = None, repair: bool = True) -> DataFrame:
    """The whole contact network: (agent_1, agent_2, edge_type, contact_rate), one edge a pair.

    Layers in order: complete households, ``links`` (edges named in texts, one a pair),
    contacts in named groups, at work and at school; a pair that an earlier layer has is
    skipped by the later ones. ``groups``: the column of ``agents`` that names the group of
    each of the layers cluster, work and school; null is no group. At last entities
    without any edge get two community edges. An entity in no layer is isolated too; an
    empty table of agents gives an empty network. Ids must not repeat.
    """
    groups = groups or {"cluster": "cluster", "work": "work_network", "school": "school_network"}
    own = F.explode(F.array(*[F.struct(F.lit(layer).alias("layer"), F.col(c).cast("string").alias("group")) for layer, c in groups.items()]))
    members = agents.select("agent_id", own.alias("_g")).select("agent_id", "_g.layer", "_g.group").where("group is not null")
    keys = ["layer", "group"]
    ranked = stage(rank_in_groups(members, keys, "agent_id", "_r", "_n"), "network-members")
    sparse = (F.col("layer") != "cluster") | (F.col("_n") > SMALL_GROUP)
    asked = [_drawn_peers(ranked.where(sparse & (F.col("layer") == layer)), layer) for layer in groups]
    asked = reduce(DataFrame.unionByName, asked)
    peer = ranked.select(F.col("agent_id").alias("_peer"), F.col("_r").alias("_to"), *keys)
    drawn = asked.join(peer, [*keys, "_to"]).where("agent_id <> _peer")
    rate = F.coalesce(*[F.when(F.col("layer") == layer, F.lit(r)) for layer, r in PEER_RATES.items()])
    drawn = drawn.select(F.least("agent_id", "_peer").alias("agent_1"), F.greatest("agent_id", "_peer").alias("agent_2"), F.col("layer").alias("edge_type"), rate.alias("contact_rate"))
    layers = [household_edges(agents, household), links.select(*EDGE), _dense_pairs(ranked.where(~sparse), keys), drawn]
    place = [F.lit(0), F.lit(1), F.lit(2), F.array_position(F.array(*[F.lit(x) for x in groups]), F.col("edge_type")).cast("int") + 1]
    every = reduce(DataFrame.unionByName, [e.withColumn("_layer", p) for e, p in zip(layers, place, strict=True)])
    best = every.groupBy("agent_1", "agent_2").agg(F.min(F.struct("_layer", "edge_type", "contact_rate")).alias("_e")).select("agent_1", "agent_2", "_e.edge_type", "_e.contact_rate")
    if not repair:
        return best
    best = stage(best, "network")
    return best.unionByName(repair_isolated(agents, best))


def neighbors(edges: DataFrame) -> DataFrame:
    """Both directions of every edge: (agent_id, other_id, edge_type, contact_rate)."""
    there = edges.select(F.col("agent_1").alias("agent_id"), F.col("agent_2").alias("other_id"), "edge_type", "contact_rate")
    back = edges.select(F.col("agent_2").alias("agent_id"), F.col("agent_1").alias("other_id"), "edge_type", "contact_rate")
    return there.unionByName(back)


def degrees(agents: DataFrame, edges: DataFrame) -> DataFrame:
    d = neighbors(edges).groupBy("agent_id").agg(F.count(F.lit(1)).alias("degree"))
    return agents.select("agent_id").join(d, "agent_id", "left").select("agent_id", F.coalesce("degree", F.lit(0)).alias("degree"))


def degree_stats(agents: DataFrame, edges: DataFrame) -> DataFrame:
    d = degrees(agents, edges)
    q = [F.percentile("degree", F.lit(p)).cast("double").alias(n) for n, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))]
    return d.agg(F.min("degree").alias("lowest"), *q, F.round(F.avg("degree"), 6).alias("mean"), F.max("degree").alias("highest"), F.round(F.stddev_pop("degree"), 6).alias("std"))


def edge_report(edges: DataFrame, known: tuple = LAYERS, household_rate: float = 0.7) -> DataFrame:
    """Per edge type: share, contact rates, whether it is expected and, of households, whether no rate is below ``household_rate``."""
    n = F.count(F.lit(1))
    by = edges.groupBy("edge_type").agg(n.alias("edges"), F.round(F.avg("contact_rate"), 6).alias("mean_rate"), F.min("contact_rate").alias("low"), F.percentile("contact_rate", F.lit(0.5)).alias("median"), F.max("contact_rate").alias("high"))
    total = edges.agg(n.alias("_n"))
    rates_hold = F.when(F.col("edge_type") == "household", F.col("low") >= household_rate)
    return by.crossJoin(F.broadcast(total)).select("edge_type", "edges", F.round(100 * F.col("edges") / F.col("_n"), 6).alias("percent"), "mean_rate", "low", "median", "high", F.col("edge_type").isin(*known).alias("expected"), rates_hold.alias("rates_hold"))


def validate_network(agents: DataFrame, edges: DataFrame) -> DataFrame:
    """(check, failures) of the network rules."""
    ids = agents.select(F.col("agent_id").alias("_id"))
    rules = edges.agg(
        F.count_if(F.col("agent_1") == F.col("agent_2")).alias("self_loop"), F.count_if(F.col("agent_1") >= F.col("agent_2")).alias("not_canonical"),
        F.count_if(~F.col("contact_rate").between(0, 1)).alias("rate_out_of_range"), F.count_if(~F.col("edge_type").isin(*LAYERS)).alias("unknown_type"),
        F.count_if(F.col("agent_1").isNull() | F.col("agent_2").isNull()).alias("null_end"),
    )
    rows = rules.unpivot([], list(rules.columns), "check", "failures")
    twice = edges.groupBy("agent_1", "agent_2").count().where("count > 1").agg(F.count(F.lit(1)).alias("failures")).select(F.lit("duplicate").alias("check"), "failures")
    ends = neighbors(edges).select(F.col("agent_id").alias("_id")).distinct()
    loose = ends.join(ids, "_id", "left_anti").agg(F.count(F.lit(1)).alias("failures")).select(F.lit("dangling").alias("check"), "failures")
    lone = ids.join(ends, "_id", "left_anti").agg(F.count(F.lit(1)).alias("failures")).select(F.lit("isolated").alias("check"), "failures")
    return rows.unionByName(twice).unionByName(loose).unionByName(lone)


def triangles(edges: DataFrame) -> DataFrame:
    """(agent_id, triangles): edges point to the end of larger (degree, id), so no hub is expanded."""
    e = canonical_pairs(edges)
    d = neighbors(e.withColumn("edge_type", F.lit("")).withColumn("contact_rate", F.lit(1.0))).groupBy("agent_id").agg(F.count(F.lit(1)).alias("k"))
    e = e.join(d.select(F.col("agent_id").alias("agent_1"), F.col("k").alias("k1")), "agent_1").join(d.select(F.col("agent_id").alias("agent_2"), F.col("k").alias("k2")), "agent_2")
    up = (F.col("k1") < F.col("k2")) | ((F.col("k1") == F.col("k2")) & (F.col("agent_1") < F.col("agent_2")))
    o = e.select(F.when(up, F.col("agent_1")).otherwise(F.col("agent_2")).alias("a"), F.when(up, F.col("agent_2")).otherwise(F.col("agent_1")).alias("b"))
    wedge = o.join(o.select("a", F.col("b").alias("c")), "a").where("b <> c")
    third = o.select(F.col("a").alias("b"), F.col("b").alias("c"))
    tri = wedge.join(third, ["b", "c"])
    return tri.select(F.explode(F.array("a", "b", "c")).alias("agent_id")).groupBy("agent_id").agg(F.count(F.lit(1)).alias("triangles"))


def graph_stats(agents: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes, edges, density, average degree, transitivity and average clustering."""
    d = degrees(agents, edges).join(triangles(edges), "agent_id", "left").na.fill(0, ["triangles"])
    pairs = F.col("degree") * (F.col("degree") - 1) / 2
    local = F.when(F.col("degree") > 1, F.col("triangles") / pairs).otherwise(0.0)
    n, m = F.count(F.lit(1)), F.sum("degree") / 2
    return d.agg(
        n.alias("nodes"), m.cast("long").alias("edges"), F.round(2 * m / (n * (n - 1)), 9).alias("density"), F.round(F.avg("degree"), 6).alias("avg_degree"),
        F.round(F.sum("triangles") / F.sum(pairs), 6).alias("transitivity"), F.round(F.avg(local), 6).alias("avg_clustering"),
    )


def connected_components(agents: DataFrame, edges: DataFrame) -> DataFrame:
    """(agent_id, component): smallest id in reach, for every entity."""
    found = components(edges, "agent_1", "agent_2")
    return agents.select("agent_id").join(found, F.col("agent_id") == F.col("node"), "left").select("agent_id", F.coalesce("component", "agent_id").alias("component"))


def induced_subgraph(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among ``ids`` (agent_id)."""
    i = ids.select(F.col("agent_id").alias("_i")).distinct()
    return edges.join(i, F.col("agent_1") == F.col("_i"), "left_semi").join(i, F.col("agent_2") == F.col("_i"), "left_semi")


def ego_subgraph(agents: DataFrame, edges: DataFrame, seeds: Column) -> DataFrame:
    """Edges induced by the seeds and their neighbours."""
    s = agents.where(seeds).select("agent_id")
    near = neighbors(edges).join(s, "agent_id", "left_semi").select(F.col("other_id").alias("agent_id"))
    return induced_subgraph(edges, s.union(near).distinct())


def prune_expired(edges: DataFrame, panel: DataFrame, day: int, after: int = 10) -> DataFrame:
    """Edges without an end that is dead for more than ``after`` days."""
    gone = panel.where((F.col("day") == day) & (F.col("state") == "D") & (F.col("days_in_state") > after)).select(F.col("agent_id").alias("_g"))
    return edges.join(gone, F.col("agent_1") == F.col("_g"), "left_anti").join(gone, F.col("agent_2") == F.col("_g"), "left_anti")


def propagate_features(features: DataFrame, nb: DataFrame, hops: int = 1) -> DataFrame:
    """Mean of each entry of ``features`` (agent_id, f array<double>) over neighbours, per hop."""
    f = features
    for _ in range(hops):
        sent = nb.select("agent_id", "other_id").join(f.withColumnRenamed("agent_id", "other_id"), "other_id")
        parts = sent.select("agent_id", F.posexplode("f").alias("pos", "x")).groupBy("agent_id", "pos").agg(F.avg("x").alias("x"))
        f = parts.groupBy("agent_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("f"))
    return f
