"""Samples of a cluster and day: tabular vector, lookback sequence, pooled embedding and transition rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from popgraph.functions.rounding import round6
from popgraph.operators.clusters import long_vectors
from popgraph.operators.features import dormitory_flags, flag
from popgraph.operators.panel import STATES, by_agent, transition_rates
from popgraph.plans.stage import stage

#: Occupations of high exposure; days that count as long in a state.
EXPOSED_JOBS = ("healthcare_worker", "teacher", "retail_worker")
LONG_STAY = {"S": 30, "E": 10, "I": 20, "R": 90}
#: Fixed values: (first day, stringency) of the policy phases.
STRINGENCY = ((0, 0.3), (50, 0.9), (110, 0.6))


def _share(part: Column, whole: Column) -> Column:
    """part / whole, 0 for an empty whole."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def _is(state: str, *more: str) -> Column:
    return F.col("state").isin(state, *more)


def _population(agents: DataFrame, panel: DataFrame, cluster: str) -> tuple[DataFrame, DataFrame]:
    """The panel without a cluster of its own, and the entities of it that have a profile and a cluster.

    The entities are written once: every part reads them. A panel that is not a table
    yet is better written by the caller.
    """
    people = agents.where(F.col(cluster).isNotNull()).join(panel.select("agent_id").distinct(), "agent_id", "left_semi")
    return panel.drop(cluster), stage(people, "samples-people")


def profile_part(agents: DataFrame, cluster: str) -> DataFrame:
    """One row per cluster: size, means of the profiles and their deviations."""
    a = agents.withColumns({"_c": F.coalesce("compliance_score", F.lit(0.7)), "_m": F.coalesce("mobility_score", F.lit(0.7))})
    by = a.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("n"), F.avg("age").alias("age"), F.stddev_pop("age").alias("age_std"), F.avg("vaccination_status").alias("vaccine"), F.avg("comorbidity_count").alias("health"),
        F.avg(flag(F.col("occupation").isin(*EXPOSED_JOBS))).alias("exposed_jobs"), F.avg("_c").alias("compliance"), F.stddev_pop("_c").alias("compliance_std"), F.avg("_m").alias("mobility"),
        F.avg(flag(F.lower("gender") == "m")).alias("male"), F.avg(flag(F.col("is_imported"))).alias("imported"), F.avg(flag(F.col("quarantined"))).alias("quarantine"),
    )
    return by.join(dormitory_flags(agents, cluster).select(cluster, flag(F.col("is_dormitory")).alias("dormitory")), cluster)


def link_part(agents: DataFrame, links: DataFrame, cluster: str) -> DataFrame:
    """One row per cluster: degrees, links inside, links inside households, links from the young to the old."""
    j = links.withColumn("_in", F.col("_own") == F.col("_other"))
    young = F.col("age") < 18
    per = j.groupBy("agent_id").agg(
        F.count(F.lit(1)).alias("_d"), F.count_if("_in").alias("_i"), F.count_if(F.col("_in") & (F.col("household_id") == F.col("_household"))).alias("_h"),
        F.count_if(F.col("_in") & young & (F.col("_age") > 65)).alias("_o"), F.count_if(young).alias("_y"),
    )
    a = agents.select("agent_id", cluster).join(per, "agent_id", "left").na.fill(0, ["_d", "_i", "_h", "_o", "_y"])
    g = a.groupBy(cluster).agg(F.avg("_d").alias("degree"), F.stddev_pop("_d").alias("degree_std"), *[F.sum(c).alias(c) for c in ("_d", "_i", "_h", "_o", "_y")])
    return g.select(cluster, "degree", "degree_std", F.col("_i").alias("inside"), _share(F.col("_h"), F.col("_d")).alias("household"), _share(F.col("_o"), F.col("_y")).alias("young_old"))


def day_part(people: DataFrame, links: DataFrame, panel: DataFrame, cluster: str) -> DataFrame:
    """One row per cluster and day: counts and mean days of the states, contacts by state, attack rate.

    Links meet the panel once; contacts are summed per entity and day before they meet
    the entity's own state, so both sides of that join have one row per key.
    """
    sick = _is("E", "I")
    met = links.join(panel.select(F.col("agent_id").alias("other_id"), "day", "state"), "other_id").groupBy("agent_id", "day").agg(
        F.count_if(sick).alias("_sick"), F.count_if(sick & (F.col("_own") != F.col("_other"))).alias("_outside"), F.count_if(_is("S")).alias("_well")
    )
    left = F.max(F.when(_is("S"), 0).otherwise(1)).over(by_agent().rowsBetween(W.unboundedPreceding, 0))
    p = panel.withColumn("_left", left).join(people.select("agent_id", cluster), "agent_id").join(met, ["agent_id", "day"], "left").na.fill(0, ["_sick", "_outside", "_well"])
    return p.groupBy(cluster, "day").agg(
        *[F.count_if(_is(s)).alias(s) for s in STATES], *[F.avg(F.when(_is(s), F.col("days_in_state"))).alias(f"days_{s}") for s in LONG_STAY],
        F.sum("_outside").alias("outside"), F.avg(F.when(_is("S"), F.col("_sick"))).alias("exposure"), F.sum(F.when(sick, F.col("_well")).otherwise(0)).alias("spread"), F.sum("_left").alias("left"),
    )


def cluster_tabular(agents: DataFrame, panel: DataFrame, neighbors: DataFrame, embeddings: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """(cluster, day, features): 37 entries. ``embeddings`` has agent_id and embedding.

    States 5, profiles 11, network 7, course 10, mixing 4. The population is the
    entities of the panel that have a profile and a cluster; links to others do not
    count. Clusters without links, embeddings or entities in a state get zeros there; the
    trend is 0.5 until three days have passed.
    """
    return _tabular(*_population(agents, panel, cluster), neighbors, embeddings, cluster)


def _tabular(panel: DataFrame, people: DataFrame, neighbors: DataFrame, embeddings: DataFrame, cluster: str) -> DataFrame:
    here = people.select("agent_id", F.col(cluster).alias("_own"), "household_id", "age")
    there = people.select(F.col("agent_id").alias("other_id"), F.col(cluster).alias("_other"), F.col("household_id").alias("_household"), F.col("age").alias("_age"))
    links = stage(neighbors.select("agent_id", "other_id").join(here, "agent_id").join(there, "other_id"), "samples-links")
    vectors = long_vectors(embeddings.join(people.select("agent_id", cluster), "agent_id"), "agent_id", "embedding", cluster)
    pooled = vectors.groupBy(cluster).agg(F.avg("x").alias("pooled"), F.stddev_pop("x").alias("pooled_std"))
    days = day_part(people, links, panel, cluster)
    before = F.lag(F.col("E") + F.col("I"), 3).over(W.partitionBy(cluster).orderBy("day"))
    days = days.withColumn("_before", before)
    j = days.join(profile_part(people, cluster), cluster).join(link_part(people, links, cluster), cluster).join(pooled, cluster, "left")
    n, c = F.col("n"), F.col
    active = c("E") + c("I")
    trend = F.when(c("_before").isNotNull(), F.greatest(F.lit(-0.5), F.least(F.lit(0.5), (active - c("_before")) / n)) + 0.5).otherwise(0.5)
    f = F.array(
        *[c(s) / n for s in STATES],
        c("age") / 100, c("age_std") / 50, c("vaccine") / 2, c("health") / 5, c("exposed_jobs"), c("compliance"), c("mobility"), c("male"), c("imported"), c("quarantine"), c("dormitory"),
        c("degree") / 50, c("degree_std") / 25, _share(c("inside"), n * (n - 1)), c("outside") / n, F.coalesce("pooled", F.lit(0.0)), F.coalesce("pooled_std", F.lit(0.0)), F.lit(0.5),
        active / n, *[F.least(F.coalesce(f"days_{s}", F.lit(0.0)) / float(k), F.lit(1.0)) for s, k in LONG_STAY.items()], F.coalesce(c("exposure") / 10, F.lit(0.0)), trend, c("left") / n, c("day") / 200.0, F.lit(0.0),
        c("household"), c("young_old"), c("compliance_std"), c("spread") / n,
    )
    return j.select(cluster, "day", F.transform(f, lambda x: round6(x.cast("double"))).alias("features"))


def stringency(day: Column) -> Column:
    """Policy stringency of a day from 0."""
    out = F.lit(STRINGENCY[0][1])
    for first, value in STRINGENCY[1:]:
        out = F.when(day >= first, value).otherwise(out)
    return out


def cluster_sequence(agents: DataFrame, panel: DataFrame, cluster: str = "cluster_id", days: int = 7) -> DataFrame:
    """(cluster, day, sequence): the last ``days`` + 1 days of ten entries each, zeros in front of the first day.

    Shares of the states, new E from S and new I from E, active share, contact rate (by
    dormitory) and policy stringency.
    """
    return _sequence(*_population(agents, panel, cluster), cluster, days)


def _sequence(panel: DataFrame, people: DataFrame, cluster: str, days: int = 7) -> DataFrame:
    p = panel.withColumn("_b", F.lag("state").over(by_agent())).join(people.select("agent_id", cluster), "agent_id")
    new = lambda a, b: F.avg(flag(_is(b) & (F.col("_b") == a)))
    g = p.groupBy(cluster, "day").agg(*[F.avg(flag(_is(s))).alias(s) for s in STATES], new("S", "E").alias("new_e"), new("E", "I").alias("new_i"))
    g = g.join(dormitory_flags(people, cluster), cluster)
    one = F.array("S", "E", "I", "R", "D", "new_e", "new_i", F.col("E") + F.col("I"), F.when(F.col("is_dormitory"), 0.75).otherwise(0.4), stringency(F.col("day")))
    seq = F.collect_list(F.transform(one, round6)).over(W.partitionBy(cluster).orderBy("day").rowsBetween(-days, 0))
    empty = F.array_repeat(F.array_repeat(F.lit(0.0), 10), days + 1 - F.size("_s"))
    return g.select(cluster, "day", seq.alias("_s")).select(cluster, "day", F.concat(empty, "_s").alias("sequence"))


def pooled_embedding(agents: DataFrame, embeddings: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """(cluster, embedding): mean of each dimension over the entities of a cluster."""
    x = long_vectors(embeddings.join(agents.select("agent_id", cluster), "agent_id"), "agent_id", "embedding", cluster)
    m = x.groupBy(cluster, "pos").agg(round6(F.avg("x")).alias("m"))
    return m.groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda e: e["m"]).alias("embedding"))


def training_samples(agents: DataFrame, panel: DataFrame, neighbors: DataFrame, embeddings: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """(cluster, day, tabular, temporal, graph, labels) of every day that has a next one; clusters without an embedding get none (null)."""
    keys = [cluster, "day"]
    panel, people = _population(agents, panel, cluster)
    rates = transition_rates(panel.join(people.select("agent_id", cluster), "agent_id"), keys)
    labels = rates.select(*keys, F.array(*[F.col(c) for c in rates.columns if c not in keys]).alias("labels"))
    tabular = _tabular(panel, people, neighbors, embeddings, cluster).withColumnRenamed("features", "tabular")
    temporal = _sequence(panel, people, cluster).withColumnRenamed("sequence", "temporal")
    graph = pooled_embedding(people, embeddings, cluster).withColumnRenamed("embedding", "graph")
    return labels.join(tabular, keys).join(temporal, keys).join(graph, cluster, "left").select(*keys, "tabular", "temporal", "graph", "labels")
