"""Reports on profiles, clusters and traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from popgraph.operators.features import flag
from popgraph.operators.panel import STATES
from popgraph.operators.retrieval import top_per_group

#: The fields a profile must have.
REQUIRED = [
    "agent_id", "name", "age", "occupation", "household_id", "vaccination_status", "comorbidity_count", "disease_status",
    "case_number", "gender", "nationality", "confirmation_date", "days_since_start", "is_imported", "cluster",
]
#: Tools by what they look for.
TOOL_GROUPS = {
    "contact_focused": ["check_infected_contacts", "check_household_infections"],
    "info_seeking": ["query_knowledge", "query_contacts"],
    "health_monitoring": ["check_symptoms", "check_days_infected"],
}


def validate_profiles(profiles: DataFrame, required: list[str] = REQUIRED, least_seed: int = 5) -> DataFrame:
    """(check, value, passed): required fields, ids unique and dense from 0, states 0 to 4, infected seed, vaccinated share, days in order of id.

    The seed passes with one exposed or infected entity and is adequate with ``least_seed``.
    The vaccinated share and days out of order are told, not judged.
    """
    from popgraph.operators.panel import count_out_of_order

    missing = [c for c in required if c not in profiles.columns]
    n, status = F.count(F.lit(1)), F.col("disease_status")
    a = profiles.agg(
        n.alias("n"), F.countDistinct("agent_id").alias("ids"), F.min("agent_id").alias("low"), F.max("agent_id").alias("high"),
        F.count_if(status.isNull() | ~status.between(0, 4)).alias("bad"), F.count_if(status.isin(1, 2)).alias("seed"), F.avg(flag(F.col("vaccination_status") > 0)).alias("vaccinated"),
    )
    row = lambda name, value, passed: F.struct(F.lit(name).alias("check"), F.round(value.cast("double"), 6).alias("value"), passed.cast("boolean").alias("passed"))
    checks = [
        row("missing_fields", F.lit(len(missing)), F.lit(not missing)), row("duplicate_ids", F.col("n") - F.col("ids"), F.col("n") == F.col("ids")),
        row("dense_ids", F.col("high"), F.coalesce((F.col("low") == 0) & (F.col("high") == F.col("n") - 1), F.lit(True))), row("invalid_states", F.col("bad"), F.col("bad") == 0),
        row("infected_seed", F.col("seed"), F.col("seed") > 0), row("adequate_seed", F.col("seed"), F.col("seed") >= least_seed), row("vaccinated_share", F.col("vaccinated"), F.lit(None)),
    ]
    rows = a.select(F.explode(F.array(*checks)).alias("r")).select("r.*")
    late = count_out_of_order(profiles, "agent_id", "days_since_start")
    return rows.unionByName(late.select(F.lit("days_out_of_order").alias("check"), F.coalesce(F.col("out_of_order"), F.lit(0)).cast("double").alias("value"), F.lit(None).cast("boolean").alias("passed")))


def summary_report(profiles: DataFrame, dimensions: list[str]) -> DataFrame:
    """n, mean age and mean comorbidity by each dimension and in all ("*"), in one pass."""
    g = profiles.groupingSets([[c] for c in dimensions] + [[]], *dimensions)
    r = g.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("age"), 6).alias("mean_age"), F.round(F.avg("comorbidity_count"), 6).alias("comorbidity"))
    return r.na.fill("*", dimensions)


def top_values(profiles: DataFrame, dimensions: list[str], k: int = 5) -> DataFrame:
    """(dimension, value, n, percent, rank): the ``k`` most frequent values of each dimension; null, empty, nan and none are no values."""
    rows = profiles.select(*[F.col(c).cast("string").alias(c) for c in dimensions]).unpivot([], dimensions, "dimension", "value")
    c = rows.groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n")).withColumn("_t", F.sum("n").over(W.partitionBy("dimension")))
    c = c.where(F.col("value").isNotNull() & ~F.lower("value").isin("", "nan", "none"))
    top = top_per_group(c, ["dimension"], [F.desc("n"), "value"], k)
    return top.select("dimension", "value", "n", F.round(100 * F.col("n") / F.col("_t"), 6).alias("percent"), "rank")


def score_report(profiles: DataFrame, scores: list[str], household: str = "household_id") -> DataFrame:
    """(field, mean, std, low, high) of numeric fields and of household sizes."""
    size = profiles.groupBy(household).agg(F.count(F.lit(1)).cast("double").alias("x")).select(F.lit("household_size").alias("field"), "x")
    rows = profiles.select(*[F.col(c).cast("double").alias(c) for c in scores]).unpivot([], scores, "field", "x").unionByName(size)
    return rows.groupBy("field").agg(F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_pop("x"), 6).alias("std"), F.round(F.min("x"), 6).alias("low"), F.round(F.max("x"), 6).alias("high"))


def _is(cond: Column) -> Column:
    return F.avg(flag(F.coalesce(cond, F.lit(False))))


def cluster_type(agents: DataFrame, cluster: str) -> DataFrame:
    """(cluster, cluster_type) by the first rule that holds. Shares of the rules."""
    b = agents.groupBy(cluster).agg(
        _is(F.lower("cluster").contains("dorm")).alias("_dorm"), _is(F.col("occupation") == "manual_worker").alias("_manual"), _is(F.col("is_imported")).alias("_imported"), F.count(F.lit(1)).alias("_n")
    )
    most = lambda rows, c, name: rows.groupBy(cluster, c).count().groupBy(cluster).agg(F.max("count").alias(name))
    j = b.join(most(agents.where("household_id >= 0"), "household_id", "_home"), cluster, "left").join(most(agents.withColumn("occupation", F.coalesce("occupation", F.lit("unknown"))), "occupation", "_job"), cluster, "left")
    kind = (
        F.when((F.col("_dorm") > 0.3) | (F.col("_manual") > 0.5), "dormitory")
        .when(F.col("_imported") > 0.5, "imported")
        .when(F.col("_home") > F.col("_n") * 0.7, "household")
        .when(F.col("_job") > F.col("_n") * 0.6, "workplace")
        .otherwise("community")
    )
    return j.select(cluster, kind.alias("cluster_type"))


def monitor_clusters(agents: DataFrame, panel: DataFrame, cluster: str) -> DataFrame:
    """Per cluster and day: counts by state, flags, deaths and their mean age, elderly infected, doses, quarantined, imported. Shares of the flags."""
    j = agents.join(panel.select("agent_id", "day", "state"), "agent_id")
    at, dose = lambda s: F.count_if(F.col("state") == s), lambda k: F.count_if(F.col("vaccination_status") == k)
    g = j.groupBy(cluster, "day").agg(
        F.count(F.lit(1)).alias("_n"), *[at(s).alias(s) for s in STATES], F.round(F.avg(F.when(F.col("state") == "D", F.col("age"))), 6).alias("mean_age_dead"),
        F.count_if((F.col("state") == "I") & (F.col("age") >= 70)).alias("elderly_infected"), dose(2).alias("fully_vaccinated"), dose(1).alias("partly_vaccinated"), dose(0).alias("unvaccinated"),
        F.count_if("quarantined").alias("quarantined"), F.count_if("is_imported").alias("imported"),
    )
    g = g.join(cluster_type(agents, cluster), cluster)
    sick = F.col("I") / F.col("_n")
    flags = F.array(
        F.when((F.col("cluster_type") == "dormitory") & (sick > 0.15), "dormitory_outbreak"), F.when(sick > 0.3, "outbreak").when(sick > 0.15, "elevated"),
        F.when(F.col("E") / F.col("_n") > 0.2, "exposure_wave"), F.when((F.col("I") > 0) & (F.col("R") > F.col("I")), "recovery"), F.when(F.col("D") > 0, "deaths"),
    )
    return g.withColumn("flags", F.array_join(flags, ",")).drop("_n")


def aggregate_traces(traces: DataFrame, key: str, order: list[str], role: str) -> DataFrame:
    """(key, turns, roles, path): an entity's conversations over all its scenarios."""
    path = F.transform(F.array_sort(F.collect_list(F.struct(*order, role))), lambda x: x[role])
    return traces.groupBy(key).agg(F.count(F.lit(1)).alias("turns"), F.countDistinct(role).alias("roles"), F.array_join(path, ">").alias("path"))


def tool_usage(talks: DataFrame, key: str, scenario: str, tools: str, groups: dict[str, list[str]] = TOOL_GROUPS) -> DataFrame:
    """Per entity, those that use no tool included: calls, distinct tools, diversity, share of each group of tools, count of each tool, decisions, scenarios and calls per decision.

    ``talks``: one row a conversation, which is a decision, with an array of the names of
    its calls; null and empty arrays are conversations without one.
    """
    by = talks.select(key, F.explode(tools).alias("_tool")).where("_tool is not null").groupBy(key, "_tool").agg(F.count(F.lit(1)).alias("_c"))
    total = by.groupBy(key).agg(F.sum("_c").alias("_t"))
    p = F.col("_c") / F.col("_t")
    share = [F.round(F.sum(F.when(F.col("_tool").isin(*names), F.col("_c")).otherwise(0)) / F.first("_t"), 3).alias(f"{name}_ratio") for name, names in groups.items()]
    used = by.join(total, key).groupBy(key).agg(
        F.first("_t").alias("calls"), F.count(F.lit(1)).alias("tools"), F.round(-F.sum(p * F.log(p + 1e-10)), 3).alias("diversity"), *share,
        F.map_from_entries(F.collect_list(F.struct("_tool", "_c"))).alias("breakdown"),
    )
    decided = talks.groupBy(key).agg(F.count(F.lit(1)).alias("decisions"), F.countDistinct(scenario).alias("scenarios"))
    none = {"calls": 0, "tools": 0, "diversity": 0.0, **{f"{name}_ratio": 0.0 for name in groups}}
    every = decided.join(used, key, "left").na.fill(none).withColumn("breakdown", F.coalesce("breakdown", F.create_map().cast("map<string,bigint>")))
    return every.withColumn("per_decision", F.round(F.col("calls") / F.col("decisions"), 2))


def text_diversity(docs: DataFrame, text: str, low: float = 0.5) -> DataFrame:
    """(distinct_texts, total, diversity, warning): distinct over all texts, a warning below ``low``."""
    r = docs.agg(F.countDistinct(text).alias("distinct_texts"), F.count(text).alias("total"))
    share = F.try_divide("distinct_texts", "total")
    return r.select("*", F.round(share, 6).alias("diversity"), (share < low).alias("warning"))


def trace_totals(traces: DataFrame, scenario: str, entity: str) -> DataFrame:
    """(scenarios, entities, distinct_entities, conversations): entities are summed over scenarios and counted once."""
    by = traces.groupBy(scenario, entity).agg(F.count(F.lit(1)).alias("_c"))
    return by.agg(F.countDistinct(scenario).alias("scenarios"), F.count(F.lit(1)).alias("entities"), F.countDistinct(entity).alias("distinct_entities"), F.coalesce(F.sum("_c"), F.lit(0)).alias("conversations"))
