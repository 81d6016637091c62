"""Exposure and transition risk as joins and column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def neighbor_states(nb: DataFrame, panel: DataFrame, agents: DataFrame, mourned: int = 10) -> DataFrame:
    """Per entity and day of ``panel``: contacts, those in E or I (also of the own household, of dormitories), those dead for at most ``mourned`` days (also of the household), infected share."""
    home = agents.select("agent_id", "household_id")
    other = panel.select(F.col("agent_id").alias("other_id"), "day", F.col("state").alias("_s"), F.col("days_in_state").alias("_d"))
    place = agents.select(F.col("agent_id").alias("other_id"), F.col("household_id").alias("_h"), F.lower("cluster").contains("dorm").alias("_dorm"))
    links = nb.select("agent_id", "other_id").join(place, "other_id").join(home, "agent_id")
    j = links.select("agent_id", "other_id", "_dorm", F.coalesce(F.col("_h") == F.col("household_id"), F.lit(False)).alias("_home")).join(other, "other_id")
    sick, dead, near = F.col("_s").isin("E", "I"), (F.col("_s") == "D") & (F.col("_d") <= mourned), F.col("_home")
    return j.groupBy("agent_id", "day").agg(
        F.count(F.lit(1)).alias("contacts"), F.count_if(sick).alias("infected"), F.count_if(sick & near).alias("household_infected"), F.count_if(sick & F.col("_dorm")).alias("dormitory_infected"),
        F.count_if(dead).alias("dead"), F.count_if(dead & near).alias("household_dead"), F.round(F.avg(F.when(sick, 1.0).otherwise(0.0)), 6).alias("share"),
    )


def cluster_context(nb: DataFrame, panel: DataFrame, cluster: str) -> DataFrame:
    """(cluster, other_cluster, day, contacts, infected): links that leave a cluster and those of them that end at E or I."""
    placed = panel.select("agent_id", cluster).distinct()
    links = nb.select("agent_id", "other_id").join(placed, "agent_id").join(placed.select(F.col("agent_id").alias("other_id"), F.col(cluster).alias("other_cluster")), "other_id").where(F.col(cluster) != F.col("other_cluster"))
    ends = links.groupBy(cluster, "other_cluster", "other_id").agg(F.count(F.lit(1)).alias("_n"))
    j = ends.join(panel.select(F.col("agent_id").alias("other_id"), "day", "state"), "other_id")
    return j.groupBy(cluster, "other_cluster", "day").agg(F.sum("_n").alias("contacts"), F.sum(F.when(F.col("state").isin("E", "I"), F.col("_n")).otherwise(0)).alias("infected"))


def relation_type(h1: Column, h2: Column, o1: Column, o2: Column, a1: Column, a2: Column) -> Column:
    study = lambda o: o.isin("student", "teacher")
    return (
        F.when(h1 == h2, "household")
        .when((o1 == o2) & o1.isin("healthcare_worker", "office_worker", "retail_worker", "teacher"), "work")
        .when((o1 == "student") & (o2 == "student") & (F.abs(a1 - a2) <= 3), "school")
        .when(study(o1) & study(o2), "school")
        .otherwise("social")
    )


def contact_risk(relation: Column, healthcare: Column, vaccination: Column, compliance: Column, age: Column, comorbidity: Column, base: float = 0.05) -> Column:
    """Daily risk from one infected contact. Multipliers of relation, protection and age."""
    by = F.when(relation == "household", 3.0).when(relation == "work", F.when(healthcare, 1.8).otherwise(1.5)).when(relation == "school", 1.8).otherwise(0.8)
    vacc = F.when(vaccination == 1, 0.5).when(vaccination == 2, 0.8).otherwise(0.0)
    return base * by * (1 - vacc) * (1 - compliance * 0.5) * F.when(age < 18, 0.6).when(age > 60, 1.3).otherwise(1.0) * (1 + comorbidity * 0.15)


def exposure_risk(nb: DataFrame, panel: DataFrame, agents: DataFrame, combine: str = "sum") -> DataFrame:
    """Summed risk of susceptible and recovered entities per day over contacts in E or I; ``product``: 1 - prod(1 - risk)."""
    cols = ["household_id", "occupation", "age"]
    there = agents.select(F.col("agent_id").alias("other_id"), *[F.col(c).alias(f"_{c}") for c in cols])
    j = nb.select("agent_id", "other_id").join(there, "other_id").join(agents, "agent_id")
    kind = relation_type(F.col("household_id"), F.col("_household_id"), F.col("occupation"), F.col("_occupation"), F.col("age"), F.col("_age"))
    risk = contact_risk(kind, F.col("occupation") == "healthcare_worker", F.col("vaccination_status"), F.col("compliance_score"), F.col("age"), F.col("comorbidity_count"))
    sick = panel.where(F.col("state").isin("E", "I")).select(F.col("agent_id").alias("other_id"), "day")
    own = panel.where(F.col("state").isin("S", "R")).select("agent_id", "day")
    total = F.sum("_r") if combine == "sum" else 1 - F.exp(F.sum(F.log1p(-F.col("_r"))))
    met = j.select("agent_id", "other_id", risk.alias("_r")).join(sick, "other_id").groupBy("agent_id", "day").agg(F.count(F.lit(1)).alias("contacts"), F.round(total, 6).alias("risk"))
    return met.join(own, ["agent_id", "day"])


def recovery_probability(days: Column, vaccination: Column, age: Column, comorbidity: Column) -> Column:
    """10 % a day by stage of infection, vaccination, age and comorbidity."""
    stage = F.when(days < 5, 0.3).when(days < 10, 1.0).otherwise(2.0)
    return 0.10 * stage * F.when(vaccination == 2, 1.3).when(vaccination == 1, 1.15).otherwise(1.0) * F.when(age < 18, 1.3).when(age > 60, 0.7).otherwise(1.0) * F.pow(F.lit(0.85), comorbidity)


def progression(state: Column, days: Column, vaccination: Column, age: Column, comorbidity: Column) -> dict[str, Column]:
    """Stage of the disease, protection of the recovered, and today's chance of recovery of the infected. Days of the stages."""
    by_days = lambda *steps: F.when(days < steps[0][0], steps[0][1]).when(days < steps[1][0], steps[1][1]).otherwise(steps[2])
    stage = (
        F.when(state == "S", "susceptible")
        .when(state == "E", F.when(days < 3, "early_incubation").otherwise("late_incubation"))
        .when(state == "I", by_days((5, "early_infection"), (10, "active_infection"), "prolonged_infection"))
        .when(state == "R", by_days((90, "strong_immunity"), (180, "waning_immunity"), "weak_immunity"))
        .when(state == "D", "deceased")
    )
    return {
        "stage": stage, "protection": F.when(state == "R", by_days((90, 0.95), (180, 0.80), F.lit(0.50))),
        "recovery": F.when(state == "I", recovery_probability(days, vaccination, age, comorbidity)),
    }


def transition_probability(state: Column, days: Column, age: Column, vaccination: Column, comorbidity: Column, compliance: Column, crowded: Column, household: Column, other: Column, quarantined: Column) -> dict[str, Column]:
    """Expected daily probabilities by name. Steps and factors of the calibration.

    ``crowded``: lives in a dormitory or does manual work; ``household`` and ``other``: contacts in E or I.
    """
    pick = lambda *v: F.when(vaccination == 0, v[0]).when(vaccination == 1, v[1]).otherwise(v[2])
    sick = household + other
    s = F.when(sick == 0, 0.002).otherwise(0.014 * household + 0.007 * other) * F.when(crowded, 2.5).otherwise(1.0) * F.when(quarantined, 0.20).otherwise(1.0) * pick(1.0, 0.65, 0.35)
    s = s * F.when(age < 18, 0.6).when(age > 65, 1.4).otherwise(1.0) * (2.2 - 1.5 * compliance)
    e = F.when(days < 2, 0.0).when(days == 2, 0.05).when(days == 3, 0.15).when(days == 4, 0.25).otherwise(0.35) * pick(1.0, 0.85, 0.70) * F.when(age < 18, 0.9).when(age > 60, 1.3).otherwise(1.0)
    r = F.when(days == 7, 0.05).when(days < 10, 0.05 + 0.02 * (days - 7)).when(days < 14, 0.10 + 0.025 * (days - 10)).otherwise(0.20 + 0.02 * F.least(days - 14, F.lit(5)))
    r = r * 1.3 * pick(1.0, 1.2, 1.4) * F.when(age < 18, 1.3).when(age > 60, 0.7).otherwise(1.0)
    ifr = F.when(age < 18, 0.00002 * 0.3).when(age < 50, 0.0005 * 0.3).when(age < 70, 0.005 * 0.3).otherwise(0.02 * 0.3)
    d = (1 - F.pow(1 - ifr, F.lit(0.1))) * F.when(days.between(7, 14), 1.5).when(days < 7, 0.05).otherwise(0.2) * (1 + comorbidity * 0.5) * pick(1.0, 0.5, 0.2)
    again = F.when(days > 365, 0.005).otherwise(0.001) * F.when(sick > 0, 1 + sick).otherwise(1) * pick(1.0, 0.5, 0.2)
    early = days < 7
    return {
        "s_e": F.when(state == "S", F.least(s, F.lit(0.30))).otherwise(0.0), "e_i": F.when(state == "E", F.least(e, F.lit(0.50))).otherwise(0.0),
        "i_r": F.when((state == "I") & ~early, F.least(r, F.lit(0.40))).otherwise(0.0), "i_d": F.when((state == "I") & ~early, F.least(d, F.lit(0.02))).otherwise(0.0),
        "r_s": F.when((state == "R") & (days >= IMMUNITY_DAYS), F.least(again, F.lit(0.03))).otherwise(0.0),
    }


# Weights of the two sources without any confidence, the cap of all and those of transitions.
UNSURE, CAP = (0.6, 0.4), 0.95
CAPS = {"S->E": 0.10, "E->I": 0.25, "I->R": 0.35, "I->D": 0.02, "R->S": 0.03}


def fuse(symbolic: Column, neural: Column, conf_s: Column, conf_n: Column, multiplier: Column, transition: Column | None = None) -> tuple[Column, Column]:
    """(probability, confidence) of two sources weighed by confidence.

    The confidence is the harmonic mean, or the larger where one is zero. ``transition``:
    name of a transition whose cap holds beside that of all; other names have none.
    """
    total = conf_s + conf_n
    weight = lambda c, otherwise: F.when(total > 0, c / total).otherwise(otherwise)
    p = (weight(conf_s, UNSURE[0]) * symbolic + weight(conf_n, UNSURE[1]) * neural) * multiplier
    caps = F.create_map(*[F.lit(x) for kv in CAPS.items() for x in kv])
    cap = F.lit(CAP) if transition is None else F.coalesce(caps[transition], F.lit(CAP))
    return F.least(p, F.lit(CAP), cap), F.when((conf_s > 0) & (conf_n > 0), 2 * conf_s * conf_n / total).otherwise(F.greatest(conf_s, conf_n))


# Transmission and immunity.
BETA_HOUSEHOLD, BETA_CONTACT, BETA_COMMUNITY, IMMUNITY_DAYS = 0.18, 0.035, 0.005, 180
#: Effect of no, one and two doses on exposure, progression, recovery and death; exposure by occupation.
VACCINE_EFFECT = {"exposure": (1.0, 0.50, 0.30), "progression": (1.0, 0.85, 0.70), "recovery": (1.0, 1.2, 1.4), "death": (1.0, 0.3, 0.1)}
OCCUPATION_RISK = {"healthcare_worker": 2.0, "retail_worker": 1.5, "teacher": 1.8, "office_worker": 1.0, "student": 1.2, "retired": 0.8}


def risk_multipliers(household_infected: str = "household_infected", infected: str = "infected") -> dict[str, Column]:
    """Multipliers of an entity's rates by transition, from its profile, day state and contact counts (null counts are zero)."""
    age, sick, dose = F.col("age"), F.col("comorbidity_count"), F.col("vaccination_status")
    days, home, near = F.col("days_in_state"), F.coalesce(F.col(household_infected), F.lit(0)), F.coalesce(F.col(infected), F.lit(0))
    vacc = lambda what: F.when(dose == 0, VACCINE_EFFECT[what][0]).when(dose == 1, VACCINE_EFFECT[what][1]).otherwise(VACCINE_EFFECT[what][2])
    by_age = lambda young, old: F.when(age < 18, young).when(age > 60, old).otherwise(1.0)
    job = F.coalesce(F.create_map(*[F.lit(x) for kv in OCCUPATION_RISK.items() for x in kv])[F.col("occupation")], F.lit(1.0))
    contact = 1 + F.when(home > 0, BETA_HOUSEHOLD * home).when(near > 0, BETA_CONTACT * near).otherwise(BETA_COMMUNITY)
    place = F.when(F.col("quarantined"), 0.20).otherwise(1.0) * F.when(F.lower("cluster").contains("dorm"), 2.5).otherwise(1.0)
    onset = F.when(days < 2, 0.0).when(days < 4, 0.5).otherwise(F.least(1 + 0.3 * (days - 4), F.lit(2.0)))
    mend = F.when(days < 7, 0.0).when(days < 10, 0.4).otherwise(F.least(1 + 0.2 * (days - 10), F.lit(2.5)))
    ifr = F.when(age < 20, 0.00002).when(age < 50, 0.0005).when(age < 70, 0.005).otherwise(0.07)
    late = F.when(days < 7, 0.05).when(days <= 14, 1.5).otherwise(0.2)
    return {
        "s_e": vacc("exposure") * place * contact * by_age(0.7, 1.3) * (1 + 0.15 * sick) * job * (2 - F.col("compliance_score")),
        "e_i": onset * vacc("progression") * by_age(0.9, 1.3) * (1 + 0.15 * sick),
        "i_r": mend * vacc("recovery") * by_age(1.3, 0.7) * F.pow(F.lit(0.85), sick),
        "i_d": ifr * 0.3 / 0.0015 * late * (1 + 0.5 * sick) * vacc("death"),
        "r_s": F.when(days < IMMUNITY_DAYS, 0.0).otherwise(1.0),
    }


def state_analysis(agents: DataFrame, panel: DataFrame, contacts: DataFrame, cluster: str) -> DataFrame:
    """Per cluster and day: what stands out among the susceptible, exposed, infected, recovered and dead. Days and ages of the flags."""
    rows = panel.select("agent_id", "day", "state", "days_in_state")
    j = agents.join(rows, "agent_id").join(contacts.select("agent_id", "day", "infected"), ["agent_id", "day"], "left")
    at = lambda s, c: F.when(F.col("state") == s, c)
    days, age = F.col("days_in_state"), F.col("age")
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)
    some = lambda s, c: F.count_if((F.col("state") == s) & c)
    span = lambda s, name: [F.min(at(s, days)).alias(f"min_days_{name}"), F.max(at(s, days)).alias(f"max_days_{name}")]
    return j.groupBy(cluster, "day").agg(
        F.count(F.lit(1)).alias("size"), F.count_if(F.col("state").isin("E", "I")).alias("infected"), mean(at("S", F.when(F.col("infected") > 0, F.col("infected")))).alias("mean_infected_contacts"), some("S", F.col("infected") > 0).alias("exposed_susceptible"),
        mean(at("E", days)).alias("avg_days_exposed"), *span("E", "exposed"), some("E", days.between(2, 5)).alias("peak_incubation"),
        mean(at("I", days)).alias("avg_days_infected"), *span("I", "infected"), some("I", days >= 10).alias("overdue"), some("I", age >= 70).alias("elderly_infected"), some("I", (age >= 50) & (age < 70)).alias("middle_aged_infected"),
        some("I", days.between(7, 14)).alias("peak_risk"), some("I", F.col("comorbidity_count") >= 2).alias("comorbid_infected"),
        mean(at("R", days)).alias("avg_days_recovered"), *span("R", "recovered"), some("R", days >= IMMUNITY_DAYS).alias("waning"),
        some("D", days <= 10).alias("mourned"), F.round(F.avg(at("D", age)), 6).alias("mean_age_dead"),
    )


def calibrated(probability: dict[str, Column], dormitory: Column, quarantine: Column, phase: Column, death: Column | None = None) -> dict[str, Column]:
    """Cluster probabilities raised to floors by prevalence, contacts and mean days. Steps of the floors.

    With ``death``, the cluster's death factor, also i_d: none before day 7, a floor that
    grows up to day 14 and none after it.
    """
    prevalence = F.col("infected") / F.col("size")
    push = F.when(dormitory & (prevalence > 0.05), 2.5).otherwise(1.0) * quarantine * phase
    least = F.when(prevalence < 0.10, 0.020).when(prevalence < 0.30, 0.035).otherwise(0.050)
    near = F.greatest(F.lit(0.3), F.least(F.lit(1.0), F.col("mean_infected_contacts") / 3.0))
    e, i = F.col("avg_days_exposed"), F.col("avg_days_infected")
    onset = F.when(e < 2, 0.0).when(e < 3, 0.05).when(e < 4, 0.15).when(e < 5, 0.25).when(e < 6, 0.30).otherwise(0.35)
    mend = F.when(i < 7, 0.0).when(i < 10, 0.05 + 0.017 * (i - 7)).when(i < 14, 0.10 + 0.025 * (i - 10)).otherwise(0.20 + 0.02 * F.least(i - 14, F.lit(5.0)))
    fatal = {}
    if death is not None:
        floor = F.when(i <= 14, 0.002 * 0.3 * death * (i - 7)).otherwise(0.0)
        fatal["i_d"] = F.when(i < 7, 0.0).otherwise(F.greatest(probability["i_d"], floor))
    return fatal | {
        "s_e": F.when(F.col("infected") > 0, F.greatest(probability["s_e"] * push, least * near * push)).otherwise(probability["s_e"]),
        "e_i": F.greatest(probability["e_i"], onset), "i_r": F.greatest(probability["i_r"], F.least(mend, F.lit(0.35))),
    }
