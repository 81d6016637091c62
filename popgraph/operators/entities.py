"""Derived attributes of entities as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from popgraph.functions.draws import categorical, normal, uniform
from popgraph.plans.ranks import global_rank

#: Occupations from 25 to 64 with their weights, and comorbidity weights by age.
OCCUPATIONS = ["healthcare_worker", "teacher", "office_worker", "retail_worker", "service_worker", "manual_worker", "professional", "unemployed"]
OCCUPATION_WEIGHTS = [0.12, 0.08, 0.25, 0.15, 0.15, 0.12, 0.10, 0.03]
YOUNG = (["student", "service_worker", "retail_worker"], [0.5, 0.3, 0.2])
COMORBIDITY = [(30, [0, 1], [0.90, 0.10]), (50, [0, 1, 2], [0.70, 0.22, 0.08]), (70, [0, 1, 2, 3], [0.40, 0.35, 0.18, 0.07]), (None, [1, 2, 3, 4], [0.25, 0.40, 0.25, 0.10])]
#: Fatality by age, upper ends exclusive.
IFR = [(20, 0.00002), (50, 0.0005), (70, 0.005), (120, 0.07)]


def age_group(age: Column, corrected: bool = False) -> Column:
    """Bins 0-17, 18-29, ... 80+; closed on the right as given, on the left if ``corrected``."""
    ends = [(17, "0-17"), (29, "18-29"), (39, "30-39"), (49, "40-49"), (59, "50-59"), (69, "60-69"), (79, "70-79")]
    shift = 0 if corrected else 1
    out = F.when(age.isNull() | (age <= (-1 if corrected else 0)), None)
    for end, name in ends:
        out = out.when(age <= end + shift, name)
    return out.when(age <= 120, "80+")


def infer_occupation(age: Column, key: Column) -> Column:
    u = uniform(key, "occupation")
    return (
        F.when(age < 5, "preschool").when(age < 18, "student").when(age < 25, categorical(u, *YOUNG)).when(age < 65, categorical(u, OCCUPATIONS, OCCUPATION_WEIGHTS)).otherwise("retired")
    )


def infer_household(cluster: Column, index: Column) -> Column:
    low = F.lower(F.coalesce(cluster, F.lit("")))
    n = F.regexp_extract(low, r"family of (\d+)", 1)
    return F.when(n != "", 10000 + n.cast("long")).when(low.contains("dorm"), 20000 + index).otherwise(F.floor(index / (index % 4 + 2)))


def infer_networks(age: Column, index: Column, cluster: Column, hospital: Column) -> tuple[Column, Column]:
    """(work, school) network ids, -1 for none: hospitals and dormitories have networks of their own, by hash of their names."""
    low = F.lower(F.coalesce(cluster, F.lit("")))
    place = lambda name, salt, n: F.floor(uniform(F.coalesce(name, F.lit("")), salt) * n)
    work = F.when(low.contains("hospital") | low.contains("healthcare"), 500 + place(hospital, "hospital", 50)).when(low.contains("dorm"), 1000 + place(low, "dormitory", 100)).otherwise(F.floor(index / 20))
    school = F.when((age >= 5) & (age < 18), F.floor(index / 30)).when((age >= 18) & (age < 25) & (uniform(index, "school") < 0.6), F.floor(index / 40)).otherwise(-1)
    return F.when((age >= 18) & (age < 65), work).otherwise(-1), school


def draw_comorbidity(age: Column, key: Column) -> Column:
    u, out = uniform(key, "comorbidity"), None
    for end, values, weights in COMORBIDITY[:-1]:
        c = categorical(u, values, weights)
        out = F.when(age < end, c) if out is None else out.when(age < end, c)
    return out.otherwise(categorical(u, *COMORBIDITY[-1][1:]))


def mobility_score(age: Column, imported: Column, key: Column) -> Column:
    base = F.when(age < 18, 0.6).when(age > 65, 0.4).otherwise(0.7) + F.when(imported, 0.1).otherwise(0.0)
    return F.greatest(F.lit(0.1), F.least(F.lit(1.0), base + normal(key, "mobility") * 0.1))


def uniform_between(key: Column, salt: str, low: float, high: float) -> Column:
    return low + (high - low) * uniform(key, salt)


def ifr_for_age(age: Column) -> Column:
    out = None
    for end, rate in IFR:
        out = F.when((age >= 0) & (age < end), rate) if out is None else out.when((age >= 0) & (age < end), rate)
    return out.otherwise(0.005)


def daily_hazard(cumulative: Column, days: float) -> Column:
    return 1 - F.pow(1 - cumulative, F.lit(1.0 / days))


def next_transition(state: Column) -> Column:
    return F.create_map(*[F.lit(x) for x in ("S", "S->E", "E", "E->I", "I", "I->R", "R", "R->S")])[state]


def state_code(state: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in zip("SEIRD", range(5), strict=True) for x in kv])[F.upper(F.trim(state))], F.lit(0))


#: Rows that one task ranks; more are ranked in ranges.
ONE_TASK = 10_000


def select_chronological(cases: DataFrame, n: int, keys: tuple = ("date", "case")) -> DataFrame:
    """The first ``n`` cases with dense ids from 0."""
    if n > ONE_TASK:
        ranked = global_rank(cases, list(keys), "agent_id")
        return ranked.where(F.col("agent_id") < n).withColumn("agent_id", F.col("agent_id").cast("int"))
    first = cases.orderBy(*keys).limit(n)
    return first.withColumn("agent_id", F.row_number().over(W.orderBy(*keys)) - 1)


#: The occupations of the entity vector.
ENTITY_JOBS = ["healthcare_worker", "office_worker", "retail_worker", "teacher", "student", "retired"]


def entity_features(a: DataFrame, state: Column, household_size: Column | None = None) -> DataFrame:
    """agent_id and 20 entries: age, occupation, household size (one unless given), vaccination, comorbidity, mobility, compliance, risk awareness, state."""
    hot = lambda c, vs: [F.when(c == v, 1.0).otherwise(0.0) for v in vs]
    home = (F.lit(1.0) if household_size is None else household_size) / 10.0
    f = F.array(
        F.col("age") / 100.0, *hot(F.col("occupation"), ENTITY_JOBS), home, *hot(F.col("vaccination_status"), range(3)), F.col("comorbidity_count") / 5.0,
        F.col("mobility_score"), F.col("compliance_score"), F.col("risk_awareness"), *hot(state, "SEIRD"),
    )
    return a.select("agent_id", f.alias("features"))


def attach_cluster(profiles: DataFrame, assign: DataFrame) -> DataFrame:
    return profiles.join(assign, "agent_id", "left").withColumn("cluster_id", F.coalesce("cluster_id", F.lit(-1)))
