"""Feature vectors of entities, cluster factors, cohorts and resampling weights."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from popgraph.functions.draws import uniform

#: The occupations of the node and panel vectors.
NODE_JOBS = ["student", "healthcare_worker", "teacher", "office_worker", "retail_worker", "service_worker", "manual_worker", "retired"]
PANEL_JOBS = ["healthcare_worker", "office_worker", "retail_worker", "teacher", "student", "retired"]
#: Baseline daily rates of the transitions.
BASELINE_RATES = {"S->E": 0.035, "E->I": 1 / 3.0, "I->R": 1 / 10.0, "I->D": 0.005, "R->S": 1 / 180.0}
#: Fixed values: (occupation, activity, hours); work and school rest on days 5 and 6.
ACTIVITIES = [
    ("healthcare_worker", "work", 10), ("healthcare_worker", "errands", 1), ("office_worker", "work", 8), ("office_worker", "errands", 1),
    ("retail_worker", "work", 8), ("retail_worker", "social", 2), ("teacher", "work", 8), ("teacher", "errands", 1),
    ("student", "school", 7), ("student", "social", 3), ("retired", "errands", 2), ("retired", "social", 3),
]


def one_hot(c: Column, values: list) -> list[Column]:
    return [flag(c == v) for v in values]


def flag(cond: Column) -> Column:
    return F.when(cond, 1.0).otherwise(0.0)


def node_features(agents: DataFrame, degrees: DataFrame) -> DataFrame:
    """agent_id and the 27 entries of a node: age, job, vaccination, health, behaviour, degree, gender, origin, first state."""
    a = agents.join(degrees, "agent_id", "left")
    gender = F.lower(F.coalesce("gender", F.lit("")))
    f = F.array(
        F.col("age") / 100.0, *one_hot(F.col("occupation"), NODE_JOBS), *one_hot(F.col("vaccination_status"), [0, 1, 2]), F.col("comorbidity_count") / 5.0,
        F.coalesce("mobility_score", F.lit(0.5)), F.coalesce("compliance_score", F.lit(0.5)), F.coalesce("risk_awareness", F.lit(0.5)), F.coalesce("degree", F.lit(0)) / 50.0,
        flag(gender == "m"), flag(gender == "f"), flag(~gender.isin("m", "f")), flag(F.col("is_imported")), F.coalesce("days_since_start", F.lit(0)) / 100.0, *one_hot(F.col("disease_status"), list(range(5))),
    )
    return a.select("agent_id", F.transform(f, lambda x: F.round(x, 6)).alias("features"))


def context_features(agents: DataFrame, degrees: DataFrame) -> DataFrame:
    """agent_id and ten entries: profile scores, degree and three groups of occupations."""
    a = agents.join(degrees, "agent_id", "left")
    care, study = F.col("occupation") == "healthcare_worker", F.col("occupation").isin("student", "teacher")
    f = F.array(
        F.col("age") / 100.0, F.col("vaccination_status") / 2.0, F.col("comorbidity_count") / 5.0, F.coalesce("compliance_score", F.lit(0.7)), F.coalesce("risk_awareness", F.lit(0.5)),
        F.coalesce("mobility_score", F.lit(0.7)), F.coalesce("degree", F.lit(0)) / 50.0, flag(care), flag(study), F.when(care | study, 0.0).otherwise(1.0),
    )
    return a.select("agent_id", F.transform(f, lambda x: F.round(x, 6)).alias("features"))


def raw_features(agents: DataFrame) -> DataFrame:
    """agent_id, age / 100, gender and one entry per occupation of the data, in order of name."""
    jobs = agents.select("occupation").where("occupation is not null").distinct()
    ranked = jobs.withColumn("_at", F.row_number().over(W.orderBy("occupation")))  # one row per occupation
    total = ranked.agg(F.count(F.lit(1)).alias("_k"))
    a = agents.join(ranked, "occupation", "left").crossJoin(F.broadcast(total))
    gender = F.lower(F.coalesce("gender", F.lit("")))
    hot = F.transform(F.sequence(F.lit(1), F.greatest("_k", F.lit(1)).cast("int")), lambda i: flag(i.eqNullSafe(F.col("_at"))))
    return a.select("agent_id", F.concat(F.array(F.round(F.col("age") / 100.0, 6), flag(gender == "m"), flag(gender == "f"), flag(~gender.isin("m", "f"))), hot).alias("features"))


def panel_features(agents: DataFrame, panel: DataFrame, neighbor_states: DataFrame) -> DataFrame:
    """agent_id, day and 21 entries of an entity on that day; no contacts give a share of zero."""
    near = neighbor_states.select("agent_id", "day", "contacts", "infected")
    a = agents.join(panel.select("agent_id", "day", "days_in_state"), "agent_id").join(near, ["agent_id", "day"], "left")
    share = F.coalesce(F.col("infected") / F.greatest("contacts", F.lit(1)), F.lit(0.0))
    f = F.array(
        F.col("age") / 100.0, *one_hot(F.col("occupation"), PANEL_JOBS), F.lit(0.1), flag(F.col("is_imported")), flag(F.col("quarantined")), flag(F.lower("cluster").contains("dorm")),
        *one_hot(F.col("vaccination_status"), [0, 1, 2]), F.col("comorbidity_count") / 5.0, F.col("mobility_score"), F.col("compliance_score"), F.col("risk_awareness"),
        F.least(F.col("days_in_state") / 20.0, F.lit(1.0)), share, flag(F.col("isolated")),
    )
    return a.select("agent_id", "day", F.transform(f, lambda x: F.round(x, 6)).alias("features"))


def baseline_rate(transition: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in BASELINE_RATES.items() for x in kv])[transition], F.lit(0.0))


def activity_schedule(agents: DataFrame, weekday: Column) -> DataFrame:
    """(agent_id, activities, hours) of a weekday from 0; occupations without a plan have none."""
    plan = agents.sparkSession.createDataFrame(ACTIVITIES, "occupation string, activity string, hours int")
    a = agents.withColumn("_day", weekday).join(F.broadcast(plan), "occupation", "left")
    held = F.col("activity").isNotNull() & ~(F.col("activity").isin("work", "school") & (F.col("_day") >= 5))
    return a.groupBy("agent_id").agg(F.count_if(held).alias("activities"), F.coalesce(F.sum(F.when(held, F.col("hours"))), F.lit(0)).alias("hours"))


def attach_motifs(traces: DataFrame, motifs: DataFrame, key: str) -> DataFrame:
    """Each trace with the ``motif`` of its entity; ``unclassified`` where it has none."""
    return traces.join(motifs.select(key, "motif"), key, "left").withColumn("motif", F.coalesce("motif", F.lit("unclassified")))


def negative_pairs(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """One drawn pair per edge: (agent_1, agent_2, neg_1, neg_2), ids dense from the smallest."""
    n = F.broadcast(entities.agg(F.count(F.lit(1)).alias("_n"), F.min("agent_id").alias("_low")))
    key = F.concat_ws("-", "agent_1", "agent_2")
    draw = lambda salt: F.floor(uniform(key, salt) * F.col("_n")) + F.col("_low")
    return edges.crossJoin(n).select("agent_1", "agent_2", draw("neg-1").alias("neg_1"), draw("neg-2").alias("neg_2"))


def dormitory_flags(agents: DataFrame, cluster: str) -> DataFrame:
    """Both rules per cluster: over 30 % by text or over half by occupation; over half by either."""
    dorm, manual = flag(F.lower("cluster").contains("dorm")), flag(F.col("occupation") == "manual_worker")
    by = agents.groupBy(cluster).agg(F.avg(dorm).alias("_d"), F.avg(manual).alias("_m"))
    return by.select(cluster, ((F.col("_d") > 0.3) | (F.col("_m") > 0.5)).alias("is_dormitory"), ((F.col("_d") > 0.5) | (F.col("_m") > 0.5)).alias("is_dormitory_strict"))


def quarantine_factor(agents: DataFrame, cluster: str) -> DataFrame:
    """(cluster, factor): 1 - 0.8 of the share under quarantine, at least 0.1."""
    return agents.groupBy(cluster).agg(F.round(F.greatest(F.lit(0.1), 1 - 0.8 * F.avg(flag(F.col("quarantined")))), 6).alias("factor"))


def death_factor(agents: DataFrame, panel: DataFrame, cluster: str) -> DataFrame:
    """(cluster, day, factor): mean fatality factor of the infected, 1 where none is. Fixed values by age, health, vaccine."""
    age = F.when(F.col("age") < 20, 0.01).when(F.col("age") < 50, 0.25).when(F.col("age") < 70, 2.5).otherwise(35.0)
    health = F.when(F.col("comorbidity_count") >= 2, 1.8).when(F.col("comorbidity_count") == 1, 1.3).otherwise(1.0)
    vaccine = F.when(F.col("vaccination_status") >= 2, 0.1).when(F.col("vaccination_status") == 1, 0.3).otherwise(1.0)
    j = agents.join(panel.select("agent_id", "day", "state"), "agent_id")
    return j.groupBy(cluster, "day").agg(F.round(F.coalesce(F.avg(F.when(F.col("state") == "I", age * health * vaccine)), F.lit(1.0)), 6).alias("factor"))


def death_probability(age: Column, days: Column, comorbidity: Column, vaccination: Column) -> Column:
    """Daily probability, at most 0.2. Fatality by age, share by days, health and vaccine."""
    base = F.when(age < 20, 0.00002).when(age < 50, 0.0005).when(age < 70, 0.005).otherwise(0.07)
    share = F.when(days < 7, 0.1).when(days < 14, 0.3).otherwise(0.05)
    return F.least(base * share * (1 + 0.8 * comorbidity) * F.when(vaccination == 2, 0.1).when(vaccination == 1, 0.3).otherwise(1.0), F.lit(0.2))


def individual_probabilities(state: Column, death: Column, recovery: Column, other: Column, multiplier: Column) -> dict[str, Column]:
    """die, recover and stay of the infected as competing hazards; change for the others in 0.001 to 0.8."""
    ifr = F.least(death * multiplier, F.lit(0.40))
    die = F.when(ifr <= 0, 0.0).otherwise(1 - F.pow(1 - ifr, F.lit(0.1)))
    recover = F.least(recovery * multiplier, F.lit(0.90))
    sick = state == "I"
    return {
        "die": F.when(sick, die).otherwise(0.0), "recover": F.when(sick, recover).otherwise(0.0), "stay": F.when(sick, F.greatest(1 - die - recover, F.lit(0.0))).otherwise(0.0),
        "change": F.when(~sick, F.least(F.greatest(other * multiplier, F.lit(0.001)), F.lit(0.80))),
    }


def oversample(df: DataFrame, rates: list[str], key: Column, factor: float = 3.0) -> DataFrame:
    """Rows repeated by weight to about the same total: ``weight`` and ``copy`` from 1.

    A row with any transition weighs ``factor``, with more than 0.01 of them half as much
    again. Its expected copies are rounded up or down by a draw from ``key``; the total of
    weights is one row.
    """
    score = sum((F.col(c) for c in rates), F.lit(0.0))
    w = df.withColumn("weight", F.when(score > 0.001, factor).otherwise(1.0) * F.when(score > 0.01, 1.5).otherwise(1.0))
    total = F.broadcast(w.agg(F.sum("weight").alias("_w"), F.count(F.lit(1)).alias("_n")))
    expected = F.col("weight") * F.col("_n") / F.col("_w")
    copies = (F.floor(expected) + F.when(uniform(key, "oversample") < expected - F.floor(expected), 1).otherwise(0)).cast("int")
    r = w.crossJoin(total).withColumn("_c", copies).where("_c > 0")
    return r.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_c")))).drop("_c", "_w", "_n")


def scale_initial_counts(counts: DataFrame, target: int) -> DataFrame:
    """S, E, I, R and D of ``target`` entities from one row of counts: E and I scaled and cut to integers, S the rest."""
    total = F.col("S") + F.col("E") + F.col("I") + F.col("R") + F.col("D")
    grow = F.lit(float(target)) / total
    some = F.col("E") + F.col("I") > 0
    c = counts.select(F.when(some, F.floor(F.col("E") * grow)).otherwise(10).cast("long").alias("E"), F.when(some, F.floor(F.col("I") * grow)).otherwise(10).cast("long").alias("I"))
    over = F.col("E") + F.col("I") > target
    shrink = F.lit(target * 0.98) / (F.col("E") + F.col("I"))
    c = c.select(*[F.when(over, F.floor(F.col(x) * shrink)).otherwise(F.col(x)).cast("long").alias(x) for x in ("E", "I")])
    return c.select((F.lit(target) - F.col("E") - F.col("I")).alias("S"), "E", "I", F.lit(0).cast("long").alias("R"), F.lit(0).cast("long").alias("D"))


def largest_groups(df: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` most frequent values of ``key``, ties to the smaller."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_c")).orderBy(F.desc("_c"), key).limit(n).select(key)


# Occupations that count as essential and how scenarios begin.
ESSENTIAL = ("healthcare_worker", "service_worker", "retail_worker")
SCENARIOS = ("imported_cases", "dormitory_cluster", "community_clusters", "circuit_breaker", "community")


def _drawn(rows: DataFrame, salt: str, most: int) -> DataFrame:
    """(agent_id, household_id, _r, _n): the first ``most`` rows in the order of a hash, their place from 1 and the number of all rows."""
    u = uniform(F.col("agent_id"), salt)
    first = rows.select("agent_id", "household_id", u.alias("_u")).orderBy("_u", "agent_id").limit(most)
    ranked = first.withColumn("_r", F.row_number().over(W.orderBy("_u", "agent_id"))).drop("_u")  # ``most`` rows
    return ranked.crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("_n"))))


def _drawn_in(rows: DataFrame, key: str, salt: str, most: int) -> DataFrame:
    """The same within each value of ``key``, without ``_n``; ranks beyond ``most`` are cut in every task before rows meet."""
    order = W.partitionBy(key).orderBy(uniform(F.col("agent_id"), salt), "agent_id")
    return rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most)


def _begin(rows: DataFrame, scenario: str, infected: Column, exposed: Column | int = 0) -> DataFrame:
    """The first ``infected`` places are I, the next ``exposed`` are E."""
    told = rows.withColumn("role", F.when(F.col("_r") <= infected, "I").when(F.col("_r") <= infected + exposed, "E"))
    return told.where("role is not null").select(F.lit(scenario).alias("scenario"), "agent_id", "household_id", "role")


def scenario_cohorts(agents: DataFrame) -> DataFrame:
    """(scenario, agent_id, role, days_in_state): who is infected (I) or exposed (E) when a scenario begins.

    ``agents``: agent_id, household_id, work_network (null: none), cluster, occupation and
    is_imported. Draws follow a hash of id and scenario, without repetition: the exposed
    are drawn from those left. ``imported_cases``: 3 of the imported and 2 exposed of them;
    ``dormitory_cluster``: 8 to 12 (a twentieth) of the dormitories and up to 15 exposed if
    10 are left; ``community_clusters``: in the three largest households a third, 1 or 2,
    and up to 2 exposed, then 3 of those left in the largest workplace;
    ``circuit_breaker``: 4 essential workers and up to 2 exposed in each of their
    households; ``community``: 3 of all and 2 exposed. Where a scenario has too few to draw
    from (3, 10, -, 3), it begins with 3, 8, -, 3 of all. Fewer rows than wanted are all
    taken; among groups of one size the smaller key comes first. Infected have been so
    for 2 to 6 days, exposed for 1 to 3.
    """
    anyone = lambda scenario, k: _drawn(agents, f"{scenario}-any", k)
    n = F.col("_n")
    out = []

    name = SCENARIOS[0]
    imported = _drawn(agents.where("is_imported"), name, 5)
    out.append(_begin(imported.where(n >= 3), name, F.lit(3), F.when(n - 3 >= 2, 2).otherwise(0)))
    few = agents.where("is_imported").agg(F.count(F.lit(1)).alias("_few")).where("_few < 3")
    out.append(_begin(anyone(name, 3).crossJoin(F.broadcast(few)), name, F.lit(3)))

    name = SCENARIOS[1]
    dormitory = agents.where(F.lower("cluster").contains("dorm"))
    ill = F.least(F.lit(12), F.greatest(F.lit(8), F.floor(n / 20)))
    out.append(_begin(_drawn(dormitory, name, 27).where(n >= 10), name, ill, F.when(n - ill >= 10, F.least(F.lit(15), n - ill)).otherwise(0)))
    few = dormitory.agg(F.count(F.lit(1)).alias("_few")).where("_few < 10")
    out.append(_begin(anyone(name, 8).crossJoin(F.broadcast(few)), name, F.lit(8)))

    name = SCENARIOS[2]
    sizes = agents.where("household_id is not null").groupBy("household_id").agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), "household_id").limit(3)
    homes = _drawn_in(agents.join(F.broadcast(sizes), "household_id"), "household_id", name, 4)
    ill = F.least(F.lit(2), F.greatest(F.lit(1), F.floor(n / 3)))
    homes = _begin(homes, name, ill, F.least(F.lit(2), n - ill))
    left = agents.where("work_network is not null").join(F.broadcast(homes.select("agent_id")), "agent_id", "left_anti")  # twelve rows at most
    place = F.broadcast(largest_groups(left, "work_network", 1))
    out += [homes, _begin(_drawn(left.join(place, "work_network", "left_semi"), f"{name}-work", 3), name, F.lit(3))]

    name = SCENARIOS[3]
    essential = agents.where(F.col("occupation").isin(*ESSENTIAL))
    few = essential.agg(F.count(F.lit(1)).alias("_few")).where("_few < 3")
    ill = _begin(_drawn(essential, name, 4).where(n >= 3), name, F.lit(4)).unionByName(_begin(anyone(name, 3).crossJoin(F.broadcast(few)), name, F.lit(3)))
    near = agents.join(F.broadcast(ill.select("household_id").distinct()), "household_id", "left_semi").join(F.broadcast(ill.select("agent_id")), "agent_id", "left_anti")
    out += [ill, _begin(_drawn_in(near, "household_id", f"{name}-home", 2), name, F.lit(0), F.lit(2))]

    name = SCENARIOS[4]
    out.append(_begin(anyone(name, 5), name, F.lit(3), F.when(n - 3 >= 2, 2).otherwise(0)))

    days = F.when(F.col("role") == "I", 2 + F.floor(5 * uniform(F.concat_ws("-", "scenario", "agent_id"), "days"))).otherwise(1 + F.floor(3 * uniform(F.concat_ws("-", "scenario", "agent_id"), "days")))
    return reduce(DataFrame.unionByName, out).select("scenario", "agent_id", "role", days.cast("int").alias("days_in_state"))


def keep_top_labels(df: DataFrame, col: str, k: int, otherwise: str) -> DataFrame:
    """``col`` where it is one of the ``k`` most frequent values, else ``otherwise``."""
    top = largest_groups(df, col, k).withColumn("_kept", F.lit(True))
    return df.join(F.broadcast(top), col, "left").withColumn(col, F.when(F.col("_kept"), F.col(col)).otherwise(otherwise)).drop("_kept")


def category_counts(df: DataFrame, col: str) -> DataFrame:
    """(category, n, share) of the values of ``col``, null among them."""
    c = df.groupBy(F.col(col).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return c.crossJoin(F.broadcast(c.agg(F.sum("n").alias("_t")))).select("category", "n", F.round(F.col("n") / F.col("_t"), 6).alias("share"))  # one row of total


def json_in_text(text: Column, bounds: str = "{}") -> Column:
    """VARIANT of the JSON between the first and the last of ``bounds`` in a text; null where there is none or it is broken.

    It is read as the only item of an array, since the parser does not mind what follows a value.
    """
    span = F.nullif(F.regexp_extract(text, rf"(?s)\{bounds[0]}.*\{bounds[1]}", 0), F.lit(""))
    items = F.try_parse_json(F.concat(F.lit("["), span, F.lit("]")))
    return F.when(F.try_variant_get(items, "$[1]", "variant").isNull(), F.try_variant_get(items, "$[0]", "variant"))


def extract_json(text: Column, fields: dict[str, str], defaults: dict, without: dict | None = None) -> list[Column]:
    """Fields of the JSON object inside a text, nested values included.

    ``fields``: name to type; of type ``json`` the value comes as text. A field that is
    absent, null or of another type, and every field of a broken object, has its value of
    ``defaults``; a text without braces has the values of ``without``, if given.
    """
    found = json_in_text(text)
    none = ~text.contains("{") | ~text.contains("}") | text.isNull()
    out = []
    for name, kind in fields.items():
        path = f"$['{name}']"
        value = F.to_json(F.try_variant_get(found, path, "variant")) if kind == "json" else F.try_variant_get(found, path, kind)
        value = F.coalesce(F.nullif(value, F.lit("null")) if kind == "json" else value, F.lit(defaults[name]))
        out.append((F.when(none, F.lit(without[name])).otherwise(value) if without else value).alias(name))
    return out


def extract_json_rows(df: DataFrame, text: str, key: str, fields: dict[str, str]) -> DataFrame:
    """A row for each object with field ``key`` in the JSON array inside column ``text``: the other columns of ``df``, ``key`` and ``fields`` (null where absent)."""
    items = F.explode(F.try_variant_get(json_in_text(F.col(text), "[]"), "$", "array<variant>"))
    rows = df.select(*[c for c in df.columns if c != text], items.alias("_item"))
    get = lambda name, kind: F.try_variant_get("_item", f"$['{name}']", kind).alias(name)
    return rows.select(*[c for c in df.columns if c != text], get(key, "string"), *[get(n, k) for n, k in fields.items()]).where(F.col(key).isNotNull())
