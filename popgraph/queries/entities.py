"""Queries of derived attributes, risk and text (B, C8 to C12, H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from popgraph.functions.draws import uniform
from popgraph.operators import entities as E
from popgraph.operators import risk as R
from popgraph.operators import text as T
from popgraph.operators.samples import stringency
from popgraph.plans.stage import stage
from popgraph.queries.base import U, agents, neighbors, query, read
from popgraph.queries.networks import cases
from popgraph.queries.panels import panel


def cat(u, values, weights):
    out, total = "CASE", 0.0
    for v, w in zip(values[:-1], weights[:-1], strict=True):
        total = round(total + w, 9)
        out += f" WHEN {u} < {total} THEN {v!r}"
    return f"{out} ELSE {values[-1]!r} END"


@query("""SELECT o_orderkey AS "case", CAST(o_orderdate AS DATE) AS date, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS agent_id FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 500""")
def b1_select_chronological(s, d):
    return E.select_chronological(cases(s, d), 500).select("case", "date", "agent_id")


@query("""SELECT agent_id, CASE WHEN age <= 0 THEN NULL WHEN age <= 18 THEN '0-17' WHEN age <= 30 THEN '18-29' WHEN age <= 40 THEN '30-39' WHEN age <= 50 THEN '40-49' WHEN age <= 60 THEN '50-59' WHEN age <= 70 THEN '60-69' WHEN age <= 80 THEN '70-79' ELSE '80+' END AS age_group FROM agents""")
def b2_age_group(s, d):
    return agents(s, d).select("agent_id", E.age_group(F.col("age")).alias("age_group"))


@query("""SELECT o_orderkey AS "case", date_diff('day', DATE '1996-01-01', CAST(o_orderdate AS DATE)) AS days, o_orderstatus <> 'P' AS imported FROM orders""")
def b4_days_since(s, d):
    o = read(s, d, "orders")
    return o.select(F.col("o_orderkey").alias("case"), F.datediff(F.to_date("o_orderdate"), F.lit("1996-01-01").cast("date")).alias("days"), (F.col("o_orderstatus") != "P").alias("imported"))


@query("SELECT agent_id, day, CASE state WHEN 'E' THEN 1 WHEN 'I' THEN 2 WHEN 'R' THEN 3 WHEN 'D' THEN 4 ELSE 0 END AS code, CASE state WHEN 'S' THEN 'S->E' WHEN 'E' THEN 'E->I' WHEN 'I' THEN 'I->R' WHEN 'R' THEN 'R->S' END AS next FROM panel")
def b5_state_code(s, d):
    return panel(s, d).select("agent_id", "day", E.state_code(F.col("state")).alias("code"), E.next_transition(F.col("state")).alias("next"))


_OCC = U.format("occupation", "agent_id")


@query(f"SELECT agent_id, CASE WHEN age < 5 THEN 'preschool' WHEN age < 18 THEN 'student' WHEN age < 25 THEN {cat(_OCC, *E.YOUNG)} WHEN age < 65 THEN {cat(_OCC, E.OCCUPATIONS, E.OCCUPATION_WEIGHTS)} ELSE 'retired' END AS job FROM agents")
def b6_infer_occupation(s, d):
    return agents(s, d).select("agent_id", E.infer_occupation(F.col("age"), F.col("agent_id")).alias("job"))


@query("SELECT agent_id, CASE WHEN agent_id % 7 = 0 THEN 10000 + agent_id % 9 WHEN agent_id % 11 = 0 THEN 20000 + agent_id ELSE agent_id // (agent_id % 4 + 2) END AS household FROM agents")
def b7_infer_household(s, d):
    said = F.when(F.col("agent_id") % 7 == 0, F.concat(F.lit("Family of "), (F.col("agent_id") % 9).cast("string"))).when(F.col("agent_id") % 11 == 0, "North Dorm")
    return agents(s, d).select("agent_id", E.infer_household(said, F.col("agent_id")).alias("household"))


_PLACE = "CASE WHEN agent_id % 13 = 0 THEN 'General Hospital' WHEN agent_id % 11 = 0 THEN 'North Dorm ' || agent_id % 5 END"


@query(f"""SELECT agent_id, CAST(CASE WHEN age >= 18 AND age < 65 THEN CASE WHEN agent_id % 13 = 0 THEN 500 + floor({U.format('hospital', "('H' || agent_id % 7)")} * 50) WHEN agent_id % 11 = 0 THEN 1000 + floor({U.format('dormitory', "('north dorm ' || agent_id % 5)")} * 100) ELSE agent_id // 20 END ELSE -1 END AS BIGINT) AS work,
CASE WHEN age >= 5 AND age < 18 THEN agent_id // 30 WHEN age >= 18 AND age < 25 AND {U.format('school', 'agent_id')} < 0.6 THEN agent_id // 40 ELSE -1 END AS school FROM agents""")
def b8_infer_networks(s, d):
    w, c = E.infer_networks(F.col("age"), F.col("agent_id"), F.expr(_PLACE), F.concat(F.lit("H"), (F.col("agent_id") % 7).cast("string")))
    return agents(s, d).select("agent_id", w.alias("work"), c.alias("school"))


_COM = U.format("comorbidity", "agent_id")


@query("SELECT agent_id, CASE " + " ".join(f"WHEN age < {e} THEN {cat(_COM, v, w)}" for e, v, w in E.COMORBIDITY[:-1]) + f" ELSE {cat(_COM, *E.COMORBIDITY[-1][1:])} END AS comorbidities FROM agents")
def b9_comorbidity(s, d):
    return agents(s, d).select("agent_id", E.draw_comorbidity(F.col("age"), F.col("agent_id")).alias("comorbidities"))


_NORM = f"sqrt(-2 * ln(1 - {U.format('mobility-a', 'agent_id')})) * cos(2 * 3.141592653589793::DOUBLE * {U.format('mobility-b', 'agent_id')})"


@query(f"SELECT agent_id, round(greatest(0.1, least(1.0, CASE WHEN age < 18 THEN 0.6 WHEN age > 65 THEN 0.4 ELSE 0.7 END::DOUBLE + CASE WHEN is_imported THEN 0.1 ELSE 0.0 END::DOUBLE + {_NORM} * 0.1)), 6) AS mobility, round(0.3 + 0.6 * {U.format('compliance', 'agent_id')}, 6) AS compliance FROM agents")
def b10_mobility_score(s, d):
    k = F.col("agent_id")
    return agents(s, d).select("agent_id", F.round(E.mobility_score(F.col("age"), F.col("is_imported"), k), 6).alias("mobility"), F.round(E.uniform_between(k, "compliance", 0.3, 0.9), 6).alias("compliance"))


@query(f"SELECT agent_id, round({U.format('x', 'agent_id')}, 9) AS u FROM agents")
def b11_uniform(s, d):
    return agents(s, d).select("agent_id", F.round(uniform(F.col("agent_id"), "x"), 9).alias("u"))


_IS = lambda c, vs: ", ".join(f"CASE WHEN {c} = {v!r} THEN 1 ELSE 0 END" for v in vs)
_JOB = f"CASE WHEN age < 5 THEN 'preschool' WHEN age < 18 THEN 'student' WHEN age < 25 THEN {cat(_OCC, *E.YOUNG)} WHEN age < 65 THEN {cat(_OCC, E.OCCUPATIONS, E.OCCUPATION_WEIGHTS)} ELSE 'retired' END"
_FIRST = "substr('SEIRD', CAST(agent_id % 5 + 1 AS INTEGER), 1)"


@query(f"SELECT agent_id, [round(x::DOUBLE, 6) FOR x IN [age / 100, {_IS('job', E.ENTITY_JOBS)}, 0.1, {_IS('vaccination_status', range(3))}, comorbidity_count / 5, agent_id % 7 / 10.0, compliance_score::DOUBLE, agent_id % 9 / 10.0, {_IS('st', 'SEIRD')}]] AS features FROM (SELECT *, {_JOB} AS job, {_FIRST} AS st FROM agents)")
def b15_entity_features(s, d):
    k = F.col("agent_id")
    a = agents(s, d).withColumns({"occupation": E.infer_occupation(F.col("age"), k), "mobility_score": k % 7 / 10.0, "risk_awareness": k % 9 / 10.0})
    return E.entity_features(a, F.expr(_FIRST)).select("agent_id", F.transform("features", lambda x: F.round(x.cast("double"), 6)).alias("features"))


@query("SELECT agent_id, CASE WHEN age < 20 THEN 0.00002 WHEN age < 50 THEN 0.0005 WHEN age < 70 THEN 0.005 ELSE 0.07 END::DOUBLE AS ifr, round(1 - pow(1 - CASE WHEN age < 20 THEN 0.00002 WHEN age < 50 THEN 0.0005 WHEN age < 70 THEN 0.005 ELSE 0.07 END::DOUBLE, 0.1), 9) AS hazard FROM agents")
def b18_ifr_and_hazard(s, d):
    ifr = E.ifr_for_age(F.col("age"))
    return agents(s, d).select("agent_id", ifr.alias("ifr"), F.round(E.daily_hazard(ifr, 10), 9).alias("hazard"))


@query("SELECT DISTINCT day, CASE WHEN day < 50 THEN 0.3 WHEN day < 110 THEN 0.9 ELSE 0.6 END::DOUBLE AS stringency FROM (SELECT date_diff('day', DATE '1996-01-01', CAST(o_orderdate AS DATE)) AS day FROM orders)")
def b21_stringency(s, d):
    days = read(s, d, "orders").select(F.datediff(F.to_date("o_orderdate"), F.lit("1996-01-01").cast("date")).alias("day")).distinct()
    return days.select("day", stringency(F.col("day")).alias("stringency"))


@query("SELECT a.agent_id, coalesce(c.cluster_id, -1) AS cluster_id FROM agents a LEFT JOIN (SELECT DISTINCT agent_id, cluster_id FROM panel) c USING (agent_id)")
def a9_attach_cluster(s, d):
    return E.attach_cluster(agents(s, d).select("agent_id"), panel(s, d).select("agent_id", "cluster_id").distinct())


#: Contact counts of entity and day.
_NBS = """, nbs AS (SELECT n.agent_id, p.day, count(*) AS contacts, count(*) FILTER (p.state IN ('E', 'I')) AS infected, count(*) FILTER (p.state IN ('E', 'I') AND b.household_id = a.household_id) AS household_infected,
 count(*) FILTER (p.state IN ('E', 'I') AND b.cluster LIKE '%dorm%') AS dormitory_infected, count(*) FILTER (p.state = 'D' AND p.days_in_state <= 10) AS dead, count(*) FILTER (p.state = 'D' AND p.days_in_state <= 10 AND b.household_id = a.household_id) AS household_dead
FROM nb n JOIN panel p ON p.agent_id = n.other_id JOIN agents b ON b.agent_id = n.other_id JOIN agents a ON a.agent_id = n.agent_id GROUP BY n.agent_id, p.day)"""


def contacts(s, d):
    return R.neighbor_states(neighbors(s, d), panel(s, d), agents(s, d))


@query(_NBS + " SELECT *, round(infected / contacts, 6) AS share FROM nbs")
def c8_neighbor_states(s, d):
    return contacts(s, d)


@query(""" SELECT p.cluster_id, q.cluster_id AS other_cluster, p.day, count(*) AS contacts, count(*) FILTER (q.state IN ('E', 'I')) AS infected
FROM nb n JOIN panel p ON p.agent_id = n.agent_id JOIN panel q ON q.agent_id = n.other_id AND q.day = p.day WHERE p.cluster_id <> q.cluster_id GROUP BY ALL""")
def c9_cluster_context(s, d):
    return R.cluster_context(neighbors(s, d), panel(s, d), "cluster_id")


@query("""SELECT n.agent_id, p.day, count(*) AS contacts, round(sum(0.05::DOUBLE * CASE WHEN a.household_id = b.household_id THEN 3.0 ELSE 0.8 END * (1 - CASE a.vaccination_status WHEN 1 THEN 0.5 WHEN 2 THEN 0.8 ELSE 0.0 END) * (1 - a.compliance_score * 0.5)
 * CASE WHEN a.age < 18 THEN 0.6 WHEN a.age > 60 THEN 1.3 ELSE 1.0 END * (1 + a.comorbidity_count * 0.15)), 6) AS risk
FROM nb n JOIN panel q ON q.agent_id = n.other_id AND q.state IN ('E', 'I') JOIN panel p ON p.agent_id = n.agent_id AND p.day = q.day AND p.state IN ('S', 'R') JOIN agents a ON a.agent_id = n.agent_id JOIN agents b ON b.agent_id = n.other_id GROUP BY n.agent_id, p.day""")
def c12_exposure_risk(s, d):
    return R.exposure_risk(neighbors(s, d), panel(s, d), agents(s, d))


@query(""", pa AS (SELECT panel.* EXCLUDE (cluster_id), agents.* EXCLUDE (agent_id) FROM panel JOIN agents USING (agent_id)) SELECT agent_id, day, CASE state WHEN 'S' THEN 'susceptible' WHEN 'E' THEN CASE WHEN days_in_state < 3 THEN 'early_incubation' ELSE 'late_incubation' END WHEN 'I' THEN CASE WHEN days_in_state < 5 THEN 'early_infection' WHEN days_in_state < 10 THEN 'active_infection' ELSE 'prolonged_infection' END
 WHEN 'R' THEN CASE WHEN days_in_state < 90 THEN 'strong_immunity' WHEN days_in_state < 180 THEN 'waning_immunity' ELSE 'weak_immunity' END ELSE 'deceased' END AS stage,
 CASE WHEN state = 'R' THEN CASE WHEN days_in_state < 90 THEN 0.95 WHEN days_in_state < 180 THEN 0.8 ELSE 0.5 END END::DOUBLE AS protection,
 CASE WHEN state = 'I' THEN round(0.10::DOUBLE * CASE WHEN days_in_state < 5 THEN 0.3 WHEN days_in_state < 10 THEN 1.0 ELSE 2.0 END * CASE vaccination_status WHEN 2 THEN 1.3 WHEN 1 THEN 1.15 ELSE 1.0 END * CASE WHEN age < 18 THEN 1.3 WHEN age > 60 THEN 0.7 ELSE 1.0 END * pow(0.85::DOUBLE, comorbidity_count), 6) END AS recovery FROM pa""")
def h20_recovery_probability(s, d):
    p = panel(s, d).drop("cluster_id").join(agents(s, d), "agent_id")
    told = R.progression(F.col("state"), F.col("days_in_state"), F.col("vaccination_status"), F.col("age"), F.col("comorbidity_count"))
    return p.select("agent_id", "day", told["stage"].alias("stage"), told["protection"].alias("protection"), F.round(told["recovery"], 6).alias("recovery"))


_V = lambda a, b, c: f"CASE vaccination_status WHEN 0 THEN {a} WHEN 1 THEN {b} ELSE {c} END::DOUBLE"


# the panel's 30 days don't reach a recovered entity's 180th: each counts for 13
@query(_NBS + f""", pa AS (SELECT p.agent_id, p.day, p.state, a.* EXCLUDE (agent_id), coalesce(household_infected, 0) AS hi, coalesce(infected, 0) - coalesce(household_infected, 0) AS oi, CASE WHEN p.state = 'R' THEN 13 * days_in_state ELSE days_in_state END AS dd, p.agent_id % 13 = 0 AS quarantined FROM panel p JOIN (SELECT *, {_JOB} AS job FROM agents) a ON a.agent_id = p.agent_id LEFT JOIN nbs ON nbs.agent_id = p.agent_id AND nbs.day = p.day)
SELECT agent_id, day, state, CASE WHEN state = 'S' THEN round(least(0.3, CASE WHEN hi + oi = 0 THEN 0.002::DOUBLE ELSE 0.014::DOUBLE * hi + 0.007::DOUBLE * oi END * CASE WHEN cluster = 'dormitory' OR job = 'manual_worker' THEN 2.5 ELSE 1.0 END * CASE WHEN quarantined THEN 0.2 ELSE 1.0 END::DOUBLE * {_V(1.0, 0.65, 0.35)} * CASE WHEN age < 18 THEN 0.6 WHEN age > 65 THEN 1.4 ELSE 1.0 END::DOUBLE * (2.2 - 1.5 * compliance_score)), 6) ELSE 0.0 END AS s_e,
CASE WHEN state = 'E' THEN round(least(0.5, CASE WHEN dd < 2 THEN 0.0 WHEN dd = 2 THEN 0.05 WHEN dd = 3 THEN 0.15 WHEN dd = 4 THEN 0.25 ELSE 0.35 END::DOUBLE * {_V(1.0, 0.85, 0.70)} * CASE WHEN age < 18 THEN 0.9 WHEN age > 60 THEN 1.3 ELSE 1.0 END::DOUBLE), 6) ELSE 0.0 END AS e_i,
CASE WHEN state = 'I' AND dd >= 7 THEN round(least(0.4, CASE WHEN dd = 7 THEN 0.05 WHEN dd < 10 THEN 0.05 + 0.02 * (dd - 7) WHEN dd < 14 THEN 0.10 + 0.025 * (dd - 10) ELSE 0.20 + 0.02 * least(dd - 14, 5) END::DOUBLE * 1.3::DOUBLE * {_V(1.0, 1.2, 1.4)} * CASE WHEN age < 18 THEN 1.3 WHEN age > 60 THEN 0.7 ELSE 1.0 END::DOUBLE), 6) ELSE 0.0 END AS i_r,
CASE WHEN state = 'I' AND dd >= 7 THEN round(least(0.02, (1 - pow(1 - CASE WHEN age < 18 THEN 0.000006 WHEN age < 50 THEN 0.00015 WHEN age < 70 THEN 0.0015 ELSE 0.006 END::DOUBLE, 0.1::DOUBLE)) * CASE WHEN dd <= 14 THEN 1.5 ELSE 0.2 END::DOUBLE * (1 + comorbidity_count * 0.5) * {_V(1.0, 0.5, 0.2)}), 9) ELSE 0.0 END AS i_d,
CASE WHEN state = 'R' AND dd >= 180 THEN round(least(0.03, CASE WHEN dd > 365 THEN 0.005 ELSE 0.001 END::DOUBLE * CASE WHEN hi + oi > 0 THEN 1 + hi + oi ELSE 1 END * {_V(1.0, 0.5, 0.2)}), 6) ELSE 0.0 END AS r_s FROM pa""")
def h21_transition_probabilities(s, d):
    c = F.col
    p = panel(s, d).drop("cluster_id").join(agents(s, d), "agent_id").join(contacts(s, d), ["agent_id", "day"], "left").na.fill(0, ["infected", "household_infected"])
    days = F.when(c("state") == "R", 13 * c("days_in_state")).otherwise(c("days_in_state"))
    crowded = (c("cluster") == "dormitory") | (E.infer_occupation(c("age"), c("agent_id")) == "manual_worker")
    t = R.transition_probability(c("state"), days, c("age"), c("vaccination_status"), c("comorbidity_count"), c("compliance_score"), crowded, c("household_infected"), c("infected") - c("household_infected"), c("agent_id") % 13 == 0)
    return p.select("agent_id", "day", "state", *[F.round(t[k], 9 if k == "i_d" else 6).alias(k) for k in ("s_e", "e_i", "i_r", "i_d", "r_s")])


@query(""", fu AS (SELECT o_orderkey, (o_orderkey % 97) / 100.0::DOUBLE AS sy, (o_custkey % 89) / 100.0::DOUBLE AS ne, (o_orderkey % 4) / 10.0::DOUBLE AS cs, (o_custkey % 5) / 10.0::DOUBLE AS cn, (1 + o_orderkey % 3)::DOUBLE AS m,
  ['S->E', 'E->I', 'I->R', 'I->D', 'R->S', 'other'][o_orderkey % 6 + 1] AS transition FROM orders)
SELECT o_orderkey, transition, round(least(CASE transition WHEN 'S->E' THEN 0.10 WHEN 'E->I' THEN 0.25 WHEN 'I->R' THEN 0.35 WHEN 'I->D' THEN 0.02 WHEN 'R->S' THEN 0.03 ELSE 0.95 END::DOUBLE, CASE WHEN cs = 0 AND cn = 0 THEN sy * 0.6::DOUBLE + ne * 0.4::DOUBLE ELSE sy * (cs / (cs + cn)) + ne * (cn / (cs + cn)) END * m), 6) AS fused,
round(CASE WHEN cs > 0 AND cn > 0 THEN 2 * cs * cn / (cs + cn) ELSE greatest(cs, cn) END, 6) AS confidence FROM fu""")
def h24_fuse_probabilities(s, d):
    o, c = read(s, d, "orders"), F.col
    name = F.element_at(F.array(*[F.lit(x) for x in (*R.CAPS, "other")]), (c("o_orderkey") % 6 + 1).cast("int"))
    o = o.select("o_orderkey", name.alias("transition"), ((c("o_orderkey") % 97) / 100.0).alias("sy"), ((c("o_custkey") % 89) / 100.0).alias("ne"), ((c("o_orderkey") % 4) / 10.0).alias("cs"), ((c("o_custkey") % 5) / 10.0).alias("cn"), (1 + c("o_orderkey") % 3).cast("double").alias("m"))
    p, q = R.fuse(c("sy"), c("ne"), c("cs"), c("cn"), c("m"), c("transition"))
    return o.select("o_orderkey", "transition", F.round(p, 6).alias("fused"), F.round(q, 6).alias("confidence"))


#: Documents with a few phrases of the rules put before them, by id.
PHRASES = [
    "3 infected contacts, day 4, I am worried",
    "5 out of 10 people; household members are fine",
    "REASONING: a long enough account of it ADJUSTMENT: 1.7 PROBABILITY: 12% CONFIDENCE: HIGH",
    "avoid contact, wash hands, wear a mask to prevent spread 20% of 3 cases.",
    "vaccinated, so protection holds for 9 days typical CONFIDENCE: LOW",
    "Intro REASONING: too short ADJUSTMENT: 0.2 CONFIDENCE: ?",
    "",
    "Cases rose in March 2020 sharply. The rate is 18.3% today. Wash hands. It fell by 40 since May 2021! Circuit Breaker began on April 7, 2020. Phase 2 ended?",
]
_DOCS = f", tx AS (SELECT doc_id, CASE CAST(doc_id % {len(PHRASES)} AS INTEGER) " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PHRASES)) + " END || ' ' || text AS t FROM documents)"


def said(s, d):
    pick = F.element_at(F.array(*[F.lit(p) for p in PHRASES]), (F.col("doc_id") % len(PHRASES) + 1).cast("int"))
    return read(s, d, "documents").select("doc_id", F.concat(pick, F.lit(" "), F.col("text")).alias("t"))


def _num(pats, default):
    return "coalesce(" + ", ".join(f"TRY_CAST(nullif(regexp_extract(t, '(?i){p}', 1), '') AS INTEGER)" for p in pats) + f", {default})"


_HAS = lambda *w: " OR ".join(f"contains(lower(t), '{x}')" for x in w)


@query(_DOCS + " SELECT doc_id, " + _num([r"(\d+)\s+(?:infected\s+)?contacts?", r"(\d+)\s+out\s+of\s+\d+", r"(\d+)\s+people?\s+(?:are|were)\s+infected"], f"CASE WHEN {_HAS('high contact', 'many contacts')} THEN 10 WHEN {_HAS('few contacts', 'low contact')} THEN 2 ELSE 5 END") + " AS contacts FROM tx")
def h2_contact_count(s, d):
    return said(s, d).select("doc_id", T.contact_count(F.col("t")).alias("contacts"))


@query(_DOCS + " SELECT doc_id, " + _num([r"(\d+)\s+household\s+members?\s+(?:are|were)?\s*infected", r"household.*?(\d+)\s+infected"], f"CASE WHEN {_HAS('household')} THEN CASE WHEN {_HAS('all', 'entire')} THEN 4 WHEN {_HAS('some', 'one')} THEN 1 ELSE 2 END ELSE 0 END") + " AS infected FROM tx")
def h3_household_infections(s, d):
    return said(s, d).select("doc_id", T.household_infections(F.col("t")).alias("infected"))


@query(_DOCS + " SELECT doc_id, " + _num([r"(\d+)\s+days?", r"day\s+(\d+)"], f"CASE WHEN {_HAS('just', 'recently')} THEN 1 WHEN {_HAS('week')} THEN 7 ELSE 3 END") + " AS days FROM tx")
def h4_days_mention(s, d):
    return said(s, d).select("doc_id", T.days_mention(F.col("t")).alias("days"))


_SUM = lambda ws: " + ".join(f"contains(lower(t), '{w}')::INTEGER" for w in ws)


@query(_DOCS + f", k AS (SELECT doc_id, {_SUM(T.HIGH_RISK)} AS h, {_SUM(T.LOW_RISK)} AS l, {_SUM(T.TOOLS)} AS tools FROM tx) SELECT doc_id, round(CASE WHEN h > l THEN least(0.5 + 0.1 * h, 1.0) WHEN l > h THEN greatest(0.5 - 0.1 * l, 0.0) ELSE 0.5 END, 6)::DOUBLE AS risk, tools FROM k")
def h5_risk_perception(s, d):
    return said(s, d).select("doc_id", F.round(T.risk_perception(F.col("t")), 6).alias("risk"), T.hits(F.lower("t"), T.TOOLS).alias("tools"))


@query(_DOCS + f""" SELECT doc_id, CASE WHEN {_HAS('household')} AND ({_HAS('terrified', 'extremely')}) THEN 'anxious_protector' WHEN regexp_matches(t, '[×*%/]') THEN 'rational_calculator' WHEN {_HAS('days')} AND ({_HAS('typical', 'timeline')}) THEN 'timeline_tracker'
WHEN {_HAS('however')} OR (({_HAS('but')}) AND ({_HAS('young')})) THEN 'optimistic_minimizer' WHEN ({_HAS('age')}) AND regexp_matches(t, '[6-8][0-9]') THEN 'elderly_vulnerable' WHEN {_HAS('young', '15 years', 'strong immune')} THEN 'youth_confident'
WHEN ({_HAS('vaccinated')}) AND ({_HAS('protection')}) THEN 'vaccine_reliant' WHEN {_HAS('household')} THEN 'household_focused' WHEN {_HAS('contacts', 'out of')} THEN 'contact_counter' ELSE 'general_risk_assessor' END AS pattern FROM tx""")
def h9_behaviour_pattern(s, d):
    return said(s, d).select("doc_id", T.behaviour_pattern(F.col("t")).alias("pattern"))


@query(_DOCS + r""", rs AS (SELECT doc_id, CASE WHEN contains(t, 'REASONING:') THEN regexp_replace(split_part(split_part(t, 'REASONING:', 2), 'ADJUSTMENT:', 1), '^\s+|\s+$', '', 'g') ELSE substr(t, 1, 200) END AS said FROM tx)
SELECT doc_id, CASE WHEN length(said) > 20 THEN said END AS reasoning FROM rs""")
def h1_reasoning_text(s, d):
    return said(s, d).select("doc_id", T.reasoning_text(F.col("t")).alias("reasoning"))


@query(_DOCS + r""", n AS (SELECT doc_id, t, TRY_CAST(nullif(regexp_extract(t, 'ADJUSTMENT:[ \t]*([0-9.]+)', 1), '') AS DOUBLE) AS a, TRY_CAST(nullif(regexp_extract(t, 'PROBABILITY:[ \t]*([0-9.]+)', 1), '') AS DOUBLE) AS p FROM tx)
SELECT doc_id, coalesce(CASE WHEN a IS NOT NULL THEN greatest(0.6, least(1.5, a)) END, 1.0)::DOUBLE AS adjustment, round(coalesce(CASE WHEN p IS NOT NULL THEN greatest(0.001, least(0.8, CASE WHEN regexp_matches(t, 'PROBABILITY:[ \t]*[0-9.]+%') THEN p / 100 ELSE p END)) END, 0.05 * coalesce(CASE WHEN a IS NOT NULL THEN greatest(0.6, least(1.5, a)) END, 1.0)), 6)::DOUBLE AS probability, CASE regexp_extract(t, 'CONFIDENCE:\s*(\S+)', 1) WHEN 'LOW' THEN 0.6 WHEN 'HIGH' THEN 0.95 ELSE 0.8 END::DOUBLE AS confidence FROM n""")
def h10_parse_response(s, d):
    t = F.col("t")
    return said(s, d).select("doc_id", F.coalesce(T.parse_adjustment(t), F.lit(1.0)).alias("adjustment"), F.round(T.parse_probability(t, 0.05), 6).alias("probability"), T.parse_confidence(t).alias("confidence"))


@query(_DOCS + f", k AS (SELECT doc_id, {_SUM(T.GUIDELINE)} AS g, {_SUM(T.BOILERPLATE)} AS b FROM tx) SELECT doc_id, g >= 3 AND b = 0 AS guideline FROM k")
def h13_is_guideline(s, d):
    return said(s, d).select("doc_id", T.is_guideline(F.col("t")).alias("guideline"))


@query(_DOCS + ", k AS (SELECT doc_id, [" + ", ".join(f"{_SUM(w)}" for w in T.CATEGORIES.values()) + "] AS s FROM tx) SELECT doc_id, CASE WHEN list_max(s) > 0 THEN [" + ", ".join(f"'{c}'" for c in T.CATEGORIES) + "][list_position(s, list_max(s))] ELSE 'general_guidelines' END AS category FROM k")
def h15_categorize(s, d):
    return said(s, d).select("doc_id", T.categorize(F.col("t")).alias("category"))


#: DuckDB's word bounds know ASCII only: other letters and numbers stand between underscores while they are looked for.
_FOREIGN = r"[^\x00-\x7F\P{L}]|[^\x00-\x7F\P{N}]"
_CLEAN = rf"regexp_replace(t, '({_FOREIGN})', '_\1_', 'g')"
for _leak in [x.replace(r"\w", T.WORD) for x in T.LEAKS]:
    _CLEAN = f"regexp_replace({_CLEAN}, '[^.!?]*{_leak}[^.!?]*[.!?]', '', 'gi')"
_TEMPORAL = T.TEMPORAL.replace(r"\w", T.WORD)
_CLEAN = f"regexp_replace({_CLEAN}, '{_TEMPORAL}', '', 'g')"
_CLEAN = rf"regexp_replace({_CLEAN}, '_({_FOREIGN})_', '\1', 'g')"
_CLEAN = rf"regexp_replace(regexp_replace(regexp_replace({_CLEAN}, '\n\s*\n\s*\n+', chr(10) || chr(10), 'g'), '  +', ' ', 'g'), '^\s+|\s+$', '', 'g')"


@query(_DOCS + f" SELECT doc_id, {_CLEAN} AS clean FROM tx")
def h14_remove_leakage(s, d):
    return said(s, d).select("doc_id", T.remove_leakage(F.col("t")).alias("clean"))


def _pieces(x: str) -> str:
    """SQL: texts between the tags of ``x``, stripped, without empty ones."""
    raw = f"regexp_split_to_array({x}, '<[^>]*>')"
    plain = "p"
    for name, said in (("lt", "'<'"), ("gt", "'>'"), ("quot", "chr(34)"), ("amp", "'&'")):  # those the articles hold; a cut text may end before the semicolon, which HTML lets be left out
        plain = f"regexp_replace({plain}, '&(?:{name}|{name.upper()});?', {said}, 'g')"
    return f"list_filter(list_transform({raw}, lambda p: regexp_replace({plain}, '^\\s+|\\s+$', '', 'g')), lambda p: p <> '')"


#: Sections of the pages as the bindings of ``marked_pages`` make them: one container and one list a page.
_SECTIONS = f""", bx AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN regexp_extract(html, '<article>(.*)</article>', 1, 's') ELSE regexp_extract(html, '<div class="ad">(.*?)</div>', 1, 's') END AS box,
  regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1, 's'), '<li>(.*?)</li>', 1) AS items FROM pages),
tx AS (SELECT page_id, array_to_string({_pieces('box')}, chr(10)) AS content, array_to_string({_pieces("nullif(regexp_extract(box, '<h1>(.*?)</h1>', 1, 's'), '')")}, '') AS heading,
  array_to_string(list_transform(items, lambda i: '- ' || array_to_string({_pieces('i')}, '')), chr(10)) AS listed, len(items) AS n FROM bx),
sec AS (SELECT page_id, 'section_0' AS section, heading, content FROM tx WHERE length(content) >= {T.SHORTEST_SECTION}
  UNION ALL SELECT page_id, 'list_0', 'Guidelines', listed FROM tx WHERE n >= {T.FEWEST_ITEMS} AND length(listed) > {T.SHORTEST_LIST})"""


def marked_pages(s, d):
    """The pages; the article of every second one is a guideline, the others have nothing but a classed ``div``."""
    html = F.when(F.pmod("page_id", F.lit(2)) == 0, F.replace("html", F.lit("<article>"), F.lit('<article class="Guideline-text">'))).otherwise(F.col("html"))
    return read(s, d, "pages").withColumn("html", html)


@query(_SECTIONS + " SELECT page_id, section, heading, content FROM sec")
def h12_extract_sections(s, d):
    return T.extract_sections(marked_pages(s, d))


ADVICE = "You should wash hands, wear a mask and avoid contact to reduce the risk of spread. Of 300 cases 20% rose by 5. "


def sections(s, d):
    """Sections of the pages, with a phrase that makes those of articles guidelines."""
    told = F.when((F.pmod("page_id", F.lit(2)) == 0) & F.col("section").startswith("section"), F.concat(F.lit(ADVICE), "content")).otherwise(F.col("content"))
    return T.extract_sections(marked_pages(s, d)).withColumn("content", told)


_SCORES = "[" + ", ".join(_SUM(w) for w in T.CATEGORIES.values()) + "]"


@query(_SECTIONS + f""", wh AS (SELECT page_id, section, heading, CASE WHEN page_id % 2 = 0 AND section LIKE 'section%' THEN '{ADVICE}' || content ELSE content END AS t FROM sec),
cl AS (SELECT page_id, section, heading, {_CLEAN} AS content FROM wh WHERE {_SUM(T.GUIDELINE)} >= 3 AND {_SUM(T.BOILERPLATE)} = 0),
sc AS (SELECT *, {_SCORES} AS s FROM (SELECT *, concat_ws(' ', heading, content) AS t FROM cl WHERE length(content) >= 50)),
kp AS (SELECT CASE WHEN list_max(s) > 0 THEN [{", ".join(f"'{c}'" for c in T.CATEGORIES)}][list_position(s, list_max(s))] ELSE 'general_guidelines' END AS category, page_id, section, heading, content FROM sc)
SELECT concat_ws('_', category, page_id, section) AS id, category, heading, CASE WHEN category = 'prevention' THEN 'known' ELSE content END AS content FROM kp""")
def h16_filter_sections(s, d):
    kept = stage(T.filter_sections(sections(s, d)), "sections")
    known = kept.where("category = 'prevention'").withColumn("content", F.lit("known"))
    return T.insert_if_absent(known, kept)


@query(_DOCS + "".join(f" {'UNION ALL ' if i else ''}SELECT doc_id, 'year {y}' AS issue FROM tx WHERE contains(t, '{y}')" for i, y in enumerate(T.AUDIT_YEARS)) + "".join(f" UNION ALL SELECT doc_id, 'event {e}' FROM tx WHERE contains(lower(t), '{e}')" for e in T.AUDIT_EVENTS)
    + f" UNION ALL SELECT doc_id, 'date' FROM tx WHERE regexp_matches(t, '({'|'.join(T.AUDIT_MONTHS)}) ({'|'.join(T.AUDIT_YEARS)})')")
def h17_audit_leakage(s, d):
    return T.audit_leakage(said(s, d), "doc_id", "t")


@query(_DOCS + " SELECT doc_id, substr(replace(t, chr(10), ' '), 1, 120) AS short FROM tx")
def h26_compress_text(s, d):
    return said(s, d).select("doc_id", F.substring(F.translate("t", "\n", " "), 1, 120).alias("short"))
