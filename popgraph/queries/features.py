"""Queries of feature vectors, cohorts, motifs and fused embeddings (B, C17, C19, D, F, H, I, J2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from popgraph.operators import clusters as K
from popgraph.operators import entities as E
from popgraph.operators import features as X
from popgraph.operators import motifs as M
from popgraph.operators import network as N
from popgraph.operators import panel as P
from popgraph.operators import retrieval as V
from popgraph.operators import risk as R
from popgraph.operators import text as T
from popgraph.queries.base import ORACLE_SQL, U, agents, edges, members, query, read, states
from popgraph.queries.entities import _JOB, _NBS, contacts, said
from popgraph.queries.panels import _NEXT, _RATE, panel
from popgraph.queries.quality import _ALIKE, _E, _EM, _FC, _T5, alike, emb, forecasts, labels, regions

_AG = f""", ag AS (SELECT * REPLACE ({_JOB} AS occupation), agent_id % 7 / 10.0::DOUBLE AS mobility_score, agent_id % 9 / 10.0::DOUBLE AS risk_awareness, agent_id % 60 AS days_since_start, agent_id % 5 AS disease_status,
  agent_id % 13 = 0 AS quarantined, agent_id % 19 = 0 AS isolated FROM agents)"""
_DG = _AG + ", dg AS (SELECT a.*, count(nb.other_id) AS degree FROM ag a LEFT JOIN nb ON nb.agent_id = a.agent_id GROUP BY ALL)"


def profiles(s, d):
    k = F.col("agent_id")
    return agents(s, d).withColumns(
        {
            "occupation": E.infer_occupation(F.col("age"), k), "mobility_score": k % 7 / 10.0, "risk_awareness": k % 9 / 10.0, "days_since_start": k % 60, "disease_status": k % 5,
            "quarantined": k % 13 == 0, "isolated": k % 19 == 0,
        }
    )


def _hot(col, values):
    return ", ".join(f"CASE WHEN {col} = {v!r} THEN 1.0 ELSE 0.0 END" for v in values)


def _flag(cond):
    return f"CASE WHEN {cond} THEN 1.0 ELSE 0.0 END"


def _vec(*parts):
    return "[round(x::DOUBLE, 6) FOR x IN [" + ", ".join(f"{p}" for p in parts) + "]]"


_D = lambda c, n: f"CAST({c} AS DOUBLE) / {n}"
_GENDER = [_flag("lower(gender) = 'm'"), _flag("lower(gender) = 'f'"), _flag("lower(gender) NOT IN ('m', 'f')")]


@query(_DG + " SELECT agent_id, " + _vec(_D("age", 100), _hot("occupation", X.NODE_JOBS), _hot("vaccination_status", [0, 1, 2]), _D("comorbidity_count", 5), "mobility_score", "compliance_score::DOUBLE", "risk_awareness", _D("degree", 50), *_GENDER, _flag("is_imported"), _D("days_since_start", 100), _hot("disease_status", range(5))) + " AS features FROM dg")
def b12_node_features(s, d):
    a = profiles(s, d)
    return X.node_features(a, N.degrees(a, edges(s, d)))


@query(_DG + " SELECT agent_id, " + _vec(_D("age", 100), _D("vaccination_status", 2), _D("comorbidity_count", 5), "compliance_score::DOUBLE", "risk_awareness", "mobility_score", _D("degree", 50), _flag("occupation = 'healthcare_worker'"), _flag("occupation IN ('student', 'teacher')"), _flag("occupation NOT IN ('healthcare_worker', 'student', 'teacher')")) + " AS features FROM dg")
def b13_context_features(s, d):
    a = profiles(s, d)
    return X.context_features(a, N.degrees(a, edges(s, d)))


@query(_AG + ", jb AS (SELECT list(DISTINCT occupation ORDER BY occupation) AS js FROM ag) SELECT agent_id, list_concat(" + _vec(_D("age", 100), *_GENDER) + ", [CASE WHEN j = occupation THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FOR j IN js]) AS features FROM ag, jb")
def b14_raw_features(s, d):
    return X.raw_features(profiles(s, d))


@query(_NBS + _AG + " SELECT a.agent_id, p.day, " + _vec(_D("age", 100), _hot("occupation", X.PANEL_JOBS), "0.1", _flag("is_imported"), _flag("quarantined"), _flag("cluster LIKE '%dorm%'"), _hot("vaccination_status", [0, 1, 2]), _D("comorbidity_count", 5), "mobility_score", "compliance_score::DOUBLE", "risk_awareness", "least(days_in_state / 20.0::DOUBLE, 1.0)", "coalesce(infected / greatest(contacts, 1)::DOUBLE, 0.0)", _flag("isolated")) + " AS features FROM ag a JOIN panel p ON p.agent_id = a.agent_id LEFT JOIN nbs ON nbs.agent_id = a.agent_id AND nbs.day = p.day")
def b16_panel_features(s, d):
    return X.panel_features(profiles(s, d), panel(s, d), contacts(s, d))


_WORKS = "('healthcare_worker', 'office_worker', 'retail_worker', 'teacher')"


@query(_AG + f""" SELECT e.agent_1, e.agent_2, CASE WHEN a.household_id = b.household_id THEN 'household' WHEN a.occupation = b.occupation AND a.occupation IN {_WORKS} THEN 'work'
 WHEN a.occupation IN ('student', 'teacher') AND b.occupation IN ('student', 'teacher') THEN 'school' ELSE 'social' END AS relation FROM edges e JOIN ag a ON a.agent_id = agent_1 JOIN ag b ON b.agent_id = agent_2""")
def b17_relation_type(s, d):
    p = profiles(s, d)
    side = lambda n: p.select(F.col("agent_id").alias(f"agent_{n}"), *[F.col(c).alias(c[0] + n) for c in ("household_id", "occupation", "age")])
    j = edges(s, d).join(side("1"), "agent_1").join(side("2"), "agent_2")
    return j.select("agent_1", "agent_2", R.relation_type(*[F.col(c) for c in ("h1", "h2", "o1", "o2", "a1", "a2")]).alias("relation"))


@query("SELECT agent_id, day, round(CASE state WHEN 'S' THEN 0.035 WHEN 'E' THEN 1 / 3.0 WHEN 'I' THEN 1 / 10.0 WHEN 'R' THEN 1 / 180.0 ELSE 0.0 END::DOUBLE, 6) AS rate FROM panel")
def b19_baseline_rate(s, d):
    return panel(s, d).select("agent_id", "day", F.round(X.baseline_rate(E.next_transition(F.col("state"))), 6).alias("rate"))


_ACT = ", ".join(str(r) for r in X.ACTIVITIES)


@query(_AG + f""", pl AS (SELECT * FROM (VALUES {_ACT}) v(occupation, activity, hours)), hd AS (SELECT agent_id, hours, activity IS NOT NULL AND NOT (activity IN ('work', 'school') AND agent_id % 7 >= 5) AS held FROM ag LEFT JOIN pl USING (occupation))
SELECT agent_id, count(*) FILTER (held) AS activities, CAST(coalesce(sum(hours) FILTER (held), 0) AS BIGINT) AS hours FROM hd GROUP BY agent_id""")
def b20_activity_schedule(s, d):
    return X.activity_schedule(profiles(s, d), F.col("agent_id") % 7)


@query("SELECT conv_id, turn, role, CASE quality WHEN 1 THEN 'careful' WHEN 0 THEN 'careless' ELSE 'unclassified' END AS motif FROM conversations LEFT JOIN labels ON doc_id = conv_id")
def c17_attach_motifs(s, d):
    m = read(s, d, "labels").select(F.col("doc_id").alias("conv_id"), F.when(F.col("quality") == 1, "careful").when(F.col("quality") == 0, "careless").alias("motif"))
    return X.attach_motifs(read(s, d, "conversations").select("conv_id", "turn", "role"), m, "conv_id")


_PAIR = "agent_1 || '-' || agent_2"


@query(f"SELECT agent_1, agent_2, CAST(floor({U.format('neg-1', _PAIR)} * n) + low AS BIGINT) AS neg_1, CAST(floor({U.format('neg-2', _PAIR)} * n) + low AS BIGINT) AS neg_2 FROM edges, (SELECT count(*) AS n, min(agent_id) AS low FROM agents)")
def c19_negative_pairs(s, d):
    return X.negative_pairs(edges(s, d), agents(s, d))


@query(_AG + ", sh AS (SELECT cluster_id, avg((cluster LIKE '%dorm%')::INTEGER) AS d, avg((occupation = 'manual_worker')::INTEGER) AS m FROM ag GROUP BY cluster_id) SELECT cluster_id, d > 0.3 OR m > 0.5 AS is_dormitory, d > 0.5 OR m > 0.5 AS is_dormitory_strict FROM sh")
def d12_dormitory_flag(s, d):
    return X.dormitory_flags(profiles(s, d), "cluster_id")


@query(_AG + " SELECT cluster_id, round(greatest(0.1, 1 - 0.8::DOUBLE * avg(quarantined::INTEGER)), 6) AS factor FROM ag GROUP BY cluster_id")
def d15_quarantine_factor(s, d):
    return X.quarantine_factor(profiles(s, d), "cluster_id")


@query("""SELECT a.cluster_id, day, round(coalesce(avg((CASE WHEN age < 20 THEN 0.01 WHEN age < 50 THEN 0.25 WHEN age < 70 THEN 2.5 ELSE 35.0 END)::DOUBLE * (CASE WHEN comorbidity_count >= 2 THEN 1.8 WHEN comorbidity_count = 1 THEN 1.3 ELSE 1.0 END)::DOUBLE
 * (CASE WHEN vaccination_status >= 2 THEN 0.1 WHEN vaccination_status = 1 THEN 0.3 ELSE 1.0 END)::DOUBLE) FILTER (state = 'I'), 1.0), 6) AS factor FROM agents a JOIN panel p ON p.agent_id = a.agent_id GROUP BY a.cluster_id, day""")
def d16_death_factor(s, d):
    return X.death_factor(agents(s, d), panel(s, d), "cluster_id")


@query(_EM + """, bs AS (SELECT label, round(avg(x), 6) AS block_mean, round(stddev_pop(x), 6) AS block_std FROM lv GROUP BY label), po AS (SELECT label, list(round(c, 6) ORDER BY pos) AS pooled FROM ct GROUP BY label) SELECT label, block_mean, block_std, pooled FROM bs JOIN po USING (label)""")
def d18_cluster_embedding(s, d):
    pooled = K.centroid_arrays(emb(s, d), *_E).select("label", F.transform("centroid", lambda x: F.round(x, 6)).alias("pooled"))
    return K.block_stats(emb(s, d), *_E).join(pooled, "label")


_LBL = _NEXT + f", lb AS (SELECT cluster_id, day, {_RATE} FROM nx WHERE n IS NOT NULL GROUP BY cluster_id, day)"


@query(_LBL + f""", ws AS (SELECT *, {' + '.join(_T5)} AS sc FROM lb), wt AS (SELECT cluster_id, day, CASE WHEN sc > 0.001 THEN 3.0 ELSE 1.0 END::DOUBLE * CASE WHEN sc > 0.01 THEN 1.5 ELSE 1.0 END::DOUBLE AS weight FROM ws),
ex AS (SELECT *, weight * count(*) OVER () / sum(weight) OVER () AS e FROM wt), cp AS (SELECT *, CAST(floor(e) AS BIGINT) + CASE WHEN {U.format('oversample', "(cluster_id || '-' || day)")} < e - floor(e) THEN 1 ELSE 0 END AS c FROM ex)
SELECT cluster_id, day, weight, unnest(range(1, c + 1)) AS copy FROM cp""")
def d28_oversample(s, d):
    return X.oversample(labels(s, d), _T5, F.concat_ws("-", "cluster_id", "day")).select("cluster_id", "day", "weight", "copy")


@query(""", c AS (SELECT E, I, S + E + I + R + D AS n FROM hist WHERE day = (SELECT min(day) FROM hist)), z AS (SELECT CASE WHEN E + I > 0 THEN CAST(floor(E * (1000.0::DOUBLE / n)) AS BIGINT) ELSE 10 END AS E, CASE WHEN E + I > 0 THEN CAST(floor(I * (1000.0::DOUBLE / n)) AS BIGINT) ELSE 10 END AS I FROM c)
SELECT 1000 - E - I AS S, E, I, 0::BIGINT AS R, 0::BIGINT AS D FROM z""")
def d32_scale_initial_counts(s, d):
    p = states(s, d)
    first = p.join(F.broadcast(p.agg(F.min("day").alias("day"))), "day", "left_semi")
    return X.scale_initial_counts(P.state_counts(first, ["day"]), 1000)


def _first(name, salt, where, most):
    """SQL: the first rows of ``sa`` in the order of a hash, with place r and number n of all."""
    return f"{name} AS (SELECT agent_id, household_id, work_network, row_number() OVER (ORDER BY {U.format(salt, 'agent_id')}, agent_id) AS r, count(*) OVER () AS n FROM sa WHERE {where} QUALIFY r <= {most})"


_N = lambda where: f"(SELECT count(*) FROM sa WHERE {where})"
_DORM, _ESSENTIAL = "cluster LIKE '%dorm%'", f"occupation IN {X.ESSENTIAL}"
_DAYS = U.format("days", "(scenario || '-' || agent_id)")


@query(_AG + ", sa AS (SELECT ag.*, mem.work_network FROM ag JOIN mem USING (agent_id)), " + ", ".join([
    _first("im", "imported_cases", "is_imported", 5), _first("im0", "imported_cases-any", "true", 3), _first("dorm", "dormitory_cluster", _DORM, 27), _first("dorm0", "dormitory_cluster-any", "true", 8),
    _first("es", "circuit_breaker", _ESSENTIAL, 4), _first("es0", "circuit_breaker-any", "true", 3), _first("co", "community-any", "true", 5)]) + f""",
bh AS (SELECT household_id, count(*) AS n FROM sa GROUP BY household_id ORDER BY n DESC, household_id LIMIT 3),
hs AS (SELECT agent_id, bh.n, row_number() OVER (PARTITION BY sa.household_id ORDER BY {U.format('community_clusters', 'agent_id')}, agent_id) AS r, least(2, greatest(1, bh.n // 3)) AS ill FROM sa JOIN bh USING (household_id)),
hr AS (SELECT agent_id, CASE WHEN r <= ill THEN 'I' ELSE 'E' END AS role FROM hs WHERE r <= ill + least(2, n - ill)),
lf AS (SELECT * FROM sa WHERE work_network IS NOT NULL AND agent_id NOT IN (SELECT agent_id FROM hr)),
bw AS (SELECT work_network FROM lf GROUP BY work_network ORDER BY count(*) DESC, work_network LIMIT 1),
ci AS (SELECT agent_id, household_id FROM es WHERE {_N(_ESSENTIAL)} >= 3 UNION ALL SELECT agent_id, household_id FROM es0 WHERE {_N(_ESSENTIAL)} < 3),
ro AS (SELECT 'imported_cases' AS scenario, agent_id, CASE WHEN r <= 3 THEN 'I' ELSE 'E' END AS role FROM im WHERE n >= 3 AND (r <= 3 OR n >= 5) UNION ALL SELECT 'imported_cases', agent_id, 'I' FROM im0 WHERE {_N('is_imported')} < 3
UNION ALL SELECT 'dormitory_cluster', agent_id, CASE WHEN r <= least(12, greatest(8, n // 20)) THEN 'I' ELSE 'E' END FROM dorm WHERE n >= 10 AND r <= least(12, greatest(8, n // 20)) + CASE WHEN n - least(12, greatest(8, n // 20)) >= 10 THEN least(15, n - least(12, greatest(8, n // 20))) ELSE 0 END
UNION ALL SELECT 'dormitory_cluster', agent_id, 'I' FROM dorm0 WHERE {_N(_DORM)} < 10
UNION ALL SELECT 'community_clusters', agent_id, role FROM hr
UNION ALL SELECT 'community_clusters', agent_id, 'I' FROM (SELECT agent_id FROM lf WHERE work_network IN (SELECT work_network FROM bw) QUALIFY row_number() OVER (ORDER BY {U.format('community_clusters-work', 'agent_id')}, agent_id) <= 3)
UNION ALL SELECT 'circuit_breaker', agent_id, 'I' FROM ci
UNION ALL SELECT 'circuit_breaker', agent_id, 'E' FROM (SELECT agent_id FROM sa WHERE household_id IN (SELECT household_id FROM ci) AND agent_id NOT IN (SELECT agent_id FROM ci) QUALIFY row_number() OVER (PARTITION BY household_id ORDER BY {U.format('circuit_breaker-home', 'agent_id')}, agent_id) <= 2)
UNION ALL SELECT 'community', agent_id, CASE WHEN r <= 3 THEN 'I' ELSE 'E' END FROM co WHERE r <= 3 OR n >= 5)
SELECT scenario, agent_id, role, CAST(CASE role WHEN 'I' THEN 2 + floor(5 * {_DAYS}) ELSE 1 + floor(3 * {_DAYS}) END AS INTEGER) AS days_in_state FROM ro""")
def d33_scenario_cohorts(s, d):
    return X.scenario_cohorts(profiles(s, d).join(members(s, d).select("agent_id", "work_network"), "agent_id"))


@query("SELECT source AS category, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM documents GROUP BY source")
def d34_category_counts(s, d):
    return X.category_counts(read(s, d, "documents"), "source")


@query(_EM + " SELECT pos, round(var_pop(x), 9) AS variance, row_number() OVER (ORDER BY round(var_pop(x), 9) DESC, pos) AS rank FROM lv GROUP BY pos QUALIFY rank <= 10")
def f4_top_variance_features(s, d):
    return M.top_variance_features(emb(s, d), "vec_id", "embedding", 10)


@query(_EM + " SELECT pos, vec_id, round(x, 6) AS x, row_number() OVER (PARTITION BY pos ORDER BY abs(x) DESC, vec_id) AS rank FROM lv QUALIFY rank <= 5")
def f4_feature_examples(s, d):
    return M.feature_examples(emb(s, d), "vec_id", "embedding").withColumn("x", F.round("x", 6))


@query(_ALIKE + " SELECT a, b, round(c, 9) AS cosine FROM sp WHERE c > 0.9 ORDER BY round(c, 9) DESC, a, b LIMIT 10")
def f5_top_pairs(s, d):
    return V.similar_pairs(alike(s, d), 0.9, k=10).withColumn("cosine", F.round("cosine", 9))


@query(_AG + ", tp AS (SELECT occupation FROM ag GROUP BY occupation ORDER BY count(*) DESC, occupation LIMIT 4) SELECT agent_id, CASE WHEN occupation IN (SELECT occupation FROM tp) THEN occupation ELSE 'other' END AS occupation FROM ag")
def f6_keep_top_labels(s, d):
    return X.keep_top_labels(profiles(s, d).select("agent_id", "occupation"), "occupation", 4, "other")


@query(", " + ", ".join(f"{q}_q AS ({ORACLE_SQL[n]})" for q, n in (("h2", "h2_contact_count"), ("h3", "h3_household_infections"), ("h4", "h4_days_mention"), ("h5", "h5_risk_perception")))
    + " SELECT doc_id, [round(doc_id % 90 / 100.0::DOUBLE, 6), round(doc_id % 10 / 10.0::DOUBLE, 6), round(least(contacts / 20.0::DOUBLE, 1.0), 6), round(least(infected / 5.0::DOUBLE, 1.0), 6), round(least(days / 14.0::DOUBLE, 1.0), 6), round(risk::DOUBLE, 6), round(least(tools / 6.0::DOUBLE, 1.0), 6), round(doc_id % 7 / 10.0::DOUBLE, 6)] AS features FROM h2_q JOIN h3_q USING (doc_id) JOIN h4_q USING (doc_id) JOIN h5_q USING (doc_id)")
def h7_continuous_features(s, d):
    k = F.col("doc_id")
    return said(s, d).select("doc_id", T.continuous_features(F.col("t"), k % 90, k % 10 / 10.0, k % 7 / 10.0).alias("features"))


_JSON_TEXTS = """, jt AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'Answer: ' || coalesce(props, '') || ' - end' WHEN 1 THEN 'So {"a": {"b": ' || event_id || ', "c": [1, {"d": 2}]}, "k": 2, "note": "x } y"} there' WHEN 2 THEN 'no object in it'
  WHEN 3 THEN 'broken {"k": 3, "note" } end' ELSE '{"k": "4", "note": null} and {more}' END AS t FROM events)"""


def json_texts(s, d):
    i = F.col("event_id").cast("string")
    nested = F.concat(F.lit('So {"a": {"b": '), i, F.lit(', "c": [1, {"d": 2}]}, "k": 2, "note": "x } y"} there'))
    kind = F.col("event_id") % 5
    t = F.when(kind == 0, F.concat(F.lit("Answer: "), F.coalesce("props", F.lit("")), F.lit(" - end"))).when(kind == 1, nested).when(kind == 2, "no object in it").when(kind == 3, 'broken {"k": 3, "note" } end').otherwise('{"k": "4", "note": null} and {more}')
    return read(s, d, "events").select("event_id", t.alias("t"))


@query(_JSON_TEXTS + """, js AS (SELECT event_id, t, CASE WHEN json_valid(regexp_extract(t, '\\{.*\\}', 0, 's')) THEN regexp_extract(t, '\\{.*\\}', 0, 's') END AS j FROM jt)
SELECT event_id, CASE WHEN contains(t, '{') AND contains(t, '}') THEN coalesce(TRY_CAST(json_extract_string(j, '$.k') AS BIGINT), -1) ELSE -2 END AS k,
CASE WHEN contains(t, '{') AND contains(t, '}') THEN coalesce(json_extract_string(j, '$.note'), 'none') ELSE 'nothing' END AS note, CASE WHEN contains(t, '{') AND contains(t, '}') THEN coalesce(CAST(json_extract(j, '$.a') AS VARCHAR), '-') ELSE '' END AS a FROM js""")
def h11_extract_json(s, d):
    kinds, absent, none = {"k": "long", "note": "string", "a": "json"}, {"k": -1, "note": "none", "a": "-"}, {"k": -2, "note": "nothing", "a": ""}
    got = json_texts(s, d).select("event_id", *X.extract_json(F.col("t"), kinds, absent, none))
    return got.withColumn("a", F.regexp_replace("a", r"\s+", ""))


@query("""SELECT event_id, 'event ' || u AS description, CASE WHEN u = 2 THEN NULL ELSE u * event_id END AS weight FROM events, range(1, 4) t(u) WHERE event_id % 4 > 0 AND u <= event_id % 4""")
def h11_extract_json_rows(s, d):
    one = lambda u: F.concat(F.lit(f'{{"description": "event {u}"'), F.lit("") if u == 2 else F.concat(F.lit(', "weight": '), (u * F.col("event_id")).cast("string")), F.lit('}, {"weight": 1}'))
    items = F.array_join(F.slice(F.array(one(1), one(2), one(3)), F.lit(1), (F.col("event_id") % 4).cast("int")), ", ")
    t = F.when(F.col("event_id") % 4 == 0, "no list").otherwise(F.concat(F.lit("Here: ["), items, F.lit("] ok")))
    return X.extract_json_rows(read(s, d, "events").select("event_id", t.alias("t")), "t", "description", {"weight": "long"})


@query("""SELECT agent_id, day, round(least((CASE WHEN age < 20 THEN 0.00002 WHEN age < 50 THEN 0.0005 WHEN age < 70 THEN 0.005 ELSE 0.07 END)::DOUBLE * (CASE WHEN days_in_state < 7 THEN 0.1 WHEN days_in_state < 14 THEN 0.3 ELSE 0.05 END)::DOUBLE
 * (1 + 0.8::DOUBLE * comorbidity_count) * (CASE vaccination_status WHEN 2 THEN 0.1 WHEN 1 THEN 0.3 ELSE 1.0 END)::DOUBLE, 0.2), 9) AS probability FROM agents JOIN panel USING (agent_id)""")
def h22_death_probability(s, d):
    j = agents(s, d).join(panel(s, d), "agent_id")
    return j.select("agent_id", "day", F.round(X.death_probability(F.col("age"), F.col("days_in_state"), F.col("comorbidity_count"), F.col("vaccination_status")), 9).alias("probability"))


@query(""", q AS (SELECT agent_id, day, state, 1 - pow(1 - least(0.005::DOUBLE * m, 0.4), 0.1) AS die, least(0.15::DOUBLE * m, 0.9) AS recover, least(greatest(0.05::DOUBLE * m, 0.001), 0.8) AS change FROM (SELECT *, 1 + agent_id % 5 AS m FROM panel))
SELECT agent_id, day, CASE WHEN state = 'I' THEN round(die, 6) ELSE 0.0 END AS die, CASE WHEN state = 'I' THEN round(recover, 6) ELSE 0.0 END AS recover, CASE WHEN state = 'I' THEN round(greatest(1 - die - recover, 0.0), 6) ELSE 0.0 END AS stay,
 CASE WHEN state <> 'I' THEN round(change, 6) END AS change FROM q""")
def h25_individual_probabilities(s, d):
    m = 1 + F.col("agent_id") % 5
    p = X.individual_probabilities(F.col("state"), F.lit(0.005), F.lit(0.15), F.lit(0.05), m)
    return panel(s, d).select("agent_id", "day", *[F.round(c, 6).alias(n) for n, c in p.items()])


_PF = ", pc AS (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY ALL), pf AS (SELECT user_id, event_type, c / sum(c) OVER (PARTITION BY user_id) AS share FROM pc)"


def patterns(s, d):
    return M.pattern_profile(read(s, d, "events"), "user_id", "event_type")


@query(_PF + " SELECT user_id, event_type, round(share, 6) AS share FROM pf")
def i8_pattern_profile(s, d):
    return patterns(s, d).withColumn("share", F.round("share", 6))


@query(_PF + ", n AS (SELECT count(DISTINCT user_id) AS n FROM pf) SELECT event_type, count(*) AS size, round(sum(share) / any_value(n), 6) AS mean, round(sum(share * share) / any_value(n) - pow(sum(share) / any_value(n), 2), 6) AS variance FROM pf, n GROUP BY event_type")
def i4_motif_catalogue(s, d):
    return M.motif_catalogue(patterns(s, d), "user_id", "event_type")


def coherence(s, d):
    p = patterns(s, d)
    return M.motif_coherence(p, p.select("user_id", (F.col("user_id") % 10).alias("cluster_id")).distinct(), "user_id", "event_type")


_CO = _PF + """, cs AS (SELECT user_id % 10 AS cluster_id, event_type, sum(share) AS s FROM pf GROUP BY ALL), cq AS (SELECT cluster_id, s / sum(s) OVER (PARTITION BY cluster_id) AS p FROM cs),
co AS (SELECT cluster_id, round(-sum(p * ln(p)), 6) AS entropy, round(CASE WHEN count(*) > 1 THEN 1 + sum(p * ln(p)) / ln(count(*)) ELSE 1.0 END, 6) AS coherence FROM cq GROUP BY cluster_id)"""


@query(_CO + " SELECT * FROM co")
def i27_motif_coherence(s, d):
    return coherence(s, d)


@query(_PF + " SELECT event_type, round(sum(share), 6) AS frequency, row_number() OVER (ORDER BY round(sum(share), 6) DESC, event_type) AS rank FROM pf GROUP BY event_type QUALIFY rank <= 15")
def i32_motif_frequency(s, d):
    return M.motif_frequency(patterns(s, d), "event_type")


@query(_PF + ", n AS (SELECT user_id % 10 AS cluster_id, count(DISTINCT user_id) AS n FROM pf GROUP BY 1), c AS (SELECT user_id % 10 AS cluster_id, event_type, sum(share) AS s FROM pf GROUP BY ALL) SELECT cluster_id, event_type, round(s / n, 6) AS share, row_number() OVER (PARTITION BY cluster_id ORDER BY round(s / n, 6) DESC, event_type) AS rank FROM c JOIN n USING (cluster_id) QUALIFY rank <= 3")
def i32_top_motifs(s, d):
    p = patterns(s, d)
    return M.top_motifs(p, p.select("user_id", (F.col("user_id") % 10).alias("cluster_id")).distinct(), "user_id", "event_type")


@query(_PF + " SELECT x.event_type AS a, y.event_type AS b, count(*) AS entities FROM pf x JOIN pf y ON x.user_id = y.user_id AND x.event_type < y.event_type WHERE x.share > 0.1 AND y.share > 0.1 GROUP BY 1, 2")
def i32_motif_cooccurrence(s, d):
    return M.motif_cooccurrence(patterns(s, d), "user_id", "event_type")


_DI = _EM + ", di AS (SELECT vec_id, em.label, ca.label AS l, list_distance(v, c) AS x FROM em, ca)"


@query(_DI + " SELECT vec_id, label FROM di GROUP BY ALL HAVING min(x) FILTER (l = label) > 0.95 * min(x) FILTER (l <> label)")
def i17_boundary_entities(s, d):
    return M.boundary_entities(emb(s, d), *_E)


_AN = _EM + ", an AS (SELECT label, vec_id AS anchor FROM (SELECT label, vec_id, round(list_cosine_similarity(v, c), 9) AS s FROM em JOIN ca USING (label)) QUALIFY row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) = 1)"


@query(_AN + ", aq AS (SELECT list_distance(v, c) AS x FROM an JOIN em ON em.vec_id = anchor JOIN ca ON ca.label = em.label) SELECT round(1 / (avg(x) + 1e-9), 6) AS representativeness FROM aq")
def i28_anchor_quality(s, d):
    return M.anchor_quality(emb(s, d), K.select_anchors(emb(s, d), *_E), *_E)


@query(_AN + ", sm AS (SELECT em.vec_id, em.label, an.label AS l, list_cosine_similarity(em.v, av.v) / 0.5::DOUBLE AS s FROM em, an JOIN em av ON av.vec_id = anchor), lo AS (SELECT vec_id, ln(sum(exp(s))) - max(s) FILTER (l = label) AS x FROM sm GROUP BY vec_id) SELECT round(avg(x), 6) AS loss FROM lo")
def i12_anchor_loss(s, d):
    return M.anchor_loss(emb(s, d), K.select_anchors(emb(s, d), *_E), *_E)


@query(_EM + f""", sz AS (SELECT count(*) AS n, min(vec_id) AS low FROM em), dp AS (SELECT vec_id AS i, CAST(floor({U.format('pair', "(vec_id || '-' || k)")} * n) + low AS BIGINT) AS j FROM em, sz, range(1, 5) t(k)),
dd AS (SELECT 1 - list_cosine_similarity(a.v, b.v) AS d FROM dp JOIN em a ON a.vec_id = i JOIN em b ON b.vec_id = j WHERE i <> j), md AS (SELECT median(d) AS m, quantile_cont(d, 0.4) AS lo, quantile_cont(d, 0.8) AS hi FROM dd), ma AS (SELECT median(abs(d - m)) AS mad FROM dd, md)
SELECT round(greatest(lo, least(hi, m + 0.75 * (mad + 1e-8))), 6) AS threshold, round(m, 6) AS median, round(mad, 6) AS mad FROM md, ma""")
def i15_adaptive_threshold(s, d):
    return M.adaptive_threshold(emb(s, d), "vec_id", "embedding")


_Z = ", {n}_s AS (SELECT pos, avg(x) AS m, CASE WHEN stddev_pop(x) < 1e-9 THEN 1 ELSE stddev_pop(x) END AS s FROM {n}_x GROUP BY pos), {n}_z AS (SELECT vec_id, pos, (x - m) / s AS z FROM {n}_x JOIN {n}_s USING (pos)), {n}_w AS (SELECT vec_id, pos, z / sqrt(sum(z * z) OVER (PARTITION BY vec_id)) * {w}::DOUBLE AS w FROM {n}_z)"


@query(_EM + ", a_x AS (SELECT vec_id, pos, x FROM lv), b_x AS (SELECT vec_id, pos, x * x AS x FROM lv WHERE pos < 16)" + _Z.format(n="a", w=0.6) + _Z.format(n="b", w=0.4) + """, fu AS (SELECT vec_id, pos, sum(w) AS w FROM (SELECT * FROM a_w UNION ALL SELECT * FROM b_w) GROUP BY ALL),
fn AS (SELECT vec_id, pos, w / sqrt(sum(w * w) OVER (PARTITION BY vec_id)) AS w FROM fu) SELECT vec_id, list(round(w, 5) + 0.0::DOUBLE ORDER BY pos) AS fused FROM fn GROUP BY vec_id""")
def i14_fuse_embeddings(s, d):
    v = F.col("embedding").cast("array<double>")
    e = emb(s, d).select("vec_id", v.alias("graph"), F.transform(F.slice(v, 1, 16), lambda x: x * x).alias("motif"))
    return M.fuse_embeddings(e, "vec_id", {"graph": 0.6, "motif": 0.4}, 64)


@query(", q1 AS (" + ORACLE_SQL["i21_modularity"] + "), q2 AS (" + ORACLE_SQL["i27_motif_coherence"] + "), q3 AS (" + ORACLE_SQL["i23_silhouette"] + ") SELECT round(0.45 * (SELECT modularity FROM q1) + 0.35 * (SELECT avg(coherence) FROM q2) + 0.2 * (SELECT avg(silhouette_sq) FROM q3), 5) AS score")
def i30_quality_score(s, d):
    return M.quality_score(K.modularity(edges(s, d), regions(s, d)), coherence(s, d), K.silhouette(emb(s, d), *_E))


@query(", q1 AS (" + ORACLE_SQL["i21_modularity"] + "), q2 AS (" + ORACLE_SQL["i27_motif_coherence"] + "), q3 AS (" + ORACLE_SQL["i23_silhouette"] + "), q4 AS (" + ORACLE_SQL["i24_ch_index"] + "), q5 AS (" + ORACLE_SQL["i24_db_index"] + "), q6 AS (" + ORACLE_SQL["i26_cluster_balance"] + """),
z AS (SELECT (SELECT modularity FROM q1) AS m, (SELECT avg(coherence) FROM q2) AS c, (SELECT avg(silhouette_sq) FROM q3) AS s, greatest(0.0, 1 - (SELECT davies_bouldin FROM q5) / 3) AS b, q6.entropy / ln(q6.clusters) AS e, least(1.0, (SELECT calinski_harabasz FROM q4) / 1000) AS h FROM q6)
SELECT round(s, 5) AS silhouette, round(b, 5) AS davies_bouldin, round(m, 5) AS modularity, round(e, 5) AS balance, round(c, 5) AS coherence, round(h, 5) AS calinski_harabasz, round((s + b + m + c) / 4, 5) AS overall FROM z""")
def i30_dashboard(s, d):
    e = emb(s, d)
    return M.dashboard(K.modularity(edges(s, d), regions(s, d)), coherence(s, d), K.silhouette(e, *_E), K.ch_index(e, *_E), K.db_index(e, *_E), K.cluster_balance(regions(s, d)))


@query()
def i34_shared_pca(s, d):
    return M.shared_pca(emb(s, d), "vec_id", "embedding")


_ST = lambda c, n: f"round(avg({c}), 6) AS {n}_mean, round(stddev_pop({c}), 6) AS {n}_std, min({c}) AS {n}_min, max({c}) AS {n}_max"


@query(_FC + f" SELECT toxic, {_ST('p', 'pred')}, {_ST('quality', 'target')}, round(avg((quality > 0.001)::INTEGER), 6) AS target_nonzero, round(var_pop(quality), 6) AS target_variance FROM fc GROUP BY toxic")
def j2_prediction_report(s, d):
    return M.prediction_report(forecasts(s, d), ["toxic"], "p", "quality")
