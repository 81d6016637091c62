"""Queries of behavioural axes, risk multipliers, cluster analysis and refinement."""

from __future__ import annotations

from pyspark.sql import functions as F

from popgraph.operators import axes as A
from popgraph.operators import clusters as K
from popgraph.operators import features as X
from popgraph.operators import motifs as M
from popgraph.operators import risk as R
from popgraph.operators import text as T
from popgraph.operators.refinement import refine_clusters
from popgraph.plans.stage import new_path
from popgraph.queries.base import ORACLE_SQL, agents, edges, neighbors, query, read
from popgraph.queries.entities import _DOCS, _NBS, contacts, said
from popgraph.queries.features import _AG, _PF, h7_continuous_features, patterns, profiles
from popgraph.queries.panels import panel
from popgraph.queries.quality import _E, _EM, emb
from popgraph.sources import tables


@query("SELECT agent_id, age, gender, occupation, household_id, cluster, vaccination_status, comorbidity_count, round(compliance_score::DOUBLE, 9) AS compliance_score FROM agents")
def a2_read_profiles(s, d):
    path = new_path(s, "profiles")
    agents(s, d).select("agent_id", "age", "gender", "occupation", "household_id", "cluster", "vaccination_status", "comorbidity_count", "compliance_score").write.json(path)
    return tables.read_profiles(s, path, multi_line=False).withColumn("compliance_score", F.round("compliance_score", 9))


def _any(words):
    return "regexp_matches(l, '" + "|".join(words) + "')"


def _n(words):
    return "(" + " + ".join(f"contains(l, '{w}')::INTEGER" for w in words) + ")"


@query(_DOCS + f", lo AS (SELECT doc_id, lower(coalesce(t, '')) AS l FROM tx) SELECT doc_id, CAST({_n(T.TOOLS)} AS BIGINT) AS tools FROM lo")
def h6_tools_mentioned(s, d):
    return said(s, d).select("doc_id", T.hits(F.lower(F.coalesce("t", F.lit(""))), T.TOOLS).cast("long").alias("tools"))


_AX = {axis: "CASE " + " ".join(f"WHEN {_any(w)} THEN '{label}'" for label, w in rules) + f" ELSE '{default}' END" for axis, (rules, default) in A.AXES.items()}
_AX["risk_posture"] = f"CASE WHEN {_any(A.IGNORING)} THEN 'risk_ignoring' WHEN {_n(A.AVERSE)} > {_n(A.MINIMIZING)} THEN 'risk_averse' WHEN {_n(A.MINIMIZING)} > {_n(A.AVERSE)} THEN 'risk_minimizing' WHEN {_any(A.WATCHING)} THEN 'risk_averse' ELSE 'risk_neutral' END"
_AXES = _DOCS + ", ax AS (SELECT doc_id, " + ", ".join(f"{c} AS {a}" for a, c in _AX.items()) + " FROM (SELECT doc_id, lower(coalesce(t, '')) AS l FROM tx))"


def axes(s, d):
    low = said(s, d).select("doc_id", F.lower("t").alias("l"))
    return low.select("doc_id", *[c.alias(a) for a, c in A.keyword_axes(F.col("l")).items()])


@query(_AXES + " SELECT * FROM ax")
def h8_keyword_axes(s, d):
    return axes(s, d)


_MULTI = ", ".join(f"max(CASE WHEN {a} = '{o}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)" for a, os in A.OPTIONS.items() for o in os)


@query(_AXES + f" SELECT doc_id % 100 AS entity, [{_MULTI}] AS profile FROM ax GROUP BY 1")
def i5_structured_profile(s, d):
    return A.structured_profile(axes(s, d).withColumn("entity", F.col("doc_id") % 100), "entity")


@query(_AXES + f", i5 AS (SELECT doc_id, [{_MULTI}] AS profile FROM ax GROUP BY 1), h7 AS ({ORACLE_SQL['h7_continuous_features']}) SELECT doc_id, list_concat(profile, features) AS profile FROM i5 JOIN h7 USING (doc_id)")
def i6_hybrid_profile(s, d):
    j = A.structured_profile(axes(s, d), "doc_id").join(h7_continuous_features(s, d), "doc_id")
    return j.select("doc_id", F.concat("profile", "features").alias("profile"))


_PLAIN = ", ".join(f"'{w}'" for w in A.PLAIN_WORDS)


@query(f""", w AS (SELECT source, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents), c AS (SELECT source, word, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, word) AS r FROM w WHERE word NOT IN ({_PLAIN}) GROUP BY source, word),
n AS (SELECT source, max(word) FILTER (r = 1) AS a, max(word) FILTER (r = 2) AS b FROM c GROUP BY source)
SELECT k.source, CASE WHEN b IS NOT NULL THEN a || '_' || b || '_archetype' WHEN a IS NOT NULL THEN a || '_pattern' ELSE 'mixed_behavioral_pattern' END AS name FROM (SELECT DISTINCT source FROM documents) k LEFT JOIN n ON k.source IS NOT DISTINCT FROM n.source""")
def h28_archetype_names(s, d):
    return A.archetype_names(read(s, d, "documents"), "source", "text")


_MARK = "CASE event_type WHEN 'view' THEN 'State: S; Transition: S->E now' WHEN 'error' THEN 'State: I' WHEN 'click' THEN 'Transition: E->I' ELSE event_type END"


@query(f", m AS (SELECT event_id, {_MARK} AS t FROM events) SELECT event_id, 'pattern_' || coalesce(nullif(regexp_extract(t, 'State:\\s*([^;]*[^;\\s])', 1), ''), 'S') || '_' || coalesce(nullif(regexp_extract(t, 'Transition:\\s*(\\S+)', 1), ''), 'unknown') AS name FROM m")
def h29_pattern_name(s, d):
    return read(s, d, "events").select("event_id", A.pattern_name(F.expr(_MARK)).alias("name"))


@query(""", nr AS (SELECT n.agent_id, p.day, string_agg('#' || p.agent_id, ', ' ORDER BY p.agent_id) FILTER (p.state = 'I') AS sick, string_agg('#' || p.agent_id, ', ' ORDER BY p.agent_id) FILTER (p.state = 'D' AND p.days_in_state <= 10) AS dead FROM nb n JOIN panel p ON p.agent_id = n.other_id GROUP BY n.agent_id, p.day)
SELECT a.agent_id, p.day, concat_ws('; ', CASE state WHEN 'I' THEN 'infected for ' || days_in_state || ' days' WHEN 'R' THEN 'recovered ' || days_in_state || ' days ago' ELSE 'healthy' END, 'infected contacts: ' || sick, 'mourned contacts: ' || dead) AS text FROM agents a JOIN panel p ON p.agent_id = a.agent_id LEFT JOIN nr ON nr.agent_id = a.agent_id AND nr.day = p.day""")
def h30_perception_text(s, d):
    return A.perception_text(agents(s, d), panel(s, d), neighbors(s, d))


_V = lambda what: f"(CASE vaccination_status WHEN 0 THEN {R.VACCINE_EFFECT[what][0]} WHEN 1 THEN {R.VACCINE_EFFECT[what][1]} ELSE {R.VACCINE_EFFECT[what][2]} END)::DOUBLE"
_AGE = lambda y, o: f"(CASE WHEN age < 18 THEN {y} WHEN age > 60 THEN {o} ELSE 1.0 END)::DOUBLE"
_SICK = "(1 + 0.15::DOUBLE * comorbidity_count)"
_OR = "(CASE occupation " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in R.OCCUPATION_RISK.items()) + " ELSE 1.0 END)::DOUBLE"


@query(_NBS + _AG + f""", x AS (SELECT a.*, p.day, p.days_in_state AS dd, coalesce(n.household_infected, 0) AS hi, coalesce(n.infected, 0) AS ni FROM ag a JOIN panel p ON p.agent_id = a.agent_id LEFT JOIN nbs n ON n.agent_id = a.agent_id AND n.day = p.day)
SELECT agent_id, day, round({_V('exposure')} * (CASE WHEN quarantined THEN 0.2 ELSE 1.0 END)::DOUBLE * (CASE WHEN cluster LIKE '%dorm%' THEN 2.5 ELSE 1.0 END)::DOUBLE * (1 + CASE WHEN hi > 0 THEN 0.18::DOUBLE * hi WHEN ni > 0 THEN 0.035::DOUBLE * ni ELSE 0.005 END) * {_AGE(0.7, 1.3)} * {_SICK} * {_OR} * (2 - compliance_score::DOUBLE), 6) AS s_e,
 round((CASE WHEN dd < 2 THEN 0.0 WHEN dd < 4 THEN 0.5 ELSE least(1 + 0.3::DOUBLE * (dd - 4), 2.0) END) * {_V('progression')} * {_AGE(0.9, 1.3)} * {_SICK}, 6) AS e_i,
 round((CASE WHEN dd < 7 THEN 0.0 WHEN dd < 10 THEN 0.4 ELSE least(1 + 0.2::DOUBLE * (dd - 10), 2.5) END) * {_V('recovery')} * {_AGE(1.3, 0.7)} * pow(0.85::DOUBLE, comorbidity_count), 6) AS i_r,
 round((CASE WHEN age < 20 THEN 0.00002 WHEN age < 50 THEN 0.0005 WHEN age < 70 THEN 0.005 ELSE 0.07 END)::DOUBLE * 0.3 / 0.0015::DOUBLE * (CASE WHEN dd < 7 THEN 0.05 WHEN dd <= 14 THEN 1.5 ELSE 0.2 END)::DOUBLE * (1 + 0.5::DOUBLE * comorbidity_count) * {_V('death')}, 6) AS i_d,
 CASE WHEN dd < 180 THEN 0.0 ELSE 1.0 END::DOUBLE AS r_s FROM x""")
def h18_risk_multiplier(s, d):
    j = profiles(s, d).join(panel(s, d).select("agent_id", "day", "days_in_state"), "agent_id").join(contacts(s, d), ["agent_id", "day"], "left")
    return j.select("agent_id", "day", *[F.round(c, 6).alias(n) for n, c in R.risk_multipliers().items()])


_SPAN = lambda s, n: f"min(days_in_state) FILTER (state = '{s}') AS min_days_{n}, max(days_in_state) FILTER (state = '{s}') AS max_days_{n}"
_MEAN = lambda s, n: f"round(coalesce(avg(days_in_state) FILTER (state = '{s}'), 0.0), 6) AS avg_days_{n}"
_SA = _NBS + f""", sa AS (SELECT a.cluster_id, p.day, count(*) AS size, count(*) FILTER (state IN ('E', 'I')) AS infected, round(coalesce(avg(n.infected) FILTER (state = 'S' AND n.infected > 0), 0.0), 6) AS mean_infected_contacts, count(*) FILTER (state = 'S' AND n.infected > 0) AS exposed_susceptible,
 {_MEAN('E', 'exposed')}, {_SPAN('E', 'exposed')}, count(*) FILTER (state = 'E' AND days_in_state BETWEEN 2 AND 5) AS peak_incubation, {_MEAN('I', 'infected')}, {_SPAN('I', 'infected')}, count(*) FILTER (state = 'I' AND days_in_state >= 10) AS overdue,
 count(*) FILTER (state = 'I' AND age >= 70) AS elderly_infected, count(*) FILTER (state = 'I' AND age >= 50 AND age < 70) AS middle_aged_infected, count(*) FILTER (state = 'I' AND days_in_state BETWEEN 7 AND 14) AS peak_risk, count(*) FILTER (state = 'I' AND comorbidity_count >= 2) AS comorbid_infected,
 {_MEAN('R', 'recovered')}, {_SPAN('R', 'recovered')}, count(*) FILTER (state = 'R' AND days_in_state >= 180) AS waning, count(*) FILTER (state = 'D' AND days_in_state <= 10) AS mourned, round(avg(age) FILTER (state = 'D'), 6) AS mean_age_dead
FROM agents a JOIN panel p ON p.agent_id = a.agent_id LEFT JOIN nbs n ON n.agent_id = a.agent_id AND n.day = p.day GROUP BY a.cluster_id, p.day)"""


@query(_SA + " SELECT * FROM sa")
def d14_state_analysis(s, d):
    return R.state_analysis(agents(s, d), panel(s, d), contacts(s, d), "cluster_id")


@query(_SA + _AG + f""", df AS ({ORACLE_SQL['d12_dormitory_flag']}), qf AS ({ORACLE_SQL['d15_quarantine_factor']}), xf AS (SELECT cluster_id, day, factor AS death FROM ({ORACLE_SQL['d16_death_factor']})), z AS (SELECT sa.*, death, infected / size AS prev, CASE WHEN is_dormitory AND infected / size > 0.05 THEN 2.5 ELSE 1.0 END::DOUBLE * factor * 1.5::DOUBLE AS push FROM sa JOIN df USING (cluster_id) JOIN qf USING (cluster_id) JOIN xf USING (cluster_id, day))
SELECT cluster_id, day, round(CASE WHEN infected > 0 THEN greatest(0.03::DOUBLE * push, (CASE WHEN prev < 0.1 THEN 0.02 WHEN prev < 0.3 THEN 0.035 ELSE 0.05 END)::DOUBLE * greatest(0.3, least(1.0, mean_infected_contacts / 3.0)) * push) ELSE 0.03 END, 6) AS s_e,
 round(greatest(0.1::DOUBLE, CASE WHEN avg_days_exposed < 2 THEN 0.0 WHEN avg_days_exposed < 3 THEN 0.05 WHEN avg_days_exposed < 4 THEN 0.15 WHEN avg_days_exposed < 5 THEN 0.25 WHEN avg_days_exposed < 6 THEN 0.3 ELSE 0.35 END), 6) AS e_i,
 round(greatest(0.05::DOUBLE, least(0.35, CASE WHEN avg_days_infected < 7 THEN 0.0 WHEN avg_days_infected < 10 THEN 0.05 + 0.017::DOUBLE * (avg_days_infected - 7) WHEN avg_days_infected < 14 THEN 0.1 + 0.025::DOUBLE * (avg_days_infected - 10) ELSE 0.2 + 0.02::DOUBLE * least(avg_days_infected - 14, 5.0) END)), 6) AS i_r,
 round(CASE WHEN avg_days_infected < 7 THEN 0.0 WHEN avg_days_infected <= 14 THEN greatest(0.004::DOUBLE, 0.0006::DOUBLE * death * (avg_days_infected - 7)) ELSE 0.004 END, 6) AS i_d FROM z""")
def h23_calibrate_cluster(s, d):
    a = profiles(s, d)
    j = R.state_analysis(a, panel(s, d), contacts(s, d), "cluster_id").join(X.dormitory_flags(a, "cluster_id"), "cluster_id").join(X.quarantine_factor(a, "cluster_id"), "cluster_id")
    j = j.join(X.death_factor(a, panel(s, d), "cluster_id").withColumnRenamed("factor", "death"), ["cluster_id", "day"])
    start = {"s_e": F.lit(0.03), "e_i": F.lit(0.1), "i_r": F.lit(0.05), "i_d": F.lit(0.004)}
    p = R.calibrated(start, F.col("is_dormitory"), F.col("factor"), F.lit(1.5), F.col("death"))
    return j.select("cluster_id", "day", *[F.round(c, 6).alias(n) for n, c in p.items()])


def tens(p):
    return p.select("user_id", (F.col("user_id") % 10).alias("cluster_id")).distinct()


_JS = _PF + """, cs AS (SELECT user_id % 10 AS c, event_type AS m, sum(share) AS s FROM pf GROUP BY ALL), cp AS (SELECT c, m, s / sum(s) OVER (PARTITION BY c) AS p FROM cs),
cc AS (SELECT x.c AS a, y.c AS b, mm.m FROM (SELECT DISTINCT c FROM cp) x JOIN (SELECT DISTINCT c FROM cp) y ON x.c < y.c, (SELECT DISTINCT m FROM cp) mm), pq AS (SELECT a, b, coalesce(x.p, 0) AS p, coalesce(y.p, 0) AS q FROM cc LEFT JOIN cp x ON x.c = a AND x.m = cc.m LEFT JOIN cp y ON y.c = b AND y.m = cc.m)"""


@query(_JS + " SELECT a, b, round(sum(CASE WHEN p > 0 THEN p * ln(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(2 * q / (p + q)) ELSE 0 END) / 2, 9) AS divergence FROM pq GROUP BY a, b")
def i19_cluster_divergence(s, d):
    p = patterns(s, d)
    return M.cluster_divergence(p, tens(p), "user_id", "event_type")


_MERGED = """, fd AS (SELECT list_reduce(list_prepend({'a': -1::BIGINT, 'b': -1::BIGINT, 'left': (SELECT list(DISTINCT c) FROM cs), 'm': []::STRUCT(a BIGINT, b BIGINT)[]},
  coalesce(list({'a': a, 'b': b, 'left': []::BIGINT[], 'm': []::STRUCT(a BIGINT, b BIGINT)[]} ORDER BY divergence, a, b), [])),
  lambda t, x: CASE WHEN len(t.left) > 2 AND list_contains(t.left, x.a) AND list_contains(t.left, x.b) THEN {'a': x.a, 'b': x.b, 'left': list_filter(t.left, lambda q: q <> x.b), 'm': list_append(t.m, {'a': x.a, 'b': x.b})} ELSE t END) AS r FROM dv WHERE divergence < 0.002),
mg AS (SELECT u.a AS a, u.b AS b FROM (SELECT unnest(r.m) AS u FROM fd)),
rt(c, root) AS (SELECT DISTINCT c, c FROM cs UNION ALL SELECT rt.c, mg.a FROM rt JOIN mg ON rt.root = mg.b),
fi AS (SELECT c, CAST(dense_rank() OVER (ORDER BY root) - 1 AS INTEGER) AS new FROM rt WHERE root NOT IN (SELECT b FROM mg))
SELECT user_id, new AS cluster_id FROM (SELECT DISTINCT user_id FROM pf) JOIN fi ON user_id % 10 = c"""


@query(_JS + ", dv AS (SELECT a, b, round(sum(CASE WHEN p > 0 THEN p * ln(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(2 * q / (p + q)) ELSE 0 END) / 2, 9) AS divergence FROM pq GROUP BY a, b)" + _MERGED)
def i19_merge_clusters(s, d):
    p = patterns(s, d)
    return M.merge_clusters(tens(p), M.cluster_divergence(p, tens(p), "user_id", "event_type"), "user_id", 0.002)


@query(_PF + """, n AS (SELECT user_id % 10 AS cluster_id, count(DISTINCT user_id) AS n FROM pf GROUP BY 1), sq AS (SELECT user_id % 10 AS cluster_id, event_type, sum(share) AS s, sum(share * share) AS q FROM pf GROUP BY ALL),
g AS (SELECT cluster_id, n, s / sum(s) OVER (PARTITION BY cluster_id) AS p, q / n - pow(s / n, 2) AS v FROM sq JOIN n USING (cluster_id)), h AS (SELECT cluster_id, n, -sum(p * ln(p)) / ln(5) AS e, sum(v) / 5 AS v FROM g GROUP BY ALL)
SELECT cluster_id, n, round(e, 6) AS entropy, round(v, 6) AS spread, n >= 6 AND e > 0.5 AND v > 0.001 AS split FROM h""")
def i20_split_flags(s, d):
    p = patterns(s, d)
    return M.split_flags(p, tens(p), "user_id", "event_type", 5, 0.5, 0.001)


def _split_sql(rounds: int = 10) -> str:
    """2-means of the wide clusters, round by round."""
    far = "row_number() OVER (PARTITION BY label ORDER BY round(list_distance(v, {0}), 9) DESC, vec_id) = 1"
    steps = [
        _EM + ", wd AS (SELECT label, avg(list_distance(v, c)) AS w, count(*) AS n FROM em JOIN ca USING (label) GROUP BY label), fl AS (SELECT label FROM wd WHERE n >= 6 AND round(w, 6) > (SELECT avg(round(w, 6)) FROM wd))",
        "sr AS (SELECT em.label, vec_id, v, c FROM em JOIN ca USING (label) WHERE em.label IN (SELECT label FROM fl))",
        f"sa AS (SELECT label, v AS a FROM sr QUALIFY {far.format('c')})", f"c0 AS (SELECT label, a, v AS b FROM sr JOIN sa USING (label) QUALIFY {far.format('a')})",
    ]
    for k in range(rounds):
        steps.append(f"h{k} AS (SELECT label, vec_id, list_distance(v, b) < list_distance(v, a) AS h, v FROM sr JOIN c{k} USING (label))")
        steps.append(f"m{k} AS (SELECT label, h, list(x ORDER BY pos) AS m FROM (SELECT label, h, pos, avg(x) AS x FROM (SELECT label, h, unnest(v) AS x, unnest(range(64)) AS pos FROM h{k}) GROUP BY ALL) GROUP BY label, h)")
        steps.append(f"c{k + 1} AS (SELECT label, coalesce((SELECT m FROM m{k} WHERE m{k}.label = c{k}.label AND NOT h), a) AS a, coalesce((SELECT m FROM m{k} WHERE m{k}.label = c{k}.label AND h), b) AS b FROM c{k})")
    steps.append(f"hz AS (SELECT label, vec_id, list_distance(v, b) < list_distance(v, a) AS h FROM sr JOIN c{rounds} USING (label))")
    steps.append("kp AS (SELECT label, arg_min(h, vec_id) AS k FROM hz GROUP BY label), nr AS (SELECT label, row_number() OVER (ORDER BY label) AS r FROM fl)")
    steps.append("mv AS (SELECT vec_id, (SELECT max(label) FROM em) + r AS new FROM hz JOIN kp USING (label) JOIN nr USING (label) WHERE h <> k)")
    return ", ".join(steps) + " SELECT em.vec_id, CAST(coalesce(new, label) AS INTEGER) AS label FROM em LEFT JOIN mv ON em.vec_id = mv.vec_id"


@query(_split_sql())
def i20_split_clusters(s, d):
    wide = K.intra_distance(emb(s, d), *_E)
    flagged = wide.crossJoin(wide.agg(F.avg("mean_distance").alias("_all"))).where("size >= 6 and mean_distance > _all")
    return M.split_clusters(emb(s, d), flagged, *_E[:2], "vec_id")


_PULL = _EM + """, mo AS (SELECT vec_id, label, [abs(x) FOR x IN v[1:8]] AS w FROM em), ml AS (SELECT label, unnest(w) AS x, unnest(range(8)) AS pos FROM mo), mc AS (SELECT label, list(m ORDER BY pos) AS m FROM (SELECT label, pos, avg(x) AS m FROM ml GROUP BY ALL) GROUP BY label),
bd AS (SELECT vec_id FROM em, ca GROUP BY vec_id, em.label HAVING min(list_distance(v, c)) FILTER (ca.label = em.label) > 0.95 * min(list_distance(v, c)) FILTER (ca.label <> em.label)),
sz AS (SELECT label, count(*) AS n FROM em GROUP BY label), lk AS (SELECT n.agent_id AS vec_id, e.label, count(*) AS k FROM nb n JOIN em e ON e.vec_id = n.other_id GROUP BY ALL),
pl AS (SELECT em.vec_id, ca.label, round(0.5 * list_cosine_similarity(mo.w, mc.m) + 0.3 * exp(-list_distance(em.v, ca.c)) + 0.2 * coalesce(k, 0) / n, 9) AS pull FROM em JOIN bd USING (vec_id) JOIN mo ON mo.vec_id = em.vec_id CROSS JOIN ca JOIN mc ON mc.label = ca.label JOIN sz ON sz.label = ca.label LEFT JOIN lk ON lk.vec_id = em.vec_id AND lk.label = ca.label)"""


@query(_PULL + " SELECT vec_id, label FROM pl QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY pull DESC, label) = 1")
def i18_reassign(s, d):
    e = emb(s, d).withColumn("motif", F.transform(F.slice(F.col("embedding").cast("array<double>"), 1, 8), lambda x: F.abs(x)))
    return M.reassign(e, neighbors(s, d), M.boundary_entities(e, *_E), "label", "embedding", "motif", "vec_id")


_PART = lambda n, src: f"SELECT '{n}' AS part, avg(s) AS s FROM (SELECT pos, stddev_pop(x) AS s FROM {src} GROUP BY pos)"


@query(_EM + ", sq AS (SELECT pos, x * x AS x FROM lv WHERE pos < 16), pt AS (" + _PART("graph", "lv") + " UNION ALL " + _PART("motif", "sq") + "), cn AS (SELECT part, s * CASE part WHEN 'graph' THEN 0.6 ELSE 0.4 END::DOUBLE AS c FROM pt) SELECT part, round(c, 6) AS contribution, round(c / sum(c) OVER (), 6) AS share FROM cn")
def i13_fusion_contribution(s, d):
    v = F.col("embedding").cast("array<double>")
    e = emb(s, d).select("vec_id", v.alias("graph"), F.transform(F.slice(v, 1, 16), lambda x: x * x).alias("motif"))
    return M.fusion_contribution(e, "vec_id", {"graph": 0.6, "motif": 0.4})


@query()
def i35_compare_clusterings(s, d):
    links = edges(s, d).select(F.col("agent_1").alias("src"), F.col("agent_2").alias("dst"))  # either direction counts once
    return K.compare_clusterings(emb(s, d), "embedding", "vec_id", 8, links)


@query()
def i36_refine_clusters(s, d):
    e = emb(s, d).select("vec_id", "embedding", F.transform(F.slice(F.col("embedding").cast("array<double>"), 1, 8), lambda x: F.abs(x)).alias("motif"))
    told = refine_clusters(e, patterns(s, d).withColumnRenamed("user_id", "vec_id"), edges(s, d), "vec_id", "embedding", "motif", "event_type", 6, 5, threshold=0.6, rounds=2)
    return told.labels.withColumns({"best_round": F.lit(told.best), "score": F.lit(told.score)})
