"""Queries of training samples, scenario profiles, archetypes and cluster descriptions."""

from __future__ import annotations

from pyspark.sql import functions as F

from popgraph.operators import archetypes as T
from popgraph.operators import evaluation as V
from popgraph.operators import panel as P
from popgraph.operators import samples as S
from popgraph.operators import scenarios as C
from popgraph.plans.stage import stage
from popgraph.queries.base import ORACLE_SQL, neighbors, query, read
from popgraph.queries.behaviour import _AXES, axes
from popgraph.queries.features import _AG, _flag, _vec, profiles
from popgraph.queries.panels import _NEXT, _RATE, panel
from popgraph.queries.quality import _EM, _T5, emb


def written_panel(s, d):
    """The panel of the events as a table: its windows run once."""
    return stage(panel(s, d), "panel")


def vectors(s, d):
    return emb(s, d).select(F.col("vec_id").alias("agent_id"), "embedding")


_SICK = "state IN ('E', 'I')"
_PEOPLE = _AG + ", pe AS (SELECT * FROM ag WHERE agent_id IN (SELECT agent_id FROM panel)), pr AS (SELECT cluster_id, count(*) AS n, avg(age) AS age, stddev_pop(age) AS age_std, avg(vaccination_status) AS vaccine, avg(comorbidity_count) AS health, " + (
    f"avg({_flag('occupation IN ' + str(S.EXPOSED_JOBS))}::DOUBLE) AS jobs, avg(compliance_score::DOUBLE) AS compliance, stddev_pop(compliance_score::DOUBLE) AS compliance_std, avg(mobility_score::DOUBLE) AS mobility, avg((gender = 'M')::INTEGER) AS male, avg(is_imported::INTEGER) AS imported, avg(quarantined::INTEGER) AS quarantine, "
    "CASE WHEN avg((cluster LIKE '%dorm%')::INTEGER) > 0.3 OR avg((occupation = 'manual_worker')::INTEGER) > 0.5 THEN 1.0 ELSE 0.0 END::DOUBLE AS dormitory FROM pe GROUP BY cluster_id)"
)
_TAB = _EM + _PEOPLE + f""", lk AS (SELECT n.agent_id, n.other_id, a.cluster_id AS own, b.cluster_id AS oth, a.household_id = b.household_id AS hh, a.age AS aa, b.age AS ba FROM nb n JOIN pe a ON a.agent_id = n.agent_id JOIN pe b ON b.agent_id = n.other_id),
dg AS (SELECT p.cluster_id, count(lk.other_id) AS d, count(*) FILTER (own = oth) AS i, count(*) FILTER (own = oth AND hh) AS h, count(*) FILTER (own = oth AND aa < 18 AND ba > 65) AS o, count(*) FILTER (aa < 18) AS y FROM pe p LEFT JOIN lk ON lk.agent_id = p.agent_id GROUP BY p.agent_id, p.cluster_id),
lp AS (SELECT cluster_id, avg(d) AS degree, stddev_pop(d) AS degree_std, sum(i) AS inside, coalesce(sum(h) / nullif(sum(d), 0), 0.0) AS household, coalesce(sum(o) / nullif(sum(y), 0), 0.0) AS young_old FROM dg GROUP BY cluster_id),
mt AS (SELECT lk.agent_id, q.day, count(*) FILTER ({_SICK}) AS sick, count(*) FILTER ({_SICK} AND own <> oth) AS outside, count(*) FILTER (state = 'S') AS well FROM lk JOIN panel q ON q.agent_id = lk.other_id GROUP BY ALL),
pn AS (SELECT pe.cluster_id, p.day, p.state, p.days_in_state, max((p.state <> 'S')::INTEGER) OVER (PARTITION BY p.agent_id ORDER BY p.day) AS gone, coalesce(sick, 0) AS sick, coalesce(outside, 0) AS outside, coalesce(well, 0) AS well
  FROM panel p JOIN pe ON pe.agent_id = p.agent_id LEFT JOIN mt ON mt.agent_id = p.agent_id AND mt.day = p.day),
dp AS (SELECT cluster_id, day, {', '.join(f"count(*) FILTER (state = '{s}') AS {s}" for s in P.STATES)}, {', '.join(f"coalesce(avg(days_in_state) FILTER (state = '{s}'), 0) AS days_{s}" for s in S.LONG_STAY)},
  sum(outside) AS outside, coalesce(avg(sick) FILTER (state = 'S'), 0) AS exposure, coalesce(sum(well) FILTER ({_SICK}), 0) AS spread, sum(gone) AS gone FROM pn GROUP BY cluster_id, day),
db AS (SELECT *, lag(E + I, 3) OVER (PARTITION BY cluster_id ORDER BY day) AS b FROM dp), po AS (SELECT cluster_id, avg(x) AS pooled, stddev_pop(x) AS pooled_std FROM lv JOIN pe ON agent_id = vec_id GROUP BY cluster_id),
tb AS (SELECT cluster_id, day, """ + _vec(
    *[f"{s} / n" for s in P.STATES], "age / 100", "age_std / 50", "vaccine / 2", "health / 5", "jobs", "compliance", "mobility", "male", "imported", "quarantine", "dormitory",
    "degree / 50", "degree_std / 25", "coalesce(inside / nullif(n * (n - 1), 0), 0)", "outside / n", "coalesce(pooled, 0)", "coalesce(pooled_std, 0)", "0.5::DOUBLE",
    "(E + I) / n", *[f"least(days_{s} / {k}, 1)" for s, k in S.LONG_STAY.items()], "exposure / 10", "CASE WHEN b IS NULL THEN 0.5 ELSE greatest(-0.5, least(0.5, (E + I - b) / n)) + 0.5 END", "gone / n", "day / 200", "0.0::DOUBLE",
    "household", "young_old", "compliance_std", "spread / n",
) + " AS features FROM db JOIN pr USING (cluster_id) JOIN lp USING (cluster_id) LEFT JOIN po USING (cluster_id))"


@query(_TAB + " SELECT * FROM tb")
def d17_cluster_tabular(s, d):
    return S.cluster_tabular(profiles(s, d), written_panel(s, d), neighbors(s, d), vectors(s, d))


_NEW = lambda a, b: f"avg((state = '{b}' AND coalesce(b, '') = '{a}')::INTEGER)"
_SEQ = f""", pb AS (SELECT pe.cluster_id, p.day, p.state, lag(p.state) OVER (PARTITION BY p.agent_id ORDER BY p.day) AS b FROM panel p JOIN pe ON pe.agent_id = p.agent_id),
sd AS (SELECT cluster_id, day, {', '.join(f"avg((state = '{s}')::INTEGER) AS {s}" for s in P.STATES)}, {_NEW('S', 'E')} AS ne, {_NEW('E', 'I')} AS ni FROM pb GROUP BY cluster_id, day),
sv AS (SELECT cluster_id, day, """ + _vec("S", "E", "I", "R", "D", "ne", "ni", "E + I", "CASE WHEN dormitory > 0 THEN 0.75 ELSE 0.4 END", "CASE WHEN day >= 110 THEN 0.6 WHEN day >= 50 THEN 0.9 ELSE 0.3 END") + """ AS x FROM sd JOIN pr USING (cluster_id)),
sw AS (SELECT cluster_id, day, list(x) OVER (PARTITION BY cluster_id ORDER BY day ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS q FROM sv),
sq AS (SELECT cluster_id, day, list_concat([0.0::DOUBLE FOR i IN range(10 * (8 - len(q)))], flatten(q)) AS sequence FROM sw)"""


@query(_PEOPLE + _SEQ + " SELECT * FROM sq")
def e7_cluster_sequence(s, d):
    return S.cluster_sequence(profiles(s, d), written_panel(s, d)).withColumn("sequence", F.flatten("sequence"))


@query(_TAB + _SEQ + _NEXT + f""", lb AS (SELECT cluster_id, day, {_RATE} FROM nx JOIN (SELECT agent_id FROM pe) USING (agent_id) WHERE n IS NOT NULL GROUP BY cluster_id, day),
gm AS (SELECT cluster_id, pos, round(avg(x), 6) AS m FROM lv JOIN pe ON agent_id = vec_id GROUP BY ALL), gr AS (SELECT cluster_id, list(m ORDER BY pos) AS graph FROM gm GROUP BY cluster_id)
SELECT cluster_id, day, features AS tabular, sequence AS temporal, graph, [{', '.join(_T5)}] AS labels FROM lb JOIN tb USING (cluster_id, day) JOIN sq USING (cluster_id, day) LEFT JOIN gr USING (cluster_id)""")
def d20_training_samples(s, d):
    return S.training_samples(profiles(s, d), written_panel(s, d), neighbors(s, d), vectors(s, d)).withColumn("temporal", F.flatten("temporal"))


_PARTS = ["tabular", "temporal", "graph"]
_ENTRIES = ", ds AS (" + ORACLE_SQL["d20_training_samples"] + """), en AS (SELECT cluster_id, day, 'tabular' AS field, generate_subscripts(tabular, 1) - 1 AS pos, unnest(tabular) AS x FROM ds UNION ALL SELECT cluster_id, day, 'graph', generate_subscripts(graph, 1) - 1, unnest(graph) FROM ds
  UNION ALL SELECT cluster_id, day, 'temporal', generate_subscripts(temporal, 1) - 1, unnest(temporal) FROM ds), ep AS (SELECT *, CASE WHEN field = 'temporal' THEN pos % 10 ELSE pos END AS place FROM en),
sl AS (SELECT field, place, avg(x) AS m, CASE WHEN stddev_samp(x) >= 1e-6 THEN stddev_samp(x) ELSE 1.0 END AS s FROM ep GROUP BY ALL)"""


def samples(s, d):
    return stage(S.training_samples(profiles(s, d), written_panel(s, d), neighbors(s, d), vectors(s, d)), "samples")


@query(_ENTRIES + ", z AS (SELECT cluster_id, day, field, list(round((x - m) / s, 5) ORDER BY pos) AS v FROM ep JOIN sl USING (field, place) GROUP BY ALL) SELECT cluster_id, day, max(v) FILTER (field = 'tabular') AS tabular, max(v) FILTER (field = 'temporal') AS temporal, max(v) FILTER (field = 'graph') AS graph FROM z GROUP BY cluster_id, day")
def d26_scale_samples(s, d):
    rows = samples(s, d)
    scaled = V.apply_array_scaler(rows, _PARTS, V.fit_array_scaler(rows, _PARTS)).withColumn("temporal", F.flatten("temporal"))
    return scaled.select("cluster_id", "day", *[F.transform(c, lambda x: F.round(x, 5)).alias(c) for c in _PARTS])


@query(_ENTRIES + " SELECT field, count(*) AS entries, count(*) FILTER (x IS NULL) AS nulls, count(*) FILTER (isnan(x)) AS nans, count(*) FILTER (isinf(x)) AS infs, count(*) FILTER (x NOT BETWEEN 0 AND 1) AS out_of_range FROM en GROUP BY field")
def d25_audit_samples(s, d):
    return V.audit_arrays(samples(s, d), _PARTS, 0.0, 1.0)


#: The scenario that an event type stands for; a day of a user is a trace.
KINDS = dict(zip(C.SCENARIOS, ("view", "click", "purchase", "error", "signup"), strict=True))


def traces(s, d):
    e = read(s, d, "events").select("user_id", F.to_date("ts").alias("day"), "event_type", F.floor(F.coalesce("value", F.lit(0.0)) * 100).alias("c"))
    g = e.groupBy("user_id", "day", "event_type").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n"))
    motifs = lambda x: F.create_map(*[y for i, f in enumerate(C.SCENARIOS[x], 1) for y in (F.lit(f), F.col("c") / (F.lit(100.0) * (F.col("n") + i)))])
    one = [F.max_by(motifs(x), F.when(F.col("event_type") == k, 1)).alias(x) for x, k in KINDS.items()]
    maps = F.map_filter(F.create_map(*[y for x in KINDS for y in (F.lit(x), F.col(x))]), lambda k, v: v.isNotNull())
    return g.groupBy("user_id", "day").agg(*one).select("user_id", "day", maps.alias("motifs"))


_SC = ", sc AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type, CAST(sum(CAST(floor(coalesce(value, 0) * 100) AS BIGINT)) AS BIGINT) AS c, count(*) AS k FROM events GROUP BY ALL), sp AS (SELECT user_id, day, " + ", ".join(
    f"max(c) FILTER (event_type = '{k}') AS c{i}, max(k) FILTER (event_type = '{k}') AS k{i}" for i, k in enumerate(KINDS.values())) + " FROM sc GROUP BY user_id, day)"
_X = lambda at, i: f"(c{at} / (100.0::DOUBLE * (k{at} + {i})))"
_I1 = _SC + ", i1 AS (SELECT user_id, [" + ", ".join(f"coalesce({_X(at, i)}, 0.0::DOUBLE)" for at, fs in enumerate(C.SCENARIOS.values()) for i in range(1, len(fs) + 1)) + "] AS profile FROM sp QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY day) = 1)"


@query(_I1 + " SELECT * FROM i1")
def i1_conditional_profile(s, d):
    return C.conditional_profile(traces(s, d), "user_id", "day")


def _contrast(name):
    kind, feature, suffix = name.split("_")
    one, two = [list(C.SCENARIOS).index(x) for x in C.PAIRS[suffix]]
    at = C.EXPOSURE.index(C.CONTRASTED[feature]) + 1
    a, b, va, vb = _X(one, at), _X(two, at), _X(one, 4), _X(two, 4)
    how = {"delta": f"{a} - {b}", "rel": f"({a} - {b}) / (abs({a}) + abs({b}) + 1e-6)", "gate": f"({a} - {b}) * (1 + (coalesce({va}, 0) + coalesce({vb}, 0)) / 2)"}
    return f"coalesce(CAST(sum(CAST(round(({how[kind]}) * 1000000) AS BIGINT)) AS BIGINT)::DOUBLE / (count({how[kind]}) * 1000000)::DOUBLE, 0.0::DOUBLE)"


_I2 = ", i2 AS (SELECT user_id, [" + ", ".join(_contrast(n) for n in C.contrastive_names()) + "] AS profile FROM sp GROUP BY user_id)"


def contrastive(s, d):
    return C.contrastive_profile(traces(s, d), "user_id")


@query(_SC + _I2 + " SELECT user_id, profile, len([x FOR x IN profile IF x <> 0]) > 0 AS contrasted FROM i2")
def i2_contrastive_profile(s, d):
    return contrastive(s, d)


_NAMED = lambda table, names: f"SELECT user_id % 10 AS c, unnest({names!r}) AS name, unnest(profile) AS v FROM {table}"
_ALL = f""", ct AS (SELECT user_id % 10 AS c, event_type AS name, count(*)::DOUBLE AS v FROM events GROUP BY ALL), un AS (UNPIVOT ax ON * EXCLUDE (doc_id) INTO NAME axis VALUE opt),
rw AS (SELECT 'archetypes' AS style, * FROM ct UNION ALL SELECT 'discovery', * FROM ct UNION ALL SELECT 'primary', c, name, v / sum(v) OVER (PARTITION BY c) FROM ct UNION ALL SELECT 'structured', doc_id % 10, axis || ':' || opt, 1 FROM un
  UNION ALL SELECT 'conditional', * FROM ({_NAMED('i1', C.profile_names())}) UNION ALL SELECT 'contrastive', * FROM ({_NAMED('i2', C.contrastive_names())})),
sm AS (SELECT style, c, name, sum(v) AS v FROM rw GROUP BY ALL), tp AS (SELECT *, row_number() OVER (PARTITION BY style, c ORDER BY round(abs(v), 6) DESC, name) AS r FROM sm QUALIFY r <= 5),
gp AS (SELECT style, c, split_part(name, ':', 1) AS g, split_part(name, ':', 2) AS item, v, r FROM tp WHERE style IN ('structured', 'conditional') QUALIFY row_number() OVER (PARTITION BY style, c, g ORDER BY r) = 1),
gq AS (SELECT *, row_number() OVER (PARTITION BY style, c ORDER BY r) AS q FROM gp)"""
_TOLD = """
SELECT style, c AS cluster_id, CASE WHEN count(*) = 1 OR max(v) > 0.5 * sum(v) THEN 'Dominated by: ' || max(name) FILTER (r = 1) WHEN style = 'discovery' THEN 'Mixed: ' || string_agg(name, ' | ' ORDER BY r) FILTER (r <= 3) ELSE 'Mixed: ' || string_agg(name, ' + ' ORDER BY r) FILTER (r <= 3) END AS description FROM tp WHERE style IN ('archetypes', 'discovery') GROUP BY style, c
UNION ALL SELECT style, c, 'Primarily ' || max(name) FILTER (r = 1) || ' (' || CAST(round(100 * max(v) FILTER (r = 1)) AS BIGINT) || '%), with ' || max(name) FILTER (r = 2) || ' tendencies' FROM tp WHERE style = 'primary' GROUP BY style, c
UNION ALL SELECT style, c, string_agg(item, ' + ' ORDER BY r) FROM gq WHERE style = 'structured' AND q <= 3 GROUP BY style, c
UNION ALL SELECT style, c, string_agg(split_part(g, '_', 1) || ':' || split_part(item, '_', 1) || '=' || printf('%.2f', v), ' + ' ORDER BY r) FROM gq WHERE style = 'conditional' AND q <= 2 GROUP BY style, c
UNION ALL SELECT style, c, string_agg(split_part(name, '_', 2) || CASE WHEN v > 0 THEN ' higher (' ELSE ' lower (' END || CASE split_part(name, '_', 3) WHEN 'hw' THEN 'home vs work' WHEN 'hc' THEN 'home vs community' ELSE 'work vs community' END || ')', ' + ' ORDER BY r) FROM tp WHERE style = 'contrastive' AND r <= 3 GROUP BY style, c"""


@query(_AXES + _I1 + _I2 + _ALL + _TOLD)
def h27_describe_cluster(s, d):
    tens = (F.col("user_id") % 10).alias("cluster_id")
    counts = read(s, d, "events").groupBy(tens, F.col("event_type").alias("name")).agg(F.count(F.lit(1)).cast("double").alias("v"))
    shares = counts.join(counts.groupBy("cluster_id").agg(F.sum("v").alias("_t")), "cluster_id").select("cluster_id", "name", (F.col("v") / F.col("_t")).alias("v"))
    ax = axes(s, d)
    options = ax.select((F.col("doc_id") % 10).alias("cluster_id"), F.explode(F.array(*[F.concat(F.lit(f"{a}:"), F.col(a)) for a in ax.columns if a != "doc_id"])).alias("name"), F.lit(1.0).alias("v"))
    named = lambda df, names: df.select(tens, F.explode(F.arrays_zip(F.array(*map(F.lit, names)).alias("name"), F.col("profile").alias("v"))).alias("e")).select("cluster_id", "e.name", "e.v")
    rows = {
        "archetypes": counts, "discovery": counts, "primary": shares, "structured": options,
        "conditional": named(C.conditional_profile(traces(s, d), "user_id", "day"), C.profile_names()), "contrastive": named(contrastive(s, d), C.contrastive_names()),
    }
    out = None
    for style, df in rows.items():
        told = C.top_entries(df, "cluster_id", "name", "v").select(F.lit(style).alias("style"), "cluster_id", C.describe_cluster(F.col("top"), style).alias("description"))
        out = told if out is None else out.unionByName(told)
    return out


def described(s, d):
    ax = axes(s, d)
    return ax.select("doc_id", F.concat_ws(" ", *[F.translate(F.col(a), "_", " ") for a in ax.columns if a != "doc_id"]).alias("description"))


@query()
def i7_archetypes(s, d):
    return T.archetypes(described(s, d), "doc_id")[0]


@query()
def i7_archetype_catalogue(s, d):
    return T.archetypes(described(s, d), "doc_id")[1]
