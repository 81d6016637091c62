"""Queries of aggregates, clustering, retrieval and evaluation (C13, C14, D, F, I, J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from popgraph.operators import clusters as K
from popgraph.operators import evaluation as V
from popgraph.operators import panel as P
from popgraph.operators import reports as O
from popgraph.operators import retrieval as R
from popgraph.queries.base import agents, edges, query, read
from popgraph.queries.panels import _NEXT, _RATE, panel

_EM = ", em AS (SELECT vec_id, label, [x::DOUBLE FOR x IN embedding] AS v FROM embeddings), lv AS (SELECT vec_id, label, unnest(v) AS x, unnest(range(64)) AS pos FROM em), ct AS (SELECT label, pos, avg(x) AS c FROM lv GROUP BY ALL), ca AS (SELECT label, list(c ORDER BY pos) AS c FROM ct GROUP BY label)"


def emb(s, d):
    return read(s, d, "embeddings")


_E = ("label", "embedding", "vec_id")


#: The embeddings and, of every third, one that is alike: the table itself holds no near pair.
_ALIKE = _EM + ", ak AS (SELECT vec_id, label, v FROM em UNION ALL SELECT vec_id + 1000000, label, [x * (1 + 0.3 * CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END)::DOUBLE FOR x, i IN v] FROM em WHERE vec_id % 3 = 0), sp AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.v, b.v) AS c, a.label = b.label AS same_label, a.vec_id % 7 = b.vec_id % 7 AS same_home FROM ak a JOIN ak b ON a.vec_id < b.vec_id)"


def alike(s, d):
    e = emb(s, d).select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    near = F.transform("embedding", lambda x, i: x * F.when(i % 2 == 0, 1.3).otherwise(0.7))
    more = e.where("vec_id % 3 = 0").select((F.col("vec_id") + 1000000).alias("vec_id"), "label", near.alias("embedding"))
    return e.unionByName(more).withColumn("home", F.col("vec_id") % 7)


@query(_ALIKE + " SELECT a, b, round(c, 6) AS cosine, same_label, same_home FROM sp WHERE c > 0.9")
def c13_similar_pairs(s, d):
    return R.similar_pairs(alike(s, d), 0.9, flags=("label", "home")).withColumn("cosine", F.round("cosine", 6))


@query(""", tk AS (SELECT doc_id, unnest([x FOR x IN regexp_split_to_array(lower(text), '[^a-z]+') IF length(x) > 3]) AS term FROM documents), qt AS (SELECT DISTINCT item_id AS query, unnest([x FOR x IN regexp_split_to_array(lower(text), '[^a-z]+') IF length(x) > 3]) AS term FROM benchmark),
dt AS (SELECT doc_id AS doc, term, count(*) AS tf FROM tk WHERE term IN (SELECT term FROM qt) GROUP BY ALL), idf AS (SELECT term, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) AS idf FROM dt GROUP BY term),
sc AS (SELECT query, doc, round(sum((1 + ln(tf)) * idf), 6) AS score FROM qt JOIN dt USING (term) JOIN idf USING (term) GROUP BY ALL) SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM sc QUALIFY rank <= 3""")
def c14_top_k_documents(s, d):
    return R.top_k_documents(read(s, d, "benchmark"), read(s, d, "documents"), 3, "item_id", "doc_id")


_WORDS = "unnest([x FOR x IN regexp_split_to_array(lower({}), '[^a-z]+') IF length(x) > 3])"
_ASKED = f"""concat_ws(' ', 'assess risk', CASE agent_id % 4 {' '.join(f"WHEN {i} THEN '{R.CONTEXT[c]}'" for i, c in enumerate('SEIR'))} END, CASE WHEN age >= 60 THEN '{R.CONTEXT_ELDERLY}' END, replace(occupation, '_', ' '))"""


@query(f""", dx AS (SELECT doc_id, text || ' ' || CASE doc_id % 3 WHEN 0 THEN 'prevention of transmission' WHEN 1 THEN 'symptoms and recovery of elderly' ELSE 'quarantine household' END AS t FROM documents), tk AS (SELECT doc_id, {_WORDS.format('t')} AS term FROM dx), qt AS (SELECT DISTINCT query, {_WORDS.format('q')} AS term FROM (SELECT agent_id AS query, {_ASKED} AS q FROM agents)),
dt AS (SELECT doc_id AS doc, term, count(*) AS tf FROM tk WHERE term IN (SELECT term FROM qt) GROUP BY ALL), idf AS (SELECT term, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) AS idf FROM dt GROUP BY term),
sc AS (SELECT query, doc, round(sum((1 + ln(tf)) * idf), 6) AS score FROM qt JOIN dt USING (term) JOIN idf USING (term) GROUP BY ALL) SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM sc QUALIFY rank <= 2""")
def c14_context_documents(s, d):
    state = F.element_at(F.array(*[F.lit(c) for c in "SEIR"]), (F.col("agent_id") % 4 + 1).cast("int"))
    asked = agents(s, d).select("agent_id", R.context_query(F.col("age"), F.col("occupation"), state, F.lit("assess_risk")).alias("text"))
    more = F.when(F.col("doc_id") % 3 == 0, "prevention of transmission").when(F.col("doc_id") % 3 == 1, "symptoms and recovery of elderly").otherwise("quarantine household")
    docs = read(s, d, "documents").select("doc_id", F.concat("text", F.lit(" "), more).alias("text"))
    return R.context_documents(asked, docs, 2, "agent_id", "doc_id")


@query(_EM + """, ev AS (SELECT user_id AS agent_id, event_id AS node_id, value, date_trunc('second', ts) AS ts, m.v AS mv, q.v AS qv FROM (SELECT *, event_id % (SELECT count(*) FROM embeddings) AS mi, user_id % (SELECT count(*) FROM embeddings) AS qi FROM events) LEFT JOIN em m ON m.vec_id = mi LEFT JOIN em q ON q.vec_id = qi),
m AS (SELECT agent_id, node_id, round(pow(0.995::DOUBLE, floor(date_diff('second', ts, TIMESTAMP '2024-02-01')) / 3600) + value / 10 + coalesce(list_cosine_similarity(mv, qv), 0), 6) AS score FROM ev)
SELECT agent_id, node_id, score, row_number() OVER (PARTITION BY agent_id ORDER BY score DESC, node_id) AS rank FROM m QUALIFY rank <= 5""")
def c15_retrieve_memories(s, d):
    e = read(s, d, "events").select(F.col("user_id").alias("agent_id"), F.col("event_id").alias("node_id"), F.col("ts").alias("timestamp"), F.col("value").alias("importance"))
    vectors = emb(s, d).select(F.col("vec_id").alias("_i"), F.col("embedding").cast("array<double>").alias("_v"))
    e = e.crossJoin(F.broadcast(vectors.agg(F.count(F.lit(1)).alias("_all"))))  # one row
    e = e.join(vectors.withColumnRenamed("_v", "embedding"), F.col("node_id") % F.col("_all") == F.col("_i"), "left").drop("_i")
    e = e.join(vectors.withColumnRenamed("_v", "asked"), F.col("agent_id") % F.col("_all") == F.col("_i"), "left").drop("_i", "_all")
    return R.retrieve_memories(e, F.lit("2024-02-01").cast("timestamp"), 5, F.col("asked")).select("agent_id", "node_id", "score", "rank")


@query("SELECT DISTINCT event_type, length(event_type) AS value FROM events")
def c18_incremental_map(s, d):
    e = read(s, d, "events")
    cache = e.where("event_type = 'view'").select("event_type").distinct().withColumn("value", F.length("event_type"))
    return R.incremental_map(e, cache, "event_type", F.length("event_type"))


_PROFILE = "(SELECT *, agent_id % 6 AS disease_status, agent_id % 60 AS days_since_start FROM agents)"


@query(f""", p AS (SELECT * FROM {_PROFILE}), a AS (SELECT count(*) AS n, count(DISTINCT agent_id) AS ids, min(agent_id) AS low, max(agent_id) AS high, count(*) FILTER (disease_status NOT BETWEEN 0 AND 4) AS bad, count(*) FILTER (disease_status IN (1, 2)) AS seed, avg((vaccination_status > 0)::INTEGER) AS v FROM p)
SELECT 'missing_fields' AS "check", 4.0::DOUBLE AS value, false AS passed UNION ALL SELECT 'duplicate_ids', n - ids, n = ids FROM a UNION ALL SELECT 'dense_ids', high, low = 0 AND high = n - 1 FROM a UNION ALL SELECT 'invalid_states', bad, bad = 0 FROM a
UNION ALL SELECT 'infected_seed', seed, seed > 0 FROM a UNION ALL SELECT 'adequate_seed', seed, seed >= 5 FROM a UNION ALL SELECT 'vaccinated_share', round(v, 6), NULL FROM a
UNION ALL SELECT 'days_out_of_order', count(*), NULL FROM (SELECT days_since_start AS v, lag(days_since_start) OVER (ORDER BY agent_id) AS b FROM p) WHERE v < b""")
def d6_validate_profiles(s, d):
    k = F.col("agent_id")
    return O.validate_profiles(agents(s, d).withColumns({"disease_status": k % 6, "days_since_start": k % 60}))


@query("SELECT coalesce(occupation, '*') AS occupation, coalesce(gender, '*') AS gender, count(*) AS n, round(avg(age), 6) AS mean_age, round(avg(comorbidity_count), 6) AS comorbidity FROM agents GROUP BY GROUPING SETS ((occupation), (gender), ())")
def d8_summary_report(s, d):
    return O.summary_report(agents(s, d), ["occupation", "gender"])


_DIMS = ["gender", "region", "occupation", "cluster", "vaccination_status", "comorbidity_count"]


@query(", r AS (" + " UNION ALL ".join(f"SELECT '{c}' AS dimension, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM agents GROUP BY {c}" for c in _DIMS) + "), t AS (SELECT *, sum(n) OVER (PARTITION BY dimension) AS t FROM r) SELECT dimension, value, n, round(100 * n / t, 6) AS percent, row_number() OVER (PARTITION BY dimension ORDER BY n DESC, value) AS rank FROM t WHERE value IS NOT NULL AND lower(value) NOT IN ('', 'nan', 'none') QUALIFY rank <= 5")
def d8_top_values(s, d):
    return O.top_values(agents(s, d), _DIMS)


@query(", r AS (SELECT 'age' AS field, age::DOUBLE AS x FROM agents UNION ALL SELECT 'compliance_score', compliance_score FROM agents UNION ALL SELECT 'comorbidity_count', comorbidity_count FROM agents UNION ALL SELECT 'household_size', count(*) FROM agents GROUP BY household_id) SELECT field, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(min(x), 6) AS low, round(max(x), 6) AS high FROM r GROUP BY field")
def d8_score_report(s, d):
    return O.score_report(agents(s, d), ["age", "compliance_score", "comorbidity_count"])


_CT = """, tb AS (SELECT {0} AS c, avg((cluster LIKE '%dorm%')::INTEGER) AS dorm, avg((occupation = 'manual_worker')::INTEGER) AS manual, avg(is_imported::INTEGER) AS imp, count(*) AS n FROM {1} GROUP BY 1), th AS (SELECT c, max(k) AS h FROM (SELECT {0} AS c, household_id, count(*) AS k FROM {1} GROUP BY ALL) GROUP BY c),
tj AS (SELECT c, max(k) AS o FROM (SELECT {0} AS c, occupation, count(*) AS k FROM {1} GROUP BY ALL) GROUP BY c), ctype AS (SELECT c, CASE WHEN dorm > 0.3 OR manual > 0.5 THEN 'dormitory' WHEN imp > 0.5 THEN 'imported' WHEN h > n * 0.7 THEN 'household' WHEN o > n * 0.6 THEN 'workplace' ELSE 'community' END AS cluster_type FROM tb JOIN th USING (c) JOIN tj USING (c))"""


@query(", ac AS (SELECT * REPLACE (CASE WHEN agent_id % 10 = 3 THEN 'manual_worker' WHEN agent_id % 10 = 4 THEN 'baker' ELSE occupation END AS occupation, agent_id % 10 = 5 OR is_imported AS is_imported, CASE WHEN agent_id % 10 = 6 THEN 1 ELSE household_id END AS household_id) FROM agents)" + _CT.format("cluster_id", "ac") + " SELECT c AS cluster_id, cluster_type FROM ctype")
def d11_cluster_type(s, d):
    ten = lambda k: F.col("agent_id") % 10 == k
    a = agents(s, d).withColumns({
        "occupation": F.when(ten(3), "manual_worker").when(ten(4), "baker").otherwise(F.col("occupation")), "is_imported": ten(5) | F.col("is_imported"), "household_id": F.when(ten(6), 1).otherwise(F.col("household_id")),
    })
    return O.cluster_type(a, "cluster_id")


@query(", ac AS (SELECT *, agent_id % 13 = 0 AS quarantined FROM agents)" + _CT.format("cluster_id", "ac") + """, g AS (SELECT a.cluster_id, p.day, count(*) AS n, count(*) FILTER (state = 'S') AS S, count(*) FILTER (state = 'E') AS E, count(*) FILTER (state = 'I') AS I, count(*) FILTER (state = 'R') AS R, count(*) FILTER (state = 'D') AS D,
 round(avg(age) FILTER (state = 'D'), 6) AS mean_age_dead, count(*) FILTER (state = 'I' AND age >= 70) AS elderly_infected, count(*) FILTER (vaccination_status = 2) AS fully_vaccinated, count(*) FILTER (vaccination_status = 1) AS partly_vaccinated, count(*) FILTER (vaccination_status = 0) AS unvaccinated, count(*) FILTER (quarantined) AS quarantined, count(*) FILTER (is_imported) AS imported FROM ac a JOIN panel p ON p.agent_id = a.agent_id GROUP BY ALL)
SELECT g.* EXCLUDE (n), cluster_type, array_to_string(list_filter([CASE WHEN cluster_type = 'dormitory' AND I / n > 0.15 THEN 'dormitory_outbreak' END, CASE WHEN I / n > 0.3 THEN 'outbreak' WHEN I / n > 0.15 THEN 'elevated' END, CASE WHEN E / n > 0.2 THEN 'exposure_wave' END, CASE WHEN I > 0 AND R > I THEN 'recovery' END, CASE WHEN D > 0 THEN 'deaths' END], lambda x: x IS NOT NULL), ',') AS flags FROM g JOIN ctype ON c = cluster_id""")
def d13_monitor_clusters(s, d):
    return O.monitor_clusters(agents(s, d).withColumn("quarantined", F.col("agent_id") % 13 == 0), panel(s, d), "cluster_id")


@query("SELECT conv_id AS entity, count(*) AS turns, count(DISTINCT role) AS roles, string_agg(role, '>' ORDER BY turn, text) AS path FROM conversations GROUP BY conv_id")
def d21_aggregate_traces(s, d):
    return O.aggregate_traces(read(s, d, "conversations").withColumnRenamed("conv_id", "entity"), "entity", ["turn", "text"], "role")


_TOOL = "CASE event_type WHEN 'view' THEN 'check_infected_contacts' WHEN 'click' THEN 'query_knowledge' WHEN 'error' THEN 'check_symptoms' WHEN 'purchase' THEN 'query_contacts' ELSE 'check_days_infected' END"


@query(f""", e AS (SELECT user_id, CASE WHEN event_id % 3 > 0 AND user_id % 9 > 0 THEN {_TOOL} END AS tool, CASE WHEN event_id % 6 = 1 AND user_id % 9 > 0 THEN 'query_policy' END AS other, event_type AS scenario FROM events),
u AS (SELECT user_id, tool FROM e WHERE tool IS NOT NULL UNION ALL SELECT user_id, other FROM e WHERE other IS NOT NULL), c AS (SELECT user_id, tool, count(*) AS n FROM u GROUP BY ALL),
g AS (SELECT user_id, sum(n)::BIGINT AS calls, count(*) AS tools, round(-sum(n / t * ln(n / t + 1e-10)), 3) AS diversity, """ + ", ".join(f"round(coalesce(sum(n) FILTER (tool IN {tuple(names)}), 0) / any_value(t), 3) AS {name}_ratio" for name, names in O.TOOL_GROUPS.items()) + """, string_agg(tool || '=' || n, ',' ORDER BY tool) AS breakdown
FROM (SELECT *, sum(n) OVER (PARTITION BY user_id) AS t FROM c) GROUP BY user_id), d AS (SELECT user_id, count(*) AS decisions, count(DISTINCT scenario) AS scenarios FROM e GROUP BY user_id)
SELECT user_id, decisions, scenarios, coalesce(calls, 0) AS calls, coalesce(tools, 0) AS tools, coalesce(diversity, 0.0)::DOUBLE AS diversity, """ + ", ".join(f"coalesce({name}_ratio, 0.0)::DOUBLE AS {name}_ratio" for name in O.TOOL_GROUPS) + """, coalesce(breakdown, '') AS breakdown, round(coalesce(calls, 0) / decisions, 2) AS per_decision FROM d LEFT JOIN g USING (user_id)""")
def d22_tool_usage(s, d):
    """An event is a conversation with no, one or two calls; every ninth user calls nothing."""
    asks = F.col("user_id") % 9 > 0
    called = F.array_compact(F.array(F.when((F.col("event_id") % 3 > 0) & asks, F.expr(_TOOL)), F.when((F.col("event_id") % 6 == 1) & asks, F.lit("query_policy"))))
    u = O.tool_usage(read(s, d, "events").select("user_id", F.col("event_type").alias("scenario"), called.alias("called")), "user_id", "scenario", "called")
    told = F.transform(F.array_sort(F.map_entries("breakdown")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return u.withColumn("breakdown", F.array_join(told, ","))


_T5 = [f"{a}_{b}".lower() for a, b in P.TRANSITIONS]
_LB = _NEXT + f", lb AS (SELECT cluster_id, day, {_RATE} FROM nx WHERE n IS NOT NULL GROUP BY cluster_id, day), ul AS (UNPIVOT lb ON {', '.join(_T5)} INTO NAME transition VALUE x)"


def labels(s, d):
    return P.transition_rates(panel(s, d), ["cluster_id", "day"])


@query(_LB + " SELECT transition, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, min(x) AS low, max(x) AS high, round(quantile_cont(x, 0.5), 6) AS median, round(avg((x <> 0)::INTEGER), 6) AS non_zero FROM ul GROUP BY transition")
def d23_label_stats(s, d):
    return V.label_stats(labels(s, d), _T5)


@query(_LB + ", f AS (SELECT transition, avg(x) AS m FROM ul GROUP BY transition), g AS (SELECT 'inverse_freq' AS method, transition, 1 / (m + 1e-8) AS i FROM f UNION ALL SELECT 'balanced', transition, (SELECT max(m) FROM f) / (m + 1e-8) FROM f) SELECT method, transition, round(i * 5 / sum(i) OVER (PARTITION BY method), 6) AS weight FROM g")
def d24_class_weights(s, d):
    of = lambda m: V.class_weights(labels(s, d), _T5, m).select(F.lit(m).alias("method"), "transition", "weight")
    return of("inverse_freq").unionByName(of("balanced"))


@query(_LB + " SELECT transition AS field, count(*) FILTER (x IS NULL) AS nulls, count(*) FILTER (isnan(x)) AS nans, count(*) FILTER (isinf(x)) AS infs, count(*) FILTER (x NOT BETWEEN 0 AND 0.5) AS out_of_range FROM ul GROUP BY transition")
def d25_audit_numeric(s, d):
    return V.audit_numeric(labels(s, d), _T5, 0.0, 0.5)


@query(", r AS (SELECT agent_id, 'age' AS field, age::DOUBLE AS x FROM agents UNION ALL SELECT agent_id, 'comorbidity_count', comorbidity_count FROM agents), f AS (SELECT field, avg(x) AS m, CASE WHEN stddev_samp(x) < 1e-6 THEN 1.0 ELSE stddev_samp(x) END AS s FROM r GROUP BY field) SELECT agent_id, field, round((x - m) / s, 6) AS z FROM r JOIN f USING (field)")
def d26_scaler(s, d):
    cols = ["age", "comorbidity_count"]
    return V.apply_scaler(agents(s, d), "agent_id", cols, V.fit_scaler(agents(s, d), cols))


@query("SELECT agent_id, (CAST('0x' || substr(md5('split:' || CAST(agent_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE) < 0.8 AS train FROM agents")
def d27_split(s, d):
    return V.seeded_split(agents(s, d).select("agent_id"), "agent_id")


@query(", h AS (SELECT avg(n) AS hs FROM (SELECT count(*) AS n FROM agents GROUP BY household_id)), w AS (SELECT 2 * count(*) / (SELECT count(*) FROM agents) AS k FROM edges WHERE edge_type <> 'household') SELECT round((hs - 1) * (1 - exp(-0.18::DOUBLE)) + 0.035::DOUBLE * k * 10, 6) AS r0 FROM h, w")
def d29_r0(s, d):
    a = agents(s, d)
    h = a.groupBy("household_id").count().agg(F.avg("count").alias("hs"))
    k = edges(s, d).where("edge_type <> 'household'").agg((2 * F.count(F.lit(1))).alias("e")).crossJoin(a.agg(F.count(F.lit(1)).alias("n")))
    return h.crossJoin(k).select(F.round(V.r0_from_network(F.col("hs"), F.col("e") / F.col("n")), 6).alias("r0"))


@query("SELECT day, round(2.5::DOUBLE * S / (S + E + I + R + D), 6) AS r_eff FROM hist")
def d29_r_eff(s, d):
    return V.r_eff(P.state_counts(panel(s, d), ["day"]))


@query("SELECT count(*) AS sources, round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS std, max(n) AS most FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)")
def d30_secondary_infections(s, d):
    return V.secondary_infections(read(s, d, "orders"), "o_custkey")


@query("SELECT count(DISTINCT text) AS distinct_texts, count(text) AS total, round(count(DISTINCT text) / count(text), 6) AS diversity, count(DISTINCT text) / count(text) < 0.5 AS warning FROM documents")
def d31_text_diversity(s, d):
    return O.text_diversity(read(s, d, "documents"), "text")


@query("SELECT count(DISTINCT conv_id % 7) AS scenarios, (SELECT count(*) FROM (SELECT DISTINCT conv_id % 7, turn FROM conversations)) AS entities, count(DISTINCT turn) AS distinct_entities, count(*) AS conversations FROM conversations")
def d35_trace_totals(s, d):
    return O.trace_totals(read(s, d, "conversations").withColumn("scenario", F.col("conv_id") % 7), "scenario", "turn")


@query(_EM + ", nm AS (SELECT vec_id, sqrt(list_dot_product(v, v)) AS n FROM em), u AS (SELECT pos, sum(x / n) AS s FROM lv JOIN nm USING (vec_id) GROUP BY pos) SELECT (SELECT count(*) FROM em) AS n, (SELECT round(avg(n), 6) FROM nm) AS mean_norm, (SELECT round(stddev_pop(n), 6) FROM nm) AS std_norm, round((sum(s * s) - (SELECT count(*) FROM em)) / ((SELECT count(*) FROM em) * ((SELECT count(*) FROM em) - 1)), 6) AS mean_cosine FROM u")
def d36_embedding_stats(s, d):
    return K.embedding_stats(emb(s, d), "embedding", "vec_id")


@query("SELECT occupation AS category, count(*) AS n FROM agents GROUP BY occupation ORDER BY n DESC, category LIMIT 3")
def f2_top_categories(s, d):
    return V.top_categories(agents(s, d), "occupation", 3)


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 50")
def f1_first_n(s, d):
    return read(s, d, "orders").orderBy("o_orderdate", "o_orderkey").limit(50).select("o_orderkey", "o_orderdate")


@query(_EM + ", r AS (SELECT label, pos, round(c, 6) AS c, row_number() OVER (PARTITION BY label ORDER BY abs(round(c, 6)) DESC, pos) AS rank FROM ct) SELECT * FROM r WHERE rank <= 5")
def f3_top_features_per_group(s, d):
    return K.top_features_per_group(emb(s, d), *_E, 5)


@query(_EM + " SELECT pos, round(avg(x), 6) AS mean, round(var_pop(x), 6) AS variance FROM lv GROUP BY pos")
def i3_feature_variance(s, d):
    return K.feature_variance(emb(s, d), "vec_id", "embedding")


@query(_EM + " SELECT label, pos, round(c, 6) AS c FROM ct")
def i9_cluster_profiles(s, d):
    return K.centroids(emb(s, d), *_E).select("label", "pos", F.round("c", 6).alias("c"))


@query()
def i10_coarse_cluster(s, d):
    return K.with_balance(K.coarse_cluster(emb(s, d), "embedding", "vec_id", 10))


@query()
def i16_fine_cluster(s, d):
    return K.fine_cluster(emb(s, d), "embedding", "vec_id", 8)


@query(_EM + ", j AS (SELECT label, vec_id, round(list_cosine_similarity(v, c), 9) AS s FROM em JOIN ca USING (label)) SELECT label, vec_id AS anchor FROM j QUALIFY row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) = 1")
def i11_select_anchors(s, d):
    return K.select_anchors(emb(s, d), *_E)


_LAB = ", e2 AS (SELECT e.*, a.region AS c1, b.region AS c2 FROM edges e JOIN agents a ON a.agent_id = agent_1 JOIN agents b ON b.agent_id = agent_2)"


def regions(s, d):
    return agents(s, d).select("agent_id", F.col("region").alias("cluster_id"))


@query(_LAB + ", en AS (SELECT c1 AS c, contact_rate AS w FROM e2 UNION ALL SELECT c2, contact_rate FROM e2), dg AS (SELECT c, sum(w) AS d FROM en GROUP BY c), iw AS (SELECT c1 AS c, sum(contact_rate) AS w FROM e2 WHERE c1 = c2 GROUP BY c1), m AS (SELECT sum(d) / 2 AS m FROM dg) SELECT round(sum(coalesce(w, 0) / m - pow(d / (2 * m), 2)), 6) AS modularity FROM dg LEFT JOIN iw USING (c), m")
def i21_modularity(s, d):
    return K.modularity(edges(s, d), regions(s, d))


@query(_LAB + ", en AS (SELECT c1 AS c, c2 AS o FROM e2 UNION ALL SELECT c2, c1 FROM e2), b AS (SELECT c, count(*) AS v, count(*) FILTER (c <> o) AS cut FROM en GROUP BY c) SELECT c AS cluster_id, round(cut / v, 6) AS conductance FROM b")
def i22_conductance(s, d):
    return K.conductance(edges(s, d), regions(s, d))


@query(_EM + """, q AS (SELECT label AS l, count(*) AS n, sum(list_dot_product(v, v)) AS q FROM em GROUP BY label), j AS (SELECT em.vec_id, em.label, q.l, q.n, list_dot_product(v, v) + q.q / q.n - 2 * list_dot_product(v, ca.c) AS m FROM em, q JOIN ca ON ca.label = q.l),
g AS (SELECT vec_id, label, max(CASE WHEN label = l AND n > 1 THEN m * n / (n - 1) END) AS a, min(CASE WHEN label <> l THEN m END) AS b FROM j GROUP BY ALL) SELECT vec_id, label, round(coalesce((b - a) / greatest(a, b), 0), 6) AS silhouette_sq FROM g""")
def i23_silhouette(s, d):
    return K.silhouette(emb(s, d), *_E)


@query(_EM + ", b AS (SELECT label, pos, count(*) AS n, sum(x) AS s, sum(x * x) AS q FROM lv GROUP BY ALL), m AS (SELECT pos, sum(s) / sum(n) AS m FROM b GROUP BY pos) SELECT round((sum(n * pow(s / n - m, 2)) / (count(DISTINCT label) - 1)) / (sum(q - s * s / n) / (sum(n) FILTER (pos = 0) - count(DISTINCT label))), 6) AS calinski_harabasz FROM b JOIN m USING (pos)")
def i24_ch_index(s, d):
    return K.ch_index(emb(s, d), *_E)


@query(_EM + ", sc AS (SELECT label, avg(list_distance(v, c)) AS s FROM em JOIN ca USING (label) GROUP BY label), rr AS (SELECT x.label, max((x.s + y.s) / list_distance(cx.c, cy.c)) AS r FROM sc x JOIN sc y ON x.label <> y.label JOIN ca cx ON cx.label = x.label JOIN ca cy ON cy.label = y.label GROUP BY x.label) SELECT round(avg(r), 6) AS davies_bouldin FROM rr")
def i24_db_index(s, d):
    return K.db_index(emb(s, d), *_E)


@query(_EM + " SELECT x.label AS a, y.label AS b, round(list_distance(x.c, y.c), 6) AS distance FROM ca x JOIN ca y ON x.label < y.label")
def i25_centroid_distances(s, d):
    return K.centroid_distances(emb(s, d), *_E)


@query(_EM + " SELECT label, count(*) AS size, round(avg(list_distance(v, c)), 6) AS mean_distance FROM em JOIN ca USING (label) GROUP BY label")
def i25_intra_distance(s, d):
    return K.intra_distance(emb(s, d), *_E)


@query(", n AS (SELECT region, count(*) AS n FROM agents GROUP BY region) SELECT count(*) AS clusters, min(n) AS smallest, max(n) AS largest, round(min(n) / max(n), 6) AS balance, round(-sum(n / t * ln(n / t)), 6) AS entropy FROM (SELECT *, sum(n) OVER () AS t FROM n)")
def i26_cluster_balance(s, d):
    return K.cluster_balance(regions(s, d))


@query(", c AS (SELECT region AS a, occupation AS b, count(*) AS n FROM agents GROUP BY ALL), s AS (SELECT sum(n * (n - 1) / 2) AS i, sum(n) AS n FROM c), r AS (SELECT sum(n * (n - 1) / 2) AS r FROM (SELECT sum(n) AS n FROM c GROUP BY a)), k AS (SELECT sum(n * (n - 1) / 2) AS k FROM (SELECT sum(n) AS n FROM c GROUP BY b)) SELECT round((i - r * k / (n * (n - 1) / 2)) / ((r + k) / 2 - r * k / (n * (n - 1) / 2)), 6) AS ari FROM s, r, k")
def i29_ari(s, d):
    return K.ari(agents(s, d), "region", "occupation")


@query(_LAB + ", m AS (SELECT least(c1, c2) AS a, greatest(c1, c2) AS b, count(*) AS edges FROM e2 GROUP BY 1, 2) SELECT *, round(edges * CASE WHEN a = b THEN 2 ELSE 1 END / (SELECT max(edges * CASE WHEN a = b THEN 2 ELSE 1 END) FROM m), 6) AS density FROM m")
def i31_cluster_edge_matrix(s, d):
    return K.cluster_edge_matrix(edges(s, d), regions(s, d))


@query(_LAB + ", n AS (SELECT region AS c, count(*) AS n FROM agents GROUP BY region) SELECT c AS cluster_id, round(coalesce((SELECT count(*) FROM e2 WHERE c1 = c AND c2 = c) / nullif(n * (n - 1) / 2, 0), 0), 9) AS intra, round(coalesce((SELECT count(*) FROM e2 WHERE c1 <> c2 AND (c1 = c OR c2 = c)) / nullif(n * ((SELECT count(*) FROM agents) - n), 0), 0), 9) AS inter FROM n")
def i31_edge_density(s, d):
    return K.edge_density(edges(s, d), regions(s, d))


@query(_EM + ", j AS (SELECT label, vec_id, round(list_distance(v, c), 9) AS s FROM em JOIN ca USING (label)) SELECT label, vec_id AS representative FROM j QUALIFY row_number() OVER (PARTITION BY label ORDER BY s, vec_id) = 1")
def i33_representatives(s, d):
    return K.representatives(emb(s, d), *_E)


_FC = ", fc AS (SELECT doc_id, quality, toxic, (1 + doc_id % 9) / 10.0::DOUBLE AS p FROM labels)"


def forecasts(s, d):
    return read(s, d, "labels").select("doc_id", "quality", "toxic", ((1 + F.col("doc_id") % 9) / 10.0).alias("p"))


@query(_FC + " SELECT toxic, count(*) AS n, round(avg(abs(p - quality)), 6) AS mae, round(sqrt(avg(pow(p - quality, 2))), 6) AS rmse, round(CASE WHEN var_pop(quality) * count(*) > 1e-12 THEN 1 - sum(pow(p - quality, 2)) / (var_pop(quality) * count(*)) ELSE -999.0 END, 6) AS r2 FROM fc GROUP BY toxic")
def j1_regression_metrics(s, d):
    return V.regression_metrics(forecasts(s, d), ["toxic"], "p", "quality")


@query(_FC + " SELECT round(avg((1 + toxic) * pow(p - quality, 2)), 6) AS weighted_mse, round(avg((1 + 2.0::DOUBLE * quality) * (1 + toxic) * pow(p - quality, 2)), 6) AS focal_mse FROM fc")
def j3_weighted_losses(s, d):
    return V.weighted_losses(forecasts(s, d), 1 + F.col("toxic"), 2.0, "p", "quality")


@query(_FC + " SELECT round(avg(pow(p - quality, 2)), 6) AS brier, round(avg(-ln(greatest(CASE WHEN quality = 1 THEN p ELSE 1 - p END, 1e-7))), 6) AS nll FROM fc")
def j4_brier_nll(s, d):
    return V.brier_nll(forecasts(s, d), "p", "quality")


@query(", x AS (SELECT state AS t, lead(state) OVER (PARTITION BY agent_id ORDER BY day) AS p FROM panel), y AS (SELECT * FROM x WHERE p IS NOT NULL), t AS (SELECT t AS c, count(*) AS t, count(*) FILTER (t = p) AS tp FROM y GROUP BY 1), p AS (SELECT p AS c, count(*) AS p FROM y GROUP BY 1) SELECT round(avg(2 * coalesce(tp, 0) / (coalesce(t, 0) + coalesce(p, 0))), 6) AS macro_f1 FROM t FULL JOIN p USING (c)")
def j6_event_macro_f1(s, d):
    p = panel(s, d).withColumn("p", F.lead("state").over(P.by_agent())).where("p is not null")
    return V.event_macro_f1(p, "p", "state")


@query(", t AS (SELECT agent_id, state AS event, min(day) AS td FROM panel WHERE days_in_state = 0 AND day > 0 GROUP BY ALL), q AS (SELECT agent_id, state AS event, min(day) AS pd FROM panel WHERE days_in_state = 1 GROUP BY ALL) SELECT count(*) AS n, round(avg(coalesce(least(abs(pd - td), 7), 7)), 6) AS error FROM t FULL JOIN q USING (agent_id, event)")
def j7_event_time_error(s, d):
    p = panel(s, d).withColumn("event", F.col("state"))
    return V.event_time_error(p.where("days_in_state = 1"), p.where("days_in_state = 0 and day > 0"), 7)


@query(_FC + " SELECT CAST(least(floor(p * 10), 9) AS BIGINT) AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(quality), 6) AS observed FROM fc GROUP BY 1")
def j8_calibration_table(s, d):
    return V.calibration_table(forecasts(s, d), "p", "quality")
