"""Contact-network queries (C, D4 to D10, G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from popgraph.operators import network as N
from popgraph.queries.base import RANKED, U, agents, edges, members, neighbors, peers, query, read, states, typed_links


@query("SELECT agent_1, agent_2, edge_type, contact_rate FROM hh")
def c1_household_edges(s, d):
    return N.household_edges(agents(s, d))


def cases(s, d):
    o = read(s, d, "orders")
    link = F.concat(F.lit("linked to case "), (F.col("o_orderkey") - F.col("o_custkey") % 50).cast("string"), F.when(F.col("o_orderkey") % 3 == 0, ", family").when(F.col("o_orderkey") % 3 == 1, " at work with 12").otherwise(", seen near S12 and 9b, colleague"))
    return o.select(F.col("o_orderkey").alias("case"), F.col("o_orderdate").cast("date").alias("date"), link.alias("link"))


@query(""", cs AS (SELECT o_orderkey AS "case", 'linked to case ' || (o_orderkey - o_custkey % 50) || CASE o_orderkey % 3 WHEN 0 THEN ', family' WHEN 1 THEN ' at work with 12' ELSE ', seen near S12 and 9b, colleague' END AS link FROM orders) """ + typed_links("cs"))
def c2_link_edges(s, d):
    return N.link_edges(cases(s, d))


@query(f""", g AS (SELECT agent_id, key, {RANKED.format('key')} FROM (SELECT agent_id, CASE WHEN agent_id % 3 = 0 THEN -1 - region ELSE agent_id // 12 END AS key FROM agents)), many AS (SELECT * FROM g WHERE n > 20), few AS (SELECT * FROM g WHERE n <= 20),
c3 AS (SELECT x.agent_id AS agent_1, y.agent_id AS agent_2, 'cluster' AS edge_type, 0.60::DOUBLE AS contact_rate FROM few x JOIN few y ON x.key = y.key AND x.agent_id < y.agent_id WHERE {U.format('cluster', "(x.agent_id || '-' || y.agent_id)")} < 0.4 UNION ALL {peers('many', 0.50, 'cluster')})
SELECT * FROM c3 WHERE NOT EXISTS (SELECT 1 FROM hh WHERE hh.agent_1 = c3.agent_1 AND hh.agent_2 = c3.agent_2)""")
def c3_group_edges(s, d):
    a = agents(s, d).withColumn("group", F.when(F.col("agent_id") % 3 == 0, -1 - F.col("region")).otherwise(F.floor(F.col("agent_id") / 12)))
    return N.without(N.group_edges(a, ["group"]), N.household_edges(a))


@query("SELECT * FROM sk")
def c4_school_edges(s, d):
    return N.network_edges(members(s, d).dropna(subset=["school_network"]), ["school_network"], "school", 0.65)


def work(s, d):
    return N.network_edges(members(s, d).dropna(subset=["work_network"]), ["work_network"], "work", 0.70)


@query("SELECT * FROM wk")
def c4_work_edges(s, d):
    return work(s, d)


@query("SELECT * FROM net_lone")
def c5_repair_isolated(s, d):
    return N.repair_isolated(agents(s, d), edges(s, d, repair=False))


@query("SELECT agent_1, agent_2, edge_type, contact_rate FROM edges")
def c6_contact_network(s, d):
    return edges(s, d)


@query("SELECT agent_id, other_id, edge_type, contact_rate FROM nb")
def c7_neighbors(s, d):
    return neighbors(s, d)


@query(""", sd AS (SELECT agent_id FROM agents WHERE is_imported), ids AS (SELECT agent_id FROM sd UNION SELECT other_id FROM nb WHERE agent_id IN (SELECT agent_id FROM sd))
SELECT * FROM edges WHERE agent_1 IN (SELECT agent_id FROM ids) AND agent_2 IN (SELECT agent_id FROM ids)""")
def c10_ego_subgraph(s, d):
    return N.ego_subgraph(agents(s, d), edges(s, d), F.col("is_imported"))


@query("SELECT * FROM edges WHERE agent_1 IN (SELECT agent_id FROM agents WHERE cluster = 'dormitory') AND agent_2 IN (SELECT agent_id FROM agents WHERE cluster = 'dormitory')")
def c11_induced_subgraph(s, d):
    return N.induced_subgraph(edges(s, d), agents(s, d).where("cluster = 'dormitory'"))


@query(""", gone AS (SELECT agent_id FROM panel WHERE day = 20 AND state = 'D' AND days_in_state > 1)
SELECT * FROM edges WHERE agent_1 NOT IN (SELECT agent_id FROM gone) AND agent_2 NOT IN (SELECT agent_id FROM gone)""")
def c16_prune_expired(s, d):
    from popgraph.operators.panel import days_in_state

    return N.prune_expired(edges(s, d), days_in_state(states(s, d)), 20, 1)


@query("SELECT n.agent_id, round(avg(a.age), 6) AS age, round(avg(a.vaccination_status), 6) AS vaccination FROM nb n JOIN agents a ON a.agent_id = n.other_id GROUP BY n.agent_id")
def c20_propagate_features(s, d):
    f = agents(s, d).select("agent_id", F.array(F.col("age").cast("double"), F.col("vaccination_status").cast("double")).alias("f"))
    return N.propagate_features(f, neighbors(s, d)).select("agent_id", F.round(F.col("f")[0], 6).alias("age"), F.round(F.col("f")[1], 6).alias("vaccination"))


_DEG = ", dg AS (SELECT a.agent_id, count(n.other_id) AS degree FROM agents a LEFT JOIN nb n ON a.agent_id = n.agent_id GROUP BY a.agent_id)"


@query(_DEG + """ SELECT min(degree) AS lowest, quantile_cont(degree, 0.25)::DOUBLE AS q1, quantile_cont(degree, 0.5)::DOUBLE AS median, quantile_cont(degree, 0.75)::DOUBLE AS q3,
round(avg(degree), 6) AS mean, max(degree) AS highest, round(stddev_pop(degree), 6) AS std FROM dg""")
def d4_degree_stats(s, d):
    return N.degree_stats(agents(s, d), edges(s, d))


@query("""SELECT edge_type, count(*) AS edges, round(100.0 * count(*) / (SELECT count(*) FROM edges), 6) AS percent, round(avg(contact_rate), 6) AS mean_rate, min(contact_rate) AS low, quantile_cont(contact_rate, 0.5) AS median, max(contact_rate) AS high, CASE WHEN edge_type = 'household' THEN min(contact_rate) >= 0.7 END AS rates_hold,
edge_type IN ('household', 'contact', 'cluster', 'work', 'school', 'community') AS expected FROM edges GROUP BY edge_type""")
def d5_edge_report(s, d):
    return N.edge_report(edges(s, d))


@query("""SELECT 'self_loop' AS "check", count(*) FILTER (agent_1 = agent_2) AS failures FROM edges UNION ALL SELECT 'not_canonical', count(*) FILTER (agent_1 >= agent_2) FROM edges
UNION ALL SELECT 'rate_out_of_range', count(*) FILTER (contact_rate NOT BETWEEN 0 AND 1) FROM edges UNION ALL SELECT 'unknown_type', count(*) FILTER (edge_type NOT IN ('household', 'contact', 'cluster', 'work', 'school', 'community')) FROM edges
UNION ALL SELECT 'null_end', count(*) FILTER (agent_1 IS NULL OR agent_2 IS NULL) FROM edges UNION ALL SELECT 'duplicate', count(*) FROM (SELECT 1 FROM edges GROUP BY agent_1, agent_2 HAVING count(*) > 1)
UNION ALL SELECT 'dangling', count(DISTINCT agent_id) FROM nb WHERE agent_id NOT IN (SELECT agent_id FROM agents) UNION ALL SELECT 'isolated', count(*) FROM agents WHERE agent_id NOT IN (SELECT agent_id FROM nb)""")
def d7_validate_network(s, d):
    return N.validate_network(agents(s, d), edges(s, d))


@query(_DEG + """, tri AS (SELECT x.agent_id, count(*) / 2 AS t FROM nb x JOIN nb y ON x.agent_id = y.agent_id AND x.other_id <> y.other_id JOIN nb z ON z.agent_id = x.other_id AND z.other_id = y.other_id GROUP BY x.agent_id),
j AS (SELECT dg.*, coalesce(t, 0) AS t, degree * (degree - 1) / 2 AS p FROM dg LEFT JOIN tri USING (agent_id))
SELECT count(*) AS nodes, CAST(sum(degree) / 2 AS BIGINT) AS edges, round(sum(degree) / (count(*) * (count(*) - 1)), 9) AS density, round(avg(degree), 6) AS avg_degree,
round(sum(t) / sum(p), 6) AS transitivity, round(avg(CASE WHEN degree > 1 THEN t / p ELSE 0.0 END), 6) AS avg_clustering FROM j""")
def d9_graph_stats(s, d):
    return N.graph_stats(agents(s, d), edges(s, d))


@query(""", cc(agent_id, component) USING KEY (agent_id) AS (SELECT agent_id, agent_id FROM agents UNION SELECT n.agent_id, min(c.component) AS component FROM cc c JOIN nb n ON n.other_id = c.agent_id
JOIN recurring.cc o ON o.agent_id = n.agent_id GROUP BY n.agent_id, o.component HAVING min(c.component) < o.component) SELECT agent_id, component FROM cc""")
def d10_connected_components(s, d):
    a = agents(s, d)
    return N.connected_components(a, edges(s, d))


@query("SELECT agent_1, agent_2, edge_type, contact_rate FROM hh UNION ALL SELECT agent_1, agent_2, edge_type, contact_rate FROM wk")
def g1_union_layers(s, d):
    a = agents(s, d)
    return N.household_edges(a).unionByName(work(s, d))


@query("SELECT DISTINCT least(agent_id, other_id) AS agent_1, greatest(agent_id, other_id) AS agent_2 FROM nb")
def g2_canonical_pairs(s, d):
    return N.canonical_pairs(neighbors(s, d), "agent_id", "other_id")


@query("SELECT agent_id FROM agents WHERE agent_id NOT IN (SELECT agent_1 FROM wk UNION SELECT agent_2 FROM wk)")
def g3_set_difference(s, d):
    a = agents(s, d)
    ends = N.neighbors(work(s, d)).select("agent_id")
    return a.select("agent_id").join(ends, "agent_id", "left_anti")


@query("SELECT * FROM edges WHERE agent_1 IN (SELECT agent_id FROM agents WHERE age < 40) AND agent_2 IN (SELECT agent_id FROM agents WHERE age < 40)")
def g4_restrict_edges(s, d):
    return N.induced_subgraph(edges(s, d), agents(s, d).where("age < 40"))
