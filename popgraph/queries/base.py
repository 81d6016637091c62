"""How the driver's tables stand in for entities, contacts and panels.

``customer`` rows are entities, five in a row form a household, those of one nation and
market segment a workplace, children of one nation and age a school; ``events`` of a user
and day give the state of that day. The same bindings are written once with DataFrames
and once as SQL (``WITH``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from popgraph.operators import network, panel

#: SQL of ``functions.draws.uniform``: salt and key.
U = "(CAST('0x' || substr(md5('{}:' || CAST({} AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL after the common bindings."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = WITH + (sql if sql.lstrip().startswith(",") else "\n" + sql)
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def agents(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer")
    k = F.col("c_custkey")
    return c.select(
        k.alias("agent_id"), F.pmod(k * 37, F.lit(90)).cast("int").alias("age"), F.floor(k / 5).alias("household_id"),
        F.col("c_nationkey").cast("int").alias("region"), F.lower("c_mktsegment").alias("occupation"),
        F.pmod(k, F.lit(3)).cast("int").alias("vaccination_status"), F.pmod(k, F.lit(4)).cast("int").alias("comorbidity_count"),
        ((F.col("c_acctbal") + 1000) / 11000).alias("compliance_score"), (F.pmod(k, F.lit(17)) == 0).alias("is_imported"),
        F.when(F.pmod(k, F.lit(11)) == 0, "dormitory").otherwise("none").alias("cluster"),
        F.when(F.pmod(k, F.lit(2)) == 0, "F").otherwise("M").alias("gender"), F.pmod(k, F.lit(10)).cast("int").alias("cluster_id"),
    )


def members(spark: SparkSession, d: str) -> DataFrame:
    """Where entities meet: every thirteenth lives alone; some are in a named group; the others of an age work or learn."""
    a = agents(spark, d)
    k = F.col("agent_id")
    group = F.when(k % 7 == 0, F.concat(F.lit("large "), F.col("region") % 5)).when(k % 7 == 1, F.concat(F.lit("small "), F.floor(k / 70)))
    return a.select(
        "agent_id", F.when(k % 13 == 0, -k).otherwise(F.col("household_id")).alias("home"), group.alias("group_name"),
        F.when(F.col("age").between(18, 64), F.concat_ws("-", "region", "occupation")).alias("work_network"),
        F.when(F.col("age").between(6, 17), F.col("region") * 10 + F.floor(F.col("age") / 6)).alias("school_network"),
    )


GROUPS = {"cluster": "group_name", "work": "work_network", "school": "school_network"}


def links(spark: SparkSession, d: str) -> DataFrame:
    """Edges that the texts of every fifth entity name."""
    k = F.col("agent_id")
    how = F.when(k % 3 == 0, ", family").when(k % 3 == 1, " at work with 12").otherwise(", seen near S12 and 9b, colleague")
    said = F.when(k % 5 == 2, F.concat(F.lit("linked to case "), (k - k % 50).cast("string"), how))
    return network.link_edges(agents(spark, d).select(k.alias("case"), said.alias("link")))


def edges(spark: SparkSession, d: str, repair: bool = True) -> DataFrame:
    return network.build_contact_network(members(spark, d), links(spark, d), "home", GROUPS, repair)


def neighbors(spark: SparkSession, d: str) -> DataFrame:
    return network.neighbors(edges(spark, d))


def states(spark: SparkSession, d: str) -> DataFrame:
    return panel.daily_states(read(spark, d, "events"))


def peers(g: str, rate: float, kind: str) -> str:
    """SQL: drawn peers of the groups of table ``g`` (agent_id, key, r, n)."""
    u = lambda salt: U.format(f"{kind}-{salt}", "x.agent_id")
    return f"""SELECT DISTINCT least(x.agent_id, y.agent_id) AS agent_1, greatest(x.agent_id, y.agent_id) AS agent_2, '{kind}' AS edge_type, {rate}::DOUBLE AS contact_rate
FROM {g} x JOIN (VALUES (0), (1), (2), (3)) o(k) ON x.n > 1 AND o.k < least(floor({u('n')} * 3) + 2, x.n - 1)
JOIN {g} y ON y.key = x.key AND y.r = CAST(x.r + (floor({u('first')} * (x.n - 1)) + o.k * greatest((x.n - 1) // 4, 1)) % (x.n - 1) + 1 AS BIGINT) % x.n"""


RANKED = "row_number() OVER (PARTITION BY {0} ORDER BY agent_id) - 1 AS r, count(*) OVER (PARTITION BY {0}) AS n"


def typed_links(cases: str) -> str:
    """SQL: edges named in the texts of table ``cases`` ("case", link)."""
    words = "regexp_extract_all(link, '\\b\\d+\\b')"
    return f"""SELECT agent_1, agent_2, edge_type, CASE edge_type WHEN 'household' THEN 0.95 WHEN 'work' THEN 0.70 ELSE 0.60 END::DOUBLE AS contact_rate FROM (
SELECT least("case", o) AS agent_1, greatest("case", o) AS agent_2, CASE WHEN link LIKE '%family%' THEN 'household' WHEN link LIKE '%work%' THEN 'work' ELSE 'contact' END AS edge_type, "case", pos
FROM (SELECT "case", link, pos, TRY_CAST(n AS BIGINT) AS o FROM (SELECT "case", link, unnest({words}) AS n, unnest(range(len({words}))) AS pos FROM {cases})) WHERE o IN (SELECT "case" FROM {cases}) AND o <> "case")
QUALIFY row_number() OVER (PARTITION BY agent_1, agent_2 ORDER BY "case", pos) = 1"""


_NET = f"""mem AS (SELECT agent_id, CASE WHEN agent_id % 13 = 0 THEN -agent_id ELSE household_id END AS home, CASE agent_id % 7 WHEN 0 THEN 'large ' || (region % 5) WHEN 1 THEN 'small ' || (agent_id // 70) END AS group_name,
  CASE WHEN age BETWEEN 18 AND 64 THEN region || '-' || occupation END AS work_network, CASE WHEN age BETWEEN 6 AND 17 THEN region * 10 + age // 6 END AS school_network FROM agents),
net_said AS (SELECT agent_id AS "case", CASE WHEN agent_id % 5 = 2 THEN 'linked to case ' || (agent_id - agent_id % 50) || CASE agent_id % 3 WHEN 0 THEN ', family' WHEN 1 THEN ' at work with 12' ELSE ', seen near S12 and 9b, colleague' END END AS link FROM agents),
net_g AS (SELECT agent_id, group_name AS key, {RANKED.format('group_name')} FROM mem WHERE group_name IS NOT NULL), net_few AS (SELECT * FROM net_g WHERE n <= {network.SMALL_GROUP}), net_many AS (SELECT * FROM net_g WHERE n > {network.SMALL_GROUP}),
net_w AS (SELECT agent_id, work_network AS key, {RANKED.format('work_network')} FROM mem WHERE work_network IS NOT NULL), net_s AS (SELECT agent_id, school_network AS key, {RANKED.format('school_network')} FROM mem WHERE school_network IS NOT NULL),
wk AS ({peers('net_w', 0.70, 'work')}), sk AS ({peers('net_s', 0.65, 'school')}),
net_every AS (SELECT a.agent_id AS agent_1, b.agent_id AS agent_2, 'household' AS edge_type, 0.95::DOUBLE AS contact_rate, 0 AS layer FROM mem a JOIN mem b ON a.home = b.home AND a.agent_id < b.agent_id
  UNION ALL SELECT *, 1 FROM ({typed_links('net_said')})
  UNION ALL SELECT x.agent_id, y.agent_id, 'cluster', 0.60::DOUBLE, 2 FROM net_few x JOIN net_few y ON x.key = y.key AND x.agent_id < y.agent_id WHERE {U.format('cluster', "(x.agent_id || '-' || y.agent_id)")} < 0.4
  UNION ALL SELECT *, 2 FROM ({peers('net_many', 0.50, 'cluster')}) UNION ALL SELECT *, 3 FROM wk UNION ALL SELECT *, 4 FROM sk),
net_one AS (SELECT agent_1, agent_2, edge_type, contact_rate FROM net_every QUALIFY row_number() OVER (PARTITION BY agent_1, agent_2 ORDER BY layer, edge_type, contact_rate) = 1),
net_deg AS (SELECT a.agent_id, count(x.agent_id) AS degree FROM agents a LEFT JOIN (SELECT agent_1 AS agent_id FROM net_one UNION ALL SELECT agent_2 FROM net_one) x ON a.agent_id = x.agent_id GROUP BY a.agent_id),
net_pool AS (SELECT *, row_number() OVER (ORDER BY degree, agent_id) - 1 AS c, count(*) OVER () AS m FROM net_deg),
net_lone AS (SELECT DISTINCT least(x.agent_id, y.agent_id) AS agent_1, greatest(x.agent_id, y.agent_id) AS agent_2, 'community' AS edge_type, 0.40::DOUBLE AS contact_rate
  FROM net_pool x JOIN (VALUES (1), (2)) o(k) ON x.degree = 0 JOIN net_pool y ON y.c = (2 * x.c + o.k) % x.m AND y.agent_id <> x.agent_id),
edges AS (SELECT * FROM net_one UNION ALL SELECT * FROM net_lone),
"""

WITH = """WITH RECURSIVE agents AS (SELECT c_custkey AS agent_id, CAST(c_custkey * 37 % 90 AS INTEGER) AS age, c_custkey // 5 AS household_id, CAST(c_nationkey AS INTEGER) AS region,
  lower(c_mktsegment) AS occupation, CAST(c_custkey % 3 AS INTEGER) AS vaccination_status, CAST(c_custkey % 4 AS INTEGER) AS comorbidity_count,
  (c_acctbal + 1000) / 11000 AS compliance_score, c_custkey % 17 = 0 AS is_imported, CASE WHEN c_custkey % 11 = 0 THEN 'dormitory' ELSE 'none' END AS cluster,
  CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender, CAST(c_custkey % 10 AS INTEGER) AS cluster_id FROM customer),
hh AS (SELECT a.agent_id AS agent_1, b.agent_id AS agent_2, 'household' AS edge_type, 0.95::DOUBLE AS contact_rate FROM agents a JOIN agents b ON a.household_id = b.household_id AND a.agent_id < b.agent_id),
""" + _NET + """nb AS (SELECT agent_1 AS agent_id, agent_2 AS other_id, edge_type, contact_rate FROM edges UNION ALL SELECT agent_2, agent_1, edge_type, contact_rate FROM edges),
seen AS (SELECT user_id AS agent_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) = 1),
span AS (SELECT min(day) AS d0, max(day) AS d1 FROM seen),
grid AS (SELECT agent_id, unnest(range(d0, d1 + 1)) AS day FROM (SELECT DISTINCT agent_id FROM seen), span),
filled AS (SELECT g.agent_id, g.day, coalesce(last_value(CASE event_type WHEN 'view' THEN 'S' WHEN 'click' THEN 'E' WHEN 'error' THEN 'I' WHEN 'purchase' THEN 'R' WHEN 'signup' THEN 'D' END IGNORE NULLS)
  OVER (PARTITION BY g.agent_id ORDER BY g.day ROWS UNBOUNDED PRECEDING), 'S') AS state FROM grid g LEFT JOIN seen s ON g.agent_id = s.agent_id AND g.day = s.day),
chg AS (SELECT *, CASE WHEN state IS NOT DISTINCT FROM lag(state) OVER (PARTITION BY agent_id ORDER BY day) THEN 0 ELSE 1 END AS c FROM filled),
isl AS (SELECT *, sum(c) OVER (PARTITION BY agent_id ORDER BY day) AS g FROM chg),
panel AS (SELECT agent_id, day, state, CAST(row_number() OVER (PARTITION BY agent_id, g ORDER BY day) - 1 AS INTEGER) AS days_in_state, CAST(agent_id % 10 AS INTEGER) AS cluster_id FROM isl),
hist AS (SELECT day, count(*) FILTER (state = 'S') AS S, count(*) FILTER (state = 'E') AS E, count(*) FILTER (state = 'I') AS I, count(*) FILTER (state = 'R') AS R, count(*) FILTER (state = 'D') AS D FROM panel GROUP BY day)"""
