"""Panel queries (D1 to D3, D19, E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from popgraph.operators import panel as P
from popgraph.queries.base import query, read, states


def panel(s, d):
    return P.days_in_state(states(s, d)).withColumn("cluster_id", F.pmod("agent_id", F.lit(10)).cast("int"))


@query("SELECT st AS state, count(p.state) AS count, round(100.0 * count(p.state) / (SELECT count(*) FROM panel), 6) AS percent FROM (VALUES ('S'), ('E'), ('I'), ('R'), ('D')) v(st) LEFT JOIN panel p ON p.state = st GROUP BY st")
def d1_state_distribution(s, d):
    return P.state_distribution(states(s, d))


@query("SELECT * FROM hist")
def d2_daily_history(s, d):
    return P.state_counts(states(s, d), ["day"])


_CH = """, ch AS (SELECT cluster_id, day, count(*) FILTER (state = 'S') AS S, count(*) FILTER (state = 'E') AS E, count(*) FILTER (state = 'I') AS I, count(*) FILTER (state = 'R') AS R, count(*) FILTER (state = 'D') AS D FROM panel GROUP BY ALL)"""


@query(_CH + " SELECT * FROM ch")
def d3_cluster_history(s, d):
    return P.state_counts(panel(s, d), ["cluster_id", "day"])


_NEXT = ", nx AS (SELECT *, lead(state) OVER (PARTITION BY agent_id ORDER BY day) AS n FROM panel)"
_RATE = ", ".join(f"coalesce(round(count(*) FILTER (state = '{a}' AND n = '{b}') / nullif(count(*) FILTER (state = '{a}'), 0), 6), 0.0) AS {(a + '_' + b).lower()}" for a, b in P.TRANSITIONS)


@query(_NEXT + f" SELECT cluster_id, day, {_RATE} FROM nx WHERE n IS NOT NULL GROUP BY cluster_id, day")
def d19_transition_rates(s, d):
    return P.transition_rates(panel(s, d), ["cluster_id", "day"])


@query("SELECT agent_id, day, state, days_in_state FROM panel")
def e1_days_in_state(s, d):
    return P.days_in_state(states(s, d))


_TR = ", tr AS (SELECT agent_id, day, f AS from_state, state AS to_state FROM (SELECT *, lag(state) OVER (PARTITION BY agent_id ORDER BY day) AS f FROM panel) WHERE f <> state)"


@query(_TR + " SELECT * FROM tr")
def e2_transitions(s, d):
    return P.transitions(states(s, d))


@query("SELECT agent_id, string_agg(state, '->' ORDER BY day) AS sequence FROM panel WHERE days_in_state = 0 GROUP BY agent_id")
def e2_state_sequences(s, d):
    return P.state_sequences(states(s, d))


_PH = """, ha AS (SELECT day, E + I AS active, S + E + I + R + D AS n, lag(E + I, 2) OVER (ORDER BY day) AS b FROM hist),
ph AS (SELECT day, active, CASE WHEN b IS NULL THEN 'PRE_EPIDEMIC' WHEN active / n < 0.01 THEN 'PRE_EPIDEMIC' WHEN active / n < 0.05 THEN CASE WHEN active > b * 1.5 THEN 'EXPONENTIAL_GROWTH' ELSE 'PRE_EPIDEMIC' END
 WHEN active / n < 0.2 THEN CASE WHEN active > b * 1.2 THEN 'EXPONENTIAL_GROWTH' WHEN active < b * 0.8 THEN 'DECLINE' ELSE 'PEAK' END WHEN active / n < 0.4 THEN CASE WHEN active > b * 1.1 THEN 'PEAK' ELSE 'DECLINE' END ELSE 'DECLINE' END AS phase,
 CASE WHEN b IS NOT NULL THEN round((active - b) / greatest(b, 1), 6) END AS growth FROM ha)"""


@query(_PH + " SELECT * FROM ph")
def e3_epidemic_phase(s, d):
    return P.epidemic_phase(P.state_counts(states(s, d), ["day"]))


_MULT = ", ".join(f"('{p}', '{t}', {m}::DOUBLE)" for p, ms in P.PHASE_MULTIPLIERS.items() for t, m in zip(("S->E", "E->I", "I->R"), ms, strict=True))


@query(_PH + f" SELECT day, phase, transition, multiplier FROM ph JOIN (VALUES {_MULT}) m(p, transition, multiplier) ON p = phase")
def e4_phase_multipliers(s, d):
    return P.phase_multipliers(P.epidemic_phase(P.state_counts(states(s, d), ["day"])))


@query(_PH + " SELECT day, growth FROM ph")
def e5_growth_rate(s, d):
    return P.epidemic_phase(P.state_counts(states(s, d), ["day"])).select("day", "growth")


@query(""", lg AS (SELECT *, lag(state) OVER (PARTITION BY agent_id ORDER BY day) AS f FROM panel)
SELECT cluster_id, day, count(*) FILTER (state = 'E' AND f <> 'E') AS new_exposed, count(*) FILTER (state = 'I' AND f <> 'I') AS new_infected FROM lg GROUP BY ALL""")
def e6_incidence(s, d):
    return P.incidence(panel(s, d), ["cluster_id", "day"])


@query(_CH + """, sh AS (SELECT *, round(I / (S + E + I + R + D), 6) AS x FROM ch), w AS (SELECT cluster_id, day, list(x) OVER (PARTITION BY cluster_id ORDER BY day ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS q FROM sh)
SELECT cluster_id, day, list_concat(list_transform(range(8 - len(q)), lambda i: 0.0), q) AS sequence FROM w""")
def e7_temporal_features(s, d):
    return P.lookback(P.state_counts(panel(s, d), ["cluster_id", "day"]), ["cluster_id"])


@query(_CH + """ SELECT cluster_id, day, round(CASE WHEN b IS NULL THEN 0.5 ELSE greatest(-0.5, least(0.5, (E + I - b) / (S + E + I + R + D))) + 0.5 END, 6) AS trend FROM (SELECT *, lag(E + I, 3) OVER (PARTITION BY cluster_id ORDER BY day) AS b FROM ch)""")
def e8_trend(s, d):
    return P.trend(P.state_counts(panel(s, d), ["cluster_id", "day"]), ["cluster_id"])


@query(""", fi AS (SELECT agent_id, min(day) FILTER (state <> 'S') AS f FROM panel GROUP BY agent_id)
SELECT day, round((SELECT count(*) FROM fi WHERE f <= dd.day) / (SELECT count(*) FROM fi), 6) AS attack_rate FROM (SELECT DISTINCT day FROM panel) dd""")
def e9_attack_rate(s, d):
    return P.attack_rate(states(s, d))


@query("SELECT day, I, sum(I) OVER (ORDER BY day) AS cumulative_I, CAST(floor(sum(I) OVER (ORDER BY day) * 0.001::DOUBLE) AS BIGINT) AS deaths FROM hist")
def e10_cumulative(s, d):
    return P.derived_deaths(P.state_counts(states(s, d), ["day"]).select("day", "I"), "I")


@query(""", w AS (SELECT agent_id, day, list(state) OVER (PARTITION BY agent_id ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS q FROM panel)
SELECT agent_id, day, array_to_string(list_concat(list_transform(range(7 - len(q)), lambda i: q[1]), q), '->') AS recent FROM w""")
def e11_recent_states(s, d):
    return P.recent_states(states(s, d))


@query(""", nc AS (SELECT n.agent_id, p.day, count(*) FILTER (p.state IN ('E', 'I')) AS i FROM nb n JOIN panel p ON p.agent_id = n.other_id GROUP BY ALL), w AS (SELECT agent_id, day, days_in_state, list(state) OVER (PARTITION BY agent_id ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS q FROM panel),
f AS (SELECT w.agent_id, w.day, days_in_state, coalesce(i, 0) AS i, list_concat(list_transform(range(7 - len(q)), lambda k: q[1]), q) AS q FROM w LEFT JOIN nc ON nc.agent_id = w.agent_id AND nc.day = w.day)
SELECT agent_id, day, [[CASE WHEN x = 'S' THEN 1.0 ELSE 0.0 END::DOUBLE, CASE WHEN x = 'E' THEN 1.0 ELSE 0.0 END::DOUBLE, CASE WHEN x = 'I' THEN 1.0 ELSE 0.0 END::DOUBLE, CASE WHEN x = 'R' THEN 1.0 ELSE 0.0 END::DOUBLE, CASE WHEN x = 'D' THEN 1.0 ELSE 0.0 END::DOUBLE,
 CASE WHEN k = 7 THEN round(least(days_in_state / 20.0::DOUBLE, 1.0), 6) ELSE 0.0 END::DOUBLE, CASE WHEN k = 7 THEN round(least(i / 5.0::DOUBLE, 1.0), 6) ELSE 0.0 END::DOUBLE] FOR x, k IN q] AS history FROM f""")
def e11_state_matrix(s, d):
    from popgraph.operators.risk import neighbor_states
    from popgraph.queries.base import agents, neighbors

    return P.state_history_matrix(panel(s, d), neighbor_states(neighbors(s, d), panel(s, d), agents(s, d)))


@query("SELECT CAST(count(*) AS BIGINT) AS out_of_order FROM (SELECT o_orderdate AS v, lag(o_orderdate) OVER (ORDER BY o_orderkey, o_orderdate) AS b FROM orders) WHERE v < b")
def e12_out_of_order(s, d):
    return P.count_out_of_order(read(s, d, "orders"), "o_orderkey", "o_orderdate")


@query(""", r AS (SELECT conv_id, turn, row_number() OVER w - 1 AS r, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, text))
SELECT conv_id, turn FROM r WHERE r % greatest(n // 3, 1) = 0 AND r / greatest(n // 3, 1) < 3""")
def e13_systematic_sample(s, d):
    return P.systematic_sample(read(s, d, "conversations"), "conv_id", ["turn", "text"], 3).select("conv_id", "turn")


@query(""", r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, event_id FROM r WHERE n <= 8 OR list_contains([CAST(floor(i * (n / 8)) AS BIGINT) FOR i IN range(8)], r)""")
def e13_even_sample(s, d):
    return P.systematic_sample(read(s, d, "events"), "user_id", ["ts", "event_id"], 8, even=True).select("user_id", "event_id")


@query(""", r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS r, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) AS l FROM conversations)
SELECT conv_id, turn, role, l = 1 AS is_last FROM r WHERE r <= 3 OR l = 1""")
def e14_head_and_last(s, d):
    return P.head_and_last(read(s, d, "conversations"), "conv_id", ["turn", "text"]).select("conv_id", "turn", "role", "is_last")


@query(""", r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) AS l FROM conversations) SELECT conv_id, string_agg(text, ' | ' ORDER BY l) AS context FROM r WHERE l <= 5 GROUP BY conv_id""")
def e15_recent_context(s, d):
    from popgraph.operators.retrieval import recent_context

    return recent_context(read(s, d, "conversations"), "conv_id", ["turn", "text"], "text", 5)


@query(""", it AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
acc AS (SELECT user_id, list_reduce(list_prepend({'s': 0.0::DOUBLE, 'i': 0::BIGINT, 'out': []::STRUCT(n BIGINT, total DOUBLE)[]}, list({'s': value, 'i': i, 'out': []::STRUCT(n BIGINT, total DOUBLE)[]} ORDER BY i)),
  lambda a, x: {'s': CASE WHEN a.s + x.s >= 150 THEN 0.0 ELSE a.s + x.s END, 'i': x.i, 'out': CASE WHEN a.s + x.s >= 150 THEN list_append(a.out, {'n': x.i, 'total': a.s + x.s}) ELSE a.out END}) AS r FROM it GROUP BY user_id)
SELECT user_id, u.n AS n, round(u.total, 6) AS total FROM (SELECT user_id, unnest(r.out) AS u FROM acc)""")
def e16_reset_accumulator(s, d):
    return P.reset_accumulator(read(s, d, "events"), "user_id", ["ts", "event_id"], "value", 150.0)


@query(""", it AS (SELECT user_id, event_id, value, event_type <> 'signup' AS obs, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
ob AS (SELECT *, count(*) FILTER (obs) OVER (PARTITION BY user_id ORDER BY i) AS seen FROM it),
acc AS (SELECT user_id, list_reduce(list_prepend({'s': 0.0::DOUBLE, 'i': 0::BIGINT, 'o': 0::BIGINT, 'out': []::BIGINT[]}, list({'s': value, 'i': i, 'o': seen, 'out': []::BIGINT[]} ORDER BY i)),
  lambda a, x: {'s': CASE WHEN a.s + x.s >= 150 AND x.o >= 3 THEN 0.0 ELSE a.s + x.s END, 'i': x.i, 'o': x.o, 'out': CASE WHEN a.s + x.s >= 150 AND x.o >= 3 THEN list_append(a.out, x.i) ELSE a.out END}) AS r FROM ob GROUP BY user_id),
fr AS (SELECT user_id, unnest(r.out) AS n FROM acc)
SELECT fr.user_id, CAST(fr.n AS INTEGER) AS n, CAST(row_number() OVER (PARTITION BY fr.user_id, fr.n ORDER BY it.value DESC, it.i) AS INTEGER) AS rank, event_id, value FROM fr JOIN it ON it.user_id = fr.user_id AND it.i <= fr.n AND obs QUALIFY rank <= 10""")
def e17_reflection_inputs(s, d):
    return P.reflection_inputs(read(s, d, "events"), "user_id", ["ts", "event_id"], "event_id", "value", F.col("event_type") != "signup", 150.0)


@query(""", w AS (SELECT day AS origin, list(I) OVER (ORDER BY day ROWS BETWEEN 27 PRECEDING AND CURRENT ROW) AS lookback, list(I) OVER (ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING) AS horizon FROM hist)
SELECT origin, array_to_string(lookback, ',') AS lookback, array_to_string(horizon, ',') AS horizon FROM w WHERE len(horizon) = 7""")
def e18_rolling_windows(s, d):
    w = P.rolling_windows(P.state_counts(states(s, d), ["day"]), "I")
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return w.select("origin", text("lookback"), text("horizon"))
